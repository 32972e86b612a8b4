"""SimHash near-dedup with a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint; documents link when their fingerprints differ in few bits, and groups are the
connected components.  The index over the distinct fingerprints has three levels:

* Upper nodes are shared masked bit patterns.  The 64 bits are cut into blocks; fingerprints that differ in at most d
  bits agree on all but d of the blocks, so they meet under a node "these blocks have this pattern".  The nodes
  are the shuffle key: a link is never lost, and groups without a common pattern never meet.
* Below a node, fingerprints are sorted by their rank in the Gray code, which puts similar patterns next to each other,
  and are halved into nodes that keep the bits all of their members share.
* Pairs of nodes are pruned as a whole when the bits in which their shared patterns differ add up to more than d, or
  when all their members are already linked.  Only leaves compare fingerprints.

A node passes on one link per fingerprint (its union-find tree), not its pairs.  A node with more than ``NODE_CAP``
fingerprints is cut along the Gray order into chunks, and the pairs of chunks whose patterns differ in at most d bits
become tasks of their own, so the size of a task is bounded and nothing is left out.

``near_groups`` links fingerprints of word shingles.  Those are far apart (ten bits and more) for texts with a few changed
words, so ``one_per_group``, which is to find such texts, takes two fingerprints of the distinct words, weighted by their
inverse document frequency over the whole corpus, and the same index for each.

Cases: a null text counts as empty; its fingerprint is zero, which links like any other.  A text with fewer words than a
shingle is one shingle.  Texts of any length are read whole.  Copies share a fingerprint and enter the index once.  A
null doc_id, or one that is no number, is ignored where the smallest doc_id is taken; a group without any doc_id still
keeps one document.  An empty table gives no rows.  Columns beyond those named are ignored by ``near_groups``, and kept by
``one_per_group``, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import cut_lineage, spread_join

NODE_CAP = 65_536
LEAF = 64
BLOCKS = 6


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of a UTF-8 text: majority bits of the XXH64 of its word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 50_000):
        upto = min(n, at + 50_000)
        spans = zip(starts[at:upto].tolist(), ends[at + shingle - 1 : upto + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _word_hashes(text: bytes, seed: int, known: dict[bytes, int]) -> np.ndarray:
    """XXH64 of the distinct words of a UTF-8 text, in no order."""
    words = set(text.lower().split())
    if len(known) > 1_000_000:
        known.clear()
    for w in words.difference(known):
        known[w] = xxhash.xxh64_intdigest(w, seed)
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def word_weights(documents: DataFrame, seed: int = 42, bits: int = 18) -> np.ndarray:
    """Logarithmic inverse document frequency of words by the leading bits of their hash, counted over all documents.

    The table has 2**bits entries, whatever the corpus; words that share an entry share their weight.
    """

    def counted(batches):
        rows, known = np.zeros(2**bits + 1, np.int64), {}
        for batch in batches:
            rows[-1] += batch.num_rows
            for text in batch.column("text"):
                rows[np.unique(_word_hashes(text.as_py() or b"", seed, known) >> np.uint64(64 - bits)).astype(np.int64)] += 1
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[at])], ["entry", "docs"])

    total = documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "entry long, docs long").groupBy("entry").agg(F.sum("docs").alias("docs"))
    found = np.ones(2**bits + 1)
    for entry, docs in total.toPandas().itertuples(index=False):  # 2**bits + 1 rows at most
        found[entry] = docs
    return np.log1p(found[-1] / found[:-1]).astype(np.float32)


def word_fingerprints(text: bytes, weights: np.ndarray, seed: int = 42, known: dict[bytes, int] | None = None) -> tuple[int, int]:
    """Two unsigned SimHashes of the distinct words of a UTF-8 text: bits that are set in more than half of the words' weight.

    The second takes the words' hashes through another mixing; what moves one by too many bits seldom moves both.
    """
    hashes = _word_hashes(text, seed, {} if known is None else known)
    if not len(hashes):
        return 0, 0
    hashes.sort()  # sums of floats depend on the order
    weight = weights[(hashes >> np.uint64(64 - len(weights).bit_length() + 1)).astype(np.int64)]
    half, out = weight.sum(dtype=np.float64) / 2, []
    for own in (hashes, _mixed(hashes)):
        counts = np.zeros(64)
        for at in range(0, len(own), 50_000):
            counts += weight[at : at + 50_000] @ np.unpackbits(own[at : at + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        out.append(int(np.packbits(counts > half, bitorder="little").view("<u8")[0]))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    return h ^ (h >> np.uint64(31))


def fingerprints(documents: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """documents: doc_id, text.  Returns doc_id, fp (long with the bits of the fingerprint)."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(v.as_py() or b"", shingle, seed) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return _bytes(documents).mapInArrow(run, "doc_id long, fp long")


def weighted_fingerprints(documents: DataFrame, weights: np.ndarray, seed: int = 42) -> DataFrame:
    """documents: doc_id, text.  Returns doc_id, sha (SHA-256 of the text), fp and fp2 of its weighted words."""

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = [v.as_py() or b"" for v in batch.column("text")]
            pairs = np.array([word_fingerprints(x, weights, seed, known) for x in texts], np.uint64).reshape(-1, 2)
            shas = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), shas, *(pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1))], ["doc_id", "sha", "fp", "fp2"])

    return _bytes(documents).mapInArrow(run, "doc_id long, sha binary, fp long, fp2 long")


def _bytes(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def gray_rank(fp: Column) -> Column:
    """Rank of a bit pattern in the Gray code, as a long that sorts like the unsigned rank."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def block_masks(differ: int, blocks: int = BLOCKS) -> list[int]:
    """Masks over all choices of ``blocks - differ`` blocks, as signed 64-bit numbers."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(one, blocks - differ))]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def linked(fps: np.ndarray, side: np.ndarray | None, differ: int) -> list[tuple[int, int]]:
    """Links (position, position of its root) among fingerprints sorted by Gray rank.

    side: 0 or 1 of each fingerprint if only links between the two sides are looked for, else None.
    """
    n, forest = len(fps), _Forest(len(fps))
    nodes: list[tuple[int, int]] = [(0, n)]
    kids: list[tuple[int, int] | None] = []
    for lo, hi in nodes:  # grows while it is read
        if hi - lo <= LEAF:
            kids.append(None)
        else:
            mid = (lo + hi) // 2
            kids.append((len(nodes), len(nodes) + 1))
            nodes += [(lo, mid), (mid, hi)]
    ones = [int(np.bitwise_and.reduce(fps[lo:hi])) for lo, hi in nodes]
    some = [int(np.bitwise_or.reduce(fps[lo:hi])) for lo, hi in nodes]
    whole: dict[int, bool] = {}

    def root(node: int) -> int | None:
        """The root of all members, if they have one."""
        lo, hi = nodes[node]
        first = forest.find(lo)
        if whole.get(node) or all(forest.find(i) == first for i in range(lo, hi)):
            whole[node] = True
            return first
        return None

    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        if ((ones[a] & ~some[b]) | (ones[b] & ~some[a])).bit_count() > differ:
            continue
        if kids[a] is None and kids[b] is None:
            if (r := root(a)) is not None and r == root(b):
                continue
            (lo, hi), (lo2, hi2) = nodes[a], nodes[b]
            near = np.bitwise_count(fps[lo:hi, None] ^ fps[None, lo2:hi2]) <= differ
            if side is not None:
                near &= side[lo:hi, None] != side[None, lo2:hi2]
            for i, j in zip(*np.nonzero(near), strict=True):
                if lo + i != lo2 + j:
                    forest.link(int(lo + i), int(lo2 + j))
        elif a == b:
            left, right = kids[a]
            stack += [(left, right), (right, right), (left, left)]
        else:
            if kids[b] is None or kids[a] is not None and nodes[a][1] - nodes[a][0] >= nodes[b][1] - nodes[b][0]:
                stack += [(k, b) for k in kids[a]]
            else:
                stack += [(a, k) for k in kids[b]]
    return [(i, r) for i in range(n) if (r := forest.find(i)) != i]


def _search(differ: int):
    """Rows sorted by node, then Gray rank: node, fp, side -> u, v."""

    def links_of(node: np.ndarray, fp: np.ndarray, side: np.ndarray):
        cuts = np.flatnonzero(np.diff(node)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(node)]
        size = ends - starts
        u, v = [], []
        small = (size > 1) & (size <= LEAF)
        # Small nodes are single leaves: all of them at once, by distance in the order.
        last = np.repeat(np.where(small, ends, starts), size)
        at, step, pairs = np.arange(len(node)), 1, []
        while len(at := at[at + step < last[at]]):
            hit = at[(np.bitwise_count(fp[at] ^ fp[at + step]) <= differ) & ((side[at] < 0) | (side[at] != side[at + step]))]
            pairs += zip(hit.tolist(), (hit + step).tolist(), strict=True)
            step += 1
        if pairs:
            forest: dict[int, int] = {}

            def find(i):
                while (j := forest.get(i, i)) != i:
                    i = j
                return i

            for i, j in pairs:
                i, j = find(i), find(j)
                if i != j:
                    forest[max(i, j)] = min(i, j)
            for i in list(forest):
                u.append(fp[i])
                v.append(fp[find(i)])
        for k in np.flatnonzero(size > LEAF):
            lo, hi = starts[k], ends[k]
            for i, r in linked(fp[lo:hi], None if side[lo] < 0 else side[lo:hi], differ):
                u.append(fp[lo + i])
                v.append(fp[lo + r])
        return u, v

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "fp", "side")]
            held.append((rows[0], rows[1].view(np.uint64), rows[2]))
            if held[0][0][0] != rows[0][-1]:  # all but the last node are whole
                node, fp, side = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(node != node[-1])[-1]) + 1
                u, v = links_of(node[:cut], fp[:cut], side[:cut])
                held = [(node[cut:], fp[cut:], side[cut:])]
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])
        if held:
            u, v = links_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])

    return run


def _chunked(rows: DataFrame, hot: DataFrame, differ: int, cap: int) -> DataFrame:
    """Rows of nodes above the cap -> rows of pairs of chunks: node, fp, side (-1 inside a chunk)."""
    keyed = rows.join(hot, "node").withColumn("rank", gray_rank(F.col("fp")))
    # Chunks of equal size along the Gray order, by position: ranges of the sorted node, numbered inside range partitions.
    place = F.row_number().over(Window.partitionBy("node", "slice").orderBy("rank"))
    sliced = keyed.withColumn("slice", F.shiftright("rank", 48).cast("int"))
    sizes = sliced.groupBy("node", "slice").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("node").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("node", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    members = sliced.join(sizes, ["node", "slice"]).withColumn("chunk", F.floor((F.col("before") + place - 1) / (cap // 2)).cast("int"))
    members = cut_lineage(members.select("node", "chunk", "fp"))
    shared = members.groupBy("node", "chunk").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("some"))
    a, b = shared.alias("a"), shared.alias("b")
    apart = F.bit_count(F.col("a.ones").bitwiseAND(F.bitwise_not("b.some")).bitwiseOR(F.col("b.ones").bitwiseAND(F.bitwise_not("a.some"))))
    pairs = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.chunk") <= F.col("b.chunk"))).where(apart <= differ)
    pairs = pairs.select("a.node", F.col("a.chunk").alias("one"), F.col("b.chunk").alias("two"))
    ends = pairs.select("node", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("chunk"))
    return members.join(ends, ["node", "chunk"]).select(
        F.xxhash64("node", "one", "two").alias("node"), "fp",
        F.when(F.col("one") == F.col("two"), -1).when(F.col("chunk") == F.col("one"), 0).otherwise(1).cast("int").alias("side"),
    )


def near_links(distinct: DataFrame, differ: int = 4, blocks: int = BLOCKS, cap: int = NODE_CAP) -> DataFrame:
    """distinct: fp, without repeats.  Returns u, v: links whose components are those of all pairs within ``differ`` bits."""
    fp = F.col("fp")
    patterns = [F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(differ, blocks))]
    rows = distinct.select("fp", F.explode(F.array(*patterns)).alias("node"))
    # The node is a hash of mask and pattern: a collision only makes a node larger.
    hot = cut_lineage(rows.groupBy("node").count().where(F.col("count") > cap).select("node"))
    plain = rows.withColumn("side", F.lit(-1))
    if not hot.isEmpty():
        plain = plain.join(hot, "node", "left_anti").select("node", "fp", "side").unionByName(_chunked(rows, hot, differ, cap))
    ordered = plain.select("node", "fp", "side").repartition("node").sortWithinPartitions("node", gray_rank(fp))
    return ordered.mapInArrow(_search(differ), "u long, v long")


def _members(own: DataFrame, least: Column, differ: int, blocks: int = BLOCKS) -> DataFrame:
    """own: fp and the columns of ``least``.  Returns fp, n (rows), least (aggregated by fingerprint), root: one row per fingerprint.

    root is null for a fingerprint without links.  With a column fp2, what links by that is linked, too.
    """
    distinct = cut_lineage(own.groupBy("fp").agg(F.count("*").alias("n"), least.alias("least")))
    links = near_links(distinct.select("fp"), differ, blocks)
    if "fp2" in own.columns:
        # The second fingerprints stand for the smallest first one that they occur with.
        both = cut_lineage(own.groupBy("fp2", "fp").agg(F.count("*").alias("n")))
        first = cut_lineage(both.groupBy("fp2").agg(F.min("fp").alias("first")))
        same = both.join(first, "fp2").where(F.col("fp") != F.col("first")).select(F.col("fp").alias("u"), F.col("first").alias("v"))
        second = near_links(first.select(F.col("fp2").alias("fp")), differ, blocks)
        for end in ("u", "v"):
            second = second.join(first.select(F.col("fp2").alias(end), F.col("first").alias(f"{end}_")), end).drop(end)
        links = links.unionByName(same).unionByName(second.select(F.col("u_").alias("u"), F.col("v_").alias("v")))
    roots = connected_components(links)
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", "root")


def near_groups(documents: DataFrame, shingle: int = 4, differ: int = 4, seed: int = 42) -> DataFrame:
    """documents: doc_id, text.  Returns one row per document: doc_id, fingerprint (16 hex digits), component_id."""
    own = cut_lineage(fingerprints(documents, shingle, seed))
    members = cut_lineage(_members(own, F.min("doc_id"), differ))
    linked = members.where("root IS NOT NULL")
    groups = linked.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    of_fp = spread_join(linked.withColumnRenamed("n", "rows"), groups, ["root"]).select("fp", F.col("rows").alias("n"), "component_id")
    of_fp = cut_lineage(of_fp.unionByName(members.where("root IS NULL").select("fp", "n", F.col("least").alias("component_id"))))
    return spread_join(own, of_fp, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(documents: DataFrame, differ: int = 6, seed: int = 42, blocks: int = 9) -> DataFrame:
    """The document with the smallest doc_id of each group, with all columns; one with a null doc_id only if no other is there.

    Fingerprints are two of the weighted words (``word_weights``), which a change of few words moves by few bits; documents
    link if either is near.  Of
    the group's texts that share the doc_id the one with the smallest SHA-256 stays; of rows that share both, the first by
    all columns.  Equal texts are in one group, so (doc_id, digest) belongs to one group only.
    """
    names = [F.col(f"`{c}`") for c in documents.columns]
    own = cut_lineage(weighted_fingerprints(documents, word_weights(documents, seed), seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha"))
    kept = _members(own, first, differ, blocks).groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    key = lambda doc, sha: F.sha2(F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("-")), F.hex(sha)), 256).alias("__key")
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = documents.select(F.struct(*names).alias("__doc"), key(F.col("doc_id").try_cast("long"), sha))
    # One shuffle of the texts: the join's key puts the window's rows together, too.
    stay = rows.join(kept.select(key(F.col("least.doc_id"), F.col("least.sha"))), "__key", "left_semi")
    number = F.row_number().over(Window.partitionBy("__key").orderBy("__doc"))
    return stay.withColumn("__n", number).where("__n = 1").select("__doc.*")
