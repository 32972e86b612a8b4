"""Exact dedup by an extendible-hash index on shared files.

Texts are normalised (A-Z lower-cased) and hashed to 64-bit keys.  The index directory starts with one bucket and doubles:
as long as a bucket holds more keys than its capacity, the directory takes one more leading bit of the key and the bucket
splits.  Owner tasks process ranges of keys: neighbouring buckets go to one owner, which reads them sorted by key.
Entries with one key form a chain; a text joins the entry of the chain that has the same bytes, so colliding keys never
merge different texts.  The owners write the index to shared files, one row per distinct text; it can be kept and read
again (``write_index``, ``read_index``), and documents are joined to it by key and digest.

Hot texts: before the shuffle each task already merges the equal texts it sees (comparing bytes, in bounded memory), so
an owner gets a text at most once per flush of a task, however many copies there are.  Where documents are joined to
their entry, those of hot entries stay where they are.

The directory has at most 2**MAX_DEPTH slots.  Beyond ``CAPACITY`` keys for each slot the capacity of a bucket grows
instead; a bucket is a sorted stream to its owner, so its size does not matter for memory, and nothing is dropped.

Cases: a null text counts as empty.  Empty texts are equal to each other.  Texts of any length are read whole.  Of equal
texts the row with the largest doc_id stays, a null doc_id being the smallest; of rows with that doc_id one stays.  A
doc_id that is no number counts as null.  An empty table gives no rows.  Columns beyond those named are ignored by
``dedup_classes`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut_lineage, new_shared_path, spread_join

MAX_DEPTH = 16
#: Keys per bucket.
CAPACITY = 4096
#: Bytes of text that a task holds for merging before it sends them on.
HELD_BYTES = 48_000_000

SEED = 42


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, SEED) - 2**63


def _digests(batches):
    """row, doc_id, text (bytes) -> row, doc_id, key, sha."""
    for batch in batches:
        texts = [(x or b"").lower() for x in batch.column("text").to_pylist()]  # of bytes: A-Z only
        keys, shas = pa.array(map(_key, texts), pa.int64()), pa.array((hashlib.sha256(x).digest() for x in texts), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), keys, shas], ["row", "doc_id", "key", "sha"])


def _merged(batches):
    """Merges equal texts of one task: doc_id, text (bytes) -> key, text (normalised), n, last (largest doc_id)."""

    def sent(held):
        items = list(held.items())
        for at in range(0, len(items), 2000):
            part = items[at : at + 2000]
            columns = [_key(x) for x, _ in part], [x for x, _ in part], [n for _, (n, _) in part], [d for _, (_, d) in part]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "text", "n", "last"])

    held: dict[bytes, tuple[int, int | None]] = {}
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = (text or b"").lower()
            if text in held:
                n, last = held[text]
                held[text] = (n + 1, doc if last is None or doc is not None and doc > last else last)
            else:
                held[text] = (1, doc)
                size += len(text) + 100
                if size > HELD_BYTES:
                    yield from sent(held)
                    held, size = {}, 0
    yield from sent(held)


def _owned(batches):
    """One owner's entries, sorted by bucket and key -> key, sha, keep_id, group_size."""
    key, chain = None, {}
    done: list[tuple] = []

    def closed():
        done.extend((key, hashlib.sha256(text).digest(), last, n) for text, (n, last) in chain.items())

    def flushed():
        columns = list(zip(*done, strict=True))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "sha", "keep_id", "group_size"])

    for batch in batches:
        for k, text, n, last in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "n", "last")), strict=True):
            if k != key:
                if key is not None:
                    closed()
                key, chain = k, {}
            if text in chain:  # a dictionary of bytes compares bytes
                m, best = chain[text]
                chain[text] = (m + n, last if best is None or last is not None and last > best else best)
            else:
                chain[text] = (n, last)
        if len(done) > 5000:
            yield flushed()
            done.clear()
    if key is not None:
        closed()
    if done:
        yield flushed()


def _slot(max_depth: int):
    return F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 64 - max_depth).cast("int")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """keys: key.  Buckets as (prefix, depth, keys in it) of an extendible-hash directory, in key order.

    Counts by leading bits come from one aggregate over the keys, at most 2**max_depth rows; doubling works on them.
    """
    counts = {r["slot"]: r["count"] for r in keys.groupBy(_slot(max_depth).alias("slot")).count().collect()}
    total = sum(counts.values())
    capacity = max(capacity, 4 * total >> max_depth)
    buckets, depth, split = [], 0, {0: total}
    while split:
        overfull = {p for p, n in split.items() if n > capacity and depth < max_depth}
        buckets += [(p, depth, n) for p, n in split.items() if p not in overfull]
        depth += 1
        halves: dict[int, int] = {child: 0 for p in overfull for child in (2 * p, 2 * p + 1)}
        for s, n in counts.items() if halves else ():
            if (p := s >> max_depth - depth) in halves:
                halves[p] += n
        split = halves
    return sorted(buckets, key=lambda b: b[0] << max_depth - b[1])


def _owners(spark: SparkSession, buckets: list[tuple[int, int, int]], max_depth: int) -> tuple[DataFrame, int]:
    """slot, owner: neighbouring buckets go to one owner, up to an equal part of the keys; and the number of owners."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = max(1, -(-sum(n for _, _, n in buckets) // tasks))
    slots, before = [], 0
    for prefix, depth, n in buckets:
        owner = min(before // part, tasks - 1)
        slots += [(s, owner) for s in range(prefix << max_depth - depth, (prefix + 1) << max_depth - depth)]
        before += n
    return spark.createDataFrame(slots, "slot int, owner int"), tasks  # 2**max_depth rows


def _to_owners(entries: DataFrame, buckets: list[tuple[int, int, int]], max_depth: int) -> DataFrame:
    """entries: key and others.  Deals them to the owners of their key ranges, sorted by key."""
    lookup, tasks = _owners(entries.sparkSession, buckets, max_depth)
    dealt = entries.withColumn("slot", _slot(max_depth)).join(F.broadcast(lookup), "slot")
    return dealt.repartitionById(tasks, "owner").drop("slot", "owner").sortWithinPartitions("key")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def write_index(documents: DataFrame, path: str, keys: DataFrame | None = None, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> None:
    """documents: doc_id, text.  Writes the index to ``path``: its directory and its entries, as Parquet files.

    keys: column key of the documents, if it is known already.
    """
    rows = _texts(documents)
    if keys is None:
        keys = rows.mapInArrow(_digests, "row long, doc_id long, key long, sha binary").select("key")
    buckets = directory(keys, capacity, max_depth)
    entries = _to_owners(rows.mapInArrow(_merged, "key long, text binary, n long, last long"), buckets, max_depth)
    owned = entries.mapInArrow(_owned, "key long, sha binary, keep_id long, group_size long")
    owned.write.mode("overwrite").parquet(f"{path}/entries")
    documents.sparkSession.createDataFrame(buckets, "prefix int, depth int, keys long").write.mode("overwrite").parquet(f"{path}/directory")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """key, sha, keep_id, group_size: one row per distinct text of an index."""
    return spark.read.parquet(f"{path}/entries")


def dedup_classes(documents: DataFrame, **options) -> DataFrame:
    """documents: doc_id, text.  Returns one row per document: doc_id, keep_id, group_size, kept, text_sha256, key."""
    spark = documents.sparkSession
    digests = cut_lineage(_texts(documents).mapInArrow(_digests, "row long, doc_id long, key long, sha binary"))
    path = new_shared_path(spark, "index")
    write_index(documents, path, digests.select("key"), **options)
    # Colliding keys are told apart by the digest of the text.
    joined = spread_join(digests, read_index(spark, path).withColumn("n", F.col("group_size")), ["key", "sha"])
    joined = cut_lineage(joined.withColumn("best", F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    # Of rows with one text and the doc_id that stays, the first is kept; only these meet.
    best = joined.drop("n").where("best")
    repeats = best.groupBy("key", "sha").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    kept = spread_join(best, repeats, ["key", "sha"], "left").withColumn("kept", F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    rows = kept.drop("first", "n").unionByName(joined.drop("n").where("NOT best").withColumn("kept", F.lit(False)))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "key")


def _later(one: tuple, other: tuple) -> bool:
    """Whether the first of two rows of one text (doc_id, struct array, place) stays: larger doc_id, then smaller in all columns."""
    if one[0] != other[0]:
        return other[0] is None or one[0] is not None and one[0] > other[0]
    return repr(one[1][one[2]].as_py()) < repr(other[1][other[2]].as_py())


def _taken(rows: list[tuple], keyed: bool, names: list[str]):
    """Batches of rows given as (doc_id, struct array, place): with their key, or as plain columns."""
    places: dict[int, tuple] = {}
    for _, docs, at in rows:
        places.setdefault(id(docs), (docs, []))[1].append(at)
    for docs, at in places.values():
        part = docs.take(pa.array(at, pa.int64()))
        yield part if keyed else pa.RecordBatch.from_arrays(part.flatten(), names)


def _firsts(text_at: int):
    """Of equal texts of one task the row that stays: doc_id, doc -> key, doc_id, doc."""

    def sent(held):
        for part in _taken(list(held.values()), True, []):
            docs = part.field(0)
            keys = [_key((x or b"").lower()) for x in docs.field(text_at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.field(1), docs], ["key", "doc_id", "doc"])

    def run(batches):
        held: dict[bytes, tuple] = {}
        size = 0  # of the texts and rows held, those that were replaced since included
        for batch in batches:
            new: set[bytes] = set()
            docs, ids = batch.column("doc"), batch.column("doc_id")
            both = pa.StructArray.from_arrays([docs, ids], ["doc", "doc_id"])
            for i, (doc, text) in enumerate(zip(ids.to_pylist(), docs.field(text_at).cast(pa.binary()).to_pylist(), strict=True)):
                text = (text or b"").lower()
                if text not in held:
                    size += len(text) + 100
                elif not _later((doc, both, i), held[text]):
                    continue
                held[text] = (doc, both, i)
                new.add(text)
            if new:  # rows that stay are copied out of their batch, which is freed
                own = both.take(pa.array([held[text][2] for text in new], pa.int64()))
                held.update({text: (held[text][0], own, i) for i, text in enumerate(new)})
                size += own.nbytes
            if size > HELD_BYTES:
                yield from sent(held)
                held, size = {}, 0
        yield from sent(held)

    return run


def _stayed(text_at: int, names: list[str]):
    """One owner's rows, sorted by key: key, doc_id, doc -> the columns of the row that stays of each text."""

    def run(batches):
        key, chain = None, {}
        for batch in batches:
            docs, done = batch.column("doc"), []
            texts = docs.field(text_at).cast(pa.binary()).to_pylist()
            for i, (k, doc, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True)):
                if k != key:
                    done += chain.values()
                    key, chain = k, {}
                text, row = (text or b"").lower(), (doc, docs, i)
                if text not in chain or _later(row, chain[text]):
                    chain[text] = row
            yield from _taken(done, False, names)
        yield from _taken(list(chain.values()), False, names)

    return run


def keep_one(documents: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The documents that stay, with all their columns: owners give back the rows themselves, so texts are shuffled once."""
    names = documents.columns
    text_at = names.index("text")
    rows = documents.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"))
    keys = _texts(documents).mapInArrow(_digests, "row long, doc_id long, key long, sha binary").select("key")
    kinds = rows.schema["doc"].dataType.simpleString()
    entries = _to_owners(rows.mapInArrow(_firsts(text_at), f"key long, doc_id long, doc {kinds}"), directory(keys, capacity, max_depth), max_depth)
    return entries.mapInArrow(_stayed(text_at, names), documents.schema)
