import random

import numpy as np
import xxhash
from pulsegrid.llm import simhash
from pulsegrid.llm.components import connected_components


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, differ=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= differ):
            x, y = find(i), find(int(j))
            up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in simhash.near_groups(docs).collect())
    assert got == brute_groups(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, None), (3, ""), (9, "one two"), (8, "ONE\ttwo"), (1, long), (2, long + " x"), (2, long + " x"), (7, "É é"), (6, " \n ")]
    docs = spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id long, text string, fp int, fingerprint string")
    assert sorted(tuple(r) for r in simhash.near_groups(docs).collect()) == brute_groups(rows)
    assert simhash.near_groups(docs.limit(0)).count() == 0
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_groups(rows)})


def test_null_and_repeated_ids_keep_one_document_of_each_group(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(7)]
    a, b, c, d, e, f, g = texts
    near = lambda t: t + " x"
    rows = [
        (None, a), (None, near(a)), (None, b), (None, b), (None, c), (30, near(c)),  # groups without an id, and with one
        (1, d), (5, near(d)), (1, e), (9, e), (2, f), (2, near(f)), (2, g), (2, g),  # one id in two groups, twice
    ]
    groups = {}
    for (_, text), (_, _, own) in zip(rows, brute_groups_in_order(rows), strict=True):
        groups.setdefault(own, set()).add(text)
    assert sorted(map(len, groups.values())) == [1, 1, 1, 2, 2, 2, 2]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_per_group(docs).collect()), key=repr)
    assert len(kept) == 7
    assert all(sum(text in members for _, text in kept) == 1 for members in groups.values())
    ids = {t: [i for i, text in kept if text in (t, near(t))] for t in texts}
    assert ids == {a: [None], b: [None], c: [30], d: [1], e: [1], f: [2], g: [2]}


def brute_groups_in_order(rows):
    """doc_id, text, number of the group, by row."""
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    own = {i: c for i, _, c in brute_groups(numbered)}
    return [(d, t, own[i]) for i, (d, t) in enumerate(rows)]


def test_large_nodes_are_cut_without_losing_links(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(500)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    want = brute_roots([f[0] for f in signed])
    for cap in (65_536, 200):
        roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(frame, 4, cap=cap)).collect()}
        groups = {}
        for f, in signed:
            groups.setdefault(roots.get(f, f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == want


def brute_roots(signed):
    a = np.array(signed, np.int64).view(np.uint64)
    left, groups = set(range(len(a))), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            near = [j for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if j in left]
            left.difference_update(near)
            todo += near
        groups.append(sorted(signed[i] for i in seen))
    return sorted(groups)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (3, 2)], "u long, v long")
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert roots == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(50)}
    assert connected_components(links.limit(0)).count() == 0
