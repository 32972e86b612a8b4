from collections import defaultdict

import pytest
from pulsegrid.llm import mixing


def targets_of(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        left = sum(weight[s] for s in sizes if s not in stopped)
        share = {s: rest * weight[s] / max(left, 1) for s in sizes if s not in stopped}
        above = {s for s, t in share.items() if t > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s]) if s in stopped else share[s] for s in sizes}
        stopped |= above


def check(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len((text or "").split())
    want = targets_of(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        copies = max(sum(1 for d in docs if d[0] == e[0] and d[2] == s) for e in docs)
        assert abs(taken[s] - want[s]) <= 1 + copies
    return taken


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


ROWS = [(i, "w " * (i % 9), "big", 1) for i in range(200)] + [(1000, "x y z", "a", 1), (1001, "x", "b", 1), (1002, None, "c", 1), (1003, "", "c", 1), (1004, "null source here", None, 1), (7, "w " * 7, "big", 1), (7, "w " * 7, "big", 1), (None, "no id", "a", 2), (1005, "word " * 30_000, "long", 3)]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    taken = check(rows, [r[:3] for r in ROWS])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
