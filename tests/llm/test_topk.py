import random

import numpy as np
import pytest
from pulsegrid.llm import topk
from pyspark.sql import functions as F


def brute(vectors, asked, k):
    rows = [(i, v) for i, v in vectors if i is not None and v is not None and None not in v]
    out = []
    for n, (q, v) in enumerate(rows):
        if asked(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block,roots", [(16_384, 4_096, 20_000), (40, 3, 20_000), (7, 50, 3)])
def test_matches_brute_force_with_ties_and_odd_rows(spark, shard, block, roots):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) for _ in range(6)]) for i in range(300)]
    rows += [(500, None), (501, [1, None, 2, 3, 4, 5]), (None, [1] * 6), (502, [1, 2]), (503, [3, 4]), (504, []), (505, []), (0, rows[0][1]), (7, [9] * 6), (600, [10**6] * 6), (601, [10**6] * 6)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, vec array<long>, query_id string, score int")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.expr("id % 20 = 0 OR id > 499"), 5, shard, block, roots).collect())
    assert got == brute(rows, lambda i: i % 20 == 0 or i > 499, 5)


def test_one_vector_that_most_rows_share(spark):
    rows = [(i, [1, 2]) for i in range(150)] + [(i, [i % 7, -i % 5]) for i in range(150, 220)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "id long, vec array<long>"), F.col("id") % 50 == 0, 5, 20, 2).collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)


def test_empty(spark):
    frame = spark.createDataFrame([], "id long, vec array<long>")
    assert topk.top_k(frame, F.lit(True)).count() == 0


def test_search_prunes_but_stays_exact():
    rng = np.random.default_rng(0)
    points = rng.integers(-50, 50, (2000, 8)) + 400 * rng.integers(0, 4, (2000, 1))
    tree = topk.BallTree(np.arange(2000), np.arange(2000), points)
    for i in range(0, 2000, 211):
        scores = points @ points[i]
        want = sorted(((int(s), -j, -j) for j, s in enumerate(scores) if j != i), reverse=True)[:5]
        assert sorted(tree.search(points[i], i, 5, -np.inf), reverse=True) == want
        assert sorted(tree.search(points[i], i, 5, want[4][0]), reverse=True) == want
