"""Quantile regression against all corners of its linear program, the quantile forest against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import models


def corners(x, y, tau, lam):
    """The least mean pinball loss + lam |coef| over all points where as many terms vanish as there are coefficients."""
    n, p = x.shape
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    a = np.vstack([np.column_stack([np.ones(n), scaled]), np.column_stack([np.zeros(p), np.eye(p)])])
    b = np.r_[y, np.zeros(p)]
    best = (math.inf, None)
    for rows in map(list, itertools.combinations(range(n + p), p + 1)):
        if abs(np.linalg.det(a[rows])) > 1e-9:
            beta = np.linalg.solve(a[rows], b[rows])
            best = min(best, (models.quantile_loss(y - a[:n] @ beta, tau) + lam * np.abs(beta[1:]).sum(), beta.tolist()))
    return best


def fitted(df, names, taus, lams):
    got = {}
    for r in models.quantile_regression_grid(df, names, "y", taus, lams).collect():
        got.setdefault((r["tau"], r["lam"]), {})[r["feature"]] = r["coef"]
    return {cell: [coefs[n] for n in ("", *names)] for cell, coefs in got.items()}


def test_quantile_regression_finds_the_best_corner(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(24, 2))
    y = 3 * x[:, 0] + rng.standard_t(3, 24)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    taus, lams = [0.13, 0.5, 0.77], [0.003, 0.21, 5.0]
    got = fitted(df.repartition(5), ["a", "b"], taus, lams)
    assert len(got) == 9
    for (tau, lam), beta in got.items():
        value, best = corners(x, y, tau, lam)
        if lam == 5.0:  # above every slope: coefficients are exactly zero, the intercept is any quantile
            assert beta[1:] == [0.0, 0.0]
            assert models.quantile_loss(y - beta[0], tau) == pytest.approx(value, abs=1e-7)
        else:
            assert beta == pytest.approx(best, abs=1e-5)
            assert [b == 0 for b in beta] == [abs(b) < 1e-12 for b in best]


def test_quantile_regression_does_not_depend_on_size_or_cut(spark):
    """Every row many times over, in other partitions: the same optimum and the same zeros, far beyond 20,000 rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(301, 4))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=301)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, d double, y double").coalesce(1)
    one = fitted(df, list("abcd"), [0.3], [0.02, 0.1])
    many = fitted(df.crossJoin(spark.range(100)).drop("id").repartition(7), list("abcd"), [0.3], [0.02, 0.1])
    for cell, beta in one.items():
        assert beta == pytest.approx(many[cell], abs=1e-4)
        assert [b == 0 for b in beta] == [b == 0 for b in many[cell]]


def test_quantile_regression_of_few_constant_or_no_rows(spark):
    schema = "a double, b double, y double"
    assert models.quantile_regression_grid(spark.createDataFrame([], schema), ["a", "b"], "y", [0.5], [0.1]).count() == 0
    flat = fitted(spark.createDataFrame([(1.0, float(i), 4.0) for i in range(5)], schema), ["a", "b"], [0.5], [0.1])
    assert flat[0.5, 0.1] == pytest.approx([4.0, 0.0, 0.0], abs=1e-6)


def plain_percentile(values, weights, q):
    at = sorted((v, w) for v, w in zip(values, weights, strict=True) if w > 0)
    total, run, points = sum(w for _, w in at), 0.0, []
    for v, w in at:
        points.append((100 / total * (run + w / 2), v))
        run += w
    return float(np.interp(q, [p for p, _ in points], [v for _, v in points]))


def test_leaf_weights_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    bag = [(t, int(rng.integers(3)), float(rng.integers(6)), int(rng.poisson(1))) for t in range(4) for _ in range(30)]
    asked = [(k, t, int(rng.integers(3))) for k in range(9) for t in range(4)]
    df = models.leaf_weights(spark.createDataFrame(bag, "__tree int, __leaf int, __y double, __count int"), spark.createDataFrame(asked, "key long, __tree int, __leaf int"), "key")
    want = {}
    for k, t, leaf in asked:
        inside = [(y, c) for u, v, y, c in bag if (u, v) == (t, leaf) and c]
        for y, c in inside:
            want[k, y] = want.get((k, y), 0.0) + c / sum(c for _, c in inside)
    assert {(r["key"], r["__y"]): r["__weight"] for r in df.collect()} == pytest.approx(want)


def test_bootstrap_counts_are_poisson_and_repeatable(spark):
    df = spark.range(4000).withColumn("k", F.array(*(models.bootstrap_count(F.lit(t), 3, "id") for t in range(5))))
    got = {r["id"]: r["k"] for r in df.collect()}
    assert got == {r["id"]: r["k"] for r in df.repartition(7).collect()}
    k = np.array([got[i] for i in range(4000)])
    assert k.shape == (4000, 5) and np.abs(k.mean(axis=0) - 1).max() < 0.07 and np.abs((k == 0).mean(axis=0) - math.exp(-1)).max() < 0.03
    assert np.abs(np.corrcoef(k.T) - np.eye(5)).max() < 0.06


def test_one_tree_of_one_leaf_gives_percentiles_of_its_bootstrap_sample(spark):
    rows = [(i, 1.0, float(i % 11)) for i in range(200)] + [(500, None, 3.0), (501, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    got = {(r["id"], r["percent"]): r["value"] for r in models.quantile_forest(df.where("y IS NOT NULL"), df, "id", ["a"], "y", [10.0, 50.0], trees=3, seed=4).collect()}
    assert {k for k, _ in got} == set(range(200)) | {501}
    drawn = df.where("id < 200").withColumn("row", F.xxhash64("id", "y", F.array("a"))).orderBy("id")
    counts = [r["k"] for r in drawn.select(F.array(*(models.bootstrap_count(F.lit(t), 4, "row") for t in range(3))).alias("k")).collect()]
    by = {}
    for (_, _, y), ks in zip(rows, counts, strict=False):
        for t in range(3):
            by[y] = by.get(y, 0.0) + ks[t] / sum(c[t] for c in counts)
    for q in (10.0, 50.0):
        assert got[7, q] == pytest.approx(plain_percentile(list(by), list(by.values()), q)) == pytest.approx(got[501, q])


def test_forest_separates_groups_and_is_repeatable(spark):
    df = spark.createDataFrame([(i, float(i % 2), float(10 * (i % 2) + i % 5)) for i in range(120)], "id long, a double, y double")
    got = [{r["id"]: r["value"] for r in models.quantile_forest(d, d, "id", ["a"], "y", [50.0], trees=4).collect()} for d in (df, df.repartition(3))]
    assert got[0] == pytest.approx(got[1])
    assert all((v > 9) == (i % 2 == 1) for i, v in got[0].items())
