"""Running values, ranks, curves and correlations with groups over several partitions, against plain loops."""

import math
import random

import numpy as np
import pytest
from pulsegrid.functions import signals as helpers
from pulsegrid.operators import evaluation, hrv, ranges, signals
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small partitions stay apart, so that groups reach over them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def groups(seed=1, sizes=((1, 400), (2, 3), (None, 150), (4, 1))):
    rng = random.Random(seed)
    rows = [(k, i, rng.choice([None, rng.randint(-5, 5)])) for k, n in sizes for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_running_values(spark):
    rows = groups()
    one, v = F.lit(1), F.col("v")
    start = ranges.ranged(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"])
    assert start.select("__pid").distinct().count() > 4
    out = ranges.running(start, ["k"], ["i"], sums={"s": v, "at": one}, totals={"n": one, "t": v}, before={"b": v}, after={"a": v}, last={"l": v}, following={"f": v})
    found = {(r["k"], r["i"]): tuple(r[c] for c in ("s", "at", "n", "t", "b", "a", "l", "f")) for r in out.collect()}
    assert len(found) == len(rows)
    for k in {r[0] for r in rows}:
        series = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        known = [x for x in series if x is not None]
        for i, _ in enumerate(series):
            left, right = [x for x in series[: i + 1] if x is not None], [x for x in series[i:] if x is not None]
            want = (sum(left), i + 1, len(series), sum(known) if known else None, series[i - 1] if i else None, series[i + 1] if i + 1 < len(series) else None, left[-1] if left else None, right[0] if right else None)
            assert found[k, i] == want
    placed = ranges.places(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"])
    assert placed.where("__at <> i").count() == 0
    gaps = ranges.filled(placed, ["k"], ["i"], "v")
    for k in {r[0] for r in rows}:
        series = np.array([np.nan if r[2] is None else r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])], float)
        got = [r["v"] for r in gaps.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("i").collect()]
        if np.isfinite(series).any():
            at = np.arange(len(series))
            assert got == pytest.approx(np.interp(at, at[np.isfinite(series)], series[np.isfinite(series)]))
        else:
            assert set(got) == {None}


def test_attached(spark):
    rows = ranges.ranged(spark.createDataFrame(groups(), "k int, i int, v int"), ["k"], ["i"])
    per = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b"), (9, "z")], "k int, name string")
    found = ranges.attached(rows, ["k"], per).groupBy("k", "name").count().collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, "a", 400), (2, "b", 3), (None, "n", 150), (4, None, 1)], key=repr)


def test_curves_and_percentiles(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, round(rng.random(), 2)]), rng.randint(0, 1), float(rng.randint(0, 3))) for k, n in (("a", 900), ("b", 5)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, score double, label int, w double")
    points = evaluation.roc_points(df, ["k"])
    got = {(r["k"], r["threshold"]): (r["tpr"], r["fpr"]) for r in points.collect()}
    areas = {r["k"]: r["auc"] for r in evaluation.auc(points, ["k"], 9).collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        p, n = sum(r[2] for r in own), sum(1 - r[2] for r in own)
        before, area = (0.0, 0.0), 0.0
        for t in sorted({r[1] for r in own if r[1] is not None}, reverse=True) + [None]:
            up = [r for r in own if t is None or r[1] is not None and r[1] >= t]
            want = sum(r[2] for r in up) / p, sum(1 - r[2] for r in up) / n
            if (k, t) in got:
                assert got[k, t] == pytest.approx(want)
                area += (want[1] - before[1]) * (want[0] + before[0]) / 2
                before = want
        assert areas[k] == pytest.approx(area, abs=1e-8)
    percents = [0, 1, 25, 50, 62.5, 99, 100]
    found = {(r["k"], r["percent"]): r["value"] for r in evaluation.weighted_percentiles(df.where("score IS NOT NULL"), ["k"], "score", "w", percents).collect()}
    for k in "ab":
        own = sorted((r[1], r[3]) for r in rows if r[0] == k and r[1] is not None and r[3] > 0)
        total, run, at = sum(w for _, w in own), 0.0, []
        for _, w in own:
            run += w
            at.append(100 / total * (run - w / 2))
        for q in percents:
            assert found[k, q] == pytest.approx(float(np.interp(q, at, [x for x, _ in own])), abs=1e-9)


@pytest.mark.parametrize("keys", [["k"], []])
def test_kendall(spark, keys):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, rng.randint(0, 9)]), rng.randint(0, 30)) for k, n in ((1, 160), (2, 2), (3, 40)) for _ in range(n)] + [(4, 1, 1)]
    found = {tuple(r[k] for k in keys): r["tau"] for r in evaluation.kendall_tau(spark.createDataFrame(rows, "k int, x int, y int"), keys, "x", "y").collect()}
    for k in found:
        own = [r[1:] for r in rows if r[1] is not None and (not keys or r[0] == k[0])]
        good = tx = ty = 0
        for i, (x, y) in enumerate(own):
            for u, v in own[:i]:
                good += ((x > u) - (x < u)) * ((y > v) - (y < v))
                tx, ty = tx + (x != u), ty + (y != v)
        assert found[k] == (pytest.approx(good / math.sqrt(tx * ty)) if tx * ty else None)
    assert len(found) == (4 if keys else 1)


def plain_segments(x, limit, full):
    """Beats one by one: the segment of each, or None."""
    total = sum(x)
    out, start, k, count = [None] * len(x), 0, 0, math.ceil(total / limit)
    while total > limit and start < len(x) and k < count:
        end, clock = start, 0.0
        while end < len(x) and clock < limit:
            clock += x[end]
            end += 1
        if clock > limit:
            end = max(end - 1, start + 1)
        if full or k < count - 1:
            out[start:end] = [k] * (end - start)
        start, k = end, k + 1
    return out


@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("duration", [2.0, 5.5, 60.0])
def test_segments_over_partitions(spark, full, duration):
    rng = random.Random(3)
    series = {1: [float(rng.choice([0, 250, 500, 1000, 7000])) for _ in range(300)], 2: [1000.0] * 41, None: [float(rng.randint(300, 1200)) for _ in range(120)], 4: [500.0], 5: [9000.0] * 3}
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)] + [(1, 300, None)]
    rng.shuffle(rows)
    got = {(r["k"], r["beat"]): r["segment"] for r in hrv.segments(spark.createDataFrame(rows, "k int, beat int, nn double"), ["k"], duration, full).collect()}
    series[1] = [*series[1], 0.0]
    want = {(k, i): s for k, x in series.items() for i, s in enumerate(plain_segments(x, duration * 1000, full)) if s is not None}
    assert got == want


@pytest.mark.parametrize(("kind", "cutoff", "order"), [("low", 0.05, 2), ("high", 1.0, 4), ("low", 1.0, 6), ("notch", 2.0, 2), ("mean", 0.5, 1)])
def test_zero_phase_filters_in_blocks(spark, kind, cutoff, order):
    rng = np.random.default_rng(1)
    series = {1: rng.normal(size=700).cumsum(), 2: rng.normal(size=30), 3: np.array([2.0]), 4: np.array([1.0, 5.0]), None: rng.normal(size=150)}
    holes = {(1, 0), (1, 99), (1, 100), (None, 149)}
    rows = [(k, i, None if (k, i) in holes else float(v), "x") for k, x in series.items() for i, v in enumerate(x)] + [(9, i, None, "x") for i in range(3)]
    found = {(r["k"], r["idx"]): r["v_filtered"] for r in signals.filtered(spark.createDataFrame(rows, "k int, idx int, v double, z string"), ["k"], "v", 8.0, kind, cutoff, order, True, n=64).collect()}
    b, a = (np.full(4, 0.25), np.array([1.0])) if kind == "mean" else helpers.notch(cutoff, 8.0) if kind == "notch" else helpers.butterworth(order, cutoff, 8.0, kind)
    assert len(found) == len(rows) and found[9, 1] is None
    for k, x in series.items():
        good = np.array([(k, i) not in holes for i in range(len(x))])
        x = np.interp(np.arange(len(x)), np.flatnonzero(good), x[good])
        assert [found[k, i] for i in range(len(x))] == pytest.approx(list(helpers.filtfilt(b, a, x)), abs=1e-9 * max(1, np.abs(x).max()))


@pytest.mark.parametrize("n", [0, 5, 128, 1000])
def test_block_filters_are_those_by_sample(n):
    x, z = np.random.default_rng(n).normal(size=n), np.array([0.3, -1.0, 0.2, 0.5, 0.1, 0.7])
    b, a = helpers.butterworth(6, 1.0, 8.0)
    for got, want in zip(helpers.lfilter_blocks(b, a, x, z), helpers.lfilter_on(b, a, x, z), strict=True):
        assert got == pytest.approx(want, abs=1e-11)


@pytest.mark.parametrize(("taps", "level"), [("haar", 4), ("db4", 3), ("coif2", 2), ("db10", 3)])
def test_wavelets_in_chunks(spark, taps, level):
    rng = np.random.default_rng(4)
    series = {1: rng.normal(size=1501), 2: rng.normal(size=30), 3: rng.normal(size=5), None: rng.normal(size=1024), 5: np.array([1.0])}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [(9, 0, None)]
    got = {(r["k_"], r["level"], r["k"]): r["coef"] for r in signals.wavelet_details(spark.createDataFrame(rows, "k_ int, idx int, v double"), ["k_"], "v", taps, level, n=64).collect()}
    want = {(k, i + 1, j): c for k, x in series.items() for i, d in enumerate(helpers.wavelet_levels(x, helpers.wavelet_taps(taps), level)[0]) for j, c in enumerate(d)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-10) for k, v in want.items())


@pytest.mark.parametrize("n", range(1, 6))
def test_coiflets_are_orthonormal_with_their_moments(n):
    h = helpers.coiflet(n)
    assert len(h) == 6 * n
    for m in range(3 * n):
        assert h[: 6 * n - 2 * m] @ h[2 * m :] == pytest.approx(float(m == 0), abs=1e-12)
    place, sign = np.arange(6 * n) - 2 * n + 0.0, (-1.0) ** np.arange(6 * n)
    for p in range(2 * n):
        scale = (np.abs(h) * np.abs(place) ** p).sum()
        assert (h * sign * place**p).sum() == pytest.approx(0, abs=1e-13 * scale)
        if p:
            assert (h * place**p).sum() == pytest.approx(0, abs=1e-13 * scale)
    if n == 1:  # in closed form
        assert h == pytest.approx((np.array([1 - math.sqrt(7), 5 + math.sqrt(7), 14 + 2 * math.sqrt(7), 14 - 2 * math.sqrt(7), 1 - math.sqrt(7), -3 + math.sqrt(7)])) / (16 * math.sqrt(2)))


@pytest.mark.parametrize("most", [3, 4_096])
@pytest.mark.parametrize("dim", [1, 2, 3])
def test_close_pairs_of_ties_and_hot_cells(spark, dim, most):
    rng = random.Random(dim)
    rows = [(k, *(rng.choice([0.1 * rng.randint(0, 30), 1.0, 1.05]) for _ in range(dim)), r) for k, n, r in ((1, 120, 0.1), (None, 60, 0.3), (3, 1, 0.2), (4, 9, 0.0)) for _ in range(n)]
    names = [f"c{i}" for i in range(dim)]
    found = {r["k"]: r["pairs"] for r in signals.close_pairs(spark.createDataFrame(rows, ", ".join(["k int", *(f"{c} double" for c in names), "r double"])), ["k"], names, "r", most).collect()}
    for k in (1, None, 3):
        own = [r[1:] for r in rows if r[0] == k]
        assert found[k] == sum(all(abs(u - v) < a[-1] for u, v in zip(a[:-1], b[:-1], strict=True)) for i, a in enumerate(own) for b in own[:i])
    assert 4 not in found


@pytest.mark.parametrize("tolerance", [None, 0.2])
def test_entropy_and_fluctuations_over_partitions(spark, tolerance):
    rng = np.random.default_rng(8)
    series = {1: rng.normal(size=400).cumsum() / 5, 2: rng.normal(size=70), None: np.sin(np.arange(90)), 4: np.ones(30), 5: np.array([1.0, 2.0, 3.0]), 6: np.array([1.0])}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [(7, 0, None)]
    got = {r["k"]: r for r in signals.nonlinear_measures(spark.createDataFrame(rows, "k int, beat int, nn double"), ["k"], tolerance=tolerance).collect()}
    for k, x in series.items():
        want = helpers.sample_entropy(x, 2, tolerance), helpers.dfa(x, range(4, 17)), helpers.dfa(x, range(17, 65)) if len(x) >= 64 else None
        for name, value in zip(("sampen", "dfa_short", "dfa_long"), want, strict=True):
            assert got[k][name] is None if value is None else got[k][name] == pytest.approx(value, rel=1e-9)
    assert got[7]["sampen"] is None


def test_weighted_percentiles_sort_their_rows_once(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, None, 3]), float(rng.randint(0, 20)), float(rng.randint(0, 3))) for _ in range(400)] + [(4, 2.5, 1.0)]
    got = evaluation.weighted_percentiles(spark.createDataFrame(rows, "k int, x double, w double"), ["k"], "x", "w", [0, 5, 50, 99.99])
    found = {(r["k"], r["percent"]): r["value"] for r in got.collect()}
    for k in (1, None, 3, 4):
        own = sorted((x, w) for g, x, w in rows if g == k and w > 0)
        total, clock = sum(w for _, w in own), np.cumsum([w for _, w in own])
        p = [100 / total * (c - w / 2) for c, (_, w) in zip(clock, own, strict=True)]
        for q in (0, 5, 50, 99.99):
            assert found[k, q] == pytest.approx(float(np.interp(q, p, [x for x, _ in own])))
    assert len(found) == 16
    assert got._jdf.queryExecution().executedPlan().toString().count("Window [") <= 10  # five, in the first and the final plan: one pass of running values, not two
