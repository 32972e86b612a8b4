"""Rolling measures and splines on chunks against loops over the whole series."""

import math

import numpy as np
import pytest

from pulsegrid.functions.signals import sample_entropy
from pulsegrid.functions.spectral import cubic_resample
from pulsegrid.operators import rolling

K = ["rec"]


def plain(x):
    steps = [(b - a) ** 2 for a, b in zip(x, x[1:], strict=False)]
    return math.sqrt(sum(steps) / len(steps)) if steps else None


def test_measures_of_one_window():
    t = np.arange(60.0)
    slow, fast = (800 + 50 * np.sin(2 * math.pi * f * t * 0.8) for f in (0.1, 0.3))
    assert rolling.lf_hf(slow) > 10 > 0.1 > rolling.lf_hf(fast)
    assert rolling.pnn50(np.array([800.0, 860, 861, 800])) == pytest.approx(200 / 3)
    assert [f(np.array([800.0])) for f in rolling.MEASURES.values()] == [None] * 4


def series(spark):
    rng = np.random.default_rng(3)
    nn = {"a": rng.normal(800, 60, 130).round(1), "b": rng.normal(700, 90, 17).round(1), "c": np.array([650.0])}
    rows = [(k, i, float(v), float(t)) for k, x in nn.items() for i, (v, t) in enumerate(zip(x, np.cumsum(x) / 1000, strict=True))]
    return nn, spark.createDataFrame(rows, "rec string, beat long, nn double, time double")


@pytest.mark.parametrize("chunk", [11, 4096])
def test_rolling_beats_equal_a_loop(spark, chunk):
    nn, df = series(spark)
    got = {(r["rec"], r["beat"]): (r["rmssd"], r["sampen"]) for r in rolling.rolling_measures(df, K, "nn", rolling.MEASURES, n=9, chunk=chunk).collect()}
    want = {}
    for k, x in nn.items():
        for i in range(1, len(x)):
            w = x[max(i - 9, 0) : i] if i + 9 >= len(x) else x[max(i - 9, 0) : i + 10]
            want[k, i] = (plain(w), sample_entropy(w))
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert got[k] == tuple(None if v is None else pytest.approx(v) for v in pair)


def test_rolling_seconds_equal_a_loop_and_nulls_are_left_out(spark):
    nn, df = series(spark)
    gaps = df.selectExpr("rec", "beat", "IF(beat % 5 = 2, NULL, nn) AS nn", "time")
    got = {(r["rec"], r["beat"]): r["rmssd"] for r in rolling.rolling_measures(gaps, K, "nn", {"rmssd": rolling.rmssd}, seconds=3.0, chunk=7.5).collect()}
    want = {}
    for k, x in nn.items():
        t, kept = np.round(np.cumsum(x) * 1000), np.arange(len(x)) % 5 != 2
        for i in range(1, len(x)):
            want[k, i] = plain(x[kept & (np.abs(t - t[i]) <= 3e6)])
    assert got == {k: None if v is None else pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("chunk", [80, 4096])
def test_resampling_by_chunk_equals_the_whole_spline(spark, chunk):
    rng = np.random.default_rng(4)
    t = {"a": 5 + np.cumsum(rng.uniform(0.2, 1.5, 500)), "b": np.array([1.0, 2.0, 4.0]), "c": np.array([7.0])}
    y = {k: rng.normal(size=len(v)) for k, v in t.items()}
    df = spark.createDataFrame([(k, float(a), float(b)) for k in t for a, b in zip(t[k], y[k], strict=True)] + [("a", None, 1.0), ("a", 9.0, None)], "rec string, time double, nn double")
    got = {}
    for r in rolling.resampled(df, K, "nn", 4.0, chunk=chunk).orderBy("time").collect():
        got.setdefault(r["rec"], []).append(r["value"])
    assert got.keys() == t.keys()
    for k in t:
        assert got[k] == pytest.approx(cubic_resample(t[k], y[k], 4.0).tolist(), abs=1e-9)


def test_empty_series(spark):
    empty = spark.createDataFrame([], "rec string, beat long, nn double, time double")
    assert rolling.rolling_measures(empty, K, "nn", {"rmssd": rolling.rmssd}, n=2).count() == 0
    assert rolling.resampled(empty, K, "nn", 4.0).count() == 0
