"""Edge cases of the operators: borders, ties, empty and one-row groups, chunk invariance, planted artefacts."""

import math
import random

import numpy as np
import pytest
from pulsegrid.functions import columns as C
from pulsegrid.operators import epochs, evaluation, features, hrv, models, recordings, series, signals, spectra
from pyspark.sql import functions as F

K = ["rec"]


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_trigger_fill(spark):
    rows = [("a", i, t) for i, t in enumerate("_A__B_")] + [("b", 0, "_"), ("b", 1, "_"), ("c", 0, None), ("c", 1, "_"), ("c", 2, "x")]
    got = recordings.fill_triggers(one(spark, rows, "rec string, idx long, trigger string"), K).orderBy("rec", "idx").collect()
    assert "".join(r["trigger"] for r in got if r["rec"] == "a") == "_AAAB_"
    assert [r["trigger"] for r in got if r["rec"] == "b"] == ["_", "_"]


def test_interval_ends_are_inside_and_overlaps_repeat(spark):
    samples = one(spark, [("a", i, float(i)) for i in range(10)], "rec string, idx long, time double")
    ivl = one(spark, [("a", 0, 2.0, 4.0), ("a", 1, 4.0, 6.0), ("b", 0, 0.0, 9.0), ("a", 2, 8.0, 7.0)], "rec string, slalom int, start double, end double")
    got = sorted((r["slalom"], r["idx"]) for r in recordings.split_by_intervals(samples, ivl, K, bucket_s=3.0).collect())
    assert got == [(0, 2), (0, 3), (0, 4), (1, 4), (1, 5), (1, 6)]


def test_outlier_repair(spark):
    x = [1.0] * 12
    x[5] = 100.0
    long = one(spark, [("f", i, v) for i, v in enumerate(x)] + [("one", 0, 7.0)], "feature string, slalom int, value double")
    got = {(r["feature"], r["slalom"]): (r["value"], r["old"], r["repaired"]) for r in series.repair_outliers(long, ["feature"], "slalom").collect()}
    assert got["f", 5] == (1.0, 100.0, True) and got["one", 0] == (7.0, 7.0, False)


def test_gaps(spark):
    rows = [("a", i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])]
    got = [r["value"] for r in series.fill_gaps(one(spark, rows, "rec string, idx long, value double"), K, "value").orderBy("idx").collect()]
    assert got == [None, 2, 4, 6, 8, 8]


def test_expressions(spark):
    r = spark.range(1).select(
        C.power_to_db(F.lit(0.1)).alias("a"), C.db_to_power(F.lit(-10.0)).alias("b"), C.magnitude_to_db(F.lit(0.1)).alias("c"), C.power_to_db(F.lit(0.0)).alias("d"), *(C.next_power_of_two(F.lit(n)).alias(f"n{n}") for n in (255, 256, 257)),
        C.one_sided(F.array(*(F.lit(float(v)) for v in (10, 2, 3, 3, 2, 8)))).alias("one"), C.two_sided(C.one_sided(F.array(*(F.lit(float(v)) for v in (10, 2, 3, 8, 3, 2))))).alias("two"),
        C.nearest_multiple(F.lit(12.5), 5).alias("even"), C.week_period(F.lit("2021-01-03").cast("date")).alias("week"), evaluation.binarise(F.lit(2.6)).alias("p"), evaluation.binarise(F.lit(2.61)).alias("q"), evaluation.binarise(F.lit(float("nan"))).alias("nan"),
    ).first()
    assert r["a"] == pytest.approx(-10) and r["b"] == pytest.approx(0.1) and r["c"] == pytest.approx(-20) and r["d"] is None
    assert (r["n255"], r["n256"], r["n257"]) == (8, 8, 9)
    assert r["one"] == [10, 4, 6, 8] and len(r["two"]) == 6 and r["two"][0] == 10
    assert r["even"] == 10 and r["week"] == 202100 and (r["p"], r["q"], r["nan"]) == (0, 1, 1)


@pytest.mark.parametrize("kind,want", [("rectangle", 1.0), ("bartlett", 1.3334), ("hann", 1.5001), ("hamming", 1.3629), ("blackman", 1.7268)])
def test_noise_bandwidths(spark, kind, want):
    n = 16_384
    w = spark.range(n).select(C.taper(kind, F.col("id"), F.lit(n)).alias("w"))
    assert w.agg((n * F.sum(F.col("w") * F.col("w")) / F.sum("w") ** 2).alias("b")).first()["b"] == pytest.approx(want, abs=2e-4)


def test_seconds_become_milliseconds_and_small_series(spark):
    nn = one(spark, [("a", 0, 0.8), ("a", 1, 0.9), ("b", 0, 700.0)], "rec string, beat long, nn double")
    got = {(r["rec"], r["beat"]): r["nn"] for r in hrv.scaled_nn(nn, K).collect()}
    assert got == {("a", 0): 800, ("a", 1): 900, ("b", 0): 700}
    s = {r["rec"]: r for r in hrv.summary(nn, K).collect()}
    assert s["b"]["rmssd"] is None and s["b"]["nn50"] == 0 and s["b"]["pnn50"] is None
    with pytest.raises(ValueError):
        hrv.exceeding(0)


def test_segments_drop_the_overshooting_beat(spark):
    nn = one(spark, [("a", i, 400.0) for i in range(10)] + [("b", 0, 100.0)], "rec string, beat long, nn double")
    got = {}
    for r in hrv.segments(nn, K, duration_s=1.0).collect():
        got.setdefault((r["rec"], r["segment"]), []).append(r["beat"])
    assert {k: sorted(v) for k, v in got.items()} == {("a", 0): [0, 1], ("a", 1): [2, 3], ("a", 2): [4, 5], ("a", 3): [6, 7]}


def test_epochs_share_their_ends(spark):
    df = spark.range(160).select(F.lit("a").alias("rec"), F.col("id").alias("tick"))
    got = {r["epoch"]: r["count"] for r in epochs.epochs(df, K).groupBy("epoch").count().collect()}
    assert got == {0: 41, 1: 41, 2: 41}


def test_large_median_does_not_depend_on_chunks(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(v)) for i, v in enumerate(rng.normal(size=500))]
    df = one(spark, rows, "rec string, idx long, value double")
    small = [r["value_median"] for r in signals.sliding_median_large(df, K, "value", 21, n=30).orderBy("idx").collect()]
    whole = [r["value_median"] for r in signals.sliding_median_large(df, K, "value", 21, n=10_000).orderBy("idx").collect()]
    plain = [r["value_median"] for r in recordings.sliding_median(df, K, "value", 21).orderBy("idx").collect()]
    assert small == whole and small == pytest.approx(plain)


def test_weighted_percentiles(spark):
    df = one(spark, [(float(v), 1.0) for v in (4, 1, 3, 2)] + [(9.0, 0.0)], "v double, w double").withColumn("g", F.lit(1))
    got = {r["percent"]: r["value"] for r in evaluation.weighted_percentiles(df, ["g"], "v", "w", [0, 50, 100]).collect()}
    assert got == {0: 1, 50: 2.5, 100: 4}


def test_perfect_and_tied_auc(spark):
    df = one(spark, [(1, 0.9, 1), (1, 0.8, 1), (1, 0.1, 0), (2, 0.5, 1), (2, 0.5, 0)], "rep int, score double, label int")
    got = {r["rep"]: r["auc"] for r in evaluation.auc(evaluation.roc_points(df, ["rep"]), ["rep"]).collect()}
    assert got == {1: 1.0, 2: 0.5}


def test_isolation_forest_marks_the_far_row_and_is_repeatable(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(300)] + [(999, 12.0, -11.0)]
    df = one(spark, rows, "id long, a double, b double")
    got = {r["id"]: r["score"] for r in models.isolation_scores(df, ["id"], ["a", "b"]).collect()}
    assert min(got, key=got.get) == 999
    again = {r["id"]: r["score"] for r in models.isolation_scores(df.repartition(5), ["id"], ["a", "b"]).collect()}
    assert got == pytest.approx(again)


def test_quantile_regression_is_near_the_optimal_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] + rng.normal(size=400)
    df = one(spark, [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    coef = {(r["tau"], r["feature"]): r["coef"] for r in models.quantile_regression_grid(df, ["a", "b", "c"], "y", [0.5, 0.9], [0.05]).collect()}
    assert coef[0.5, "a"] > 1 and coef[0.5, "b"] == 0 and coef[0.5, "c"] == 0
    assert coef[0.9, ""] > coef[0.5, ""] + 0.8


def test_spectrum_peak_and_bands(spark):
    t = np.arange(0, 250, 0.8)
    rows = [("a", float(u), 800 + 50 * math.sin(2 * math.pi * 0.1 * u)) for u in t] + [("b", 0.0, 800.0)]
    s = spectra.power_spectra(one(spark, rows, "rec string, time double, nn double"), K)
    bands = {r["rec"]: r for r in spectra.band_powers(s, K).collect()}
    assert set(bands) == {"a"} and bands["a"]["lf_peak"] == pytest.approx(0.1, abs=0.01) and bands["a"]["lf"] > 50 * bands["a"]["hf"]


def test_normalise_without_baseline(spark):
    long = one(spark, [("a", "f", 4.0), ("b", "f", 1.0), ("a", "g", 3.0)], "rec string, feature string, value double")
    base = one(spark, [("a", "f", 2.0), ("a", "g", 0.0)], "rec string, feature string, value double")
    got = {(r["rec"], r["feature"]): r["value"] for r in features.normalised(long, base, K).collect()}
    assert got == {("a", "f"): 2.0, ("b", "f"): None, ("a", "g"): None}
    assert [r["rec"] for r in features.without_baseline(long, base, K).collect()] == ["b"]


def test_empty_inputs(spark):
    empty = one(spark, [], "rec string, idx long, time double, value double, trigger string")
    assert recordings.fill_triggers(empty, K).count() == 0
    assert series.fill_gaps(empty, K, "value").count() == 0
    assert features.signal_statistics(empty, K, "value").count() == 0
    assert signals.peaks(empty, K, "value", 1.0, 2).count() == 0
    assert recordings.without_null_columns(empty, K).count() == 0


def test_artefacts_are_replaced_inside_the_partitions_of_their_recording(spark):
    rng = random.Random(9)
    rows = []
    for rec in ("a", "b", None):
        for i in range(120):
            at = None if i % 40 == 39 else rng.choice([i * 2.5, float(5 * i % 300), rng.uniform(0, 300)])
            rows.append((rec, i, at, None if i % 17 == 5 else round(rng.uniform(0, 50), 2), rng.choice(["go", "go", "rest", None]), i % 6 == 2))
    df = spark.createDataFrame(rows, "rec string, idx long, time double, value double, phase string, art boolean").repartition(3, "rec")
    out = series.replace_artefacts(df, ["rec"], "value", F.col("art"), F.col("phase") == "go", half_s=20.0)
    got = {(r["rec"], r["idx"]): r["value_clean"] for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") == 1, plan  # that of the repartitioning above
    for rec in ("a", "b", None):
        own = [r for r in rows if r[0] == rec]
        new = []
        for _, _, at, value, _, art in own:
            if art:
                p = None if at is None or rec is None else round(at / 5.0) * 5.0
                near = [] if p is None else [r[3] for r in own if not r[5] and r[4] == "go" and r[3] is not None and r[2] is not None and abs(r[2] - p) < 20.0]
                value = sum(near) / len(near) if near else None
            new.append(value)
        for i in range(len(own)):
            want = next((v for v in new[i:] if v is not None), next((v for v in reversed(new[:i]) if v is not None), None))
            assert got[rec, i] == pytest.approx(want, rel=1e-12), (rec, i)
