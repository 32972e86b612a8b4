"""Percentiles and what rests on them: large groups give what small ones give."""

import math
import random

import duckdb
import numpy as np
import pytest
from pulsegrid.operators import features, hrv, selection, series
from pyspark.sql import functions as F

POINTS = (0.0, 0.05, 0.25, 0.5, 0.777, 0.95, 1.0)


def test_percentiles_of_large_groups_are_those_of_sorted_values(spark):
    rng = random.Random(3)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(3_001)], "wide": [math.copysign(10 ** rng.uniform(-300, 300), rng.random() - 0.4) for _ in range(2_000)],
        "atom": [0.0] * 900 + [rng.random() for _ in range(500)] + [1.0] * 700, "flat": [7.5] * 400, "two": [1.0, 2.0] * 300, "one": [3.0], "pair": [1.0, 4.0], None: [float(i) for i in range(100)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("normal", None), ("one", float("nan")), ("one", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "rec string, x double").repartition(7)
    for large in (64, 1_000_000):
        got = {r["rec"]: r["points"] for r in selection.percentiles(df, ["rec"], F.col("x"), POINTS, large).collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            if g != "wide":
                assert got[g] == pytest.approx(np.quantile(values, POINTS).tolist(), rel=1e-12, abs=1e-12)
            else:
                ordered, at = sorted(values), [(len(values) - 1) * p for p in POINTS]
                for v, place in zip(got[g], at, strict=True):
                    assert ordered[math.floor(place)] * (1 - 1e-9) <= v <= ordered[math.ceil(place)] * (1 + 1e-9) or v == pytest.approx(ordered[math.floor(place)])
    assert selection.percentiles(df.limit(0), ["rec"], F.col("x"), POINTS, 10).count() == 0


def _same_rows(a, b, keys):
    left, right = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (a, b))
    assert set(left) == set(right) and left
    for k, row in left.items():
        for name, v in row.items():
            assert right[k][name] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (k, name)


def test_operators_give_the_same_above_and_below_the_size(spark):
    rng = random.Random(5)
    sizes = {"a": 800, "b": 300, "c": 40, "d": 1}
    rows = [(g, i, None if i == 17 else rng.choice([rng.gauss(0, 5), -1.0, 2.0, 90.0 if i % 37 == 0 else 0.5])) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "rec string, idx long, value double").repartition(5)
    for large in (200,):
        _same_rows(features.signal_statistics(df, ["rec"], "value"), features.signal_statistics(df, ["rec"], "value", large=large), ["rec"])
        for method in ("median", "mean"):
            plain = series.repair_outliers(df, ["rec"], "idx", method=method, beta=1.5, large=None)
            assert plain.where("repaired").count() > 5
            _same_rows(plain, series.repair_outliers(df, ["rec"], "idx", method=method, beta=1.5, large=large), ["rec", "idx"])
    beats = df.where("value IS NOT NULL").select("rec", F.col("idx").alias("beat"), (800 + F.round(10 * F.col("value"))).cast("int").alias("nn"))
    _same_rows(hrv.summary(beats, ["rec"]), hrv.summary(beats, ["rec"], large=100), ["rec"])


def test_large_groups_are_split_off(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [(None, i) for i in range(25)] + [("c", 1)], "rec string, i int")
    few, many = selection.split_by_size(df, ["rec"], 20)
    assert few.count() == 1 and many.count() == 55
    assert selection.split_by_size(df, ["rec"], 30)[1] is None and selection.split_by_size(df, ["rec"], None)[1] is None


def test_percentiles_that_cancel_are_those_of_sql(spark):
    # -a and 19 a of two values, or 9 a of three, of which a percentile is zero but for rounding: the base of a ratio
    rng = random.Random(5)
    groups = [[-1.0 * a, 19.0 * a] for a in range(1, 100)] + [[-1.0 * a, 9.0 * a, 40.0 * a] for a in range(1, 100)]
    groups += [[rng.randint(-60, 60) * 1.0 for _ in range(rng.randint(1, 9))] for _ in range(300)]
    rows = [(i, v) for i, g in enumerate(groups) for v in g]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r["g"]: [r[f"v_{n}"] for n in ("n5", "n25", "n50", "n75", "n95")] for r in features.event_statistics(df, ["g"], ["v"], "v").collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE t (g BIGINT, v DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {r[0]: list(r[1:]) for r in db.execute("SELECT g, " + ", ".join(f"quantile_cont(v, {p})" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM t GROUP BY 1").fetchall()}
    assert got.keys() == want.keys()
    tiny = 0
    for g, points in want.items():
        for a, b in zip(points, got[g], strict=True):
            if abs(a) < 1e-9:
                assert a == b, (groups[g], a, b)
                tiny += a != 0
            else:
                assert math.isclose(a, b, rel_tol=1e-14), (groups[g], a, b)
    assert tiny > 0


def test_outliers_are_judged_and_repaired_in_one_shuffle(spark):
    rng = random.Random(11)
    rows = [(g, f, i, 100.0 if i == 4 else rng.random()) for g in ("a", "b", None) for f in ("x", "y") for i in range(20)]
    out = series.repair_outliers(spark.createDataFrame(rows, "rec string, feature string, slalom int, value double"), ["rec", "feature"], "slalom", large=None)
    got = {(r["rec"], r["feature"], r["slalom"]): r["value"] for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1, plan
    value = {r[:3]: r[3] for r in rows}
    for g in ("a", "b"):  # rows without a key have no group
        for f in ("x", "y"):
            assert got[g, f, 4] == pytest.approx((value[g, f, 3] + value[g, f, 5]) / 2)
            assert all(got[g, f, i] == value[g, f, i] for i in range(20) if i != 4)
    assert len(got) == 80


def test_heart_rates_of_simultaneous_beats_and_wide_gaps_at_any_size(spark):
    rng = random.Random(7)
    rows = [(g, i, 0.0 if i % every == every - 1 else 3e9 if i == 50 else float(rng.randint(600, 900))) for g, every in (("a", 5), ("b", 60), ("c", 100_000)) for i in range(120)]
    nn = spark.createDataFrame(rows, "rec string, beat long, nn double").repartition(5)
    few, many = hrv.summary(nn, ["rec"]), hrv.summary(nn, ["rec"], large=10)
    _same_rows(few.drop("hr_std"), many.drop("hr_std"), ["rec"])
    for out in (few, many):
        got = {r["rec"]: r for r in out.collect()}
        for g in "abc":
            x = np.array([v for k, _, v in rows if k == g])
            with np.errstate(all="ignore"):
                rate = 60000 / x
            assert got[g]["diff_max"] == int(np.abs(np.diff(x)).max()) > 2**31
            assert got[g]["hr_max"] == rate.max() and got[g]["hr_mean"] == pytest.approx(rate.mean()) and got[g]["hr_p50"] == pytest.approx(np.median(rate))
            assert math.isnan(got[g]["hr_std"]) if g != "c" else got[g]["hr_std"] == pytest.approx(rate.std(ddof=1))
        assert got["a"]["hr_p95"] == math.inf and got["b"]["hr_p95"] < math.inf
