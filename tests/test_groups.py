"""Many small groups share a batch; a group may be longer than one."""

import numpy as np
import pytest
from pulsegrid.functions import signals as H
from pulsegrid.operators import capacity as N
from pulsegrid.operators import hrv as V
from pulsegrid.operators import rolling as L
from pulsegrid.operators import signals as G
from pulsegrid.operators import spectra as P
from pyspark.sql import functions as F


def test_by_group_gives_whole_groups(spark):
    sizes = [1] * 300 + [25_000, 2, 1, 30_001]
    rows = [(None if g == 7 else g, f"k{g % 3}", i) for g, m in enumerate(sizes) for i in range(m)]
    df = spark.createDataFrame(rows, "g long, k string, i long").repartition(3)

    def run(table, starts):
        ends = [*starts[1:].tolist(), table.num_rows]
        sizes = np.repeat(np.diff([*starts.tolist(), table.num_rows]), np.diff([*starts.tolist(), table.num_rows]))
        assert all(table.column("i")[lo].as_py() == 0 for lo in starts.tolist()) and len(ends) == len(starts)
        return table.append_column("size", [sizes.astype("int64")])

    got = G.by_group(df, ["g", "k"], "i", run, "g long, k string, i long, size long")
    told = got.groupBy("g", "k").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi")).collect()
    assert len(told) == len(sizes) and all(r["n"] == r["lo"] == r["hi"] for r in told)


def test_groups_leave_no_batch_each(spark):
    """One batch a group, as grouped Arrow functions have it, took milliseconds a group."""
    df = spark.range(2_000).select(F.col("id").alias("g"), F.lit(0).alias("i"), F.rand(1).alias("v"))
    batches = spark.sparkContext.accumulator(0)

    def run(table, starts):
        batches.add(1)
        return table.select(["g"])

    assert G.by_group(df, ["g"], "i", run, "g long").count() == 2_000
    assert batches.value <= 8


@pytest.mark.parametrize("distance", [1, 3, 6])
def test_peaks_equal_the_helper(spark, distance):
    rng = np.random.default_rng(distance)
    series = [rng.integers(0, 9, n).astype(float) for n in (60, 3, 1, 200, 33)]
    df = spark.createDataFrame([(r, i, float(v)) for r, x in enumerate(series) for i, v in enumerate(x)], "rec long, idx long, v double")
    got = {(r["rec"], r["at"]) for r in G.peaks(df, ["rec"], "v", 2.0, distance).collect()}
    assert got == {(r, int(i)) for r, x in enumerate(series) if len(x) > 2 for i in H.find_peaks(x, 2.0, distance)}


def test_entropy_of_all_pairs_equals_the_loop():
    rng = np.random.default_rng(0)
    for n in (4, 5, 21, 60, 256, 257):
        for x in (rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.ones(n)):
            r = 0.2 * np.sqrt(((x - x.mean()) ** 2).sum() / (n + 1))
            counts = []
            for m in (2, 3):
                t = np.array([x[i : i + m] for i in range(n - 2)])[: n - 2] if m == 2 else np.array([x[i : i + m] for i in range(n - 2)])
                counts.append(sum(int(np.abs(t[i] - t[j]).max() < r) for i in range(len(t)) for j in range(i)))
            want = -np.log(counts[1] / counts[0]) if all(counts) else None
            got = H.sample_entropy(x)
            assert (got is None) == (want is None) and (got is None or abs(got - want) < 1e-12)


@pytest.mark.parametrize("method", ["welch", "lomb", "yule-walker"])
def test_bands_of_segments_equal_those_of_spectra(spark, method):
    rng = np.random.default_rng(1)
    rows = [(g, float(t), float(800 + 40 * rng.normal())) for g, m in enumerate((3, 6, 40, 80)) for t in np.cumsum(rng.uniform(0.6, 1.1, m))]
    df = spark.createDataFrame(rows, "g long, time double, nn double")
    got = P.segment_bands(df, ["g"], method=method, nfft=512).orderBy("g").collect()
    want = P.band_powers(P.power_spectra(df, ["g"], method=method, nfft=512), ["g"]).orderBy("g").collect()
    assert len(got) == 3 and [r["g"] for r in got] == [r["g"] for r in want]
    for a, b in zip(got, want, strict=True):
        for c, v in a.asDict().items():
            assert (v is None) == (b[c] is None) and (v is None or v == pytest.approx(b[c], rel=1e-9, abs=1e-12)), c


def test_filter_states_pass_from_chunk_to_chunk(spark):
    x = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([(r, i, float(v)) for r in range(3) for i, v in enumerate(x[: 500 - 170 * r])], "rec long, idx long, v double")
    got = G.filtered(df, ["rec"], "v", 8.0, "low", 1.0, n=64).orderBy("rec", "idx").collect()
    b, a = H.butterworth(6, 1.0, 8.0, "low")
    want = np.concatenate([H.lfilter(b, a, x[: 500 - 170 * r]) for r in range(3)])
    assert np.allclose([r["v_filtered"] for r in got], want)


def test_rolling_entropy_of_many_recordings(spark):
    rng = np.random.default_rng(3)
    series = [rng.uniform(700, 900, n) for n in (1, 2, 30, 90)]
    df = spark.createDataFrame([(r, i, float(v)) for r, x in enumerate(series) for i, v in enumerate(x)], "rec long, beat long, nn double")
    got = {(r["rec"], r["beat"]): r["sampen"] for r in L.rolling_measures(df, ["rec"], "nn", {"sampen": L.MEASURES["sampen"]}, n=10, chunk=16).collect()}
    for r, x in enumerate(series):
        for i in range(1, len(x)):
            w = x[max(i - 10, 0) : i if i + 10 >= len(x) else i + 11]
            want = H.sample_entropy(w) if len(w) else None
            assert got[r, i] == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("short", [0, 100, 2_048])
def test_short_series_need_no_ranges(spark, monkeypatch, short):
    """Measures of many short series come from sorted partitions; only longer ones are dealt to range partitions."""
    rng = np.random.default_rng(2)
    series = {1: rng.normal(size=150).cumsum(), 2: rng.normal(size=70), None: rng.integers(0, 3, 40).astype(float), 4: np.ones(30), 5: np.array([1.0])}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [(7, 0, None)]
    if short == 2_048:
        monkeypatch.setattr(G, "places", None)
    got = {r["k"]: r for r in G.nonlinear_measures(spark.createDataFrame(rows, "k int, beat int, nn double"), ["k"], short=short).collect()}
    assert got.keys() == {*series, 7}
    for k, x in series.items():
        want = H.sample_entropy(x), H.dfa(x, range(4, 17)), H.dfa(x, range(17, 65)) if len(x) >= 64 else None
        for name, value in zip(("sampen", "dfa_short", "dfa_long"), want, strict=True):
            assert got[k][name] is None if value is None else got[k][name] == pytest.approx(value, rel=1e-9)


@pytest.mark.parametrize("full", [True, False])
def test_segments_of_short_and_long_series_are_the_same(spark, monkeypatch, full):
    rng = np.random.default_rng(4)
    series = {1: rng.choice([0.0, 250.0, 500.0, 1000.0, 7000.0], 300), 2: np.full(41, 1000.0), None: rng.integers(300, 1200, 120).astype(float), 4: np.array([500.0]), 5: np.full(3, 9000.0)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [(1, 300, None), (1, 301, float("nan"))]
    df = spark.createDataFrame(rows, "k int, beat int, nn double").select("k", "beat", "nn")
    told = [{(r["k"], r["beat"]): r["segment"] for r in V.segments(df, ["k"], 5.5, full, short=short).collect()} for short in (0, 100, 2_048)]
    assert told[0] == told[1] == told[2] and told[0]
    monkeypatch.setattr(V, "ranged", None)  # no range partitions for short series
    V.segments(df, ["k"], 5.5, full)


def test_slopes_side_by_side(spark):
    """Several slopes in one aggregate, each of the rows that have both of its values."""
    rows = [(1, 1.0, 2.0, None), (1, 2.0, 4.0, 1.0), (1, None, 9.0, 9.0), (2, 1.0, None, 3.0), (3, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double")
    (y, n), (z, m) = N.slope_of("x", "y"), N.slope_of("x", "z")
    assert {r[0]: tuple(r[1:]) for r in df.groupBy("k").agg(y, n, z, m).collect()} == {1: (2.0, 2, 0.5, 1), 2: (None, 0, 3.0, 1), 3: (None, 1, None, 1)}
    assert {r["k"]: r["slope"] for r in N.slope_through_origin(df, ["k"], "x", "y").collect()} == {1: 2.0, 3: None}
