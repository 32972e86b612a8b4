"""Forms for large groups against plain loops: chunks, parts and passes give what one group gives."""

import itertools
import math
import random

import numpy as np
import pytest
from pulsegrid.functions import signals as H
from pulsegrid.jobs import workloads as W
from pulsegrid.operators import capacity, epochs, evaluation, hrv, models, series, signals
from pyspark.sql import functions as F

K = ["rec"]


def brute_tau(x, y):
    s = nx = ny = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y, strict=True), 2):
        dx, dy = np.sign(a - c), np.sign(b - d)
        s, nx, ny = s + dx * dy, nx + dx * dx, ny + dy * dy
    return s / math.sqrt(nx * ny) if nx and ny else None


def test_kendall_tau_counts_pairs_without_listing_them(spark):
    rng = random.Random(4)
    groups = {"ties": [(rng.randint(0, 5), rng.randint(0, 9)) for _ in range(60)], "plain": [(rng.random(), rng.random()) for _ in range(77)], "one": [(1.0, 2.0)], "flat": [(1.0, float(i)) for i in range(5)], "same": [(float(i), float(i)) for i in range(9)]}
    rows = [(g, float(a), float(b)) for g, pairs in groups.items() for a, b in pairs] + [("ties", None, 1.0), ("plain", 0.5, None)]
    got = {r["rec"]: r["tau"] for r in evaluation.kendall_tau(spark.createDataFrame(rows, "rec string, x double, y double"), K, "x", "y").collect()}
    for g, pairs in groups.items():
        want = brute_tau(*zip(*pairs, strict=True))
        assert got[g] is None if want is None else got[g] == pytest.approx(want)


def test_many_lags_are_those_of_few(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, None if i == 7 else float(v)) for g, n in (("a", 700), ("b", 90), ("c", 3)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "rec string, idx long, v double")
    for norm in ("biased", "unbiased", "coeff", "raw"):
        few = {(r["rec"], r["lag"]): r["r"] for r in series.autocorrelation(df, K, "v", 40, norm).collect()}
        many = {(r["rec"], r["lag"]): r["r"] for r in series._many_lags(df, K, "v", 40, norm, "idx", None, n=100).collect()}
        assert few.keys() == many.keys()
        for k, v in few.items():
            assert many[k] == pytest.approx(v, abs=1e-9) or (v is None and many[k] is None)
    assert series.autocorrelation(df, K, "v", 60).where("rec = 'a'").count() == 61


def test_places_over_range_partitions(spark):
    rng = random.Random(1)
    rows = [("big" if i % 5 else "small", rng.randint(0, 50), i) for i in range(500)]
    got = evaluation.ranked(spark.createDataFrame(rows, "g string, a int, b int"), ["g"], ["a", "b"]).collect()
    for g in ("big", "small"):
        own = sorted((a, b) for x, a, b in rows if x == g)
        assert {(r["a"], r["b"]): r["__at"] for r in got if r["g"] == g} == {v: i + 1 for i, v in enumerate(own)}
        assert {r["__n"] for r in got if r["g"] == g} == {len(own)}
    first = evaluation.first_share(spark.createDataFrame(rows, "g string, a int, b int"), "b").collect()
    assert sorted(r["b"] for r in first) == list(range(165))


def test_support_vectors_in_parts(spark):
    rng = np.random.default_rng(3)
    model = spark.createDataFrame([(i, float(rng.normal()), rng.normal(size=3).tolist()) for i in range(25)], "sv_id int, coef double, sv array<double>")
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "k int, x array<double>")
    one = {r["k"]: (r["decision"], r["label"]) for r in epochs.svm_scores(rows, model, ["k"], "x", 0.5, 0.1).collect()}
    parts = {r["k"]: (r["decision"], r["label"]) for r in epochs.svm_scores(rows, model, ["k"], "x", 0.5, 0.1, most=4).collect()}
    assert all(parts[k][0] == pytest.approx(v[0]) and parts[k][1] == v[1] for k, v in one.items()) and len(one) == len(parts) == 40
    twice = epochs.svm_scores(rows.where("k = 7").unionByName(rows.where("k = 7")), model, ["k"], "x", 0.5, 0.1, most=4).collect()
    assert [r["decision"] for r in twice] == pytest.approx([one[7][0]] * 2)


def test_triangle_by_running_sums(spark):
    rng = random.Random(6)
    d = [rng.randint(0, 20) for _ in range(15)] + [40] + [rng.randint(0, 20) for _ in range(12)]
    got = hrv.tinn(spark.createDataFrame([("a", i, n) for i, n in enumerate(d) if n], "rec string, bin int, n long"), K, 2.0).first()
    d, top = [*d, 0], 15
    left = min(range(top), key=lambda a: sum((max(d[top] * (i - a) / (top - a), 0) - d[i]) ** 2 for i in range(top)))
    right = min(range(top + 1, len(d)), key=lambda b: sum((max(d[top] * (b - i) / (b - top), 0) - d[i]) ** 2 for i in range(top + 1, len(d))))
    assert (got["tinn_n"], got["tinn_m"], got["tinn"]) == (2.0 * left, 2.0 * right, 2.0 * (right - left))


def plain_peaks(x, height, distance):
    """Candidates by height; each takes its place unless a taken one is nearer than ``distance``."""
    tops = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] >= x[i + 1] and x[i] >= height]
    taken = []
    for i in sorted(tops, key=lambda i: (-x[i], i)):
        if all(abs(i - j) >= distance for j in taken):
            taken.append(i)
    return sorted(taken)


@pytest.mark.parametrize("distance", [1, 2, 5, 17])
def test_peaks_of_runs_are_those_of_the_whole(spark, distance):
    rng = np.random.default_rng(distance)
    x = rng.integers(0, 9, 400).astype(float)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "rec string, idx long, v double")
    got = signals.peaks(df, K, "v", 3.0, distance).orderBy("n").collect()
    assert [r["at"] for r in got] == plain_peaks(x, 3.0, distance) == H.find_peaks(x, 3.0, distance).tolist()
    assert [r["n"] for r in got] == list(range(len(got)))


def plain_responses(x, run, back, ahead, least, fs):
    d = [b - a for a, b in zip(x, x[1:], strict=False)]
    found = []
    for i in range(run, len(d) - run):
        if d[i] > 0 and d[i + 1] <= 0 and all(d[i - j] > 0 and d[i + j] < 0 for j in range(1, run)):
            steepest, start = max(d[max(0, i - fs) : i]), max(i - back, 0)
            for k in range(i, max(i - back, -1), -1):
                if d[k] < 0.01 * steepest:
                    start = k
                    break
            found.append((i, start))
    starts, out = {s for _, s in found}, []
    for i, s in found:
        if x[i] - x[s] < least:
            continue
        half, end, width = x[s] + (x[i] - x[s]) / 2, None, 0.0
        for k in range(i, min(i + ahead, len(x) - 1)):
            if x[k] < half:
                rise = i
                while x[rise] >= half:
                    rise -= 1
                end, width = k, (k - rise) / fs
                break
            if k in starts:
                end = k
                break
        if end is None:
            part = x[i : i + ahead]
            end = i + part.index(min(part))
        out.append((i, s, end, round(width, 6)))
    return out


@pytest.mark.parametrize("offset", [0.25, 0.5])
def test_skin_responses_in_chunks(spark, offset):
    rng = np.random.default_rng(8)
    x = (np.cumsum(rng.normal(size=900)) + 5 * np.sin(np.arange(900) / 9)).tolist()
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "rec string, tick long, v double")
    got = [(r["apex"], r["start"], r["end"], round(r["width"], 6)) for r in signals.skin_responses(df, K, "v", n=200, offset=offset).orderBy("apex").collect()]
    assert got == plain_responses(x, int(offset * 8), 32, 32, 0.02, 8) and len(got) >= 5


def test_a_missing_and_a_double_beat_at_a_splice(spark):
    """Chunks of 1000 with beats 600 apart; the middle one is spliced in and leaves a long and a short gap."""
    x = np.zeros(3000)
    x[[100, 700, 1800, 2050, 2650]] = 1.0
    rows = [("a", i, i // 1000, i // 1000 == 1, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "rec string, idx long, chunk long, spliced boolean, v double")
    out = np.array([r["v"] for r in signals.repaired_joins(df, K, "v", [0.5] * 100).orderBy("idx").collect()])
    want = x.copy()  # 1100 from 700 to 1800 is not long; 250 from 1800 to 2050 is short
    want[2000:2100] = 0
    assert (out == want).all()
    x[700], x[300] = 0.0, 1.0  # now 1500 before the splice
    df = spark.createDataFrame([(*r[:4], float(v)) for r, v in zip(rows, x, strict=True)], df.schema)
    out = np.array([r["v"] for r in signals.repaired_joins(df, K, "v", [0.5] * 100).orderBy("idx").collect()])
    assert (out[800:900] == 0.5).all() and out[300] == 1.0 and out[2050] == 0


def test_abnormal_chunks_are_replaced_and_scored(spark):
    rng = np.random.default_rng(1)
    x = np.tile(np.concatenate([[0, 0, 5.0], np.zeros(17)]), 60) + 0.01 * rng.normal(size=1200)
    x[500:600] += 80 * rng.normal(size=100)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "rec string, idx long, ecg double")
    out = W.clean_heart_signal(df, K, [5.0], chunk=100, height=2.0, distance=10, long=30, short=10, usual=20, ahead=2, back=4, around=2).orderBy("idx").collect()
    assert len(out) == 1200 and max(abs(r["ecg"]) for r in out) < 10
    assert {r["score"] for r in out[500:600]} == {min(r["score"] for r in out)}


def test_densification_follows_the_loop(spark):
    def loop(tech, demand, bands, r2, r3):
        """The steps one by one, as the table says."""
        out, new, left = "", False, demand
        while tech == "4G" and left >= 5 and not new:
            narrow = "LTE21005M" in bands
            l18, l21, l9 = "LTE1800" in bands, "LTE2100" in bands, "LTE900" in bands
            if l18 and not l9 and (l21 or narrow):
                can = r3 or r2
            elif l18 and l21 and l9:
                can = r3
            else:
                return "NO_ACTION", left, False
            out, new, left = (out + "5M_LTE2100", False, left - 5) if can else (out + "_2600TDD/newsite", True, left)
        return out, left, new

    lists = ["LTE18005M_LTE210010M", "LTE18005M_LTE9005M_LTE21005M", "LTE18005M", "LTE9005M", "LTE18005M_LTE9005M", "UMTS_F1_UMTS_F2"]
    rows = [(i, "4G", dem, b, r2, r3) for i, (dem, b, r2, r3) in enumerate(itertools.product((0.0, 4.9, 5.0, 17.0, 400.0), lists, (0, 1), (0, 1)))]
    df = spark.createDataFrame(rows, "k int, tech string, demand double, bands string, refarming_2g int, refarming_3g int").withColumns({"band_bw": F.col("bands"), "bw_bands": F.col("bands")})
    got = {r["k"]: (r["upgrade"], r["left"], r["new_site"]) for r in capacity.densify(df).collect()}
    for k, tech, dem, b, r2, r3 in rows:
        assert got[k] == loop(tech, dem, b, bool(r2), bool(r3))


@pytest.mark.parametrize("kind,cutoff", [("low", 1.0), ("high", 0.5), ("notch", 2.0), ("mean", 1.0)])
def test_filters_carry_their_state_over_chunks(spark, kind, cutoff):
    rng = np.random.default_rng(5)
    rows = [(g, i, float(v), g) for g, n in (("a", 1000), ("b", 130), ("c", 1)) for i, v in enumerate(np.cumsum(rng.normal(size=n)))]
    df = spark.createDataFrame(rows, "rec string, idx long, v double, other string")
    whole = {(r["rec"], r["idx"]): r["v_filtered"] for r in signals.filtered(df, K, "v", 8.0, kind, cutoff).collect()}
    parts = {(r["rec"], r["idx"]): r["v_filtered"] for r in signals.filtered(df, K, "v", 8.0, kind, cutoff, n=64).collect()}
    assert whole.keys() == parts.keys() and len(whole) == len(rows)
    assert all(parts[k] == pytest.approx(v, abs=1e-6) for k, v in whole.items())
    if kind == "mean":
        x = [r[2] for r in rows if r[0] == "a"]
        assert all(whole["a", i] == pytest.approx(sum(x[max(i - 7, 0) : i + 1]) / 8) for i in range(1000))


def test_the_feature_matrix_has_all_blocks_in_ratio_to_rest(spark):
    """Three intervals of a recording at 8 Hz: skin responses, breaths of two seconds, beats of one second."""
    n = 960
    t = np.arange(n)
    eda = 5 + np.maximum(0, 1 - np.abs((t % 160) - 20) / 20) * np.where((t % 160) < 20, 1, 1)
    rsp, ecg = 100 * np.sin(2 * np.pi * t / 16), np.where(t % 8 == 3, 1.0, 0.0)
    rows = [("a", i, i / 8, "rest" if i < 320 else "drive", float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(eda, rsp, ecg, strict=True))]
    df = spark.createDataFrame(rows, "rec string, idx long, time double, trigger string, eda double, rsp double, ecg double")
    ivl = spark.createDataFrame([("a", 0, 40.0, 79.875), ("a", 1, 80.0, 119.875)], "rec string, slalom int, start double, end double")
    got = {(r["slalom"], r["feature"]): r["value"] for r in W.feature_matrix(df, ivl, K, "rest", "eda", "rsp", "ecg", beat_gap=4, levels=2).collect()}
    names = {f for _, f in got}
    assert {"eda_mean", "rsp_std", "ecg_zero_crossings", "eda_wavelet_l2_std", "scr_n_events", "scr_amplitude_mean", "rsp_peaks", "rsp_out_breath_mean", "hrv_nn_mean", "hrv_sampen", "hrv_sd1"} <= names
    # Each interval repeats the rest phase, so what is there comes out as one.
    for feature in ("eda_mean", "rsp_std", "scr_n_events", "scr_amplitude_mean", "rsp_peaks", "rsp_out_breath_mean", "hrv_nn_mean", "hrv_hr_max", "eda_wavelet_l1_max"):
        assert got[0, feature] == pytest.approx(1, abs=1e-6) and got[1, feature] == pytest.approx(1, abs=1e-6), feature


def test_a_skin_signal_is_cleaned_in_one_job(spark):
    n = 1600
    rng = np.random.default_rng(2)
    x = 4 + np.cumsum(rng.normal(size=n)) * 0.01
    x[800:816] += 60  # an artefact
    phase = ["still" if i < 300 else "moving" if i < 600 else "_" if i % 2 else "drive" for i in range(n)]
    df = spark.createDataFrame([("a", i, i / 8, p, float(v)) for i, (p, v) in enumerate(zip(phase, x, strict=True))], "rec string, idx long, time double, trigger string, eda double")
    labels = spark.createDataFrame([("a", e, 5.0 * e, 5.0 * e + 4.875, -1 if 19 <= e <= 21 else 1) for e in range(40)], "rec string, epoch int, first double, last double, label int")
    out = W.clean_skin_signal(df, K, labels, {"still": "still", "moving": "moving"}, ["drive"], rate=8, floor=1e9).orderBy("tick").collect()
    assert [r["tick"] for r in out] == list(range(n))
    assert all(r["corrected_still"] is not None and r["corrected_moving"] is not None for r in out)
    assert max(r["tonic"] for r in out) < 10 < max(x)
