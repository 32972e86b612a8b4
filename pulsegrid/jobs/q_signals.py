"""Queries of signal processing, spectra and models; without SQL where SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import next_power_of_two
from ..functions import signals as helpers
from ..operators import features as X
from ..operators import hrv as H
from ..operators import models as M
from ..operators import recordings as R
from ..operators import signals as G
from ..operators import spectra as P
from ..operators.series import fill_missing_chunks
from .q_recordings import FILLED
from .tables import IVL, NN, REC, beats, intervals, recordings, registrar, rounded, statistics_sql, table
from . import q_hrv as hrv
from . import workloads as W

K = ["rec"]
#: The components of an embedding, as features.
ALL = [f"f{i}" for i in range(64)]
Q: dict = {}
query = registrar(Q)


@query("v1_repaired_defects", None)
def v1(spark, d):
    r = R.trigger_runs(recordings(spark, d), K)
    return G.repaired_runs(r.select("rec", "run", "idx", "value"), ["rec", "run"], "value", n_max=3, edge=1, reach=3, floor=1.0)


@query("v2_large_median", f"""WITH {REC}, p AS (SELECT rec, idx, value, list(value) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS l FROM rec)
SELECT rec, idx, round(list_sort(list_concat(l, list_transform(range(15 - len(l)), lambda x: 0.0)))[8], 4) AS value_median FROM p""")
def v2(spark, d):
    return rounded(G.sliding_median_large(recordings(spark, d).select("rec", "idx", "value"), K, "value", 15, n=20).select("rec", "idx", "value_median"))


@query("v3_wavelet_details", f"""WITH {REC}, n AS (SELECT rec, max(idx) + 1 AS n FROM rec GROUP BY 1), h AS (SELECT a.rec, 1 AS level, CAST(a.idx // 2 AS BIGINT) AS k, (a.value - coalesce(b.value, a.value)) / sqrt(2) AS coef FROM rec a LEFT JOIN rec b ON a.rec = b.rec AND b.idx = a.idx + 1 WHERE a.idx % 2 = 0)
SELECT rec, level, k, round(abs(coef), 4) AS coef FROM h""")
def v3(spark, d):
    return rounded(G.wavelet_details(recordings(spark, d), K, "value", "haar", 1).withColumn("coef", F.abs("coef")))


def wavelet_sql(taps: str, level: int) -> str:
    """x0 the samples; x1, x2, ... approximations and details of each level: rec, k, n, a, d."""
    low = [float(v) for v in helpers.wavelet_taps(taps)]
    pairs = ", ".join(f"({i}, {lo!r}, {(-1) ** i * hi!r})" for i, (lo, hi) in enumerate(zip(low, low[::-1], strict=True)))
    out = f"taps(i, lo, hi) AS (VALUES {pairs}), x0 AS (SELECT rec, idx AS k, count(*) OVER (PARTITION BY rec) AS n, value AS a FROM rec)"
    for j in range(1, level + 1):
        out += f""", g{j} AS (SELECT rec, n, unnest(range((n + {len(low) - 1}) // 2)) AS k FROM (SELECT DISTINCT rec, n FROM x{j - 1})),
    s{j} AS (SELECT rec, n, k, lo, hi, ((2 * k + {2 - len(low)} + i) % (2 * n) + 2 * n) % (2 * n) AS m FROM g{j}, taps),
    x{j} AS (SELECT s.rec, s.k, (s.n + {len(low) - 1}) // 2 AS n, sum(lo * a) AS a, sum(hi * a) AS d FROM s{j} s JOIN x{j - 1} p ON p.rec = s.rec AND p.k = CASE WHEN m < s.n THEN m ELSE 2 * s.n - 1 - m END GROUP BY ALL)"""
    return out + ", coefs AS (" + " UNION ALL ".join(f"SELECT rec, {j} AS level, k, d AS coef FROM x{j}" for j in range(1, level + 1)) + ")"


@query("v3_coiflet_details", f"WITH {REC}, {wavelet_sql('coif5', 3)} SELECT rec, level, k, round(coef, 4) AS coef FROM coefs")
def v3b(spark, d):
    return rounded(G.wavelet_details(recordings(spark, d), K, "value", "coif5", 3))


STATISTICS = "n5 n25 n50 n75 n95 median max mean min std rms mean_abs".split()
_per_level = ", ".join(f"l{j} AS (SELECT rec, {statistics_sql('coef')} FROM coefs WHERE level = {j} GROUP BY 1)" for j in (1, 2, 3))
_named = ", ".join(f"l{j}.{c} AS eda_wavelet_l{j}_{c}" for j in (1, 2, 3) for c in STATISTICS)


@query("a14_wavelet_statistics", f"WITH {REC}, {wavelet_sql('db4', 3)}, {_per_level} SELECT l1.rec, {_named} FROM l1 JOIN l2 USING (rec) JOIN l3 USING (rec)")
def a14(spark, d):
    return rounded(X.level_statistics(G.wavelet_details(recordings(spark, d), K, "value", "db4", 3), K, "eda", [1, 2, 3]))


def filter_sql(name: str, source: str, b, a, entered=None) -> str:
    """Recursive CTE: rec, p, y of a filter over source (rec, p from 0, x), one sample a step; entered: state for an input of ones."""
    b, a = [float(v) for v in b], [float(v) for v in a]
    z = [f"z{i}" for i in range(1, len(a))]
    start = [f"{float(v)!r} * s.x" for v in (entered if entered is not None else [0.0] * len(z))]

    def step(state):
        y = f"({b[0]!r} * s.x + {state[0]})"
        return [y, *(f"{b[i]!r} * s.x - ({a[i]!r}) * {y}" + (f" + {state[i]}" if i < len(z) else "") for i in range(1, len(a)))]

    first, then = (", ".join(f"({c})::DOUBLE AS {n}" for c, n in zip(step(state), ["y", *z], strict=True)) for state in (start, [f"f.{c}" for c in z]))
    return f"{name} AS (SELECT s.rec, s.p, {first} FROM {source} s WHERE s.p = 0 UNION ALL SELECT s.rec, s.p, {then} FROM {name} f JOIN {source} s ON s.rec = f.rec AND s.p = f.p + 1)"


LOW6, LOW2 = helpers.butterworth(6, 1.0, 8.0), helpers.butterworth(2, 0.05, 8.0)


@query("v4_filtered", f"WITH RECURSIVE {REC}, src AS (SELECT rec, idx AS p, value AS x FROM rec), {filter_sql('fil', 'src', *LOW6)} SELECT rec, idx, round(value, 4) AS value, round(y, 4) AS value_filtered FROM fil JOIN rec USING (rec) WHERE p = idx")
def v4(spark, d):
    return rounded(G.filtered(recordings(spark, d).select("rec", "idx", "value"), K, "value", 8.0, "low", 1.0, 6))


@query("v4_moving_average", f"WITH {REC} SELECT rec, idx, round(sum(value) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4, 4) AS value_filtered FROM rec")
def v4b(spark, d):
    return rounded(G.filtered(recordings(spark, d).select("rec", "idx", "value"), K, "value", 8.0, "mean", 0.5).select("rec", "idx", "value_filtered"))


@query("v5_steps", f"""WITH {REC}, h AS (SELECT j, CASE WHEN j = 7.5 THEN 1 ELSE sin(pi() * 0.5 * (j - 7.5)) / (pi() * 0.5 * (j - 7.5)) END * (0.54 - 0.46 * cos(2 * pi() * j / 15)) AS h FROM unnest(range(0, 16)) u(j)),
y AS (SELECT a.rec, a.idx, coalesce(sum(h * b.value), 0) / (SELECT sum(h) FROM h) AS y FROM rec a CROSS JOIN h LEFT JOIN rec b ON b.rec = a.rec AND b.idx = a.idx + 7 - j GROUP BY 1, 2),
d AS (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after, abs(lead(y) OVER w - y) AS d, count(*) OVER (PARTITION BY rec) AS n FROM y WINDOW w AS (PARTITION BY rec ORDER BY idx)),
m AS (SELECT *, max(d) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS most FROM d)
SELECT rec, idx AS tick FROM m WHERE y < before AND y < after AND idx > 4 AND idx < n - 5 AND most > 0.3""")
def v5(spark, d):
    return G.steps(recordings(spark, d), K, "value", "idx", taps=16, n=64)


def peaks_sql(name: str, value: str, height: float, distance: int) -> str:
    """Table {name} (rec, n, place, amplitude): local maxima of a recording, taken from the highest down if none taken is nearer than the distance."""
    return f"""{name}_p AS (SELECT rec, idx, {value} AS v, lag({value}) OVER w AS b, lead({value}) OVER w AS a FROM rec WINDOW w AS (PARTITION BY rec ORDER BY idx)),
{name}_c AS (SELECT rec, list([idx] ORDER BY v DESC, idx) AS l FROM {name}_p WHERE v > b AND v >= a AND v >= {height} GROUP BY 1),
{name}_t AS (SELECT rec, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < {distance})) = 0 THEN list_concat(acc, x) ELSE acc END)) AS place FROM {name}_c),
{name} AS (SELECT t.rec, CAST(row_number() OVER (PARTITION BY t.rec ORDER BY place) - 1 AS INTEGER) AS n, place, v AS amplitude FROM {name}_t t JOIN {name}_p p ON p.rec = t.rec AND p.idx = t.place)"""


@query("v7_peaks", f"WITH {REC}, {peaks_sql('k', 'value', 30, 3)} SELECT rec, n, place AS at, round(amplitude, 4) AS amplitude FROM k")
def v7(spark, d):
    return rounded(G.peaks(recordings(spark, d), K, "value", 30.0, 3))


@query("v7_local_maxima", f"WITH {REC}, p AS (SELECT rec, idx, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM rec WINDOW w AS (PARTITION BY rec ORDER BY idx)) SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS INTEGER) AS n, idx AS at, round(value, 4) AS amplitude FROM p WHERE value > b AND value >= a AND value >= 30")
def v7b(spark, d):
    return rounded(G.peaks(recordings(spark, d), K, "value", 30.0, 1))


@query("v8_skin_responses", None)
def v8(spark, d):
    return G.skin_responses(recordings(spark, d), K, "value", "idx", offset=0.25)


@query("a12_response_statistics", None)
def a12(spark, d):
    return X.event_statistics(G.skin_responses(recordings(spark, d), K, "value", "idx", offset=0.25), K, ["amplitude", "rise"], "apex")


@query("a13_breath_measures", f"""WITH {REC}, {peaks_sql('hi', 'value', 0, 3)}, {peaks_sql('lo', '-value', -1000, 3)}
SELECT h.rec, h.n, CAST(trunc(h.amplitude + lo.amplitude) AS INTEGER) AS out_breath, CAST(trunc(h.next + lo.amplitude) AS INTEGER) AS in_breath FROM (SELECT *, lead(amplitude) OVER (PARTITION BY rec ORDER BY n) AS next FROM hi) h JOIN lo ON lo.rec = h.rec AND lo.n = h.n""")
def a13(spark, d):
    r = recordings(spark, d)
    low = G.peaks(r.withColumn("value", -F.col("value")), K, "value", -1000.0, 3).withColumn("amplitude", -F.col("amplitude"))
    return X.breath_measures(G.peaks(r, K, "value", 0.0, 3), low, K)


@query("v9_tonic_phasic", f"""WITH RECURSIVE {REC}, n AS (SELECT rec, max(idx) + 1 AS n, arg_min(value, idx) AS head, arg_max(value, idx) AS tail, least(9, max(idx)) AS pad FROM rec GROUP BY 1),
wide AS (SELECT rec, idx + pad AS p, value AS x FROM rec JOIN n USING (rec) UNION ALL SELECT rec, pad - idx, 2 * head - value FROM rec JOIN n USING (rec) WHERE idx BETWEEN 1 AND pad
    UNION ALL SELECT rec, pad + 2 * (n - 1) - idx, 2 * tail - value FROM rec JOIN n USING (rec) WHERE idx BETWEEN n - 1 - pad AND n - 2),
{filter_sql("once", "wide", *LOW2, helpers.steady_state(*LOW2))}, turned AS (SELECT rec, n + 2 * pad - 1 - p AS p, y AS x FROM once JOIN n USING (rec)), {filter_sql("back", "turned", *LOW2, helpers.steady_state(*LOW2))},
out AS (SELECT rec, n + pad - 1 - p AS idx, y AS tonic FROM back JOIN n USING (rec))
SELECT rec, idx AS tick, round(value, 4) AS value, round(CASE WHEN n = 1 THEN value ELSE tonic END, 4) AS tonic, round(value - CASE WHEN n = 1 THEN value ELSE tonic END, 4) AS phasic FROM rec JOIN n USING (rec) LEFT JOIN out USING (rec, idx)""")
def v9(spark, d):
    return rounded(G.tonic_phasic(recordings(spark, d).select("rec", F.col("idx").alias("tick"), "value"), K, "value"))


def nn_seconds(spark, d):
    nn = H.nn_intervals(beats(recordings(spark, d)), K)
    return nn.withColumn("time", (F.row_number().over(Window.partitionBy("rec").orderBy("beat")) - 1) * 0.25).withColumn("nn", F.col("nn") / 1e4)


SAMPEN = """x AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY beat) AS i, nn / 1e4 AS a, lead(nn / 1e4) OVER w AS b, lead(nn / 1e4, 2) OVER w AS c FROM nn WINDOW w AS (PARTITION BY rec ORDER BY beat)),
tol AS (SELECT rec, 0.2 * sqrt(var_pop(a) * count(*) / (count(*) + 1)) AS tol FROM x GROUP BY 1), t AS (SELECT * FROM x WHERE c IS NOT NULL),
m AS (SELECT p.rec, count(*) FILTER (greatest(abs(p.a - q.a), abs(p.b - q.b)) < tol) AS two, count(*) FILTER (greatest(abs(p.a - q.a), abs(p.b - q.b), abs(p.c - q.c)) < tol) AS three FROM t p JOIN t q ON p.rec = q.rec AND p.i < q.i JOIN tol ON p.rec = tol.rec GROUP BY 1)"""
DFA = """y AS (SELECT rec, i - 1 AS i, sum(a - mean) OVER (PARTITION BY rec ORDER BY i) AS y, n FROM (SELECT *, avg(a) OVER (PARTITION BY rec) AS mean, count(*) OVER (PARTITION BY rec) AS n FROM x)),
g AS (SELECT rec, s, i // s AS seg, any_value(n) AS n, count(*) AS c, greatest(regr_syy(y, i) - pow(regr_sxy(y, i), 2) / regr_sxx(y, i), 0) AS e FROM y, unnest(range(4, 65)) u(s) WHERE i < n // s * s AND n >= 2 * s GROUP BY 1, 2, 3),
l AS (SELECT rec, s, any_value(n) AS n, ln(s) AS ls, ln(sqrt(sum(e) / sum(c))) AS lf FROM g GROUP BY 1, 2 HAVING sum(e) > 0),
v AS (SELECT rec, CASE WHEN count(*) FILTER (s <= 16) > 1 THEN regr_slope(lf, ls) FILTER (s <= 16) END AS dfa_short, CASE WHEN max(n) >= 64 AND count(*) FILTER (s > 16) > 1 THEN regr_slope(lf, ls) FILTER (s > 16) END AS dfa_long FROM l GROUP BY 1)"""


@query("v11_nonlinear", f"""WITH {REC}, {NN}, {SAMPEN}, {DFA} SELECT rec, round(CASE WHEN two > 0 AND three > 0 THEN -ln(three / two) END, 4) AS sampen, round(dfa_short, 4) AS dfa_short, round(dfa_long, 4) AS dfa_long FROM (SELECT DISTINCT rec FROM nn) LEFT JOIN m USING (rec) LEFT JOIN v USING (rec)""")
def v11(spark, d):
    return rounded(G.nonlinear_measures(nn_seconds(spark, d), K))


@query("v12_welch_bands", None)
def v12(spark, d):
    return P.segment_bands(nn_seconds(spark, d), K, nfft=256)


@query("v12_lomb_bands", f"""WITH {REC}, {NN}, s AS (SELECT rec, (row_number() OVER (PARTITION BY rec ORDER BY beat) - 1) * 0.25 AS t, nn / 1e4 - avg(nn / 1e4) OVER (PARTITION BY rec) AS x, count(*) OVER (PARTITION BY rec) AS n FROM nn),
w AS (SELECT k * 0.41 / 255 AS freq, 2 * pi() * k * 0.41 / 255 AS w FROM unnest(range(1, 256)) u(k)), tau AS (SELECT rec, freq, w, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / 2 AS tau FROM s, w WHERE n >= 4 GROUP BY 1, 2, 3),
p AS (SELECT s.rec, freq, 0.5 * (pow(sum(x * cos(w * t - tau)), 2) / sum(pow(cos(w * t - tau), 2)) + pow(sum(x * sin(w * t - tau)), 2) / sum(pow(sin(w * t - tau), 2))) AS power FROM s JOIN tau ON s.rec = tau.rec GROUP BY 1, 2),
b AS (SELECT rec, coalesce(sum(power) FILTER (freq <= 0.04), 0) AS vlf, coalesce(sum(power) FILTER (freq BETWEEN 0.04 AND 0.15), 0) AS lf, coalesce(sum(power) FILTER (freq BETWEEN 0.15 AND 0.4), 0) AS hf FROM p GROUP BY 1)
SELECT rec, round(100 * vlf / (vlf + lf + hf), 4) AS vlf_percent, round(100 * lf / (vlf + lf + hf), 4) AS lf_percent, round(100 * hf / (vlf + lf + hf), 4) AS hf_percent, round(lf / hf, 4) AS lf_hf, round(ln(vlf * 0.41 / 255), 4) AS vlf_log, round(ln(lf * 0.41 / 255), 4) AS lf_log, round(ln(hf * 0.41 / 255), 4) AS hf_log FROM b""")
def v12b(spark, d):
    bands = P.segment_bands(nn_seconds(spark, d), K, method="lomb")
    return rounded(bands.select("rec", "vlf_percent", "lf_percent", "hf_percent", "lf_hf", "vlf_log", "lf_log", "hf_log"))


@query("v12_yule_walker", None)
def v12c(spark, d):
    return P.power_spectra(nn_seconds(spark, d), K, method="yule-walker", order=8, nfft=64)


@query("v13_ar_order", None)
def v13(spark, d):
    return P.best_order(P.ar_order_table(recordings(spark, d), K, "value", most=10), K)


@query("v13_periodogram", f"""WITH {REC}, s AS (SELECT rec, idx, value - avg(value) OVER (PARTITION BY rec) AS x, count(*) OVER (PARTITION BY rec) AS n FROM rec)
SELECT rec, round(k / 32.0, 4) AS freq, round(CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END * (pow(sum(x * cos(2 * pi() * k * idx / 128)), 2) + pow(sum(x * sin(2 * pi() * k * idx / 128)), 2)) / (4 * max(n)), 4) AS power FROM s, unnest(range(0, 65)) u(k) GROUP BY 1, k""")
def v13c(spark, d):
    r = recordings(spark, d).withColumn("clock", F.col("idx") / 4)
    return rounded(P.power_spectra(r, K, "value", "clock", "periodogram", resample=False, nfft=128))


@query("v13_spectra", None)
def v13b(spark, d):
    s = nn_seconds(spark, d)
    parts = [P.power_spectra(s, K, method=m, nfft=128, resample=False).withColumn("method", F.lit(m)) for m in ("periodogram", "daniell", "correlogram", "burg")]
    return R.stack(*parts)


@query("v14_frames", f"""WITH {REC}, n AS (SELECT rec, max(idx) + 1 AS n FROM rec GROUP BY 1), f AS (SELECT rec, unnest(range(0, (n - 16) // 8 + 1)) AS frame FROM n)
SELECT f.rec, frame, count(*) AS n, round(avg(value), 4) AS mean FROM f JOIN rec r ON f.rec = r.rec AND idx BETWEEN frame * 8 AND frame * 8 + 15 GROUP BY 1, 2""")
def v14(spark, d):
    return rounded(P.frames(recordings(spark, d), K, 16, 8).groupBy("rec", "frame").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("v14_spectrogram", f"""WITH {REC}, n AS (SELECT rec, max(idx) + 1 AS n FROM rec GROUP BY 1), f AS (SELECT rec, unnest(range(0, (n - 16) // 8 + 1)) AS frame FROM n),
s AS (SELECT f.rec, frame, idx - frame * 8 AS i, value - avg(value) OVER (PARTITION BY f.rec, frame) AS x FROM f JOIN rec r ON f.rec = r.rec AND idx BETWEEN frame * 8 AND frame * 8 + 15)
SELECT rec, frame, k / 4.0 AS freq, round(CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END * (pow(sum(x * cos(2 * pi() * k * i / 16)), 2) + pow(sum(x * sin(2 * pi() * k * i / 16)), 2)) / 64, 4) AS power FROM s, unnest(range(0, 9)) u(k) GROUP BY 1, 2, k""")
def v14b(spark, d):
    f = P.frames(recordings(spark, d).withColumn("clock", F.col("idx") / 4), K, 16, 8)
    return rounded(P.power_spectra(f, ["rec", "frame"], "value", "clock", "periodogram", resample=False, nfft=16))


@query("a11_band_powers", f"""WITH {REC}, s AS (SELECT rec, idx / 100.0 AS freq, value AS power FROM rec), b AS (SELECT rec, 0.01 * sum(power) FILTER (freq <= 0.04) AS vlf, 0.01 * sum(power) FILTER (freq BETWEEN 0.04 AND 0.15) AS lf, 0.01 * sum(power) FILTER (freq BETWEEN 0.15 AND 0.4) AS hf FROM s GROUP BY 1)
SELECT rec, round(vlf, 4) AS vlf, round(lf, 4) AS lf, round(hf, 4) AS hf, round(vlf + lf + hf, 4) AS total, round(lf / hf, 4) AS lf_hf, round(lf * 100 / (lf + hf), 4) AS lf_norm, round(ln(hf), 4) AS hf_log, round(vlf * 100 / (vlf + lf + hf), 4) AS vlf_percent FROM b""")
def a11(spark, d):
    s = recordings(spark, d).select("rec", (F.col("idx") / 100.0).alias("freq"), F.col("value").alias("power"))
    return rounded(P.band_powers(s, K).select("rec", "vlf", "lf", "hf", "total", "lf_hf", "lf_norm", "hf_log", "vlf_percent"))


@query("v15_isolation_scores", None)
def v15(spark, d):
    wide = recordings(spark, d).groupBy("rec", "phase").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))
    return M.isolation_scores(wide, ["rec", "phase"], ["mean", "max", "std"], trees=50)


@query("v16_spliced_chunks", f"""WITH {REC}, c AS (SELECT rec, idx // 5 AS chunk, max(value) > 60 AS abnormal FROM rec GROUP BY 1, 2),
n AS (SELECT *, last_value(CASE WHEN NOT abnormal THEN chunk END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
  first_value(CASE WHEN NOT abnormal THEN chunk END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM c),
o AS (SELECT rec, chunk, CASE WHEN NOT abnormal THEN NULL WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN hi - chunk < chunk - lo THEN hi ELSE lo END AS donor FROM n)
SELECT r.rec, r.idx, coalesce(x.value, r.value) AS value FROM rec r JOIN o ON r.rec = o.rec AND r.idx // 5 = o.chunk LEFT JOIN rec x ON x.rec = r.rec AND x.idx = o.donor * 5 + r.idx % 5""")
def v16(spark, d):
    r = R.chunks(recordings(spark, d), 5)
    marks = R.nearest_clean(r.groupBy("rec", "chunk").agg((F.max("value") > 60).alias("abnormal")), K)
    return G.spliced_chunks(r.join(marks, ["rec", "chunk"]), K, "value").select("rec", "idx", "value")


@query("v16_repaired_joins", f"""WITH {REC}, c AS (SELECT rec, idx // 5 AS chunk, max(value) > 60 AS abnormal FROM rec GROUP BY 1, 2),
n AS (SELECT *, last_value(CASE WHEN NOT abnormal THEN chunk END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
  first_value(CASE WHEN NOT abnormal THEN chunk END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM c),
o AS (SELECT rec, chunk, CASE WHEN NOT abnormal THEN NULL WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN hi - chunk < chunk - lo THEN hi ELSE lo END AS donor FROM n),
s AS (SELECT r.rec, r.idx, o.chunk, donor IS NOT NULL AS spliced, coalesce(x.value, r.value) AS value FROM rec r JOIN o ON r.rec = o.rec AND r.idx // 5 = o.chunk LEFT JOIN rec x ON x.rec = r.rec AND x.idx = o.donor * 5 + r.idx % 5),
p AS (SELECT *, lag(value) OVER u AS b, lead(value) OVER u AS a FROM s WINDOW u AS (PARTITION BY rec, chunk ORDER BY idx)),
k AS (SELECT rec, chunk, min(idx) AS first, count(*) AS size, bool_or(spliced) AS spliced, min(idx) FILTER (value > b AND value >= a AND value >= 20) AS head, max(idx) FILTER (value > b AND value >= a AND value >= 20) AS tail FROM p GROUP BY 1, 2),
g AS (SELECT *, coalesce(head - lag(tail) OVER w, 4 ) AS gap, coalesce(lag(spliced) OVER w, false) AS after FROM k WINDOW w AS (PARTITION BY rec ORDER BY chunk)),
h AS (SELECT *, coalesce(lead(gap) OVER w, 4 ) AS "right", coalesce(lead(spliced) OVER w, false) AS before FROM g WINDOW w AS (PARTITION BY rec ORDER BY chunk))
SELECT s.rec, s.idx, CASE WHEN (after OR h.spliced) AND gap < 3 AND s.idx >= head - 1 AND s.idx < head + 1 THEN 0.0 WHEN before AND "right" > 5 AND s.idx - first = size - 2 THEN 7.5 WHEN after AND gap > 5 AND s.idx - first = 1 THEN 7.5 ELSE value END AS value FROM s JOIN h USING (rec, chunk)""")
def v16b(spark, d):
    r = R.chunks(recordings(spark, d), 5)
    marks = R.nearest_clean(r.groupBy("rec", "chunk").agg((F.max("value") > 60).alias("abnormal")), K)
    spliced = G.spliced_chunks(r.join(marks, ["rec", "chunk"]), K, "value").withColumn("spliced", F.col("donor").isNotNull())
    return G.repaired_joins(spliced, K, "value", [7.5], height=20.0, distance=1, long=5, short=3, usual=4, ahead=1, back=2, around=1).select("rec", "idx", "value")


@query("v17_quantile_regression", None)
def v17(spark, d):
    return M.quantile_regression_grid(_matrix(spark, d), ALL, "label", [0.01, 0.26, 0.51, 0.76], [0.002])


@query("v18_quantile_forest", None)
def v18(spark, d):
    e = _matrix(spark, d)
    return M.quantile_forest(e, e, "vec_id", ALL, "label", [10.0, 50.0, 90.0], trees=10, max_depth=6)


def c1(spark, d):
    out = W.time_domain(H.nn_intervals(beats(recordings(spark, d)), K), K, 1e8, 300_000.0)
    two = ["sd1", "sd2", "sdnn_index", "sdann"]
    large = out.withColumns({c: F.round(c, 2).cast("decimal(38,2)") for c in two} | {"ellipse_area": F.round(F.col("ellipse_area") / 1e9, 2).cast("decimal(38,2)")})
    return hrv.whole_differences(rounded(large)).withColumns({c: F.col(c).cast("double") for c in (*two, "ellipse_area")})


# The parts are queries of their own, with SQL; the triangular index has bins as wide as those of the triangle.
_tri = f"WITH {REC}, {NN}, {hrv.HIST.replace('1000000.0', '100000000.0')} SELECT rec, round(sum(n) / max(n)::DOUBLE + 1.23e-8, 4) AS tri_index FROM h GROUP BY 1"
_parts = [hrv.Q["a4_a7_hrv_summary"][1], _tri, hrv.Q["v10_tinn"][1], hrv.Q["a10_poincare"][1]]
_joined = f"SELECT * FROM ({_parts[0]}) p0" + "".join(f" JOIN ({p}) p{i} USING (rec)" for i, p in enumerate(_parts[1:], 1)) + f" LEFT JOIN ({hrv.Q['a8_segment_deviations'][1]}) p9 USING (rec)"
Q["c1_time_domain"] = (c1, _joined)


@query("c2_frequency_domain", None)
def c2(spark, d):
    return W.frequency_domain(nn_seconds(spark, d), K, nfft=256, order=8)


@query("c3_nonlinear", f"""WITH {REC}, {NN}, {SAMPEN}, {DFA}, q AS (SELECT rec, stddev_pop((a - b) / sqrt(2)) AS sd1, stddev_pop((a + b) / sqrt(2)) AS sd2 FROM x WHERE b IS NOT NULL GROUP BY 1)
SELECT rec, round(sd1, 4) AS sd1, round(sd2, 4) AS sd2, round(sd2 / nullif(sd1, 0), 4) AS sd_ratio, round(pi() * sd1 * sd2 / 1e9, 4) AS ellipse_area, round(CASE WHEN two > 0 AND three > 0 THEN -ln(three / two) END, 4) AS sampen, round(dfa_short, 4) AS dfa_short, round(dfa_long, 4) AS dfa_long FROM q LEFT JOIN m USING (rec) LEFT JOIN v USING (rec)""")
def c3(spark, d):
    return rounded(W.nonlinear(nn_seconds(spark, d), K).withColumn("ellipse_area", F.col("ellipse_area") / 1e9))


@query("c4_hrv_report", None)
def c4(spark, d):
    nn = H.nn_intervals(beats(recordings(spark, d)), K).withColumn("nn", F.col("nn") / 1e4)
    return W.hrv_report(nn, K, duration_s=60.0, binsize=100.0)


def ratio_sql(measures) -> str:
    """Ratios of all columns but rec of measures(FROM clause of the samples), of whole recordings to their phase 'view'."""
    whole, rest = (f"(FROM (SELECT rec, COLUMNS(* EXCLUDE (rec))::DOUBLE FROM ({measures(where)})) UNPIVOT INCLUDE NULLS (v FOR feature IN (COLUMNS(* EXCLUDE (rec)))))" for where in ("true", "phase = 'view'"))
    return f"SELECT w.rec, w.feature, round(CASE WHEN r.v <> 0 THEN w.v / r.v END, 4) AS value FROM {whole} w LEFT JOIN {rest} r ON w.rec = r.rec AND w.feature = r.feature"


def heart_sql(where: str) -> str:
    points = ", ".join(f"quantile_cont(hr, {q / 100}) AS hr_p{q}" for q in (5, 25, 50, 75, 95))
    return f"""WITH {REC}, {NN.replace("FROM rec", f"FROM rec WHERE {where}")}, {hrv.DIFF}, {SAMPEN}, {DFA},
s AS (SELECT rec, count(nn) AS nn_count, avg(nn) AS nn_mean, min(nn) AS nn_min, max(nn) AS nn_max, avg(diff) AS diff_mean, trunc(min(diff))::INTEGER AS diff_min, trunc(max(diff))::INTEGER AS diff_max, avg(hr) AS hr_mean, min(hr) AS hr_min, max(hr) AS hr_max, stddev_samp(hr) AS hr_std, {points},
  stddev_samp(nn) AS sdnn, stddev_samp(diff) AS sdsd, sqrt(avg(diff * diff)) AS rmssd, count(*) FILTER (diff > 50) AS nn50, count(*) FILTER (diff > 50) * 100.0 / nullif(count(diff), 0) AS pnn50, count(*) FILTER (diff > 20) AS nn20, count(*) FILTER (diff > 20) * 100.0 / nullif(count(diff), 0) AS pnn20 FROM d GROUP BY 1),
q AS (SELECT rec, stddev_pop((x - y) / sqrt(2)) AS sd1, stddev_pop((x + y) / sqrt(2)) AS sd2 FROM (SELECT rec, nn AS x, lead(nn) OVER (PARTITION BY rec ORDER BY beat) AS y FROM nn) WHERE y IS NOT NULL GROUP BY 1)
SELECT s.*, sd1, sd2, sd2 / nullif(sd1, 0) AS sd_ratio, pi() * sd1 * sd2 AS ellipse_area, CASE WHEN two > 0 AND three > 0 THEN -ln(three / two) END AS sampen, dfa_short, dfa_long FROM s LEFT JOIN q USING (rec) LEFT JOIN m USING (rec) LEFT JOIN v USING (rec)"""


@query("j10_hrv_rest_ratio", ratio_sql(heart_sql))
def j10(spark, d):
    r = recordings(spark, d)
    nn, rest = (H.nn_intervals(beats(x), K, scaled=False) for x in (r, R.in_phases(r, ["view"], "phase")))  # ms, however near the beats
    return rounded(W.heart_rest_ratios(nn, rest, K))


def breath_sql(where: str) -> str:
    stats = ", ".join(statistics_sql(c).replace("round(", "(").replace(", 4) AS ", f") AS {c}_") for c in ("out_breath", "in_breath"))
    placed = f"rec AS (SELECT rec, value, row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS idx FROM r0 WHERE {where})"
    return f"""WITH {REC.replace("rec AS (", "r0 AS (", 1)}, {placed}, {peaks_sql('hi', 'value', 0, 3)}, {peaks_sql('lo', '-value', -1000, 3)},
b AS (SELECT h.rec, trunc(h.amplitude + lo.amplitude)::INTEGER AS out_breath, trunc(h.next + lo.amplitude)::INTEGER AS in_breath FROM (SELECT *, lead(amplitude) OVER (PARTITION BY rec ORDER BY n) AS next FROM hi) h JOIN lo ON lo.rec = h.rec AND lo.n = h.n)
SELECT rec, count(*) AS n_events, {stats} FROM b GROUP BY 1"""


@query("j10_breath_rest_ratio", ratio_sql(breath_sql))
def j10b(spark, d):
    r = recordings(spark, d).select("rec", "idx", "value", "phase")
    rest = R.in_phases(r, ["view"], "phase").withColumn("idx", (F.row_number().over(Window.partitionBy("rec").orderBy("idx")) - 1).cast("long"))
    return rounded(W.breath_rest_ratios(r, rest, K, "value", 0.0, 1000.0, 3))


def _matrix(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)))


@query("feature_selection", None)
def selection(spark, d):
    return W.feature_selection(_matrix(spark, d), ALL, "label", [0.26, 0.51, 0.76], [0.002, 0.01])


@query("repeated_evaluation", None)
def evaluation(spark, d):
    return W.repeated_evaluation(_matrix(spark, d), "vec_id", ALL, "label", 4.5, repeats=3, trees=5, max_depth=5)


_raw = ", ".join(f"quantile_cont(v, {q}) AS {n}" for q, n in ((0.05, "n5"), (0.25, "n25"), (0.5, "n50"), (0.75, "n75"), (0.95, "n95"), (0.5, "median")))
_raw += ", max(v) AS max, avg(v) AS mean, min(v) AS min, stddev_pop(v) AS std, sqrt(avg(v * v)) AS rms, avg(abs(v)) AS mean_abs, (count(*) FILTER (v * b < 0))::DOUBLE AS zero_crossings"


@query("c5_interval_features", f"""WITH {REC}, {FILLED}, {IVL}, s AS (SELECT f.rec, slalom, value AS v, lag(value) OVER (PARTITION BY f.rec, slalom ORDER BY idx) AS b FROM filled f JOIN ivl ON f.rec = ivl.rec AND time BETWEEN start AND "end"),
r AS (SELECT rec, value AS v, lag(value) OVER (PARTITION BY rec ORDER BY idx) AS b FROM filled WHERE trigger = 'view'),
l AS (SELECT * FROM (UNPIVOT (SELECT rec, slalom, {_raw} FROM s GROUP BY 1, 2) ON COLUMNS(* EXCLUDE (rec, slalom)) INTO NAME feature VALUE v)), base AS (SELECT * FROM (UNPIVOT (SELECT rec, {_raw} FROM r GROUP BY 1) ON COLUMNS(* EXCLUDE (rec)) INTO NAME feature VALUE base)),
m AS (SELECT rec, feature, median(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1, 2), g AS (SELECT l.*, row_number() OVER (PARTITION BY rec, feature ORDER BY slalom) AS pos, CASE WHEN s IS NULL OR v BETWEEN m - 3 * s AND m + 3 * s THEN v END AS good FROM l JOIN m USING (rec, feature)),
f AS (SELECT *, last_value(good IGNORE NULLS) OVER u AS a, last_value(CASE WHEN good IS NOT NULL THEN pos END IGNORE NULLS) OVER u AS pa, first_value(good IGNORE NULLS) OVER w AS c, first_value(CASE WHEN good IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS pc FROM g
  WINDOW u AS (PARTITION BY rec, feature ORDER BY slalom ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY rec, feature ORDER BY slalom ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT rec, slalom, feature, round(CASE WHEN a IS NULL THEN c WHEN c IS NULL OR pa = pc THEN a ELSE a + (c - a) * (pos - pa) / (pc - pa) END / nullif(base, 0), 4) AS value FROM f LEFT JOIN base USING (rec, feature)""")
def c5(spark, d):
    r = recordings(spark, d)
    return rounded(W.interval_features(r, intervals(r), K, "value", "view", bucket_s=86400.0))


def _halves(r):
    """Two intervals of each recording: its first and its second half."""
    w = Window.partitionBy("rec")
    half = r.withColumns({"half": (F.col("idx") * 2 >= F.count("*").over(w)).cast("int")})
    return half.groupBy("rec", F.col("half").alias("slalom")).agg(F.min("time").alias("start"), F.max("time").alias("end"))


@query("c5_feature_matrix", None)
def c5b(spark, d):
    r = recordings(spark, d).withColumns({"eda": F.col("value"), "rsp": F.col("value") * 2, "ecg": F.col("value") / 50})
    return W.feature_matrix(r, _halves(r), K, "view", "eda", "rsp", "ecg", bucket_s=864_000.0, wavelet="haar", levels=2, offset=0.25, beat_gap=2, breath_gap=2)


@query("c7_clean_skin_signal", None)
def c7(spark, d):
    r = recordings(spark, d).withColumns({"eda": F.col("value"), "time": F.col("idx") / 8})
    ends = r.groupBy("rec", F.floor(F.col("idx") / 40).cast("int").alias("epoch")).agg(F.min("time").alias("first"), F.max("time").alias("last"), F.when(F.max("value") > 90, -1).otherwise(1).alias("label"))
    return W.clean_skin_signal(r, K, ends, {"still": "view", "moving": "click"}, ["purchase", "signup"], rate=8, n_max=3, edge=1, reach=3, floor=1.0)


@query("c8_clean_heart_signal", None)
def c8(spark, d):
    r = recordings(spark, d).withColumn("ecg", F.col("value"))
    return W.clean_heart_signal(r, K, [7.5], chunk=10, trees=50, height=20.0, distance=2, long=8, short=2, usual=5, ahead=1, back=2, around=1)


@query("interval_statistics", f"""WITH {REC}, ivl AS (SELECT rec, CAST(idx // 10 AS INTEGER) AS slalom, time AS start, lead(time, 5) OVER (PARTITION BY rec ORDER BY idx) AS fin, idx FROM rec),
s AS (SELECT r.rec, slalom, value FROM rec r JOIN ivl i ON r.rec = i.rec AND i.idx % 10 = 0 AND fin IS NOT NULL AND time BETWEEN start AND fin) SELECT rec, slalom, {statistics_sql('value')} FROM s GROUP BY 1, 2""")
def interval_statistics(spark, d):
    r = recordings(spark, d)
    out = X.signal_statistics(R.split_by_intervals(r, intervals(r), K, bucket_s=86400.0), ["rec", "slalom"], "value")
    return rounded(out.drop("zero_crossings"))


@query("nextpow2_lengths", f"WITH {REC} SELECT rec, CAST(ceil(round(log2(count(*)), 12)) AS INTEGER) AS exponent FROM rec GROUP BY 1")
def nextpow2(spark, d):
    return recordings(spark, d).groupBy("rec").agg(F.count("*").alias("n")).select("rec", next_power_of_two(F.col("n")).alias("exponent"))


@query("w12_chunk_hrv", f"""WITH {REC}, {NN}, c AS (SELECT rec, beat // 10 AS chunk, CASE WHEN count(*) >= 10 THEN avg(nn) END AS m FROM nn GROUP BY 1, 2)
SELECT rec, chunk, round(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(m IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 2) AS mean FROM c""")
def w12(spark, d):
    c = R.chunks(H.nn_intervals(beats(recordings(spark, d)), K), 10, "beat").groupBy("rec", "chunk").agg(F.when(F.count("*") >= 10, F.avg("nn")).alias("mean"))
    return fill_missing_chunks(c, K, ["mean"]).select("rec", "chunk", F.round("mean", 2).alias("mean"))
