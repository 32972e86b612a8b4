"""Queries on NN intervals (differences of event times), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hrv as H
from ..operators import rolling as L
from .tables import NN, REC, beats, recordings, registrar, rounded

K = ["rec"]
Q: dict = {}
query = registrar(Q)
DIFF = "d AS (SELECT *, abs(nn - lag(nn) OVER (PARTITION BY rec ORDER BY beat)) AS diff, 60000 / nn AS hr FROM nn)"


def nn(spark, d):
    return H.nn_intervals(beats(recordings(spark, d)), K)


def whole_differences(summary):
    """diff_min and diff_max in the type of SQL."""
    return summary.withColumns({c: F.col(c).cast("int") for c in ("diff_min", "diff_max")})


@query("w4_nn_intervals", f"WITH {REC}, {NN} SELECT rec, beat, round(nn, 4) AS nn, round(sum(nn) OVER (PARTITION BY rec ORDER BY beat) / 1000, 3) AS time FROM nn")
def w4(spark, d):
    out = H.beat_clock(nn(spark, d), K)
    return out.select("rec", "beat", F.round(F.col("nn") + 1.23e-8, 4).alias("nn"), F.round("time", 3).alias("time"))


@query("w4_scaled_seconds", f"WITH {REC}, {NN}, s AS (SELECT rec, beat, CASE WHEN rec % 2 = 0 THEN nn / 1e8 ELSE nn END AS nn FROM nn) SELECT rec, beat, round(CASE WHEN max(nn) OVER (PARTITION BY rec) < 10 THEN trunc(nn * 1000) ELSE nn END, 4) AS nn FROM s")
def w4b(spark, d):
    return rounded(H.scaled_nn(nn(spark, d).withColumn("nn", F.when(F.col("rec") % 2 == 0, F.col("nn") / 1e8).otherwise(F.col("nn"))), K))


_p = ", ".join(f"round(quantile_cont(hr, {q}), 4) AS hr_{n}" for q, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95")))


@query("a4_a7_hrv_summary", f"""WITH {REC}, {NN}, {DIFF} SELECT rec, count(nn) AS nn_count, round(avg(nn), 4) AS nn_mean, round(min(nn), 4) AS nn_min, round(max(nn), 4) AS nn_max, round(avg(diff), 4) AS diff_mean,
    CAST(trunc(min(diff)) AS INTEGER) AS diff_min, CAST(trunc(max(diff)) AS INTEGER) AS diff_max, round(avg(hr), 4) AS hr_mean, round(min(hr), 4) AS hr_min, round(max(hr), 4) AS hr_max, round(stddev_samp(hr), 4) AS hr_std, {_p},
    round(stddev_samp(nn), 4) AS sdnn, round(stddev_samp(diff), 4) AS sdsd, round(sqrt(avg(diff * diff)), 4) AS rmssd, count(*) FILTER (diff > 50) AS nn50, round(count(*) FILTER (diff > 50) * 100.0 / nullif(count(diff), 0), 4) AS pnn50,
    count(*) FILTER (diff > 20) AS nn20, round(count(*) FILTER (diff > 20) * 100.0 / nullif(count(diff), 0), 4) AS pnn20 FROM d GROUP BY 1""")
def summary(spark, d):
    return whole_differences(rounded(H.summary(nn(spark, d), K)))


HIST = """t AS (SELECT *, max(nn) OVER (PARTITION BY rec) AS top FROM nn), h AS (SELECT rec, CAST(least(floor(nn / 1000000.0), greatest(ceil((top + 1000000.0) / 1000000.0) - 2, 0)) AS INTEGER) AS bin, count(*) AS n FROM t GROUP BY 1, 2)"""


@query("a9_nn_histogram", f"WITH {REC}, {NN}, {HIST} SELECT rec, bin, n FROM h")
def hist(spark, d):
    return H.histogram(nn(spark, d), K, 1e6)


@query("a9_triangular_index", f"WITH {REC}, {NN}, {HIST} SELECT rec, round(sum(n) / max(n)::DOUBLE, 4) AS tri_index FROM h GROUP BY 1")
def tri(spark, d):
    return rounded(H.triangular_index(H.histogram(nn(spark, d), K, 1e6), K))


@query("a10_poincare", f"""WITH {REC}, {NN}, p AS (SELECT rec, nn AS x, lead(nn) OVER (PARTITION BY rec ORDER BY beat) AS y FROM nn QUALIFY y IS NOT NULL),
s AS (SELECT rec, stddev_pop((x - y) / sqrt(2)) AS sd1, stddev_pop((x + y) / sqrt(2)) AS sd2 FROM p GROUP BY 1)
SELECT rec, round(sd1, 2) AS sd1, round(sd2, 2) AS sd2, round(sd2 / nullif(sd1, 0), 4) AS sd_ratio, round(pi() * sd1 * sd2 / 1e9, 2) AS ellipse_area FROM s""")
def poincare(spark, d):
    p = H.poincare(nn(spark, d), K)
    return p.select("rec", F.round("sd1", 2).alias("sd1"), F.round("sd2", 2).alias("sd2"), F.round(F.col("sd_ratio") + 1.23e-8, 4).alias("sd_ratio"), F.round(F.col("ellipse_area") / 1e9, 2).alias("ellipse_area"))


@query("w13_rolling_beats", f"""WITH {REC}, {NN}, c AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY beat) - 1 AS p, count(*) OVER (PARTITION BY rec) AS n FROM nn),
v AS (SELECT rec, beat, p, CASE WHEN p + 3 >= n THEN avg(nn) OVER (PARTITION BY rec ORDER BY beat ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) ELSE avg(nn) OVER (PARTITION BY rec ORDER BY beat ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS m,
 CASE WHEN p + 3 >= n THEN stddev_samp(nn) OVER (PARTITION BY rec ORDER BY beat ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) ELSE stddev_samp(nn) OVER (PARTITION BY rec ORDER BY beat ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS s FROM c)
SELECT rec, beat, round(m, 2) AS nn_mean, round(s, 2) AS sdnn FROM v WHERE p > 0""")
def rolling_beats(spark, d):
    from ..operators.series import rolling

    out = rolling(nn(spark, d), K, "nn", {"nn_mean": F.avg, "sdnn": F.stddev_samp}, n=3)
    return out.select("rec", "beat", F.round("nn_mean", 2).alias("nn_mean"), F.round("sdnn", 2).alias("sdnn"))


@query("w13_rolling_seconds", f"""WITH {REC}, {NN}, c AS (SELECT *, sum(nn) OVER (PARTITION BY rec ORDER BY beat) / 1000 AS time, row_number() OVER (PARTITION BY rec ORDER BY beat) - 1 AS p FROM nn),
v AS (SELECT rec, beat, p, max(nn) OVER (PARTITION BY rec ORDER BY time RANGE BETWEEN 100000.5 PRECEDING AND 100000.5 FOLLOWING) AS m FROM c) SELECT rec, beat, round(m, 2) AS nn_max FROM v WHERE p > 0""")
def rolling_seconds(spark, d):
    from ..operators.series import rolling

    out = rolling(H.beat_clock(nn(spark, d), K), K, "nn", {"nn_max": F.max}, seconds=100000.5)
    return out.select("rec", "beat", F.round("nn_max", 2).alias("nn_max"))


@query("w13_rolling_measures", f"""WITH {REC}, {NN}, c AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY beat) - 1 AS p, count(*) OVER (PARTITION BY rec) AS n FROM nn),
l AS (SELECT rec, beat, p, CASE WHEN p + 10 >= n THEN list(nn) OVER (PARTITION BY rec ORDER BY beat ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) ELSE list(nn) OVER (PARTITION BY rec ORDER BY beat ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) END AS l FROM c),
d AS (SELECT rec, beat, list_transform(range(2, len(l) + 1), lambda i: l[i] - l[i - 1]) AS d FROM l WHERE p > 0)
SELECT rec, beat, round(sqrt(list_avg(list_transform(d, lambda x: x * x))), 2) AS rmssd, round(100 * list_avg(list_transform(d, lambda x: CASE WHEN abs(x) > 50 THEN 1.0 ELSE 0.0 END)), 2) AS pnn50 FROM d""")
def rolling_measures(spark, d):
    out = L.rolling_measures(nn(spark, d), K, "nn", {m: L.MEASURES[m] for m in ("rmssd", "pnn50")}, n=10)
    return out.select("rec", "beat", F.round("rmssd", 2).alias("rmssd"), F.round("pnn50", 2).alias("pnn50"))


@query("w13_resampled_entropy", None)
def resampled_entropy(spark, d):
    series = H.beat_clock(nn(spark, d).withColumn("nn", F.col("nn") / 1e4), K)
    return L.resampled(L.rolling_measures(series, K, "nn", {"sampen": L.MEASURES["sampen"]}, n=10), K, "sampen", 1 / 60)


@query("p10_heart_rate_classes", f"""WITH {REC}, b AS (SELECT rec, CAST(trunc(value) AS INTEGER) AS hr, CASE WHEN rec % 2 = 0 THEN 'F' ELSE 'M' END AS gender, 20 + rec % 40 AS age FROM rec),
c AS (SELECT * FROM (VALUES ('F', 18, 35, 'low', 0, 20), ('F', 18, 35, 'high', 21, 500), ('F', 36, 70, 'low', 0, 30), ('F', 36, 70, 'high', 31, 500), ('M', 18, 35, 'low', 0, 25), ('M', 18, 35, 'high', 26, 500), ('M', 36, 70, 'low', 0, 35), ('M', 36, 70, 'high', 36, 500)) t(gender, age_lo, age_hi, class, lo, hi)),
n AS (SELECT rec, count(*) AS n FROM b GROUP BY 1) SELECT b.rec, class, round(count(*) * 100.0 / max(n), 4) AS percent FROM b JOIN c ON b.gender = c.gender AND age > age_lo - 1 AND age < age_hi + 1 AND hr BETWEEN lo AND hi JOIN n ON b.rec = n.rec GROUP BY 1, 2""")
def classes(spark, d):
    r = recordings(spark, d)
    series = r.select("rec", "idx", (60000 / (F.floor("value") + 0.5)).alias("nn"))
    people = r.select("rec").distinct().select("rec", F.when(F.col("rec") % 2 == 0, "F").otherwise("M").alias("gender"), (20 + F.col("rec") % 40).alias("age"))
    rows = [(g, a, b, c, lo, hi) for g, edges in (("F", ((18, 35, 20), (36, 70, 30))), ("M", ((18, 35, 25), (36, 70, 35)))) for a, b, e in edges for c, lo, hi in (("low", 0, e), ("high", e + 1, 500))]
    table = spark.createDataFrame(rows, "gender string, age_lo int, age_hi int, class string, hr_lo int, hr_hi int")
    return rounded(H.heart_rate_classes(series, people, table, K))


# Segment k ends before the first beat that takes its sum above the limit; the recursion goes from end to end.
SEGMENTS = """c AS (SELECT rec, beat, nn, row_number() OVER w AS p, sum(nn) OVER w AS clock FROM nn WINDOW w AS (PARTITION BY rec ORDER BY beat)),
t AS (SELECT rec, ceil(max(clock) / 3e8) AS most, max(p) AS n FROM c GROUP BY 1 HAVING max(clock) > 3e8),
s AS (SELECT rec, 0 AS segment, 0::BIGINT AS lo, 0.0::DOUBLE AS at_clock FROM t UNION ALL
  SELECT e.rec, e.segment + 1, e.hi, c.clock FROM (SELECT rec, segment, CASE WHEN pe IS NULL THEN n WHEN pc - at_clock > 3e8 THEN greatest(pe - 1, lo + 1) ELSE pe END AS hi FROM
    (SELECT s.rec, s.segment, s.lo, s.at_clock, t.n, t.most, min(c.p) FILTER (c.clock >= s.at_clock + 3e8) AS pe, min(c.clock) FILTER (c.clock >= s.at_clock + 3e8) AS pc
     FROM s JOIN t ON s.rec = t.rec JOIN c ON c.rec = s.rec AND c.p > s.lo GROUP BY ALL) WHERE segment < most) e JOIN c ON c.rec = e.rec AND c.p = e.hi),
g AS (SELECT a.rec, a.segment, a.lo, b.lo AS hi FROM s a JOIN s b ON a.rec = b.rec AND b.segment = a.segment + 1),
parts AS (SELECT c.rec, c.beat, c.nn, CAST(g.segment AS INTEGER) AS segment FROM c JOIN g ON c.rec = g.rec AND c.p > g.lo AND c.p <= g.hi)"""


@query("v6_segments", f"WITH RECURSIVE {REC}, {NN}, {SEGMENTS} SELECT rec, beat, round(nn, 4) AS nn, segment FROM parts")
def segments(spark, d):
    return rounded(H.segments(nn(spark, d), K, duration_s=300_000.0))


@query("a8_segment_deviations", f"""WITH RECURSIVE {REC}, {NN}, {SEGMENTS}, q AS (SELECT rec, segment, stddev_samp(nn) AS s, avg(nn) AS m FROM parts GROUP BY 1, 2)
SELECT rec, round(avg(s), 2) AS sdnn_index, round(stddev_samp(m), 2) AS sdann FROM q GROUP BY 1""")
def deviations(spark, d):
    out = H.segment_deviations(H.segments(nn(spark, d), K, duration_s=300_000.0), K)
    return out.select("rec", F.round("sdnn_index", 2).alias("sdnn_index"), F.round("sdann", 2).alias("sdann"))


@query("v10_tinn", f"""WITH {REC}, {NN}, t AS (SELECT rec, greatest(CAST(ceil((max(nn) + 1e8) / 1e8) AS INTEGER) - 2, 0) AS last FROM nn GROUP BY 1),
h AS (SELECT rec, least(CAST(floor(nn / 1e8) AS INTEGER), last) AS bin, count(*) AS n FROM nn JOIN t USING (rec) GROUP BY 1, 2), m AS (SELECT rec, max(bin) + 1 AS most, arg_max(bin, (n, -bin)) AS top, max(n) AS peak FROM h GROUP BY 1),
d AS (SELECT m.rec, i, top, peak, most, coalesce(n, 0) AS n FROM m, unnest(range(0, most + 1)) u(i) LEFT JOIN h ON h.rec = m.rec AND h.bin = i),
l AS (SELECT d.rec, a, sum(pow(CASE WHEN i >= a THEN peak * (i - a) / (top - a)::DOUBLE ELSE 0 END - n, 2)) AS e FROM d, unnest(range(0, top)) u(a) WHERE i < top GROUP BY 1, 2),
r AS (SELECT d.rec, b, sum(pow(CASE WHEN i <= b THEN peak * (b - i) / (b - top)::DOUBLE ELSE 0 END - n, 2)) AS e FROM d, unnest(range(top + 1, most + 1)) u(b) WHERE i > top GROUP BY 1, 2),
f AS (SELECT m.rec, lb.a, lb.e AS le, rb.b, rb.e AS re FROM m LEFT JOIN (SELECT rec, min_by(a, (round(e, 6), a)) AS a, min(e) AS e FROM l GROUP BY 1) lb ON lb.rec = m.rec LEFT JOIN (SELECT rec, min_by(b, (round(e, 6), -b)) AS b, min(e) AS e FROM r GROUP BY 1) rb ON rb.rec = m.rec)
SELECT rec, CASE WHEN le + re < 16384 THEN a * 1e8 ELSE 0.0 END AS tinn_n, CASE WHEN le + re < 16384 THEN b * 1e8 ELSE 0.0 END AS tinn_m, CASE WHEN le + re < 16384 THEN (b - a) * 1e8 ELSE 0.0 END AS tinn FROM f""")
def tinn(spark, d):
    return H.tinn(H.histogram(nn(spark, d), K, 1e8), K, 1e8)
