"""Queries on recordings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import epochs as E
from ..operators import features as X
from ..operators import recordings as R
from ..operators import series as S
from .tables import NUDGE, IVL, REC, REST, intervals, recordings, registrar, rounded, statistics_sql, table

K = ["rec"]
Q: dict = {}


query = registrar(Q)


FILLED = """filled AS (SELECT * EXCLUDE (trigger, b, a), CASE WHEN trigger = '_' AND b IS NOT NULL AND a IS NOT NULL THEN b ELSE trigger END AS trigger FROM (
    SELECT *, last_value(nullif(trigger, '_') IGNORE NULLS) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
        first_value(nullif(trigger, '_') IGNORE NULLS) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM rec))"""


@query("w1_trigger_fill", f"WITH {REC}, {FILLED} SELECT rec, idx, trigger FROM filled")
def w1(spark, d):
    return R.fill_triggers(recordings(spark, d), K).select("rec", "idx", "trigger")


@query(
    "w2_trigger_runs",
    f"""WITH {REC}, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(trigger) OVER w = trigger THEN 0 ELSE 1 END AS ch FROM rec WINDOW w AS (PARTITION BY rec ORDER BY idx)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY rec ORDER BY idx) AS run FROM c)
SELECT rec, CAST(run AS INTEGER) AS run, min(idx) AS first_idx, max(idx) AS last_idx, min(trigger) AS trigger FROM r GROUP BY 1, 2""",
)
def w2(spark, d):
    return R.trigger_runs(recordings(spark, d), K).groupBy("rec", "run").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("trigger").alias("trigger"))


@query(
    "w3_last_rest_rows",
    f"""WITH {REC}, m AS (SELECT *, CASE WHEN value <> lead(value) OVER (PARTITION BY rec ORDER BY idx) THEN idx END AS mv FROM rec),
f AS (SELECT *, min(mv) OVER (PARTITION BY rec) AS fi FROM m)
SELECT rec, idx, value FROM f WHERE idx > fi AND trigger = 'view' QUALIFY row_number() OVER (PARTITION BY rec ORDER BY idx DESC) <= 5""",
)
def w3(spark, d):
    return R.last_rows_of_phase(recordings(spark, d), K, REST, 5, changing="value").select("rec", "idx", "value")


@query("p1_column_pick", "SELECT event_id, value FROM events")
def p1(spark, d):
    return R.pick_columns(table(spark, d, "events"), ["event_id", "value"])


@query("p2_phase_filter", f"WITH {REC} SELECT rec, idx, time, value FROM rec WHERE trigger IN ('view', 'click')")
def p2(spark, d):
    return R.in_phases(recordings(spark, d), [REST, "click"]).select("rec", "idx", "time", "value")


@query("p3_drop_null_columns", f"WITH {REC} SELECT rec, idx, value, value * 2 AS twice FROM rec")
def p3(spark, d):
    df = recordings(spark, d).select("rec", "idx", "value", (F.col("value") * 2).alias("twice"), F.lag("value").over(Window.partitionBy("rec").orderBy("idx")).alias("before"), (F.col("value").cast("double") / F.when(F.col("idx") > 0, 1.0).otherwise(float("inf")) * F.when(F.col("idx") > 0, 1.0).otherwise(float("inf"))).alias("endless"))
    return R.without_null_columns(df, ["rec", "idx"])


@query("j1_interval_join", f"WITH {REC}, {IVL} SELECT r.rec, idx, time, value, slalom FROM rec r JOIN ivl i ON r.rec = i.rec AND time BETWEEN start AND \"end\"")
def j1(spark, d):
    r = recordings(spark, d)
    return R.split_by_intervals(r, intervals(r), K, bucket_s=86400.0).select("rec", "idx", "time", "value", "slalom")


GAPS = 'gaps AS (SELECT rec, slalom, "end" AS start, coalesce(lead(start) OVER (PARTITION BY rec ORDER BY slalom), "end" + 15) AS "end" FROM ivl)'


@query(
    "j2_interval_scores",
    f"""WITH {REC}, {IVL}, {GAPS}, s AS (SELECT r.rec, slalom, idx, value FROM rec r JOIN gaps g ON r.rec = g.rec AND time BETWEEN start AND "end"),
p AS (SELECT rec, slalom, idx, list_sort(list(value) OVER (PARTITION BY rec, slalom ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM s),
m AS (SELECT rec, slalom, list_sort(list_concat(l, list_transform(range(5 - len(l)), lambda x: 0.0)))[3] AS v FROM p)
SELECT rec, slalom, round(max(v), 4) AS score FROM m GROUP BY 1, 2""",
)
def j2(spark, d):
    r = recordings(spark, d)
    return rounded(R.interval_scores(r.withColumnRenamed("value", "score"), intervals(r), K, k=5, bucket_s=86400.0))


@query(
    "j3_score_override",
    f"""WITH {REC}, {IVL}, {GAPS}, n AS (SELECT *, slalom + 0.5 AS new_score FROM gaps WHERE slalom % 2 = 0),
h AS (SELECT r.rec, idx, arg_max(new_score, slalom) AS new FROM rec r JOIN n ON r.rec = n.rec AND time BETWEEN start AND "end" GROUP BY 1, 2)
SELECT rec, idx, coalesce(new, value) AS score FROM rec LEFT JOIN h USING (rec, idx)""",
)
def j3(spark, d):
    r = recordings(spark, d)
    new = R.gaps_after(intervals(r), K).where("slalom % 2 = 0").withColumn("new_score", F.col("slalom") + F.lit(0.5))
    return R.override_scores(r.select("rec", "idx", "time", F.col("value").alias("score")), new, K, bucket_s=86400.0).select("rec", "idx", "score")


@query(
    "j4_corrections",
    f"""WITH {REC} SELECT rec, idx, CASE WHEN rec % 3 = 0 AND idx BETWEEN 2 AND 4 THEN 'fixed' WHEN rec % 3 = 1 AND trigger = 'click' THEN 'tap' ELSE trigger END AS trigger
FROM rec WHERE NOT (rec % 3 = 0 AND idx BETWEEN 7 AND 8)""",
)
def j4(spark, d):
    r = recordings(spark, d)
    recs = r.select("rec").distinct()
    none = F.lit(None).cast("string")
    rules = recs.where("rec % 3 = 0").select("rec", F.lit("relabel").alias("op"), F.lit(2).alias("lo"), F.lit(4).alias("hi"), none.alias("old"), F.lit("fixed").alias("value"))
    rules = rules.unionByName(recs.where("rec % 3 = 0").select("rec", F.lit("drop").alias("op"), F.lit(7).alias("lo"), F.lit(8).alias("hi"), none.alias("old"), none.alias("value")))
    rules = rules.unionByName(recs.where("rec % 3 = 1").select("rec", F.lit("rename").alias("op"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit("click").alias("old"), F.lit("tap").alias("value")))
    return R.apply_corrections(r, rules, K).select("rec", "idx", "trigger")


@query(
    "j5_epoch_labels",
    f"""WITH {REC}, {IVL}, h AS (SELECT r.rec, idx, arg_max(slalom % 3 - 1, slalom) AS l FROM rec r JOIN ivl i ON r.rec = i.rec AND time BETWEEN start AND "end" GROUP BY 1, 2)
SELECT rec, idx, CAST(coalesce(l, 1) AS INTEGER) AS label FROM rec LEFT JOIN h USING (rec, idx)""",
)
def j5(spark, d):
    r = recordings(spark, d)
    labels = intervals(r).select("rec", F.col("slalom").alias("epoch"), F.col("start").alias("first"), F.col("end").alias("last"), (F.col("slalom") % 3 - 1).alias("label"))
    return E.spread_labels(r, labels, K, bucket_s=86400.0).select("rec", "idx", F.col("label").cast("int").alias("label"))


@query(
    "j6_artefact_replacement",
    f"""WITH {REC}, t AS (SELECT rec, idx, us // 1000000 % 100000 / 4.0 AS time, value, idx % 7 = 3 AS art, trigger IN ('view', 'click') AS ok FROM rec),
p AS (SELECT *, CASE WHEN art THEN round_even(time / 5, 0) * 5 END AS pt FROM t),
m AS (SELECT a.rec, a.pt, avg(c.value) AS mean FROM (SELECT DISTINCT rec, pt FROM p WHERE art) a JOIN p c ON a.rec = c.rec AND NOT c.art AND c.ok AND c.time > a.pt - 600 AND c.time < a.pt + 600 GROUP BY 1, 2),
n AS (SELECT p.rec, p.idx, CASE WHEN art THEN mean ELSE value END AS v FROM p LEFT JOIN m ON p.rec = m.rec AND p.pt = m.pt)
SELECT rec, idx, round(coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(v IGNORE NULLS) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS value_clean FROM n""",
)
def j6(spark, d):
    r = recordings(spark, d).withColumn("time", F.floor(F.col("us") / 1000000) % 100000 / 4.0)
    r = r.select("rec", "idx", "time", "value", "trigger")
    return rounded(S.replace_artefacts(r, K, "value", F.col("idx") % 7 == 3, F.col("trigger").isin("view", "click"), half_s=600.0).select("rec", "idx", "value_clean"))


LONG = f"""long AS (SELECT rec, phase, day, f AS feature, v AS value FROM (SELECT rec, phase, day, avg(value) AS mean, max(value) AS max, stddev_pop(value) AS std FROM rec GROUP BY 1, 2, 3)
    UNPIVOT (v FOR f IN (mean, max, std)))"""


def _long(spark, d):
    wide = recordings(spark, d).groupBy("rec", "phase", "day").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))
    return X.to_long(wide, ["rec", "phase", "day"])


def _base(spark, d):
    rest = recordings(spark, d).where(F.col("phase") == REST).groupBy("rec").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))
    return X.to_long(rest, K)


BASE = "base AS (SELECT rec, f AS feature, v AS base FROM (SELECT rec, avg(value) AS mean, max(value) AS max, stddev_pop(value) AS std FROM rec WHERE phase = 'view' GROUP BY 1) UNPIVOT (v FOR f IN (mean, max, std)))"


@query("j7_normalise", f"WITH {REC}, {LONG}, {BASE} SELECT rec, phase, CAST(day AS VARCHAR) AS day, feature, round(value / nullif(base, 0), 4) AS value FROM long LEFT JOIN base USING (rec, feature)")
def j7(spark, d):
    return rounded(X.normalised(_long(spark, d), _base(spark, d), K)).select("rec", "phase", F.col("day").cast("string").alias("day"), "feature", "value")


@query("j7_missing_baselines", f"WITH {REC} SELECT DISTINCT rec FROM rec WHERE rec NOT IN (SELECT rec FROM rec WHERE phase = 'view' AND rec % 4 <> 0)")
def j7b(spark, d):
    return X.without_baseline(_long(spark, d), _base(spark, d).where("rec % 4 <> 0"), K)


@query("j8_rest_baseline", f"WITH {REC} SELECT rec, idx, round(value / nullif(avg(CASE WHEN phase = 'view' THEN value END) OVER (PARTITION BY rec), 0), 4) AS value FROM rec")
def j8(spark, d):
    return rounded(S.rest_baseline(recordings(spark, d), K, "value", F.col("phase") == REST).select("rec", "idx", "value"))


@query(
    "j9_range_baseline",
    f"""WITH {REC}, m AS (SELECT *, value * 2 AS tonic, value / 2 AS phasic, value <> lead(value) OVER (PARTITION BY rec ORDER BY idx) AS mv FROM rec),
f AS (SELECT *, min(CASE WHEN mv THEN idx END) OVER (PARTITION BY rec) AS fi, min(CASE WHEN mv THEN time END) OVER (PARTITION BY rec) AS ft, rec % 5 = 0 AS bare FROM m),
s AS (SELECT rec, min(tonic) FILTER (phase = 'view' AND NOT bare AND idx > fi) AS a, min(tonic) FILTER (phase = 'click' AND NOT bare) AS b,
  min(tonic) FILTER (time - ft >= 0 AND time - ft < 864000) AS fa, min(tonic) FILTER (time - ft >= 864000 AND time - ft < 1728000) AS fb, max(tonic) AS top, max(phasic) AS high FROM f GROUP BY 1),
l AS (SELECT rec, top, high, CASE WHEN a IS NULL AND b IS NULL THEN fa ELSE a END AS la, CASE WHEN a IS NULL AND b IS NULL THEN fb ELSE b END AS lb FROM s)
SELECT rec, idx, round((tonic - la) / nullif(top - la, 0) + phasic / nullif(high, 0), 4) AS corrected_still, round((tonic - lb) / nullif(top - lb, 0) + phasic / nullif(high, 0), 4) AS corrected_moving FROM f JOIN l USING (rec)""",
)
def j9(spark, d):
    """Every fifth recording has no rest rows and falls back on ten days after the first change, and the ten days after them."""
    r = recordings(spark, d).withColumns({"tonic": F.col("value") * 2, "phasic": F.col("value") / 2})
    some = F.col("rec") % 5 != 0
    out = S.range_baseline(r, K, {"still": (F.col("phase") == REST) & some, "moving": (F.col("phase") == "click") & some}, changing="value", fallback_s=864_000.0)
    return rounded(out.select("rec", "idx", "corrected_still", "corrected_moving"))


@query("j11_condition_lookup", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0.05 AND l_tax = 0.02 THEN 'C1' WHEN l_discount = 0.01 AND l_tax = 0.04 THEN 'C2' ELSE 'C3' END AS condition FROM lineitem WHERE (l_discount = 0.05 AND l_tax = 0.02) OR (l_discount = 0.01 AND l_tax = 0.04) OR (l_discount = 0.1 AND l_tax = 0.08)")
def j11(spark, d):
    names = spark.createDataFrame([("C1", 0.05, 0.02), ("C2", 0.01, 0.04), ("C3", 0.10, 0.08)], "condition string, a double, b double")
    names = names.select("condition", F.col("a").cast("decimal(6,3)").alias("a"), F.col("b").cast("decimal(6,3)").alias("b"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("decimal(6,3)").alias("a"), F.col("l_tax").cast("decimal(6,3)").alias("b"))
    return li.join(F.broadcast(names), ["a", "b"]).select("l_orderkey", "l_linenumber", "condition")


@query("j12_aligned_signals", f"WITH {REC} SELECT rec, count(*) FILTER (idx % 11 = 5) AS mismatches FROM rec GROUP BY 1")
def j12(spark, d):
    r = recordings(spark, d)
    other = r.withColumn("time", F.when(F.col("idx") % 11 == 5, F.col("time") + 1).otherwise(F.col("time"))).withColumnRenamed("value", "ecg")
    return R.aligned(r, other, K, "ecg")[1]


@query(
    "j16_reference_comparison",
    f"WITH {REC}, {BASE}, a AS (SELECT rec, feature, base AS v FROM base WHERE rec % 2 = 0), b AS (SELECT rec + 1 AS rec, feature, base AS r FROM base) SELECT rec, feature, round(v / nullif(r, 0) * 100, 4) AS percent FROM a JOIN b USING (rec, feature) WHERE v IS NOT NULL AND r IS NOT NULL",
)
def j16(spark, d):
    from ..operators.hrv import against_reference

    base = _base(spark, d)
    return rounded(against_reference(base.where("rec % 2 = 0"), base.withColumn("rec", F.col("rec") + 1), K))


@query(
    "j17_nearest_clean_chunk",
    f"""WITH {REC}, c AS (SELECT rec, idx // 5 AS chunk, max(value) > 60 AS abnormal FROM rec GROUP BY 1, 2),
n AS (SELECT *, last_value(CASE WHEN NOT abnormal THEN chunk END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
  first_value(CASE WHEN NOT abnormal THEN chunk END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM c)
SELECT rec, chunk, abnormal, CASE WHEN NOT abnormal THEN NULL WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN hi - chunk < chunk - lo THEN hi ELSE lo END AS donor FROM n""",
)
def j17(spark, d):
    c = R.chunks(recordings(spark, d), 5).groupBy("rec", "chunk").agg((F.max("value") > 60).alias("abnormal"))
    return R.nearest_clean(c, K)


@query(
    "u1_lead_in",
    f"""WITH {REC}, s AS (SELECT rec, min(time) FILTER (trigger = 'click') AS own FROM rec GROUP BY 1), n AS (SELECT rec, 50 + rec % 7 AS n FROM s WHERE own IS NOT NULL),
f AS (SELECT rec, value FROM rec WHERE idx = 0)
SELECT rec, idx, round(time, 4) AS time, value FROM rec UNION ALL SELECT rec, i - n, round(i * 0.001, 4), value FROM n JOIN f USING (rec), unnest(range(0, n)) t(i)""",
)
def u1(spark, d):
    r = recordings(spark, d)
    log = r.withColumn("time", F.col("time") + (50 + F.col("rec") % 7) * 0.001)
    return rounded(R.lead_in(r, log, K, "click").select("rec", "idx", "time", "value"))


@query(
    "u2_joined_parts",
    f"""WITH {REC}, e AS (SELECT rec, max(time) AS t, max(idx) + 1 AS n FROM rec WHERE day < DATE '2024-01-10' GROUP BY 1)
SELECT rec, idx, round(time, 4) AS time FROM rec WHERE day < DATE '2024-01-10' UNION ALL
SELECT rec, idx + coalesce(n, 0), round(time + coalesce(t, 0), 4) FROM rec LEFT JOIN e USING (rec) WHERE day >= DATE '2024-01-10'""",
)
def u2(spark, d):
    r = recordings(spark, d)
    early = F.col("day") < F.lit("2024-01-10").cast("date")
    return rounded(R.join_parts(r.where(early), r.where(~early), K).select("rec", "idx", "time"))


@query("u3_stacked_campaigns", "SELECT event_id, value, NULL::VARCHAR AS props FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, value, props FROM events WHERE event_type = 'click'")
def u3(spark, d):
    e = table(spark, d, "events")
    return R.stack(e.where("event_type = 'view'").select("event_id", "value"), e.where("event_type = 'click'").select("event_id", "value", "props"))


@query("u4_wide_concat", f"WITH {REC} SELECT a.rec, round(m, 4) AS m, x FROM (SELECT rec, avg(value) AS m FROM rec GROUP BY 1) a JOIN (SELECT rec, max(value) AS x FROM rec WHERE phase = 'view' GROUP BY 1) b USING (rec)")
def u4(spark, d):
    r = recordings(spark, d)
    return rounded(X.wide_concat([r.groupBy("rec").agg(F.avg("value").alias("m")), r.where(F.col("phase") == REST).groupBy("rec").agg(F.max("value").alias("x"))], K))


@query("a1_signal_statistics", f"""WITH {REC}, z AS (SELECT rec, trigger, value - 30 AS v, lag(value - 30) OVER (PARTITION BY rec, trigger ORDER BY idx) AS b FROM rec)
SELECT rec, trigger, {statistics_sql('v')}, count(*) FILTER (v * b < 0) AS zero_crossings FROM z GROUP BY 1, 2""")
def a1(spark, d):
    r = recordings(spark, d).withColumn("v", F.col("value") - 30)
    return rounded(X.signal_statistics(r, ["rec", "trigger"], "v"))


def _repair_sql(m):
    return f"""g AS (SELECT rec, phase, day, mean, {m} OVER (PARTITION BY rec, phase) AS m, stddev_samp(mean) OVER (PARTITION BY rec, phase) AS s, row_number() OVER (PARTITION BY rec, phase ORDER BY day) AS pos FROM
    (SELECT rec, phase, day, avg(value) AS mean FROM rec GROUP BY 1, 2, 3)),
k AS (SELECT *, CASE WHEN s IS NULL OR mean BETWEEN m - 1.0 * s AND m + 1.0 * s THEN mean END AS ok FROM g),
f AS (SELECT *, last_value(ok IGNORE NULLS) OVER u AS a, last_value(CASE WHEN ok IS NOT NULL THEN pos END IGNORE NULLS) OVER u AS pa, first_value(ok IGNORE NULLS) OVER v AS b, first_value(CASE WHEN ok IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS pb FROM k
  WINDOW u AS (PARTITION BY rec, phase ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY rec, phase ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w5_outlier_repair", f"WITH {REC}, {_repair_sql('median(mean)')} SELECT rec, phase, CAST(day AS VARCHAR) AS day, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL OR pa = pb THEN a ELSE a + (b - a) * (pos - pa) / (pb - pa) END, 4) AS value, round(mean, 4) AS old FROM f")
def w5(spark, d):
    daily = recordings(spark, d).groupBy("rec", "phase", "day").agg(F.avg("value").alias("value"))
    return rounded(S.repair_outliers(daily, ["rec", "phase"], "day", beta=1.0)).select("rec", "phase", F.col("day").cast("string").alias("day"), "value", "old")


GAP = """h AS (SELECT rec, idx, CASE WHEN idx % 5 IN (0, 3) THEN NULL ELSE value END AS v FROM rec),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER u AS a, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER u AS pa, first_value(v IGNORE NULLS) OVER w AS b, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS pb FROM h
  WINDOW u AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w6_gap_interpolation", f"WITH {REC}, {GAP} SELECT rec, idx, round(CASE WHEN a IS NULL THEN NULL WHEN b IS NULL OR pa = pb THEN a ELSE a + (b - a) * (idx - pa) / (pb - pa) END, 4) AS value FROM f")
def w6(spark, d):
    r = recordings(spark, d).withColumn("value", F.when(~(F.col("idx") % 5).isin(0, 3), F.col("value")))
    return rounded(S.fill_gaps(r, K, "value").select("rec", "idx", "value"))


@query("w7_sliding_median", f"""WITH {REC}, p AS (SELECT rec, idx, list(value) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM rec)
SELECT rec, idx, list_sort(list_concat(l, list_transform(range(5 - len(l)), lambda x: 0.0)))[3] AS value_median FROM p""")
def w7(spark, d):
    return R.sliding_median(recordings(spark, d), K, "value", 5).select("rec", "idx", "value_median")


@query("w8_pooled_max", f"WITH {REC} SELECT rec, idx, max(value) OVER (PARTITION BY rec, floor(time / 86400)) AS value_pooled FROM rec")
def w8(spark, d):
    return S.pooled_max(recordings(spark, d), K, "value", 86400.0).select("rec", "idx", "value_pooled")


@query("w8_pooled_max_right_closed", f"WITH {REC} SELECT rec, idx, max(value) OVER (PARTITION BY rec, greatest(ceil(time / 86400) - 1, 0)) AS value_pooled FROM rec")
def w8b(spark, d):
    return S.pooled_max(recordings(spark, d), K, "value", 86400.0, right_closed=True).select("rec", "idx", "value_pooled")


@query("w9_resample_decimate", f"WITH {REC} SELECT rec, idx // 4 AS tick, value FROM rec WHERE idx % 4 = 0")
def w9(spark, d):
    return S.to_8hz(recordings(spark, d), K, "value", 32)


@query("w9_resample_interpolate", f"""WITH {REC}, t AS (SELECT rec, unnest(range(0, 2 * max(idx) + 1)) AS tick FROM rec GROUP BY 1), g AS (SELECT t.rec, tick, value AS v FROM t LEFT JOIN rec r ON t.rec = r.rec AND tick = 2 * idx)
SELECT rec, tick, round(coalesce(v, (lag(v) OVER (PARTITION BY rec ORDER BY tick) + lead(v) OVER (PARTITION BY rec ORDER BY tick)) / 2), 4) AS value FROM g""")
def w9b(spark, d):
    return rounded(S.to_8hz(recordings(spark, d), K, "value", 4))


@query("w11_chunks", f"WITH {REC} SELECT rec, idx // 7 AS chunk, count(*) AS n, round(avg(value), 4) AS mean FROM rec GROUP BY 1, 2")
def w11(spark, d):
    return rounded(R.chunks(recordings(spark, d), 7).groupBy("rec", "chunk").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("w12_missing_chunks", f"""WITH {REC}, c AS (SELECT rec, idx // 7 AS chunk, avg(value) AS m FROM rec GROUP BY 1, 2), h AS (SELECT rec, chunk, CASE WHEN chunk % 3 <> 0 THEN m END AS m FROM c)
SELECT rec, chunk, round(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(m IGNORE NULLS) OVER (PARTITION BY rec ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 4) AS mean FROM h""")
def w12(spark, d):
    c = R.chunks(recordings(spark, d), 7).groupBy("rec", "chunk").agg(F.avg("value").alias("mean")).withColumn("mean", F.when(F.col("chunk") % 3 != 0, F.col("mean")))
    return rounded(S.fill_missing_chunks(c, K, ["mean"]))


@query("w14_stillness", f"""WITH {REC}, m AS (SELECT rec, idx, sqrt(value * value + coalesce(lag(value) OVER w, 0) ** 2 + coalesce(lag(value, 2) OVER w, 0) ** 2) AS v FROM rec WINDOW w AS (PARTITION BY rec ORDER BY idx)),
s AS (SELECT rec, idx // 10 AS minute, v - lag(v) OVER (PARTITION BY rec ORDER BY idx) AS d FROM m) SELECT rec, minute, count(*) FILTER (d < 0.1) / nullif(count(d), 0) > 0.5 AS still FROM s GROUP BY 1, 2""")
def w14(spark, d):
    w = Window.partitionBy("rec").orderBy("idx")
    r = recordings(spark, d).select("rec", "idx", F.col("value").alias("x"), F.coalesce(F.lag("value").over(w), F.lit(0.0)).alias("y"), F.coalesce(F.lag("value", 2).over(w), F.lit(0.0)).alias("z"))
    return S.stillness(r.withColumn("m", S.motion(r)), K, "m", order="idx", minute=10, share=0.5)


@query("w21_autocorrelation", f"""WITH {REC}, n AS (SELECT rec, count(*) AS n FROM rec GROUP BY 1), p AS (SELECT a.rec, CAST(k AS INTEGER) AS lag, coalesce(sum(a.value * b.value), 0) AS s FROM rec a, unnest(range(0, 6)) t(k) LEFT JOIN rec b ON a.rec = b.rec AND b.idx = a.idx + k GROUP BY 1, 2)
SELECT rec, lag, round(s / n, 4) AS r FROM p JOIN n USING (rec)""")
def w21(spark, d):
    return rounded(S.autocorrelation(recordings(spark, d), K, "value", 5))


@query("w21_many_lags", f"""WITH {REC}, n AS (SELECT rec, count(*) AS n FROM rec GROUP BY 1), p AS (SELECT a.rec, CAST(k AS INTEGER) AS lag, coalesce(sum(a.value * b.value), 0) AS s FROM rec a, unnest(range(0, 61)) t(k) LEFT JOIN rec b ON a.rec = b.rec AND b.idx = a.idx + k GROUP BY 1, 2)
SELECT rec, lag, round(s / n, 4) AS r FROM p JOIN n USING (rec)""")
def w21b(spark, d):
    return rounded(S.autocorrelation(recordings(spark, d), K, "value", 60))


@query("w22_defect_thresholds", f"""WITH {REC}, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(trigger) OVER w = trigger THEN 0 ELSE 1 END AS ch FROM rec WINDOW w AS (PARTITION BY rec ORDER BY idx)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY rec ORDER BY idx) AS run FROM c), s AS (SELECT rec, run, abs(lead(value) OVER v - 2 * value + lag(value) OVER v) AS d2 FROM r WINDOW v AS (PARTITION BY rec, run ORDER BY idx))
SELECT rec, CAST(run AS INTEGER) AS run, round(20 * quantile_cont(d2, 0.8), 4) AS threshold FROM s WHERE d2 IS NOT NULL GROUP BY 1, 2""")
def w22(spark, d):
    r = R.trigger_runs(recordings(spark, d), K)
    w = Window.partitionBy("rec", "run").orderBy("idx")
    d2 = F.abs(F.lead("value").over(w) - 2 * F.col("value") + F.lag("value").over(w))
    return rounded(r.withColumn("d2", d2).where("d2 IS NOT NULL").groupBy("rec", "run").agg((20 * F.percentile("d2", F.lit(0.8))).alias("threshold")))


FLAG = f"""WITH {REC}, {FILLED}, s AS (SELECT rec, trigger, {statistics_sql('value')} FROM filled GROUP BY 1, 2), b AS (SELECT rec, mean AS m, std AS sd, rms AS r FROM s WHERE trigger = 'view')
SELECT rec, trigger, round(mean / nullif(m, 0), 2) AS mean, round(std / nullif(sd, 0), 2) AS std, round(rms / nullif(r, 0), 2) AS rms FROM s LEFT JOIN b USING (rec)"""


@query("flagship", FLAG)
def flagship(spark, d):
    """Trigger fill, statistics per phase, and their ratio to the rest phase."""
    stats = X.signal_statistics(R.fill_triggers(recordings(spark, d), K), ["rec", "trigger"], "value").select("rec", "trigger", *(F.round(c, 4).alias(c) for c in ("mean", "std", "rms")))
    long = X.to_long(stats, ["rec", "trigger"])
    base = X.to_long(stats.where(F.col("trigger") == REST).drop("trigger"), K)
    return rounded(X.to_wide(X.normalised(long, base, K), ["rec", "trigger"], ["mean", "std", "rms"]), 2)


@query("w10_epochs", f"""WITH {REC}, t AS (SELECT rec, unnest(range(0, (max(idx) + 1) // 16 - 1)) AS epoch FROM rec GROUP BY 1)
SELECT t.rec, CAST(epoch AS INTEGER) AS epoch, count(*) AS n, round(avg(value), 4) AS mean FROM t JOIN rec r ON t.rec = r.rec AND idx BETWEEN epoch * 16 AND epoch * 16 + 16 GROUP BY 1, 2""")
def w10(spark, d):
    return rounded(E.epochs(recordings(spark, d), K, "idx", window=2, step=2).groupBy("rec", "epoch").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("a2_derivative_features", f"""WITH {REC}, e AS (SELECT *, idx // 16 AS epoch FROM rec), s AS (SELECT rec, epoch, value, (lead(value) OVER w - lag(value) OVER w) / 2 AS d1, lead(value) OVER w - 2 * value + lag(value) OVER w AS d2 FROM e WINDOW w AS (PARTITION BY rec, epoch ORDER BY idx))
SELECT rec, epoch, round(avg(value), 4) AS mean, round(max(d1), 4) AS d1_max, round(min(d1), 4) AS d1_min, round(max(abs(d1)), 4) AS d1_max_abs, round(avg(abs(d1)), 4) AS d1_mean_abs, round(max(d2), 4) AS d2_max, round(min(d2), 4) AS d2_min, round(max(abs(d2)), 4) AS d2_max_abs, round(avg(abs(d2)), 4) AS d2_mean_abs FROM s GROUP BY 1, 2""")
def a2(spark, d):
    return rounded(E.derivative_features(recordings(spark, d).withColumn("epoch", F.floor(F.col("idx") / 16)), K, "value", "idx"))


HAAR = "c AS (" + " UNION ALL ".join(f"SELECT rec, {k} AS level, idx // {2**k} AS k, sum(CASE WHEN idx % {2**k} < {2 ** (k - 1)} THEN value ELSE -value END) / {2 ** (k / 2)!r} AS d FROM rec GROUP BY 1, 2, 3 HAVING count(*) = {2**k}" for k in (1, 2, 3)) + ")"


@query("w15_haar_coefficients", f"""WITH {REC}, {HAAR}, s AS (SELECT rec, level, k // (8 // CAST(2 ** level AS BIGINT)) AS second, max(abs(d)) AS m, count(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT a.rec, a.second, round(a.m, 4) AS c1, round(b.m, 4) AS c2, round(c.m, 4) AS c3 FROM s a JOIN s b ON a.rec = b.rec AND a.second = b.second AND b.level = 2 JOIN s c ON a.rec = c.rec AND a.second = c.second AND c.level = 3 WHERE a.level = 1 AND a.n = 4 AND b.n = 2 AND c.n = 1""")
def w15(spark, d):
    return rounded(E.second_coefficients(recordings(spark, d), K, "value", "idx"))


@query("a3_coefficient_features", f"""WITH {REC}, {HAAR} SELECT rec, k // 4 AS epoch, round(max(d), 4) AS detail_max, round(avg(d), 4) AS detail_mean, round(stddev_samp(d), 4) AS detail_std, round(median(d), 4) AS detail_median, count(*) FILTER (d > 0) AS detail_above FROM c WHERE level = 1 GROUP BY 1, 2""")
def a3(spark, d):
    c = E.haar_details(recordings(spark, d), K, "value", "idx", 1).withColumn("epoch", F.floor(F.col("k") / 4))
    return rounded(E.coefficient_features(c, K, ["detail"]))


SVM = """m AS (SELECT vec_id AS sv_id, CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS coef, list_transform(embedding, lambda x: x::DOUBLE) AS sv FROM embeddings WHERE vec_id < 20),
s AS (SELECT e.vec_id, sum(coef * exp(-0.02 * list_distance(sv, list_transform(embedding, lambda x: x::DOUBLE)) ** 2)) + 0.01 AS decision FROM embeddings e, m GROUP BY 1)"""


def _svm(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    model = e.where("vec_id < 20").select(F.col("vec_id").alias("sv_id"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("coef"), F.col("x").alias("sv"))
    return E.svm_scores(e, model, ["vec_id"], "x", 0.02, 0.01)


@query("a25_svm_scores", f"WITH {SVM} SELECT vec_id, round(decision, 4) AS decision, CAST(sign(decision) AS INTEGER) AS label FROM s")
def a25(spark, d):
    return rounded(_svm(spark, d))


@query("a26_one_vs_one", f"WITH {REC} SELECT rec, idx, CASE WHEN value > 20 AND value > 40 THEN -1 WHEN value <= 20 AND value < 60 THEN 0 WHEN value <= 40 AND value >= 60 THEN 1 ELSE -1 END AS label FROM rec")
def a26(spark, d):
    v = F.col("value")
    return recordings(spark, d).select("rec", "idx", E.one_vs_one(v - 20, v - 40, 60 - v).alias("label"))


@query("a27_activity", f"WITH {REC}, t AS (SELECT rec, CAST(floor(time) AS BIGINT) AS tick FROM rec), s AS (SELECT rec, tick // 86400 AS m, tick - lag(tick) OVER (PARTITION BY rec, tick // 86400 ORDER BY tick) AS g FROM t), p AS (SELECT rec, m, count(*) AS n, avg(g) AS g FROM s GROUP BY 1, 2) SELECT rec, sum(n)::BIGINT AS steps, round(avg(g), 4) AS gap FROM p GROUP BY 1")
def a27(spark, d):
    steps = recordings(spark, d).select("rec", F.floor("time").alias("tick"))
    return rounded(E.step_statistics(steps, K, minute=86_400))


@query("a27_down_aggregation", f"WITH {REC} SELECT rec, idx // 6 AS block, round(sum(value), 4) AS sum, round(avg(value), 4) AS mean, round(max(value), 4) AS max, round(count(*) FILTER (value <> 0) / count(value), 4) AS share FROM rec GROUP BY 1, 2")
def a27b(spark, d):
    return rounded(E.down_aggregate(recordings(spark, d), K, "value", 6, "idx"))


@query("p4_binarise", f"WITH {REC} SELECT rec, idx, CASE WHEN value <= 2.6 THEN 0 ELSE 1 END AS label FROM rec")
def p4(spark, d):
    from ..operators.evaluation import binarise

    return recordings(spark, d).select("rec", "idx", binarise(F.col("value")).alias("label"))


@query("x2_decibels", "SELECT event_id, round(10 * log10(value), 4) AS power_db, round(20 * log10(value), 4) AS magnitude_db, round(pow(10, value / 1000), 4) AS power, round(pow(10, value / 2000), 4) AS magnitude, CAST(ceil(round(log2(value), 12)) AS INTEGER) AS exponent FROM events")
def x2(spark, d):
    v = F.col("value")
    return rounded(table(spark, d, "events").select("event_id", C.power_to_db(v).alias("power_db"), C.magnitude_to_db(v).alias("magnitude_db"), C.db_to_power(v / 100).alias("power"), C.db_to_magnitude(v / 100).alias("magnitude"), C.next_power_of_two(v).alias("exponent")))


@query("x3_tapered_power", f"""WITH {REC}, c AS (SELECT rec, idx, value, count(*) OVER (PARTITION BY rec) AS n FROM rec), w AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * idx / (n - 1)) AS hann, 0.54 - 0.46 * cos(2 * pi() * idx / (n - 1)) AS hamming FROM c)
SELECT rec, round(sum(value * value * hann * hann), 2) AS hann_power, round(sum(value * value * hamming * hamming), 2) AS hamming_power, round(max(n) * sum(hann * hann) / (sum(hann) ** 2), 4) AS bandwidth FROM w GROUP BY 1""")
def x3(spark, d):
    r = recordings(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("rec")))
    hann, hamming, v = C.taper("hann", F.col("idx"), F.col("n")), C.taper("hamming", F.col("idx"), F.col("n")), F.col("value")
    r = r.withColumns({"hann": hann, "hamming": hamming})
    return r.groupBy("rec").agg(
        F.round(F.sum(v * v * F.col("hann") * F.col("hann")), 2).alias("hann_power"), F.round(F.sum(v * v * F.col("hamming") * F.col("hamming")), 2).alias("hamming_power"),
        F.round(F.max("n") * F.sum(F.col("hann") * F.col("hann")) / (F.sum("hann") * F.sum("hann")) + float(NUDGE), 4).alias("bandwidth"),
    )


@query("x4_one_sided", "SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS a, round(2 * embedding[2]::DOUBLE, 4) AS b, round(2 * embedding[32]::DOUBLE, 4) AS c, round(embedding[64]::DOUBLE, 4) AS d, 33 AS n FROM embeddings")
def x4(spark, d):
    one = C.one_sided(F.col("embedding").cast("array<double>"))
    return rounded(table(spark, d, "embeddings").select("vec_id", one[0].alias("a"), one[1].alias("b"), one[31].alias("c"), one[32].alias("d"), F.size(one).alias("n")))


@query("x6_nearest_multiple", f"WITH {REC} SELECT rec, idx, round_even(value / 5, 0) * 5 AS v FROM rec")
def x6(spark, d):
    return recordings(spark, d).select("rec", "idx", C.nearest_multiple(F.col("value"), 5.0).alias("v"))


