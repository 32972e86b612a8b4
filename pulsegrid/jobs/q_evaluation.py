"""Queries on scores and feature tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators.selection import percentiles
from .tables import REC, recordings, registrar, rounded, table

Q: dict = {}
query = registrar(Q)
SCORED = "s AS (SELECT o_orderkey AS k, o_custkey % 5 AS rep, round(o_totalprice / 1000) AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)"
ROC = """g AS (SELECT rep, score, sum(label) AS p, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT rep, score AS threshold, sum(p) OVER u AS tp, sum(n) OVER u - sum(p) OVER u AS fp, sum(p) OVER (PARTITION BY rep) AS pa, sum(n) OVER (PARTITION BY rep) AS na FROM g WINDOW u AS (PARTITION BY rep ORDER BY score DESC)),
r AS (SELECT rep, threshold, tp / pa::DOUBLE AS tpr, fp / (na - pa)::DOUBLE AS fpr FROM c)"""


def scored(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("rep"), F.round(F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@query("w18_roc_points", f"WITH {SCORED}, {ROC} SELECT rep, threshold, round(tpr, 4) AS tpr, round(fpr, 4) AS fpr FROM r")
def roc(spark, d):
    return rounded(V.roc_points(scored(spark, d), ["rep"]))


@query("w18_auc", f"WITH {SCORED}, {ROC}, a AS (SELECT rep, (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS a FROM r WINDOW w AS (PARTITION BY rep ORDER BY threshold DESC)) SELECT rep, round(sum(a), 2) AS auc FROM a GROUP BY 1")
def auc(spark, d):
    return V.auc(V.roc_points(scored(spark, d), ["rep"]), ["rep"])


@query("w19_mean_roc", f"""WITH {SCORED}, {ROC}, n AS (SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY threshold DESC) - 1 AS k, tpr, fpr FROM r), grid AS (SELECT DISTINCT rep, CAST(k AS INTEGER) AS k FROM r, unnest(range(0, 450)) t(k))
SELECT k, round(avg(coalesce(tpr, 1)), 4) AS tpr, round(avg(coalesce(fpr, 1)), 4) AS fpr FROM grid LEFT JOIN n USING (rep, k) GROUP BY 1""")
def mean_roc(spark, d):
    return rounded(V.mean_roc(V.roc_points(scored(spark, d), ["rep"]), "rep", 450))


@query("a24_evaluation_summary", "SELECT o_custkey % 7 AS g, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 2) AS std FROM orders GROUP BY 1")
def a24(spark, d):
    out = V.evaluation_summary(table(spark, d, "orders").withColumn("g", F.col("o_custkey") % 7), ["g"], "o_totalprice")
    return out.select("g", F.round(F.col("mean") + 1.23e-8, 4).alias("mean"), F.round("std", 2).alias("std"))


@query("w20_weighted_percentiles", """WITH a AS (SELECT l_suppkey AS g, l_extendedprice AS x, l_quantity AS w FROM lineitem WHERE l_quantity > 0), u AS (SELECT g, x, sum(w) AS w FROM a GROUP BY 1, 2),
p AS (SELECT g, x, 100 / sum(w) OVER (PARTITION BY g) * (sum(w) OVER (PARTITION BY g ORDER BY x) - w / 2) AS p FROM u), q AS (SELECT *, lead(x) OVER o AS x2, lead(p) OVER o AS p2, row_number() OVER o = 1 AS f FROM p WINDOW o AS (PARTITION BY g ORDER BY p, x)),
c AS (SELECT g, percent, CASE WHEN (f AND percent < p) OR p2 IS NULL THEN x ELSE x + (x2 - x) * (percent - p) / (p2 - p) END AS value FROM q, (VALUES (5.0::DOUBLE), (50.0::DOUBLE), (99.99::DOUBLE)) t(percent) WHERE (percent >= p AND (percent < p2 OR p2 IS NULL)) OR (f AND percent < p))
SELECT g, percent, round(value, 4) AS value FROM c""")
def w20(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("x")).agg(F.sum("l_quantity").alias("w"))
    return rounded(V.weighted_percentiles(li, ["g"], "x", "w", [5.0, 50.0, 99.99]))


STEPS = "st AS (SELECT l_linenumber AS tau, l_suppkey % 4 AS lam, 'f' || (l_partkey % 60) AS feature, CASE WHEN l_quantity > 48 THEN l_discount ELSE 0 END AS coef FROM lineitem)"


def steps(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_linenumber").alias("tau"), (F.col("l_suppkey") % 4).alias("lam"), F.concat(F.lit("f"), (F.col("l_partkey") % 60).cast("string")).alias("feature"), F.when(F.col("l_quantity") > 48, F.col("l_discount")).otherwise(0.0).alias("coef"))


@query("a22_t1_feature_votes", f"WITH {STEPS}, v AS (SELECT feature, count(DISTINCT tau) AS votes FROM st WHERE coef <> 0 GROUP BY 1) SELECT feature, votes FROM v ORDER BY votes DESC, feature LIMIT 30")
def a22(spark, d):
    return V.feature_votes(steps(spark, d))


@query("a23_scaled_coefficients", f"WITH {STEPS}, m AS (SELECT tau, feature, max(coef) AS coef FROM st GROUP BY 1, 2) SELECT tau, feature, coef, round((coef - min(coef) OVER (PARTITION BY feature)) / nullif(max(coef) OVER (PARTITION BY feature) - min(coef) OVER (PARTITION BY feature), 0), 4) AS scaled FROM m")
def a23(spark, d):
    return rounded(V.scaled_by_feature(steps(spark, d).groupBy("tau", "feature").agg(F.max("coef").alias("coef"))))


@query("u5_repeated_splits", """WITH r AS (SELECT o_orderkey AS k, rep, row_number() OVER (PARTITION BY rep ORDER BY md5('0/' || rep || '/' || o_orderkey), o_orderkey) AS pos, count(*) OVER (PARTITION BY rep) AS n FROM orders, unnest(range(0, 3)) t(rep))
SELECT k, CAST(rep AS INTEGER) AS rep, pos <= floor(0.75 * n) AS train FROM r""")
def u5(spark, d):
    return V.repeated_splits(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k", 3)


@query("t3_first_share", f"WITH {REC}, n AS (SELECT rec, idx, count(*) OVER (PARTITION BY rec) AS n FROM rec) SELECT rec, idx FROM n WHERE idx + 1 <= floor(n * 0.33)")
def t3(spark, d):
    return V.first_share(recordings(spark, d), "idx", keys=["rec"]).select("rec", "idx")


@query("v19_kendall_tau", f"""WITH {REC}, p AS (SELECT a.rec, sign(a.value - b.value) AS x, sign(a.time % 100 - b.time % 100) AS y FROM rec a JOIN rec b ON a.rec = b.rec AND a.idx < b.idx)
SELECT rec, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 4) AS tau FROM p GROUP BY 1""")
def v19(spark, d):
    r = recordings(spark, d).withColumn("t", F.col("time") % 100)
    return rounded(V.kendall_tau(r, ["rec"], "value", "t"))


@query("a5_percentiles_of_large_groups", """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice::DOUBLE, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 4) AS p95
FROM lineitem GROUP BY 1, 2""")
def percentiles_of_large_groups(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    out = percentiles(table(spark, d, "lineitem"), keys, F.col("l_extendedprice"), (0.05, 0.5, 0.95), large=10_000)
    return rounded(out.select(*keys, *(F.col("points")[i].alias(n) for i, n in enumerate(("p5", "p50", "p95")))))
