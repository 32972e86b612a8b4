"""Queries on network load (surrogates from lineitem, part, supplier), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import capacity as N
from .tables import CAT, KPI, catalogue, kpi, registrar, rounded, table

Q: dict = {}
query = registrar(Q)


def weekly_kpi(spark, d):
    return kpi(spark, d).withColumn("week_period", C.week_period(F.col("day")))


@query("p5_sentinel_filter", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN NULL ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'F'")
def p5(spark, d):
    s = F.col("o_orderstatus")
    o = table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "NIL").when(s == "O", "x").otherwise(F.col("o_totalprice").cast("string")).alias("v"))
    return N.without_sentinel(o, "v")


@query("p6_busy_hour_load", f"WITH {KPI} SELECT cell, CAST(day AS VARCHAR) AS day, tech, round(occupation * CASE tech WHEN '3G' THEN 0.8 WHEN '4G' THEN 1.2 END, 4) AS load FROM kpi")
def p6(spark, d):
    return rounded(N.busy_hour_load(kpi(spark, d), {"3G": 0.8, "4G": 1.2}).select("cell", F.col("day").cast("string").alias("day"), "tech", "load"))


@query("p7_site_congestion", f"WITH {KPI} SELECT cell, site, tech, count(*) AS n FROM kpi WHERE (tech = '3G' AND (code > 85 OR power > 85)) OR (tech = '4G' AND occupation > 75) GROUP BY 1, 2, 3")
def p7(spark, d):
    k = N.site_congestion(kpi(spark, d).withColumn("load", F.col("occupation") + 10))
    return k.where("congested").groupBy("cell", "site", "tech").agg(F.count("*").alias("n"))


@query("p7_cell_congestion", f"""WITH {KPI}, {CAT}, j AS (SELECT kpi.cell, kpi.code, CASE WHEN sector = 0 THEN '20 MHz' ELSE band_width END AS bw FROM kpi JOIN cat USING (cell)), n AS (SELECT cell, bw, count(*) AS n FROM j GROUP BY 1, 2),
m AS (SELECT cell, bw FROM n QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, bw) = 1)
SELECT j.cell, CAST(regexp_extract(m.bw, '^\\d+') AS DOUBLE) AS bw, count(*) FILTER (code / (CAST(regexp_extract(m.bw, '^\\d+') AS DOUBLE) * 5) > 0.85) AS n FROM j JOIN m USING (cell) GROUP BY 1, 2""")
def p7b(spark, d):
    k = kpi(spark, d).join(catalogue(spark, d), "cell").withColumn("band_width", F.when(F.col("sector") == 0, "20 MHz").otherwise(F.col("band_width")))
    return N.cell_congestion(k, used="code").groupBy("cell", "bw").agg(F.count_if("congested").alias("n"))


@query("p8_cell_technology", f"WITH {CAT} SELECT cell, CASE WHEN band LIKE 'UMTS%' THEN '3G' WHEN band LIKE 'LTE%' THEN '4G' WHEN band LIKE 'GSM%' THEN '2G' END AS tech, concat_ws('_', CASE WHEN band LIKE '%LTE%' THEN '4G' END, CASE WHEN band LIKE '%UMTS%' THEN '3G' END, CASE WHEN band LIKE '%GSM%' THEN '2G' END) AS techs FROM cat")
def p8(spark, d):
    return catalogue(spark, d).select("cell", C.cell_technology(F.col("band")).alias("tech"), C.technologies_of_bands(F.col("band")).alias("techs"))


@query("a15_weekly_kpi", f"WITH {KPI} SELECT cell, week_period, round(avg(traffic), 4) AS traffic, round(avg(code), 4) AS code FROM kpi GROUP BY 1, 2")
def a15(spark, d):
    return rounded(N.weekly(kpi(spark, d), ["cell"], ["traffic", "code"]))


@query("a16_site_features", f"WITH {KPI} SELECT week_period, site, tech, max(occupation) AS load, max(code) AS code, max(power) AS power FROM kpi GROUP BY 1, 2, 3")
def a16(spark, d):
    return N.site_features(weekly_kpi(spark, d).withColumnRenamed("occupation", "load"))


SITE_BANDS = "sb AS (SELECT site, upper(string_agg(DISTINCT band, '_' ORDER BY band)) AS bands FROM kpi JOIN cat USING (cell) GROUP BY 1)"


def site_bands(spark, d):
    return N.bands_per_site(kpi(spark, d).select("cell", "site").join(catalogue(spark, d), "cell"))


@query("a17_bands_per_site", f"WITH {KPI}, {CAT}, {SITE_BANDS} SELECT site, bands FROM sb")
def a17(spark, d):
    return site_bands(spark, d)


FLAGS = """f AS (SELECT site, week_period, CASE WHEN coalesce(max(code) FILTER (tech = '3G') < 90, false) AND coalesce(max(power) FILTER (tech = '3G') < 90, false) THEN 1 ELSE 0 END AS refarming_3g,
    CASE WHEN coalesce(max(occupation) FILTER (tech = '2G') < 2, false) THEN 1 ELSE 0 END AS refarming_2g FROM kpi GROUP BY 1, 2)"""


def flags(spark, d):
    return N.refarming_flags(N.site_features(weekly_kpi(spark, d).withColumnRenamed("occupation", "load")))


@query("a18_refarming_flags", f"WITH {KPI}, {FLAGS} SELECT * FROM f")
def a18(spark, d):
    return flags(spark, d)


@query("a19_slope", f"WITH {KPI} SELECT cell, round(sum(traffic * code) / nullif(sum(traffic * traffic), 0) * 1000, 4) AS slope FROM kpi GROUP BY 1")
def a19(spark, d):
    return rounded(N.slope_through_origin(kpi(spark, d), ["cell"], "traffic", "code").withColumn("slope", F.col("slope") * 1000))


DEMAND = """dm AS (SELECT site, sector, week_period, tech, sum(CASE tech WHEN '4G' THEN occupation / 5 WHEN '3G' THEN greatest(round_even((power - 85) / 85, 0), round_even((code - 85) / 85, 0)) END) AS demand FROM kpi GROUP BY ALL)"""


def demand(spark, d):
    return N.sector_demand(weekly_kpi(spark, d).withColumnRenamed("occupation", "prb"))


@query("a20_sector_demand", f"WITH {KPI}, {DEMAND} SELECT site, sector, week_period, tech, round(demand, 4) AS demand FROM dm")
def a20(spark, d):
    return rounded(demand(spark, d))


@query("w17_top_sector", f"WITH {KPI}, {DEMAND}, r AS (SELECT * REPLACE (round(demand, 4) AS demand) FROM dm) SELECT site, sector, week_period, tech, demand FROM r QUALIFY row_number() OVER (PARTITION BY site, week_period, tech ORDER BY demand DESC NULLS LAST, sector) = 1")
def w17(spark, d):
    return N.top_sector(rounded(demand(spark, d)))


@query("w17_first_congested_week", f"WITH {KPI} SELECT site, min(week_period) AS week_period FROM kpi WHERE tech = '3G' AND (code > 85 OR power > 85) AND week_period < 200100 GROUP BY 1")
def w17b(spark, d):
    k = N.site_congestion(weekly_kpi(spark, d).withColumn("load", F.col("occupation"))).where("congested AND tech = '3G'")
    return N.first_week(k.select("site", "week_period"), before=200100)


@query("a21_distinct_pairs", f"WITH {KPI} SELECT DISTINCT site, tech FROM kpi")
def a21(spark, d):
    return kpi(spark, d).select("site", "tech").dropDuplicates()


@query("j13_catalogue_join", f"WITH {KPI}, {CAT}, s AS (SELECT DISTINCT site, cell, 'S' || (cell % 3) AS sector_name FROM kpi WHERE cell % 5 <> 0) SELECT k.cell, k.site, k.week_period, band, sector_name, round(sum(traffic), 2) AS traffic FROM kpi k LEFT JOIN cat ON k.cell = cat.cell AND cat.cell % 2 = 0 LEFT JOIN s ON k.site = s.site AND k.cell = s.cell GROUP BY 1, 2, 3, 4, 5")
def j13(spark, d):
    k = weekly_kpi(spark, d)
    sectors = k.where("cell % 5 <> 0").select("site", "cell", F.concat(F.lit("S"), (F.col("cell") % 3).cast("string")).alias("sector_name"))
    out = N.with_catalogue(k.select("cell", "site", "week_period", "traffic"), sectors, catalogue(spark, d).where("cell % 2 = 0").select("cell", "band"))
    return out.groupBy("cell", "site", "week_period", "band", "sector_name").agg(F.round(F.sum("traffic"), 2).alias("traffic"))


@query("j14_congestion_with_flags", f"WITH {KPI}, {FLAGS} SELECT k.site, k.week_period, tech, refarming_3g, refarming_2g, count(*) AS n FROM kpi k JOIN f USING (site, week_period) WHERE code > 95 GROUP BY 1, 2, 3, 4, 5")
def j14(spark, d):
    k = weekly_kpi(spark, d).where("code > 95").groupBy("site", "week_period", "tech").agg(F.count("*").alias("n"))
    return k.join(flags(spark, d), ["site", "week_period"]).select("site", "week_period", "tech", "refarming_3g", "refarming_2g", "n")


@query("j15_cells_seen", f"WITH {KPI}, {CAT} SELECT cell, band FROM cat WHERE cell IN (SELECT cell FROM kpi)")
def j15(spark, d):
    return catalogue(spark, d).dropna(subset=["band"]).join(kpi(spark, d), "cell", "left_semi").select("cell", "band")


@query("w16_traffic_growth", f"""WITH {KPI}, w AS (SELECT cell, week_period, avg(traffic) AS traffic, max(code) AS busy_hour FROM kpi GROUP BY 1, 2), h AS (SELECT * FROM w WHERE week_period < 200100), l AS (SELECT cell, arg_max(traffic, week_period) AS t, arg_max(busy_hour, week_period) AS b FROM h GROUP BY 1)
SELECT cell, week_period, round(traffic, 4) AS traffic, round(traffic / lag(traffic) OVER (PARTITION BY cell ORDER BY week_period), 4) AS growth, round(busy_hour, 4) AS busy_hour, true AS observed FROM h
UNION ALL SELECT w.cell, week_period, round(traffic, 4), round(traffic / t, 4), round(traffic / t * b, 4), false FROM w JOIN l USING (cell) WHERE week_period >= 200100""")
def w16(spark, d):
    w = weekly_kpi(spark, d).groupBy("cell", "week_period").agg(F.avg("traffic").alias("traffic"), F.max("code").alias("busy_hour"))
    return rounded(N.traffic_growth(w.where("week_period < 200100"), w.where("week_period >= 200100"), ["cell"]))


@query("x1_bands_of_technology", f"""WITH {KPI}, {CAT}, {SITE_BANDS}, u AS (SELECT site, unnest(string_split(bands, '_')) AS b FROM sb),
a AS (SELECT site, string_agg(c, '_' ORDER BY c) AS bands_3g FROM u, (VALUES ('F1'), ('F2'), ('F3'), ('U1'), ('U2')) t(c) WHERE contains(b, c) GROUP BY 1),
e AS (SELECT site, string_agg(c || b[-3:-2], '_' ORDER BY c || b[-3:-2]) AS bands_4g FROM u, (VALUES ('LTE1800'), ('LTE2100'), ('LTE900')) t(c) WHERE contains(b, c) GROUP BY 1)
SELECT site, coalesce(bands_3g, '') AS bands_3g, coalesce(bands_4g, '') AS bands_4g FROM sb LEFT JOIN a USING (site) LEFT JOIN e USING (site)""")
def x1(spark, d):
    return site_bands(spark, d).select("site", C.bands_of_technology(F.col("bands"), F.lit("3G")).alias("bands_3g"), C.bands_of_technology(F.col("bands"), F.lit("4G")).alias("bands_4g"))


CHOICE = """c AS (SELECT *, coalesce((SELECT string_agg(x, '_' ORDER BY x) FROM unnest(['F1', 'F2', 'F3', 'U1', 'U2']) t(x) WHERE contains(bands, x)), '') AS car,
  contains(bands, 'LTE21005M') AS a, contains(bands, 'LTE210010M') AS b, contains(bands, 'LTE9005M') AS e, contains(bands, 'LTE1800') AS l18, contains(bands, 'LTE2100') AS l21, contains(bands, 'LTE900') AS l9,
  CASE WHEN r2 = 1 THEN 'U900' ELSE 'New_Site' END AS u FROM s),
g AS (SELECT *, CASE WHEN l18 AND l9 AND NOT l21 THEN CASE WHEN r3 = 1 THEN '5M_LTE2100' ELSE '2600TDD/New_Site' END
   WHEN l18 AND NOT l9 AND (NOT l21 OR a) THEN CASE WHEN r3 = 1 OR r2 = 1 THEN '5M_LTE2100' ELSE '2600TDD/New_Site' END ELSE '' END AS four FROM c),
o AS (SELECT *, CASE WHEN l18 AND l21 AND l9 AND b THEN '2600TDD/New_Site' WHEN l18 AND l21 AND l9 AND a THEN CASE WHEN r3 = 1 THEN '5M_LTE2100' ELSE '2600TDD/New_Site' END
   WHEN l18 AND l21 AND NOT l9 AND b THEN four || CASE WHEN r2 = 1 THEN '5M_LTE900' ELSE '2600TDD/New_Site' END ELSE four END AS out4,
  CASE car WHEN 'F1_F2' THEN CASE WHEN a THEN u ELSE 'F3' END WHEN 'F1_F2_F3' THEN u WHEN 'F1_F2_F3_U1' THEN CASE WHEN e THEN 'New_Site' ELSE u END
   WHEN 'F1_F2_U1' THEN CASE WHEN NOT a THEN 'F3' WHEN e THEN 'New_Site' ELSE u END WHEN 'F1_F2_U1_U2' THEN CASE WHEN a THEN 'New_Site' ELSE 'F3' END
   WHEN 'F1_U1' THEN CASE WHEN NOT b THEN 'F2' WHEN e THEN 'New_Site' ELSE u END WHEN 'F1_F2_F3_U1_U2' THEN 'New_Site' WHEN 'U1' THEN 'U1'
   WHEN 'F1' THEN CASE WHEN b THEN u ELSE 'F2' END WHEN 'F1_U1_U2' THEN CASE WHEN b THEN 'New_Site' ELSE 'F2' END WHEN 'F1_F3_U1' THEN NULL ELSE '' END AS out3 FROM g)"""

MIX = f"""m AS (SELECT l_orderkey AS k, string_agg(DISTINCT band, '_' ORDER BY band) AS bands, max(CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS r2, max(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS r3 FROM lineitem JOIN cat ON l_partkey = cell GROUP BY 1)"""


@query("p9_band_choice", f"WITH {CAT}, {MIX}, s AS (SELECT * FROM m), {CHOICE} SELECT k, '3G' AS tech, out3 AS choice FROM o UNION ALL SELECT k, '4G', out4 FROM o")
def p9(spark, d):
    li = table(spark, d, "lineitem").join(catalogue(spark, d), F.col("l_partkey") == F.col("cell"))
    s = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_join(F.array_sort(F.collect_set("band")), "_").alias("bands"), F.max((F.col("l_tax") > 0.06).cast("int")).alias("refarming_2g"), F.max((F.col("l_discount") > 0.08).cast("int")).alias("refarming_3g")
    )
    s = s.withColumns({"bw_bands": F.col("bands"), "band_bw": F.col("bands"), "tech": F.explode(F.array(F.lit("3G"), F.lit("4G")))})
    return s.select("k", "tech", N.choose_band().alias("choice"))


@query("p11_densification", f"""WITH {KPI}, {CAT}, {SITE_BANDS}, {FLAGS}, s AS (SELECT site, week_period, bands, r2, r3, tech, demand, r3 = 1 OR r2 = 1 AS any_ FROM (SELECT k.site, k.week_period, tech, sum(occupation) / 50 AS demand FROM kpi k GROUP BY ALL) JOIN sb USING (site)
  JOIN (SELECT site, week_period, refarming_2g AS r2, refarming_3g AS r3 FROM f) USING (site, week_period)), {CHOICE},
p AS (SELECT *, CASE WHEN l18 AND l21 AND NOT l9 THEN CASE WHEN any_ THEN '5M_LTE2100' END WHEN l18 AND NOT l21 AND NOT l9 AND a THEN CASE WHEN any_ THEN '5M_LTE2100' END WHEN l18 AND l21 AND l9 THEN CASE WHEN r3 = 1 THEN '5M_LTE2100' END ELSE '' END AS step,
  CASE WHEN tech = '4G' AND demand >= 5 THEN CAST(floor(demand / 5) AS INTEGER) ELSE 0 END AS steps FROM o)
SELECT site, week_period, tech, CASE WHEN tech = '3G' THEN coalesce(replace(out3, 'New_Site', 'new_site'), '') WHEN steps = 0 THEN '' WHEN step IS NULL THEN '_2600TDD/newsite' WHEN step = '' THEN 'NO_ACTION' ELSE repeat(step, steps) END AS upgrade,
  round(CASE WHEN tech = '4G' THEN demand - CASE WHEN step <> '' THEN 5.0 * steps ELSE 0 END END, 4) AS "left", (tech = '4G' AND steps > 0 AND step IS NULL) OR (tech = '3G' AND coalesce(out3 = 'New_Site', false)) AS new_site FROM p""")
def p11(spark, d):
    k = weekly_kpi(spark, d).groupBy("site", "week_period", "tech").agg((F.sum("occupation") / 50).alias("demand"))
    s = k.join(site_bands(spark, d), "site").join(flags(spark, d), ["site", "week_period"]).withColumns({"bw_bands": F.col("bands"), "band_bw": F.col("bands")})
    return rounded(N.densify(s).select("site", "week_period", "tech", "upgrade", "left", "new_site"))


@query("p12_later_weeks", f"WITH {KPI}, w AS (SELECT DISTINCT site, week_period FROM kpi) SELECT site, week_period FROM w WHERE week_period > (SELECT max(week_period) FROM w WHERE site < 10 AND week_period < 200120)")
def p12(spark, d):
    w = weekly_kpi(spark, d).select("site", "week_period").distinct()
    return N.weeks_after(w, w.where("site < 10 AND week_period < 200120"))


@query("c6_upgrade_selection", f"""WITH {KPI}, {CAT}, {SITE_BANDS}, {FLAGS}, con AS (SELECT DISTINCT site, week_period, tech FROM kpi WHERE (tech = '3G' AND (code > 85 OR power > 85)) OR (tech = '4G' AND occupation > 75)),
w AS (SELECT site, tech, min(week_period) AS week_period FROM con GROUP BY 1, 2), s AS (SELECT w.site, w.tech, w.week_period, bands, refarming_2g AS r2, refarming_3g AS r3 FROM w JOIN sb USING (site) JOIN f ON w.site = f.site AND w.week_period = f.week_period), {CHOICE}
SELECT site, week_period, tech, CASE tech WHEN '3G' THEN out3 ELSE out4 END AS choice FROM o""")
def c6(spark, d):
    """Weekly load to the first congested week per site and technology, with the band to add."""
    from .workloads import upgrade_selection

    k = weekly_kpi(spark, d).withColumnRenamed("occupation", "load")
    return upgrade_selection(k, catalogue(spark, d), load_limit=75.0)


PREDICTED = """w AS (SELECT cell, site, sector, tech, week_period, avg(traffic) AS traffic, max(traffic) AS busy_hour, max(code) AS code, max(power) AS power, max(occupation) AS prb FROM kpi GROUP BY ALL),
hist AS (SELECT * FROM w WHERE week_period < 200020), fut AS (SELECT * FROM w WHERE week_period >= 200020),
last AS (SELECT cell, arg_max(traffic, (week_period, site, tech)) AS t, arg_max(busy_hour, (week_period, site, tech)) AS b FROM hist GROUP BY 1),
slope AS (SELECT cell, sum(busy_hour * code) / sum(busy_hour * busy_hour) AS sc, sum(busy_hour * power) / sum(busy_hour * busy_hour) AS sp, sum(busy_hour * prb) / sum(busy_hour * busy_hour) AS sq FROM hist GROUP BY 1),
pred AS (SELECT fut.cell, site, sector, tech, week_period, traffic / t * b * sc AS code, traffic / t * b * sp AS power, traffic / t * b * sq AS prb FROM fut JOIN last USING (cell) JOIN slope USING (cell)),
con AS (SELECT pred.*, CASE WHEN tech = '3G' THEN code > 85 OR power > 85 WHEN tech = '4G' THEN prb / (CAST(regexp_extract(band_width, '^\\d+') AS DOUBLE) * 5) > 0.85 ELSE false END AS hot FROM pred LEFT JOIN cat USING (cell)),
dem AS (SELECT site, sector, week_period, tech, round(sum(CASE tech WHEN '4G' THEN prb / 5 ELSE greatest(round_even((power - 85) / 85, 0), round_even((code - 85) / 85, 0)) END), 6) AS demand FROM con WHERE hot GROUP BY ALL),
top AS (SELECT * FROM dem QUALIFY row_number() OVER (PARTITION BY site, week_period, tech ORDER BY demand DESC NULLS LAST, sector) = 1),
fst AS (SELECT * FROM top WHERE week_period < 200130 QUALIFY row_number() OVER (PARTITION BY site, tech ORDER BY week_period) = 1),
pb AS (SELECT site, upper(string_agg(DISTINCT band, '_' ORDER BY band)) AS bands, upper(string_agg(DISTINCT band_width, '_' ORDER BY band_width)) AS widths, upper(string_agg(DISTINCT band || band_width, '_' ORDER BY band || band_width)) AS band_bw FROM (SELECT DISTINCT cell, site FROM pred) JOIN cat USING (cell) GROUP BY 1),
f AS (SELECT site, week_period, CASE WHEN coalesce(max(code) FILTER (tech = '3G') < 90, false) AND coalesce(max(power) FILTER (tech = '3G') < 90, false) THEN 1 ELSE 0 END AS r3, CASE WHEN coalesce(max(prb) FILTER (tech = '2G') < 2, false) THEN 1 ELSE 0 END AS r2 FROM pred GROUP BY 1, 2),
s AS (SELECT fst.*, bands, widths, band_bw, r2, r3 FROM fst JOIN pb USING (site) JOIN f USING (site, week_period))"""
CHOICE_BY_LIST = CHOICE.replace("contains(bands, x)", "contains(widths, x)").replace("contains(bands, 'LTE21005M')", "contains(band_bw, 'LTE21005M')").replace("contains(bands, 'LTE210010M')", "contains(band_bw, 'LTE210010M')").replace("contains(bands, 'LTE9005M')", "contains(band_bw, 'LTE9005M')")


@query("c6_predicted_upgrades", f"""WITH {KPI}, {CAT}, {PREDICTED}, {CHOICE_BY_LIST}
SELECT site, sector, week_period, tech, round(demand, 4) AS demand, CASE tech WHEN '3G' THEN out3 ELSE out4 END AS choice FROM o WHERE week_period > (SELECT max(week_period) FROM hist)""")
def c6b(spark, d):
    """Weeks before 200020 are the observed ones, later ones play the forecast, upgrades are planned for week 200130."""
    from .workloads import predicted_upgrades

    k = weekly_kpi(spark, d).groupBy("cell", "site", "sector", "tech", "week_period").agg(F.avg("traffic").alias("traffic"), F.max("traffic").alias("busy_hour"), F.max("code").alias("code"), F.max("power").alias("power"), F.max("occupation").alias("prb"))
    seen, ahead = k.where("week_period < 200020"), k.where("week_period >= 200020")
    # Cells of several sites or technologies a week: the largest (site, tech) of the last week counts as the last row.
    return rounded(predicted_upgrades(seen, ahead.select("cell", "site", "sector", "tech", "week_period", "traffic"), catalogue(spark, d), before=200130))
