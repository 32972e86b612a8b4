"""Views of the driver's tables as the library's inputs, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``error`` events play the placeholder trigger, ``view`` the rest phase.
BLANK, REST = "_", "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, idx, us (microseconds), time (seconds from the start), value, trigger, phase, day."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("rec")
    return (
        e.select(F.col("user_id").alias("rec"), us.alias("us"), "event_id", "value", F.col("event_type").alias("phase"), F.to_date("ts").alias("day"))
        .withColumn("idx", (F.row_number().over(w.orderBy("us", "event_id")) - 1).cast("long"))
        .withColumn("time", (F.col("us") - F.min("us").over(w)) / 1e6)
        .withColumn("trigger", F.when(F.col("phase") == "error", BLANK).otherwise(F.col("phase")))
        .drop("event_id")
    )


REC = """rec AS (SELECT user_id AS rec, epoch_us(ts) AS us, value, event_type AS phase, ts::DATE AS day,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS time,
    CASE WHEN event_type = 'error' THEN '_' ELSE event_type END AS trigger FROM events)"""


def intervals(rec: DataFrame) -> DataFrame:
    """Every tenth row of a recording opens an interval that ends at the fifth row after it: rec, slalom, start, end."""
    w = Window.partitionBy("rec").orderBy("idx")
    return rec.withColumn("end", F.lead("time", 5).over(w)).where("idx % 10 = 0 AND end IS NOT NULL").select("rec", (F.col("idx") / 10).cast("int").alias("slalom"), F.col("time").alias("start"), "end")


IVL = """ivl AS (SELECT rec, CAST(idx // 10 AS INTEGER) AS slalom, time AS start, "end" FROM (SELECT *, lead(time, 5) OVER (PARTITION BY rec ORDER BY idx) AS "end" FROM rec)
    WHERE idx % 10 = 0 AND "end" IS NOT NULL)"""


def beats(rec: DataFrame) -> DataFrame:
    return rec.select("rec", F.col("idx").alias("beat"), (F.col("us") / 1000).alias("beat_ms"))


NN = """nn AS (SELECT rec, idx AS beat, us / 1000.0 - lag(us / 1000.0) OVER (PARTITION BY rec ORDER BY idx) AS nn FROM rec QUALIFY nn IS NOT NULL)"""


def statistics_sql(c: str) -> str:
    p = ", ".join(f"round(quantile_cont({c}, {q}), 4) AS {n}" for q, n in ((0.05, "n5"), (0.25, "n25"), (0.5, "n50"), (0.75, "n75"), (0.95, "n95"), (0.5, "median")))
    return f"{p}, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(min({c}), 4) AS min, round(stddev_pop({c}), 4) AS std, round(sqrt(avg({c} * {c})), 4) AS rms, round(avg(abs({c})), 4) AS mean_abs"


#: Added before rounding, so that exact halves (means of values with two decimals) go the same way in every engine.
NUDGE = "1.23e-8"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    def cut(c):
        # Above 2 ** 53 units SQL's multiplication and division by the power of ten may still move the last bit.
        x, unit = F.col(c) + float(NUDGE), 10.0**digits
        return F.when((F.abs(x) >= 2.0**53 / unit) & (F.abs(x) < 1e300), x * unit / unit).otherwise(F.round(x, digits))

    return df.select(*(cut(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def registrar(into: dict):
    """Decorator that registers a query with its SQL; SQL rounds to four digits as ``rounded`` does."""

    def query(name, sql=None):
        def add(f):
            into[name] = (f, sql and sql.replace(", 4)", f" + {NUDGE}, 4) + 0.0"))
            return f

        return add

    return query


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load of cells (parts) at sites (suppliers) by ship day."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("site"), (F.col("l_partkey") % 3).alias("sector"), F.to_date("l_shipdate").alias("day"),
        F.col("l_extendedprice").alias("traffic"), (F.col("l_quantity") * 2).alias("code"), (F.col("l_discount") * 1000).alias("power"), (F.col("l_tax") * 1000).alias("occupation"),
        F.when(F.col("l_returnflag") == "A", "3G").when(F.col("l_returnflag") == "N", "4G").otherwise("2G").alias("tech"),
    )


KPI = """kpi AS (SELECT l_partkey AS cell, l_suppkey AS site, l_partkey % 3 AS sector, l_shipdate::DATE AS day, l_extendedprice AS traffic, l_quantity * 2 AS code, l_discount * 1000 AS power,
    l_tax * 1000 AS occupation, CASE l_returnflag WHEN 'A' THEN '3G' WHEN 'N' THEN '4G' ELSE '2G' END AS tech, CAST(strftime(l_shipdate, '%Y%W') AS INTEGER) AS week_period FROM lineitem)"""

BAND_NAMES = ("LTE18005M", "LTE210010M", "LTE21005M", "LTE90010M", "UMTS_F1", "UMTS_F2", "UMTS_U1", "UMTS_F3", "LTE9005M", "UMTS_U2")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, band, band_width."""
    names = F.array(*(F.lit(b) for b in BAND_NAMES))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.element_at(names, (F.pmod(F.col("p_size"), F.lit(len(BAND_NAMES))) + 1).cast("int")).alias("band"), F.concat((F.col("p_size") % 4 * 5 + 5).cast("string"), F.lit(" MHz")).alias("band_width"))


CAT = f"""cat AS (SELECT p_partkey AS cell, ([{", ".join(repr(b) for b in BAND_NAMES)}])[p_size % {len(BAND_NAMES)} + 1] AS band, CAST(p_size % 4 * 5 + 5 AS VARCHAR) || ' MHz' AS band_width FROM part)"""
