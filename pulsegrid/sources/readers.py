"""Readers and writers of recordings, wearables, logs, intervals and network tables.

All readers take a fixed schema and are lazy; file names come from Spark's own ``_metadata`` column, so inputs may lie in
any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import write_parquet_files

# Columns of the two campaigns, in file order.
CAMPAIGNS = {
    1: ["time", "x1", "y1", "z1", "x2", "y2", "z2", "ecg", "ppg", "rsp", "eda", "skt1", "egg1", "score", "trigger"],
    2: ["time", "x1", "y1", "z1", "x2", "y2", "z2", "x3", "y3", "z3", "rsp", "ppg", "ecg", "skt1_b", "skt2_b", "eda", "score", "trigger"],
}
#: Anchored at both ends: tried from every character of a long path, it took most of the time of reading small files.
PATH = r"^(?:.*[/\\])?([^/\\]+)[/\\]([^/\\]+)[/\\][^/\\]+$"


def _keys(path: Column, pattern: str = PATH) -> dict[str, Column]:
    return {"subject": F.regexp_extract(path, pattern, 1), "condition": F.regexp_extract(path, pattern, 2)}


def _place() -> Column:
    """Place of a row in its file, also where Spark cuts the file: the cut's start, then the order of reading."""
    return F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def read_recordings(spark: SparkSession, path: str, campaign: int = 1, sep: str = " ", extra: Sequence[str] = (), drop_first: bool = False) -> DataFrame:
    """subject, condition (from .../subject/condition/file), idx and the campaign's columns.

    extra: names of additional last columns of late files, read and dropped.  drop_first leaves out each file's first
    data row.  Values that are no numbers become null; an empty file gives no rows.  Rows are numbered by time, then by
    their place in the file.
    """
    names = CAMPAIGNS[campaign]
    schema = ", ".join(f"`{n}` {'string' if n == 'trigger' else 'double'}" for n in [*names, *extra])
    raw = spark.read.csv(path, sep=sep, header=True, schema=schema, recursiveFileLookup=True, enforceSchema=True)
    raw = raw.select(*names, F.col("_metadata.file_path").alias("__file"), _place().alias("__at"))
    w = Window.partitionBy("__file").orderBy(F.col("time").asc_nulls_first(), "__at")
    rows = raw.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    if drop_first:
        rows = rows.where("idx > 0").withColumn("idx", F.col("idx") - 1)
    return rows.withColumns(_keys(F.col("__file"))).select("subject", "condition", "idx", *names)


def read_log(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Vehicle log: subject, condition, time, trigger, score."""
    raw = spark.read.csv(path, sep=sep, header=True, schema="time double, Event string, Score double", recursiveFileLookup=True)
    return raw.withColumns(_keys(F.col("_metadata.file_path"))).select("subject", "condition", "time", F.col("Event").alias("trigger"), F.col("Score").alias("score"))


def select_files(spark: SparkSession, path: str, starts: str = "", ends: str = "", contains: str = "") -> DataFrame:
    """path, name and length of files below ``path`` by prefix, suffix and substring of their names; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(F.col("name").startswith(starts) & F.col("name").endswith(ends) & F.col("name").contains(contains))


def write_store(df: DataFrame, path: str, mode: str = "errorifexists", folders: bool = True) -> None:
    """Parquet by condition and subject, so that reading one recording prunes to its folder.

    ``folders=False`` keeps many recordings in a file, sorted by subject: their number costs no files, and reading one prunes to
    the row groups whose subjects enclose it.
    """
    if folders:
        write_parquet_files(df, path, ["condition", "subject"], ["idx"], mode)
    else:
        df.repartitionByRange("condition", "subject").sortWithinPartitions("condition", "subject", "idx").write.mode(mode).partitionBy("condition").parquet(path)


def read_store(spark: SparkSession, path: str, subject: str, condition: str, slalom: int | None = None) -> DataFrame:
    """One recording (or slalom) of a store of either form; a missing key is an error."""
    own, columns = F.lit(True), spark.read.parquet(path)
    for name, wanted in (("subject", subject), ("condition", condition)):
        own = own & ((F.col(name) if dict(columns.dtypes)[name] == "string" else F.col(name).cast("string")) == wanted)
    rows = columns.where(own)
    if slalom is not None:
        rows = rows.where(F.col("slalom") == slalom)
    if rows.isEmpty():
        raise KeyError((subject, condition, slalom))
    return rows


def read_intervals(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """subject, condition, slalom, start, end."""
    return spark.read.csv(path, sep=sep, header=True, schema="subject string, condition string, slalom int, start double, end double")


def read_wearable(spark: SparkSession, paths: dict[str, str], rates: dict[str, int] | None = None) -> DataFrame:
    """Wearable files of one kind each (eda, temp, acc): rec, tick, eda, temp, accel_x, accel_y, accel_z at 8 Hz.

    The first line of a file holds the start in epoch seconds, the second the rate; acceleration counts 64 to 1 g.  rec is
    the folder's name.  Streams meet on the tick of 125 ms, are cut to the shortest, and keep gaps as nulls.
    """
    streams, last = None, None
    for kind, path in paths.items():
        lines = spark.read.text(path, recursiveFileLookup=True).select(F.regexp_extract("_metadata.file_path", r"^(?:.*/)?([^/]+)/[^/]+$", 1).alias("rec"), _place().alias("__at"), F.split("value", ",").alias("__v"))
        at = F.row_number().over(Window.partitionBy("rec").orderBy("__at")) - 1
        numbered = lines.withColumn("__n", at)
        head = numbered.where("__n < 2").groupBy("rec").agg(F.max(F.when(F.col("__n") == 0, F.col("__v")[0].try_cast("double"))).alias("__start"), F.max(F.when(F.col("__n") == 1, F.col("__v")[0].try_cast("double"))).alias("__rate"))
        body = numbered.where("__n >= 2").join(head, "rec").withColumn("__tick", F.col("__start") * 8 + (F.col("__n") - 2) * 8 / F.col("__rate"))
        body = body.where(F.col("__tick") == F.floor("__tick")).withColumn("tick", F.col("__tick").cast("long"))
        values = [F.try_element_at("__v", F.lit(i + 1)).try_cast("double") for i in range(3 if kind == "acc" else 1)]
        columns = [(v / 64).alias(f"accel_{a}") for v, a in zip(values, "xyz", strict=True)] if kind == "acc" else [values[0].alias(kind)]
        own = body.select("rec", "tick", *columns)
        end = own.groupBy("rec").agg(F.max("tick").alias(f"__end_{kind}"))
        streams = own if streams is None else streams.join(own, ["rec", "tick"], "full")
        last = end if last is None else last.join(end, "rec")
    ends = [F.col(f"__end_{k}") for k in paths]
    shortest = F.least(*ends) if len(ends) > 1 else ends[0]
    first = Window.partitionBy("rec")
    cut = streams.join(last, "rec").where(F.col("tick") <= shortest).drop(*(f"__end_{k}" for k in paths))
    return cut.withColumn("tick", F.col("tick") - F.min("tick").over(first))


def _holding(column: str, part: str) -> Column:
    return F.transform(column, lambda h: h.contains(part))


def read_mapped(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",", skip: int = 0, units_row: str | None = "ms") -> DataFrame:
    """Sensor exports: rec (the file's name), tick and the columns of ``columns`` (new name -> substring of the header's name).

    skip: lines before the header.  A row whose first cell is ``units_row`` goes.  Cells that are no numbers become null;
    a column without match is null, but ``temp`` is 0.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("__file"), _place().alias("__at"), F.split("value", sep).alias("__v"))
    numbered = lines.withColumn("__n", F.row_number().over(Window.partitionBy("__file").orderBy("__at")) - 1)
    header = numbered.where(F.col("__n") == skip).select("__file", F.col("__v").alias("__header"))
    body = numbered.where(F.col("__n") > skip).join(header, "__file")
    if units_row is not None:
        body = body.where(F.trim(F.col("__v")[0]) != units_row)
    picked = {}
    for name, part in columns.items():
        place = F.array_position(_holding("__header", part), True)
        value = F.when(place > 0, F.try_element_at("__v", F.when(place > 0, place).otherwise(1).cast("int")).try_cast("double"))
        picked[name] = F.when(place == 0, 0.0).otherwise(value) if name == "temp" else value
    tick = F.row_number().over(Window.partitionBy("__file").orderBy("__n")) - 1
    return body.withColumns({"tick": tick.cast("long"), "rec": F.regexp_extract("__file", r"^(?:.*/)?([^/]+)$", 1)}).select("rec", "tick", *(c.alias(n) for n, c in picked.items()))


def read_kpi(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Network tables, comma- or pipe-separated, with a header."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep=sep, header=True)


def export_results(df: DataFrame, path: str) -> None:
    """Result rows as JSON with sorted fields; null and NaN are written as 'n/a'.  Never overwrites."""
    kinds = dict(df.dtypes)
    columns = [F.coalesce(F.when(~F.isnan(c), F.col(c).cast("string")) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in sorted(df.columns)]
    df.select(*columns).write.mode("errorifexists").json(path)


def import_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results written by ``export_results``, with types again; 'n/a' is null."""
    typed = spark.createDataFrame([], schema).schema
    text = spark.read.json(path, schema=", ".join(f"`{f.name}` string" for f in typed))
    return text.select(*(F.when(F.col(f.name) != "n/a", F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in typed))
