"""What the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: ``spread_join`` sends a key to all tasks if it has more than one row in so many, or more than so many rows.
HOT_PART, HOT_ROWS = 10_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, which ``spark.checkpoint.dir`` names.

    A session without that setting gets a temporary one only if its executors are threads of this machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's shared checkpoint folder and reads it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins rows to a lookup with unique keys and a column n: how many rows a key may have.

    Keys with many rows would each fill one task of a shuffle join.  As many as ``HOT_PART`` of them at most can have
    more than that part of all rows, so that part of the lookup is broadcast; the others are joined by shuffle.
    """
    least = max(HOT_ROWS, rows.count() // HOT_PART)
    hot = lookup.where(F.col("n") > least)
    if hot.isEmpty():
        return rows.join(lookup, on, how)
    keys = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(lookup.where(F.col("n") <= least), on, how))
