"""Epochs of wearable signals at 8 Hz: windows, wavelet and derivative features, artefact labels, activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epochs(df: DataFrame, keys: Sequence[str], order: str = "tick", rate: int = 8, window: int = 5, step: int = 5) -> DataFrame:
    """Adds epoch: starts every step seconds, ends included, so a tick on a border is in two.  The last epoch is left out."""
    s, n = rate * step, rate * window
    top = df.groupBy(*keys).agg(F.floor((F.max(order) + 1) / s).alias("__count"))
    first = F.greatest(F.ceil((F.col(order) - n) / s), F.lit(0))
    last = F.floor(F.col(order) / s)
    own = df.withColumn("epoch", F.explode(F.when(first <= last, F.sequence(first, last))))
    return own.join(top, list(keys)).where(F.col("epoch") < F.col("__count") - 1).drop("__count").withColumn("epoch", F.col("epoch").cast("int"))


def derivative_features(df: DataFrame, keys: Sequence[str], value: str, order: str = "tick") -> DataFrame:
    """Extremes and means of the first and second differences at interior points of each epoch."""
    w = Window.partitionBy(*keys, "epoch").orderBy(order)
    a, x, b = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    own = df.withColumns({"__d1": (b - a) / 2, "__d2": b - 2 * x + a})
    out = [F.avg(value).alias("mean")]
    for d in ("d1", "d2"):
        c = F.col(f"__{d}")
        out += [F.max(c).alias(f"{d}_max"), F.min(c).alias(f"{d}_min"), F.max(F.abs(c)).alias(f"{d}_max_abs"), F.avg(F.abs(c)).alias(f"{d}_mean_abs")]
    return own.groupBy(*keys, "epoch").agg(*out)


def haar_details(df: DataFrame, keys: Sequence[str], value: str, order: str = "tick", level: int = 1) -> DataFrame:
    """Haar detail coefficients of one level: keys, k, detail; incomplete blocks at the end are left out."""
    block = 2**level
    sign = F.when(F.col(order) % block < block // 2, 1).otherwise(-1)
    sums = df.withColumn("k", F.floor(F.col(order) / block)).groupBy(*keys, "k").agg(F.sum(sign * F.col(value)).alias("detail"), F.count(value).alias("__n"))
    return sums.where(F.col("__n") == block).select(*keys, "k", (F.col("detail") / 2 ** (level / 2)).alias("detail"))


def second_coefficients(df: DataFrame, keys: Sequence[str], value: str, order: str = "tick") -> DataFrame:
    """keys, second, c1, c2, c3: largest |detail| of each level inside each whole second of 8 ticks."""
    out = None
    for level in (1, 2, 3):
        per = 8 // 2**level
        part = haar_details(df, keys, value, order, level).withColumn("second", F.floor(F.col("k") / per)).groupBy(*keys, "second").agg(F.max(F.abs("detail")).alias(f"c{level}"), F.count("*").alias("__n"))
        part = part.where(F.col("__n") == per).drop("__n")
        out = part if out is None else out.join(part, [*keys, "second"])
    return out


def coefficient_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """max, mean, sample deviation, median and count above zero of coefficient columns by epoch."""
    out = []
    for c in columns:
        out += [F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.count_if(F.col(c) > 0).alias(f"{c}_above")]
    return df.groupBy(*keys, "epoch").agg(*out)


def svm_scores(rows: DataFrame, model: DataFrame, keys: Sequence[str], features: str, gamma: float, intercept: float, most: int = 10_000) -> DataFrame:
    """RBF-SVM decision: keys, decision, label (sign, 0 if exactly 0).

    rows: keys and an array of features.  model: sv_id, coef, sv.  Up to ``most`` support vectors (counted) are broadcast
    as one array; more are dealt to parts of that size, each row meets every part, and a row's sums are added up.  Rows that
    share their keys have a score each.
    """
    parts = max(1, -(-model.count() // most))
    folded = model.groupBy(F.pmod(F.xxhash64("sv_id"), F.lit(parts)).alias("__part")).agg(F.sort_array(F.collect_list(F.struct("sv_id", "coef", "sv"))).alias("__model"))
    total = F.aggregate(
        "__model", F.lit(0.0),
        lambda acc, m: acc + m["coef"] * F.exp(-gamma * F.aggregate(F.zip_with(m["sv"], F.col(features), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)),
    )
    own = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.lit(0).cast("long") if parts == 1 else F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    if parts == 1:
        scored = own.join(F.broadcast(folded), "__part", "left").select(*keys, (F.coalesce(total, F.lit(0.0)) + intercept).alias("decision"))
    else:
        scored = own.join(folded, "__part").select(*keys, "__row", total.alias("__s")).groupBy(*keys, "__row").agg((F.sum("__s") + intercept).alias("decision")).drop("__row")
    return scored.withColumn("label", F.signum("decision").cast("int"))


def one_vs_one(score_01: Column, score_02: Column, score_12: Column, labels: tuple[int, int, int] = (-1, 0, 1)) -> Column:
    """Majority of three pair decisions (positive: the first of the pair); a three-way tie gives the first class."""
    a, b, c = F.when(score_01 > 0, 0).otherwise(1), F.when(score_02 > 0, 0).otherwise(2), F.when(score_12 > 0, 1).otherwise(2)
    votes = [sum(((x == k).cast("int") for x in (a, b, c)), F.lit(0)) for k in range(3)]
    return F.when(votes[0] >= 2, labels[0]).when(votes[1] >= 2, labels[1]).when(votes[2] >= 2, labels[2]).otherwise(labels[0])


def spread_labels(samples: DataFrame, labels: DataFrame, keys: Sequence[str], time: str = "time", order: str = "idx", bucket_s: float = 5.0, default: int = 1) -> DataFrame:
    """Adds label: that of the epoch with first <= time <= last; the later epoch wins; else the default.

    labels: keys, epoch, first, last, label.
    """
    spread = labels.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket_s), F.floor(F.col("last") / bucket_s))))
    spread = spread.select(*(F.col(k).alias(f"__{k}") for k in keys), "epoch", "first", "last", "label", "__bucket")
    own = samples.withColumn("__of", F.floor(F.col(time) / bucket_s))
    on = (F.col("__of") == F.col("__bucket")) & F.col(time).between(F.col("first"), F.col("last"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    hits = own.select(*keys, order, time, "__of").join(spread, on).groupBy(*keys, order).agg(F.max_by("label", "epoch").alias("label"))
    return samples.join(hits, [*keys, order], "left").withColumn("label", F.coalesce("label", F.lit(default)))


def step_statistics(steps: DataFrame, keys: Sequence[str], tick: str = "tick", minute: int = 480) -> DataFrame:
    """keys, steps, gap: number of steps, and the mean over minutes of the mean gap between steps, rounded to 10 digits."""
    gap = F.col(tick) - F.lag(tick).over(Window.partitionBy(*keys, "__minute").orderBy(tick))
    own = steps.withColumn("__minute", F.floor(F.col(tick) / minute)).withColumn("__gap", gap)
    per = own.groupBy(*keys, "__minute").agg(F.count("*").alias("__n"), F.avg("__gap").alias("__mean"))
    return per.groupBy(*keys).agg(F.sum("__n").alias("steps"), F.round(F.avg("__mean"), 10).alias("gap"))


def down_aggregate(df: DataFrame, keys: Sequence[str], value: str, every: int, order: str = "tick") -> DataFrame:
    """sum, mean, max and share of non-zero rows of blocks of ``every`` rows."""
    own = df.withColumn("block", F.floor(F.col(order) / every))
    return own.groupBy(*keys, "block").agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.max(value).alias("max"), (F.count_if(F.col(value) != 0) / F.count(value)).alias("share"))
