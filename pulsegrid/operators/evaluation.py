"""Model evaluation: splits, ROC, AUC, votes, weighted percentiles, rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.lineage import cut_lineage
from .ranges import PART, places, ranged, running


def binarise(score: Column, threshold: float = 2.6) -> Column:
    """0 up to the threshold, else 1; NaN and null are 1."""
    return F.when(~F.isnan(score) & (score <= threshold), 0).otherwise(1)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds __at, the place (from 1) of a row in its group by ``order``, and __n, the group's rows; no group meets in one task."""
    return places(df, keys, order).withColumn("__at", F.col("__at") + 1).drop("__pid")


def repeated_splits(df: DataFrame, key: str, repeats: int, train_share: float = 0.75, seed: int = 0, total: int | None = None) -> DataFrame:
    """Adds rep and train for each repeat: a hash-random share of exactly int(train_share * n) rows trains.

    Rows are ranked by the hash of (seed, repeat, key) inside each repeat.
    """
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = reps.withColumn("__hash", F.md5(F.concat_ws("/", F.lit(seed), "rep", key)))
    n = F.col("__n") if total is None else F.lit(total)
    return ranked(hashed, ["rep"], ["__hash", key]).withColumn("train", F.col("__at") <= F.floor(train_share * n)).drop("__hash", "__at", "__n")


def first_share(df: DataFrame, order: str, share: float = 0.33, keys: Sequence[str] = ()) -> DataFrame:
    """The first int(share * n) rows by an explicit order key, per group."""
    return ranked(df, keys, [order]).where(F.col("__at") <= F.floor(F.col("__n") * share)).drop("__n", "__at")


def _descending(rows: DataFrame, column: str) -> DataFrame:
    """Adds __null and __down, whose ascending order is the descending order of a column, nulls last."""
    x = F.col(column).cast("double")
    return rows.withColumns({"__null": x.isNull(), "__down": F.when(F.isnan(x), float("-inf")).otherwise(-x)})


DOWN = ["__null", "__down"]


def roc_points(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """keys, threshold, tpr, fpr: one point per distinct score, descending.

    Scores are grouped, range-partitioned and summed up from partition to partition.
    """
    per = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("__p"), F.count(label).alias("__n"))
    rows = ranged(_descending(per, score), keys, DOWN)
    p, n = F.col("__p"), F.col("__n")
    rows = running(rows, keys, DOWN, sums={"__tp": p, "__seen": n}, totals={"__p_all": p, "__n_all": n})
    tp, fp = F.col("__tp"), F.col("__seen") - F.col("__tp")
    return rows.select(*keys, F.col(score).alias("threshold"), F.try_divide(tp, F.col("__p_all")).alias("tpr"), F.try_divide(fp, F.col("__n_all") - F.col("__p_all")).alias("fpr"))


def auc(points: DataFrame, keys: Sequence[str], digits: int = 2) -> DataFrame:
    """Trapezoid area under the ROC curve from (0, 0), rounded."""
    rows = running(ranged(_descending(points, "threshold"), keys, DOWN), keys, DOWN, before={"__x0": F.col("fpr"), "__y0": F.col("tpr")})
    x0, y0 = F.coalesce("__x0", F.lit(0.0)), F.coalesce("__y0", F.lit(0.0))
    own = rows.withColumn("__area", (F.col("fpr") - x0) * (F.col("tpr") + y0) / 2)
    return own.groupBy(*keys).agg(F.round(F.sum("__area"), digits).alias("auc"))


def mean_roc(points: DataFrame, rep: str, length: int) -> DataFrame:
    """k, tpr, fpr: means over repeats of their k-th points; shorter curves are padded with 1, longer ones cut."""
    placed = places(_descending(points, "threshold"), [rep], DOWN)
    numbered = placed.withColumn("k", F.col("__at").cast("int")).where(F.col("k") < length).select(rep, "k", "tpr", "fpr")
    grid = points.select(rep).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    padded = grid.join(numbered, [rep, "k"], "left")
    return padded.groupBy("k").agg(F.avg(F.coalesce("tpr", F.lit(1.0))).alias("tpr"), F.avg(F.coalesce("fpr", F.lit(1.0))).alias("fpr"))


def evaluation_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    x = finite(F.col(value))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def weighted_percentiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, percents: Sequence[float]) -> DataFrame:
    """keys, percent, value: points at p = 100 / W (cumulated w - w / 2), linear between, clamped; zero weights ignored.

    Cumulated weights come from range partitions, so a group may be as large as the table.  Of a group only the points on both
    sides of each percent are kept, first by partition, then by group.
    """
    own = df.where(F.col(weight) > 0).select(*keys, F.col(value).alias("__x"), F.col(weight).cast("double").alias("__w"))
    rows = ranged(own.groupBy(*keys, "__x", "__w").agg(F.count("*").alias("__times")), keys, ["__x", "__w"])
    rows = running(rows, keys, ["__x", "__w"], sums={"__sum": F.col("__w") * F.col("__times")}, totals={"__all": F.col("__w") * F.col("__times")})
    # Equal rows lie side by side: the first and the last of them bound a level stretch.
    first, end = F.col("__sum") - F.col("__w") * (F.col("__times") - 0.5), F.col("__sum") - F.col("__w") / 2
    point = F.struct(F.col("__x").alias("x"), F.col("__w").alias("w"), (100 / F.col("__all") * first).alias("p"), (100 / F.col("__all") * end).alias("end"))
    rows = rows.select(PART, *keys, point.alias("__point"))
    sides = {}
    for i, q in enumerate(percents):
        sides |= {f"__lo{i}": (F.max, F.col("__point.p") <= float(q)), f"__hi{i}": (F.min, F.col("__point.p") > float(q))}
    near = rows.groupBy(PART, *keys).agg(*(best(F.when(on, F.col("__point"))).alias(n) for n, (best, on) in sides.items()))  # as the rows are sorted
    near = near.groupBy(*keys).agg(*(best(n).alias(n) for n, (best, _) in sides.items()))
    told = []
    for i, q in enumerate(percents):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        line = lo["x"] + (hi["x"] - lo["x"]) * (float(q) - lo["end"]) / (hi["p"] - lo["end"])
        told.append(F.struct(F.lit(float(q)).alias("percent"), F.when(lo.isNull(), hi["x"]).when(hi.isNull() | (lo["end"] >= float(q)), lo["x"]).otherwise(line).alias("value")))
    return near.select(*keys, F.explode(F.array(*told)).alias("__at")).select(*keys, "__at.percent", "__at.value")


def feature_votes(steps: DataFrame, top: int = 30) -> DataFrame:
    """steps: tau, lam, feature, coef.  A feature counts once per tau with any non-zero step; ties by name.  feature, votes."""
    votes = steps.where((F.col("coef") != 0) & F.col("coef").isNotNull()).select("tau", "feature").distinct().groupBy("feature").agg(F.count("*").alias("votes"))
    return votes.orderBy(F.desc("votes"), "feature").limit(top)


def scaled_by_feature(df: DataFrame, value: str = "coef") -> DataFrame:
    """Adds scaled: value in [0, 1] between the feature's extremes; null for constant features."""
    w = Window.partitionBy("feature")
    return df.withColumn("scaled", F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)))


def kendall_tau(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, tau: Kendall tau-b of each group; rows with a null on either side are left out, no two pairs give null.

    Pairs are counted, not listed.  Rows are ordered by x, then y.  Two rows are in the wrong order when the ranks of
    their y agree above some bit and that bit is 1 in the earlier row, 0 in the later: for each bit, and each value of the
    bits above it, a running count of ones is added up over the zeros.  That makes n log n rows instead of n * n pairs.
    Ranks, places and running counts come from range partitions: no group, nor its half above a bit, meets in one task.
    """
    own = df.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    one, up = F.lit(1).cast("long"), ["__y", "__u"]
    rows = ranged(own.withColumn("__u", F.monotonically_increasing_id()), keys, up)
    rows = running(rows, keys, up, sums={"__at": one}, totals={"__n": one}, before={"__y0": F.col("__y")})
    new = F.col("__y0").isNull() | (F.col("__y0") != F.col("__y"))
    rows = running(rows, keys, up, last={"__yr": F.when(new, F.col("__at") - 1)}).select(*keys, "__x", "__y", "__yr", "__n")
    own = cut_lineage(running(ranged(rows, keys, ["__x", "__y"]), keys, ["__x", "__y"], sums={"__xr": one}).drop("__pid"))
    levels = own.withColumn("__b", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("__n") - 1)) - 1)))
    levels = levels.select(*keys, "__b", F.expr("shiftright(__yr, __b) % 2").alias("__one"), F.expr("shiftright(__yr, __b + 1)").alias("__above"), "__xr")
    by = [*keys, "__b", "__above"]
    before = running(ranged(levels, by, ["__xr"]), by, ["__xr"], sums={"__ones": F.col("__one")})
    sums = before.groupBy(*keys).agg(F.sum(F.when(F.col("__one") == 0, F.col("__ones")).otherwise(0)).cast("double").alias("__n")).withColumn("__of", F.lit("wrong"))

    def pairs(n):
        return (n * (n - 1) / 2).cast("double")

    for name, of in (("all", []), ("tx", ["__x"]), ("ty", ["__y"]), ("txy", ["__x", "__y"])):
        ties = own.groupBy(*keys, *of).agg(F.count("*").alias("__c")).groupBy(*keys).agg(F.sum(pairs(F.col("__c"))).alias("__n"))
        sums = sums.unionByName(ties.withColumn("__of", F.lit(name)))
    n = {name: F.sum(F.when(F.col("__of") == name, F.col("__n"))) for name in ("all", "tx", "ty", "txy", "wrong")}
    good = n["all"] - n["tx"] - n["ty"] + n["txy"] - 2 * n["wrong"]
    return sums.groupBy(*keys).agg(F.try_divide(good, F.sqrt((n["all"] - n["tx"]) * (n["all"] - n["ty"]))).alias("tau"))
