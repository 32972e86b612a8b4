"""Recordings: one row per sample, keyed by recording, ordered by ``idx``.

Every function takes the key columns of a recording (``keys``) and keeps all other columns.  Windows partition by these
keys, so one shuffle by recording serves a chain of them.  Nulls: a null trigger is a value of its own; a null time or
value never lies in an interval and is skipped by aggregates.  Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = "_"


def pick_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns if all are there, else an empty frame of what is."""
    have = [n for n in names if n in df.columns]
    return df.select(*names) if len(have) == len(names) else df.select(*have).limit(0)


def in_phases(df: DataFrame, phases: Sequence[str], trigger: str = "trigger") -> DataFrame:
    return df.where(F.col(trigger).isin(*phases))


def without_null_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Infinities become null, then every column that holds a null (or NaN) in any row goes.  One aggregate, one row."""
    values = [c for c in df.columns if c not in keys]
    kinds = dict(df.dtypes)
    clean = df.select(*keys, *(F.when(F.abs(c) != float("inf"), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in values))
    bad = clean.agg(*(F.count_if(F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))).alias(c) for c in values)).first()
    return clean.select(*keys, *(c for c in values if not bad[c]))


def fill_triggers(df: DataFrame, keys: Sequence[str], trigger: str = "trigger", order: str = "idx", blank: str = BLANK) -> DataFrame:
    """Runs of blanks take the value before the run; runs that touch either end of the recording stay blank."""
    named = F.when(F.col(trigger) != blank, F.col(trigger))
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(named, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(trigger, F.when((F.col(trigger) == blank) & before.isNotNull() & after.isNotNull(), before).otherwise(F.col(trigger)))


def trigger_runs(df: DataFrame, keys: Sequence[str], trigger: str = "trigger", order: str = "idx") -> DataFrame:
    """Adds run: the number of the run of equal triggers, from 0; two nulls are different triggers."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.row_number().over(w) == 1, 0).when(F.lag(trigger).over(w) == F.col(trigger), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn("run", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__changed")


def last_rows_of_phase(df: DataFrame, keys: Sequence[str], phase: str, n: int, changing: str | None = None, trigger: str = "trigger", order: str = "idx") -> DataFrame:
    """The last n rows of a phase; with ``changing``, only rows after the first change of that column in the recording."""
    w = Window.partitionBy(*keys).orderBy(order)
    if changing:
        moves = F.when(F.col(changing) != F.lead(changing).over(w), F.col(order))
        df = df.withColumn("__moves", moves).withColumn("__first", F.min("__moves").over(Window.partitionBy(*keys))).where(F.col(order) > F.col("__first"))
        df = df.drop("__moves", "__first")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.where(F.col(trigger) == phase).withColumn("__n", last).where(F.col("__n") <= n).drop("__n")


def chunks(df: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """Adds chunk: consecutive blocks of n rows, the last of which may be short."""
    return df.withColumn("chunk", F.floor(F.col(order) / n).cast("long"))


def _within(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, how: str, bucket_s: float) -> DataFrame:
    """Range join with both ends included.

    Intervals are spread over the time buckets they touch, so that recording and bucket are the join key: a recording's
    samples are spread over many tasks, and neither side has to be small.
    """
    spread = intervals.where("start <= end").withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket_s), F.floor(F.col("end") / bucket_s))))
    spread = spread.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in intervals.columns if c not in keys), "__bucket")
    left = samples.withColumn("__of", F.floor(F.col(time) / bucket_s))
    on = (F.col("__of") == F.col("__bucket")) & F.col(time).between(F.col("start"), F.col("end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(spread, on, how).drop("__of", "__bucket", *(f"__{k}" for k in keys))


def split_by_intervals(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str = "time", bucket_s: float = 60.0) -> DataFrame:
    """samples with slalom of each interval (keys, slalom, start, end) that holds them; a sample in two appears twice."""
    return _within(samples, intervals.select(*keys, "slalom", "start", "end"), keys, time, "inner", bucket_s).drop("start", "end")


def gaps_after(intervals: DataFrame, keys: Sequence[str], tail_s: float = 15.0) -> DataFrame:
    """The stretch from the end of each interval to the start of the next; after the last, ``tail_s`` seconds."""
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("slalom"))
    return intervals.select(*keys, "slalom", F.col("end").alias("start"), F.coalesce(following, F.col("end") + tail_s).alias("end"))


def interval_scores(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], score: str = "score", k: int = 51, tail_s: float = 15.0, order: str = "idx", bucket_s: float = 60.0) -> DataFrame:
    """Per slalom: the largest sliding median (k, zero-padded) of the score in the gap after it.  keys, slalom, score."""
    inside = split_by_intervals(samples, gaps_after(intervals, keys, tail_s), keys, bucket_s=bucket_s)
    smooth = sliding_median(inside, [*keys, "slalom"], score, k, order)
    return smooth.groupBy(*keys, "slalom").agg(F.max(f"{score}_median").alias(score))


def sliding_median(df: DataFrame, keys: Sequence[str], value: str, k: int, order: str = "idx") -> DataFrame:
    """Adds <value>_median: median of the k rows around each row, zeros beyond the ends.  For small odd k."""
    h = k // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h)
    frame = F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(w)
    padded = F.concat(frame, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(frame)))
    return df.withColumn(f"{value}_median", F.element_at(F.sort_array(padded), h + 1))


def override_scores(samples: DataFrame, corrections: DataFrame, keys: Sequence[str], score: str = "score", time: str = "time", order: str = "idx", bucket_s: float = 60.0) -> DataFrame:
    """corrections: keys, slalom, start, end, new_score.  Samples inside take the new score; the later slalom wins."""
    joined = _within(samples, corrections.select(*keys, "slalom", "start", "end", "new_score"), keys, time, "left", bucket_s)
    kept = [c for c in samples.columns if c not in (*keys, order, score)]
    best = joined.groupBy(*keys, order).agg(*(F.first(c).alias(c) for c in kept), F.first(score).alias(score), F.max_by("new_score", "slalom").alias("__new"))
    return best.withColumn(score, F.coalesce("__new", score)).select(*samples.columns)


def apply_corrections(samples: DataFrame, rules: DataFrame, keys: Sequence[str], trigger: str = "trigger", order: str = "idx") -> DataFrame:
    """rules: keys, op, lo, hi, old, value.

    ``relabel``: rows with lo <= idx <= hi take the trigger ``value``.  ``rename``: trigger ``old`` becomes ``value``.
    ``drop``: rows with lo <= idx <= hi go.  Rules are hand-written (a few per recording), so their arrays travel by key.
    """
    per_key = rules.groupBy(*keys).agg(F.collect_list(F.struct("op", "lo", "hi", "old", "value")).alias("__rules"))
    per_key = per_key.select(*(F.col(k).alias(f"__{k}") for k in keys), "__rules")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    at = F.col(order)

    def hits(r: Column, op: str) -> Column:
        return (r["op"] == op) & at.between(r["lo"], r["hi"])

    none = F.array().cast(dict(per_key.dtypes)["__rules"])
    own = samples.join(per_key, on, "left").withColumn("__rules", F.coalesce("__rules", none))
    own = own.where(~F.exists("__rules", lambda r: F.coalesce(hits(r, "drop"), F.lit(False))))
    relabelled = F.element_at(F.transform(F.filter("__rules", lambda r: hits(r, "relabel")), lambda r: r["value"]), -1)
    renamed = F.element_at(F.transform(F.filter("__rules", lambda r: (r["op"] == "rename") & (r["old"] == F.col(trigger))), lambda r: r["value"]), -1)
    first_relabel = F.when(F.size(F.filter("__rules", lambda r: hits(r, "relabel"))) > 0, relabelled)
    any_rename = F.when(F.size(F.filter("__rules", lambda r: (r["op"] == "rename") & (r["old"] == F.col(trigger)))) > 0, renamed)
    return own.withColumn(trigger, F.coalesce(first_relabel, any_rename, F.col(trigger))).select(*samples.columns)


def lead_in(recordings: DataFrame, log: DataFrame, keys: Sequence[str], trigger_value: str, step: float = 0.001, time: str = "time", order: str = "idx", trigger: str = "trigger") -> DataFrame:
    """Prepends copies of a recording's first row so that its start trigger comes as late as in the log.

    The copies stand at 0, step, ... up to the delay minus step and get negative idx; no delay, no rows.
    """
    start = F.min(F.when(F.col(trigger) == trigger_value, F.col(time)))
    of_log = log.groupBy(*keys).agg(start.alias("__log"))
    first = recordings.groupBy(*keys).agg(start.alias("__own"), F.min_by(F.struct(*recordings.columns), order).alias("__row"))
    n = F.round((F.col("__log") - F.col("__own")) / step).cast("long")
    copies = first.join(of_log, list(keys)).where(F.col("__log") - F.col("__own") > step).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    rows = copies.select(*(F.round(F.col("__i") * step, 9).alias(time) if c == time else (F.col("__i") - n).alias(order) if c == order else F.col(f"__row.{c}").alias(c) for c in recordings.columns))
    return rows.unionByName(recordings)


def join_parts(first: DataFrame, second: DataFrame, keys: Sequence[str], time: str = "time", order: str = "idx") -> DataFrame:
    """Second parts follow their first parts: times shifted by its last time, idx continued."""
    ends = first.groupBy(*keys).agg(F.max(time).alias("__end"), (F.max(order) + 1).alias("__n"))
    shifted = second.join(ends, list(keys), "left").withColumn(time, F.col(time) + F.coalesce("__end", F.lit(0.0))).withColumn(order, F.col(order) + F.coalesce("__n", F.lit(0)))
    return first.unionByName(shifted.select(*first.columns))


def shift_intervals(first: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """Intervals of second parts on the time of the joined recording."""
    ends = first.groupBy(*keys).agg(F.max(time).alias("__end"))
    moved = intervals.join(ends, list(keys), "left")
    return moved.withColumn("start", F.col("start") + F.coalesce("__end", F.lit(0.0))).withColumn("end", F.col("end") + F.coalesce("__end", F.lit(0.0))).select(*intervals.columns)


def stack(*frames: DataFrame) -> DataFrame:
    """Frames of different campaigns or phases on top of each other; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str], signal: str, time: str = "time", order: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Two cleaned signals of one recording side by side, and the number of samples whose times differ by recording."""
    other = b.select(*keys, order, F.col(time).alias("__time"), signal)
    both = a.join(other, [*keys, order])
    wrong = both.groupBy(*keys).agg(F.count_if(~F.col(time).eqNullSafe(F.col("__time"))).alias("mismatches"))
    return both.drop("__time"), wrong


def nearest_clean(df: DataFrame, keys: Sequence[str], order: str = "chunk", abnormal: str = "abnormal") -> DataFrame:
    """For each abnormal row the nearest normal one by position, ties to the lower; null without any.  Adds donor."""
    w = Window.partitionBy(*keys).orderBy(order)
    normal = F.when(~F.col(abnormal), F.col(order))
    below = F.last(normal, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first(normal, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    at = F.col(order)
    nearest = F.when(below.isNull(), above).when(above.isNull(), below).when(above - at < at - below, above).otherwise(below)
    return df.withColumn("donor", F.when(F.col(abnormal), nearest))
