"""Heart-rate variability of NN-interval series: rows (keys, beat, nn in ms).

All statistics are grouped aggregates; nulls are skipped.  A series with one beat has null differences and deviations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PERCENTS
from ..functions.lineage import cut_lineage
from .ranges import _same, ranged, running
from .selection import LARGE, SHORT, percentiles, split_by_size


def nn_intervals(beats: DataFrame, keys: Sequence[str], beat_time: str = "beat_ms", order: str = "beat", scaled: bool = True) -> DataFrame:
    """Differences of successive beat times; with ``scaled`` a series whose largest value is below 10 is in seconds and becomes whole ms."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = beats.withColumn("nn", F.col(beat_time) - F.lag(beat_time).over(w)).where("nn IS NOT NULL")
    return (scaled_nn(out, keys) if scaled else out.withColumn("nn", F.col("nn").cast("double"))).select(*keys, order, "nn")


def scaled_nn(nn: DataFrame, keys: Sequence[str]) -> DataFrame:
    largest = F.max("nn").over(Window.partitionBy(*keys))
    return nn.withColumn("nn", F.when(largest < 10, (F.col("nn") * 1000).cast("int").cast("double")).otherwise(F.col("nn").cast("double")))


def beat_clock(nn: DataFrame, keys: Sequence[str], order: str = "beat") -> DataFrame:
    """Adds time: seconds since the start, the running sum of the intervals."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return nn.withColumn("time", F.sum("nn").over(w) / 1000)


def with_differences(nn: DataFrame, keys: Sequence[str], order: str = "beat") -> DataFrame:
    """Adds diff: absolute difference to the interval before."""
    return nn.withColumn("diff", F.abs(F.col("nn") - F.lag("nn").over(Window.partitionBy(*keys).orderBy(order))))


def exceeding(threshold: float) -> tuple[Column, Column]:
    """Count and percentage of differences above a threshold in ms."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    n = F.count_if(F.col("diff") > threshold)
    return n, F.try_divide(n * 100.0, F.count("diff"))


def _rates(points: Column) -> list[Column]:
    return [points[i].alias(n) for i, n in enumerate(("hr_p5", "hr_p25", "hr_p50", "hr_p75", "hr_p95"))]


def summary(nn: DataFrame, keys: Sequence[str], order: str = "beat", large: int | None = LARGE) -> DataFrame:
    """Counts, means and extremes of intervals, differences and heart rates; sdnn, sdsd, rmssd; nn50, nn20.

    Beats at the same time have an infinite rate, which counts in all statistics of the rate; differences may be of any length.

    Groups of more than ``large`` beats are neither sorted in one task nor are their values held in one executor; None takes
    all as small and saves the count of the groups.
    """
    hr = F.when(F.col("nn") == 0, float("inf")).otherwise(60000 / F.col("nn"))
    n50, p50 = exceeding(50)
    n20, p20 = exceeding(20)
    head = [
        F.count("nn").alias("nn_count"), F.avg("nn").alias("nn_mean"), F.min("nn").alias("nn_min"), F.max("nn").alias("nn_max"),
        F.avg("diff").alias("diff_mean"), F.min("diff").cast("long").alias("diff_min"), F.max("diff").cast("long").alias("diff_max"),
        F.avg(hr).alias("hr_mean"), F.min(hr).alias("hr_min"), F.max(hr).alias("hr_max"), F.stddev_samp(hr).alias("hr_std"),
    ]
    tail = [
        F.stddev_samp("nn").alias("sdnn"), F.stddev_samp("diff").alias("sdsd"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmssd"),
        n50.alias("nn50"), p50.alias("pnn50"), n20.alias("nn20"), p20.alias("pnn20"),
    ]
    few, many = split_by_size(nn, keys, large)
    out = with_differences(few, keys, order).groupBy(*keys).agg(*head, *_rates(F.percentile(hr, F.array(*(F.lit(p) for p in PERCENTS)))), *tail)
    if many is None:
        return out
    chained = running(ranged(many, keys, [order]), keys, [order], before={"__before": F.col("nn")}).withColumn("diff", F.abs(F.col("nn") - F.col("__before")))
    held = percentiles(many, keys, hr, PERCENTS, large, infinite=True).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    both = chained.groupBy(*keys).agg(*head, *tail).join(held, _same(keys, "__k_"), "left").select("*", *_rates(F.col("points")))
    return out.unionByName(both.select(*out.columns))


def _next_starts(beats: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """keys, __i, __j: where a segment that starts at beat __i (from 0) is followed by one at beat __j.

    beats: keys, __p (beats up to this one), __c (their sum), __n, __total.  The end of a segment is a search among running
    sums: searched values and sums are sorted together, and a running count says how many sums lie below each value.
    """
    start = F.col("__c") + limit
    sums = beats.select(*keys, F.col("__c").alias("__v"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__i"), F.lit(None).cast("double").alias("__from"), "__n")
    inner = beats.where((F.col("__p") < F.col("__n")) & (start <= F.col("__total"))).select(*keys, start.alias("__v"), F.lit(0), F.col("__p"), F.col("__c"), "__n")
    first = beats.where("__p = 1").select(*keys, F.lit(float(limit)), F.lit(0), F.lit(0).cast("long"), F.lit(0.0), "__n")
    order, summed = ["__v", "__kind"], F.col("__kind") == 1
    found = running(ranged(sums.union(inner).union(first), keys, order), keys, order, sums={"__below": summed.cast("long")}, following={"__at": F.when(summed, F.col("__v"))})
    end = F.col("__below") + 1  # the first beat count whose sum reaches the limit; the beat that overshoots is left to the next segment
    end = F.when(F.col("__at") - F.col("__from") > limit, F.greatest(end - 1, F.col("__i") + 1)).otherwise(end)
    return found.where("__kind = 0").select(*keys, "__i", end.alias("__j"), "__n").where("__j < __n").drop("__n")


def _followed(left: DataFrame, steps: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    """Rows (keys, __j and others) moved from __j to where steps (keys, __i, __j) lead."""
    to = steps.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__i").alias("__from"), F.col("__j").alias("__to"))
    on = F.col("__j") == F.col("__from")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(to, on).select(*keys, *(c.alias(n) for n, c in columns.items()), F.col("__to").alias("__j"))


def _segments_in_order(nn: DataFrame, keys: Sequence[str], limit: float, full: bool, order: str) -> DataFrame:
    """``segments`` of recordings that a task holds: from start to start along the running sums."""
    import numpy as np
    import pyarrow as pa

    from .signals import _kinds, by_group

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x = np.nan_to_num(table.column("nn").cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float), posinf=np.inf, neginf=-np.inf)
        segment = np.full(len(x), -1, np.int32)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
            clock, m = np.cumsum(x[lo:hi]), hi - lo
            total, at, since, k = clock[-1], 0, 0.0, 0
            count = np.ceil(total / limit) - (not full) if total > limit else 0
            while at < m and k < count:
                end = m
                if since + limit <= total:
                    end = int(clock.searchsorted(since + limit)) + 1  # the first beat count whose sum reaches the limit
                    end = max(end - 1 if clock[end - 1] - since > limit else end, at + 1)
                segment[lo + at : lo + end] = k
                at, since, k = end, clock[end - 1], k + 1
        return table.append_column("segment", pa.array(segment)).filter(pa.array(segment >= 0))

    own = nn.select(*keys, order, "nn")
    return by_group(own, keys, order, run, f"{_kinds(own, own.columns)}, segment int")


def segments(nn: DataFrame, keys: Sequence[str], duration_s: float = 300.0, full: bool = True, order: str = "beat", short: int = SHORT) -> DataFrame:
    """Adds segment: beats are taken until their sum reaches the duration; the beat that overshoots opens the next one.

    There are ceil(total / duration) segments; beats beyond the last are lost, and with ``full=False`` the last goes too.
    Recordings not longer than the duration give nothing.  Intervals are not negative; null and NaN count as 0.

    Recordings of up to ``short`` beats are cut one after the other in sorted partitions; longer ones go by
    ``_segments_over_partitions``.
    """
    few, many = split_by_size(nn.select(*keys, order, "nn"), keys, short)
    out = _segments_in_order(few, keys, duration_s * 1000.0, full, order)
    return out if many is None else out.unionByName(_segments_over_partitions(many, keys, duration_s, full, order))


def _segments_over_partitions(nn: DataFrame, keys: Sequence[str], duration_s: float, full: bool, order: str) -> DataFrame:
    """``segments`` of recordings of any length.

    Greedy, but no recording meets in one task: where a segment from each beat would end comes from running sums over range
    partitions.  Steps are then doubled (to the next start, the one after the next, the fourth, ...) and starts already known
    take each step once, so the starts of all segments are found in as many joins as their number has binary digits.
    """
    limit, x = duration_s * 1000.0, F.coalesce(F.nanvl(F.col("nn").cast("double"), F.lit(0.0)), F.lit(0.0))
    one = F.lit(1).cast("long")
    beats = running(ranged(nn.select(*keys, order, "nn"), keys, [order]), keys, [order], sums={"__c": x, "__p": one}, totals={"__n": one, "__total": x})
    beats = cut_lineage(beats.where(F.col("__total") > limit))
    steps = cut_lineage(_next_starts(beats, keys, limit))
    starts, length = beats.where("__p = 1").select(*keys, F.lit(0).cast("long").alias("__k"), F.lit(0).cast("long").alias("__j")), 1
    while True:
        more = cut_lineage(_followed(starts, steps, keys, __k=F.col("__k") + length))
        if more.isEmpty():
            break
        starts, length = starts.unionByName(more), 2 * length
        steps = cut_lineage(_followed(steps, steps, keys, __i=F.col("__i")))
    marks = starts.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__k", F.col("__j").alias("__start"))
    on = F.col("__p") - 1 == F.col("__start")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    marked = beats.join(marks, on, "left").select(*beats.columns, "__k")
    out = running(marked, keys, [order], last={"__segment": F.col("__k")})
    count = F.ceil(F.col("__total") / limit) - (0 if full else 1)
    return out.where(F.col("__segment") < count).select(*keys, order, "nn", F.col("__segment").cast("int").alias("segment"))


def segment_deviations(segmented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sdnn_index: mean of the segments' deviations; sdann: deviation of their means."""
    per = segmented.groupBy(*keys, "segment").agg(F.stddev_samp("nn").alias("__s"), F.avg("nn").alias("__m"))
    return per.groupBy(*keys).agg(F.avg("__s").alias("sdnn_index"), F.stddev_samp("__m").alias("sdann"))


def histogram(nn: DataFrame, keys: Sequence[str], binsize: float = 7.8125) -> DataFrame:
    """keys, bin, n over bins [k b, (k + 1) b) from 0; the last bin also holds its upper edge."""
    top = F.max("nn").over(Window.partitionBy(*keys))
    last = F.greatest(F.ceil((top + binsize) / binsize) - 2, F.lit(0))  # bins end at the first edge not below the maximum
    return nn.where("nn IS NOT NULL").withColumn("bin", F.least(F.floor(F.col("nn") / binsize), last).cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def triangular_index(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hist.groupBy(*keys).agg((F.sum("n") / F.max("n")).alias("tri_index"))


def poincare(nn: DataFrame, keys: Sequence[str], order: str = "beat") -> DataFrame:
    """Spread of the points (nn, next nn) across and along the identity line, their ratio, and the ellipse's area."""
    following = F.lead("nn").over(Window.partitionBy(*keys).orderBy(order))
    p = nn.withColumn("__x2", following).where("__x2 IS NOT NULL")
    sd1, sd2 = (F.stddev_pop((F.col("nn") + s * F.col("__x2")) / math.sqrt(2)) for s in (-1, 1))
    return p.groupBy(*keys).agg(sd1.alias("sd1"), sd2.alias("sd2")).withColumns({"sd_ratio": F.try_divide("sd2", "sd1"), "ellipse_area": math.pi * F.col("sd1") * F.col("sd2")})


def tinn(hist: DataFrame, keys: Sequence[str], binsize: float = 7.8125) -> DataFrame:
    """Baseline width of the triangle that fits the histogram best: keys, tinn_n, tinn_m, tinn.

    The triangle rises from N left of the mode to the mode and falls to M right of it; N and M are bin edges.  Errors are
    squared; a best error not below 2**14 gives zeros.  One histogram (some hundred bins) per group.
    """
    import numpy as np
    import pyarrow as pa

    from .signals import sorted_groups

    def side(d: np.ndarray, top: float) -> tuple[int, float]:
        """Where a line to ``top``, one bin behind the last, has to start at 0, and its squared error, by running sums."""
        m = len(d)
        at = np.arange(m)
        # Sums over the bins from a on: of d * d, d, and d * place.
        ones, places = (np.cumsum(v[::-1])[::-1] for v in (d, d * at))
        run = m - at  # bins from a on; the line rises by top / run a bin
        squares = (run - 1) * run * (2 * run - 1) / 6  # of 0 .. run - 1
        error = (d * d).sum() - 2 * top / run * (places - at * ones) + (top / run) ** 2 * squares
        best = int(error.round(6).argmin())  # ties to the widest
        return best, float(error[best])

    def fit(table: pa.Table) -> dict[str, list]:
        bins, n = table.column("bin").to_numpy(), table.column("n").to_numpy()
        d = np.zeros(int(bins.max()) + 2)
        d[bins] = n
        edges = np.arange(len(d)) * binsize
        top = int(d.argmax())
        best = (2.0**14, 0.0, 0.0)
        left, right = np.arange(top), np.arange(top + 1, len(d))
        if len(left) and len(right):
            i, el = side(d[:top], d[top])
            j, er = side(d[:top:-1], d[top])  # the two sides are independent
            if el + er < best[0]:
                best = (el + er, edges[i], edges[len(d) - 1 - j])
        return {"tinn_n": [float(best[1])], "tinn_m": [float(best[2])], "tinn": [float(best[2] - best[1])]}

    return sorted_groups(hist, keys, "bin", fit, {c: pa.float64() for c in ("tinn_n", "tinn_m", "tinn")}, "tinn_n double, tinn_m double, tinn double")


def heart_rate_classes(nn: DataFrame, people: DataFrame, classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of beats per heart-rate class: keys, class, percent.

    people: keys, gender, age.  classes: gender, age_lo, age_hi, class, hr_lo, hr_hi; a small argument table.
    """
    beats = nn.join(people, list(keys)).withColumn("__hr", (60000 / F.col("nn")).cast("int"))
    c = classes.withColumnRenamed("gender", "__gender")
    on = (F.col("gender") == F.col("__gender")) & (F.col("age") > F.col("age_lo") - 1) & (F.col("age") < F.col("age_hi") + 1) & F.col("__hr").between(F.col("hr_lo"), F.col("hr_hi"))
    counted = beats.join(c, on).groupBy(*keys, "class").agg(F.count("*").alias("__n"))
    total = beats.groupBy(*keys).agg(F.count("*").alias("__all"))
    return counted.join(total, list(keys)).select(*keys, "class", (F.col("__n") * 100.0 / F.col("__all")).alias("percent"))


def against_reference(features: DataFrame, reference: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Features (keys, feature, value) in percent of the reference, for features non-null on both sides."""
    r = reference.select(*keys, "feature", F.col("value").alias("__ref"))
    both = features.join(r, [*keys, "feature"]).where("value IS NOT NULL AND __ref IS NOT NULL")
    return both.select(*keys, "feature", (F.try_divide("value", "__ref") * 100).alias("percent"))
