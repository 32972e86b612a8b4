"""Feature tables: statistics by interval, long and wide forms, normalisation by a rest phase."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PERCENTS, at_percents, finite, percents_of, ratio, stats_of
from .ranges import _same, ranged, running
from .selection import LARGE, percentiles, split_by_size


def described(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[Column, Column | None]], others: Mapping[str, Column] = {}) -> DataFrame:
    """keys, others (aggregates) and the statistics of each measure, named by its prefix: prefix -> column and its crossings.

    Percentiles come from the sorted values of a group and are rounded as in SQL, see ``interpolated``.
    """
    aggs, out = [c.alias(n) for n, c in others.items()], [F.col(n) for n in others]
    for i, (prefix, (c, cross)) in enumerate(measures.items()):
        plain = stats_of(c, cross, percentiles=False)
        aggs += [*(a.alias(f"{prefix}{n}") for n, a in plain.items()), F.sort_array(F.collect_list(finite(c))).alias(f"__all{i}")]
        points = {n: p.alias(f"{prefix}{n}") for n, p in at_percents(F.col(f"__points{i}")).items()}
        out += [points[n] if n in points else F.col(f"{prefix}{n}") for n in stats_of(c, cross)]
    made = df.groupBy(*keys).agg(*aggs).withColumns({f"__points{i}": percents_of(F.col(f"__all{i}")) for i in range(len(measures))})
    return made.select(*keys, *out)


def signal_statistics(df: DataFrame, keys: Sequence[str], value: str, order: str = "idx", large: int | None = LARGE) -> DataFrame:
    """Percentiles, extremes, mean, population deviation, zero crossings, rms and mean absolute value by group.

    Groups of more than ``large`` rows are neither sorted in one task nor are their values held in one executor; None takes all
    as small and saves the count of the groups.
    """
    x, cross = finite(F.col(value)), F.col("__cross")
    few, many = split_by_size(df, keys, large)
    before = F.lag(x).over(Window.partitionBy(*keys).orderBy(order))
    out = few.withColumn("__cross", F.when(x * before < 0, 1)).transform(described, keys, {"": (F.col(value), cross)})
    if many is None:
        return out
    chained = running(ranged(many, keys, [order]), keys, [order], before={"__before": x}).withColumn("__cross", F.when(x * F.col("__before") < 0, 1))
    held = percentiles(many, keys, F.col(value), PERCENTS, large).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    rest = chained.groupBy(*keys).agg(*(c.alias(n) for n, c in stats_of(F.col(value), cross, percentiles=False).items()))
    both = rest.join(held, _same(keys, "__k_"), "left").withColumns(at_percents(F.col("points")))
    return out.unionByName(both.select(*out.columns))


def to_long(wide: DataFrame, keys: Sequence[str], features: Sequence[str] | None = None, infinite: bool = False) -> DataFrame:
    """keys, feature, value; the form for work on single features.  infinite: NaN and infinities stay instead of becoming null."""
    names = [c for c in wide.columns if c not in keys] if features is None else list(features)
    typed = wide.select(*keys, *((F.col(c).cast("double") if infinite else finite(F.col(c))).alias(c) for c in names))
    return typed.unpivot(list(keys), names, "feature", "value")


def to_wide(long: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One column per named feature."""
    return long.groupBy(*keys).pivot("feature", list(features)).agg(F.first("value"))


def normalised(long: DataFrame, baseline: DataFrame, keys: Sequence[str], infinite: bool = False) -> DataFrame:
    """Values (…keys…, feature, value) divided by the baseline's (keys, feature, value); smallest baseline if repeated.

    A missing baseline or one of 0, and a result that is not finite, give null; with ``infinite`` the latter stays.
    """
    base = baseline.groupBy(*keys, "feature").agg(F.min("value").alias("__base"))
    share = (F.try_divide if infinite else ratio)(F.col("value"), F.col("__base"))
    return long.join(base, [*keys, "feature"], "left").withColumn("value", share).drop("__base")


def without_baseline(long: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that have no baseline."""
    return long.select(*keys).distinct().join(baseline.select(*keys), list(keys), "left_anti")


def wide_concat(blocks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Feature blocks side by side, by key and never by position."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, list(keys))
    return out


def event_statistics(events: DataFrame, keys: Sequence[str], measures: Sequence[str], order: str) -> DataFrame:
    """Statistics of each measure of detected events (skin responses, breaths), and their number, one row per key."""
    return described(events, keys, {f"{m}_": (F.col(m), None) for m in measures}, {"n_events": F.count("*")})


def breath_measures(peaks: DataFrame, troughs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, out_breath, in_breath from rows (keys, n, amplitude): n-th peak minus n-th trough, next peak minus trough; whole numbers."""
    t = troughs.select(*keys, "n", F.col("amplitude").alias("__t"))
    nxt = F.lead("amplitude").over(Window.partitionBy(*keys).orderBy("n"))
    both = peaks.withColumn("__next", nxt).join(t, [*keys, "n"])
    return both.select(*keys, "n", (F.col("amplitude") - F.col("__t")).cast("int").alias("out_breath"), (F.col("__next") - F.col("__t")).cast("int").alias("in_breath"))


def level_statistics(coefs: DataFrame, keys: Sequence[str], signal: str, levels: Sequence[int]) -> DataFrame:
    """Statistics per wavelet level, one row per key, columns <signal>_wavelet_l<level>_<stat>."""
    aggs = []
    for level in levels:
        c = F.when(F.col("level") == level, F.col("coef"))
        aggs += [s.alias(f"{signal}_wavelet_l{level}_{n}") for n, s in stats_of(c).items()]
    return coefs.groupBy(*keys).agg(*aggs)
