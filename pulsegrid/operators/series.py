"""Sample series: gaps, outliers, pooling, resampling, rolling values, activity.

Keys partition every window; ``order`` gives the position.  Nulls are gaps.  Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .ranges import attached, filled, places
from .selection import LARGE, percentiles, split_by_size


def _interpolated(good: Column, position: Column, w) -> tuple[Column, Column, Column, Column]:
    """Last good value and its position up to a row, first good value and its position from it on."""
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(good.isNotNull(), position)
    return F.last(good, ignorenulls=True).over(up), F.last(at, ignorenulls=True).over(up), F.first(good, ignorenulls=True).over(down), F.first(at, ignorenulls=True).over(down)


def _line(a: Column, pa: Column, b: Column, pb: Column, at: Column) -> Column:
    return F.when(pa == pb, a).otherwise(a + (b - a) * (at - pa) / (pb - pa))


def fill_gaps(df: DataFrame, keys: Sequence[str], value: str, order: str = "idx") -> DataFrame:
    """Linear between neighbours; a leading gap stays null, a trailing one takes the last value."""
    a, pa, b, pb = _interpolated(F.col(value), F.col(order), Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(value, F.when(a.isNull(), F.lit(None)).when(b.isNull(), a).otherwise(_line(a, pa, b, pb, F.col(order))))


def repair_outliers(long: DataFrame, keys: Sequence[str], order: str, value: str = "value", method: str = "median", alpha: float = 1.0, beta: float = 3.0, large: int | None = LARGE) -> DataFrame:
    """Values outside alpha m +- beta s of their group are interpolated over the position in the group, clamped at its ends.

    m: median or mean, s: sample deviation.  long: one row per (keys, order); put the feature's name among the keys to
    repair all features at once.  A group without deviation (one row) keeps its values.  Adds old (the value before) and
    repaired (whether it changed).  Groups of more than ``large`` rows are ranked over range partitions and their median is found
    without holding their values; None takes all as small and saves the count of the groups.
    """
    x = finite(F.col(value))
    few, many = split_by_size(long, keys, large)
    keep = F.col("__s").isNull() | F.isnan("__s") | x.between(alpha * F.col("__m") - beta * F.col("__s"), alpha * F.col("__m") + beta * F.col("__s"))
    known = reduce(lambda p, q: p & q, (F.col(k).isNotNull() for k in keys), F.lit(True))
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one shuffle and one sort serve statistics and neighbours
    middle = F.percentile(x, F.lit(0.5)) if method == "median" else F.avg(x)
    own = few.where(known).withColumns({"__m": middle.over(whole), "__s": F.stddev_samp(x).over(whole), "__at": F.row_number().over(w)}).withColumn("__good", F.when(keep, x))
    a, pa, b, pb = _interpolated(F.col("__good"), F.col("__at"), w)
    new = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(_line(a, pa, b, pb, F.col("__at")))
    own = own.withColumn("__new", new)
    if many is not None:
        rows = places(many, keys, [order])
        told = many.groupBy(*keys).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
        if method == "median":
            held = percentiles(many, keys, F.col(value), (0.5,), large).select(*keys, F.col("points")[0].alias("__m"))
            told = told.drop("__m").join(held, list(keys), "left")
        judged = attached(rows, keys, told).withColumn("__new", F.when(keep, x)).where(known)
        own = own.select(*long.columns, "__new").unionByName(filled(judged, keys, [order], "__new").select(*long.columns, "__new"))
    own = own.select(*long.columns, "__new").withColumn("old", F.col(value)).withColumn(value, F.col("__new"))
    return own.withColumn("repaired", ~F.col("old").eqNullSafe(F.col(value))).drop("__new")


def pooled_max(df: DataFrame, keys: Sequence[str], value: str, size: float, time: str = "time", right_closed: bool = False) -> DataFrame:
    """Every sample takes the maximum of its bucket of ``size`` seconds.  Adds <value>_pooled."""
    start = F.min(time).over(Window.partitionBy(*keys))
    at = (F.col(time) - start) / size
    bucket = F.greatest(F.ceil(at) - 1, F.lit(0)) if right_closed else F.floor(at)
    df = df.withColumn("__bucket", bucket)
    return df.withColumn(f"{value}_pooled", F.max(value).over(Window.partitionBy(*keys, "__bucket"))).drop("__bucket")


def to_8hz(df: DataFrame, keys: Sequence[str], value: str, rate: int, order: str = "idx") -> DataFrame:
    """keys, tick, value on the 125 ms grid: every (rate / 8)th sample, or (rates 1, 2, 4) interpolated between samples."""
    if rate >= 8:
        step = rate // 8
        return df.where(F.col(order) % step == 0).select(*keys, (F.col(order) / step).cast("long").alias("tick"), value)
    step = 8 // rate
    last = df.groupBy(*keys).agg(F.max(order).alias("__last"))
    grid = last.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last") * step)).alias("tick"))
    known = df.select(*keys, (F.col(order) * step).cast("long").alias("tick"), value)
    return fill_gaps(grid.join(known, [*keys, "tick"], "left"), keys, value, "tick")


def fill_missing_chunks(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "chunk") -> DataFrame:
    """Forward fill; a leading gap takes the first value there is."""
    w = Window.partitionBy(*keys).orderBy(order)
    up, all_ = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({v: F.coalesce(F.last(v, ignorenulls=True).over(up), F.first(v, ignorenulls=True).over(all_)) for v in values})


def rest_baseline(df: DataFrame, keys: Sequence[str], value: str, rest: Column, how: str = "divide") -> DataFrame:
    """Value divided by, or minus, its mean over the recording's rest rows."""
    mean = F.avg(F.when(rest, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.try_divide(F.col(value), mean) if how == "divide" else F.col(value) - mean)


def range_baseline(df: DataFrame, keys: Sequence[str], rests: dict[str, Column], tonic: str = "tonic", phasic: str = "phasic", changing: str = "eda", order: str = "idx", time: str = "time", fallback_s: float = 300.0) -> DataFrame:
    """(tonic - lowest rest tonic) / (highest tonic - lowest rest tonic) + phasic / highest phasic, for each rest phase.

    rests: name -> which rows are of that phase.  Adds corrected_<name>.  Rows of the first phase count after the first
    change of ``changing`` only.  Without rows of any phase, the phases are the ``fallback_s`` seconds from that change on,
    one after the other.
    """
    p = Window.partitionBy(*keys)
    w = p.orderBy(order)
    moved = F.col(changing) != F.lead(changing).over(w)
    df = df.withColumns({"__moves": F.when(moved, F.col(order)), "__at": F.when(moved, F.col(time))})
    df = df.withColumns({"__first": F.min("__moves").over(p), "__clock": F.min("__at").over(p)})
    aggs = [F.max(tonic).alias("__top"), F.max(phasic).alias("__high")]
    for i, rest in enumerate(rests.values()):
        own = rest & (F.col(order) > F.col("__first")) if i == 0 else rest
        since = F.col(time) - F.col("__clock")
        aggs += [F.min(F.when(own, F.col(tonic))).alias(f"__rest{i}"), F.min(F.when((since >= i * fallback_s) & (since < (i + 1) * fallback_s), F.col(tonic))).alias(f"__fall{i}")]
    stats = df.groupBy(*keys).agg(*aggs)
    none = F.coalesce(*(F.col(f"__rest{i}") for i in range(len(rests)))).isNull()
    out = df.join(stats, list(keys))
    for i, name in enumerate(rests):
        low = F.when(none, F.col(f"__fall{i}")).otherwise(F.col(f"__rest{i}"))
        out = out.withColumn(f"corrected_{name}", F.try_divide(F.col(tonic) - low, F.col("__top") - low) + F.try_divide(F.col(phasic), F.col("__high")))
    return out.drop("__moves", "__at", "__first", "__clock", "__top", "__high", *(f"__{k}{i}" for k in ("rest", "fall") for i in range(len(rests))))


def replace_artefacts(df: DataFrame, keys: Sequence[str], value: str, artefact: Column, phases: Column, half_s: float = 60.0, grid_s: float = 5.0, time: str = "time", order: str = "idx") -> DataFrame:
    """Artefact samples take the mean of clean samples of the driving phases with |time - their grid point| < half_s.

    Grid points are the times rounded to ``grid_s`` (ties to even).  Samples are grouped and clean ones added up by grid cell first,
    and a cell edge that lies exactly on an open end is left out, so a point costs as many rows as there are cells, not
    samples.  Cells and windows stay in the partitions of their recording: rows that are partitioned by ``keys`` are not shuffled.
    Points without clean samples take the next, then the last earlier value.  Adds <value>_clean.
    """
    cells = int(round(half_s / grid_s))
    t = F.col(time)
    cell, point = F.floor(t / grid_s), F.bround(t / grid_s).cast("long")
    clean = ~artefact & phases & F.col(value).isNotNull()
    edge = clean & (t == cell * grid_s)
    rows = F.struct(*(c for c in df.columns if c not in keys), F.coalesce(artefact, F.lit(False)).alias("__art"), (point - cell).alias("__up"))
    held = df.groupBy(*keys, cell.alias("__cell")).agg(
        F.sum(F.when(clean, F.col(value))).alias("__sum"), F.count_if(clean).alias("__n"),
        F.coalesce(F.sum(F.when(edge, F.col(value))), F.lit(0.0)).alias("__edge_sum"), F.count_if(edge).alias("__edge_n"), F.collect_list(rows).alias("__rows"),
    )
    # Cell j holds j g <= t < (j + 1) g.  Open interval around point p: cells p - n .. p + n - 1 without t = (p - n) g.  A sample's
    # point is the lower or the upper end of its own cell.
    along = Window.partitionBy(*keys).orderBy("__cell")

    def mean(up: int) -> Column:
        inner, first = along.rangeBetween(up - cells + 1, up + cells - 1), along.rangeBetween(up - cells, up - cells)
        zero = F.lit(0)
        total = F.coalesce(F.sum("__sum").over(inner), zero) + F.coalesce(F.sum(F.col("__sum") - F.col("__edge_sum")).over(first), zero)
        return F.try_divide(total, F.coalesce(F.sum("__n").over(inner), zero) + F.coalesce(F.sum(F.col("__n") - F.col("__edge_n")).over(first), zero))

    placed = reduce(lambda p, q: p & q, (F.col(k).isNotNull() for k in (*keys, "__cell")))
    means = held.withColumns({f"__mean{up}": mean(up) for up in (0, 1)}).select(*keys, placed.alias("__placed"), "__mean0", "__mean1", F.inline("__rows"))
    around = F.when(F.col("__placed"), F.when(F.col("__up") == 0, F.col("__mean0")).otherwise(F.col("__mean1")))
    own = means.withColumn("__new", F.when(F.col("__art"), around).otherwise(F.col(value)))
    w = Window.partitionBy(*keys).orderBy(order)
    following = F.first("__new", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    earlier = F.last("__new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select(*df.columns, F.coalesce(following, earlier).alias(f"{value}_clean"))


def motion(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))


def stillness(df: DataFrame, keys: Sequence[str], value: str, order: str = "tick", minute: int = 480, share: float = 0.95, limit: float = 0.1, absolute: bool = False) -> DataFrame:
    """Per minute of ticks: still if more than ``share`` of the steps are below ``limit``.  keys, minute, still.

    Steps are signed unless ``absolute``.
    """
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    step = F.abs(step) if absolute else step
    own = df.withColumn("__step", step).withColumn("minute", F.floor(F.col(order) / minute))
    return own.groupBy(*keys, "minute").agg((F.count_if(F.col("__step") < limit) / F.count("__step") > share).alias("still"))


def autocorrelation(df: DataFrame, keys: Sequence[str], value: str, lags: int, norm: str = "biased", order: str = "idx", other: str | None = None) -> DataFrame:
    """keys, lag, r: sum of x[i + lag] y[i] over i; biased: / N, unbiased: / (N - lag), coeff: / sqrt(r_xx r_yy), raw.

    Up to 50 lags are frames of one sorted window; more are sums over chunks of their spectral products.
    """
    if lags > 50:
        return _many_lags(df, keys, value, lags, norm, order, other)
    y = F.col(other or value)
    x = F.coalesce(F.col(value), F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(order)
    terms = df.select(*keys, *(F.lead(x, k).over(w).alias(f"__l{k}") for k in range(lags + 1)), F.coalesce(y, F.lit(0.0)).alias("__y"), x.alias("__x"))
    sums = terms.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(F.col("__x") ** 2).alias("__xx"), F.sum(F.col("__y") ** 2).alias("__yy"), *(F.sum(F.col(f"__l{k}") * F.col("__y")).alias(str(k)) for k in range(lags + 1)))
    long = sums.select(*keys, "__n", "__xx", "__yy", F.posexplode(F.array(*(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)) for k in range(lags + 1)))).alias("lag", "r"))
    n, lag = F.col("__n"), F.col("lag")
    by = {"biased": n, "unbiased": F.when(n > lag, n - lag), "coeff": F.sqrt(F.col("__xx") * F.col("__yy")), "raw": F.lit(1.0)}[norm]
    return long.select(*keys, "lag", F.try_divide(F.col("r"), by.cast("double")).alias("r"))


def _many_lags(df: DataFrame, keys: Sequence[str], value: str, lags: int, norm: str, order: str, other: str | None, n: int = 65_536) -> DataFrame:
    """Each chunk of n rows multiplies its y with its x and the ``lags`` rows that follow, by Fourier transform."""
    import numpy as np
    import pyarrow as pa

    x, y = F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.coalesce(F.col(other or value).cast("double"), F.lit(0.0))
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long")
    rows = df.select(*keys, place.alias("__at"), x.alias("__x"), y.alias("__y"))
    n = max(n, lags + 1)
    own = F.floor(F.col("__at") / n)
    to = F.array_compact(F.array(own, F.when((F.col("__at") % n < lags) & (own > 0), own - 1)))
    spread = rows.withColumn("__chunk", F.explode(to)).withColumn("__own", F.col("__chunk") == own)

    def products(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        x, own = table.column("__x").to_numpy(), table.column("__own").to_numpy(zero_copy_only=False).astype(bool)
        y = np.where(own, table.column("__y").to_numpy(), 0.0)
        size = 1 << (len(x) + lags).bit_length()
        r = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)[: lags + 1]
        mine = x[own]
        out = {k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=False)}
        return pa.table(out | {"__r": pa.array([r.tolist()], pa.list_(pa.float64())), "__n": pa.array([int(own.sum())]), "__xx": pa.array([float(mine @ mine)]), "__yy": pa.array([float(y @ y)])})

    kinds = dict(df.dtypes)
    parts = spread.groupBy(*keys, "__chunk").applyInArrow(products, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", __r array<double>, __n long, __xx double, __yy double")
    whole = parts.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.sum("__xx").alias("__xx"), F.sum("__yy").alias("__yy"))
    sums = parts.select(*keys, F.posexplode("__r").alias("lag", "__p")).groupBy(*keys, "lag").agg(F.sum("__p").alias("r")).join(whole, list(keys))
    n_, lag = F.col("__n"), F.col("lag")
    by = {"biased": n_, "unbiased": F.when(n_ > lag, n_ - lag), "coeff": F.sqrt(F.col("__xx") * F.col("__yy")), "raw": F.lit(1.0)}[norm]
    return sums.select(*keys, "lag", F.try_divide(F.col("r"), by.cast("double")).alias("r"))


def rolling(df: DataFrame, keys: Sequence[str], value: str, aggregates: dict, n: int | None = None, seconds: float | None = None, order: str = "beat", clock: str = "time") -> DataFrame:
    """Aggregates over the n beats, or the seconds, around each beat.

    Beats: i - n .. i + n, at the start 0 .. i + n, at the end i - n .. i - 1.  Seconds: clock +- seconds.  The first beat
    of a recording is left out.  aggregates: name -> function from a column to an aggregate column.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    count = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(w) - 1
    own = df.withColumns({"__at": at, "__count": count})
    if seconds is not None:
        ticks = F.round(F.col(clock) * 1_000_000).cast("long")  # range frames take whole numbers
        reach = round(seconds * 1_000_000)
        frame = Window.partitionBy(*keys).orderBy(ticks).rangeBetween(-reach, reach)
        out = own.withColumns({name: f(F.col(value)).over(frame) for name, f in aggregates.items()})
    else:
        whole, end = w.rowsBetween(-n, n), w.rowsBetween(-n, -1)
        late = F.col("__at") + n >= F.col("__count")
        out = own.withColumns({name: F.when(late, f(F.col(value)).over(end)).otherwise(f(F.col(value)).over(whole)) for name, f in aggregates.items()})
    return out.where("__at > 0").drop("__at", "__count")
