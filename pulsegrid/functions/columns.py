"""Column expressions shared by the operators.  All run inside Spark's generated code; none is a Python function."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or the result is not finite."""
    return finite(F.try_divide(a, b))


def nearest_multiple(c: Column, step: float) -> Column:
    """Nearest multiple of step, ties to the even one."""
    return F.bround(c / step) * step


def power_to_db(c: Column) -> Column:
    return F.when(c > 0, 10 * F.log10(c))


def db_to_power(c: Column) -> Column:
    return F.pow(F.lit(10.0), c / 10)


def magnitude_to_db(c: Column) -> Column:
    return F.when(c > 0, 20 * F.log10(c))


def db_to_magnitude(c: Column) -> Column:
    return F.pow(F.lit(10.0), c / 20)


def next_power_of_two(c: Column) -> Column:
    """Exponent of the smallest power of two that is not below c."""
    return F.when(c > 0, F.ceil(F.round(F.log2(c), 12))).cast("int")


def taper(kind: str, n: Column, size: Column, alpha: float | None = None) -> Column:
    """Weight n (from 0) of a taper with ``size`` weights; 1 for a single weight."""
    turn = 2 * math.pi * n / (size - 1)
    half = (size - 1) / 2
    if kind == "rectangle":
        w = F.lit(1.0)
    elif kind == "bartlett":
        w = 1 - F.abs((n - half) / half)
    elif kind == "hann":
        w = 0.5 - 0.5 * F.cos(turn)
    elif kind == "hamming":
        w = 0.54 - 0.46 * F.cos(turn)
    elif kind == "blackman":
        a = 0.16 if alpha is None else alpha
        w = (1 - a) / 2 - 0.5 * F.cos(turn) + a / 2 * F.cos(2 * turn)
    elif kind == "cosine":
        w = F.sin(math.pi * n / (size - 1))
    elif kind == "gaussian":
        a = 2.5 if alpha is None else alpha
        w = F.exp(-0.5 * F.pow(a * (n - half) / (size / 2), F.lit(2.0)))
    else:
        raise ValueError(f"unknown taper {kind!r}")
    return F.when(size == 1, 1.0).otherwise(w)


def one_sided(psd: Column) -> Column:
    """Folds a two-sided PSD array: the first half doubled, its first value kept, its last one that of the two-sided array."""
    n = F.size(psd)
    half = F.slice(psd, F.lit(1), (n / 2).cast("int") + 1)
    last = F.size(half) - 1
    return F.transform(half, lambda x, i: F.when(i == 0, x).when(i == last, F.element_at(psd, -1)).otherwise(2 * x))


def two_sided(psd: Column) -> Column:
    """Unfolds a one-sided PSD array of even length: inner values halved and mirrored."""
    last = F.size(psd) - 1
    halved = F.transform(psd, lambda x, i: F.when((i == 0) | (i == last), x).otherwise(x / 2))
    inner = F.slice(halved, F.lit(2), last - 1)
    return F.concat(F.slice(halved, F.lit(1), last), F.slice(psd, last + 1, F.lit(1)), F.reverse(inner))


def week_period(day: Column) -> Column:
    """Year and week of the year as yyyyww; weeks begin on Monday, days before the first Monday are week 0."""
    week = F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7)
    return (F.year(day) * 100 + week).cast("int")


#: The percentiles of descriptive statistics, as shares.
PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def at_percents(points: Column) -> dict[str, Column]:
    """Names of the entries of an array of the PERCENTS."""
    return {f"n{round(100 * p)}": points[i] for i, p in enumerate(PERCENTS)} | {"median": points[2]}


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """low (1 - share) + high share, the first product not rounded before the sum, as SQL engines with fused multiply-add do.

    Between values of opposite signs the sum may be zero but for rounding; as the base of a ratio, what is left then counts.
    """

    def halves(x: Column) -> tuple[Column, Column]:
        top = x * 134217729.0 - (x * 134217729.0 - x)
        return top, x - top

    rest = 1 - share
    (a, b), (c, d), product = halves(low), halves(rest), low * rest
    lost = F.nanvl(((a * c - product) + a * d + b * c) + b * d, F.lit(0.0))  # what the product's rounding took
    return (product + high * share) + lost


def percents_of(values: Column) -> Column:
    """The PERCENTS of a sorted array, null of an empty one."""
    at = lambda p: (F.size(values) - 1) * p
    ends = lambda p: F.struct(F.get(values, F.floor(at(p)).cast("int")).alias("low"), F.get(values, F.ceil(at(p)).cast("int")).alias("high"), (at(p) - F.floor(at(p))).alias("share"))
    return F.transform(F.transform(F.array(*(F.lit(p) for p in PERCENTS)), ends), lambda e: interpolated(e["low"], e["high"], e["share"]))


def stats_of(c: Column, zero_crossings: Column | None = None, percentiles: bool = True) -> dict[str, Column]:
    """Descriptive statistics of a signal inside a group, as named aggregates.

    zero_crossings: a column that is 1 where the signal changes sign against the sample before.  percentiles: whether to
    give those, which hold the distinct values of a group.
    """
    x = finite(c)
    points = at_percents(F.percentile(x, F.array(*(F.lit(p) for p in PERCENTS)))) if percentiles else {}
    out = {n: p for n, p in points.items() if n != "median"} | {"max": F.max(x), "mean": F.avg(x), "min": F.min(x)}
    out |= {n: p for n, p in points.items() if n == "median"}
    out |= {"std": F.stddev_pop(x), "rms": F.sqrt(F.avg(x * x)), "mean_abs": F.avg(F.abs(x))}
    if zero_crossings is not None:
        out["zero_crossings"] = F.coalesce(F.sum(zero_crossings), F.lit(0)).cast("long")
    return out


def cell_technology(band: Column) -> Column:
    return F.when(band.startswith("UMTS"), "3G").when(band.startswith("LTE"), "4G").when(band.startswith("GSM"), "2G")


def technologies_of_bands(bands: Column) -> Column:
    """Technologies of a site from its bands, as in ``4G_3G_2G``."""
    parts = [F.when(bands.contains(a), b) for a, b in (("LTE", "4G"), ("UMTS", "3G"), ("GSM", "2G"))]
    return F.concat_ws("_", *parts)


UMTS_CARRIERS = ("F1", "F2", "F3", "U1", "U2")
LTE_BANDS = ("LTE1800", "LTE2100", "LTE900")


def bands_of_technology(bands: Column, tech: Column) -> Column:
    """Bands of one technology in a ``_``-joined list: sorted carriers for 3G, band and width for 4G, else null."""
    parts = F.split(bands, "_")
    carriers = F.array_compact(F.flatten(F.transform(parts, lambda b: F.array(*(F.when(b.contains(c), c) for c in UMTS_CARRIERS)))))
    widths = F.array_compact(F.flatten(F.transform(parts, lambda b: F.array(*(F.when(b.contains(c), F.concat(F.lit(c), b.substr(F.length(b) - 2, F.lit(2)))) for c in LTE_BANDS)))))
    return F.when(tech == "3G", F.array_join(F.array_sort(carriers), "_")).when(tech == "4G", F.array_join(F.array_sort(widths), "_"))


def leading_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
