"""Rolling values of any measure around each beat, and their cubic resampling, on chunks with a halo.

Chunks are groups of bounded size, so a recording may be as long as the table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signals import sample_entropy
from ..functions.spectral import cubic_spline, lomb
from .ranges import attached, places
from .signals import by_group, sorted_groups, with_halo

#: Knots beside a chunk: what a spline takes from a knot fades by more than 3.7 with each knot between.
FADING = 64


def rmssd(nn: np.ndarray) -> float | None:
    return float(np.sqrt((np.diff(nn) ** 2).mean())) if len(nn) > 1 else None


def pnn50(nn: np.ndarray) -> float | None:
    return float(100 * (np.abs(np.diff(nn)) > 50).mean()) if len(nn) > 1 else None


def lf_hf(nn: np.ndarray) -> float | None:
    """Power at 0.04 to 0.15 Hz over that at 0.15 to 0.4 Hz, by Lomb's method on the beats' own times."""
    if len(nn) < 4:
        return None
    freqs = np.arange(0.04, 0.4, 0.005)
    power = lomb(np.cumsum(nn) / 1000, nn - nn.mean(), freqs)
    high = power[freqs > 0.15].sum()
    return float(power[freqs <= 0.15].sum() / high) if high > 0 else None


#: Measures of NN intervals in ms that are no aggregates of single beats.
MEASURES: dict[str, Callable[[np.ndarray], float | None]] = {"rmssd": rmssd, "pnn50": pnn50, "sampen": sample_entropy, "lf_hf": lf_hf}


def rolling_measures(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Callable[[np.ndarray], float | None]], n: int | None = None, seconds: float | None = None, order: str = "beat", clock: str = "time", chunk: float = 4096) -> DataFrame:
    """df with one column per measure, a function of the values of the n beats, or the seconds, around each beat.

    Windows are those of ``series.rolling``: beats i - n .. i + n, at the start 0 .. i + n, at the end i - n .. i - 1; or
    clock +- seconds.  The first beat of a recording is left out.  Values that are null or not finite are left out of a
    window; an empty window, and a result that is missing or not finite, give null.  Rows go to the chunk (of ``chunk`` beats
    or seconds, or of the reach if that is larger) of their place and to those whose windows need them.
    """
    columns, reach = df.columns, n if seconds is None else round(seconds * 1_000_000)
    rows = places(df, keys, [order])
    place = F.col("__at") if seconds is None else F.round(F.col(clock) * 1_000_000).cast("long")
    width = max(round(chunk if seconds is None else chunk * 1_000_000), reach, 1)
    own = F.floor(F.col("__place") / width)
    rows = rows.drop("__pid").withColumn("__place", place).where("__place IS NOT NULL")
    spread = rows.withColumn("__chunk", F.explode(F.sequence(F.floor((F.col("__place") - reach) / width), F.floor((F.col("__place") + reach) / width)))).withColumn("__own", F.col("__chunk") == own)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        at, total, place = (table.column(c).to_numpy() for c in ("__at", "__n", "__place"))
        x = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        wanted = table.column("__own").to_numpy(zero_copy_only=False).astype(bool) & (at > 0)
        ends = np.where(at + n >= total, at - 1, at + n) if seconds is None else place + reach
        found: dict[str, list] = {m: [] for m in measures}
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
            mine = lo + np.flatnonzero(wanted[lo:hi])
            firsts = lo + np.searchsorted(place[lo:hi], place[mine] - reach)
            lasts = lo + np.searchsorted(place[lo:hi], ends[mine], side="right")
            for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
                window = x[first:last]
                window = window[np.isfinite(window)]
                for m, f in measures.items():
                    v = f(window) if len(window) else None
                    found[m].append(None if v is None or not np.isfinite(v) else float(v))
        out = table.filter(pa.array(wanted)).select(columns)
        for m, values in found.items():
            out = out.append_column(m, pa.array(values, pa.float64()))
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"`{m}` double" for m in measures])
    return by_group(spread, [*keys, "__chunk"], ["__place", "__at"], run, schema)


def resampled(df: DataFrame, keys: Sequence[str], value: str, rate: float, time: str = "time", chunk: int = 4096) -> DataFrame:
    """keys, time, value: the not-a-knot cubic spline through a recording's points, ``rate`` times a second from its first time.

    Points without a finite value or time are left out; of points of one time, the one with the least value stays.
    """
    x, t = F.col(value).cast("double"), F.col(time).cast("double")
    good = df.select(*keys, t.alias("__t"), x.alias("__x")).where("abs(__t) < double('Infinity') AND abs(__x) < double('Infinity')")
    rows = places(good.groupBy(*keys, "__t").agg(F.min("__x").alias("__x")), keys, ["__t"])
    rows = attached(rows, keys, good.groupBy(*keys).agg(F.min("__t").alias("__zero"))).drop("__pid")

    def run(table: pa.Table) -> dict[str, list]:
        t, x, at, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("__t", "__x", "__at", "__own"))
        mine, zero = np.flatnonzero(own.astype(bool)), table.column("__zero")[0].as_py()
        whole = at[mine[-1]] + 1 == table.column("__n")[0].as_py()
        end = t[mine[-1]] + 1e-12 if whole else t[mine[-1] + 1]
        k = np.arange(np.floor((t[mine[0]] - zero) * rate) - 1, np.ceil((end - zero) * rate) + 1)
        grid = zero + k / rate
        grid = grid[(grid >= t[mine[0]]) & ((grid <= end) if whole else (grid < end))]
        y = cubic_spline(t, x, grid)
        return {"time": grid.tolist(), "value": y.tolist()}

    spread = with_halo(rows, keys, chunk, min(FADING, chunk - 1), "__at")
    # A chunk behind the last row gets that row's halo only.
    spread = spread.where(F.col("__chunk") <= F.floor((F.col("__n") - 1) / chunk))
    return sorted_groups(spread, [*keys, "__chunk"], "__t", run, {"time": pa.float64(), "value": pa.float64()}, "time double, value double").drop("__chunk")
