"""Power spectra of segments and their band tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spectral as P
from .signals import _filled, sorted_groups

#: Hz.  Both ends belong to a band.
BANDS = (("vlf", 0.0, 0.04), ("lf", 0.04, 0.15), ("hf", 0.15, 0.4))


def _estimate(method: str, t: np.ndarray, x: np.ndarray, options: dict) -> tuple[np.ndarray, np.ndarray]:
    """t in seconds and x of one segment -> frequencies, powers.  Methods on even grids resample at ``rate``."""
    if len(x) < options.get("least", 4):
        return np.zeros(0), np.zeros(0)
    if method == "lomb":
        f = np.linspace(0, 0.41, options.get("nfft", 256))
        return f, P.lomb(t, x, f)
    rate, nfft = options.get("rate", 4.0), options.get("nfft", 4096)
    y = P.cubic_resample(t, x, rate) if options.get("resample", True) else x
    y = y - y.mean()
    if method == "welch":
        short = t[-1] - t[0] < 300
        return P.welch(y, rate, options.get("nperseg", min(4096, len(y)) if short else 300), nfft)
    order = min(options.get("order", 16), len(y) - 1)
    if method == "yule-walker":
        return P.ar_psd(*P.levinson(P.autocorrelations(y, order), order), rate, nfft)
    if method == "burg":
        return P.ar_psd(*P.burg(y, order)[-1], rate, nfft)
    nfft = max(nfft, len(y))
    if method == "periodogram":
        return P.periodogram(y, rate, nfft)
    if method == "daniell":
        return P.daniell(y, rate, nfft, options.get("half", 8))
    if method == "correlogram":
        return P.correlogram(y, rate, nfft, min(options.get("lags", 64), len(y) - 1))
    raise ValueError(f"unknown method {method!r}")


def power_spectra(df: DataFrame, keys: Sequence[str], value: str = "nn", time: str = "time", method: str = "welch", **options) -> DataFrame:
    """keys, freq, power; keys name one segment (recording and segment).  Segments with too few values give no rows."""

    def f(t):
        freq, power = _estimate(method, t.column(time).to_numpy().astype(float), _filled(t.column(value)), options)
        return {"freq": freq, "power": power}

    return sorted_groups(df, keys, time, f, {"freq": pa.float64(), "power": pa.float64()}, "freq double, power double")


def ar_order_table(df: DataFrame, keys: Sequence[str], value: str, order: str = "idx", most: int = 20) -> DataFrame:
    """keys, ar_order, rho and the criteria of every order; ``best_order`` picks by one."""

    def f(t):
        x = _filled(t.column(value))
        x = x - x.mean() if len(x) else x
        n = len(x)
        table = [(k + 1, rho, P.order_criteria(n, k + 1, rho)) for k, (_, rho) in enumerate(P.burg(x, min(most, max(n - 2, 0))))] if n > 3 else []
        return {"ar_order": [k for k, _, _ in table], "rho": [r for _, r, _ in table]} | {c: [d[c] for _, _, d in table] for c in ("AIC", "AICc", "KIC", "AKICc", "FPE", "MDL")}

    kinds = {"ar_order": pa.int32(), "rho": pa.float64()} | {c: pa.float64() for c in ("AIC", "AICc", "KIC", "AKICc", "FPE", "MDL")}
    return sorted_groups(df, keys, order, f, kinds, "ar_order int, rho double, " + ", ".join(f"{c} double" for c in ("AIC", "AICc", "KIC", "AKICc", "FPE", "MDL")))


def best_order(table: DataFrame, keys: Sequence[str], criterion: str = "AIC") -> DataFrame:
    return table.groupBy(*keys).agg(F.min_by("ar_order", F.struct(criterion, "ar_order")).alias("ar_order"))


def band_powers(spectrum: DataFrame, keys: Sequence[str], bands: Sequence[tuple[str, float, float]] = BANDS) -> DataFrame:
    """Per segment: power, peak frequency, share, logarithm of each band, normalised LF and HF, their ratio, the total.

    Power is the sum times the frequency step; a frequency on the border of two bands counts in both.  The bands are a
    handful of conditions, so one aggregate over the spectrum does it.
    """
    w = Window.partitionBy(*keys).orderBy("freq")
    own = spectrum.withColumn("__df", F.col("freq") - F.lag("freq").over(w))
    aggs = [F.max("__df").alias("__df")]
    for name, lo, hi in bands:
        inside = F.col("freq").between(lo, hi)
        aggs += [F.sum(F.when(inside, F.col("power"))).alias(name), F.max_by(F.when(inside, F.col("freq")), F.when(inside, F.struct("power", -F.col("freq")))).alias(f"{name}_peak")]
    return _told(own.groupBy(*keys).agg(*aggs), bands)


def segment_bands(df: DataFrame, keys: Sequence[str], value: str = "nn", time: str = "time", method: str = "welch", bands: Sequence[tuple[str, float, float]] = BANDS, **options) -> DataFrame:
    """``band_powers`` of ``power_spectra``, each segment's spectrum being summed where it is made: one row per segment leaves a task."""
    fields = {"__df": pa.float64()} | {f"{n}{end}": pa.float64() for n, _, _ in bands for end in ("", "_peak")}

    def f(t):
        freq, power = _estimate(method, t.column(time).to_numpy().astype(float), _filled(t.column(value)), options)
        if not len(freq):
            return {c: [] for c in fields}
        out = {"__df": [float(np.diff(freq).max()) if len(freq) > 1 else None]}
        for name, lo, hi in bands:
            inside = np.flatnonzero((freq >= lo) & (freq <= hi))
            out[name] = [float(power[inside].sum()) if len(inside) else None]
            out[f"{name}_peak"] = [float(freq[inside[power[inside].argmax()]]) if len(inside) else None]
        return out

    return _told(sorted_groups(df, keys, time, f, fields, ", ".join(f"`{c}` double" for c in fields)), bands)


def _told(out: DataFrame, bands: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Band table from the sums and peaks of the bands and the frequency step."""
    names = [b[0] for b in bands]
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) * F.col("__df") for n in names})
    total = sum((F.col(n) for n in names), F.lit(0.0))
    out = out.withColumn("total", total)
    out = out.withColumns({f"{n}_percent": F.try_divide(F.col(n) * 100, F.col("total")) for n in names} | {f"{n}_log": F.when(F.col(n) > 0, F.ln(F.col(n))) for n in names})
    if {"lf", "hf"} <= set(names):
        both = F.col("lf") + F.col("hf")
        out = out.withColumns({"lf_norm": F.try_divide(F.col("lf") * 100, both), "hf_norm": F.try_divide(F.col("hf") * 100, both), "lf_hf": F.try_divide("lf", "hf")})
    return out.drop("__df")


def frames(df: DataFrame, keys: Sequence[str], width: int, step: int, order: str = "idx", drop_last: int = 0) -> DataFrame:
    """Adds frame: windows of ``width`` rows every ``step`` rows; incomplete and the last ``drop_last`` frames are left out."""
    at = F.col(order)
    first, last = F.greatest(F.ceil((at - width + 1) / step), F.lit(0)), F.floor(at / step)
    spread = df.withColumn("frame", F.explode(F.when(first <= last, F.sequence(first, last))))
    rows = df.groupBy(*keys).agg((F.floor((F.max(order) + 1 - width) / step) + 1 - drop_last).alias("__frames"))
    return spread.join(rows, list(keys)).where(F.col("frame") < F.col("__frames")).drop("__frames")
