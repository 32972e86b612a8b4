"""Numpy helpers for spectra of one segment.  No Spark here."""

from __future__ import annotations

import math

import numpy as np


def cubic_resample(t: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """Not-a-knot cubic spline through (t, y), sampled at ``rate`` from the first to the last time."""
    return cubic_spline(t, y, np.arange(t[0], t[-1] + 1e-12, 1 / rate))


def cubic_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline through (t, y); through less than four points, the polynomial."""
    n = len(t)
    if n < 4:
        return np.polyval(np.polyfit(t - t[0], y, n - 1), at - t[0])
    h, slope = np.diff(t), np.diff(y) / np.diff(t)
    # Second derivatives m: tridiagonal inside, equal third derivatives at the second and the last but one knot.
    lower, diag, upper, rhs = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    a0, a1, b0, b1 = h[0], h[1], h[-1], h[-2]
    diag[0] += lower[0] * (a0 + a1) / a1
    upper[0] -= lower[0] * a0 / a1
    diag[-1] += upper[-1] * (b0 + b1) / b1
    lower[-1] -= upper[-1] * b0 / b1
    for i in range(1, n - 2):
        w = lower[i] / diag[i - 1]
        diag[i] -= w * upper[i - 1]
        rhs[i] -= w * rhs[i - 1]
    m = np.zeros(n)
    m[n - 2] = rhs[-1] / diag[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (rhs[i] - upper[i] * m[i + 2]) / diag[i]
    m[0] = ((a0 + a1) * m[1] - a0 * m[2]) / a1
    m[-1] = ((b0 + b1) * m[-2] - b0 * m[-3]) / b1
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    u, v, w = at - t[k], t[k + 1] - at, h[k]
    return (m[k] * v**3 + m[k + 1] * u**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * v + (y[k + 1] / w - m[k + 1] * w / 6) * u


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(x: np.ndarray, fs: float, nperseg: int, nfft: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density: mean of Hamming-windowed, demeaned segments' periodograms."""
    nperseg = min(nperseg, len(x))
    nfft = max(nfft, nperseg)
    step = max(nperseg - int(nperseg * overlap), 1)
    w = hamming(nperseg)
    parts = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step]
    parts = parts - parts.mean(axis=1, keepdims=True)
    p = (np.abs(np.fft.rfft(parts * w, nfft)) ** 2).mean(axis=0) / (fs * (w**2).sum())
    p[1 : None if nfft % 2 else -1] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), p


def lomb(t: np.ndarray, x: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Lomb-Scargle power of a demeaned, unevenly sampled series; power at zero is 0."""
    x = x - x.mean()
    w = 2 * np.pi * freqs[:, None]
    tau = np.arctan2(np.sin(2 * w * t).sum(axis=1), np.cos(2 * w * t).sum(axis=1))[:, None] / 2
    c, s = np.cos(w * t - tau), np.sin(w * t - tau)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = 0.5 * ((c @ x) ** 2 / (c * c).sum(axis=1) + (s @ x) ** 2 / (s * s).sum(axis=1))
    p[freqs == 0] = 0
    return p


def autocorrelations(x: np.ndarray, lags: int, norm: str = "biased") -> np.ndarray:
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x, size)
    r = np.fft.irfft(f * np.conj(f), size)[: lags + 1]
    if norm == "unbiased":
        return r / (n - np.arange(lags + 1))
    return r / n if norm == "biased" else r / r[0] if norm == "coeff" else r


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """AR coefficients (without the leading 1) and noise variance from autocorrelations."""
    a, e = np.zeros(0), float(r[0])
    for m in range(order):
        k = -(r[m + 1] + a @ r[m:0:-1]) / e if e else 0.0
        a = np.append(a + k * a[::-1], k)
        e *= 1 - k * k
    return a, e


def burg(x: np.ndarray, order: int) -> list[tuple[np.ndarray, float]]:
    """(AR coefficients, noise variance) of every order up to ``order``, by Burg's recursion."""
    f, b = x[1:].astype(float), x[:-1].astype(float)
    a, e, out = np.zeros(0), float(np.mean(np.abs(x) ** 2)), []
    for _ in range(order):
        den = f @ f + b @ b
        k = -2 * (f @ b) / den if den else 0.0
        a = np.append(a + k * a[::-1], k)
        e *= 1 - k * k
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
        out.append((a, e))
    return out


def order_criteria(n: int, k: int, rho: float) -> dict[str, float]:
    """Criteria of an AR model of order k with noise variance rho on n samples; the smallest is the best."""
    log = math.log(max(rho, 1e-300))
    return {
        "AIC": n * log + 2 * (k + 1),
        "AICc": log + 2 * (k + 1) / (n - k - 2) if n > k + 2 else math.inf,
        "KIC": log + 3 * (k + 1) / n,
        "AKICc": log + k / n / (n - k) + (3 - (k + 2) / n) * (k + 1) / (n - k - 2) if n > k + 2 else math.inf,
        "FPE": rho * (n + k + 1) / (n - k - 1) if n > k + 1 else math.inf,
        "MDL": n * log + k * math.log(n),
    }


def ar_psd(a: np.ndarray, rho: float, fs: float, nfft: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of an AR model."""
    full = np.fft.rfft(np.r_[1.0, a], nfft)
    p = rho / fs / np.abs(full) ** 2
    p[1 : None if nfft % 2 else -1] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), p


def periodogram(x: np.ndarray, fs: float, nfft: int, window: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    w = np.ones(len(x)) if window is None else window
    p = np.abs(np.fft.rfft(x * w, nfft)) ** 2 / (fs * (w**2).sum())
    p[1 : None if nfft % 2 else -1] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), p


def daniell(x: np.ndarray, fs: float, nfft: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Periodogram averaged over 2 half + 1 neighbouring frequencies, fewer at the ends."""
    f, p = periodogram(x, fs, nfft)
    c = np.concatenate([[0.0], np.cumsum(p)])
    lo, hi = np.maximum(np.arange(len(p)) - half, 0), np.minimum(np.arange(len(p)) + half + 1, len(p))
    return f, (c[hi] - c[lo]) / (hi - lo)


def correlogram(x: np.ndarray, fs: float, nfft: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Transform of the Hamming-tapered biased autocorrelation; one-sided."""
    r = autocorrelations(x, lags) * (0.54 + 0.46 * np.cos(np.pi * np.arange(lags + 1) / lags))
    f = np.fft.rfftfreq(nfft, 1 / fs)
    p = r[0] + 2 * np.cos(2 * np.pi * np.outer(f / fs, np.arange(1, lags + 1))) @ r[1:]
    p = np.maximum(p, 0) / fs
    p[1 : None if nfft % 2 else -1] *= 2
    return f, p
