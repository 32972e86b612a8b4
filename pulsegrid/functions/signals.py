"""Numpy helpers for what is sequential inside one recording or segment.  No Spark here."""

from __future__ import annotations

import math
import re
from decimal import Decimal, localcontext
from functools import reduce

import numpy as np


def median_filter(x: np.ndarray, k: int) -> np.ndarray:
    """Sliding median of odd length k, zeros beyond the ends."""
    h = k // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x.astype(float), h), k), axis=1)


def butterworth(order: int, cutoff: float, fs: float, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter, by the bilinear transform."""
    warped = 2 * fs * math.tan(math.pi * cutoff / fs)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "high":
        poles = warped * warped / poles
    digital = (2 * fs + poles) / (2 * fs - poles)
    a = np.real(np.poly(digital))
    b = np.real(np.poly(np.full(order, -1.0 if kind == "low" else 1.0)))
    at = 1.0 if kind == "low" else -1.0  # unit gain at zero, or at half the rate
    return b * np.polyval(a, at) / np.polyval(b, at), a


def notch(frequency: float, fs: float, quality: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * math.pi * frequency / fs
    gain = 1 / (1 + math.tan(w / quality / 2))
    return gain * np.array([1, -2 * math.cos(w), 1]), np.array([1, -2 * gain * math.cos(w), 2 * gain - 1])


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Causal filtering, transposed direct form."""
    return lfilter_on(b, a, x, state)[0]


def lfilter_on(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered values, and the state from which the filter goes on."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    z = np.zeros(n) if state is None else np.append(state, 0.0)
    b, a, zs, out = b.tolist(), a.tolist(), z.tolist(), []
    for v in x.tolist():
        y = b[0] * v + zs[0]
        for i in range(1, n):
            zs[i - 1] = b[i] * v - a[i] * y + zs[i]
        out.append(y)
    return np.array(out), np.array(zs[:-1])


def lfilter_blocks(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """As ``lfilter_on``, with the samples of a block at once: what they do to its outputs and to the state are matrix products."""
    n = max(len(a), len(b))
    z = np.zeros(n - 1) if state is None else np.asarray(state, float)
    whole = len(x) // block
    if n > 1 and whole:
        bb, once = np.pad(b, (0, n - len(b))) / a[0], fading(b, a, 1)
        enters = bb[1:] + once[:, 0] * bb[0]  # what one sample adds to the state
        powers = [np.eye(n - 1)]
        for _ in range(block):
            powers.append(once @ powers[-1])
        seen = np.array([p[0] for p in powers[:block]])  # the state at the start of a block in its outputs
        answer = np.concatenate([[bb[0]], seen[:-1] @ enters])
        forced = np.array([[answer[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
        taken = np.array([powers[block - 1 - i] @ enters for i in range(block)])
        rows = x[: whole * block].reshape(whole, block)
        added, starts = rows @ taken, np.empty((whole, n - 1))
        for k in range(whole):
            starts[k] = z
            z = powers[block] @ z + added[k]
        head = (rows @ forced.T + starts @ seen.T).ravel()
    else:
        whole, head = 0, np.zeros(0)
    tail, z = lfilter_on(b, a, x[whole * block :], z)
    return np.concatenate([head, tail]), z


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state of a filter that has seen ones for ever."""
    n = max(len(a), len(b))
    bb = np.pad(b, (0, n - len(b))) / a[0]
    once = fading(b, a, 1)
    return np.linalg.solve(np.eye(n - 1) - once, bb[1:] + once[:, 0] * bb[0])


def fading(b: np.ndarray, a: np.ndarray, steps: int) -> np.ndarray:
    """Matrix that takes a filter's state over ``steps`` samples of silence."""
    n = max(len(a), len(b))
    a = np.pad(a, (0, n - len(a))) / a[0]
    once = np.eye(n - 1, k=1)
    once[:, 0] -= a[1:]
    return np.linalg.matrix_power(once, steps)


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering with odd padding of three times the filter's length."""
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    if pad < 1:
        return x.astype(float)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    n = max(len(a), len(b))
    bb, aa = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    companion = np.eye(n - 1) - np.column_stack([-aa[1:], np.eye(n - 1)[:, : n - 2]])
    steady = np.linalg.solve(companion, bb[1:] - aa[1:] * bb[0])
    once = lfilter(b, a, wide, steady * wide[0])
    back = lfilter(b, a, once[::-1], steady * once[-1])[::-1]
    return back[pad : len(back) - pad]


def repair_defects(x: np.ndarray, n_max: int = 700, edge: int = 200, reach: int = 600, floor: float = 20.0) -> np.ndarray:
    """Replaces defects of one trigger run by a quadratic fitted on both sides of them.

    A defect starts where |second difference| exceeds ``floor`` times its 0.8-quantile and reaches as far as such points
    follow within n_max samples; without any, the first difference is tried, against 5 times its 0.9-quantile.
    A defect too near the end is left, so a run shorter than ``reach`` stays; positions before the start are clamped.
    """
    out = x.astype(float).copy()
    if len(x) < reach:
        return out
    d2, d1 = np.abs(np.diff(x, 2)), np.abs(np.diff(x))
    at = np.flatnonzero(d2 > floor * np.quantile(d2, 0.8)) if len(d2) else np.array([], int)
    if not len(at) and len(d1):
        at = np.flatnonzero(d1 > 5 * np.quantile(d1, 0.9))
    if not len(at):
        return out
    breaks = np.flatnonzero(np.diff(at) > n_max)
    for lo, hi in zip(at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]], strict=True):
        if hi + reach > len(x):
            continue
        left, right = np.arange(max(lo - reach, 0), max(lo - edge, 0)), np.arange(hi + edge, hi + reach)
        around = np.concatenate([left, right])
        if len(around) < 3:
            continue
        middle = around.mean()
        fit = np.polyfit(around - middle, x[around], 2)
        inside = np.arange(max(lo - edge, 0), hi + edge)
        out[inside] = np.polyval(fit, inside - middle)
    return out


def find_peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima of at least ``height``, taken from the highest down, at least ``distance`` apart."""
    mid = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
    taken: list[int] = []
    blocked = np.zeros(len(x), bool)
    for i in mid[np.argsort(-x[mid], kind="stable")]:
        if not blocked[i]:
            taken.append(int(i))
            blocked[max(i - distance + 1, 0) : i + distance] = True
    return np.sort(np.array(taken, int))


def scr_peaks(x: np.ndarray, offset: float = 1.0, start_wt: float = 4.0, end_wt: float = 4.0, thres: float = 0.02, fs: int = 8) -> list[dict]:
    """Skin responses of one recording at fs Hz: one dict per peak.

    Apex: the sample before the last rising step, if offset * fs - 1 steps before it rise and as many after it fall.
    Onset: back from the apex to the first step below 1 % of the steepest one of the last second, at most start_wt
    seconds.  End: the first sample below half the amplitude (half recovery) within end_wt seconds, or the next onset if
    that comes first, else the lowest sample of that time.  Width and decay are those of half recovery, width from the
    last sample before the apex below half the amplitude; 0 without half recovery.
    """
    run, d, n = max(int(offset * fs), 1), np.diff(x), len(x)
    back, ahead = int(start_wt * fs), int(end_wt * fs)
    sign = np.sign(d)
    found = []
    for i in range(run, len(d) - run):
        if sign[i] == 1 and sign[i + 1] < 1 and (sign[i - run + 1 : i] == 1).all() and (sign[i + 1 : i + run] == -1).all():
            steepest = d[max(i - fs, 0) : i].max()
            slow = np.flatnonzero(d[max(i - back + 1, 0) : i + 1] < 0.01 * steepest)
            found.append((i, max(i - back + 1, 0) + int(slow[-1]) if len(slow) else max(i - back, 0), float(steepest * fs)))
    onsets = {start for _, start, _ in found}
    out = []
    for i, start, slope in found:
        amplitude = x[i] - x[start]
        if thres > 0 and amplitude < thres:
            continue
        half, stop = x[start] + amplitude / 2, min(i + ahead, n - 1)
        low = i + int(np.argmax(x[i:stop] < half)) if (x[i:stop] < half).any() else n
        onset = next((k for k in range(i, min(low, stop)) if k in onsets), None)
        decay = width = 0.0
        if onset is not None:
            end = onset
        elif low < n:
            rise = np.flatnonzero(x[: i + 1] < half)
            end, decay, width = low, (low - i) / fs, (low - (int(rise[-1]) if len(rise) else 0)) / fs
        else:
            end = i + int(np.argmin(x[i : i + ahead]))
        out.append({"apex": i, "start": start, "end": end, "amplitude": float(amplitude), "rise": (i - start) / fs, "decay": decay, "width": width, "auc": float(amplitude * width), "max_slope": slope})
    return out


def daubechies(n: int) -> np.ndarray:
    """Low-pass taps of the Daubechies wavelet with n vanishing moments, by spectral factorisation; n = 1 is Haar."""
    binomials = [math.comb(n - 1 + k, k) for k in range(n)]
    y_roots = np.roots(binomials[::-1]) if n > 1 else np.array([])
    taps = np.array([1.0 + 0j])
    for y in y_roots:  # y = (2 - z - 1/z) / 4: the root inside the unit circle
        z = np.roots([1, 4 * y - 2, 1])
        taps = np.convolve(taps, [1, -z[np.abs(z) < 1][0]])
    for _ in range(n):
        taps = np.convolve(taps, [1, 1])
    taps = np.real(taps)
    return taps * math.sqrt(2) / taps.sum()


def _solved(rows: list[list[Decimal]], right: list[Decimal]) -> list[Decimal]:
    """Linear equations by elimination with pivots."""
    table = [[*row, v] for row, v in zip(rows, right, strict=True)]
    for c in range(len(table)):
        best = max(range(c, len(table)), key=lambda r: abs(table[r][c]))
        table[c], table[best] = table[best], table[c]
        for r in range(len(table)):
            if r != c:
                part = table[r][c] / table[c][c]
                table[r] = [u - part * v for u, v in zip(table[r], table[c], strict=True)]
    return [row[-1] / row[i] for i, row in enumerate(table)]


def coiflet(n: int) -> np.ndarray:
    """Low-pass taps (6 n) of the Coiflet with 2 n vanishing moments of the wavelet and 2 n - 1 of the scaling function.

    A trigonometric polynomial that has these moments whatever its 2 n free coefficients is made orthonormal by Newton's
    method, from zero coefficients, in 60 digits (the equations are ill-conditioned).  Printed tables of the longer filters
    agree to their own precision, about five digits for n = 5.
    """

    def times(p, q):
        out = [Decimal(0)] * (len(p) + len(q) - 1)
        for i, u in enumerate(p):
            for j, v in enumerate(q):
                out[i + j] += u * v
        return out

    with localcontext() as context:
        context.prec = 60
        low, high = ([Decimal(s) / 4, Decimal(1) / 2, Decimal(s) / 4] for s in (1, -1))
        ups, downs = ([reduce(times, [part] * k, [Decimal(1)]) for k in range(n + 1)] for part in (low, high))
        fixed = [Decimal(0)] * 6 * n  # places -2 n to 4 n - 1
        for k in range(n):
            for i, v in enumerate(times(ups[n], downs[k])):
                fixed[n - k + i] += math.comb(n - 1 + k, k) * v
        mask, free = times(ups[n], downs[n]), [Decimal(0)] * 2 * n
        while True:
            taps = fixed[:]
            for i, f in enumerate(free):
                for j, m in enumerate(mask):
                    taps[i + j] += f * m
            wide = [Decimal(0)] * 6 * n + taps + [Decimal(0)] * 6 * n
            off = [sum(v * wide[6 * n + i + 2 * m] for i, v in enumerate(taps)) - (Decimal(1) / 2 if m == 0 else 0) for m in range(3 * n)]
            slopes = [[sum(v * (wide[6 * n + i + j + 2 * m] + wide[6 * n + i + j - 2 * m]) for j, v in enumerate(mask)) for i in range(2 * n)] for m in range(3 * n)]
            columns = list(zip(*slopes, strict=True))
            step = _solved([[sum(map(Decimal.__mul__, p, q)) for q in columns] for p in columns], [-sum(map(Decimal.__mul__, p, off)) for p in columns])
            free = [f + s for f, s in zip(free, step, strict=True)]
            if max(map(abs, step)) < Decimal(10) ** -25:
                return np.array([float(v * Decimal(2).sqrt()) for v in taps])


def wavelet_taps(name: str) -> np.ndarray:
    """Low-pass taps by name: haar, dbN or coifN."""
    kind, number = re.fullmatch(r"(haar|db|coif)([1-9][0-9]*)?", name).groups()
    return daubechies(1) if kind == "haar" else (daubechies if kind == "db" else coiflet)(int(number))


def wavelet_part(x: np.ndarray, start: int, n: int, low: np.ndarray, level: int) -> list[tuple[int, np.ndarray]]:
    """First place and detail coefficients of each level that samples start, start + 1, ... of n determine.

    Ends of the recording are extended symmetrically; a level of m samples gives (m + L - 1) // 2 coefficients.
    """
    taps = len(low)
    high = low[::-1] * (-1) ** np.arange(taps)
    found, a, lo, size = [], x.astype(float), start, n
    for _ in range(level):
        hi, after = lo + len(a), (size + taps - 1) // 2
        first = 0 if lo == 0 else -(-(lo + taps - 2) // 2)
        last = after - 1 if hi == size else (hi - 2) // 2
        if last < first or not len(a):
            break
        at = 2 * np.arange(first, last + 1)[:, None] + 2 - taps + np.arange(taps)
        at = np.mod(at, 2 * size)
        own = a[np.where(at < size, at, 2 * size - 1 - at) - lo]
        found.append((first, (own * high).sum(axis=1)))  # no fused products: equal samples give exact zeros
        a, lo, size = (own * low).sum(axis=1), first, after
    return found


def wavelet_levels(x: np.ndarray, low: np.ndarray, level: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Detail coefficients of levels 1..level and the last approximation; symmetric extension, (n + L - 1) // 2 outputs."""
    L = len(low)
    high = low[::-1] * (-1) ** np.arange(L)
    details, a = [], x.astype(float)
    for _ in range(level):
        n = len(a)
        if n < 1:
            break
        pad = L - 1
        at = np.arange(-pad, n + pad)
        at = np.mod(at, 2 * n)
        wide = a[np.where(at < n, at, 2 * n - 1 - at)]
        keep = slice(1, 2 * ((n + L - 1) // 2), 2)
        details.append(np.convolve(wide, high[::-1], "valid")[keep])
        a = np.convolve(wide, low[::-1], "valid")[keep]
    return details, a


def sample_entropy(x: np.ndarray, dim: int = 2, tolerance: float | None = None) -> float | None:
    """-log of the share of template matches that stay matches when one beat longer; strict tolerance."""
    n = len(x)
    if n < dim + 2:
        return None
    r = 0.2 * math.sqrt(((x - x.mean()) ** 2).sum() / (n + 1)) if tolerance is None else tolerance

    if n <= 256:  # the closeness of all pairs of beats at once
        close = np.abs(x[:, None] - x) < r
        k, same = n - dim, close[: n - dim, : n - dim]
        for j in range(1, dim):
            same = same & close[j : j + k, j : j + k]
        own = k if r > 0 else 0  # a beat is close to itself
        b, a = (int(np.count_nonzero(m)) - own for m in (same, same & close[dim:, dim:]))
        return -math.log(a / b) if a and b else None

    def matches(m: int) -> int:
        t = np.lib.stride_tricks.sliding_window_view(x, m)[: n - dim]
        return sum(int((np.abs(t[i + 1 :] - t[i]).max(axis=1) < r).sum()) for i in range(len(t) - 1))

    b, a = matches(dim), matches(dim + 1)
    return -math.log(a / b) if a and b else None


def dfa(x: np.ndarray, scales: range) -> float | None:
    """Detrended fluctuation exponent: slope of log fluctuation against log scale, linear detrending, no overlap."""
    y = np.cumsum(x - x.mean())
    logs = []
    for s in scales:
        if len(y) < 2 * s:
            continue
        parts = y[: len(y) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        slope = parts @ t / (t @ t)
        rest = parts - parts.mean(axis=1, keepdims=True) - slope[:, None] * t
        f = math.sqrt((rest**2).mean())
        if f > 0:
            logs.append((math.log(s), math.log(f)))
    return float(np.polyfit(*zip(*logs, strict=True), 1)[0]) if len(logs) > 1 else None


def fir_lowpass(taps: int, cutoff: float, fs: float) -> np.ndarray:
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(2 * cutoff / fs * n) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / (taps - 1)))
    return h / h.sum()
