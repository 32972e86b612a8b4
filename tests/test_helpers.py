"""Closed forms and plain restatements for the numpy helpers."""

import math

import numpy as np
import pytest
from pulsegrid.functions import signals as H
from pulsegrid.functions import spectral as P


def test_median_filter_pads_with_zeros():
    assert H.median_filter(np.array([5.0, 1, 4, 2, 9]), 3).tolist() == [1, 4, 2, 4, 2]


@pytest.mark.parametrize("kind", ["low", "high"])
def test_butterworth_gain(kind):
    b, a = H.butterworth(4, 1.0, 8.0, kind)
    gain = lambda f: abs(np.polyval(b, z := np.exp(2j * np.pi * f / 8)) / np.polyval(a, z))
    assert gain(1.0) == pytest.approx(1 / math.sqrt(2), abs=1e-9)
    assert gain(0.0 if kind == "low" else 4.0) == pytest.approx(1, abs=1e-9)
    assert gain(3.5 if kind == "low" else 0.05) < 0.01


def test_zero_phase_keeps_slow_signals_and_notch_removes_its_tone():
    t = np.arange(400) / 8
    slow = np.sin(2 * np.pi * 0.02 * t) + 3
    assert np.abs(H.filtfilt(*H.butterworth(2, 1.0, 8.0), slow) - slow)[20:-20].max() < 1e-3
    tone = np.sin(2 * np.pi * 2 * t)
    assert np.abs(H.lfilter(*H.notch(2.0, 8.0, 5.0), tone))[200:].max() < 1e-3
    assert H.lfilter(np.array([0.5, 0.5]), np.array([1.0]), np.array([2.0, 4, 6])).tolist() == [1, 3, 5]


def test_repair_replaces_a_spike_by_the_curve_around_it():
    x = 0.001 * (np.arange(3000) - 1500.0) ** 2
    y = x.copy()
    y[1500] += 1e4
    assert np.abs(H.repair_defects(y) - x).max() < 1e-3
    late = x.copy()
    late[2950] += 1e4
    assert (H.repair_defects(late) == late).all()


def test_peaks_by_height_and_distance():
    x = np.array([0, 3, 0, 5, 0, 4, 0, 1, 0.0])
    assert H.find_peaks(x, 2, 3).tolist() == [3]
    assert H.find_peaks(x, 0.5, 2).tolist() == [1, 3, 5, 7]
    assert H.find_peaks(np.zeros(0), 1, 2).tolist() == []


def test_one_skin_response():
    t = np.arange(200)
    x = 1 + np.where(t < 100, 0, np.where(t < 116, (t - 100) / 16, np.exp(-(t - 116) / 12)))
    (p,) = H.scr_peaks(x)
    assert p["apex"] == 115 and p["start"] in (99, 100) and p["amplitude"] == pytest.approx(15 / 16)
    assert p["decay"] == (next(i for i in range(116, 200) if x[i] < x[p["start"]] + p["amplitude"] / 2) - 115) / 8
    assert p["auc"] == pytest.approx(p["amplitude"] * p["width"])


@pytest.mark.parametrize("n", [1, 4, 10])
def test_daubechies_taps_are_orthonormal_with_vanishing_moments(n):
    h = H.daubechies(n)
    assert len(h) == 2 * n and h.sum() == pytest.approx(math.sqrt(2))
    for k in range(n):
        assert h[: len(h) - 2 * k] @ h[2 * k :] == pytest.approx(float(k == 0), abs=1e-6)
    g = h[::-1] * (-1) ** np.arange(2 * n)
    assert abs(g.sum()) < 1e-6 and (n < 2 or abs(g @ np.arange(2 * n)) < 1e-4)


def test_wavelet_lengths_and_energy():
    x = np.random.default_rng(1).normal(size=64)
    details, rest = H.wavelet_levels(x, H.daubechies(1), 3)
    assert [len(d) for d in details] == [32, 16, 8]
    assert sum((d**2).sum() for d in details) + (rest**2).sum() == pytest.approx((x**2).sum())
    details, _ = H.wavelet_levels(x, H.daubechies(4), 2)
    assert [len(d) for d in details] == [(64 + 7) // 2, ((64 + 7) // 2 + 7) // 2]
    assert np.abs(H.wavelet_levels(np.ones(50), H.daubechies(4), 1)[0][0]).max() < 1e-9


def test_entropy_and_dfa():
    x = np.tile([1.0, 2.0], 50)
    assert H.sample_entropy(x, 2, 0.5) == pytest.approx(0, abs=0.05)
    assert H.sample_entropy(np.array([1.0, 2, 3])) is None
    rng = np.random.default_rng(0)
    noise = rng.normal(size=4000)
    assert H.dfa(noise, range(4, 17)) == pytest.approx(0.5, abs=0.12)
    assert H.dfa(np.cumsum(noise), range(17, 65)) == pytest.approx(1.5, abs=0.15)

    def plain(x, m, r):
        n = len(x)
        count = lambda k: sum(max(abs(x[i + q] - x[j + q]) for q in range(k)) < r for i in range(n - m) for j in range(i + 1, n - m))
        return -math.log(count(m + 1) / count(m))

    y = rng.normal(size=120)
    assert H.sample_entropy(y, 2, 0.4) == pytest.approx(plain(y, 2, 0.4))


def test_spline_is_exact_for_cubics():
    t = np.sort(np.random.default_rng(2).random(30)) * 10
    f = lambda u: u**3 - 4 * u * u + u - 2
    at = np.arange(t[0], t[-1] + 1e-12, 0.25)
    assert np.allclose(P.cubic_resample(t, f(t), 4.0), f(at))


@pytest.mark.parametrize("estimate", [lambda x: P.welch(x, 1024.0, 512, 1024), lambda x: P.periodogram(x, 1024.0, 1024), lambda x: P.daniell(x, 1024.0, 1024, 1), lambda x: P.correlogram(x, 1024.0, 1024, 200), lambda x: P.ar_psd(*P.burg(x, 30)[-1], 1024.0, 65536), lambda x: P.ar_psd(*P.levinson(P.autocorrelations(x, 30), 30), 1024.0, 65536)])
def test_noisy_cosine_peaks_at_its_frequency(estimate):
    t = np.arange(1024) / 1024
    x = np.cos(2 * np.pi * 200 * t) + 0.1 * np.random.default_rng(3).normal(size=1024)
    f, p = estimate(x)
    assert abs(f[p.argmax()] - 200) <= 2
    assert p.sum() * (f[1] - f[0]) == pytest.approx((x**2).mean(), rel=0.25)


def test_two_tones_and_lomb():
    n = np.arange(1024)
    x = np.cos(0.257 * np.pi * n) + np.sin(0.2 * np.pi * n)
    f, p = P.periodogram(x, 1.0, 4096)
    top = sorted(f[i] for i in np.argsort(-np.where((p[1:-1] > p[:-2]) & (p[1:-1] > p[2:]), p[1:-1], 0))[:2] + 1)
    assert top == pytest.approx([0.1, 0.1285], abs=0.001)
    t = np.sort(np.random.default_rng(4).random(400)) * 100
    freqs = np.linspace(0, 0.41, 256)
    power = P.lomb(t, np.sin(2 * np.pi * 0.25 * t), freqs)
    assert freqs[power.argmax()] == pytest.approx(0.25, abs=0.003) and power[0] == 0


def test_autocorrelation_and_levinson():
    x = np.array([1.0, 2, 3, 4, 5])
    assert P.autocorrelations(x, 0)[0] == pytest.approx(11)
    assert P.autocorrelations(x, 2, "raw") == pytest.approx([55, 40, 26])
    a, e = P.levinson(np.array([1.0, 0.5, 0.25]), 2)
    assert a == pytest.approx([-0.5, 0]) and e == pytest.approx(0.75)


def test_order_criteria_find_the_order():
    rng = np.random.default_rng(6)
    x = np.zeros(3000)
    for i in range(2, 3000):
        x[i] = 1.3 * x[i - 1] - 0.8 * x[i - 2] + rng.normal()
    fits = P.burg(x, 10)
    assert min(range(1, 11), key=lambda k: P.order_criteria(3000, k, fits[k - 1][1])["MDL"]) == 2
    assert fits[1][0] == pytest.approx([-1.3, 0.8], abs=0.05)
