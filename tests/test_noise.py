"""Spikes, binned power, gain priors and map tests against plain NumPy."""

import numpy as np

from lumenfold.operators import filters, noise


def test_cubic_smooth_is_exact_for_cubics_and_for_windows():
    t = np.linspace(-1, 1, 400)
    assert np.allclose(noise.smooth_cubic(3 * t**3 - t + 2), 3 * t**3 - t + 2)
    g = np.random.default_rng(1).normal(size=300)
    out = noise.smooth_cubic(g)
    for i in (0, 40, 75, 150, 224, 299):
        lo = min(max(0, i - 75), 149)
        assert np.isclose(out[i], np.polyval(np.polyfit(np.arange(151.0), g[lo : lo + 151], 3), i - lo))
    assert np.allclose(noise.smooth_cubic(np.array([1.0, 2.0])), [1, 2])


def test_spikes_are_found_and_fitted(spark):
    t = np.arange(2000) * 0.02
    d = 5 * (1 + 1e-4 * np.random.default_rng(2).normal(size=2000) + sum(a * np.exp(-((t - p) ** 2) / (2 * 0.1**2)) for a, p in ((0.05, 10.0), (0.03, 25.0))))
    rows = spark.createDataFrame([(1, d.tolist()), (2, [5.0] * 500), (3, []), (4, None)], "k int, s array<double>")
    out = {r["k"]: r for r in noise.find_spikes(rows, "k", "s", 0.02).collect()}
    assert [out[k]["n_spikes"] for k in (1, 2, 3, 4)] == [2, 0, 0, 0]
    norm = 5 / d.mean()
    for got, (a, p) in zip(out[1]["spikes"], ((0.05, 10.0), (0.03, 25.0))):
        assert np.allclose([got["amplitude"], got["position"], got["width"]], [a * norm, p, 0.1], rtol=5e-2)


def test_binned_power_holds_all_power(spark):
    g = np.random.default_rng(3).normal(size=512)
    out = noise.stream_power(spark.createDataFrame([(1, g.tolist())], "k int, s array<double>"), "k", "s", 30).toPandas()
    p = np.abs(np.fft.rfft(g))[1:] ** 2 / 512
    assert out.modes.sum() == 256 and np.isclose((out.power * out.modes).sum(), p.sum()) and (np.diff(out.frequency) > 0).all()


def test_frequency_filter_with_a_prior(spark):
    g = np.random.default_rng(4)
    n, t = 12, 40
    tsys = g.uniform(30, 50, n)
    x = np.linspace(-1, 1, n)
    p = np.stack([1 / tsys, x / tsys], axis=1)
    y = g.normal(size=(n, t)) + np.outer(np.ones(n), np.cumsum(g.normal(size=t)))
    rows = spark.createDataFrame([(1, c, k, float(y[c, k]), float(p[c, 0]), float(p[c, 1])) for c in range(n) for k in range(t)], "feed int, chan int, t int, y double, p double, q double")
    prior, sigma, rate = (0.5, 1.0, -2.0), 0.7, 50.0
    z = np.eye(n) - p @ np.linalg.pinv(p.T @ p) @ p.T
    one = np.ones(n)
    f = np.fft.rfftfreq(t, 1 / rate)
    f[0] = f[1] / 2
    a = np.fft.irfft(np.fft.rfft(one @ z @ y) / (one @ z @ one + sigma**2 / (prior[0] ** 2 * (f / prior[1]) ** prior[2])), n=t)
    want = y - np.outer(one, a) - p @ (np.linalg.pinv(p.T @ p) @ p.T @ (y - np.outer(one, a)))
    out = noise.frequency_filter_prior(rows.repartition(4), ["feed"], "t", "y", "p", "q", sigma, prior, rate).collect()
    assert len(out) == n * t and max(abs(r["residual"] - want[r["chan"], r["t"]]) for r in out) < 1e-8
    flat = noise.frequency_filter_prior(rows, ["feed"], "t", "y", "p", "q", 1e-12, prior, rate).collect()
    plain = {(r["chan"], r["t"]): r["residual"] for r in filters.frequency_filter(rows, ["feed", "t"], "y", "p", "q").collect()}
    assert max(abs(r["residual"] - plain[r["chan"], r["t"]]) for r in flat) < 1e-6  # without noise the prior says nothing


def test_map_chi2_of_noise_and_of_signal(spark):
    g, shape, steps = np.random.default_rng(5), (8, 8, 8), (1.0, 1.0, 1.0)
    wave = np.sin(2 * np.pi * np.arange(8) / 4)[:, None, None] * 1.5
    rows = [(u, *map(int, at), float(m[at]), 1.0) for u, m in ((u, g.normal(size=shape) + (u == 9) * wave) for u in range(10)) for at in np.ndindex(shape)]
    cells = spark.createDataFrame(rows, "u int, x int, y int, z int, map double, sigma double")
    how = (shape, steps, [0.5, 1.2, 1.8, 2.4, 3.2])
    out = {r["u"]: r["chi2"] for r in noise.map_chi2(cells, "u", *how).collect()}
    again = {r["u"]: r["chi2"] for r in noise.map_chi2(cells.repartition(7), "u", *how).collect()}
    assert out.keys() == again.keys() and np.allclose([out[u] for u in out], [again[u] for u in out])
    assert out[9] > 10 and max(abs(out[u]) for u in range(9)) < 6
