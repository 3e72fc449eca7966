"""Filters, map cleaning and spectra against NumPy and known answers; queries without SQL run and repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import fields, filters
from lumenfold.plans import queries as plans
from lumenfold.plans import signal_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
N = 600
T = np.arange(N)


def filtered(spark, change, d, *how):
    return np.array(change(spark.createDataFrame([(1, [float(x) for x in d])], "k int, s array<double>"), "k", "s", *how).first()["filtered"])


def test_gain_of_a_constant_is_nothing_and_fast_waves_stay(spark):
    fast = 0.1 * np.sin(2 * np.pi * 0.25 * T)
    for change, how in ((filters.normalise_gain, (0.01,)), (filters.normalise_gain_gaussian, (20, 4.0))):
        assert np.allclose(filtered(spark, change, np.full(N, 5.0), *how), 0, atol=1e-9)
        assert np.allclose(filtered(spark, change, 5 * (1 + fast), *how)[50:-50], fast[50:-50], atol=5e-3)


def test_notches_take_their_frequency_only(spark):
    bad, good = np.sin(2 * np.pi * 0.2 * T), np.sin(2 * np.pi * 0.05 * T)
    for change, how in ((filters.notch, (0.2, 0.05)), (filters.notch_both_ways, (0.2, 5.0))):
        assert np.abs(filtered(spark, change, bad + good, *how) - good)[100:-100].max() < 0.05


def test_highpass_and_start_decay(spark):
    slow, fast = 3 + T / N, np.sin(2 * np.pi * 0.25 * T)
    assert np.abs(filtered(spark, filters.padded_highpass, slow + fast, 0.05) - fast)[100:-100].max() < 0.05
    t = T * 0.1
    assert np.allclose(filtered(spark, filters.subtract_start_decay, 2 + 0.3 * t + 5 * np.exp(-t / 19.2), 0.1), 2 + 0.3 * t, atol=1e-6)


def test_noise_is_repeatable_and_its_fit_finds_it(spark):
    keys = spark.createDataFrame([(k,) for k in range(6)], "k long")
    noise = filters.noise_streams(keys, "k", 1 << 14, 2.0, 0.02, -2.0)
    again = {r["k"]: r["filtered"] for r in filters.noise_streams(keys.repartition(5), "k", 1 << 14, 2.0, 0.02, -2.0).collect()}
    assert all(again[r["k"]] == r["filtered"] for r in noise.collect())
    fit = np.array([r["filtered"] for r in filters.fit_noise(noise.withColumnRenamed("filtered", "s"), "k", "s").collect()])
    assert np.allclose(np.median(fit, axis=0), [2.0, 0.02, -2.0], rtol=0.25)
    assert np.isinf(filtered(spark, filters.fit_noise, np.ones(50))).all()


def test_empty_and_null_streams(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "k int, s array<double>")
    for change, how in ((filters.notch, (0.2, 0.05)), (filters.normalise_gain, (0.01,)), (filters.fit_noise, ())):
        assert [r["filtered"] for r in change(rows, "k", "s", *how).collect()] == [[], []]


def cube(spark, seed=1, modes=1, noise=0.0):
    g = np.random.default_rng(seed)
    values = sum(np.outer(g.normal(size=12), g.normal(size=30)) for _ in range(modes)) + noise * g.normal(size=(12, 30))
    sigma = g.uniform(0.5, 2, (12, 30))
    rows = [(1, p // 6, p % 6, c // 4, c % 4, float(values[c, p]), float(sigma[c, p])) for c in range(12) for p in range(30)]
    return spark.createDataFrame(rows, "feed int, dec_i int, ra_i int, sb int, chan int, map double, sigma double"), values, sigma


def test_modes_go(spark):
    maps, values, _ = cube(spark, modes=2)
    for out in (fields.subtract_modes(maps, ["feed"], 2, 0.0), fields.subtract_weighted_modes(maps.withColumn("sigma", F.lit(1.0)), ["feed"], 2)):
        assert max(abs(r["cleaned"]) for r in out.collect()) < 1e-3
    maps, values, sigma = cube(spark, 3, 1, 0.5)
    u, s, v = np.linalg.svd(values / sigma, full_matrices=False)
    want = values - (u[:, :2] * s[:2]) @ v[:2] * sigma
    for r in fields.subtract_modes(maps, ["feed"], 2).collect():
        assert abs(r["cleaned"] - want[r["sb"] * 4 + r["chan"], r["dec_i"] * 6 + r["ra_i"]]) < 1e-8


def test_map_highpass_takes_slow_waves(spark):
    rows = [(1, 0, 0, i, j, float(5 + np.sin(2 * np.pi * i / 16) + (i == 7) * (j == 7)), 1.0) for i in range(16) for j in range(16)]
    maps = spark.createDataFrame(rows, "feed int, sb int, chan int, dec_i int, ra_i int, map double, sigma double")
    out = {(r["dec_i"], r["ra_i"]): r["cleaned"] for r in fields.highpass_maps(maps, ["feed", "sb", "chan"], 1.5, 16, 16).collect()}
    assert out[7, 7] > 0.9 and max(abs(v) for k, v in out.items() if k != (7, 7)) < 0.1


def test_cross_spectrum_of_equal_white_maps(spark):
    g, shape, steps = np.random.default_rng(2), (8, 8, 16), (2.0, 2.0, 1.0)
    m, other = g.normal(size=shape), g.normal(size=shape)
    rows = [(u, *map(int, at), float(d[at]), 1.0) for u, d in ((1, m), (2, m), (3, other)) for at in np.ndindex(shape)]
    maps = spark.createDataFrame(rows, "u int, x int, y int, z int, map double, sigma double")
    out = fields.cross_spectra(maps, "u", shape, steps, [0.0, 10.0], [0.0, 10.0], sims=20).toPandas().set_index(["a", "b"])
    assert len(out) == 3 and (out.modes == 1024).all() and (out.sigma > 0).all()
    assert np.isclose(out.power[1, 2], (m**2).mean() * 4.0)  # Parseval: voxel volume times variance
    assert np.isclose(out.power[1, 3], (m * other).mean() * 4.0)


@pytest.mark.parametrize("name", ["gain_fft", "noise_fit", "white_noise", "map_svd", "map_weighted_modes", "map_highpass", "cross_spectra"])
def test_queries_without_sql_run(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
