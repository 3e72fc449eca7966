"""Splines, model spectra, fitted degrees of freedom and covariance weights against NumPy and known answers."""

from math import erfc, exp, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import averages, tabulated


def plain_spline(x, y, at, ends="smooth"):
    """The spline's value by its 4 (n - 1) conditions, solved as one system."""
    n = len(x)
    rows, right = [], []

    def row(*parts):
        out = np.zeros(4 * (n - 1))
        for i, c in parts:
            out[4 * i : 4 * i + 4] += c
        rows.append(out)

    powers = lambda h, d: [[1, h, h**2, h**3], [0, 1, 2 * h, 3 * h**2], [0, 0, 2, 6 * h], [0, 0, 0, 6.0]][d]
    h = np.diff(x)
    for i in range(n - 1):
        row((i, powers(0, 0))), right.append(y[i])
        row((i, powers(h[i], 0))), right.append(y[i + 1])
    for i in range(n - 2):
        for d in (1, 2):
            row((i, powers(h[i], d)), (i + 1, -np.array(powers(0, d), float))), right.append(0)
    if ends == "smooth" and n > 3:
        for i in (0, n - 3):
            row((i, powers(h[i], 3)), (i + 1, -np.array(powers(0, 3), float))), right.append(0)
    else:
        row((0, powers(0, 2))), right.append(0)
        row((n - 2, powers(h[-1], 2))), right.append(0)
    c = np.linalg.solve(np.array(rows), np.array(right, float)).reshape(-1, 4)
    i = min(max(int(np.searchsorted(x, at, side="right")) - 1, 0), n - 2)
    return float(c[i] @ powers(at - x[i], 0))


def test_bicubic_tables_multiply_and_reproduce_cubics(spark):
    g = np.random.default_rng(1)
    x, y = np.cumsum(g.uniform(0.1, 1, 6)), np.cumsum(g.uniform(0.1, 1, 5))
    z1, z2 = g.normal(size=(6, 5)), g.normal(size=(6, 5))
    rows = [(n, float(a), float(b), float(z[i, j])) for n, z in (("one", z1), ("two", z2)) for i, a in enumerate(x) for j, b in enumerate(y)] + [("one", 99.0, 1.0, 5.0)]
    points = [(k, float(g.uniform(x[0] - 0.5, x[-1] + 0.5)), float(g.uniform(y[0] - 0.5, y[-1] + 0.5))) for k in range(60)] + [(100, float(x[2]), float(y[3])), (101, float(x[-1]), float(y[-1]))]
    table = spark.createDataFrame(rows, "name string, kx double, ky double, v double")
    out = tabulated.transfer_at(spark.createDataFrame(points, "k int, px double, py double"), "px", "py", table, "name", "kx", "ky", "v")
    got = {r["k"]: r["transfer"] for r in out.collect()}
    assert len(got) == 62
    for k, a, b in points:
        a, b = min(max(a, x[0]), x[-1]), min(max(b, y[0]), y[-1])
        want = plain_spline(x, [plain_spline(y, (z1 * z2)[i], b) for i in range(6)], a)
        assert abs(got[k] - want) < 1e-9
    op = tabulated.spline_operator(list(x))
    cubic = x**3 - 2 * x
    for i in range(5):
        assert np.allclose(op[i] @ cubic, [cubic[i], 3 * x[i] ** 2 - 2, 3 * x[i], 1])
    assert np.allclose(tabulated.spline_operator([0.0, 1.0])[0] @ [2, 5], [2, 3, 0, 0])
    assert np.allclose(tabulated.spline_operator([0.0, 1.0, 3.0])[1] @ [0, 1, 9], [1, 2, 1, 0])


@pytest.mark.parametrize("ends", ["smooth", "natural"])
def test_model_splines(spark, ends):
    g = np.random.default_rng(3)
    knots = {n: np.sort(g.uniform(0, 3, n)) for n in (2, 3, 4, 5, 9)}
    values = {n: g.normal(size=n) for n in knots}
    models = spark.createDataFrame([(n, float(a), float(b)) for n in knots for a, b in zip(knots[n], values[n])] + [(1, 0.5, 2.0)], "model int, k double, p double")
    points = [(n, float(a)) for n in knots for a in [*g.uniform(knots[n][0], knots[n][-1], 20), knots[n][0], knots[n][-1]]] + [(4, 99.0), (1, 0.5)]
    intervals = tabulated.spline_intervals(models.repartition(3), "model", "k", "p", ends)
    got = tabulated.evaluate_splines(spark.createDataFrame(points, "model int, k double").withColumn("at", F.col("k")), "model", "at", intervals, 0.1).collect()
    assert len(got) == len(points)
    for r in got:
        if r["model"] == 1 or r["k"] == 99.0:
            assert r["power"] is None
        else:
            assert abs(r["power"] - plain_spline(knots[r["model"]], values[r["model"]], r["k"], ends)) < 1e-9


def test_angle_mean(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 0.5, 1.0), ("b", 0.2, 7.0)], "m string, mu double, v double")
    assert {r["m"]: r["power"] for r in tabulated.angle_mean(rows, ["m"], "mu", "v").collect()} == {"a": 1.5, "b": 0.0}


def test_beam_of_a_gaussian_profile(spark):
    s, r = 0.05, np.linspace(0, 1.5, 200)
    profile = spark.createDataFrame([(float(a), float(np.exp(-0.5 * (a / s) ** 2))) for a in r], "r double, b double")
    k = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.3)], "k double")
    out = {x["k"]: x["transfer"] for x in tabulated.beam_profile_transfer(profile, "r", "b", k, 100.0, 0.01, 1.0, 0.1, 0.72).collect()}
    whole = 0.72 / (1 - np.exp(-0.5 * (0.1 / s) ** 2))
    for v in out:
        assert abs(out[v] / (whole**2 * np.exp(-((v * 100 * s) ** 2))) - 1) < 0.05


def test_survival_and_fitted_dof(spark):
    rows = spark.createDataFrame([(x, n) for x in (0.0, 0.5, 3.0, 30.0) for n in (1.0, 2.0, 4.0)] + [(None, 2.0)], "x double, n double")
    known = {1.0: lambda x: erfc(sqrt(x / 2)), 2.0: lambda x: exp(-x / 2), 4.0: lambda x: exp(-x / 2) * (1 + x / 2)}
    for r in averages.with_survival(rows, "x", "n").collect():
        assert r["pte"] is None if r["x"] is None else abs(r["pte"] - known[r["n"]](r["x"])) < 1e-12
    ones = spark.createDataFrame([(x,) for x in (0.05, 1.0, 2.5, 40.0)], "x double").select("x", averages.digamma(F.col("x")).alias("d"), averages.trigamma(F.col("x")).alias("t")).collect()
    got = {r["x"]: (r["d"], r["t"]) for r in ones}
    assert abs(got[1.0][0] + 0.5772156649015329) < 1e-12 and abs(got[1.0][1] - np.pi**2 / 6) < 1e-12
    assert abs(got[2.5][0] - (2 / 3 + 2 - 0.5772156649015329 - 2 * np.log(2))) < 1e-12 and abs(got[0.05][0] + 20.49784500) < 1e-5
    g = np.random.default_rng(2)
    draws = {n: g.chisquare(n, 20_000) for n in (0.4, 3, 57.5)}
    sims = spark.createDataFrame([(float(n), float(x)) for n in draws for x in draws[n]] + [(3.0, 0.0), (3.0, None)], "n double, x double")
    fits = {r["n0"]: r["dof"] for r in averages.fitted_dof(sims.withColumnRenamed("n", "n0"), ["n0"], "x").collect()}
    assert all(abs(fits[n] / n - 1) < 0.02 for n in draws)
    found = spark.createDataFrame([(3.0, 2.0)], "n double, x double")
    assert abs(averages.numeric_pte(found, sims, ["n"], "x").first()["numeric"] - np.mean(draws[3] > 2)) < 1e-3


def test_covariance_weights_against_least_squares(spark):
    g = np.random.default_rng(5)
    pairs, blocks, cells, runs = 4, 2, 3, 40
    noise = g.normal(size=(pairs, blocks, runs, cells)) @ g.normal(size=(cells, cells))
    value = g.normal(size=(pairs, blocks, cells))
    noise[3, 1, :, 2] = noise[3, 1, :, 1]  # no inverse there
    rows = [(p, b, r, c, float(noise[p, b, r, c])) for p, b, r, c in np.ndindex(noise.shape)]
    inverses = averages.block_inverses(spark.createDataFrame(rows, "pair int, par int, run int, perp int, v double"), ["pair"], "run", "par", "perp", "v")
    spectra = spark.createDataFrame([(p, b, c, float(value[p, b, c])) for p, b, c in np.ndindex(value.shape)], "pair int, par int, perp int, v double")
    got = {(r["par"], r["perp"]): (r["mean"], r["error"]) for r in averages.covariance_average(spectra, inverses, ["pair"], "par", "perp", "v").collect()}
    for b in range(blocks):
        use = [p for p in range(pairs) if (p, b) != (3, 1)]
        inv = {p: np.linalg.inv(np.cov(noise[p, b].T)) for p in use}
        cov = np.linalg.inv(sum(inv.values()))
        mean = cov @ sum(inv[p] @ value[p, b] for p in use)
        for c in range(cells):
            assert np.allclose(got[b, c], (mean[c], np.sqrt(cov[c, c])), rtol=1e-8)
    few = spark.createDataFrame([(0, 0, r, c, float(r * c)) for r in range(3) for c in range(4)], "pair int, par int, run int, perp int, v double")
    assert averages.block_inverses(few, ["pair"], "run", "par", "perp", "v").count() == 0


def test_covariance_query(spark):
    """The query that SQL can't express, by NumPy."""
    from lumenfold.plans import spectrum_queries

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", "vec_id", "embedding").collect()
    got = {(r["block"], r["cell"]): (r["mean"], r["error"]) for r in spectrum_queries.covariance_average(spark, sf).collect()}
    assert len(got) == 64
    by_label = {}
    for r in sorted(rows, key=lambda r: r["vec_id"]):
        by_label.setdefault(r["label"], []).append(r["embedding"])
    for b in range(16):
        inv, sums = np.zeros((4, 4)), np.zeros(4)
        for vectors in by_label.values():
            m = np.array(vectors, dtype=float)[:, 4 * b : 4 * b + 4]
            one = np.linalg.inv(np.cov(m.T))
            inv, sums = inv + one, sums + one @ m[0]
        cov = np.linalg.inv(inv)
        for c in range(4):
            assert np.allclose(got[b, c], ((cov @ sums)[c], np.sqrt(cov[c, c])), rtol=1e-6)
