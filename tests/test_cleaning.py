"""Map cleaning against NumPy on whole maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import cleaning
from lumenfold.plans import cleaning_queries

SF = "/root/testdata/sf0.001"
BY, PIXEL = ["feed"], ["dec_i", "ra_i"]


def maps(spark, feeds=3, channels=8, side=4, seed=1):
    g = np.random.default_rng(seed)
    m = np.einsum("fc,fp->fcp", g.normal(size=(feeds, channels)) * 4, g.normal(size=(feeds, side * side))) + g.normal(size=(feeds, channels, side * side))
    s = g.uniform(0.5, 2, m.shape)
    s[g.random(m.shape) < 0.1] = np.nan
    rows = [(f, p // side, p % side, c // 4, c % 4, float(m[f, c, p]), float(s[f, c, p])) for f in range(feeds) for c in range(channels) for p in range(side * side)]
    rows += [(9, 0, 0, 0, 0, 1.0, None), (9, 0, 1, 0, 0, None, 1.0), (9, 0, 2, 0, 1, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "feed int, dec_i int, ra_i int, sb int, chan int, map double, sigma double")
    return df, np.where(np.isfinite(s), m, 0), np.where(np.isfinite(s), 1 / s**2, 0)


def plain_mode(m, w, rounds, still):
    """One weighted mode of channels x pixels, element by element."""
    p = m.sum(axis=0)
    p = p / np.linalg.norm(p)
    solve = lambda m, w, a: np.divide((m * w) @ a, w @ a**2, out=np.zeros(len(m)), where=w @ a**2 > 0)
    f = np.zeros(len(m))
    state = {"f": [f, f, np.zeros(len(f))], "p": [p, p, np.zeros(len(p))]}
    for _ in range(rounds):
        for axis, (mm, ww) in {"f": (m, w), "p": (m.T, w.T)}.items():
            now, before, speed = state[axis]
            to = solve(mm, ww, state["p" if axis == "f" else "f"][0])
            speed = np.where((to - now) * (now - before) < 0, 0, np.minimum(speed + 0.03, 0.9))
            state[axis] = [to + speed * (to - now), now, speed]
        if all(np.mean(np.abs(x[0] - x[1])) < still for x in state.values()):
            break
    return state["f"][0], state["p"][0]


def plain_subtract(m, w, blocks, rounds, still):
    m, out = m.copy(), []
    for size in blocks:
        ww = w.reshape(-1, size, w.shape[1]).sum(axis=1)
        mm = np.divide((w * m).reshape(-1, size, w.shape[1]).sum(axis=1), ww, out=np.zeros_like(ww), where=ww > 0)
        p = plain_mode(mm, ww, rounds, still)[1]
        p = p / np.linalg.norm(p)
        f = np.divide((m * w) @ p, w @ p**2, out=np.zeros(len(m)), where=w @ p**2 > 0)
        m = m - np.outer(f, p) * (w > 0)
        out.append((f, p))
    return m, out


@pytest.mark.parametrize("blocks, rounds, still", [([1, 2], 6, 1e-8), ([1], 40, 1e-2)])
def test_weighted_modes_are_those_of_a_plain_loop(spark, blocks, rounds, still):
    df, m, w = maps(spark)
    cells, factors = cleaning.subtract_weighted(cleaning.seen_cells(df, BY, PIXEL, 4), BY, PIXEL, blocks, rounds, still)
    want = [plain_subtract(m[f], w[f], blocks, rounds, still) for f in range(3)]
    got = cells.collect()
    assert len(got) == int((w > 0).sum())
    for x in got:
        assert abs(x["m"] - want[x["feed"]][0][x["f"], x["dec_i"] * 4 + x["ra_i"]]) < 1e-6
    for x in factors.collect():
        f, p = want[x["feed"]][1][x["mode"]]
        assert abs(x["value"] - (f[x["element"][0]] if x["axis"] == "f" else p[x["element"][0] * 4 + x["element"][1]])) < 1e-6


def plain_normalised(m, w, modes, power, separable, line_mean):
    seen = w > 0
    if separable:
        rows, cols = seen.any(axis=1), seen.any(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            noise = np.sqrt(np.outer(np.sqrt(cols.sum() / w.sum(axis=1)), np.sqrt(rows.sum() / w.sum(axis=0))))
    else:
        noise = 1 / np.sqrt(np.where(seen, w, 1))
    scale = np.where(seen, noise, 1) ** power
    x = np.where(seen, m / scale, 0)
    if line_mean:
        x = np.where(seen, x - x.sum(axis=0) / np.maximum(seen.sum(axis=0), 1), 0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    return m - (u[:, :modes] * s[:modes]) @ v[:modes] * scale * seen


@pytest.mark.parametrize("norm, separable, line_mean", [("sigma_wn", False, False), ("var", True, False), ("weightless", False, True), ("three", True, True)])
def test_normalised_modes_against_svd(spark, norm, separable, line_mean):
    df, m, w = maps(spark, seed=4)
    out = cleaning.subtract_normalised(cleaning.seen_cells(df, BY, PIXEL, 4).repartition(7), BY, PIXEL, 2, norm, separable, line_mean).collect()
    want = [plain_normalised(m[f], w[f], 2, cleaning.NORMS[norm], separable, line_mean) for f in range(3)]
    assert len(out) == int((w > 0).sum())
    assert max(abs(x["m"] - want[x["feed"]][x["f"], x["dec_i"] * 4 + x["ra_i"]]) for x in out) < 1e-8


def test_cleaned_maps_and_their_coadds(spark):
    df, m, w = maps(spark)
    df = df.withColumn("feed", F.col("feed") + 4)  # feeds 4 and 5 stand in the first group, 6 in the second
    for norm in ("exper", "sigma_wn"):
        out = cleaning.clean_maps(df, 4, 1, norm, rounds=5).collect()
        want = np.array([plain_subtract(m[f], w[f], [1], 5, 1e-8)[0] if norm == "exper" else plain_normalised(m[f], w[f], 1, 1, False, False) for f in range(3)])
        for x in out:
            at = x["sb"] * 4 + x["chan"], x["dec_i"] * 4 + x["ra_i"]
            feeds = [x["feed"] - 4] if x["level"] == 0 else ([0, 1] if x["bag"] == 0 else [2]) if x["level"] == 1 else [0, 1, 2]
            weights = w[feeds, at[0], at[1]]
            assert abs(x["map"] - (want[feeds, at[0], at[1]] * weights).sum() / weights.sum()) < 1e-6
            assert abs(x["sigma"] - 1 / np.sqrt(weights.sum())) < 1e-9
        assert {x["level"] for x in out} == {0, 1, 2}
    loud = cleaning.quiet(df.filter("sigma > 0").withColumn("sigma", F.when(F.col("ra_i") == 3, 100.0).otherwise(F.col("sigma"))), 3, 8.0)
    assert {x["ra_i"] for x in loud.select("ra_i").distinct().collect()} == {0, 1, 2}
    high = cleaning.clean_maps(df, 4, 1, "sigma_wn", highpass=(1.0, 4, 4)).filter("level = 0").count()
    assert high == int((w > 0).sum())
    assert cleaning.clean_maps(df.limit(0), 4, 1, "exper", rounds=2).count() == 0


def test_queries_are_the_plain_loops(spark):
    """The two queries that SQL can't express, cell by cell."""
    cells = cleaning_queries.cells(spark, SF).toPandas()
    for name, plain in (("weighted_map_modes", lambda m, w: plain_subtract(m, w, *cleaning_queries.WEIGHTED, 1e-8)[0]), ("separable_map_modes", lambda m, w: plain_normalised(m, w, 2, 1, True, True))):
        got = cleaning_queries.QUERIES[name](spark, SF).toPandas()
        for feed, part in cells.groupby("feed"):
            m, w = np.zeros((256, 120)), np.zeros((256, 120))
            at = part["f"], part["dec_i"] * 12 + part["ra_i"]
            m[at], w[at] = part["m"], part["w"]
            want = plain(m, w)
            mine = got[got.feed == feed]
            assert len(mine) == len(part)
            assert np.abs(mine["map"] - want[mine.sb * 64 + mine.chan, mine.dec_i * 12 + mine.ra_i]).max() < 1e-6 * np.abs(m).max()
