"""Pairs, noise banks and map statistics against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import crosses, map_tests

SHAPE, STEPS = (6, 5, 8), (2.0, 2.0, 1.0)
ACROSS, ALONG = [0.3, 1.0, 2.0, 3.0], [0.1, 1.0, 2.0, 3.2]


def cubes(seed=1):
    g = np.random.default_rng(seed)
    out = {}
    for field in ("f", "o"):
        for split in (0, 1):
            for feed in (1, 2, 3):
                s = g.uniform(0.5, 2, SHAPE)
                s[g.random(SHAPE) < 0.1] = 0
                out[field, split, feed] = np.where(s > 0, g.normal(size=SHAPE), 0), s
    del out["o", 1, 3]
    return out


def as_rows(spark, maps):
    rows = [(*key, *map(int, at), float(m[at]), float(s[at]) or None) for key, (m, s) in maps.items() for at in np.ndindex(SHAPE)]
    return spark.createDataFrame(rows, "field string, split int, feed int, x int, y int, z int, map double, sigma double")


def plain_power(a, b):
    k = [2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(SHAPE, STEPS)]
    p = np.real(np.fft.fftn(a) * np.conj(np.fft.fftn(b))) * np.prod(STEPS) / np.prod(SHAPE)
    sums, count = {}, {}
    for x, y, z in np.ndindex(SHAPE):
        at = []
        for v, edges in ((np.hypot(k[0][x], k[1][y]), ACROSS), (abs(k[2][z]), ALONG)):
            i = int(np.searchsorted(edges, v, side="right")) - 1
            at.append(len(edges) - 2 if v == edges[-1] else i if 0 <= i < len(edges) - 1 else None)
        if None not in at:
            sums[tuple(at)] = sums.get(tuple(at), 0) + p[x, y, z]
            count[tuple(at)] = count.get(tuple(at), 0) + 1
    return {at: sums[at] / count[at] for at in sums}


def plain_weights(s1, s2, symmetric):
    w1, w2 = (np.where(s > 0, 1 / np.where(s > 0, s, 1) ** 2, 0) for s in (s1, s2))
    norm = np.sqrt((w1 * w2).mean())
    w1, w2 = (np.where(np.log10(np.maximum(w / norm, 1e-99)) < -0.5, 0, w / norm) for w in (w1, w2))
    if symmetric:
        w1 = w2 = np.sqrt(w1 * w2)
    return w1 / np.sqrt((w1**2).mean()), w2 / np.sqrt((w2**2).mean())


def test_pairs_stand_once(spark):
    maps = cubes()
    keys = spark.createDataFrame(list(maps) * 2, "field string, split int, feed int")
    splits = spark.createDataFrame([(0, 0), (0, 1), (5, 5)], "split1 int, split2 int")
    fields = spark.createDataFrame([("f", "f"), ("o", "o"), ("f", "o")], "field1 string, field2 string")
    got = {tuple(r)[1:] for r in crosses.map_pairs(keys, splits, fields).collect()}
    want = {(f1, s1, a, f2, s2, b) for f1, f2 in (("f", "f"), ("o", "o"), ("f", "o")) for s1, s2 in ((0, 0), (0, 1)) for a in (1, 2, 3) for b in (1, 2, 3)
            if (f1, s1, a) in maps and (f2, s2, b) in maps and not (f1 == f2 and s1 == s2 and b < a)}
    assert got == want and crosses.map_pairs(keys, splits, fields).count() == len(want)
    assert {(r["field1"], r["field2"]) for r in crosses.map_pairs(keys, splits).collect()} == {("f", "f"), ("o", "o")}


def test_seeds_of_a_pair_differ(spark):
    pairs = spark.createDataFrame([(1, 4, 4), (2, 4, 5)], "pair long, feed1 int, feed2 int")
    seeds = crosses.noise_seeds(pairs, 50, 3).collect()
    for pair in (1, 2):
        assert len({r["seed"] for r in seeds if r["pair"] == pair}) == 100


@pytest.mark.parametrize("symmetric", [True, False])
def test_spectra_and_noise_bank(spark, symmetric):
    maps = cubes()
    rows = as_rows(spark, maps)
    pairs = crosses.map_pairs(rows, spark.createDataFrame([(0, 1), (1, 1)], "split1 int, split2 int"), spark.createDataFrame([("f", "f"), ("f", "o")], "field1 string, field2 string"))
    out = crosses.pair_spectra(rows.repartition(5), pairs, SHAPE, STEPS, ACROSS, ALONG, 6, 7, 4, symmetric)
    got = {(r["pair"], r["run"], r["across"], r["along"]): r["power"] for r in out.collect()}
    again = {(r["pair"], r["run"], r["across"], r["along"]): r["power"] for r in crosses.pair_spectra(rows.repartition(2), pairs, SHAPE, STEPS, ACROSS, ALONG, 6, 7, 1, symmetric).collect()}
    assert got.keys() == again.keys() and all(abs(got[k] - again[k]) < 1e-12 for k in got)
    seeds = {(r["pair"], r["run"], r["side"]): r["seed"] for r in crosses.noise_seeds(pairs, 6, 7).collect()}
    for p in pairs.collect():
        (m1, s1), (m2, s2) = maps[p["field1"], p["split1"], p["feed1"]], maps[p["field2"], p["split2"], p["feed2"]]
        w1, w2 = plain_weights(s1, s2, symmetric)
        for run in range(-1, 6):
            a, b = (m1, m2) if run < 0 else (np.random.default_rng(seeds[p["pair"], run, k]).normal(size=SHAPE) * s for k, s in ((1, s1), (2, s2)))
            for at, v in plain_power(a * w1, b * w2).items():
                assert abs(got[p["pair"], run, *at] - v) < 1e-9
    data, runs = crosses.with_noise(out)
    one = data.first()
    assert abs(one["sigma"] - np.std([got[one["pair"], n, one["across"], one["along"]] for n in range(6)], ddof=1)) < 1e-12
    p = pairs.first()
    (_, s1), (_, s2) = maps[p["field1"], p["split1"], p["feed1"]], maps[p["field2"], p["split2"], p["feed2"]]
    see = crosses.pair_overlaps(rows, pairs).filter(F.col("pair") == p["pair"]).first()
    a, b = s1 > 0, s2 > 0
    assert abs(see["iou"] - np.mean((a & b).sum(axis=(0, 1)) / (a | b).sum(axis=(0, 1)))) < 1e-12
    v1, v2 = (np.where(s > 0, 1 / np.where(s > 0, s, 1), 0) for s in (s1, s2))
    assert abs(see["overlap"] - np.mean((v1 * v2).sum(axis=(0, 1)) / np.sqrt((v1**2).sum(axis=(0, 1)) * (v2**2).sum(axis=(0, 1))))) < 1e-12


def test_pair_spectra_query(spark):
    """The query's powers and sigmas by plain sums, pair by pair."""
    from lumenfold.plans import cross_queries

    assert (cross_queries.SHAPE, cross_queries.STEPS, cross_queries.ACROSS, cross_queries.ALONG) == (SHAPE, STEPS, ACROSS, ALONG)
    sf, maps = "/root/testdata/sf0.001", {}
    for r in cross_queries.cells(spark, sf).collect():
        m, s = maps.setdefault((r["field"], r["split"], r["feed"]), (np.zeros(SHAPE), np.zeros(SHAPE)))
        m[r["x"], r["y"], r["z"]], s[r["x"], r["y"], r["z"]] = r["map"], r["sigma"]
    got = {tuple(r[c] for c in (*crosses.SIDES, "across", "along")): (r["power"], r["sigma"]) for r in cross_queries.pair_spectra(spark, sf).collect()}
    pairs = cross_queries.pairs(spark, sf)
    seeds = {(r["pair"], r["run"], r["side"]): r["seed"] for r in crosses.noise_seeds(pairs, cross_queries.RUNS, cross_queries.SEED).collect()}
    pairs = pairs.collect()
    assert len(pairs) == 6 + 9 + 6 + 9 + 9 + 9 and len(got) == len(pairs) * len(plain_power(np.ones(SHAPE), np.ones(SHAPE)))
    for p in pairs[::5]:
        (m1, s1), (m2, s2) = maps[p["field1"], p["split1"], p["feed1"]], maps[p["field2"], p["split2"], p["feed2"]]
        w1, w2 = plain_weights(s1, s2, True)
        noise = [plain_power(*(np.random.default_rng(seeds[p["pair"], n, k]).normal(size=SHAPE) * s * w for k, s, w in ((1, s1, w1), (2, s2, w2)))) for n in range(cross_queries.RUNS)]
        for at, v in plain_power(m1 * w1, m2 * w2).items():
            power, sigma = got[*(p[c] for c in crosses.SIDES), *at]
            assert abs(power - v) < 1e-8 and abs(sigma - np.std([x[at] for x in noise], ddof=1)) < 1e-8


def plain_chi2(m, s, steps, kind, unit, runs, seed):
    w = np.where(s > 0, 1 / np.where(s > 0, s, 1) ** 2, 0)

    def power(x):
        if kind == "z":
            return (np.abs(np.fft.rfft(x, axis=2)) ** 2 * steps[2] / x.shape[2]).mean(axis=(0, 1))[1:]
        n = 3 if kind == "xyz" else 2
        p = np.abs(np.fft.fftn(x, axes=range(n))) ** 2 * np.prod(steps[:n]) / np.prod(x.shape[:n])
        p = p if n == 3 else p.mean(axis=2)
        k = np.sqrt(sum(np.meshgrid(*[(2 * np.pi * np.fft.fftfreq(n, d)) ** 2 for n, d in zip(p.shape, steps)], indexing="ij")))
        e = map_tests.EDGES[kind]
        out = []
        for lo, hi in zip(e, e[1:]):
            some = (k > 0) & (k >= lo) & ((k < hi) | ((hi == e[-1]) & (k == hi)))
            out.append(p[some].mean() if some.any() else 0)
        return np.array(out)

    noise = np.array([power(w * np.random.default_rng([seed, unit & (1 << 63) - 1, n]).normal(size=s.shape) * s) for n in range(runs)])
    p, std = power(w * m), noise.std(axis=0)
    ok = (p > 0) & (std > 0)
    z = ((p - noise.mean(axis=0))[ok] / std[ok])
    return None if len(z) < map_tests.FEWEST[kind] else np.sign((z**3).sum()) * abs(((z**2).sum() - len(z)) / np.sqrt(2 * len(z)))


def test_map_statistics_of_every_level(spark):
    g, steps, channels, bands, runs = np.random.default_rng(4), (15.0, 15.0, 4.0), 5, 2, 9
    scans = {(7, 702): (0, 1), (7, 703): (1,), (8, 802): (0, 1)}
    cells = {}
    for (obs, scan), sbs in scans.items():
        for feed in (1, 2):
            for sb in sbs:
                for at in np.ndindex(5, 4, channels):
                    if g.random() < 0.8:
                        cells[obs, scan, feed, sb, *at] = float(g.normal()), float(g.uniform(0.5, 2))
    rows = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "obsid int, scan int, feed int, sb int, x int, y int, chan int, map double, sigma double")
    squares = rows.withColumn("x", F.col("x") + 3)
    out = map_tests.map_statistics(rows.repartition(4), channels, bands, steps, squares, runs, 5)
    got = {(r["statistic"], r["obsid"], r["scan"], r["feed"], r["sb"]): r["value"] for r in out.collect()}
    levels = {0: (1, 1, 1), 1: (1, 1, 0), 3: (1, 0, 0), 4: (0, 1, 1), 5: (0, 1, 0), 7: (0, 0, 0)}
    units = {}
    for (obs, scan, feed, sb, x, y, c), (m, s) in cells.items():
        for level, keep in levels.items():
            unit = (level, obs, *(v if k else None for v, k in zip((scan, feed, sb), keep)))
            stack = units.setdefault(unit, {}).setdefault((x, y, c if keep[2] else sb * channels + c), [0, 0])
            stack[0] += m / s**2
            stack[1] += 1 / s**2
    ids = {(r["level"], r["obsid"], r["scan"], r["feed"], r["sb"]): r["u"] for r in map_tests.stacked_cells(rows, channels).select("level", *map_tests.UNIT, F.xxhash64("level", *map_tests.UNIT).alias("u")).distinct().collect()}
    seen = 0
    for unit, stack in units.items():
        at = np.array(list(stack))
        lo, hi = at.min(axis=0), at.max(axis=0)
        shape = (hi[0] - lo[0] + 1, hi[1] - lo[1] + 1, channels if unit[4] is not None else channels * bands)
        m, s = np.zeros(shape), np.zeros(shape)
        for (x, y, z), (num, den) in stack.items():
            m[x - lo[0], y - lo[1], z], s[x - lo[0], y - lo[1], z] = num / den, den**-0.5
        for kind in ("xyz", "z", "xy") if unit[0] == 0 else ("xyz",):
            name = map_tests.ONE_BAND[kind] if unit[0] == 0 else map_tests.NAMES[unit[0]]
            want, mine = plain_chi2(m, s, steps, kind, ids[unit], runs, 5), got[name, *unit[1:]]
            assert mine is None if want is None else abs(mine - want) < 1e-6, (unit, kind)
            seen += 1
    assert len(got) == seen + sum(k[0] == "ps_chi2" for k in got)
    assert {k[0] for k in got} == {*map_tests.NAMES.values(), *map_tests.ONE_BAND.values(), "ps_chi2"} and any(v is not None for v in got.values())


def test_square_maps(spark):
    rows = [(1, 101, 1, 0, 0, 10.0 + i, 0.1 * j, float(i + j), 2.0, (i + j) % 5 > 0) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(rows, "obsid int, scan int, feed int, sb int, chan int, ra double, dec double, value double, sigma0 double, kept boolean")
    out = map_tests.square_maps(df, 4, 1.0).collect()
    assert sum(round((2.0 / r["sigma"]) ** 2) for r in out) == sum(r[-1] for r in rows)
    assert map_tests.square_maps(df, 2, 0.1).agg(F.sum(F.lit(1))).first()[0] < 9
