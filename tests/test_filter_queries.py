"""Queries that SQL can't express, by plain Python and NumPy over the same tables."""

import struct
from collections import defaultdict

import numpy as np
import xxhash
from test_crosses import SHAPE, STEPS, plain_power  # noqa: F401
from test_scans import plain_box_mask

from lumenfold.operators import masking, modes
from lumenfold.plans import filter_queries
from lumenfold.plans.scan_queries import scan_table

SF = "/root/testdata/sf0.001"


def plain_hash(*parts):
    """xxhash64 of columns: each one's bytes, seeded by the hash before."""
    h = 42
    for kind, v in parts:
        h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack({"l": "<q", "i": "<i"}[kind], v), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_runlist_parts(spark):
    ids = [r[0] for r in scan_table(spark, SF).select("scanid").collect()]
    assert sorted(r[0] for r in filter_queries.runlist_parts(spark, SF).collect()) == sorted(i for i in ids if plain_hash(("l", i), ("i", 42)) % 4 == 1)


def test_random_halves(spark):
    rows = filter_queries.random_half_bits(spark, SF).collect()
    el, groups = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["accepted"]:
            el[r["feed"], r["sb"]].append(r["el"])
    for r in rows:
        if r["accepted"]:
            groups[r["feed"], r["sb"], r["el"] < np.median(el[r["feed"], r["sb"]]), r["sidereal"] < 231].append(r)
        else:
            assert r["bits"] == 0
    for some in groups.values():
        draws = {n: [plain_hash(("l", r["scanid"]), ("s", n), ("i", 3)) % (1 << 52) / (1 << 52) for r in some] for n in ("rnda", "trtp")}
        for k, r in enumerate(some):
            assert r["bits"] == 1 + sum(bit * bool(draws[n][k] > np.median(draws[n])) for n, bit in (("rnda", 2), ("trtp", 4)))


def test_filled_gaps(spark):
    by = defaultdict(list)
    for r in filter_queries.filled_gaps(spark, SF).orderBy("t").collect():
        by[r["feed"]].append(r)
    gaps = 0
    for feed, rows in by.items():
        for k, r in enumerate(rows):
            near = [x["value"] for x in rows[max(0, k - 10) : k + 11] if x["value"] is not None]
            if r["value"] is not None:
                assert r["filled"] == r["value"]
            elif near:
                u = [(plain_hash(("l", feed), ("l", r["t"]), ("i", 5), ("i", j)) % (1 << 52) + 0.5) / (1 << 52) for j in (0, 1)]
                gaps += 1
                assert abs(r["filled"] - np.mean(near) - np.std(near) * np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])) < 1e-9
    assert gaps


def bands(spark, sf):
    out = defaultdict(list)
    for r in filter_queries._bands(spark, sf).orderBy("band", "chan").collect():
        out[r["band"]].append(r)
    return {b: (np.array([r["samples"] for r in rows]), np.array([r["kept"] for r in rows]), np.array([r["weight"] for r in rows])) for b, rows in out.items()}


def test_correlation_masks(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["band"], r["chan"]): r for r in filter_queries.correlation_masks(spark, sf).collect()}
    for band, (m, kept, _) in bands(spark, sf).items():
        n = len(m)
        c = np.corrcoef(m)
        c[np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 1] = 0
        c[~kept] = 0
        c[:, ~kept] = 0
        want, names = plain_box_mask(c, kept, 64, 4, (16, 32), (16, 32), ((16.0, 5.0, 9.0), (4.8, 4.2, 8.0)), ((9.0, 3.5), (6.0, 3.0)))
        for k in range(n):
            strongest = np.abs(c[k]).max()
            bits = sum(masking.reason(x) for x in names[k] if x in masking.REASONS) | (masking.reason("correlated") if strongest > 0.99 else 0)
            assert (got[band, k]["kept"], got[band, k]["reason"]) == (bool(want[k] and strongest <= 0.99), bits)


def test_mode_filters(spark):
    sf = "/root/testdata/sf0.01"
    got = {name: {(r["band"], r["chan"]): np.array(r["cleaned"]) for r in filter_queries.QUERIES[name](spark, sf).collect()} for name in ("scan_mode_filter", "detector_mode_filter")}
    for band, (m, kept, w) in bands(spark, sf).items():
        some = m[kept]
        s, v = np.linalg.svd(some - some.mean(axis=1, keepdims=True), full_matrices=False)[1:]
        edge = modes.noise_edge(64, len(some), (np.std(np.diff(some, axis=1), axis=1) / np.sqrt(2)).mean(), 9.0)
        n = max(2, int((s[:6] > edge).sum()))
        assert n == 2
        left = m - (m @ v[:n].T) @ v[:n]
        assert max(np.abs(got["scan_mode_filter"][band, k] - left[k]).max() for k in range(len(m))) < 1e-5
        streams = []
        for b in range(-(-len(m) // 3)):
            ww = w[3 * b : 3 * b + 3]
            if (ww > 0).any():
                size = (ww**2).sum()
                streams.append(ww @ m[3 * b : 3 * b + 3] / size / (3 / np.sqrt(size)))
        streams = np.array(streams)
        v = np.linalg.svd(streams - streams.mean(axis=1, keepdims=True), full_matrices=False)[2]
        left = m - (m @ v[:2].T) @ v[:2]
        assert max(np.abs(got["detector_mode_filter"][band, k] - left[k]).max() for k in range(len(m))) < 1e-5


def test_map_spectra(spark):
    maps = defaultdict(lambda: (np.zeros(SHAPE), np.zeros(SHAPE)))
    for r in filter_queries.units(spark, SF).collect():
        m, w = maps[r["unit"]]
        m[r["x"], r["y"], r["z"]], w[r["x"], r["y"], r["z"]] = r["map"], r["sigma"] ** -2
    got = {(r["unit"], r["across"], r["along"]): r["power"] for r in filter_queries.map_spectra(spark, SF).collect()}
    assert len(maps) == 12
    for unit, (m, w) in maps.items():
        x = m * w / np.sqrt((w**2).mean())
        for at, v in plain_power(x, x).items():
            assert abs(got[unit, *at] - v) < 1e-9


def test_map_highpass_query(spark):
    """Every channel's map by weighted least squares of its waves."""
    from lumenfold.plans import signal_queries
    from lumenfold.plans.queries import QUERIES

    maps = defaultdict(dict)
    for r in signal_queries._maps(spark, SF).collect():
        maps[r["feed"], r["sb"], r["chan"]][r["dec_i"], r["ra_i"]] = r["map"], r["sigma"]
    got = {(r["feed"], r["sb"], r["chan"], r["dec_i"], r["ra_i"]): r["cleaned"] for r in QUERIES["map_highpass"](spark, SF).collect()}
    waves = [(0, 0), (0, 1), (1, 0), (1, 1)]
    for key, cells in list(maps.items())[::37]:
        at = np.array(list(cells))
        m, s = np.array(list(cells.values())).T
        phase = 2 * np.pi * np.stack([i * at[:, 0] / 10 + j * at[:, 1] / 12 for i, j in waves], axis=1)
        basis = np.hstack([np.cos(phase), np.sin(phase)])
        fit = basis @ np.linalg.lstsq(basis / s[:, None], m / s, rcond=1e-8)[0]
        for (dec, ra), v in zip(at, m - fit):
            assert abs(got[*key, dec, ra] - v) < 1e-6 * np.abs(m).max()
