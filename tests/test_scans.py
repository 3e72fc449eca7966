"""Mode filters, correlation masks and split names against plain NumPy and Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import averages, masking, modes, splits
from lumenfold.plans import queries as plans
from lumenfold.plans import scan_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def streams(spark, seed=1, channels=60, samples=200, strong=3):
    g = np.random.default_rng(seed)
    m = g.normal(size=(channels, samples)) + 8 * g.normal(size=(channels, strong)) @ g.normal(size=(strong, samples)) + g.normal(size=(channels, 1))
    rows = [(1, c, [float(x) for x in m[c]], c % 10 != 0) for c in range(channels)] + [(2, c, [float(x) for x in g.normal(size=samples)], True) for c in range(30)]
    return spark.createDataFrame(rows, "scan long, chan long, s array<double>, kept boolean"), m


def test_pca_filter_takes_the_strong_modes(spark):
    rows, m = streams(spark)
    kept = np.arange(60) % 10 != 0
    centred = (m - m.mean(axis=1, keepdims=True))[kept]
    _, want, v = np.linalg.svd(centred, full_matrices=False)
    cleaned, found = modes.pca_filter(rows.repartition(5), "scan", "chan", "s", "kept", most=6)
    got = {r["scan"]: r for r in found.collect()}
    assert np.allclose(got[1]["singular"][:3], want[:3], rtol=1e-6) and got[1]["n_modes"] == 3 and got[2]["n_modes"] == 2
    sigma = (np.std(np.diff(m[kept], axis=1), axis=1) / np.sqrt(2)).mean()
    assert np.isclose(got[1]["edge"], modes.noise_edge(200, 54, sigma, 1.005)) and got[1]["channels"] == 54
    out = {r["chan"]: r for r in cleaned.filter("scan = 1").collect()}
    left = m - (m @ v[:3].T) @ v[:3]
    assert len(out) == 60 and max(np.abs(np.array(out[c]["cleaned"]) - left[c]).max() for c in out) < 1e-5
    assert all(np.allclose(np.abs(out[c]["amplitudes"]), np.abs(m[c] @ v[:3].T), atol=1e-5) for c in out)


def test_pca_feed_filter_uses_weighted_blocks(spark):
    g = np.random.default_rng(4)
    m = g.normal(size=(64, 150)) + 6 * np.outer(g.normal(size=64), g.normal(size=150))
    w = g.uniform(0.5, 2, 64) * (np.arange(64) % 9 != 0)
    rows = spark.createDataFrame([(3, c, [float(x) for x in m[c]], float(w[c])) for c in range(64)], "feed long, chan long, s array<double>, w double")
    blocks = {r["block"]: np.array(r["stream"]) for r in modes.block_streams(rows.repartition(4), "feed", "chan", "s", "w", 4).collect()}
    want = np.array([(w[4 * b : 4 * b + 4] @ m[4 * b : 4 * b + 4]) / (w[4 * b : 4 * b + 4] ** 2).sum() / (4 / np.sqrt((w[4 * b : 4 * b + 4] ** 2).sum())) for b in range(16)])
    assert all(np.allclose(blocks[b], want[b]) for b in range(16))
    cleaned, found = modes.pca_feed_filter(rows, "feed", "chan", "s", "w", 4)
    assert found.first()["n_modes"] == 1
    u = np.linalg.svd(want - want.mean(axis=1, keepdims=True), full_matrices=False)[2][0]
    assert all(np.allclose(r["cleaned"], m[r["chan"]] - (m[r["chan"]] @ u) * u, atol=1e-5) for r in cleaned.collect())


def plain_box_mask(c, kept, samples, jump, boxes, stripes, box_limits, stripe_limits):
    c, kept, names = c.copy(), kept.copy(), [set() for _ in kept]

    def hit(lo, hi, name):
        kept[lo:hi] = False
        for x in range(lo, hi):
            names[x].add(name)

    for k in range(len(boxes)):
        b = boxes[k]
        for i in range(len(c) // b):
            for j in range(i + 1, len(c) // b):
                box = c[i * b : (i + 1) * b, j * b : (j + 1) * b]
                dof = max(1, (box != 0).sum())
                pr = box[:-jump:2] * box[jump::2]
                tests = {"chi2": ((box**2).sum() * samples - dof) / np.sqrt(2 * dof) > box_limits[k][0], "prod": pr.sum() * samples / np.sqrt(max(1, (pr != 0).sum())) > box_limits[k][1],
                         "sum": abs(box.sum()) * np.sqrt(samples / dof) > box_limits[k][2]}
                for name, bad in tests.items():
                    if bad:
                        hit(i * b, (i + 1) * b, f"box {b} {name}")
                        hit(j * b, (j + 1) * b, f"box {b} {name}")
        c[~kept] = 0
        c[:, ~kept] = 0
        s = stripes[k]
        for i in range(len(c) // s):
            part = c[i * s : (i + 1) * s].copy()
            for x in range(s):
                part[x:, x] = 0
            dof = max(1, (part != 0).sum())
            pr = part[:, :-jump:2] * part[:, jump::2]
            if ((part**2).sum() * samples - dof) / np.sqrt(2 * dof) > stripe_limits[k][0]:
                hit(i * s, (i + 1) * s, f"stripe {s} chi2")
            if pr.sum() * samples / np.sqrt(max(1, (pr != 0).sum())) > stripe_limits[k][1]:
                hit(i * s, (i + 1) * s, f"stripe {s} prod")
        c[~kept] = 0
        c[:, ~kept] = 0
    return kept, names


def test_correlation_masks_against_plain_loops(spark):
    g = np.random.default_rng(7)
    n, samples = 256, 400
    m = g.normal(size=(n, samples))
    m[40:70] += 0.6 * g.normal(size=samples)
    m[200:203] += 2 * g.normal(size=samples)
    kept = g.random(n) > 0.1
    how = dict(boxes=(32, 128), stripes=(32, 128), box_limits=((6.0, 5.0, 9.0), (4.8, 4.2, 8.0)), stripe_limits=((9.0, 3.5), (6.0, 3.0)))
    rows = spark.createDataFrame([(5, c, [float(x) for x in m[c]], bool(kept[c]), 0) for c in range(n)], "feed int, chan int, s array<double>, kept boolean, reason long")
    got = {r["chan"]: r for r in masking.mask_correlated(rows.repartition(3), ["feed"], "chan", "s", 16, 0.5, **how).collect()}
    c = np.corrcoef(m)
    c[np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 1] = 0
    c[~kept] = 0
    c[:, ~kept] = 0
    want, names = plain_box_mask(c, kept, samples, 16, **how)
    strongest = np.abs(c).max(axis=1)
    assert 0 < want.sum() < kept.sum()
    for k in range(n):
        bits = sum(masking.reason(x) for x in names[k]) | (masking.reason("correlated") if strongest[k] > 0.5 else 0)
        assert (got[k]["kept"], got[k]["reason"]) == (bool(want[k] and strongest[k] <= 0.5), bits) and np.isclose(got[k]["strongest"], strongest[k])


def test_reason_bits_are_never_added(spark):
    rows = spark.createDataFrame([(1, True, 0), (2, True, 2), (3, True, 0)], "c int, kept boolean, reason long")
    twice = masking.flag(masking.flag(rows, F.col("c") < 3, "marked"), F.col("c") == 1, "marked")
    assert {tuple(r) for r in twice.collect()} == {(1, False, 2), (2, False, 2), (3, True, 0)}


def test_split_pairs():
    assert splits.split_pairs(["elev"], ["ambt"], ["elev"]) == [
        ("elev0ambt0", "elev1ambt0"), ("elev0ambt0", "elev0ambt0"), ("elev1ambt0", "elev1ambt0"), ("elev0ambt1", "elev1ambt1"), ("elev0ambt1", "elev0ambt1"), ("elev1ambt1", "elev1ambt1")]
    crossed = splits.split_pairs(["wind"], ["elev", "ambt"], ["elev"])
    assert ("wind1elev0ambt1", "wind1elev1ambt1") in crossed and len(crossed) == 2 * 3 * 2
    assert (("wind0elev0", "wind1elev0"), ("wind0elev1", "wind1elev1")) in splits.split_pairs(["wind"], ["elev"], ["elev"], null_difference=True)


def test_random_splits_are_halves(spark):
    rows = spark.range(4000).select(F.col("id").alias("scanid"), (F.col("id") % 2).cast("int").alias("feed"), F.lit(0).alias("sb"), (F.col("id") % 7 > 0).alias("accepted"), F.rand(1).alias("el"), (F.col("id") * 7 % 360).cast("double").alias("sidereal"))
    got = splits.split_bits(rows, ["rnda", "rndb"], "co2").groupBy("feed", "accepted").agg(*[F.avg(F.expr(f"bits >> {b} & 1")).alias(f"b{b}") for b in range(3)]).collect()
    for r in got:
        assert (r["b0"], r["b1"], r["b2"]) == (0, 0, 0) if not r["accepted"] else r["b0"] == 1 and abs(r["b1"] - 0.5) < 0.01 and abs(r["b2"] - 0.5) < 0.01


@pytest.mark.parametrize("x,n", [(3.2, 2), (18.3, 10), (100.0, 100), (20.0, 60), (0.0, 4)])
def test_chi2_survival_of_even_degrees(x, n):
    """exp(-x / 2) sum((x / 2)^k / k!) over k < n / 2."""
    term = total = 1.0
    for k in range(1, n // 2):
        term *= x / 2 / k
        total += term
    assert np.isclose(averages.chi2_survival(x, n), np.exp(-x / 2) * total, rtol=1e-10)
    assert np.isclose(averages.chi2_survival(3.841458820694124, 1), 0.05)
