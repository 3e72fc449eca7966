"""What made queries fail on larger tables: plans and sizes that grow faster than the input, and ties."""

import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_scans import plain_box_mask

from lumenfold.operators import filters, masking, scans, series, spectra
from lumenfold.plans import filter_queries, map_queries, scan_queries, signal_queries  # noqa: F401
from lumenfold.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_ranges_sort_runs_not_their_parts(spark):
    plan = plan_of(filter_queries.scan_ranges(spark, SF))
    assert plan.count("Generate explode") == 1
    above = plan[: plan.index("Generate explode")]
    assert "Window" not in above and "Sort" not in above and "Exchange" not in above


def test_edge_mask_limit_between_all_but_equal_values(spark):
    """|80.1 - 40.1| and |0.1 - 40.1| differ in their last bit; the limit lies 2 / 5 of the way between them, which is the lower one."""
    rows = [(1, t, v) for t, v in enumerate([40.1, 0.1, 20.1, 20.1, 40.1, 40.1, 60.1, 80.1, 120.1])]
    got = series.edge_mask(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], "t", "v", 0.8, 1).filter("masked").collect()
    assert sorted(r["t"] for r in got) == [0, 1, 7, 8]


def test_pointing_of_a_scan_of_very_many_blocks(spark):
    rows = spark.createDataFrame([(1, t / 4, 10.0, float(t)) for t in range(4001)], "feed int, at double, az double, el double")
    some = spark.createDataFrame([(1, 7, 0.0, 1000.0), (1, 8, 3.0, 3.5), (1, 9, 5.0, 5.0), (1, 10, None, 6.0)], "feed int, scanid int, start double, stop double")
    got = {r["scanid"]: (r["n"], r["mean_el"]) for r in scans.pointing_facts(rows, some, ["feed"], "at", "az", "el", 1e-7).collect()}
    assert got == {7: (4000, 2000.5), 8: (2, 13.5)}


@pytest.mark.parametrize("name", ["correlation_boxes", "correlation_blocks", "strongest_correlation", "mean_correlation"])
def test_pairs_are_summed_where_matrices_are(spark, name):
    """No rows of pairs: the plan has no column of correlations before what they come to."""
    plan = plan_of(plans.QUERIES[name](spark, SF))
    assert "FlatMapGroupsInPandas" in plan and "corr#" not in plan.split("FlatMapGroupsInPandas")[1].split("\n")[0]


def test_sums_and_largest_of_correlations_with_gaps(spark):
    g = np.random.default_rng(5)
    for gaps in (True, False):
        m = g.normal(size=(600, 12)) + 3
        m[7] = 2.0
        if gaps:
            m[g.random(m.shape) < 0.1] = np.nan
        rows = [(1, c, t, None if np.isnan(m[c, t]) else float(m[c, t])) for c in range(600) for t in range(12)]
        long = spark.createDataFrame(rows, "sb int, chan long, t int, value double").repartition(3)
        frame = pd.DataFrame(m.T)
        corr, common = frame.corr().to_numpy(), (~np.isnan(m)).astype(int) @ (~np.isnan(m)).T
        corr[7], corr[:, 7] = np.nan, np.nan
        a, b = np.indices(corr.shape)
        pair = (b - a >= 2) & (common > 0)
        sums = {(r["i"], r["j"]): r for r in spectra.correlation_sums(long, ["sb"], "chan", lambda c: c % 7 // 2, apart=2).collect()}
        for (i, j), r in sums.items():
            cell = corr[pair & (a % 7 // 2 == i) & (b % 7 // 2 == j)]
            some = cell[~np.isnan(cell)]
            assert (r["pairs"], r["valid"], r["nonzero"]) == (len(cell), len(some), len(some))
            assert np.allclose([r["total"], r["squares"], r["largest"]], [some.sum(), (some**2).sum(), np.abs(some).max()])
        assert len(sums) == 16
        got = {r["chan"]: r["largest"] for r in spectra.largest_correlation(long, ["sb"], "chan").collect()}
        both = np.abs(np.where((abs(a - b) >= 2) & (common > 0), corr, np.nan))
        assert len(got) == 600 and got[7] is None and all(np.isclose(got[c], np.nanmax(both[c])) for c in range(600) if c != 7)


def test_correlation_masks_by_panels(spark):
    g = np.random.default_rng(11)
    n, samples, jump, sizes = 299, 100, 4, (8, 16)
    m = g.normal(size=(n, samples))
    m[100:130] += 0.7 * g.normal(size=samples)
    m[3:6] += 2 * g.normal(size=samples)
    kept = g.random(n) > 0.1
    limits = ((9.0, 5.0, 9.0), (7.0, 6.0, 8.0)), ((9.0, 5.0), (8.0, 5.0))
    rows = spark.createDataFrame([(5, 2 * c, [float(x) for x in m[c]], bool(kept[c]), 0) for c in range(n)], "feed int, chan int, s array<double>, kept boolean, reason long")
    panels = masking._panels(rows.selectExpr("feed", "chan div 2 as _at", "299L as _of", "s", "kept"), ["feed"], "s", 16, jump).groupBy("_i", "_j", "_row").count().collect()
    assert len(panels) == 2 * 7 * 7 and max(r["count"] for r in panels) == 48 + jump  # seven panels of 48; before, one task had all
    got = {r["chan"] // 2: r for r in masking.mask_correlated(rows.repartition(3), ["feed"], "chan", "s", jump, 0.6, sizes, sizes, *limits).collect()}
    c = np.corrcoef(m)
    c[np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 1] = 0
    c[~kept] = 0
    c[:, ~kept] = 0
    want, _ = plain_box_mask(c, kept, samples, jump, sizes, sizes, *limits)
    strongest = np.abs(c).max(axis=1)
    assert 0 < want.sum() < kept.sum() and len(got) == n
    assert all(got[k]["kept"] == bool(want[k] and strongest[k] <= 0.6) and np.isclose(got[k]["strongest"], strongest[k]) for k in range(n))


def plain_noise_fit(d, bins=19):
    if len(d) < 8 or not np.ptp(d):
        return np.full(3, np.inf)
    f, p, modes = filters.binned_power(d, np.geomspace(1 / len(d), 0.5 + 1e-9, bins + 1))
    best, found = np.inf, np.full(3, np.inf)
    for knee in (f[0], f[len(f) // 2]):
        x, damp = np.array([np.log(p[len(p) // 2 :].mean()), np.log(knee), -1.0]), 1e-2

        def error(x):
            z = x[2] * (np.log(f) - x[1])
            return np.sqrt(modes) * (np.log(p) - x[0] - np.logaddexp(0, z)), z

        r, z = error(x)
        for _ in range(100):
            s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            jac = np.sqrt(modes)[:, None] * np.stack([np.ones_like(f), -s * x[2], s * (np.log(f) - x[1])], axis=1)
            h = jac.T @ jac
            trial = x + np.linalg.solve(h + damp * np.diag(np.diag(h)) + 1e-9 * np.eye(3), jac.T @ r)
            r2, z2 = error(trial)
            if np.isfinite(trial).all() and r2 @ r2 < r @ r:
                x, r, z, damp = trial, r2, z2, damp / 3
            else:
                damp = min(damp * 4, 1e9)
        if r @ r < best:
            best, found = r @ r, np.array([np.exp(x[0] / 2), np.exp(np.clip(x[1], -700, 700)), x[2]])
    return found


def test_noise_fits_of_a_batch_step_together(monkeypatch):
    g = np.random.default_rng(8)
    streams = [np.cumsum(g.normal(size=64)) * 0.2 + g.normal(size=64) for _ in range(40)] + [g.normal(size=100), np.ones(64), np.ones(3), np.empty(0)]
    want, steps, solve = [plain_noise_fit(d) if len(d) else d for d in streams], [0], np.linalg.solve

    def counted(*a):
        steps[0] += 1
        return solve(*a)

    monkeypatch.setattr(np.linalg, "solve", counted)
    got = filters.noise_parameters(streams)
    assert steps[0] == 400  # two lengths, two starts; before, 200 for each row
    assert sum(np.allclose(a, b, rtol=1e-5) for a, b in zip(got, want)) >= 42 and all(a.shape == b.shape for a, b in zip(got, want))


def test_arrays_of_correlations_are_repeated_for_large_blocks_only(spark):
    long = spark.range(600 * 4).selectExpr("1 as sb", "id div 4 as chan", "id % 4 as t", "hash(id) / 1e9 as value")
    most = int(inspect.signature(spectra.correlation).parameters["block"].default)
    met = spectra._meet(long, ["sb"], "chan", "t", F.ceil(F.col("_n") / most))
    assert met.count() == 600  # blocks of 256 made 1,800


@pytest.mark.parametrize("name", ["corr_matrix", "corr_matrix_all"])
def test_correlations_are_rounded_where_the_matrix_is(spark, name):
    """Not pair by pair above it; halves go away from 0, and 0 has no sign."""
    assert "round(" not in plan_of(plans.QUERIES[name](spark, SF))
    m = np.array([[1.0, 0, 0, -1], [1, 1, -1, -1], [-1, 9, 9, 1], [3, 3, 3, 3], [1, -1e-7, 1e-7, 1]])
    long = spark.createDataFrame([(1, c, t, float(m[c, t])) for c in range(5) for t in range(4)], "sb int, chan long, t int, value double")
    got = {(r["a"], r["b"]): r["corr"] for r in spectra.correlation(long, ["sb"], "chan", digits=1).collect()}
    assert got[0, 1] == 0.7 and got[0, 2] == -0.2 and got[0, 3] is None and str(got[1, 4]) == "0.0" and len(got) == 10
