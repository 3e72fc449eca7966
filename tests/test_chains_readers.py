"""Chains of filters, readers of text and stores, spherical cross spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_crosses import SHAPE, STEPS, as_rows, cubes, plain_weights

from lumenfold.operators import crosses, modes, splits
from lumenfold.plans import chain
from lumenfold.sources import tables, text


def test_chain_dumps_and_takes_up(spark, tmp_path):
    calls = []

    def shift(rows, by):
        calls.append(by)
        return rows.withColumn("v", F.col("v") + by)

    chain.register_filter("shift", shift)
    chain.register_filter("double", lambda rows: rows.withColumn("v", F.col("v") * 2))
    chain.register_filter("shift", shift)
    with pytest.raises(ValueError):
        chain.register_filter("shift", lambda rows: rows)
    with pytest.raises(ValueError):
        chain.run_chain(spark.range(1), [("nothing", {})])
    rows = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    steps = [("shift", {"by": 3}), ("double", {}), ("shift", {"by": -1})]
    for how in ({}, {"settle": True}, {"dump": str(tmp_path)}):
        assert sorted(r["v"] for r in chain.run_chain(rows, steps, **how).collect()) == [7.0, 9.0]
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "01-double")).collect()) == [8.0, 10.0]
    calls.clear()
    assert sorted(r["v"] for r in chain.run_chain(rows.limit(0), steps, dump=str(tmp_path), done=2).collect()) == [7.0, 9.0] and calls == [-1]


def test_split_roles_feed_bits_keys_and_pairs(spark, tmp_path):
    (tmp_path / "splits.txt").write_text("6 splits\naccr 1\nambt 3   # air\nazdr 3 $ \nelev 2 1 # crossed\ndayn 2\nwind 3 1\nbad line\n")
    roles = text.split_roles(spark, str(tmp_path / "splits.txt"))
    assert roles == {"bits": ["ambt", "elev", "dayn", "wind"], "primary": ["elev", "dayn"], "secondary": ["ambt", "azdr", "wind"], "temporal": ["azdr"], "cross": ["elev", "wind"], "cross_primary": ["elev"], "cross_secondary": ["wind"]}
    keys = splits.map_keys(F.lit(0b10101), roles["bits"], roles["primary"], roles["secondary"], roles["temporal"])
    got = sorted(r[0] for r in spark.range(1).select(F.explode(keys)).collect())
    assert got == ["dayn0wind1azdr0ambt0", "dayn0wind1azdr1ambt0", "elev1wind1azdr0ambt0", "elev1wind1azdr1ambt0"]


def test_profile_and_absent_stores(spark, tmp_path):
    (tmp_path / "r.txt").write_text("0.0\n0.5\n1.0\n")
    (tmp_path / "v.txt").write_text("1.0\n0.25\n0.0")
    assert sorted(tuple(r) for r in text.read_profile(spark, str(tmp_path / "r.txt"), str(tmp_path / "v.txt")).collect()) == [(0.0, 1.0), (0.5, 0.25), (1.0, 0.0)]
    none = tables.read_or_none(spark, str(tmp_path), "calibrations", "obsid long, tsys double")
    assert none.count() == 0 and none.columns == ["obsid", "tsys"]
    tables.append_store(spark.createDataFrame([(7, 40.0)], "obsid long, tsys double"), str(tmp_path), "calibrations", ["obsid"])
    assert tables.read_or_none(spark, str(tmp_path), "calibrations", "obsid long, tsys double", obsid=7).first()["tsys"] == 40.0


def test_modes_of_another_run_are_imported(spark, tmp_path):
    g = np.random.default_rng(1)
    m = g.normal(size=(30, 50)) + 9 * np.outer(g.normal(size=30), g.normal(size=50))
    rows = spark.createDataFrame([(1, c, [float(x) for x in m[c]], True) for c in range(30)], "scan long, chan long, s array<double>, kept boolean")
    cleaned, found = modes.pca_filter(rows, "scan", "chan", "s", "kept", least=1)
    tables.append_store(found, str(tmp_path), "modes", ["scan"])
    again = modes.subtract_streams(rows, tables.read_store(spark, str(tmp_path), "modes", scan=1), "scan", "chan", "s")
    first, second = ({r["chan"]: r["cleaned"] for r in x.collect()} for x in (cleaned, again))
    assert all(np.allclose(first[c], second[c], atol=1e-9) for c in first) and len(second) == 30


def test_spherical_cross_spectra(spark):
    maps = {k: v for k, v in cubes().items() if k in (("f", 0, 1), ("f", 1, 1))}
    rows = as_rows(spark, maps)
    pairs = crosses.map_pairs(rows, spark.createDataFrame([(0, 1)], "split1 int, split2 int"))
    edges = [0.3, 1.0, 2.0, 3.0]
    got = {r["across"]: (r["power"], r["modes"]) for r in crosses.pair_spectra(rows, pairs, SHAPE, STEPS, edges, None).collect()}
    (m1, s1), (m2, s2) = maps["f", 0, 1], maps["f", 1, 1]
    w1, w2 = plain_weights(s1, s2, True)
    p = np.real(np.fft.fftn(m1 * w1) * np.conj(np.fft.fftn(m2 * w2))) * np.prod(STEPS) / np.prod(SHAPE)
    k = np.sqrt(sum(np.meshgrid(*[(2 * np.pi * np.fft.fftfreq(n, d)) ** 2 for n, d in zip(SHAPE, STEPS)], indexing="ij")))
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        some = (k > 0) & (k >= lo) & (k < hi)
        assert abs(got[i][0] - p[some].mean()) < 1e-9 and got[i][1] == some.sum()
