"""Every relational query against its SQL in DuckDB, and the sources, stream and numeric operators."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import maps, series, spectra
from lumenfold.plans import queries as plans
from lumenfold.plans import signal_queries  # noqa: F401
from lumenfold.sources.text import read_scans, read_splits
from lumenfold.streaming.maps import stream_map, streamed_map

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "events", "embeddings", "orders", "customer", "part", "supplier", "nation", "region")


def canonical(frame):
    rows = frame[sorted(frame.columns)].astype(object).itertuples(index=False)
    return list(tuple("" if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x) for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(plans.ORACLES[name]).df(), plans.QUERIES[name](spark, SF).toPandas()
    key = lambda row: tuple(map(str, row))
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(canonical(got), key=key) == sorted(canonical(want), key=key)


def test_principal_components_match_svd(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = frame.filter("label = 1").toPandas()
    want = np.linalg.svd(np.stack(rows.embedding).astype(float), compute_uv=False)[:5]
    got = spectra.principal_components(frame, "label", "embedding", 5).filter("label = 1").orderBy("component").toPandas().singular
    assert np.allclose(got, want, rtol=1e-6)


def test_highpass_keeps_fast_and_drops_constant(spark):
    wave = [5.0 + (-1.0) ** i for i in range(64)]
    out = spectra.highpass(spark.createDataFrame([(1, wave)], "k int, s array<double>"), "k", "s", 0.01, 4.0).first()["filtered"]
    assert np.allclose(out, [(-1.0) ** i for i in range(64)], atol=1e-3)


def test_constant_samples_make_a_constant_map(spark):
    rows = [(f, i % 3, i % 2, 0, 0, 7.0, 0.5 + i, True) for f in (1, 6) for i in range(12)]
    tod = spark.createDataFrame(rows, "feed int, dec_i int, ra_i int, sb int, chan int, value double, w double, ok boolean")
    assert {r["map"] for r in maps.coadd_levels(maps.bin_map(tod)).collect()} == {7.0}


def test_intervals_at_the_ends(spark):
    rows = spark.createDataFrame([(1, t, t in (0, 1, 4, 5)) for t in range(6)] + [(2, t, False) for t in range(3)], "k int, t int, on boolean")
    assert {tuple(r) for r in series.on_intervals(rows, ["k"], "t", "on").select("k", "start", "stop").collect()} == {(1, 0, 2), (1, 4, 5)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "runs").write_text("1\nco6 1\n  000123 58000.1 58000.2 2 path/a\n   00012302 58000.10 58000.12 32 1.0\n   00012303 58000.12 58000.14 16 1.0\n")
    assert [(r["scanid"], r["scantype"]) for r in read_scans(spark, str(tmp_path / "runs")).collect()] == [(12302, 32), (12303, 16)]
    (tmp_path / "splits").write_text("3\nname type\nelev 2 # quadrants\nambt 3 1\nazdr 3 $\n")
    assert [tuple(r) for r in read_splits(spark, str(tmp_path / "splits")).collect()] == [("elev", 2, False, False), ("ambt", 3, True, False), ("azdr", 3, False, True)]


def test_streamed_map_equals_batch_map(spark, tmp_path):
    tod = plans.tod(spark, SF)
    for i in range(2):
        tod.filter(F.col("feed") % 2 == i).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = str(tmp_path / "in" / "*")
    stream_map(spark, source, tod.schema, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    got, want = streamed_map(spark, str(tmp_path / "out")), maps.bin_map(tod)
    assert got.select(*maps.PIXEL, "nhit").exceptAll(want.select(*maps.PIXEL, "nhit")).count() == 0 and got.count() == want.count()
