"""Scan statistics, map keys, null-test tables and stores against plain loops and known answers."""

import numpy as np
from pyspark.sql import functions as F
from test_crosses import plain_power, plain_weights

from lumenfold.operators import averages, crosses, series, spectra, splits, statistics
from lumenfold.plans import cross_queries, statistic_queries
from lumenfold.sources import tables

SF = "/root/testdata/sf0.001"


def test_azimuth_chi2_of_channels(spark):
    g = np.random.default_rng(1)
    rows = [(1, c, float(a), float(v), float(c + 1)) for c in range(3) for a, v in zip(g.uniform(10, 20, 200), g.normal(size=200))] + [(2, 0, 5.0, 1.0, 1.0)]
    out = {r["feed"]: r for r in statistics.azimuth_chi2(spark.createDataFrame(rows, "feed int, chan int, az double, v double, s double"), ["feed"], "chan", "az", "v", "s").collect()}
    chi2 = []
    for c in range(3):
        az, v = np.array([(r[2], r[3] / r[4]) for r in rows if r[0] == 1 and r[1] == c]).T
        total, hits = np.histogram(az, 15, weights=v)[0], np.histogram(az, 15)[0]
        chi2.append(((total**2 / np.maximum(hits, 1)).sum() - 15) / np.sqrt(30))
    assert np.allclose([out[1]["az_chi2"], out[1]["max_az_chi2"], out[1]["med_az_chi2"]], [sum(chi2) / np.sqrt(3), max(chi2), np.median(chi2)])


def test_frames(spark):
    one = spark.createDataFrame([(266.405, -28.936), (192.85948, 27.12825), (0.0, 90.0)], "ra double, dec double")
    lon, lat = statistics.galactic(F.col("ra"), F.col("dec"))
    got = [tuple(r) for r in one.select(lon, lat).collect()]
    assert min(abs(got[0][0]), abs(got[0][0] - 360)) < 0.01 and abs(got[0][1]) < 0.01 and abs(got[1][1] - 90) < 1e-5 and abs(got[2][0] - 122.93192) < 1e-6
    sky = spark.createDataFrame([(0.0, 37.0, 50.0), (180.0, 53.0, 50.0), (90.0, 0.0, 50.0)], "az double, alt double, sid double")
    ra, dec = statistics.sky_of(F.col("az"), F.col("alt"), F.col("sid"), 37.0)
    pole, south, east = [tuple(r) for r in sky.select(ra, dec).collect()]
    assert abs(pole[1] - 90) < 1e-5 and abs(south[0] - 50) < 1e-6 and abs(south[1]) < 1e-6 and abs(east[0] - 140) < 1e-6 and abs(east[1]) < 1e-6
    up = statistics.side_lobes(spark.createDataFrame([(33.0, 90.0, 10.0)], "az double, alt double, sid double"), "az", "alt", "sid", 37.0).first()
    for k, around in enumerate((0.0, 180.0, 90.0, 270.0), 1):  # pointing up, lobes stand at 25 degrees
        lon, lat = statistics.galactic(*statistics.sky_of(F.lit(33.0 + around), F.lit(25.0), F.lit(10.0), 37.0))
        want = spark.range(1).select(lon, lat).first()
        assert np.allclose([up[f"galaxy_sl{k}_lon"], up[f"galaxy_sl{k}_lat"]], tuple(want))


def test_standing_waves_and_the_long_table(spark):
    rows = spark.createDataFrame([(70002, 1), (70003, 1), (80002, 2)], "scanid long, feed int")
    waves = spark.createDataFrame([(700, 1, 1, *map(float, range(14)))], "obsid long, scan long, feed int, " + ", ".join(f"sw_{k:02d} double" for k in range(1, 15)))
    got = {r["scanid"]: r["sw_14"] for r in statistics.with_standing_waves(rows, waves).collect()}
    assert got == {70002: None, 70003: 13.0, 80002: None}
    noise = rows.withColumn("n", statistics.thermal_noise(F.lit(40.0), 2e6, 50.0)).withColumn("hits", F.lit(3))
    long = statistics.long_statistics(["scanid", "feed"], noise, rows.select("*", F.lit("sw").alias("statistic"), F.lit(1).alias("value")))
    assert long.count() == 9
    wide = statistics.wide_statistics(long, ["scanid", "feed"], ["n", "sw", "absent"]).filter("scanid = 70002").first()
    assert np.isclose(wide["n"], 40 / np.sqrt(2e6 / 50)) and wide["sw"] == 1 and wide["absent"] is None


def test_map_keys(spark):
    one = spark.createDataFrame([(0b1011,), (0b0110,)], "bits long")
    keys = splits.map_keys(F.col("bits"), ["ambt", "wind", "elev"], ["elev"], ["ambt", "azdr", "schf"], ["azdr", "schf"])
    got = [r[0] for r in one.select(keys).collect()]
    assert sorted(got[0]) == sorted(f"elev1schf{a}azdr{b}ambt1" for a in "01" for b in "01") and got[1] == []


def test_null_test_table(spark):
    g = np.random.default_rng(2)
    rows = [(f"t{k}", c, float(p)) for c in ("co2", "co6") for k, p in enumerate(g.random(30) ** (1 if c == "co2" else 4))] + [("t0", "co9", 0.5)]
    out = averages.pte_table(spark.createDataFrame(rows, "test string, field string, pte double"), "test", "field", "pte", ["co2", "co6"]).collect()
    ks = [r for r in out if r["last"]]
    assert len(out) == 31 and len(ks) == 1 and ks[0]["co2"] > 0.05 > 0.001 > ks[0]["co6"]


def test_stores_take_new_keys_only(spark, tmp_path):
    first = spark.createDataFrame([("a", "b", 1, 1.0), ("a", "c", 1, 2.0)], "split1 string, split2 string, feed int, power double")
    tables.append_store(first, str(tmp_path), "spectra", ["split1", "split2", "feed"])
    tables.append_store(first.withColumn("power", F.lit(9.0)).unionByName(spark.createDataFrame([("a", "b", 2, 3.0)], first.schema)), str(tmp_path), "spectra", ["split1", "split2", "feed"])
    assert sorted((r["split2"], r["feed"], r["power"]) for r in tables.read_store(spark, str(tmp_path), "spectra").collect()) == [("b", 1, 1.0), ("b", 2, 3.0), ("c", 1, 2.0)]


def test_block_correlation_with_gaps_and_blocks(spark):
    g = np.random.default_rng(3)
    m = g.normal(size=(7, 40)) + 100
    m[6] = 5.0
    m[g.random(m.shape) < 0.2] = np.nan
    rows = [("x", f"c{c}", t, None if np.isnan(m[c, t]) else float(m[c, t])) for c in range(7) for t in range(40) if not (np.isnan(m[c, t]) and c % 2)]
    long = spark.createDataFrame(rows, "sb string, chan string, t int, value double")
    for block in (256, 2):
        got = {(r["a"], r["b"]): r["corr"] for r in spectra.correlation(long.repartition(3), ["sb"], "chan", block=block).collect()}
        assert len(got) == 21
        for a in range(7):
            for b in range(a + 1, 7):
                ok = ~np.isnan(m[a]) & ~np.isnan(m[b])
                if b == 6:
                    assert got[f"c{a}", "c6"] is None or abs(got[f"c{a}", "c6"]) < 1e-6
                else:
                    assert abs(got[f"c{a}", f"c{b}"] - np.corrcoef(m[a][ok], m[b][ok])[0, 1]) < 1e-9


def test_scan_ranges_of_rests_and_open_runs(spark):
    day = 1 / 1440
    rows = [(1, k * day, 0, None, "ces", "halt") for k in range(14)] + [(2, k * day, 1 if 2 <= k else 8192, None, "ces", "co7") for k in range(5)] + [(3, k * day, 0, None, "ces", "co7") for k in range(3)]
    rows += [(4, k * day, 0, 512 if k in (1, 2) else 8704, "raster", "jupiter") for k in range(5)] + [(5, 0.0, 7, None, "ces", "co7")]
    out = series.scan_ranges(spark.createDataFrame(rows, "o int, at double, status int, feature int, mode string, field string"), ["o"], "at", "status", "feature", "mode", "field").collect()
    got = sorted((r["o"], r["part"], round(r["start"] / day, 3), round(r["stop"] / day, 3), r["known"]) for r in out)
    assert got == [(1, 0, 0, 4.333, True), (1, 1, 4.333, 8.667, True), (1, 2, 8.667, 13, True), (2, 0, 2, 4, True), (3, 0, 0, 2, True), (4, 0, 1, 3, True)]


def test_cross_correlation_transfer_query(spark):
    maps = {}
    for r in cross_queries.cells(spark, SF).collect():
        m, s = maps.setdefault((r["field"], r["split"], r["feed"]), (np.zeros(cross_queries.SHAPE), np.zeros(cross_queries.SHAPE)))
        m[r["x"], r["y"], r["z"]], s[r["x"], r["y"], r["z"]] = r["map"], r["sigma"]
    got = {(r["field2"], r["feed2"], r["across"], r["along"]): r["transfer"] for r in statistic_queries.cross_correlation_transfer(spark, SF).collect()}
    for field in "FO":
        for feed in (1, 2, 3):
            (m1, s1), (m2, s2) = maps[field, 0, feed], maps[field, 1, feed]
            w, v = plain_weights(s1, s2, True)[0], plain_weights(s2, s2, True)[0]
            cross, auto = plain_power(m1 * w, m2 * w), plain_power(m2 * v, m2 * v)
            for at in cross:
                assert abs(got[field, feed, *at] - cross[at] / auto[at]) < 1e-8
    assert crosses.KEY == ["field", "split", "feed"]
