"""Recursive notches, boxes, spectra of single maps, random fields and stores against plain Python and NumPy."""

import numpy as np
from pyspark.sql import functions as F

from lumenfold.operators import fields, filters, series
from lumenfold.sources import tables, text


def plain_filter(b, a, x):
    out = []
    for i in range(len(x)):
        y = sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * out[i - k] for k in range(1, len(a)) if i >= k)
        out.append(y)
    return np.array(out)


def test_recursive_filter_against_plain_loops():
    g = np.random.default_rng(1)
    b, a = filters.notch_coefficients([0.1, 0.23], [4.0, 7.0])
    x = g.normal(size=(3, 80))
    assert np.allclose(filters.recursive(b, a, x, np.zeros((3, 4))), [plain_filter(b, a, row) for row in x])
    w = np.exp(-2j * np.pi * np.array([0.1, 0.23]))
    assert np.allclose([np.polyval(b[::-1], z) for z in w], 0) and np.isclose(b.sum() / a.sum(), 1)
    constant = np.full((2, 60), 3.0)
    assert np.allclose(filters.both_ways(b, a, constant), constant)  # the start is that of a steady input


def test_notch_both_ways_of_rows_of_several_lengths(spark):
    t = np.arange(900)
    good, bad = np.sin(2 * np.pi * 0.03 * t), np.sin(2 * np.pi * 0.1 * t) + np.cos(2 * np.pi * 0.23 * t)
    rows = [(k, [float(v) for v in (good + bad)[:n]]) for k, n in ((1, 900), (2, 600), (3, 1), (4, 0))]
    out = {r["k"]: np.array(r["filtered"]) for r in filters.notch_both_ways(spark.createDataFrame(rows, "k int, s array<double>"), "k", "s", [0.1, 0.23], [4.0, 7.0]).collect()}
    assert [len(out[k]) for k in (1, 2, 3, 4)] == [900, 600, 1, 0]
    assert np.abs(out[1] - good)[150:-150].max() < 0.02 and np.abs(out[2] - good[:600])[150:-150].max() < 0.02


def test_notch_at_turns_leaves_the_rest(spark):
    t = np.arange(1200)
    az = np.abs((t + 100) % 800 - 400.0)
    d = np.sin(2 * np.pi * 0.1 * t)
    rows = spark.createDataFrame([(1, d.tolist(), az.tolist())], "k int, s array<double>, az array<double>")
    out = np.array(filters.notch_at_turns(rows, "k", "s", "az", 0.1, 4.0, reach=100).first()["filtered"])
    turns = filters.peaks(np.abs(az - np.median(az)), 100)
    assert turns.tolist() == [300, 700, 1100]
    same = np.isclose(out, d)
    assert same[:200].all() and same[400:600].all() and same[800:1000].all() and not same[250:350].all()
    assert filters.peaks(np.array([0, 2, 2, 2, 1, 3, 0.0]), 1).tolist() == [2, 5] and filters.peaks(np.array([0, 2, 2, 2, 1, 3, 0.0]), 4).tolist() == [5]


def test_padding_weighs_the_outermost_samples_most():
    d = np.arange(150.0)
    wide, w = filters.mirrored(d), np.linspace(1, 0, 100)
    assert np.isclose(wide[0] + d[-1], 2 * (w @ d[:100]) / w.sum()) and np.isclose(wide[-1] + d[0], 2 * (w[::-1] @ d[-100:]) / w.sum())
    assert len(filters.mirrored(np.ones(1))) == 3 and np.allclose(filters.mirrored(np.full(5, 2.0)), 2)


def test_missing_samples_are_drawn_like_their_neighbours(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 4 > 0, F.randn(3) + 5).alias("v"))
    out = series.fill_missing(rows, ["k"], "t", "v").filter("v is null").agg(F.avg("filled").alias("m"), F.stddev("filled").alias("s"), F.count("filled").alias("n")).first()
    assert out["n"] == 1000 and abs(out["m"] - 5) < 0.15 and abs(out["s"] - 1) < 0.15


def test_comoving_box():
    assert np.allclose(fields.comoving(0.5, matter=0.0, hubble=70.0), 299_792.458 / 70 * 0.5)
    assert np.allclose(fields.comoving(3.0, matter=1.0, hubble=70.0), 2 * 299_792.458 / 70 * (1 - 0.5))
    steps = fields.box_steps(2.9, 115.27, 26.0, 34.0, 256, 2 / 60, 2 / 60, 60.0)
    assert np.isclose(steps["dx"], steps["dy"] / 2) and np.isclose(steps["volume"], steps["dx"] * steps["dy"] * steps["dz"])
    assert np.isclose(steps["dy"], 2 * steps["mpc_per_arcmin"])


def test_auto_spectrum_and_random_fields(spark):
    shape, steps = (8, 8, 16), (2.0, 2.0, 1.0)
    made = fields.random_fields(spark.range(24), "id", shape, steps, lambda k: np.full(k.shape, 4.0), seed=3)
    cubes = {r["id"]: np.array(r["cells"]).reshape(shape) for r in made.collect()}
    again = {r["id"]: r["cells"] for r in fields.random_fields(spark.range(24).repartition(3), "id", shape, steps, lambda k: np.full(k.shape, 4.0), seed=3).collect()}
    assert all(np.array_equal(cubes[k].ravel(), again[k]) for k in cubes)
    rows = [(int(u), *map(int, at), float(m[at]), 2.0) for u, m in list(cubes.items())[:3] for at in np.ndindex(shape)]
    cells = spark.createDataFrame(rows, "u long, x int, y int, z int, map double, sigma double")
    two = fields.auto_spectra(cells, "u", shape, steps, [0.0, 10.0], [0.0, 10.0]).toPandas().set_index("u")
    for u in (0, 1, 2):  # Parseval, and the spectrum that the field was made with
        assert np.isclose(two.power[u], (cubes[u] ** 2).mean() * 4.0) and two.modes[u] == 1024
    assert abs(np.mean([(c**2).mean() * 4.0 for c in cubes.values()]) - 4.0) < 0.2
    one = fields.auto_spectra(cells, "u", shape, steps, [0.01, 10.0]).toPandas()
    assert (one.modes == 1023).all()


def test_runlists_round_trip(spark, tmp_path):
    scans = [("co2", 123, "a/b.hd5", 12302, 58000.5, 58000.6, 32, 10.0, 55.0, 0.1, [1, 0]), ("co2", 123, "a/b.hd5", 12303, 58000.7, 58000.8, 16, 11.0, 56.0, 0.2, [0, 1]), ("co6", 7001, "c.hd5", 700102, 58100.1, 58100.2, 32, 1.0, 2.0, 0.3, [1, 1])]
    frame = spark.createDataFrame(scans, "field string, obsid long, file string, scanid long, mjd_start double, mjd_stop double, scantype int, mean_az double, mean_el double, std_el double, bits array<int>")
    text.write_runlist(frame, str(tmp_path / "runlist"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "runlist")).collect()]
    assert lines[0].strip() == "2" and len(lines) == 1 + 2 + 2 + 3
    back = text.read_runlist(spark, str(tmp_path / "runlist"))
    keys = ["scanid", "mjd_start", "mjd_stop", "scantype", "field", "obsid", "file"]
    assert sorted(map(tuple, back.select(*keys).collect())) == sorted(map(tuple, frame.select(*keys).collect()))


def test_patch_and_parameter_files(spark, tmp_path):
    (tmp_path / "patches").write_text("Name: RA: Dec: Radius_ra: Radius_dec: Resolution: Field type:\nco2 25.435 0.0 2 2 2 cosmo\nx1 1.0 2.0 2 2 2 cosmo\nend\n")
    assert [(r["name"], r["ra"], r["kind"]) for r in text.read_patches(spark, str(tmp_path / "patches")).collect()] == [("co2", 25.435, "cosmo")]
    (tmp_path / "param").write_text("--fields co2 co6 # two\n--split_base 2\n--flag\n")
    assert text.read_parameters(str(tmp_path / "param")) == {"fields": ["co2", "co6"], "split_base": ["2"], "flag": []}


def test_stores_replace_only_their_partitions(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(6).select(F.lit("co2").alias("field"), (F.col("id") % 3).alias("scan"), F.col("id").alias("value"))
    tables.write_store(rows, root, "streams")
    tables.write_store(rows.filter("scan = 1").withColumn("value", F.lit(99).cast("long")), root, "streams")
    back = tables.read_store(spark, root, "streams", ["scan", "value"], field="co2")
    assert sorted(map(tuple, back.collect())) == [(0, 0), (0, 3), (1, 99), (1, 99), (2, 2), (2, 5)]
    assert tables.read_store(spark, root, "streams", None, scan=[0, 2]).count() == 4
    wanted = spark.createDataFrame([(0,), (7,)], "scan int")
    assert [r["scan"] for r in tables.missing_scans(wanted, spark, root, "streams").collect()] == [7]
    assert tables.map_name("map", 5, "exper", 8) == "map_highpass_8_n5_subtr_exper"
    none = spark.createDataFrame([], "path string")
    files = tables.unread_files(spark, root, "*.parquet", none, none)
    assert files.count() == 3 and tables.unread_files(spark, root, "*.parquet", files, none).count() == 0
