"""Calibration, filters, map cleaning and spectra on the tables at hand; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, filters, maps, spectra
from .queries import EV, query, r, read, stream, tod

STEP = "CAST(t * 7919 % 101 AS DOUBLE)"


def _hot_and_sky(spark, sf_dir):
    ev = stream(spark, sf_dir).withColumn("t_hot", 290.0 + F.col("feed") % 5)
    return ev.filter("sb = 'click'"), ev.filter("sb = 'view'")


TSYS = f"""{EV}, h AS (SELECT feed, avg(value) p_hot, avg(290.0::DOUBLE + feed % 5) t_hot FROM ev WHERE sb = 'click' GROUP BY feed),
c AS (SELECT feed, avg(value) p_cold FROM ev WHERE sb = 'view' GROUP BY feed),
ts AS (SELECT feed, (p_hot - p_cold) / (t_hot - 2.725::DOUBLE) AS gain, (t_hot - 2.725::DOUBLE) / nullif(p_hot / p_cold - 1, 0) AS tsys FROM c LEFT JOIN h USING (feed))"""


@query(f"WITH {TSYS} SELECT feed, round(gain, 5) AS gain, round(tsys, 2) AS tsys, tsys IS NOT NULL AS calibrated FROM ts")
def tsys_calibration(spark, sf_dir):
    out = filters.system_temperature(*_hot_and_sky(spark, sf_dir), ["feed"], "value", "t_hot")
    return out.select("feed", r("gain", 5).alias("gain"), r("tsys", 2).alias("tsys"), "calibrated")


@query(f"WITH {TSYS} SELECT t, round(value / 100 * tsys, 2) AS kelvin FROM ev LEFT JOIN ts USING (feed) WHERE sb = 'view'")
def calibrate_kelvin(spark, sf_dir):
    hot, sky = _hot_and_sky(spark, sf_dir)
    tsys = filters.system_temperature(hot, sky, ["feed"], "value", "t_hot")
    return filters.calibrate(sky.withColumn("value", F.col("value") / 100), tsys, ["feed"], "value").select("t", r("kelvin", 2).alias("kelvin"))


@query(f"""WITH {EV}, x AS (SELECT feed, t, value, {STEP} AS x FROM ev),
d AS (SELECT *, coalesce(x - lag(x) OVER w, lead(x) OVER w - x, 0) > 0 AS rising, x - avg(x) OVER (PARTITION BY feed) AS c FROM x WINDOW w AS (PARTITION BY feed ORDER BY t)),
a AS (SELECT feed, rising, sum(c * value) / nullif(sum(c * c), 0) AS amp FROM d GROUP BY ALL)
SELECT t, rising, round(value - coalesce(amp, 0) * c, 4) AS residual FROM d JOIN a USING (feed, rising)""")
def pointing_slope_by_direction(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("x", (F.col("t") * 7919 % 101).cast("double"))
    return filters.subtract_slope_by_direction(rows, ["feed"], "t", "x", "value").select("t", "rising", r("residual").alias("residual"))


def _spectra(spark, sf_dir):
    long = spectra.long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return long.withColumn("p", 1.0 / (1 + F.col("vec_id") % 7)).withColumn("q", F.col("vec_id") % 11 * F.col("p"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS t, 1.0::DOUBLE / (1 + vec_id % 7) AS p, (vec_id % 11) / (1.0::DOUBLE + vec_id % 7) AS q FROM embeddings),
m AS (SELECT t, count(*)::DOUBLE n, avg(p) mp, avg(q) mq, avg(y) my FROM x GROUP BY t),
s AS (SELECT t, any_value(mp) mp, any_value(mq) mq, any_value(my) my, sum((p - mp) * (p - mp)) pp, sum((p - mp) * (q - mq)) pq, sum((q - mq) * (q - mq)) qq, sum((p - mp) * (y - my)) py, sum((q - mq) * (y - my)) qy FROM x JOIN m USING (t) GROUP BY t),
f AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) AS b, (qy * pp - py * pq) / (pp * qq - pq * pq) AS c FROM s)
SELECT vec_id, CAST(t AS INTEGER) AS t, round(my - b * mp - c * mq, 4) + 0 AS "offset", round(y - my - b * (p - mp) - c * (q - mq), 4) + 0 AS residual FROM x JOIN f USING (t)""")
def frequency_filter(spark, sf_dir):
    out = filters.frequency_filter(_spectra(spark, sf_dir), ["t"], "value", "p", "q")
    return out.select("vec_id", "t", (r("offset") + 0.0).alias("offset"), (r("residual") + 0.0).alias("residual"))


@query("""SELECT p_partkey, round(exp(-pow(p_size / 10.0::DOUBLE, 2) * 0.04::DOUBLE) * CASE WHEN p_size = 0 THEN 1 ELSE pow(sin(p_size / 10.0::DOUBLE * 0.25::DOUBLE) / (p_size / 10.0::DOUBLE * 0.25::DOUBLE), 2) END, 6) AS transfer FROM part""")
def beam_and_pixel_transfer(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", r(fields.beam_transfer(F.col("p_size") / 10.0, 0.2, 0.5), 6).alias("transfer"))


@query("""WITH c AS (SELECT c_custkey, radians(CAST(c_custkey * 37 % 360 AS DOUBLE) - 30) a, radians(c_acctbal / 150) d FROM customer),
v AS (SELECT c_custkey, cos(d) * cos(a) x, cos(d) * sin(a) y, sin(d) z, sin(radians(20.0::DOUBLE)) s0, cos(radians(20.0::DOUBLE)) c0 FROM c)
SELECT c_custkey, round(degrees(atan2(y, x * c0 + z * s0)), 5) AS lon, round(degrees(asin(z * c0 - x * s0)), 5) AS lat FROM v""")
def field_rotation(spark, sf_dir):
    lon, lat = fields.rotate_to_field((F.col("c_custkey") * 37 % 360).cast("double"), F.col("c_acctbal") / 150, 30.0, 20.0)
    return read(spark, sf_dir, "customer").select("c_custkey", r(lon, 5).alias("lon"), r(lat, 5).alias("lat"))


@query("""WITH c AS (SELECT c_custkey, CAST(c_custkey * 37 % 60 AS DOUBLE) AS ra, c_acctbal / 150 AS dec FROM customer),
p AS (SELECT c_custkey, round_even(59.5::DOUBLE - (ra - 30) * cos(radians(20.0::DOUBLE)) / 0.3::DOUBLE, 0) AS x, round_even(59.5::DOUBLE + (dec - 20) / 0.3::DOUBLE, 0) AS y FROM c)
SELECT c_custkey, CASE WHEN x >= 0 AND x < 120 THEN CAST(x AS INTEGER) END AS ra_i, CASE WHEN y >= 0 AND y < 120 THEN CAST(y AS INTEGER) END AS dec_i FROM p""")
def sky_pixels(spark, sf_dir):
    ra_i, dec_i = fields.sky_pixel((F.col("c_custkey") * 37 % 60).cast("double"), F.col("c_acctbal") / 150, 30.0, 20.0, 0.3, 120)
    return read(spark, sf_dir, "customer").select("c_custkey", ra_i.alias("ra_i"), dec_i.alias("dec_i"))


@query("""WITH c AS (SELECT p_partkey % 40 AS x, p_size AS y, sum(p_retailprice) AS v FROM part GROUP BY ALL),
g AS (SELECT i, exp(-0.5::DOUBLE * pow(i / 1.5::DOUBLE, 2)) AS g FROM (SELECT unnest(range(-3, 4)) AS i)), k AS (SELECT i, g / (SELECT sum(g) FROM g) AS g FROM g)
SELECT CAST(x + a.i AS INTEGER) AS x, CAST(y + b.i AS INTEGER) AS y, round(sum(v * a.g * b.g), 4) AS value FROM c, k a, k b GROUP BY x + a.i, y + b.i""")
def beam_convolution(spark, sf_dir):
    cells = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).cast("int").alias("x"), F.col("p_size").alias("y")).agg(F.sum("p_retailprice").alias("value"))
    return fields.convolve(cells, [], "x", "y", "value", 1.5, 3).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), r("value").alias("value"))


@query("""WITH m AS (SELECT CAST(floor(o_totalprice / 10000) AS INTEGER) AS bin, count(*) AS n FROM orders GROUP BY 1), ma AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above FROM m),
l AS (SELECT CAST(floor((c_acctbal + 1000) / 250) AS INTEGER) AS bin, count(*) AS n FROM customer GROUP BY 1), la AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above FROM l)
SELECT ma.bin, max(la.bin) AS bright FROM ma LEFT JOIN la ON la.above >= ma.above GROUP BY ma.bin""")
def abundance_matching(spark, sf_dir):
    masses = fields.counts_above(read(spark, sf_dir, "orders"), "o_totalprice", 0.0, 10_000.0)
    return fields.match_abundance(masses, fields.counts_above(read(spark, sf_dir, "customer"), "c_acctbal", -1000.0, 250.0))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings),
c AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, corr(a.v, b.v) AS c FROM x a JOIN x b USING (label, t) WHERE a.vec_id < b.vec_id GROUP BY ALL)
SELECT label, CAST(floor(a / 100) AS INTEGER) AS i, CAST(floor(b / 100) AS INTEGER) AS j, round(avg(c), 5) AS mean, round(max(abs(c)), 5) AS largest, count(*) AS n FROM c GROUP BY ALL""")
def correlation_blocks(spark, sf_dir):
    long = spectra.long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    sums = spectra.correlation_sums(long, ["label"], "vec_id", lambda chan: chan // 100)
    return sums.select("label", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r(F.col("total") / F.nullif("valid", F.lit(0)), 5).alias("mean"), r("largest", 5).alias("largest"), F.col("pairs").alias("n"))


@query(f"""WITH {EV}, p AS (SELECT feed, avg(value) FILTER (sb = 'view') AS i, avg(value) FILTER (sb = 'click') AS n, avg(value) FILTER (sb = 'purchase') AS s FROM ev GROUP BY feed)
SELECT feed, round((i - n) / nullif(s, 0), 5) AS transfer FROM p WHERE i IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL""")
def transfer_function(spark, sf_dir):
    ev = stream(spark, sf_dir)
    three = [ev.filter(F.col("sb") == sb).groupBy("feed").agg(F.avg("value").alias("power")) for sb in ("view", "click", "purchase")]
    return fields.transfer_function(*three, ["feed"]).select("feed", r("transfer", 5).alias("transfer"))


def _arrays(change, *how):
    return lambda spark, sf_dir: change(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", *how)


def _named(name: str, f):
    f.__name__ = name
    return query()(f)


_named("gain_fft", _arrays(filters.normalise_gain, 0.05))
_named("gain_gaussian", _arrays(filters.normalise_gain_gaussian, 8, 1.0))
_named("highpass_mirrored", _arrays(filters.padded_highpass, 0.1))
_named("notch_fft", _arrays(filters.notch, 0.2, 0.05))
_named("notch_both_ways", _arrays(filters.notch_both_ways, 0.2, 5.0))
_named("start_decay", _arrays(filters.subtract_start_decay, 0.5))
_named("noise_fit", _arrays(filters.fit_noise))
_named("white_noise", lambda spark, sf_dir: filters.noise_streams(read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 256, 1.0, 0.05, -1.5))


def _maps(spark, sf_dir):
    return maps.finalise(maps.bin_map(tod(spark, sf_dir))).select(*maps.PIXEL, "map", "sigma")


_named("map_svd", lambda spark, sf_dir: fields.subtract_modes(_maps(spark, sf_dir), ["feed"], 3))
_named("map_weighted_modes", lambda spark, sf_dir: fields.subtract_weighted_modes(_maps(spark, sf_dir), ["feed"], 2, 100))
_named("map_highpass", lambda spark, sf_dir: fields.highpass_maps(_maps(spark, sf_dir), ["feed", "sb", "chan"], 1.5, 10, 12))


@query()
def cross_spectra(spark, sf_dir):
    """Spectra between the maps of the four bands, with noise maps."""
    bands = maps.finalise(maps.bin_map(tod(spark, sf_dir), ["dec_i", "ra_i", "sb", "chan"]))
    cells = bands.select("sb", F.col("dec_i").alias("x"), F.col("ra_i").alias("y"), F.col("chan").alias("z"), "map", "sigma")
    across, along = [0.02 * 75 ** (i / 6) for i in range(7)], [0.01 * 100 ** (i / 6) for i in range(7)]
    return fields.cross_spectra(cells, "sb", (10, 12, 64), (8.0, 8.0, 4.0), across, along, sims=10)
