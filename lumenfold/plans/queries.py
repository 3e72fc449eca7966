"""The operators on the tables at hand, each with the same result in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import accept, maps, series, simulate, spectra

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column, digits: int = 4):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def tod(spark, sf_dir) -> DataFrame:
    """lineitem as samples: a pixel, a channel, a value, a weight and a mask."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 19 + 1).cast("int").alias("feed"), (F.col("l_suppkey") % 10).cast("int").alias("dec_i"), (F.col("l_partkey") % 12).cast("int").alias("ra_i"),
        (F.col("l_linenumber") % 4).cast("int").alias("sb"), (F.col("l_partkey") % 64).cast("int").alias("chan"), F.col("l_extendedprice").alias("value"),
        (1 / F.pow(1 + F.col("l_tax"), F.lit(2.0))).alias("w"), (F.col("l_returnflag") != "R").alias("ok"),
    )


TOD = """tod AS (SELECT CAST(l_suppkey % 19 + 1 AS INTEGER) feed, CAST(l_suppkey % 10 AS INTEGER) dec_i, CAST(l_partkey % 12 AS INTEGER) ra_i, CAST(l_linenumber % 4 AS INTEGER) sb,
  CAST(l_partkey % 64 AS INTEGER) chan, l_extendedprice AS value, 1 / pow(1 + l_tax, 2) AS w, l_returnflag <> 'R' AS ok FROM lineitem),
m AS (SELECT feed, dec_i, ra_i, sb, chan, sum(value * w) num, sum(w) den, count(*) nhit FROM tod WHERE ok GROUP BY ALL)"""


def stream(spark, sf_dir) -> DataFrame:
    """events as time streams: a detector, a band, an order and a value."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("feed"), F.col("event_type").alias("sb"), F.col("event_id").alias("t"), "value",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6 + 40587).alias("mjd"),
    )


EV = "ev AS (SELECT user_id feed, event_type sb, event_id t, value, epoch_us(ts) / 86400e6::DOUBLE + 40587 AS mjd FROM events)"


@query(f"WITH {TOD} SELECT feed, dec_i, ra_i, sb, chan, round(num, 2) AS num, round(den, 4) AS den, CAST(nhit AS BIGINT) AS nhit FROM m")
def map_bin(spark, sf_dir):
    return maps.bin_map(tod(spark, sf_dir)).select(*maps.PIXEL, r("num", 2).alias("num"), r("den").alias("den"), "nhit")


@query(f"""WITH {TOD}, g AS (SELECT *, CAST(floor((feed - 1) / 5.0) AS INTEGER) bag FROM m),
l AS (SELECT feed, bag, dec_i, ra_i, sb, chan, sum(num) num, sum(den) den, sum(nhit) nhit, CAST(grouping(feed) + grouping(bag) AS INTEGER) AS level
  FROM g GROUP BY GROUPING SETS ((feed, bag, dec_i, ra_i, sb, chan), (bag, dec_i, ra_i, sb, chan), (dec_i, ra_i, sb, chan)))
SELECT level, feed, bag, dec_i, ra_i, sb, chan, round(num / nullif(den, 0), 3) AS map, round(1 / sqrt(nullif(den, 0)), 5) AS sigma, CAST(nhit AS BIGINT) AS nhit FROM l""")
def map_finalise_coadd(spark, sf_dir):
    out = maps.coadd_levels(maps.bin_map(tod(spark, sf_dir)))
    return out.select("level", "feed", "bag", "dec_i", "ra_i", "sb", "chan", r("map", 3).alias("map"), r("sigma", 5).alias("sigma"), "nhit")


@query(f"""WITH {TOD}, f AS (SELECT *, 1 / sqrt(den) sigma FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY sigma, dec_i, ra_i, sb, chan) p FROM f),
l AS (SELECT feed, avg(sigma) lo FROM k WHERE p <= 20 GROUP BY feed)
SELECT feed, CAST(count(*) FILTER (sigma <= 1.2::DOUBLE * lo) AS BIGINT) AS kept, CAST(count(*) AS BIGINT) AS pixels, round(any_value(lo), 5) AS floor FROM f JOIN l USING (feed) GROUP BY feed""")
def map_noise_mask_topk(spark, sf_dir):
    out = maps.noise_mask(maps.finalise(maps.bin_map(tod(spark, sf_dir))), 20, 1.2)
    return out.groupBy("feed").agg(F.count_if("keep").alias("kept"), F.count("*").alias("pixels"), r(F.max("floor"), 5).alias("floor"))


@query(f"""WITH {TOD}, f AS (SELECT *, num / den AS map, 1 / sqrt(den) AS sigma FROM m)
SELECT dec_i, ra_i, sb, chan, round(sum(map / (sigma * sigma)) / sum(1 / (sigma * sigma)), 3) AS map, round(1 / sqrt(sum(1 / (sigma * sigma))), 5) AS sigma FROM f GROUP BY ALL""")
def inverse_variance_coadd(spark, sf_dir):
    out = maps.inverse_variance_coadd(maps.finalise(maps.bin_map(tod(spark, sf_dir))), ["dec_i", "ra_i", "sb", "chan"])
    return out.select("dec_i", "ra_i", "sb", "chan", r("map", 3).alias("map"), r("sigma", 5).alias("sigma"))


@query(f"""WITH {TOD}, f AS (SELECT *, num / den AS map, 1 / sqrt(den) AS sigma FROM m)
SELECT a.dec_i, a.ra_i, a.sb, a.chan, round((a.map - b.map) / 2, 3) AS map, round(sqrt(a.sigma * a.sigma + b.sigma * b.sigma) / 2, 5) AS sigma
FROM f a JOIN f b USING (dec_i, ra_i, sb, chan) WHERE a.feed = 1 AND b.feed = 11""")
def map_difference(spark, sf_dir):
    keys = ["dec_i", "ra_i", "sb", "chan"]
    m = maps.finalise(maps.bin_map(tod(spark, sf_dir)))
    return maps.difference_map(m.filter("feed = 1"), m.filter("feed = 11"), keys).select(*keys, r("map", 3).alias("map"), r("sigma", 5).alias("sigma"))


@query(f"""WITH {TOD}, a AS (SELECT dec_i, ra_i, sb, chan, den wa FROM m WHERE feed = 1), b AS (SELECT dec_i, ra_i, sb, chan, den wb FROM m WHERE feed = 11)
SELECT sb, round(count(*) FILTER (wa IS NOT NULL AND wb IS NOT NULL) / count(*), 6) AS iou, round(sum(wa * wb) / sqrt(sum(wa * wa) * sum(wb * wb)), 6) AS weighted
FROM a FULL JOIN b USING (dec_i, ra_i, sb, chan) GROUP BY sb""")
def overlap_iou(spark, sf_dir):
    m = maps.finalise(maps.bin_map(tod(spark, sf_dir)))
    out = maps.overlap(m.filter("feed = 1"), m.filter("feed = 11"), ["dec_i", "ra_i", "sb", "chan"], ["sb"])
    return out.select("sb", r("iou", 6).alias("iou"), r("weighted", 6).alias("weighted"))


@query(f"""WITH {TOD} SELECT feed, sb, CAST(floor(chan / 16) AS INTEGER) AS low, round(sum(value * w) / sum(w), 3) AS mean, round(sum(w), 4) AS weight, CAST(count(*) AS BIGINT) AS n FROM tod WHERE ok GROUP BY ALL""")
def decimate_weighted(spark, sf_dir):
    out = series.decimate(tod(spark, sf_dir).filter("ok"), ["feed", "sb"], "chan", "value", "w", 16)
    return out.select("feed", "sb", "low", r("mean", 3).alias("mean"), r("weight").alias("weight"), "n")


@query(f"WITH {EV}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY feed ORDER BY t) AS diff FROM ev) SELECT feed, round(stddev_pop(diff) / sqrt(2), 6) AS sigma0, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY feed")
def sigma0_diff(spark, sf_dir):
    return series.sigma0(stream(spark, sf_dir), ["feed"]).select("feed", r("sigma0", 6).alias("sigma0"), "n")


@query(f"""WITH {EV}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY feed ORDER BY t) AS diff FROM ev), s AS (SELECT feed, stddev_pop(diff) / sqrt(2) s, sum(value * value) ss, count(*) n FROM d GROUP BY feed)
SELECT feed, round((ss / nullif(s * s, 0) - n) / sqrt(2.0::DOUBLE * n), 4) AS chi2 FROM s""")
def chan_chi2(spark, sf_dir):
    ev = stream(spark, sf_dir)
    return series.chi2(ev, series.sigma0(ev, ["feed"]), ["feed"]).select("feed", r("chi2").alias("chi2"))


@query(f"WITH {EV}, d AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY feed ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS median FROM ev) SELECT t, round(median, 4) AS median, value > median + 100 AS cut FROM d")
def running_median_cut(spark, sf_dir):
    return series.running_median_cut(stream(spark, sf_dir), ["feed"], "t", "value", 10, 100.0).select("t", r("median").alias("median"), "cut")


RUNS = """, c AS (SELECT *, CASE WHEN flag = lag(flag) OVER w THEN 0 ELSE 1 END AS ch FROM fl WINDOW w AS (PARTITION BY feed ORDER BY t)),
ru AS (SELECT *, sum(ch) OVER (PARTITION BY feed ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c)"""


@query(f"WITH {EV}, fl AS (SELECT *, value > 30 AS flag FROM ev){RUNS} SELECT t, flag, CAST(count(*) OVER (PARTITION BY feed, run) AS BIGINT) AS run_length, flag AND count(*) OVER (PARTITION BY feed, run) > 4 AS kept FROM ru")
def lonely_channel_islands(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("flag", F.col("value") > 30)
    return series.mask_lonely(rows, ["feed"], "t", "flag").select("t", "flag", "run_length", "kept")


@query(f"""WITH {EV}, fl AS (SELECT *, value > 60 AS flag FROM ev){RUNS}, nx AS (SELECT *, lead(t) OVER (PARTITION BY feed ORDER BY t) AS nxt FROM ru)
SELECT feed, min(t) AS start, max(coalesce(nxt, t)) AS stop, CAST(count(*) AS BIGINT) AS n FROM nx WHERE flag GROUP BY feed, run""")
def edge_detect_intervals(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("flag", F.col("value") > 60)
    return series.on_intervals(rows, ["feed"], "t", "flag").select("feed", "start", "stop", "n")


@query(f"""WITH {EV}, md AS (SELECT feed, quantile_cont(value, 0.5) AS mid FROM ev GROUP BY feed), fa AS (SELECT ev.*, abs(value - mid) AS far FROM ev JOIN md USING (feed)),
li AS (SELECT feed, quantile_cont(far, 0.8) AS lim FROM fa GROUP BY feed), fl AS (SELECT fa.*, far > lim AS flag, row_number() OVER (PARTITION BY feed ORDER BY t) AS place FROM fa JOIN li USING (feed)){RUNS},
pk AS (SELECT feed, run, arg_max(place, far) AS peak FROM (SELECT * FROM ru WHERE flag ORDER BY place) GROUP BY feed, run)
SELECT t, EXISTS (SELECT 1 FROM pk WHERE pk.feed = ru.feed AND ru.place >= peak - 3 AND ru.place < peak + 3) AS masked FROM ru""")
def az_edge_mask(spark, sf_dir):
    return series.edge_mask(stream(spark, sf_dir), ["feed"], "t", "value", 0.8, 3).select("t", "masked")


@query(f"WITH {EV}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY feed ORDER BY t) - 1) / 20) AS INTEGER) AS block FROM ev) SELECT feed, block, round(avg(value), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL")
def block_mean(spark, sf_dir):
    return series.block_mean(stream(spark, sf_dir), ["feed"], "t", "value", 20).select("feed", "block", r("mean", 6).alias("mean"), "n")


@query(f"""WITH {EV}, l AS (SELECT feed, t FROM ev WHERE sb = 'click'), s AS (SELECT feed, t, value FROM ev WHERE sb = 'view'),
b AS (SELECT l.feed, l.t, p.t pt, p.value pv FROM l ASOF LEFT JOIN s p ON l.feed = p.feed AND l.t >= p.t),
a AS (SELECT b.*, n.t nt, n.value nv FROM b ASOF LEFT JOIN s n ON b.feed = n.feed AND b.t <= n.t)
SELECT feed, t, CASE WHEN nt IS NULL OR (pt IS NOT NULL AND t - pt < nt - t) THEN pv ELSE nv END AS value FROM a""")
def asof_feature(spark, sf_dir):
    ev = stream(spark, sf_dir)
    return series.nearest_state(ev.filter("sb = 'click'").select("feed", "t"), ev.filter("sb = 'view'").select("feed", "t", "value"), ["feed"], "t", "value")


@query(f"WITH {EV} SELECT t, round(value / avg(value) OVER (PARTITION BY feed, sb) - 1, 6) AS normalised FROM ev")
def norm_gain_mean(spark, sf_dir):
    return series.normalise_gain_mean(stream(spark, sf_dir), ["feed", "sb"], "value").select("t", r("normalised", 6).alias("normalised"))


@query(f"""WITH {EV}, m AS (SELECT feed, avg(mjd) mx FROM ev GROUP BY feed), c AS (SELECT ev.*, mjd - mx AS x FROM ev JOIN m USING (feed)), a AS (SELECT feed, sum(x * value) / nullif(sum(x * x), 0) AS amp FROM c GROUP BY feed)
SELECT t, round(amp, 3) AS amplitude, round(value - coalesce(amp, 0) * x, 2) AS residual FROM c JOIN a USING (feed)""")
def pointing_slope(spark, sf_dir):
    return series.subtract_slope(stream(spark, sf_dir), ["feed"], "mjd", "value").select("t", r("amplitude", 3).alias("amplitude"), r("residual", 2).alias("residual"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings)
SELECT label, CAST(t AS INTEGER) AS t, round(regr_slope(value, vec_id::DOUBLE), 7) AS slope, round(regr_intercept(value, vec_id::DOUBLE), 5) AS "offset", CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL""")
def poly_filter(spark, sf_dir):
    long = spectra.long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"]).withColumn("x", F.col("vec_id").cast("double"))
    return series.subtract_line(long, ["label", "t"], "x", "value").select("label", "t", r("slope", 7).alias("slope"), r("offset", 5).alias("offset"), "n")


@query(f"""WITH {EV}, s AS (SELECT feed, min(mjd) lo, max(mjd) hi, stddev_pop(value) s FROM ev GROUP BY feed),
z AS (SELECT feed, least(floor((mjd - lo) / nullif(hi - lo, 0) * 15), 14) b, sum(value / nullif(s, 0)) / sqrt(count(*)) z FROM ev JOIN s USING (feed) GROUP BY ALL)
SELECT feed, round((sum(z * z) - count(z)) / sqrt(2.0::DOUBLE * count(z)), 3) AS chi2, CAST(count(*) AS BIGINT) AS bins FROM z GROUP BY feed""")
def az_binned_chi2(spark, sf_dir):
    return series.binned_chi2(stream(spark, sf_dir), ["feed"], "mjd", "value").select("feed", r("chi2", 3).alias("chi2"), "bins")


@query(f"""WITH {EV}, m AS (SELECT sb, avg(value) mu, stddev_pop(value) sd FROM ev GROUP BY sb)
SELECT sb, round(avg(pow((value - mu) / sd, 3)), 5) AS skew, round(avg(pow((value - mu) / sd, 4)) - 3, 5) AS kurt FROM ev JOIN m USING (sb) GROUP BY sb""")
def skew_kurt(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("sb").agg(r(F.skewness("value"), 5).alias("skew"), r(F.kurtosis("value"), 5).alias("kurt"))


@query(f"WITH {EV} SELECT sb, round(((degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) % 360) + 360) % 360, 4) AS az FROM ev GROUP BY sb")
def circular_mean_az(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("sb").agg(r(series.circular_mean(F.col("value"))).alias("az"))


@query(f"""WITH {EV}, h AS (SELECT t, ((mjd * 24 - 7) % 24 + 24) % 24 AS h, 360 * ((1.002737811::DOUBLE * mjd) % 1) AS sid FROM ev)
SELECT t, round(least(abs(2 - h), abs(26 - h)), 3) AS night, round(sid, 2) AS sidereal FROM h""")
def night_sidereal(spark, sf_dir):
    return stream(spark, sf_dir).select("t", r(accept.night_hours(F.col("mjd")), 3).alias("night"), r(accept.sidereal(F.col("mjd")), 2).alias("sidereal"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings), k AS (SELECT unnest(range(33)) AS k)
SELECT vec_id, CAST(k AS INTEGER) AS k, round((pow(sum(v * cos(k * t * (2 * pi() / 64))), 2) + pow(sum(v * sin(k * t * (2 * pi() / 64))), 2)) / 64, 5) AS power FROM x, k GROUP BY ALL""")
def dft(spark, sf_dir):
    long = spectra.long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return series.dft_power(long, ["vec_id"], "t", "value", 64).select("vec_id", "k", r("power", 5).alias("power"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings WHERE label < 3)
SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(corr(a.v, b.v), 6) AS corr FROM x a JOIN x b ON a.label = b.label AND a.t = b.t AND a.vec_id < b.vec_id GROUP BY ALL""")
def corr_matrix(spark, sf_dir):
    """Channel pairs of three bands; a band has a fixed number of channels."""
    long = spectra.long_matrix(read(spark, sf_dir, "embeddings").filter("label < 3"), "vec_id", "embedding", ["label"])
    return spectra.correlation(long, ["label"], "vec_id", digits=6)


@query()
def corr_matrix_all(spark, sf_dir):
    """Channel pairs of every band."""
    long = spectra.long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    return spectra.correlation(long, ["label"], "vec_id", digits=6)


@query()
def pca_singular_values(spark, sf_dir):
    return spectra.principal_components(read(spark, sf_dir, "embeddings"), "label", "embedding", 12)


@query()
def highpass_fft(spark, sf_dir):
    return spectra.highpass(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.05, 4.0)


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings), k AS (SELECT unnest(range(33)) AS k),
p AS (SELECT vec_id, label, k, (pow(sum(v * cos(k * t * (2 * pi() / 64))), 2) + pow(sum(v * sin(k * t * (2 * pi() / 64))), 2)) / 64 AS power FROM x, k GROUP BY ALL)
SELECT label, CAST(CASE WHEN k >= 16 THEN 3 WHEN k >= 8 THEN 2 WHEN k >= 4 THEN 1 ELSE 0 END AS INTEGER) AS bin, round(avg(power), 5) AS power, CAST(count(*) AS BIGINT) AS modes FROM p WHERE k >= 1 AND k < 32 GROUP BY ALL""")
def k_bin_average(spark, sf_dir):
    long = spectra.long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    power = series.dft_power(long, ["vec_id", "label"], "t", "value", 64)
    return spectra.k_average(power, ["label"], "k", "power", [1, 4, 8, 16, 32]).select("label", "bin", r("power", 5).alias("power"), "modes")


def scans(spark, sf_dir) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("scanid"), F.col("c_mktsegment").alias("field"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"),
        F.expr("shiftleft(1, cast(o_orderkey % 8 as int))").alias("scantype"), (F.col("o_totalprice") / 1000).alias("length"),
    )


SC = "sc AS (SELECT o_orderkey scanid, c_mktsegment field, o_totalprice price, c_acctbal balance, 1 << CAST(o_orderkey % 8 AS INTEGER) scantype, o_totalprice / 1000 AS length FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {SC} SELECT scanid, field FROM sc WHERE (scantype & 48) <> 0 AND length > 120 AND NOT (scanid BETWEEN 100 AND 900 OR scanid BETWEEN 5000 AND 5500)")
def runlist_filter(spark, sf_dir):
    excluded = spark.createDataFrame([(100, 900), (5000, 5500)], "first long, last long")
    return accept.runlist_filter(scans(spark, sf_dir), excluded, 48, 120.0).select("scanid", "field")


@query(f"WITH {SC} SELECT scanid, field FROM sc WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = scanid)")
def unprocessed_anti(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scanid"))
    return scans(spark, sf_dir).join(done, "scanid", "left_anti").select("scanid", "field")


@query(f"""WITH {SC} SELECT scanid, coalesce(price >= 20000 AND price <= 300000, true) AND coalesce(balance >= 0, false) AS accepted,
CAST(CASE WHEN price < 20000 OR price > 300000 THEN 1 ELSE 0 END + CASE WHEN balance IS NULL OR balance < 0 THEN 1 ELSE 0 END AS BIGINT) AS n_rejected FROM sc""")
def accept_cuts(spark, sf_dir):
    cuts = spark.createDataFrame([("price", 20000.0, 300000.0), ("balance", 0.0, None)], "stat string, lo double, hi double")
    stats = scans(spark, sf_dir).unpivot("scanid", ["price", "balance", "length"], "stat", "value")
    return accept.accept_list(accept.accept_cuts(stats, cuts, ["scanid"]), ["scanid"])


@query(f"WITH {SC}, m AS (SELECT field, quantile_cont(price, 0.5) mid FROM sc GROUP BY field) SELECT scanid, CAST(1 | CASE WHEN price > mid THEN 8 ELSE 0 END AS BIGINT) AS bits FROM sc JOIN m USING (field)")
def median_split_bits(spark, sf_dir):
    return accept.median_split(scans(spark, sf_dir), ["field"], "price", 3).select("scanid", "bits")


@query(f"WITH {SC} SELECT scanid, 2 * (row_number() OVER w - 1) >= count(*) OVER (PARTITION BY field) AS upper FROM sc WINDOW w AS (PARTITION BY field ORDER BY price, scanid)")
def rank_split(spark, sf_dir):
    return accept.rank_split(scans(spark, sf_dir), ["field"], [F.col("price"), F.col("scanid")]).select("scanid", "upper")


@query(f"WITH {SC} SELECT scanid, 's' || n || '_' || (scantype & 1) || ((scantype >> CAST(n AS INTEGER)) & 1) AS split_key FROM sc, (VALUES (1), (2), (3)) s(n)")
def split_key_explode(spark, sf_dir):
    return accept.split_keys(scans(spark, sf_dir), "scantype", 0, [1, 2, 3]).select("scanid", "split_key")


@query(f"WITH {SC} SELECT field, CAST(bit_or(scantype) AS BIGINT) AS bits FROM sc GROUP BY field")
def bitmask_or(spark, sf_dir):
    return scans(spark, sf_dir).groupBy("field").agg(F.bit_or("scantype").cast("long").alias("bits"))


@query(f"WITH {SC} SELECT CAST(b AS INTEGER) AS bit, CAST(count(*) FILTER (((scantype >> CAST(b AS INTEGER)) & 1) = 1) AS BIGINT) AS hits, round(count(*) FILTER (((scantype >> CAST(b AS INTEGER)) & 1) = 1) / count(*), 6) AS share FROM sc, (SELECT unnest(range(8)) AS b) GROUP BY b")
def reason_frequency(spark, sf_dir):
    return accept.reason_table(scans(spark, sf_dir), "scantype", 8).select("bit", "hits", r("share", 6).alias("share"))


@query(f"WITH {EV}, z AS (SELECT sb, (value - avg(value) OVER (PARTITION BY sb)) / stddev_pop(value) OVER (PARTITION BY sb) AS z FROM ev) SELECT sb, round(sign(sum(pow(z, 3))) * abs((sum(z * z) - count(*)) / sqrt(2 * count(*)::DOUBLE)), 4) + 0 AS chi2 FROM z GROUP BY sb")
def signed_chi2(spark, sf_dir):
    w = Window.partitionBy("sb")
    z = stream(spark, sf_dir).withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w))
    return z.groupBy("sb").agg((r(accept.signed_chi2(F.col("z"))) + F.lit(0.0)).alias("chi2"))


@query(f"WITH {SC}, c AS (SELECT field, price, count(*) OVER (PARTITION BY field ORDER BY price) / count(*) OVER (PARTITION BY field) AS f FROM sc) SELECT field, price, round(1 - f, 6) AS pte FROM c")
def pte_ecdf(spark, sf_dir):
    return scans(spark, sf_dir).select("field", "price", r(1 - F.cume_dist().over(Window.partitionBy("field").orderBy("price")), 6).alias("pte"))


@query("SELECT c_custkey AS halo, round(1e6::DOUBLE / (pow((c_acctbal + 1100) / 3000.0::DOUBLE, -2.5::DOUBLE) + pow((c_acctbal + 1100) / 3000.0::DOUBLE, 0.3::DOUBLE)), 3) AS luminosity FROM customer")
def halo_luminosity(spark, sf_dir):
    mass = F.col("c_acctbal") + 1100
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("halo"), r(simulate.double_power_luminosity(mass, -2.5, 0.3, 1e6, 3000.0), 3).alias("luminosity"))


@query("""SELECT CAST(least(floor((x - 0) / 100000 * 8), 7) AS INTEGER) AS x_i, CAST(CASE WHEN y = 50 THEN 9 ELSE floor(y / 50 * 10) END AS INTEGER) AS y_i, round(sum(q), 2) AS total, CAST(count(*) AS BIGINT) AS halos
FROM (SELECT l_extendedprice AS x, l_quantity AS y, l_tax AS q FROM lineitem) WHERE x >= 0 AND x <= 100000 AND y >= 0 AND y <= 50 GROUP BY ALL""")
def cube_histogram(spark, sf_dir):
    halos = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_tax").alias("q"))
    return simulate.histogram_cube(halos, {"x": (0.0, 100000.0, 8), "y": (0.0, 50.0, 10)}, "q").select("x_i", "y_i", r("total", 2).alias("total"), "halos")


@query("""WITH g AS (SELECT CAST(p_partkey % 40 AS INTEGER) xi, CAST(floor(p_partkey / 40) AS INTEGER) yi, p_retailprice v FROM part WHERE p_partkey < 1600), q AS (SELECT s_suppkey k, (s_suppkey * 7 % 390) / 10.0::DOUBLE x, (s_suppkey * 3 % 380) / 10.0::DOUBLE y FROM supplier),
c AS (SELECT k, CAST(floor(x) + di AS INTEGER) xi, CAST(floor(y) + dj AS INTEGER) yi, (CASE WHEN di = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN dj = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) s FROM q, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj))
SELECT k AS sample, round(sum(s * v), 4) AS value FROM c JOIN g USING (xi, yi) GROUP BY k HAVING count(*) = 4""")
def cube_bilinear(spark, sf_dir):
    cube = read(spark, sf_dir, "part").filter("p_partkey < 1600").select((F.col("p_partkey") % 40).cast("int").alias("xi"), F.floor(F.col("p_partkey") / 40).cast("int").alias("yi"), F.col("p_retailprice").alias("value"))
    points = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_suppkey") * 7 % 390 / 10.0).alias("x"), (F.col("s_suppkey") * 3 % 380 / 10.0).alias("y"))
    return simulate.sample_bilinear(points, cube, "x", "y", "value", "sample").select("sample", r("value").alias("value"))
