"""Scan catalogues, channel masks, splits and spectrum averages on the tables at hand, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import averages, masking, scans, series, spectra, splits
from .queries import EV, query, r, read, stream

#: orders as scans: an id, a field, a start and a length in days, type bits and a detector.
SCANS = """sc AS (SELECT o_orderkey AS scanid, substr(c_mktsegment, 1, 4) AS field, epoch_us(o_orderdate) / 86400e6::DOUBLE + 40587 AS mjd_start,
  epoch_us(o_orderdate) / 86400e6::DOUBLE + 40587 + o_totalprice / 1e8::DOUBLE AS mjd_stop, CAST(1 << CAST(o_orderkey % 7 AS INTEGER) AS INTEGER) AS scantype,
  CAST(o_custkey % 19 + 1 AS INTEGER) AS feed, CAST(o_orderkey % 4 AS INTEGER) AS sb, o_totalprice AS price, c_acctbal AS el, o_orderstatus <> 'P' AS accepted,
  CAST(o_custkey * 7 % 360 AS DOUBLE) AS sidereal FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scan_table(spark, sf_dir):
    both = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6 + 40587
    return both.select(
        F.col("o_orderkey").alias("scanid"), F.substring("c_mktsegment", 1, 4).alias("field"), start.alias("mjd_start"), (start + F.col("o_totalprice") / 1e8).alias("mjd_stop"),
        F.expr("shiftleft(1, cast(o_orderkey % 7 as int))").alias("scantype"), (F.col("o_custkey") % 19 + 1).cast("int").alias("feed"), (F.col("o_orderkey") % 4).cast("int").alias("sb"),
        F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("el"), (F.col("o_orderstatus") != "P").alias("accepted"), (F.col("o_custkey") * 7 % 360).cast("double").alias("sidereal"),
    )


#: embeddings as channels: band, channel and samples.
GRID = "g AS (SELECT label AS sb, vec_id AS chan, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS t, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def grid(spark, sf_dir):
    return spectra.long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"]).withColumnsRenamed({"label": "sb", "vec_id": "chan"})


#: part as channels: detector, band, channel, frequency and a system temperature.
CHANNELS = """ch AS (SELECT p_partkey AS id, CAST(p_partkey % 5 + 1 AS INTEGER) AS feed, CAST(p_partkey // 5 % 4 AS INTEGER) AS sb, p_partkey // 20 AS chan, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice / 25 END AS tsys,
  p_size > 5 AS kept, CAST(p_size AS DOUBLE) AS size FROM part)"""


def channel_table(spark, sf_dir):
    tsys = F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice") / 25)
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5 + 1).cast("int").alias("feed"), F.expr("cast(p_partkey div 5 % 4 as int)").alias("sb"), F.expr("p_partkey div 20").alias("chan"),
        tsys.alias("tsys"), (F.col("p_size") > 5).alias("kept"), F.col("p_size").cast("double").alias("size"), F.lit(0).cast("long").alias("reason"),
    )


@query(f"WITH {EV} SELECT feed, t, value FROM ev WHERE mjd BETWEEN (SELECT min(mjd) + 2 FROM ev) AND (SELECT min(mjd) + 9 FROM ev) AND feed IN (1, 3, 5, 7)")
def scan_slice(spark, sf_dir):
    ev = stream(spark, sf_dir)
    first = ev.agg(F.min("mjd")).first()[0]
    return scans.slice_scan(ev, "mjd", first + 2, first + 9, "feed", [1, 3, 5, 7]).select("feed", "t", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey & 16 <> 0 THEN 'circ' WHEN o_orderkey & 32 <> 0 THEN 'ces' WHEN o_orderkey & 128 <> 0 THEN 'stationary' WHEN o_orderkey & 32768 <> 0 THEN 'liss' END AS kind FROM orders")
def scan_type_names(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scans.scan_type(F.col("o_orderkey")).alias("kind"))


@query(f"""WITH {SCANS}, x AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey % 5 = 0), s AS (SELECT *, mjd_start + 2 / 86400.0::DOUBLE AS start, mjd_stop - 1 / 86400.0::DOUBLE AS stop, scanid // 100 AS obsid FROM sc)
SELECT scanid, CASE WHEN field NOT IN ('AUTO', 'BUIL', 'MACH') THEN 'field' WHEN obsid NOT BETWEEN 1 AND 200 OR EXISTS (SELECT 1 FROM x WHERE obsid BETWEEN a AND b) THEN 'obsid'
  WHEN scantype & 37 = 0 THEN 'type' WHEN (stop - start) * 86400 <= 120 THEN 'length' ELSE 'kept' END AS verdict FROM s""")
def runlist_verdicts(spark, sf_dir):
    excluded = read(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("long").alias("first"), (F.col("n_nationkey") + 1).cast("long").alias("last"))
    return scans.judge_scans(scan_table(spark, sf_dir), ["AUTO", "BUIL", "MACH"], 37, 1, 200, excluded, 120.0, (2.0, 1.0), 10).select("scanid", "verdict")


@query(f"""WITH {SCANS} SELECT scanid FROM sc WHERE scanid % 100 <> 2 AND scanid IN (SELECT scanid FROM sc WHERE accepted AND price > 100000)""")
def usable_scans(spark, sf_dir):
    rows = scan_table(spark, sf_dir)
    return scans.usable_scans(rows, rows.withColumn("accepted", F.col("accepted") & (F.col("price") > 100000)), "scanid").select("scanid")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 8192 ELSE CAST(1 << CAST(event_id % 12 AS INTEGER) AS INTEGER) END AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
a AS (SELECT user_id, arg_min(f, event_id) AS first, arg_max(f, event_id) AS last, max(f) FILTER (p = 2) AS second, count(*) AS ranges FROM e GROUP BY user_id)
SELECT user_id, CAST(ranges AS BIGINT) AS ranges FROM a WHERE first = 8192 AND last = 8192 AND coalesce(second & 1024, 0) = 0""")
def usable_observations(spark, sf_dir):
    feature = F.when(F.col("event_type").isin("purchase", "view"), 8192).otherwise(F.expr("shiftleft(1, cast(event_id % 12 as int))"))
    return scans.usable_observations(read(spark, sf_dir, "events").withColumn("f", feature), "user_id", "event_id", "f")


@query(f"""WITH {SCANS}, m AS (SELECT sb, feed, count(*) AS n, avg(price) AS price FROM sc GROUP BY ALL), w AS (SELECT sb, CAST(unnest(range(1, 21)) AS INTEGER) AS feed FROM (SELECT DISTINCT sb FROM m))
SELECT sb, feed, CAST(coalesce(n, 0) AS BIGINT) AS scans, round(price, 3) AS price FROM w LEFT JOIN m USING (sb, feed)""")
def field_summary(spark, sf_dir):
    return scans.summary(scan_table(spark, sf_dir), ["sb"], ["price"]).select("sb", "feed", "scans", r("price", 3).alias("price"))


@query("""WITH c AS (SELECT s_suppkey % 7 AS obsid, s_suppkey % 2 AS slot, max(s_suppkey * 1.0::DOUBLE) AS tm, max(s_acctbal) AS p, max(280.0::DOUBLE + s_suppkey % 9) AS th FROM supplier WHERE s_acctbal > 2000 GROUP BY ALL),
w AS (SELECT obsid, max(tm) FILTER (slot = 0) t0, max(tm) FILTER (slot = 1) t1, max(p) FILTER (slot = 0) p0, max(p) FILTER (slot = 1) p1, max(th) FILTER (slot = 0) h0, max(th) FILTER (slot = 1) h1 FROM c GROUP BY obsid),
s AS (SELECT c_custkey, c_custkey % 9 AS obsid, c_custkey / 10.0::DOUBLE AS tm FROM customer)
SELECT c_custkey, round(CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN p0 + (p1 - p0) * ((tm - t0) / nullif(t1 - t0, 0)) ELSE coalesce(p0, p1) END, 4) AS p_hot,
  round(CASE WHEN h0 IS NOT NULL AND h1 IS NOT NULL THEN h0 + (h1 - h0) * ((tm - t0) / nullif(t1 - t0, 0)) ELSE coalesce(h0, h1) END, 4) AS t_hot, CAST((t0 IS NOT NULL)::INT + (t1 IS NOT NULL)::INT AS INTEGER) AS n_cal
FROM s LEFT JOIN w USING (obsid)""")
def calibration_interpolated(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 9).alias("obsid"), (F.col("c_custkey") / 10.0).alias("at"))
    cal = read(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 7).alias("obsid"), (F.col("s_suppkey") % 2).alias("slot"), F.col("s_suppkey").cast("double").alias("time"), F.col("s_acctbal").alias("p_hot"),
        (280.0 + F.col("s_suppkey") % 9).alias("t_hot"), (F.col("s_acctbal") > 2000).alias("ok"),
    )
    return scans.calibration_at(rows, cal, ["obsid"], "at").select("c_custkey", r("p_hot").alias("p_hot"), r("t_hot").alias("t_hot"), "n_cal")


@query(f"""WITH {SCANS}, f AS (SELECT CAST(s_suppkey % 19 + 1 AS INTEGER) AS feed, CAST(s_suppkey // 19 AS INTEGER) AS bucket, max(s_acctbal) AS value FROM supplier GROUP BY ALL), l AS (SELECT feed, max(bucket) AS last FROM f GROUP BY feed),
b AS (SELECT sc.*, CAST(least(greatest(floor((mjd_start - floor(mjd_start)) * 144), 0), last) AS INTEGER) AS a, CAST(least(greatest(floor((mjd_stop - floor(mjd_start)) * 144), 0), last) AS INTEGER) AS b FROM sc LEFT JOIN l USING (feed))
SELECT scanid, round(greatest(x.value, y.value), 4) AS weather FROM b LEFT JOIN f x ON x.feed = b.feed AND x.bucket = a LEFT JOIN f y ON y.feed = b.feed AND y.bucket = b.b""")
def weather_forecast(spark, sf_dir):
    forecast = read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 19 + 1).cast("int").alias("feed"), F.expr("cast(s_suppkey div 19 as int)").alias("bucket")).agg(F.max("s_acctbal").alias("value"))
    rows = scan_table(spark, sf_dir).withColumn("first", F.floor("mjd_start").cast("double"))
    return scans.bucket_forecast(rows, forecast, ["feed"], "mjd_start", "mjd_stop", "first").select("scanid", r("weather").alias("weather"))


@query(f"""WITH {SCANS} SELECT scanid, scanid // 100 AS obsid, round((mjd_start + mjd_stop) / 2, 6) AS mjd, round((mjd_stop - mjd_start) * 1440, 6) AS minutes, scantype AS fbit,
  CASE WHEN feed IN (1, 4, 5, 12, 13) THEN 1 WHEN feed IN (6, 14, 15, 16, 17) THEN 2 WHEN feed IN (2, 7, 18, 19, 20) THEN 3 WHEN feed IN (3, 8, 9, 10, 11) THEN 4 END AS saddlebag,
  CAST(EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = scanid) AS INTEGER) AS blacklisted FROM sc""")
def scan_facts(spark, sf_dir):
    rows = scans.listed(scan_table(spark, sf_dir), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scanid")), ["scanid"], "blacklisted")
    return scans.scan_facts(rows).join(rows.select("scanid", "blacklisted"), "scanid").select("scanid", "obsid", r("mjd", 6).alias("mjd"), r("minutes", 6).alias("minutes"), "fbit", "saddlebag", "blacklisted")


@query(f"""WITH {EV}, s AS (SELECT user_id AS feed, user_id * 10 + event_id % 3 AS scanid, min(event_id) AS start, max(event_id) AS stop FROM events GROUP BY ALL)
SELECT scanid, round(((degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) % 360) + 360) % 360, 4) AS mean_az, round(avg(mjd), 5) AS mean_el, round(stddev_pop(mjd), 5) AS std_el, CAST(count(*) AS BIGINT) AS n
FROM ev JOIN s USING (feed) WHERE t > start AND t <= stop GROUP BY scanid""")
def scan_pointing(spark, sf_dir):
    ev = stream(spark, sf_dir)
    some = ev.groupBy("feed", (F.col("feed") * 10 + F.col("t") % 3).alias("scanid")).agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    return scans.pointing_facts(ev, some, ["feed"], "t", "value", "mjd", 500.0).select("scanid", r("mean_az").alias("mean_az"), r("mean_el", 5).alias("mean_el"), r("std_el", 5).alias("std_el"), "n")


@query("""WITH c AS (SELECT c_custkey, radians(c_custkey % 360::DOUBLE) a, radians(30 + c_custkey % 50::DOUBLE) e, radians(c_custkey * 7 % 360::DOUBLE) b, radians(c_acctbal / 200) h FROM customer),
v AS (SELECT c_custkey, cos(h) * cos(b - a) * sin(e) - sin(h) * cos(e) x, cos(h) * sin(b - a) y, cos(h) * cos(b - a) * cos(e) + sin(h) * sin(e) z FROM c)
SELECT c_custkey, round(degrees(acos(least(greatest(z, -1), 1))), 5) AS distance, round(((degrees(atan2(y, x)) % 360) + 360) % 360, 4) AS angle FROM v""")
def body_distance(spark, sf_dir):
    key = F.col("c_custkey")
    distance, angle = scans.sidelobe_score((key % 360).cast("double"), (30 + key % 50).cast("double"), (key * 7 % 360).cast("double"), F.col("c_acctbal") / 200)
    return read(spark, sf_dir, "customer").select("c_custkey", r(distance, 5).alias("distance"), r(angle).alias("angle"))


@query(f"""WITH {SCANS}, s AS (SELECT scanid, unnest([1, 2, 3]) AS stat, unnest([price > 250000, el < 0, feed = 3]) AS rejected, 1.0 AS w FROM sc),
f AS (SELECT scanid, min(stat) FILTER (rejected) AS o FROM s GROUP BY scanid) SELECT stat, round((SELECT count(*) FROM f WHERE o IS NULL OR o > stat) / (SELECT count(*) FROM sc), 6) AS accept_rate FROM (SELECT DISTINCT stat FROM s)""")
def accept_trace(spark, sf_dir):
    rows = scan_table(spark, sf_dir)
    judged = rows.select("scanid", F.lit(1.0).alias("w"), F.expr("stack(3, 1, price > 250000, 2, el < 0, 3, feed = 3) as (stat, rejected)"))
    return scans.accept_trace(judged, ["scanid"], "stat", "w").select("stat", r("accept_rate", 6).alias("accept_rate"))


@query(f"""WITH {CHANNELS}, o AS (SELECT l_partkey AS id, bool_and(l_returnflag <> 'R') AS k FROM lineitem GROUP BY ALL) SELECT id, kept AND coalesce(k, TRUE) AS kept FROM ch LEFT JOIN o USING (id)""")
def mask_import(spark, sf_dir):
    other = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("kept"))
    return scans.imported_mask(channel_table(spark, sf_dir), other, ["id"]).select("id", "kept")


@query("WITH e AS (SELECT user_id, CASE WHEN value > 200 THEN 'nan'::DOUBLE WHEN value > 150 THEN 'inf'::DOUBLE WHEN value > 100 THEN NULL ELSE value END AS v FROM events) SELECT user_id, CAST(count(*) FILTER (v IS NULL OR NOT isfinite(v)) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY user_id")
def samples_not_finite(spark, sf_dir):
    v = F.col("value")
    odd = F.when(v > 200, float("nan")).when(v > 150, float("inf")).when(v > 100, None).otherwise(v)
    return masking.count_not_finite(read(spark, sf_dir, "events").withColumn("v", odd), ["user_id"], "v")


@query(f"""WITH {CHANNELS} SELECT id, chan < 2 OR chan = 512 OR (sb IN (0, 1) AND chan >= 1024 - 179) OR (feed IN (4, 10) AND ((sb = 2 AND chan >= 952) OR (sb = 3 AND chan < 72))) AS marked FROM ch""")
def marked_channels(spark, sf_dir):
    return channel_table(spark, sf_dir).select("id", masking.marked(F.col("feed"), F.col("sb"), F.col("chan")).alias("marked"))


FREQS = """fq AS (SELECT CAST(s_suppkey % 4 AS INTEGER) AS sb, s_suppkey // 4 AS chan, 26 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * (s_suppkey // 4) * 0.01::DOUBLE AS freq FROM supplier),
st AS (SELECT sb, max(freq) FILTER (chan = 1) - max(freq) FILTER (chan = 0) AS step, max(chan) AS top FROM fq GROUP BY sb),
up AS (SELECT fq.*, step, top, coalesce(lead(freq) OVER (PARTITION BY sb ORDER BY chan), freq + step) AS e FROM fq JOIN st USING (sb)),
ban AS (SELECT sb, CASE WHEN step < 0 THEN top - chan ELSE chan END AS chan, step < 0 AS flipped, least(freq, e) AS lo, greatest(freq, e) AS hi, (freq + e) / 2 AS centre FROM up)"""


def _freqs(spark, sf_dir):
    sign = F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(-1)
    return read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).cast("int").alias("sb"), F.expr("s_suppkey div 4").alias("chan"), (26 + sign * F.expr("s_suppkey div 4") * 0.01).alias("freq"))


@query(f"WITH {FREQS} SELECT sb, chan, flipped, round(lo, 6) AS lo, round(hi, 6) AS hi, round(centre, 6) AS centre FROM ban")
def sideband_flip(spark, sf_dir):
    return masking.upward_bands(_freqs(spark, sf_dir)).select("sb", "chan", "flipped", r("lo", 6).alias("lo"), r("hi", 6).alias("hi"), r("centre", 6).alias("centre"))


@query(f"WITH {FREQS}, z AS (SELECT *, (centre - 25.003::DOUBLE) / (2.0::DOUBLE / 64) AS p FROM ban) SELECT sb, chan, CASE WHEN p > 0 AND p < 64 AND p <> floor(p) THEN CAST(floor(p) AS INTEGER) END AS low FROM z")
def low_resolution_bins(spark, sf_dir):
    return masking.low_band(masking.upward_bands(_freqs(spark, sf_dir)), "centre", 25.003, 2.0, 64).select("sb", "chan", "low")


@query(f"""WITH {CHANNELS}, a AS (SELECT *, CASE WHEN tsys BETWEEN 36 AND 60 THEN tsys END AS v0 FROM ch),
b AS (SELECT *, CASE WHEN count(v0) OVER w > 4 THEN quantile_cont(v0, 0.5) OVER w ELSE 0 END AS m FROM a WINDOW w AS (PARTITION BY feed, sb ORDER BY chan ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)), c AS (SELECT *, CASE WHEN v0 <= m + 11 THEN v0 END AS v1 FROM b),
d AS (SELECT *, CASE WHEN count(v1) OVER w > 2 THEN quantile_cont(v1, 0.5) OVER w ELSE 0 END AS m2 FROM c WINDOW w AS (PARTITION BY feed, sb ORDER BY chan ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
SELECT id, coalesce(v1 <= m2 + 1, FALSE) OR tsys IS NULL AS kept FROM d""")
def tsys_median_mask(spark, sf_dir):
    rows = channel_table(spark, sf_dir).drop("kept")
    return masking.running_median_mask(rows, ["feed", "sb"], "chan", "tsys", 36.0, 60.0, (20, 10), 1.0).select("id", "kept")


@query(f"""WITH {CHANNELS}, tb AS (SELECT CAST(s_suppkey % 5 + 1 AS INTEGER) AS feed, CAST(s_suppkey // 5 % 4 AS INTEGER) AS sb, s_suppkey // 20 AS chan, s_acctbal / 400 AS ab, s_acctbal / 300 AS leak FROM supplier)
SELECT id, coalesce(id < 700 AND (ab < 15 OR leak < 15), FALSE) AS aliased FROM ch LEFT JOIN tb USING (feed, sb, chan)""")
def aliasing_mask(spark, sf_dir):
    key = F.col("s_suppkey")
    known = read(spark, sf_dir, "supplier").select((key % 5 + 1).cast("int").alias("feed"), F.expr("cast(s_suppkey div 5 % 4 as int)").alias("sb"), F.expr("s_suppkey div 20").alias("chan"), (F.col("s_acctbal") / 400).alias("ab"), (F.col("s_acctbal") / 300).alias("leak"))
    return masking.aliasing_bad(channel_table(spark, sf_dir), known, ["feed", "sb", "chan"], "id", 700).select("id", "aliased")


@query(f"WITH {GRID} SELECT chan, round(var_pop(value), 6) AS variance, var_pop(value) > pow(1.15::DOUBLE / sqrt(80.0::DOUBLE), 2) AS noisy FROM g GROUP BY chan")
def radiometer_mask(spark, sf_dir):
    return masking.radiometer_bad(grid(spark, sf_dir), ["chan"], "value", 4000.0, 0.02).select("chan", r("variance", 6).alias("variance"), "noisy")


PAIRS = f"{GRID}, pr AS (SELECT x.sb, x.chan AS a, y.chan AS b, corr(x.value, y.value) AS corr FROM g x JOIN g y ON x.sb = y.sb AND x.t = y.t AND x.chan < y.chan GROUP BY ALL)"


@query(f"""WITH {PAIRS}, f AS (SELECT * FROM pr WHERE b - a > 1), u AS (SELECT sb, a AS chan, corr FROM f UNION ALL SELECT sb, b, corr FROM f)
SELECT sb, chan, round(max(abs(corr)), 5) AS strongest, max(abs(corr)) > 0.4 AS correlated FROM u GROUP BY ALL""")
def strongest_correlation(spark, sf_dir):
    largest = spectra.largest_correlation(grid(spark, sf_dir), ["sb"], "chan").withColumnRenamed("largest", "strongest")
    return largest.withColumn("correlated", F.col("strongest") > 0.4).select("sb", "chan", r("strongest", 5).alias("strongest"), "correlated")


@query(f"""WITH {PAIRS}, f AS (SELECT *, CAST(floor(a / 64.0) AS INTEGER) AS box_a, CAST(floor(b / 64.0) AS INTEGER) AS box_b FROM pr WHERE b - a > 1), s AS (SELECT sb, box_a, box_b, sum(corr * corr) AS s, sum(corr) AS t, greatest(count(*) FILTER (corr <> 0), 1) AS dof FROM f WHERE box_a < box_b GROUP BY ALL)
SELECT sb, box_a, box_b, CAST(dof AS BIGINT) AS dof, round((s * 64 - dof) / sqrt(2.0::DOUBLE * dof), 4) AS chi2, round(t * sqrt(64.0::DOUBLE / dof), 4) AS total FROM s""")
def correlation_boxes(spark, sf_dir):
    sums = spectra.correlation_sums(grid(spark, sf_dir), ["sb"], "chan", lambda chan: chan // 64, apart=2)
    return masking.box_statistics(sums, ["sb"], 64).select("sb", "box_a", "box_b", "dof", r("chi2").alias("chi2"), r("total").alias("total"))


@query(f"""WITH {CHANNELS}, s AS (SELECT *, avg(kept::INT) OVER (PARTITION BY feed, sb) AS share FROM (SELECT * REPLACE (size > 45 AS kept) FROM ch))
SELECT id, kept AND share > 0.1 AS kept, CASE WHEN kept AND share <= 0.1 THEN 1024::BIGINT ELSE 0::BIGINT END AS reason FROM s""")
def thin_band_mask(spark, sf_dir):
    return masking.mask_thin_bands(channel_table(spark, sf_dir).withColumn("kept", F.col("size") > 45), ["feed", "sb"]).select("id", "kept", "reason")


@query(f"""WITH {CHANNELS} SELECT feed, sb, round(avg(kept::INT), 6) AS accept_rate, round(avg(tsys) FILTER (kept), 5) AS tsys, round(sum(size) FILTER (kept) / nullif(sqrt(count(size) FILTER (kept)), 0), 5) AS chi2, round(max(size) FILTER (kept), 5) AS max_chi2,
  round(quantile_cont(size, 0.5) FILTER (kept), 5) AS median_chi2, round(100 * sqrt(pow(avg(abs(size)) FILTER (kept), 2) * 4 / 9), 5) AS amplitude FROM ch GROUP BY ALL""")
def band_statistics(spark, sf_dir):
    ch, by = channel_table(spark, sf_dir), ["feed", "sb"]
    out = scans.masked_means(ch, by, ["tsys"]).join(scans.band_chi2(ch, by, "size"), by).join(scans.mode_amplitude(ch, by, "size", F.lit(2.0), 3.0), by)
    return out.select(*by, r("accept_rate", 6).alias("accept_rate"), *[r(c, 5).alias(c) for c in ("tsys", "chi2", "max_chi2", "median_chi2", "amplitude")])


@query(f"""WITH {CHANNELS}, d AS (SELECT feed, sb, CAST(floor(chan / 16) AS INTEGER) AS low, count(*) AS n, count(*) FILTER (kept) AS good, sum(1 / (tsys * tsys)) FILTER (kept) AS w, sum(size / (tsys * tsys)) FILTER (kept) AS s FROM ch GROUP BY ALL)
SELECT feed, sb, low, CAST(n AS BIGINT) AS n, good > 0 AND w IS NOT NULL AS kept, round(s / w, 5) AS mean, round(sqrt(16 / w), 5) AS tsys_low FROM d""")
def decimate_masked(spark, sf_dir):
    ch = channel_table(spark, sf_dir)
    return series.decimate_masked(ch, ["feed", "sb"], "chan", "size", "tsys", "kept", 16).select("feed", "sb", "low", "n", "kept", r("mean", 5).alias("mean"), r("tsys_low", 5).alias("tsys_low"))


@query(f"""WITH {SCANS}, ok AS (SELECT *, mjd_start AS mjd FROM sc WHERE accepted), e AS (SELECT feed, sb, quantile_cont(el, 0.5) AS me FROM ok GROUP BY ALL),
q AS (SELECT ok.*, me, (el < me)::INT * 2 + (sidereal < 231)::INT AS qd FROM ok JOIN e USING (feed, sb)),
m AS (SELECT feed, sb, qd, quantile_cont(mjd, 0.5) AS m1, quantile_cont(price, 0.5) AS m2 FROM q GROUP BY ALL), s AS (SELECT qd, quantile_cont(sidereal, 0.5) AS m3 FROM q GROUP BY qd),
b AS (SELECT scanid, feed, sb, 1 | CASE WHEN mjd > m1 THEN 2 ELSE 0 END | CASE WHEN price > m2 THEN 4 ELSE 0 END | CASE WHEN el > me THEN 8 ELSE 0 END | CASE WHEN sidereal > m3 THEN 16 ELSE 0 END
  | CASE WHEN scanid // 100 % 2 = 1 THEN 32 ELSE 0 END | CASE WHEN scantype = 32 THEN 64 ELSE 0 END | CASE WHEN sidereal < 231 THEN 128 ELSE 0 END AS bits FROM q JOIN m USING (feed, sb, qd) JOIN s USING (qd))
SELECT scanid, CAST(coalesce(bits, 0) AS BIGINT) AS bits FROM sc LEFT JOIN b USING (scanid)""")
def quadrant_split_bits(spark, sf_dir):
    rows = scan_table(spark, sf_dir).withColumn("mjd", F.col("mjd_start")).withColumn("tsys", F.col("price")).withColumn("fbit", F.col("scantype"))
    return splits.split_bits(rows, ["half", "tsys", "elev", "sidr", "odde", "cesc", "rise"], "co7").select("scanid", "bits")


@query(f"""WITH {EV}, m AS (SELECT feed, quantile_cont(value, 0.5) AS mid, count(*) AS n FROM ev GROUP BY feed),
d AS (SELECT ev.*, mid, n, lag(value) OVER w AS p, lead(value) OVER w AS q, row_number() OVER w - 1 AS place, abs(value - mid) AS far FROM ev JOIN m USING (feed) WINDOW w AS (PARTITION BY feed ORDER BY t)),
f AS (SELECT feed, quantile_cont(far, 0.5) AS mf FROM d GROUP BY feed), s AS (SELECT d.*, mf, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN (q - p) / 2 ELSE coalesce(q - value, value - p) END AS step FROM d JOIN f USING (feed))
SELECT t, CASE WHEN step > 0 THEN 0 WHEN step < 0 THEN 1 END AS azdr, CASE WHEN value < mid THEN 0 WHEN value > mid THEN 1 END AS azmd, CASE WHEN place < floor(n / 2) THEN 0 ELSE 1 END AS schf, CASE WHEN far <= mf THEN 0 ELSE 1 END AS azdi FROM s""")
def temporal_split_masks(spark, sf_dir):
    return splits.temporal_splits(stream(spark, sf_dir), ["feed"], "t", "value").select("t", "azdr", "azmd", "schf", "azdi")


#: embeddings as spectra of pairs of detectors: 8 x 8 bins.
SPECTRA = """sp AS (SELECT CAST(vec_id % 7 AS INTEGER) AS feed1, CAST(vec_id // 7 % 7 AS INTEGER) AS feed2, CAST(vec_id // 49 AS INTEGER) AS run, 0.5 + label / 20.0::DOUBLE AS overlap, CAST((generate_subscripts(embedding, 1) - 1) // 8 AS INTEGER) AS i,
  CAST((generate_subscripts(embedding, 1) - 1) % 8 AS INTEGER) AS j, unnest(embedding)::DOUBLE AS value FROM embeddings),
sk AS (SELECT *, 0.1 * (i + 1) AS k_perp, 0.08 * j AS k_par, 0.1 + 0.01 * (i + j) AS sigma, 1.0 / (1 + 0.1 * (i + j)) AS transfer FROM (SELECT feed1, feed2, run, overlap, i::DOUBLE AS i, j::DOUBLE AS j, value FROM sp)),
en AS (SELECT max(transfer) FILTER (i > 0 AND j > 0 AND i < 7 AND j < 7) AS most FROM sk),
su AS (SELECT sk.*, transfer > 0.5 * most AND k_perp BETWEEN 0.11 AND 0.75 AND k_par BETWEEN 0 AND 0.5 AND sqrt(k_perp * k_perp + k_par * k_par) BETWEEN 0 AND 0.8 AS usable FROM sk, en)"""
MOMENTS = "pc AS (SELECT run, feed1, feed2, sign(sum(pow(value / sigma, 3)) FILTER (usable)) * abs((sum(value * value / (sigma * sigma)) FILTER (usable) - count(*) FILTER (usable)) / sqrt(2.0::DOUBLE * count(*) FILTER (usable))) AS chi2, max(overlap) AS overlap FROM su GROUP BY ALL)"


def _cells(spark, sf_dir):
    long = spectra.long_matrix(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    rows = long.select(
        (F.col("vec_id") % 7).cast("int").alias("feed1"), F.expr("cast(vec_id div 7 % 7 as int)").alias("feed2"), F.expr("cast(vec_id div 49 as int)").alias("run"), (0.5 + F.col("label") / 20.0).alias("overlap"),
        F.expr("cast(t div 8 as double)").alias("i"), (F.col("t") % 8).cast("double").alias("j"), "value",
    )
    return rows.withColumns({"k_perp": 0.1 * (F.col("i") + 1), "k_par": 0.08 * F.col("j"), "sigma": 0.1 + 0.01 * (F.col("i") + F.col("j")), "transfer": 1.0 / (1 + 0.1 * (F.col("i") + F.col("j")))})


def _usable(spark, sf_dir):
    return averages.usable_bins(_cells(spark, sf_dir), 0.5, (0.11, 0.75), (0.0, 0.5), (0.0, 0.8))


@query(f"WITH {SPECTRA} SELECT DISTINCT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, usable FROM su")
def k_space_mask(spark, sf_dir):
    return _usable(spark, sf_dir).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "usable").distinct()


@query(f"WITH {SPECTRA}, {MOMENTS} SELECT run, feed1, feed2, round(chi2, 3) AS chi2, feed1 <> feed2 AND chi2 <> 0 AND abs(chi2) < 5 AND overlap > 0.6 AS accepted FROM pc")
def spectrum_acceptance(spark, sf_dir):
    return averages.accepted_pairs(_usable(spark, sf_dir), ["run", "feed1", "feed2"]).select("run", "feed1", "feed2", r("chi2", 3).alias("chi2"), "accepted")


AVERAGED = f"""{SPECTRA}, {MOMENTS}, av AS (SELECT i, j, any_value(k_perp) AS k_perp, any_value(k_par) AS k_par, any_value(transfer) AS transfer, any_value(usable) AS usable, sum(value / (sigma * sigma)) / sum(1 / (sigma * sigma)) AS mean, 1 / sqrt(sum(1 / (sigma * sigma))) AS error, count(*) AS pairs
  FROM su JOIN pc USING (run, feed1, feed2) WHERE feed1 <> feed2 AND chi2 <> 0 AND abs(chi2) < 5 AND pc.overlap > 0.6 GROUP BY i, j)"""


def _averaged(spark, sf_dir):
    cells, pair = _usable(spark, sf_dir), ["run", "feed1", "feed2"]
    return averages.averaged(cells, averages.accepted_pairs(cells, pair), pair, ["i", "j", "k_perp", "k_par", "transfer", "usable"])


@query(f"WITH {AVERAGED} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(mean, 5) AS mean, round(error, 6) AS error, CAST(pairs AS BIGINT) AS pairs FROM av")
def pair_averaged_spectrum(spark, sf_dir):
    return _averaged(spark, sf_dir).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r("mean", 5).alias("mean"), r("error", 6).alias("error"), "pairs")


EDGES = [0.05, 0.2, 0.35, 0.5, 0.7, 1.1]


@query(f"""WITH {AVERAGED}, k AS (SELECT *, sqrt(k_perp * k_perp + k_par * k_par) AS k, CASE WHEN usable THEN pow(transfer / error, 2) ELSE 0 END AS w FROM av), b AS (SELECT *, CASE WHEN k < 0.05 THEN NULL WHEN k < 0.2 THEN 0 WHEN k < 0.35 THEN 1 WHEN k < 0.5 THEN 2 WHEN k < 0.7 THEN 3 WHEN k <= 1.1 THEN 4 END AS bin FROM k)
SELECT bin, round(CASE WHEN bin < 4 THEN sum(w * mean / transfer) / nullif(sum(w), 0) END, 4) AS power, round(CASE WHEN bin < 4 THEN 1 / sqrt(nullif(sum(w), 0)) END, 6) AS error, CAST(count(*) AS BIGINT) AS modes FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def spherical_average(spark, sf_dir):
    return averages.spherical(_averaged(spark, sf_dir), [], EDGES, (0.0, 0.65)).select("bin", r("power").alias("power"), r("error", 6).alias("error"), "modes")


@query(f"""WITH {SPECTRA}, n AS (SELECT max(run) + 1 AS runs FROM su) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(stddev_samp(nullif(value, 0)) FILTER (run < floor(runs * 0.25)), 5) AS sigma, round(quantile_cont(overlap, 0.5), 5) AS overlap FROM su, n GROUP BY i, j""")
def random_split_sigma(spark, sf_dir):
    sigma, _ = averages.random_split_noise(_cells(spark, sf_dir), "run", ["i", "j"], "value", "overlap")
    return sigma.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r("sigma", 5).alias("sigma"), r("overlap", 5).alias("overlap"))


@query(f"WITH {GRID}, c AS (SELECT chan, t, value FROM g) SELECT x.t AS a, y.t AS b, round(covar_samp(x.value, y.value), 6) + 0 AS covariance FROM c x JOIN c y USING (chan) WHERE x.t <= y.t GROUP BY ALL")
def ensemble_covariance(spark, sf_dir):
    return averages.ensemble_covariance(grid(spark, sf_dir), "chan", "t", "value").select("a", "b", (r("covariance", 6) + 0.0).alias("covariance"))


@query(f"WITH {GRID} SELECT sb, t, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, CAST(count(*) AS BIGINT) AS runs FROM g GROUP BY ALL")
def ensemble_moments(spark, sf_dir):
    return averages.ensemble_moments(grid(spark, sf_dir), ["sb", "t"], "value").select("sb", "t", r("mean", 6).alias("mean"), r("std", 6).alias("std"), "runs")


@query(f"""WITH {GRID}, x AS (SELECT t, (value * 2 - chan % 3 - 0.5) / (1 + chan % 5) AS one, 0.5 + chan % 3 AS noise FROM g), o AS (SELECT t, avg(one) AS transfer, stddev_samp(one) AS spread, avg(noise) AS noise FROM x GROUP BY t)
SELECT t, round(transfer, 5) AS transfer, round(spread, 5) AS spread, round(noise / (SELECT max(noise) FROM o), 6) AS noise_share FROM o""")
def transfer_estimates(spark, sf_dir):
    rows = grid(spark, sf_dir).select("t", (2 * F.col("value")).alias("injected"), (0.5 + F.col("chan") % 3).cast("double").alias("noise"), (1 + F.col("chan") % 5).cast("double").alias("signal"))
    return averages.transfer_estimates(rows, ["t"]).select("t", r("transfer", 5).alias("transfer"), r("spread", 5).alias("spread"), r("noise_share", 6).alias("noise_share"))


@query(f"""WITH {GRID}, m AS (SELECT sb AS model, chan, t * 0.1::DOUBLE AS k0, value AS p0, lead(t * 0.1::DOUBLE) OVER w AS k1, lead(value) OVER w AS p1 FROM g WHERE chan < 3 WINDOW w AS (PARTITION BY chan ORDER BY t)), b AS (SELECT chan, t * 0.07::DOUBLE + 0.013 AS k, value AS power, 0.5 AS error FROM g)
SELECT b.chan, m.chan AS model, round(sum(pow((power - (p0 + (p1 - p0) * (k - k0) / (k1 - k0))) / error, 2)), 3) AS chi2, CAST(count(*) AS BIGINT) AS bins FROM b JOIN m ON k >= k0 AND k < k1 AND k1 IS NOT NULL GROUP BY ALL""")
def model_chi2(spark, sf_dir):
    g = grid(spark, sf_dir)
    model = g.filter("chan < 3").select(F.col("chan").alias("model"), (F.col("t") * 0.1).alias("k"), F.col("value").alias("power"))
    bins = g.select("chan", (F.col("t") * 0.07 + 0.013).alias("k"), F.col("value").alias("power"), F.lit(0.5).alias("error"))
    return averages.model_chi2(bins, model, ["chan"]).select("chan", "model", r("chi2", 3).alias("chi2"), "bins")


@query("""WITH p AS (SELECT label, (vec_id * 37 % 101) / 101.0::DOUBLE AS pte FROM embeddings), s AS (SELECT label, pte, row_number() OVER (PARTITION BY label ORDER BY pte) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM p)
SELECT label, CAST(any_value(n) AS BIGINT) AS n, round(max(greatest((i + 1.0::DOUBLE) / n - pte, pte - i / n::DOUBLE)), 6) AS distance FROM s GROUP BY label""")
def null_test_uniformity(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") * 37 % 101 / 101.0).alias("pte"))
    return averages.uniformity(rows, ["label"], "pte").select("label", "n", r("distance", 6).alias("distance"))


@query("""WITH m AS (SELECT 's' || (s_suppkey % 3) AS split, CAST(s_nationkey AS INTEGER) AS u FROM supplier GROUP BY ALL), p(a, b) AS (VALUES ('s0', 's1'), ('s0', 's0'), ('s2', 's1'))
SELECT a AS split1, b AS split2, x.u AS feed1, y.u AS feed2 FROM p JOIN m x ON x.split = a JOIN m y ON y.split = b WHERE a <> b OR y.u >= x.u""")
def cross_pairs(spark, sf_dir):
    maps = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 3).cast("string")).alias("split"), F.col("s_nationkey").cast("int").alias("u")).distinct()
    return averages.pair_table(maps, "u", spark.createDataFrame([("s0", "s1"), ("s0", "s0"), ("s2", "s1")], "split1 string, split2 string"))
