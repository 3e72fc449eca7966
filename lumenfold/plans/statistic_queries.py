"""Scan statistics, map keys and null-test tables on the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import averages, crosses, fields, splits, statistics
from . import cross_queries
from .queries import EV, QUERIES, query, r, read, stream  # noqa: F401


@query(f"""WITH {EV}, x AS (SELECT feed, sb AS chan, value, (t * 7919 % 101)::DOUBLE AS az, 1 + feed % 3 AS s FROM ev), sp AS (SELECT feed, chan, min(az) AS lo, max(az) AS hi FROM x GROUP BY ALL),
c AS (SELECT feed, chan, coalesce(least(floor((az - lo) / nullif(hi - lo, 0) * 15), 14), 0) AS bin, sum(value / s / 100) AS v, count(*) AS n FROM x JOIN sp USING (feed, chan) GROUP BY ALL),
k AS (SELECT feed, chan, (sum(v * v / n) - 15) / sqrt(30.0::DOUBLE) AS q FROM c GROUP BY ALL)
SELECT feed, round(sum(q) / sqrt(count(*)), 5) AS az_chi2, round(max(q), 5) AS max_az_chi2, round(quantile_cont(q, 0.5), 5) AS med_az_chi2 FROM k GROUP BY feed""")
def azimuth_chi2(spark, sf_dir):
    rows = stream(spark, sf_dir).select("feed", F.col("sb").alias("chan"), (F.col("value") / 100).alias("value"), (F.col("t") * 7919 % 101).cast("double").alias("az"), (1 + F.col("feed") % 3).cast("double").alias("s"))
    out = statistics.azimuth_chi2(rows, ["feed"], "chan", "az", "value", "s")
    return out.select("feed", *[r(c, 5).alias(c) for c in ("az_chi2", "max_az_chi2", "med_az_chi2")])


@query(f"""WITH {EV}, s AS (SELECT feed, feed * 10 + t // 3000 AS scanid, min(t) AS a, max(t) AS b FROM ev GROUP BY ALL)
SELECT s.scanid, round(avg(value) FILTER (sb = 'view'), 5) AS airtemp, round(avg(value) FILTER (sb = 'click'), 5) AS humidity FROM s JOIN ev ON ev.feed = s.feed AND t BETWEEN a AND b GROUP BY s.scanid""")
def housekeeping_means(spark, sf_dir):
    ev = stream(spark, sf_dir)
    scans = ev.groupBy("feed", (F.col("feed") * 10 + F.expr("t div 3000")).alias("scanid")).agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    name = F.when(F.col("sb") == "view", "airtemp").when(F.col("sb") == "click", "humidity").otherwise("other")
    out = statistics.housekeeping_means(ev.select("feed", name.alias("name"), F.col("t").alias("at"), "value"), scans, ["feed"], ["airtemp", "humidity"], 3000.0)
    return out.select("scanid", r("airtemp", 5).alias("airtemp"), r("humidity", 5).alias("humidity"))


@query("""WITH a AS (SELECT o_orderkey % 50 AS scanid, CAST(o_custkey % 4 AS INTEGER) AS sb, CASE WHEN o_orderkey % 3 = 0 THEN 'pcf' ELSE 'pca' END AS kind, CAST(o_custkey % 5 + 1 AS INTEGER) AS mode, o_totalprice / 1e5 - 2 AS amp FROM orders),
s AS (SELECT c_custkey % 50 AS scanid, CASE WHEN c_custkey // 50 % 2 = 0 THEN 'pcf' ELSE 'pca' END AS kind, CAST(c_custkey // 100 % 5 + 1 AS INTEGER) AS mode, max(abs(c_acctbal) / 1e4) AS spread FROM customer GROUP BY ALL),
p AS (SELECT a.scanid, sb, a.kind, a.mode, 100 * avg(abs(amp)) * any_value(spread) / 0.05::DOUBLE AS p FROM a LEFT JOIN s USING (scanid, kind, mode) GROUP BY ALL)
SELECT scanid, sb, count(*) FILTER (kind = 'pca') AS npca, count(*) FILTER (kind = 'pcf') AS npcaf, round(coalesce(max(p) FILTER (kind = 'pca' AND mode = 1), 0), 3) AS pca1, round(coalesce(max(p) FILTER (kind = 'pca' AND mode = 2), 0), 3) AS pca2,
  round(coalesce(max(p) FILTER (kind = 'pca' AND mode = 3), 0), 3) AS pca3, round(coalesce(max(p) FILTER (kind = 'pca' AND mode = 4), 0), 3) AS pca4, round(coalesce(max(p) FILTER (kind = 'pcf' AND mode = 1), 0), 3) AS pcf1,
  round(coalesce(max(p) FILTER (kind = 'pcf' AND mode = 2), 0), 3) AS pcf2, round(coalesce(sum(p) FILTER (mode <= 4), 0), 3) AS pcsm FROM p GROUP BY ALL""")
def mode_statistics(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    amplitudes = read(spark, sf_dir, "orders").select((key % 50).alias("scanid"), (F.col("o_custkey") % 4).cast("int").alias("sb"), F.when(key % 3 == 0, "pcf").otherwise("pca").alias("kind"), (F.col("o_custkey") % 5 + 1).cast("int").alias("mode"), key.alias("chan"), (F.col("o_totalprice") / 1e5 - 2).alias("amplitude"))
    spreads = read(spark, sf_dir, "customer").groupBy((cust % 50).alias("scanid"), F.when(F.expr("c_custkey div 50 % 2") == 0, "pcf").otherwise("pca").alias("kind"), F.expr("c_custkey div 100 % 5 + 1").cast("int").alias("mode")).agg(F.max(F.abs("c_acctbal") / 1e4).alias("spread"))
    out = statistics.mode_statistics(amplitudes, spreads, ["scanid", "sb"], 0.05)
    return out.select("scanid", "sb", "npca", "npcaf", *[r(c, 3).alias(c) for c in ("pca1", "pca2", "pca3", "pca4", "pcf1", "pcf2", "pcsm")])


def _lobe_sql(around: float) -> str:
    return f"""(SELECT c_custkey, l, b FROM (SELECT *, ((122.93192::DOUBLE - degrees(atan2(cos(dec) * sin(ra - radians(192.85948::DOUBLE)), sin(dec) * cos(radians(27.12825::DOUBLE)) - cos(dec) * sin(radians(27.12825::DOUBLE)) * cos(ra - radians(192.85948::DOUBLE))))) % 360 + 360) % 360 AS l,
    degrees(asin(sin(dec) * sin(radians(27.12825::DOUBLE)) + cos(dec) * cos(radians(27.12825::DOUBLE)) * cos(ra - radians(192.85948::DOUBLE)))) AS b FROM (
    SELECT *, asin(sin(h) * sin(p) + cos(h) * cos(p) * cos(a)) AS dec, radians(sid) - atan2(-sin(a) * cos(h), sin(h) * cos(p) - cos(h) * sin(p) * cos(a)) AS ra FROM (
    SELECT *, radians(37.23::DOUBLE) AS p, atan2(y, x * cos(t) + z * sin(t)) + radians(az) AS a, asin(greatest(least(z * cos(t) - x * sin(t), 1), -1)) AS h FROM (
    SELECT *, radians(90 - alt) AS t, cos(radians(25.0::DOUBLE)) * cos(radians({around}::DOUBLE)) AS x, cos(radians(25.0::DOUBLE)) * sin(radians({around}::DOUBLE)) AS y, sin(radians(25.0::DOUBLE)) AS z FROM base)))))"""


@query(f"""WITH base AS (SELECT c_custkey, c_custkey * 37 % 360::DOUBLE AS az, 30 + c_custkey % 45::DOUBLE AS alt, c_custkey * 7 % 360::DOUBLE AS sid FROM customer)
SELECT c_custkey, round(s1.l, 4) AS lon1, round(s1.b, 4) AS lat1, round(s3.l, 4) AS lon3, round(s3.b, 4) AS lat3, round(degrees(acos(cos(radians(s4.b)) * cos(radians(s4.l)))), 4) AS far4
FROM base JOIN {_lobe_sql(0.0)} s1 USING (c_custkey) JOIN {_lobe_sql(90.0)} s3 USING (c_custkey) JOIN {_lobe_sql(270.0)} s4 USING (c_custkey)""")
def side_lobes(spark, sf_dir):
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", (key * 37 % 360).cast("double").alias("az"), (30 + key % 45).cast("double").alias("alt"), (key * 7 % 360).cast("double").alias("sid"))
    out = statistics.side_lobes(rows, "az", "alt", "sid", 37.23)
    return out.select("c_custkey", *[r(f"galaxy_sl{k}_{c}").alias(f"{c}{k}") for k in (1, 3) for c in ("lon", "lat")], r("galactic_center_dist_sl4").alias("far4"))


@query("""WITH k AS (SELECT o_orderkey, (o_custkey % 64) AS bits FROM orders), h AS (SELECT unnest(['0', '1']) AS h)
SELECT o_orderkey, 'elev' || (bits >> 3 & 1) || 'azdr' || h || 'ambt' || (bits >> 1 & 1) AS split_key FROM k, h WHERE bits & 1 = 1
UNION ALL SELECT o_orderkey, 'dayn' || (bits >> 4 & 1) || 'azdr' || h || 'ambt' || (bits >> 1 & 1) FROM k, h WHERE bits & 1 = 1""")
def temporal_map_keys(spark, sf_dir):
    """Maps of scans by two primaries, a secondary, and a secondary that halves samples."""
    keys = splits.map_keys(F.col("bits"), ["ambt", "wind", "elev", "dayn"], ["elev", "dayn"], ["ambt", "azdr"], ["azdr"])
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 64).alias("bits")).select("o_orderkey", F.explode(keys).alias("split_key"))


@query("""WITH p AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS test, o_orderpriority AS c, min(o_totalprice / 6e5) AS p FROM orders GROUP BY ALL), w AS (SELECT c, p, row_number() OVER (PARTITION BY c ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY c) AS n FROM p),
d AS (SELECT c, any_value(n) AS n, max(greatest((i + 1) / n::DOUBLE - p, p - i / n::DOUBLE)) AS d FROM w GROUP BY c), x AS (SELECT c, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * d AS x FROM d),
k AS (SELECT c, CASE WHEN x < 0.2 THEN 1 ELSE (SELECT least(greatest(sum(2 * CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * j * j * x * x)), 0), 1) FROM range(1, 41) r(j)) END AS p FROM x), a AS (SELECT test, c, p, false AS last FROM p UNION ALL SELECT 'KS', c, p, true FROM k)
SELECT test, last, round(max(p) FILTER (c = '1-URGENT'), 6) AS urgent, round(max(p) FILTER (c = '2-HIGH'), 6) AS high, round(max(p) FILTER (c = '5-LOW'), 6) AS low FROM a WHERE c IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY test, last""")
def null_test_table(spark, sf_dir):
    ptes = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).cast("string").alias("test"), F.col("o_orderpriority").alias("c")).agg(F.min(F.col("o_totalprice") / 6e5).alias("p"))
    out = averages.pte_table(ptes, "test", "c", "p", ["1-URGENT", "2-HIGH", "5-LOW"])
    return out.select("test", "last", r("1-URGENT", 6).alias("urgent"), r("2-HIGH", 6).alias("high"), r("5-LOW", 6).alias("low"))


@query()
def cross_correlation_transfer(spark, sf_dir):
    """Transfer functions of each detector's map of the first split against the second as signal: cross over auto spectrum, bin by bin."""
    cells = cross_queries.cells(spark, sf_dir)
    both = crosses.map_pairs(cells, spark.createDataFrame([(0, 1), (1, 1)], "split1 int, split2 int")).filter("feed1 = feed2")
    power = crosses.pair_spectra(cells, both, cross_queries.SHAPE, cross_queries.STEPS, cross_queries.ACROSS, cross_queries.ALONG).join(both, "pair")
    by = ["field2", "feed2", "across", "along"]
    return fields.cross_transfer(power.filter("split1 = 0"), power.filter("split1 = 1"), by)
