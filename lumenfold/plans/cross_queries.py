"""Pairs of maps, their spectra and noise runs, and map statistics on the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import averages, crosses, map_tests
from .queries import QUERIES, query, r, read  # noqa: F401

SHAPE, STEPS = (6, 5, 8), (2.0, 2.0, 1.0)
ACROSS, ALONG = [0.3, 1.0, 2.0, 3.0], [0.1, 1.0, 2.0, 3.2]
RUNS, SEED = 12, 7


def cells(spark, sf_dir):
    """lineitem as maps: a field of each line status, two splits, three detectors, 6 x 5 pixels and 8 channels."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("field"), (F.col("l_linenumber") % 2).cast("int").alias("split"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("feed"), (F.col("l_partkey") % 6).cast("int").alias("x"),
        (F.col("l_suppkey") % 5).cast("int").alias("y"), (F.col("l_quantity") % 8).cast("int").alias("z"), ((F.col("l_extendedprice") - 38_000) / 23_000).alias("value"), (1 / (1 + F.col("l_tax")) ** 2).alias("w"),
    )
    sums = rows.groupBy(*crosses.KEY, "x", "y", "z").agg(F.sum(F.col("value") * F.col("w")).alias("num"), F.sum("w").alias("den"))
    return sums.select(*crosses.KEY, "x", "y", "z", (F.col("num") / F.col("den")).alias("map"), (1 / F.sqrt("den")).alias("sigma"))


def pairs(spark, sf_dir):
    splits = spark.createDataFrame([(0, 0), (0, 1)], "split1 int, split2 int")
    fields = spark.createDataFrame([("F", "F"), ("O", "O"), ("F", "O")], "field1 string, field2 string")
    return crosses.map_pairs(cells(spark, sf_dir), splits, fields)


MAPS = """c AS (SELECT l_linestatus AS field, CAST(l_linenumber % 2 AS INTEGER) AS split, CAST(l_suppkey % 3 + 1 AS INTEGER) AS feed, l_partkey % 6 AS x, l_suppkey % 5 AS y, CAST(floor(l_quantity % 8) AS INTEGER) AS z,
  1 / sqrt(sum(1 / pow(1 + l_tax, 2))) AS sigma FROM lineitem GROUP BY ALL), k AS (SELECT DISTINCT field, split, feed FROM c),
p AS (SELECT a.field AS field1, a.split AS split1, a.feed AS feed1, b.field AS field2, b.split AS split2, b.feed AS feed2 FROM k a JOIN k b ON a.split = 0 AND a.field <= b.field WHERE a.field <> b.field OR a.split <> b.split OR a.feed <= b.feed)"""


@query(f"WITH {MAPS} SELECT * FROM p")
def map_pair_table(spark, sf_dir):
    return pairs(spark, sf_dir).drop("pair")


@query(f"""WITH {MAPS}, m AS (SELECT p.*, z, 1 / a.sigma AS w1, 1 / b.sigma AS w2 FROM p JOIN c a ON a.field = field1 AND a.split = split1 AND a.feed = feed1 JOIN c b USING (x, y, z) WHERE b.field = field2 AND b.split = split2 AND b.feed = feed2),
s AS (SELECT field, split, feed, z, sum(1 / pow(sigma, 2)) AS ss, count(*) AS n FROM c GROUP BY ALL),
h AS (SELECT p.*, x.z, count(w1) AS shared, any_value(x.n) AS n1, any_value(y.n) AS n2, sum(w1 * w2) / sqrt(any_value(x.ss) * any_value(y.ss)) AS o
  FROM p JOIN s x ON x.field = field1 AND x.split = split1 AND x.feed = feed1 JOIN s y ON y.field = field2 AND y.split = split2 AND y.feed = feed2 AND y.z = x.z LEFT JOIN m ON m.z = x.z AND (m.field1, m.split1, m.feed1, m.field2, m.split2, m.feed2) = (p.field1, p.split1, p.feed1, p.field2, p.split2, p.feed2) GROUP BY ALL)
SELECT field1, split1, feed1, field2, split2, feed2, round(avg(shared / (n1 + n2 - shared)::DOUBLE), 6) AS iou, round(avg(nullif(o, 0)), 6) AS overlap FROM h GROUP BY ALL""")
def pair_overlap_table(spark, sf_dir):
    both = pairs(spark, sf_dir)
    return crosses.pair_overlaps(cells(spark, sf_dir), both).join(both, "pair").select(*crosses.SIDES, r("iou", 6).alias("iou"), r("overlap", 6).alias("overlap"))


@query(f"""WITH {MAPS}, t AS (SELECT p.*, side, run FROM p, (SELECT unnest([1, 2]) AS side), (SELECT unnest(range({RUNS})) AS run)),
b AS (SELECT *, {SEED} * (run + 1) * side + CASE side WHEN 1 THEN feed1 ELSE feed2 END AS base FROM t)
SELECT field1, split1, feed1, field2, split2, feed2, CAST(run AS INTEGER) AS run, CAST(side AS INTEGER) AS side, CAST(base * {2 * RUNS} + row_number() OVER (PARTITION BY field1, split1, feed1, field2, split2, feed2, base ORDER BY run, side) - 1 AS BIGINT) AS seed FROM b""")
def noise_seed_table(spark, sf_dir):
    both = pairs(spark, sf_dir)
    return crosses.noise_seeds(both, RUNS, SEED).join(both, "pair").select(*crosses.SIDES, "run", "side", "seed")


@query()
def pair_spectra(spark, sf_dir):
    """Every pair's spectrum with the spread of its noise runs."""
    both = pairs(spark, sf_dir)
    data, _ = crosses.with_noise(crosses.pair_spectra(cells(spark, sf_dir), both, SHAPE, STEPS, ACROSS, ALONG, RUNS, SEED))
    return data.join(both, "pair").select(*crosses.SIDES, "across", "along", "power", "sigma", "modes")


@query()
def accepted_pair_average(spark, sf_dir):
    """Spectra averaged over the accepted pairs of each two fields and splits, with as much of their noise runs' mean chi-square."""
    both = pairs(spark, sf_dir)
    data, _ = crosses.with_noise(crosses.pair_spectra(cells(spark, sf_dir), both, SHAPE, STEPS, ACROSS, ALONG, RUNS, SEED))
    rows = data.join(both, "pair").join(crosses.pair_overlaps(cells(spark, sf_dir), both), "pair").withColumn("usable", F.lit(True)).withColumnRenamed("power", "value")
    accepted = averages.accepted_pairs(rows, ["pair", "feed1", "feed2"], 5.0, 0.1)
    return averages.averaged(rows, accepted, ["pair"], ["field1", "split1", "field2", "split2", "across", "along"])


def scan_maps(spark, sf_dir):
    """lineitem as scans' maps: two observations of three scans, two detectors of two bands of five channels, 5 x 4 pixels."""
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 2).cast("int").alias("obsid"), (F.col("l_suppkey") % 2 * 100 + F.col("l_linenumber") % 3).cast("int").alias("scan"), (F.expr("l_suppkey div 2") % 2 + 1).cast("int").alias("feed"), (F.col("l_partkey") % 2).cast("int").alias("sb"),
        (F.expr("l_partkey div 2") % 5).cast("int").alias("x"), (F.expr("l_suppkey div 4") % 2 * 2 + F.expr("l_partkey div 10") % 2).cast("int").alias("y"), (F.col("l_quantity") % 5).cast("int").alias("chan"), ((F.col("l_extendedprice") - 38_000) / 23_000).alias("value"),
    )
    return rows.groupBy(*map_tests.UNIT, "x", "y", "chan").agg(F.avg("value").alias("map"), (1 / F.sqrt(F.count("*"))).alias("sigma"))


@query()
def map_noise_tests(spark, sf_dir):
    return map_tests.map_statistics(scan_maps(spark, sf_dir), 5, 2, (15.0, 15.0, 4.0), runs=RUNS, seed=5)
