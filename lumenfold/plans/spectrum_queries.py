"""Tabulated transfer functions, model splines, fitted degrees of freedom and covariance weights on the tables at hand."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import averages, spectra, tabulated
from .queries import query, r, read

KX, KY = [float((b + 1) ** 1.5) for b in range(6)], [0.0, 0.5, 1.5, 3.0, 5.0]


def _values(knots: list[float]) -> str:
    op = tabulated.spline_operator(knots)
    return ", ".join(f"({i}, {a}, {k}, {float(op[i, a, k])!r}::DOUBLE)" for i, a, k in zip(*map(np.ndarray.tolist, np.nonzero(op))))


def _list(knots: list[float]) -> str:
    return "[" + ", ".join(f"{k!r}::DOUBLE" for k in knots) + "]"


@query(f"""WITH t AS (SELECT l_linenumber % 2 AS name, CAST(least(floor(l_quantity / 8), 5) AS INTEGER) AS b, CAST(l_suppkey % 5 AS INTEGER) AS j, avg(l_extendedprice) / 4e4::DOUBLE AS v FROM lineitem GROUP BY ALL),
z AS (SELECT b, j, product(v) AS z FROM t GROUP BY b, j HAVING count(*) = 2), ox(i, a, b, d) AS (VALUES {_values(KX)}), oy(i, a, j, d) AS (VALUES {_values(KY)}),
c AS (SELECT ox.i, oy.i AS j, ox.a, oy.a AS b, sum(z * ox.d * oy.d) AS c FROM z JOIN ox USING (b) JOIN oy ON oy.j = z.j GROUP BY ALL),
p AS (SELECT p_partkey, least(greatest(p_size / 3.0::DOUBLE, {KX[0]!r}), {KX[-1]!r}) AS x, least(greatest(p_partkey % 100 / 20.0::DOUBLE, {KY[0]!r}), {KY[-1]!r}) AS y FROM part),
q AS (SELECT *, len(list_filter({_list(KX[1:-1])}, lambda k: k <= x)) AS i, len(list_filter({_list(KY[1:-1])}, lambda k: k <= y)) AS j FROM p)
SELECT p_partkey, round(sum(c * pow(x - {_list(KX)}[q.i + 1], a) * pow(y - {_list(KY)}[q.j + 1], b)), 6) AS transfer FROM q JOIN c USING (i, j) GROUP BY p_partkey""")
def tabulated_transfer(spark, sf_dir):
    """The product of two tables, one of each half of the lines, at a place of each part."""
    at = lambda knots, i: F.element_at(F.array(*[F.lit(k) for k in knots]), i + 1)
    tables = read(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_linenumber") % 2).alias("name"), at(KX, F.least(F.floor(F.col("l_quantity") / 8), F.lit(5)).cast("int")).alias("kx"), at(KY, (F.col("l_suppkey") % 5).cast("int")).alias("ky"),
    ).agg((F.avg("l_extendedprice") / 4e4).alias("v"))
    points = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 3.0).alias("x"), (F.col("p_partkey") % 100 / 20.0).alias("y"))
    return tabulated.transfer_at(points, "x", "y", tables, "name", "kx", "ky", "v").select("p_partkey", r("transfer", 6).alias("transfer"))


@query("""WITH RECURSIVE a AS (SELECT p_brand, p_size, p_partkey % 5 / 4.0::DOUBLE AS mu, avg(p_retailprice) AS v FROM part GROUP BY ALL),
g AS (SELECT p_brand, p_size, (lead(v) OVER w + v) / 2 * (lead(mu) OVER w - mu) AS s FROM a WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY mu)),
m AS (SELECT p_brand, p_size::DOUBLE AS k, coalesce(sum(s), 0) AS y FROM g GROUP BY p_brand, p_size),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY p_brand) AS n, lead(k) OVER w - k AS h, (lead(y) OVER w - y) / (lead(k) OVER w - k) AS s, lead(k) OVER w AS k1 FROM m WINDOW w AS (PARTITION BY p_brand ORDER BY k)),
t AS (SELECT *, lag(h) OVER w AS g, lag(s) OVER w AS s0 FROM n WINDOW w AS (PARTITION BY p_brand ORDER BY i)),
f(p_brand, i, n, c, d) AS (SELECT p_brand, i, n, 0.0::DOUBLE, 0.0::DOUBLE FROM t WHERE i = 1 UNION ALL
  SELECT t.p_brand, t.i, t.n, t.h / (2 * (t.g + t.h) - t.g * f.c), (6 * (t.s - t.s0) - t.g * f.d) / (2 * (t.g + t.h) - t.g * f.c) FROM f JOIN t ON t.p_brand = f.p_brand AND t.i = f.i + 1 WHERE t.i < t.n),
b(p_brand, i, m) AS (SELECT p_brand, n, 0.0::DOUBLE FROM t WHERE i = 1 UNION ALL SELECT f.p_brand, f.i, f.d - f.c * b.m FROM b JOIN f ON f.p_brand = b.p_brand AND f.i = b.i - 1 WHERE f.i > 1),
e AS (SELECT t.*, coalesce(x.m, 0) AS m0, coalesce(y.m, 0) AS m1 FROM t LEFT JOIN b x ON x.p_brand = t.p_brand AND x.i = t.i LEFT JOIN b y ON y.p_brand = t.p_brand AND y.i = t.i + 1 WHERE t.k1 IS NOT NULL)
SELECT p_partkey, round(e.y + (p.p_size + 0.37::DOUBLE - k) * (s - h * (2 * m0 + m1) / 6 + (p.p_size + 0.37::DOUBLE - k) * (m0 / 2 + (p.p_size + 0.37::DOUBLE - k) * (m1 - m0) / 6 / h)), 3) + 0 AS power
FROM part p LEFT JOIN e ON e.p_brand = p.p_brand AND p.p_size + 0.37::DOUBLE >= k AND p.p_size + 0.37::DOUBLE < k1""")
def model_spline_power(spark, sf_dir):
    """Each brand's model over sizes, integrated over an angle, at a place of each part."""
    part = read(spark, sf_dir, "part")
    rows = part.groupBy("p_brand", "p_size", (F.col("p_partkey") % 5 / 4.0).alias("mu")).agg(F.avg("p_retailprice").alias("v"))
    models = tabulated.angle_mean(rows, ["p_brand", "p_size"], "mu", "v")
    intervals = tabulated.spline_intervals(models, "p_brand", "p_size", "power", "natural")
    points = part.select("p_partkey", "p_brand", (F.col("p_size") + F.lit(0.37)).alias("k"))
    return tabulated.evaluate_splines(points, "p_brand", "k", intervals, 5.0).select("p_partkey", (r("power", 3) + 0.0).alias("power"))


def _digamma(x: str) -> str:
    shift = " + ".join(f"1 / ({x} + {k})" for k in range(8))
    z = f"pow({x} + 8, -2)"
    return f"(ln({x} + 8) - 0.5 / ({x} + 8) - {z} * (1 / 12.0 - {z} * (1 / 120.0 - {z} * (1 / 252.0 - {z} * (1 / 240.0 - {z} / 132.0)))) - ({shift}))".replace(".0 ", ".0::DOUBLE ").replace(".0)", ".0::DOUBLE)")


@query(f"""WITH RECURSIVE s AS (SELECT c_nationkey AS nation, pow(c_acctbal / 3000, 2) AS x FROM customer), f AS (SELECT s_nationkey AS nation, avg(pow(s_acctbal / 3000, 2)) AS chi2 FROM supplier GROUP BY 1),
l AS (SELECT nation, avg(ln(x / 2)) AS l FROM s WHERE x > 0 GROUP BY nation),
d(nation, l, lo, hi, k) AS (SELECT nation, l, 1e-3::DOUBLE, 1e3::DOUBLE, 0 FROM l UNION ALL
  SELECT nation, l, CASE WHEN {_digamma('((lo + hi) / 2)')} < l THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_digamma('((lo + hi) / 2)')} < l THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM d WHERE k < 70),
a AS (SELECT nation, lo AS a, chi2 / 2 AS x, chi2 FROM d JOIN f USING (nation) WHERE k = 70),
g(nation, a, x, term, total, k) AS (SELECT nation, a, x, 1 / a, 1 / a, 0 FROM a UNION ALL SELECT nation, a, x, term * x / (a + k + 1), total + term * x / (a + k + 1), k + 1 FROM g WHERE k < 120),
n AS (SELECT a.nation, 1 - avg(CASE WHEN s.x <= chi2 THEN 1.0::DOUBLE ELSE 0 END) AS numeric FROM a JOIN s USING (nation) GROUP BY a.nation, chi2)
SELECT nation, round(2 * a, 5) AS dof, round(numeric, 6) AS numeric, round(1 - total * exp(a * ln(x) - x - lgamma(a)), 6) AS pte FROM g JOIN n USING (nation) WHERE k = 120""")
def fitted_dof_pte(spark, sf_dir):
    """A nation's customers as simulated chi-squares: their degrees of freedom, and the chances of what its suppliers have."""
    sims = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), ((F.col("c_acctbal") / 3000) ** 2).alias("chi2"))
    found = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg((F.col("s_acctbal") / 3000) ** 2).alias("chi2"))
    both = averages.numeric_pte(found, sims, ["nation"], "chi2").join(averages.fitted_dof(sims, ["nation"], "chi2"), "nation")
    return averages.with_survival(both, "chi2", "dof").select("nation", r("dof", 5).alias("dof"), r("numeric", 6).alias("numeric"), r("pte", 6).alias("pte"))


@query()
def covariance_average(spark, sf_dir):
    """Labels as pairs, their vectors as noise runs of 64 bins, in blocks of four; the spectrum of a label is its first vector."""
    rows = read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    long = spectra.long_matrix(rows, "vec_id", "embedding", ["label"]).withColumn("block", F.expr("t div 4").cast("int")).withColumn("cell", (F.col("t") % 4).cast("int"))
    inverses = averages.block_inverses(long, ["label"], "vec_id", "block", "cell", "value")
    first = long.join(rows.groupBy("label").agg(F.min("vec_id").alias("vec_id")), ["label", "vec_id"], "left_semi")
    return averages.covariance_average(first, inverses, ["label"], "block", "cell", "value")
