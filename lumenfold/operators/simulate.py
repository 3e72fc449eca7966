"""Signal simulation: halo luminosities, line temperatures, cubes and their sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double_power_luminosity(mass: Column, a: float, b: float, c: float, pivot: float) -> Column:
    """L = c / ((m / pivot)^a + (m / pivot)^b)."""
    x = mass / F.lit(pivot)
    return F.lit(c) / (F.pow(x, F.lit(a)) + F.pow(x, F.lit(b)))


def histogram_cube(halos: DataFrame, axes: dict[str, tuple[float, float, int]], weight: str) -> DataFrame:
    """Weighted counts on a regular grid; what lies outside is left out, the last edge is closed."""
    cells = halos
    for name, (lo, hi, n) in axes.items():
        at = F.when(F.col(name) == hi, F.lit(n - 1)).otherwise(F.floor((F.col(name) - lo) / (hi - lo) * n))
        cells = cells.withColumn(f"{name}_i", at.cast("int")).filter(F.col(f"{name}_i").between(0, n - 1))
    return cells.groupBy(*[f"{n}_i" for n in axes]).agg(F.sum(weight).alias("total"), F.count("*").alias("halos"))


def sample_bilinear(points: DataFrame, cube: DataFrame, x: str, y: str, value: str, key: str) -> DataFrame:
    """Bilinear samples of a gridded plane (xi, yi, value) at points in pixel units.

    Each point asks for its four neighbours by an equi-join; points that miss one are left out.
    """
    corner = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (0, 1) for j in (0, 1)])
    asked = points.select(key, x, y, F.explode(corner).alias("c")).select(
        key, (F.floor(x) + F.col("c.di")).cast("int").alias("xi"), (F.floor(y) + F.col("c.dj")).cast("int").alias("yi"),
        (F.when(F.col("c.di") == 1, F.col(x) - F.floor(x)).otherwise(1 - F.col(x) + F.floor(x)) * F.when(F.col("c.dj") == 1, F.col(y) - F.floor(y)).otherwise(1 - F.col(y) + F.floor(y))).alias("share"),
    )
    got = asked.join(cube, ["xi", "yi"]).groupBy(key).agg(F.sum(F.col("share") * F.col(value)).alias(value), F.count("*").alias("corners"))
    return got.filter("corners = 4").drop("corners")
