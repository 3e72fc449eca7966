"""Tabulated functions: bicubic and cubic splines as tables of coefficients, joined to points by interval; model spectra from their angles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spline_operator(knots: list[float], ends: str = "smooth") -> np.ndarray:
    """intervals x 4 x knots: what each knot's value adds to the powers 0 to 3 of (x - knot) on each interval.

    ends: smooth has the third derivative go through the second knot and the last but one, natural has no curvature at the
    ends. Two knots make a line, three (smooth) a parabola.
    """
    x = np.asarray(knots, dtype=float)
    n = len(x)
    h = np.diff(x)
    rows, right = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        rows[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    if n < 3 or ends == "natural":
        rows[0, 0] = rows[-1, -1] = 1
    elif n == 3:
        rows[0, :2] = rows[2, 1:] = 1, -1
    else:
        rows[0, :3] = h[1], -h[0] - h[1], h[0]
        rows[-1, -3:] = h[-1], -h[-2] - h[-1], h[-2]
    bend = np.linalg.solve(rows, right)
    value = np.eye(n)
    out = np.zeros((n - 1, 4, n))
    for i in range(n - 1):
        out[i] = value[i], (value[i + 1] - value[i]) / h[i] - h[i] * (2 * bend[i] + bend[i + 1]) / 6, bend[i] / 2, (bend[i + 1] - bend[i]) / 6 / h[i]
    return out


def product_of_tables(tables: DataFrame, name: str, x: str, y: str, value: str) -> DataFrame:
    """x, y and value of the product of all tables, on the grid points that all of them have."""
    count = tables.select(F.count_distinct(name).alias("_all"))
    rows = tables.groupBy(x, y).agg(F.product(value).alias(value), F.count_distinct(name).alias("_n"))
    return rows.crossJoin(F.broadcast(count)).filter("_n = _all").drop("_n", "_all")


def _operator_table(spark, knots: list[float], index: str, power: str, part: str) -> DataFrame:
    op = spline_operator(knots)
    rows = [(i, a, float(knots[k]), float(op[i, a, k])) for i, a, k in zip(*np.nonzero(op))]
    return spark.createDataFrame([(int(i), int(a), k, v) for i, a, k, v in rows], f"{index} int, {power} int, _knot double, {part} double")


def grid_axes(table: DataFrame, x: str, y: str) -> tuple[list[float], list[float]]:
    """The knots of a tabulated function's two axes, in order; as many numbers as the grid's sides reach the driver."""
    return tuple(sorted(float(r[0]) for r in table.select(c).distinct().collect()) for c in (x, y))


def bicubic_coefficients(table: DataFrame, x: str, y: str, value: str, axes: tuple[list[float], list[float]]) -> DataFrame:
    """i, j and an array of 16 coefficients: of (x - x_i)^a (y - y_j)^b at 4 a + b. The table must have every pair of knots.

    The product of a spline in x with one in y: two joins with the axes' operators, summed one axis at a time.
    """
    spark = table.sparkSession
    z = table.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(value).cast("double").alias("_z"))
    ox, oy = _operator_table(spark, axes[0], "i", "a", "_dx"), _operator_table(spark, axes[1], "j", "b", "_dy")
    half = z.join(ox.withColumnRenamed("_knot", "_x"), "_x").groupBy("i", "a", "_y").agg(F.sum(F.col("_z") * F.col("_dx")).alias("_z"))
    whole = half.join(oy.withColumnRenamed("_knot", "_y"), "_y").groupBy("i", "j", "a", "b").agg(F.sum(F.col("_z") * F.col("_dy")).alias("c"))
    sums = [F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("c")).otherwise(0.0)) for a in range(4) for b in range(4)]
    return whole.groupBy("i", "j").agg(F.array(*sums).alias("coefficients"))


def _interval(value: Column, knots: list[float]) -> Column:
    inner = F.filter(F.array(*[F.lit(float(k)) for k in knots[1:-1]]), lambda k: k <= value) if len(knots) > 2 else F.array()
    return F.size(inner)


def _offset(value: Column, at: Column, knots: list[float]) -> Column:
    return value - F.element_at(F.array(*[F.lit(float(k)) for k in knots[:-1]]), at + 1)


def evaluate_bicubic(points: DataFrame, x: str, y: str, coefficients: DataFrame, axes: tuple[list[float], list[float]], name: str = "transfer") -> DataFrame:
    """points with the spline's value at (x, y); beyond the grid, its value at the edge. One equi-join on the cell of the grid."""
    inside = [F.least(F.greatest(F.col(c).cast("double"), F.lit(float(k[0]))), F.lit(float(k[-1]))) for c, k in zip((x, y), axes)]
    placed = points.withColumn("_px", inside[0]).withColumn("_py", inside[1])
    placed = placed.withColumn("i", _interval(F.col("_px"), axes[0])).withColumn("j", _interval(F.col("_py"), axes[1]))
    dx, dy = _offset(F.col("_px"), F.col("i"), axes[0]), _offset(F.col("_py"), F.col("j"), axes[1])

    def along(a: int) -> Column:
        c = [F.element_at("coefficients", 4 * a + b + 1) for b in range(4)]
        return c[0] + dy * (c[1] + dy * (c[2] + dy * c[3]))

    total = along(0) + dx * (along(1) + dx * (along(2) + dx * along(3)))
    return placed.join(coefficients, ["i", "j"]).withColumn(name, total).drop("i", "j", "_px", "_py", "coefficients")


def transfer_at(points: DataFrame, x: str, y: str, tables: DataFrame, table: str, kx: str, ky: str, value: str, name: str = "transfer") -> DataFrame:
    """points with the product of tabulated transfer functions (table, kx, ky, value) at each, by a bicubic spline."""
    product = product_of_tables(tables, table, kx, ky, value)
    axes = grid_axes(product, kx, ky)
    return evaluate_bicubic(points, x, y, bicubic_coefficients(product, kx, ky, value, axes), axes, name)


def angle_mean(rows: DataFrame, by: list[str], mu: str, value: str, name: str = "power") -> DataFrame:
    """The integral of value over mu by trapezoids, of each group."""
    w = Window.partitionBy(*by).orderBy(mu)
    area = (F.lead(value).over(w) + F.col(value)) / 2 * (F.lead(mu).over(w) - F.col(mu))
    return rows.withColumn("_area", area).groupBy(*by).agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias(name))


def spline_intervals(models: DataFrame, model: str, k: str, value: str, ends: str = "smooth") -> DataFrame:
    """The cubic spline through each model's points: model, k0, k1, c0, c1, c2 and c3, of powers of (k - k0), for each interval.

    Curvatures solve a tridiagonal system; each model's is swept through its own array of knots, forward and back. k must be
    distinct within a model. ends: smooth has the third derivative go through the outer but one knots (from four
    knots on; fewer are natural), natural has no curvature at the ends. Models of one point have no interval.
    """
    w = Window.partitionBy(model).orderBy("k")
    rows = models.select(model, F.col(k).cast("double").alias("k"), F.col(value).cast("double").alias("y"))
    rows = rows.withColumns({"at": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(model)), "h": F.lead("k").over(w) - F.col("k"), "slope": (F.lead("y").over(w) - F.col("y")) / (F.lead("k").over(w) - F.col("k"))})
    rows = rows.withColumns({"h0": F.lag("h").over(w), "s0": F.lag("slope").over(w)}).withColumns({"h00": F.lag("h0").over(w), "hh": F.lead("h").over(w)})
    smooth = (F.col("n") > 3) & F.lit(ends == "smooth")
    first, last = smooth & (F.col("at") == 1), smooth & (F.col("at") == F.col("n") - 2)
    h0, h = F.col("h0"), F.col("h")
    # the outer curvatures follow from the two beside them, which is put into the outer rows of the system
    low = h0 - F.when(last, h * h / h0).otherwise(0.0)
    up = h - F.when(first, h0 * h0 / h).otherwise(0.0)
    mid = 2 * (h0 + h) + F.when(first, h0 + h0 * h0 / h).otherwise(0.0) + F.when(last, h + h * h / h0).otherwise(0.0)
    inner = rows.filter((F.col("at") > 0) & (F.col("at") < F.col("n") - 1)).select(model, F.struct("at", low.alias("low"), mid.alias("mid"), up.alias("up"), (6 * (F.col("slope") - F.col("s0"))).alias("right")).alias("row"))

    def forward(acc: Column, row: Column) -> Column:
        before = F.try_element_at(acc, F.lit(-1))
        under = row["mid"] - F.coalesce(row["low"] * before["c"], F.lit(0.0))
        return F.concat(acc, F.array(F.struct((row["up"] / under).alias("c"), ((row["right"] - F.coalesce(row["low"] * before["d"], F.lit(0.0))) / under).alias("d"), row["at"].alias("at"))))

    def back(acc: Column, row: Column) -> Column:
        after = F.coalesce(F.try_element_at(acc, F.lit(-1))["bend"], F.lit(0.0))
        return F.concat(acc, F.array(F.struct(row["at"].alias("at"), (row["d"] - row["c"] * after).alias("bend"))))

    swept = F.aggregate(F.array_sort(F.col("rows")), F.array().cast("array<struct<c:double,d:double,at:int>>"), forward)
    bends = F.aggregate(F.reverse(swept), F.array().cast("array<struct<at:int,bend:double>>"), back)
    known = inner.groupBy(model).agg(F.collect_list("row").alias("rows")).select(model, F.explode(bends).alias("_b")).select(model, "_b.at", "_b.bend")
    both = rows.select(model, "at", "n", "k", "y", "h", "h0", "h00", "hh", "slope").join(known, [model, "at"], "left")
    near = lambda c, step: F.lag(c, step).over(w) if step > 0 else F.lead(c, -step).over(w)
    # outer curvatures: on the line through the two beside them, or none
    left = near("bend", -1) - (near("bend", -2) - near("bend", -1)) * h / F.col("hh")
    right = near("bend", 1) + (near("bend", 1) - near("bend", 2)) * h0 / F.col("h00")
    bend = F.coalesce("bend", F.when(smooth & (F.col("at") == 0), left).when(smooth & (F.col("at") == F.col("n") - 1), right), F.lit(0.0))
    both = both.withColumn("_m", bend).withColumn("_m1", F.lead("_m").over(w)).withColumn("k1", F.lead("k").over(w)).filter("k1 is not null")
    return both.select(model, F.col("k").alias("k0"), "k1", F.col("y").alias("c0"), (F.col("slope") - h * (2 * F.col("_m") + F.col("_m1")) / 6).alias("c1"), (F.col("_m") / 2).alias("c2"), ((F.col("_m1") - F.col("_m")) / 6 / h).alias("c3"))


def evaluate_splines(points: DataFrame, model: str, k: str, intervals: DataFrame, cell: float, name: str = "power") -> DataFrame:
    """points (model, k) with their model's value; null beyond its knots. Intervals are dealt into cells of k, so that one equi-join finds them."""
    dealt = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("k0") / cell), F.floor(F.col("k1") / cell))))
    ends = Window.partitionBy(model)
    dealt = dealt.withColumn("_last", F.col("k1") == F.max("k1").over(ends))
    p, q = points.withColumn("_id", F.struct(*points.columns)).withColumn("_cell", F.floor(F.col(k) / cell)).alias("p"), dealt.alias("q")
    within = (F.col(f"p.{k}") >= F.col("q.k0")) & ((F.col(f"p.{k}") < F.col("q.k1")) | (F.col("q._last") & (F.col(f"p.{k}") == F.col("q.k1"))))
    both = p.join(q, (F.col(f"p.{model}") == F.col(f"q.{model}")) & (F.col("p._cell") == F.col("q._cell")) & within, "left")
    d = F.col(f"p.{k}") - F.col("q.k0")
    return both.select(*[F.col(f"p.{c}") for c in points.columns], (F.col("q.c0") + d * (F.col("q.c1") + d * (F.col("q.c2") + d * F.col("q.c3")))).alias(name))


def beam_profile_transfer(profile: DataFrame, r: str, value: str, k: DataFrame, mpc_per_degree: float, step: float = 1e-3, reach: float = 1.0, core: float = 6.4 / 60, share: float = 0.72) -> DataFrame:
    """Power that a round beam leaves at each k (1/Mpc) across the sky: k and transfer.

    profile: the beam by radius in degrees. It is laid on a grid of `step` degrees up to `reach`, scaled so that `share` of its power lies
    within `core`, summed along one axis, and transformed along the other; each is a grouped sum over grid cells.
    """
    spark = profile.sparkSession
    n = int(round(reach / step))
    axis = spark.range(-n, n).select(F.col("id").alias("i"))
    cells = axis.select("i", F.explode(F.sequence(F.lit(-n), F.lit(n - 1))).alias("j")).withColumn("radius", F.sqrt(F.col("i") ** 2 + F.col("j") ** 2) * step)
    cells = cells.filter(F.col("radius") <= reach).withColumn("_one", F.lit(1))
    curve = spline_intervals(profile.select(F.lit(1).alias("_one"), r, value), "_one", r, value)
    laid = evaluate_splines(cells, "_one", "radius", curve, reach / 64, "b")
    lines = laid.groupBy("i").agg(F.sum("b").alias("line"), F.sum(F.when(F.col("radius") <= core, F.col("b"))).alias("inner"))
    scale = lines.agg((F.lit(share) / F.sum("inner")).alias("scale"))
    lines = lines.crossJoin(F.broadcast(scale)).select("i", (F.col("line") * F.col("scale")).alias("line"))
    waves = k.select("k").distinct().withColumn("i", F.explode(F.sequence(F.lit(-n), F.lit(n - 1)))).join(lines, "i").withColumn("_phase", F.col("k") * F.col("i") * step * mpc_per_degree)
    sums = waves.groupBy("k").agg(F.sum(F.col("line") * F.cos("_phase")).alias("_re"), F.sum(F.col("line") * F.sin("_phase")).alias("_im"))
    return sums.select("k", (F.col("_re") ** 2 + F.col("_im") ** 2).alias("transfer"))
