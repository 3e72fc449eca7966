"""Map cleaning over long cells (by, f, pixel, map, sigma): modes, what noise they are weighted with, and the coadds after.

A map is never held by one task: factors of modes are tables, and each step that improves them is a join of
the cells with one factor and a grouped sum for the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.settled import dealt, settled
from . import fields
from . import maps as map_ops

#: What momentum gains each step and at most. Fixed values.
GAIN, MOST = 0.03, 0.9
#: Powers of sigma that maps are divided by. Fixed values.
NORMS = {"weightless": 0, "sigma_wn": 1, "var": 2, "three": 3}


def seen_cells(maps: DataFrame, by: list[str], pixel: list[str], channels: int) -> DataFrame:
    """by, f (channels of all bands in order), pixel, m and w = 1 / sigma^2 of the cells that were seen."""
    ok = maps.filter(F.col("map").isNotNull() & ~F.isnan("map") & (F.col("sigma") > 0) & (F.col("sigma") < float("inf")))
    return ok.select(*by, (F.col("sb") * channels + F.col("chan")).cast("int").alias("f"), *pixel, F.col("map").alias("m"), (1 / F.col("sigma") ** 2).alias("w"))


def solved(cells: DataFrame, known: DataFrame, by: list[str], mine: list[str], theirs: list[str]) -> DataFrame:
    """Least squares of one factor, given the other: sum(m a w) / sum(a^2 w) of each element, 0 where nothing weighs."""
    both = cells.join(known.select(*by, *theirs, F.col("now").alias("_a")), [*by, *theirs])
    sums = both.groupBy(*by, *mine).agg(F.sum(F.col("m") * F.col("_a") * F.col("w")).alias("_n"), F.sum(F.col("_a") ** 2 * F.col("w")).alias("_d"))
    return sums.select(*by, *mine, F.coalesce(F.col("_n") / F.nullif("_d", F.lit(0.0)), F.lit(0.0)).alias("_to"))


def _moved(factor: DataFrame, solved: DataFrame, keys: list[str]) -> DataFrame:
    """The factor one step on: each element goes on beyond its solution by its momentum, which a turn of direction resets."""
    step, was = F.col("_to") - F.col("now"), F.col("now") - F.col("before")
    momentum = F.when(step * was < 0, 0.0).otherwise(F.least(F.col("momentum") + GAIN, F.lit(MOST)))
    both = factor.join(solved, keys).withColumn("_m", momentum)
    return both.select(*keys, (F.col("_to") + F.col("_m") * step).alias("_now"), F.col("now").alias("before"), F.col("_m").alias("momentum")).withColumnRenamed("_now", "now")


def _start(values: DataFrame) -> DataFrame:
    return values.withColumn("before", F.col("now")).withColumn("momentum", F.lit(0.0))


def of_length_one(factor: DataFrame, by: list[str]) -> DataFrame:
    """factor with `now` divided by its length over the group; 0 where that is 0."""
    length = factor.groupBy(*by).agg(F.sqrt(F.sum(F.col("now") ** 2)).alias("_l"))
    return factor.join(length, by).withColumn("now", F.coalesce(F.col("now") / F.nullif("_l", F.lit(0.0)), F.lit(0.0))).drop("_l")


def weighted_mode(cells: DataFrame, by: list[str], pixel: list[str], rounds: int = 500, still: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """The rank-one fit of cells (by, f, pixel, m, w) with the least weighted squares: (by, f, now) and (by, pixel, now).

    Alternating steps from the channel sum of each pixel, scaled to length one, and channel factors of 0. A group rests when neither factor's
    elements move by `still` on average; the others go on, `rounds` at most. A step reads cells that lie by the key
    it needs, so only factors are shuffled. Each step is written out, and a lost executor costs its tasks only.
    """
    near = {"f": dealt(cells, *by, "f"), "p": dealt(cells, *by, *pixel)}
    across = settled(_start(of_length_one(cells.groupBy(*by, *pixel).agg(F.sum("m").alias("now")), by)))
    along = settled(_start(cells.select(*by, "f").distinct().withColumn("now", F.lit(0.0))))
    rested = []
    for _ in range(rounds):
        along = settled(_moved(along, solved(near["p"], across, by, ["f"], pixel), [*by, "f"]))
        across = settled(_moved(across, solved(near["f"], along, by, pixel, ["f"]), [*by, *pixel]))
        far = F.avg(F.abs(F.col("now") - F.col("before")))
        moves = along.groupBy(*by).agg(far.alias("_f")).join(across.groupBy(*by).agg(far.alias("_p")), by)
        done = settled(moves.filter((F.col("_f") < still) & (F.col("_p") < still)).select(*by))
        if done.count():
            rested.append((along.join(done, by, "left_semi"), across.join(done, by, "left_semi")))
            along, across = settled(along.join(done, by, "left_anti")), settled(across.join(done, by, "left_anti"))
            if not across.limit(1).count():
                break
    for a, b in rested:
        along, across = along.unionByName(a), across.unionByName(b)
    return along.select(*by, "f", "now"), across.select(*by, *pixel, "now")


def coarse(cells: DataFrame, by: list[str], pixel: list[str], size: int) -> DataFrame:
    """Cells of blocks of `size` channels: inverse-variance means and summed weights."""
    sums = cells.groupBy(*by, F.floor(F.col("f") / size).cast("int").alias("f"), *pixel).agg(F.sum(F.col("m") * F.col("w")).alias("_n"), F.sum("w").alias("w"))
    return sums.select(*by, "f", *pixel, (F.col("_n") / F.col("w")).alias("m"), "w")


def subtract_weighted(cells: DataFrame, by: list[str], pixel: list[str], blocks: list[int], rounds: int = 500, still: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """cells less one weighted mode after the other, and the modes: (cells, factors).

    blocks: for each mode, how many channels are averaged before its pixel factor is fitted. That factor, of
    length one, then gets its channel factor from all channels. factors: by, mode, axis (f or p), element and value.
    """
    factors = None
    for k, size in enumerate(blocks):
        fitted = settled(coarse(cells, by, pixel, size)) if size > 1 else cells
        across = settled(of_length_one(weighted_mode(fitted, by, pixel, rounds, still)[1], by))
        along = settled(solved(cells, across, by, ["f"], pixel))
        both = cells.join(across, [*by, *pixel]).join(along, [*by, "f"])
        cells = settled(both.select(*by, "f", *pixel, (F.col("m") - F.col("now") * F.col("_to")).alias("m"), "w"))
        rows = along.select(*by, F.lit(k).alias("mode"), F.lit("f").alias("axis"), F.array(F.col("f")).alias("element"), F.col("_to").alias("value"))
        rows = rows.unionByName(across.select(*by, F.lit(k).alias("mode"), F.lit("p").alias("axis"), F.array(*[F.col(c).cast("int") for c in pixel]).alias("element"), F.col("now").alias("value")))
        factors = rows if factors is None else factors.unionByName(rows)
    return cells, factors


def separable_noise(cells: DataFrame, by: list[str], pixel: list[str]) -> DataFrame:
    """cells with `smooth`, the geometric mean of a channel's noise and a pixel's, each the root of how many pixels
    (channels) there are over the sum of weights. Grids are as large as the pixels and channels that by has."""
    f = cells.groupBy(*by, "f").agg(F.sum("w").alias("_wf"))
    p = cells.groupBy(*by, *pixel).agg(F.sum("w").alias("_wp"))
    sizes = f.groupBy(*by).agg(F.count("*").alias("_nf")).join(p.groupBy(*by).agg(F.count("*").alias("_np")), by)
    both = cells.join(f, [*by, "f"]).join(p, [*by, *pixel]).join(sizes, by)
    smooth = F.sqrt(F.sqrt(F.col("_np") / F.col("_wf")) * F.sqrt(F.col("_nf") / F.col("_wp")))
    return both.withColumn("smooth", smooth).drop("_wf", "_wp", "_nf", "_np")


def without_line_mean(cells: DataFrame, by: list[str], pixel: list[str], value: str) -> DataFrame:
    """value less its mean over the channels of its pixel."""
    mean = cells.groupBy(*by, *pixel).agg(F.avg(value).alias("_mean"))
    return cells.join(mean, [*by, *pixel]).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def channel_modes(cells: DataFrame, by: list[str], pixel: list[str], value: str, modes: int, slots: int = 32) -> DataFrame:
    """by, mode, f, part and singular of the leading right singular vectors of each group's pixels x channels matrix of value, absent cells 0.

    Products of channels are summed over the pixels of a partition, then over `slots`, then over all. A
    mode's sign is that of its largest part.
    """
    names = ", ".join(f"{b} {cells.schema[b].dataType.simpleString()}" for b in by)
    lines = cells.groupBy(*by, *pixel).agg(F.collect_list(F.struct("f", F.col(value).alias("x"))).alias("line"))
    top = cells.groupBy(*by).agg((F.max("f") + 1).alias("_n"))
    lines = lines.join(top, by)

    def products(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(by):
                m = np.zeros((len(part), int(part["_n"].iloc[0])))
                for row, line in zip(m, part["line"]):
                    row[[c["f"] for c in line]] = [c["x"] for c in line]
                sums[key] = sums.get(key, 0) + m.T @ m
        for key, gram in sums.items():
            yield pd.DataFrame({**{b: [k] for b, k in zip(by, key)}, "slot": [TaskContext.get().partitionId() % slots], "gram": [gram.ravel()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{b: [group[b].iloc[0]] for b in by}, "gram": [np.sum([np.asarray(g) for g in group["gram"]], axis=0)]})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        gram = np.sum([np.asarray(g) for g in group["gram"]], axis=0)
        n = int(np.sqrt(len(gram)))
        values, turn = np.linalg.eigh(gram.reshape(n, n))
        values, turn = np.sqrt(np.maximum(values[::-1][:modes], 0)), turn[:, ::-1][:, :modes]
        turn = turn * np.sign(turn[np.argmax(np.abs(turn), axis=0), np.arange(turn.shape[1])])
        k, f = (x.ravel() for x in np.meshgrid(np.arange(turn.shape[1]), np.arange(n), indexing="ij"))
        return pd.DataFrame({**{b: group[b].iloc[0] for b in by}, "mode": k, "f": f, "part": turn[f, k], "singular": values[k]})

    grams = lines.select(*by, "_n", "line").mapInPandas(products, f"{names}, slot int, gram array<double>")
    grams = grams.groupBy(*by, "slot").applyInPandas(added, f"{names}, gram array<double>")
    return grams.groupBy(*by).applyInPandas(solve, f"{names}, mode int, f int, part double, singular double")


def subtract_normalised(cells: DataFrame, by: list[str], pixel: list[str], modes: int, norm: str = "sigma_wn", separable: bool = False, line_mean: bool = False) -> DataFrame:
    """cells less the leading singular modes of m / noise^power (NORMS), where noise is sigma or its separable form.

    line_mean takes each pixel's mean over channels out before modes are sought; it stays in the map. `mode` is what
    was subtracted.
    """
    noise = F.col("smooth") if separable else 1 / F.sqrt("w")
    rows = separable_noise(cells, by, pixel) if separable else cells
    scale = noise ** NORMS[norm] if NORMS[norm] else F.lit(1.0)
    rows = rows.withColumn("_scale", scale).withColumn("_x", F.col("m") / F.col("_scale"))
    rows = settled(without_line_mean(rows, by, pixel, "_x") if line_mean else rows)
    vectors = settled(channel_modes(rows, by, pixel, "_x", modes).select(*by, "mode", "f", "part"))
    size = rows.join(vectors, [*by, "f"]).groupBy(*by, *pixel, "mode").agg(F.sum(F.col("_x") * F.col("part")).alias("_size"))
    model = vectors.join(size, [*by, "mode"]).groupBy(*by, "f", *pixel).agg(F.sum(F.col("part") * F.col("_size")).alias("_model"))
    both = rows.join(model, [*by, "f", *pixel]).withColumn("mode", F.col("_model") * F.col("_scale"))
    return both.select(*by, "f", *pixel, (F.col("m") - F.col("mode")).alias("m"), "w", "mode")


def as_maps(cells: DataFrame, channels: int, value: str = "m") -> DataFrame:
    """cells as maps again: sb, chan, map and sigma for by, f, m and w."""
    rest = [c for c in cells.columns if c not in ("f", "m", "w", "mode")]
    return cells.select(*rest, F.expr(f"f div {channels}").cast("int").alias("sb"), (F.col("f") % channels).cast("int").alias("chan"), F.col(value).alias("map"), (1 / F.sqrt("w")).alias("sigma"))


def quiet(maps: DataFrame, lowest: int, factor: float) -> DataFrame:
    """maps without the pixels of a detector whose noise over all channels exceeds `factor` times the mean of its `lowest` ones."""
    keys = ["feed", "dec_i", "ra_i"]
    whole = maps.groupBy(*keys).agg((1 / F.sqrt(F.sum(1 / F.col("sigma") ** 2))).alias("sigma")).withColumn("sb", F.lit(0)).withColumn("chan", F.lit(0))
    return maps.join(map_ops.noise_mask(whole, lowest, factor).filter("keep").select(*keys), keys, "left_semi")


def clean_maps(maps: DataFrame, channels: int, modes: int, norm: str = "exper", blocks: list[int] | None = None, separable: bool = False, line_mean: bool = False, noise_limit: tuple[int, float] | None = None, highpass: tuple[float, int, int] | None = None, rounds: int = 500) -> DataFrame:
    """Detector maps (feed, dec_i, ra_i, sb, chan, map, sigma) cleaned of modes, and their coadds, by level as `maps.coadd_levels` has them.

    norm: exper for weighted modes (blocks: channels averaged for each), else one of NORMS. noise_limit: how
    many lowest pixels, and the factor, of `quiet`. highpass: reach, rows and columns of `fields.highpass_maps`.
    Unseen cells take no part. All levels come from one grouping-sets pass over the cleaned cells.
    """
    by, pixel = ["feed"], ["dec_i", "ra_i"]
    if noise_limit:
        maps = quiet(maps, *noise_limit)
    cells = settled(seen_cells(maps, by, pixel, channels))
    if norm == "exper":
        cells = subtract_weighted(cells, by, pixel, blocks or [1] * modes, rounds)[0]
    else:
        cells = subtract_normalised(cells, by, pixel, modes, norm, separable, line_mean)
    out = as_maps(cells, channels)
    if highpass:
        out = fields.highpass_maps(out, ["feed", "sb", "chan"], *highpass).withColumn("map", F.col("cleaned")).drop("cleaned")
    w = 1 / F.col("sigma") ** 2
    return map_ops.coadd_levels(out.withColumn("num", F.col("map") * w).withColumn("den", w).withColumn("nhit", F.lit(1))).drop("num", "den", "nhit")
