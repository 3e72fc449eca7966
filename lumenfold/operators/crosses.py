"""Cross spectra over pairs of fields, splits and detectors, with a bank of noise runs that spreads over tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["field", "split", "feed"]
SIDES = [f"{c}{side}" for side in (1, 2) for c in KEY]


def map_pairs(maps: DataFrame, splits: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """The pairs of maps to cross: pair (a hash of the six names), field1, split1, feed1, field2, split2, feed2.

    maps: field, split, feed, repeats allowed; splits: split1, split2; fields: field1, field2, or each field with itself. Detectors
    meet detectors in both orders, but for a split of a field with itself each pair stands once (feed1 <= feed2).
    Maps that aren't there have no pairs.
    """
    there = maps.select(*KEY).distinct()
    first, second = (there.toDF(*[f"{c}{side}" for c in KEY]) for side in (1, 2))
    if fields is None:
        fields = there.select(F.col("field").alias("field1"), F.col("field").alias("field2")).distinct()
    rows = fields.join(first, "field1").join(splits, "split1").join(second, ["field2", "split2"])
    same = (F.col("field1") == F.col("field2")) & (F.col("split1") == F.col("split2"))
    rows = rows.filter(~same | (F.col("feed1") <= F.col("feed2"))).select(*SIDES).distinct()
    return rows.select(F.xxhash64(*SIDES).alias("pair"), *SIDES)


def noise_seeds(pairs: DataFrame, runs: int, seed: int) -> DataFrame:
    """pair, run, side and seed of every noise map: seed * (run + 1) * side + feed, times the number of a pair's maps.

    Where that number stands twice in a pair, as it does for a detector with itself, the later of them counts on; the factor
    leaves room for it, so no two maps of a pair share a seed.
    """
    sides = pairs.select("pair", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"feed{k}").cast("long").alias("feed")) for k in (1, 2)])).alias("s"))
    rows = sides.select("pair", "s.*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = rows.withColumn("_base", seed * (F.col("run") + 1) * F.col("side") + F.col("feed"))
    again = F.row_number().over(Window.partitionBy("pair", "_base").orderBy("run", "side")) - 1
    return rows.select("pair", "run", "side", (F.col("_base") * (2 * runs) + again).alias("seed"))


def _bins(shape, steps, across, along):
    if along is None:  # spheres: bins of |k| without k = 0
        k = np.sqrt(sum(np.meshgrid(*[(2 * np.pi * np.fft.fftfreq(n, d)) ** 2 for n, d in zip(shape, steps)], indexing="ij"))).ravel()
        edges = [np.asarray(across), np.array([-1.0, 1.0])]
        first = np.where(k > 0, k, edges[0][0] - 1)
        return first, np.zeros_like(k), edges, np.histogram2d(first, np.zeros_like(k), edges)[0]
    kx, ky, kz = (2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(shape, steps))
    k_across = np.sqrt(kx[:, None, None] ** 2 + ky[None, :, None] ** 2 + 0 * kz).ravel()
    k_along = np.abs(0 * kx[:, None, None] + 0 * ky[None, :, None] + kz).ravel()
    edges = [np.asarray(across), np.asarray(along)]
    return k_across, k_along, edges, np.histogram2d(k_across, k_along, edges)[0]


def _weights(s1: np.ndarray, s2: np.ndarray, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both maps of a pair: 1 / sigma^2 over the root mean product, 0 where that is below 10^-1/2, of root mean square one."""
    w1, w2 = (np.divide(1, s * s, out=np.zeros_like(s), where=s > 0) for s in (s1, s2))
    norm = np.sqrt(np.mean(w1 * w2))
    if not norm:
        return np.zeros_like(w1), np.zeros_like(w1)
    w1, w2 = (np.where(w / norm < 10**-0.5, 0, w / norm) for w in (w1, w2))
    if symmetric:
        w1 = w2 = np.sqrt(w1 * w2)
    return tuple(np.divide(w, size := np.sqrt(np.mean(w * w)), out=np.zeros_like(w), where=size > 0) for w in (w1, w2))


def pair_spectra(maps: DataFrame, pairs: DataFrame, shape: tuple[int, int, int], steps: tuple[float, float, float], across: list[float], along: list[float] | None, runs: int = 0, seed: int = 1, runs_a_task: int = 8, symmetric: bool = True) -> DataFrame:
    """Pseudo cross spectra of pairs and of their noise runs: pair, run (-1 for the data), across, along, power and modes.

    Without `along`, across are spheres of |k|, k = 0 left out. maps: field, split, feed, x, y, z, map, sigma; pairs: of `map_pairs`. Both sides of a pair are joined to the cells
    of their map, so a map is read for the pairs it has and no cell meets another map's. A noise run is a normal map of
    each side's sigma under its own seed (`noise_seeds`); runs of a pair are dealt to tasks `runs_a_task` at a time, so
    results don't depend on how they lie. Pairs without common cells have powers of 0.
    """
    cells = maps.filter(F.col("map").isNotNull() & (F.col("sigma") > 0)).select(*KEY, "x", "y", "z", "map", "sigma")
    blocks = F.array(F.lit(-1), *[F.lit(b) for b in range(0, runs, runs_a_task)])

    def side(k: int) -> DataFrame:
        mine = pairs.select("pair", *[F.col(f"{c}{k}").alias(c) for c in KEY])
        return cells.join(mine, KEY).select("pair", "x", "y", "z", "map", "sigma", F.explode(blocks).alias("block"))

    seeds = noise_seeds(pairs, runs, seed) if runs else None
    volume, count = float(np.prod(steps)), int(np.prod(shape))
    k_across, k_along, edges, modes = _bins(shape, steps, across, along)
    i, j = np.nonzero(modes)
    both = side(1).withColumn("side", F.lit(1)).unionByName(side(2).withColumn("side", F.lit(2))).withColumn("seed", F.lit(None).cast("long"))
    if seeds is not None:
        # a run's seeds travel with its block as rows without a cell
        told = seeds.select("pair", F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.col("run").alias("z"), F.lit(0.0).alias("map"), F.lit(0.0).alias("sigma"), (F.col("run") - F.col("run") % runs_a_task).alias("block"), "side", "seed")
        both = both.unionByName(told.select(*both.columns))

    def power(a, b):
        p = np.real(np.fft.fftn(a) * np.conj(np.fft.fftn(b))).ravel() * volume / count
        return np.divide(np.histogram2d(k_across, k_along, edges, weights=p)[0], modes, out=np.zeros_like(modes), where=modes > 0)[i, j]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seen = group[group["x"] >= 0]
        m, s = np.zeros((2, *shape)), np.zeros((2, *shape))
        at = (seen["side"].to_numpy() - 1, *(seen[c].to_numpy() for c in "xyz"))
        m[at], s[at] = seen["map"], seen["sigma"]
        w = _weights(*s, symmetric)
        pair, block = int(group["pair"].iloc[0]), int(group["block"].iloc[0])
        out = {-1: power(m[0] * w[0], m[1] * w[1])} if block < 0 else {}
        for n, told in group[group["x"] < 0].groupby("z"):
            by_side = dict(zip(told["side"], told["seed"]))
            noise = [np.random.default_rng(abs(int(by_side[k]))).normal(size=shape) * s[k - 1] * w[k - 1] for k in (1, 2)]
            out[int(n)] = power(*noise)
        return pd.DataFrame({"pair": pair, "run": np.repeat(list(out), len(i)), "across": np.tile(i, len(out)), "along": np.tile(j, len(out)), "power": np.concatenate([*out.values(), []]), "modes": np.tile(modes[i, j].astype(int), len(out))})

    return both.groupBy("pair", "block").applyInPandas(run, "pair long, run int, across int, along int, power double, modes long")


def pair_overlaps(maps: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, iou and overlap: shares of cells that both maps see, and overlaps of 1 / sigma, per channel and then averaged."""
    cells = maps.filter(F.col("sigma") > 0).select(*KEY, "x", "y", "z", (1 / F.col("sigma")).alias("w"))
    one, two = (cells.join(pairs.select("pair", *[F.col(f"{c}{k}").alias(c) for c in KEY]), KEY).select("pair", "x", "y", "z", F.col("w").alias(f"w{k}")) for k in (1, 2))
    both = one.join(two, ["pair", "x", "y", "z"], "full")
    channel = both.groupBy("pair", "z").agg(
        (F.count_if(F.col("w1").isNotNull() & F.col("w2").isNotNull()) / F.count("*")).alias("iou"),
        F.nullif(F.sum(F.col("w1") * F.col("w2")) / F.sqrt(F.sum(F.col("w1") ** 2) * F.sum(F.col("w2") ** 2)), F.lit(0.0)).alias("overlap"),
    )
    return channel.groupBy("pair").agg(F.avg("iou").alias("iou"), F.avg("overlap").alias("overlap"))


def with_noise(spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `pair_spectra`: the data's spectra with sigma, the sample standard deviation over runs, and the runs."""
    runs = spectra.filter("run >= 0")
    sigma = runs.groupBy("pair", "across", "along").agg(F.stddev_samp("power").alias("sigma"), F.avg("power").alias("noise_mean"))
    return spectra.filter("run < 0").drop("run").join(sigma, ["pair", "across", "along"], "left"), runs
