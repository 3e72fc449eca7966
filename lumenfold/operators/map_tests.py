"""Noise tests of scans' small maps at every level of stacking: spectra of the map and of noise runs as rows, and their chi-squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maps import stack_levels

UNIT = ["obsid", "scan", "feed", "sb"]
#: What each level of `maps.stack_levels` is called; level 0 is tested along and across the line of sight too.
NAMES = {0: "ps_s_sb", 1: "ps_s_feed", 3: "ps_s", 4: "ps_o_sb", 5: "ps_o_feed", 7: "ps_o"}
ONE_BAND = {"xyz": "ps_s_sb", "z": "ps_z_s_sb", "xy": "ps_xy_s_sb"}
#: Edges of k in three dimensions and across the sky, 1/Mpc. Fixed values.
EDGES = {"xyz": tuple(np.logspace(-1.8, np.log10(0.5), 10)), "xy": tuple(np.logspace(-1.45, -1.0, 10))}
#: So many bins a test must have; fewer give null.
FEWEST = {"xyz": 5, "xy": 2, "z": 1}


def _powers(cube: np.ndarray, steps: tuple[float, float, float], kinds: tuple[str, ...]) -> dict[str, np.ndarray]:
    out = {}
    if "xyz" in kinds:
        k = np.sqrt(sum(np.meshgrid(*[(2 * np.pi * np.fft.fftfreq(n, d)) ** 2 for n, d in zip(cube.shape, steps)], indexing="ij")))
        out["xyz"] = _mean_in_bins(k, np.abs(np.fft.fftn(cube)) ** 2 * np.prod(steps) / cube.size, EDGES["xyz"])
    if "z" in kinds:
        out["z"] = (np.abs(np.fft.rfft(cube, axis=2)) ** 2 * steps[2] / cube.shape[2]).mean(axis=(0, 1))[1:]
    if "xy" in kinds:
        k = np.sqrt(sum(np.meshgrid(*[(2 * np.pi * np.fft.fftfreq(n, d)) ** 2 for n, d in zip(cube.shape[:2], steps)], indexing="ij")))
        flat = (np.abs(np.fft.fftn(cube, axes=(0, 1))) ** 2 * steps[0] * steps[1] / k.size).mean(axis=2)
        out["xy"] = _mean_in_bins(k, flat, EDGES["xy"])
    return out


def _mean_in_bins(k: np.ndarray, p: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    ok = k > 0
    count, total = np.histogram(k[ok], edges)[0], np.histogram(k[ok], edges, weights=p[ok])[0]
    return np.divide(total, count, out=np.zeros(len(count)), where=count > 0)


def stacked_cells(maps: DataFrame, channels: int) -> DataFrame:
    """Cells of every stack of scans' maps (obsid, scan, feed, sb, x, y, chan, map, sigma): level, the unit's names, x, y, z, map, sigma.

    Channels of all bands lie behind one another along z, so that stacks over bands keep them apart. One
    grouping-sets pass; only cells that were seen are rows.
    """
    z = (F.col("sb") * channels + F.col("chan")).cast("int").alias("z")
    return stack_levels(maps.select(*UNIT, "x", "y", z, "map", "sigma"), ["x", "y", "z"])


def stack_spectra(cells: DataFrame, channels: int, bands: int, steps: tuple[float, float, float], runs: int = 100, seed: int = 1, runs_a_task: int = 25) -> DataFrame:
    """Spectra of weighted stacks and of noise of their sigma: level, unit, kind, run (-1: the map), bin and power.

    cells: of `stacked_cells`. A unit's box spans its cells on the sky and its band's channels, or all bands'. Weights are 1 / sigma^2. Noise is
    seeded by (seed, unit, run), so it doesn't depend on how runs are dealt to tasks, `runs_a_task` at a time.
    """
    keys = ["level", *UNIT]
    starts = F.array(F.lit(-1), *[F.lit(b) for b in range(0, runs, runs_a_task)])
    dealt = cells.filter(F.col("map").isNotNull() & (F.col("sigma") > 0)).select(*keys, "x", "y", "z", "map", "sigma", F.xxhash64(*keys).alias("unit"), F.explode(starts).alias("start"))
    names = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = {c: group[c].iloc[0] for c in (*keys, "unit", "start")}
        one = not pd.isna(first["sb"])
        depth = channels if one else channels * bands
        x, y, z = group["x"] - group["x"].min(), group["y"] - group["y"].min(), group["z"] - (int(first["sb"]) * channels if one else 0)
        m, s = np.zeros((2, x.max() + 1, y.max() + 1, depth))
        m[x, y, z], s[x, y, z] = group["map"], group["sigma"]
        w = np.divide(1, s * s, out=np.zeros_like(s), where=s > 0)
        kinds = ("xyz", "z", "xy") if first["level"] == 0 else ("xyz",)
        start, rows = int(first["start"]), []
        for n in [-1] if start < 0 else range(start, min(start + runs_a_task, runs)):
            noise = m if n < 0 else np.random.default_rng([seed, int(first["unit"]) & (1 << 63) - 1, n]).normal(size=s.shape) * s
            for kind, p in _powers(w * noise, steps, kinds).items():
                rows.append(pd.DataFrame({"kind": kind, "run": n, "bin": np.arange(len(p)), "power": p}))
        out = pd.concat(rows)
        for c in reversed(keys):
            out.insert(0, c, [first[c]] * len(out))
        return out

    return dealt.groupBy(*keys, "unit", "start").applyInPandas(run, f"{names}, kind string, run int, bin int, power double")


def stack_chi2(spectra: DataFrame, transfer: DataFrame | None = None) -> DataFrame:
    """Signed chi-squares of `stack_spectra`, as one long table: obsid, scan, feed, sb, statistic and value.

    Each bin's power, over transfer (statistic, bin, transfer) if given, is compared with the noise runs' mean and spread over transfer; the
    sign is that of the sum of cubes. Bins without power or spread don't count; with too few bins (FEWEST) the value is null.
    """
    keys = ["level", *UNIT, "kind"]
    bins = spectra.groupBy(*keys, "bin").agg(F.max(F.when(F.col("run") < 0, F.col("power"))).alias("power"), F.avg(F.when(F.col("run") >= 0, F.col("power"))).alias("mean"), F.stddev_pop(F.when(F.col("run") >= 0, F.col("power"))).alias("std"))
    names = F.lit(None).cast("string")
    for level, name in NAMES.items():
        names = F.when(F.col("level") == level, name).otherwise(names)
    for kind, name in ONE_BAND.items():
        names = F.when((F.col("level") == 0) & (F.col("kind") == kind), name).otherwise(names)
    bins = bins.withColumn("statistic", names)
    bins = bins.join(transfer, ["statistic", "bin"], "left") if transfer is not None else bins.withColumn("transfer", F.lit(1.0))
    spread = F.nullif(F.col("std") / F.nullif("transfer", F.lit(0.0)), F.lit(0.0))
    z = F.when(F.col("power") > 0, (F.col("power") / F.nullif("transfer", F.lit(0.0)) - F.col("mean")) / spread)
    sums = bins.withColumn("z", z).groupBy(*UNIT, "statistic", "kind").agg(F.sum(F.col("z") ** 2).alias("_2"), F.sum(F.col("z") ** 3).alias("_3"), F.count("z").alias("n"))
    least = F.lit(0)
    for kind, fewest in FEWEST.items():
        least = F.when(F.col("kind") == kind, fewest).otherwise(least)
    value = F.signum("_3") * F.abs((F.col("_2") - F.col("n")) / F.sqrt(2.0 * F.col("n")))
    return sums.select(*UNIT, "statistic", F.when(F.col("n") >= least, value).alias("value"))


def square_maps(samples: DataFrame, pixels: int, size: float) -> DataFrame:
    """Each scan's band on a square of `pixels` x `pixels` about the middle of its own pointing: obsid, scan, feed, sb, x, y, chan, map and sigma.

    samples: obsid, scan, feed, sb, chan, ra, dec, value, sigma0 (of the channel), kept; size: a pixel in degrees of dec. Samples beyond the
    square are left out, as are masked ones. sigma is sigma0 over the root of hits.
    """
    mid = samples.groupBy("scan").agg(((F.max("ra") + F.min("ra")) / 2).alias("_ra"), ((F.max("dec") + F.min("dec")) / 2).alias("_dec"))
    both = samples.filter("kept").join(mid, "scan")
    x = F.floor((F.col("ra") - F.col("_ra")) * F.cos(F.radians("_dec")) / size + pixels / 2).cast("int")
    y = F.floor((F.col("dec") - F.col("_dec")) / size + pixels / 2).cast("int")
    inside = both.withColumn("x", x).withColumn("y", y).filter(F.col("x").between(0, pixels - 1) & F.col("y").between(0, pixels - 1))
    return inside.groupBy(*UNIT, "x", "y", "chan").agg(F.avg("value").alias("map"), (F.max("sigma0") / F.sqrt(F.count("*"))).alias("sigma"))


def map_statistics(maps: DataFrame, channels: int, bands: int, steps: tuple[float, float, float], squares: DataFrame | None = None, runs: int = 100, seed: int = 1, transfer: DataFrame | None = None) -> DataFrame:
    """The nine map statistics as one long table (obsid, scan, feed, sb, statistic, value); nulls in the names a statistic is stacked over.

    maps: scans' maps on the field's grid; squares: on squares of their own (`square_maps`), for ps_chi2.
    """
    out = stack_chi2(stack_spectra(stacked_cells(maps, channels), channels, bands, steps, runs, seed), transfer)
    if squares is None:
        return out
    own = squares.select(F.lit(0).alias("level"), *UNIT, "x", "y", (F.col("sb") * channels + F.col("chan")).cast("int").alias("z"), "map", "sigma")
    alone = stack_chi2(stack_spectra(own, channels, bands, steps, runs, seed + 1), None).filter(F.col("statistic") == "ps_s_sb")
    return out.unionByName(alone.withColumn("statistic", F.lit("ps_chi2")))
