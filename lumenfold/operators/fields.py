"""Maps as fields: sky pixels, cleaning, cross spectra, transfer functions and mock maps.

One group is one detector's map or one pair of maps, on a grid of fixed size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rotate_to_field(ra: Column, dec: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Longitude and latitude in degrees about a field's centre."""
    a, d = F.radians(ra - F.lit(ra0)), F.radians(dec)
    s0, c0 = float(np.sin(np.radians(dec0))), float(np.cos(np.radians(dec0)))
    x, y, z = F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)
    return F.degrees(F.atan2(y, x * c0 + z * s0)), F.degrees(F.asin(F.least(F.greatest(z * c0 - x * s0, F.lit(-1.0)), F.lit(1.0))))


def sky_pixel(ra: Column, dec: Column, ra0: float, dec0: float, res: float, n: int) -> tuple[Column, Column]:
    """Pixel numbers on an equirectangular grid of n x n; right ascension falls. Null outside."""
    mid = (n - 1) / 2
    at = [F.rint(F.lit(mid) - (ra - F.lit(ra0)) * float(np.cos(np.radians(dec0))) / res), F.rint(F.lit(mid) + (dec - F.lit(dec0)) / res)]
    ra_i, dec_i = [F.when((x >= 0) & (x < n), x.cast("int")) for x in at]
    return ra_i, dec_i


def _grid(group: pd.DataFrame, rows: list[str], cols: list[str]):
    i, j = (pd.MultiIndex.from_frame(group[c]).factorize() for c in (rows, cols))
    return i[0], j[0], (len(i[1]), len(j[1]))


def _clean(maps: DataFrame, by: list[str], change) -> DataFrame:
    """Group by group, change(values, sigma, cells by channel and pixel) becomes the column `cleaned`."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j, shape = _grid(group, ["sb", "chan"], ["dec_i", "ra_i"])
        ok = group["map"].notna() & (group["sigma"] > 0)
        m, w = np.zeros(shape), np.zeros(shape)
        m[i[ok], j[ok]], w[i[ok], j[ok]] = group["map"][ok], 1 / group["sigma"][ok]
        return group.assign(cleaned=np.where(ok, change(m, w)[i, j], np.nan))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in maps.schema.fields)
    return maps.groupBy(*by).applyInPandas(run, f"{fields}, cleaned double")


def subtract_modes(maps: DataFrame, by: list[str], modes: int, power: float = 1.0) -> DataFrame:
    """Each map (channel x pixel) without the leading singular modes of map / sigma^power."""
    def change(m, w):
        scale = np.where(w > 0, w, 0) ** power if power else np.ones_like(w)
        u, s, v = np.linalg.svd(m * scale, full_matrices=False)
        return m - np.divide((u[:, :modes] * s[:modes]) @ v[:modes], scale, out=np.zeros_like(m), where=scale > 0)

    return _clean(maps, by, change)


def subtract_weighted_modes(maps: DataFrame, by: list[str], modes: int, rounds: int = 500, settled: float = 1e-8) -> DataFrame:
    """Like `subtract_modes`, but each rank-one mode is an inverse-variance least-squares fit, by alternating steps."""
    def change(m, w):
        w, left = w * w, m.copy()
        for _ in range(modes):
            pixel = np.ones(m.shape[1])
            for _ in range(rounds):
                channel = np.divide((w * left) @ pixel, w @ pixel**2, out=np.zeros(m.shape[0]), where=w @ pixel**2 > 0)
                under = channel**2 @ w
                new = np.divide(channel @ (w * left), under, out=np.zeros(m.shape[1]), where=under > 0)
                size = np.linalg.norm(new)
                if not size:
                    break
                new, channel = new / size, channel * size
                stop, pixel = np.linalg.norm(new - pixel) < settled, new
                if stop:
                    break
            left = left - np.outer(channel, pixel) * (w > 0)
        return left

    return _clean(maps, by, change)


def highpass_maps(maps: DataFrame, by: list[str], reach: float, n_dec: int, n_ra: int) -> DataFrame:
    """Each channel's map without its weighted fit of Fourier waves (i, j), both from 0, with i^2 + j^2 <= reach^2."""
    top = int(reach)
    waves = [(i, j) for i in range(top + 1) for j in range(top + 1) if i * i + j * j <= reach * reach]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ok = (group["map"].notna() & (group["sigma"] > 0)).to_numpy()
        phase = 2 * np.pi * np.stack([i * group["dec_i"] / n_dec + j * group["ra_i"] / n_ra for i, j in waves], axis=1)
        basis = np.concatenate([np.cos(phase), np.sin(phase)], axis=1)
        w, m = 1 / group["sigma"].to_numpy()[ok], group["map"].to_numpy()
        fit = np.linalg.lstsq(basis[ok] * w[:, None], m[ok] * w, rcond=1e-8)[0] if ok.any() else np.zeros(basis.shape[1])
        return group.assign(cleaned=np.where(ok, m - basis @ fit, np.nan))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in maps.schema.fields)
    return maps.groupBy(*by).applyInPandas(run, f"{fields}, cleaned double")


def cross_spectra(maps: DataFrame, unit: str, shape: tuple[int, int, int], steps: tuple[float, float, float], across: list[float], along: list[float], sims: int = 0, seed: int = 1) -> DataFrame:
    """Pseudo cross spectra of all pairs of maps in bins of k across and along the line of sight.

    maps: unit, x, y, z (cell numbers), map, sigma; shape and steps: cells and cell sizes. Cells are
    weighted by sqrt(w1 w2) over its root mean square, w = 1 / sigma^2, and by 0 where the
    logarithm of that is below -0.5. sigma is the standard deviation (n - 1) over `sims` noise maps
    seeded by the pair; null for fewer than two. A pair without common cells gives no rows.
    """
    volume, cells = float(np.prod(steps)), int(np.prod(shape))
    kx, ky, kz = (2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(shape, steps))
    k_across = np.sqrt(kx[:, None, None] ** 2 + ky[None, :, None] ** 2 + 0 * kz).ravel()
    k_along = np.abs(0 * kx[:, None, None] + 0 * ky[None, :, None] + kz).ravel()
    bins = [np.asarray(across), np.asarray(along)]
    modes = np.histogram2d(k_across, k_along, bins)[0]
    kind = maps.schema[unit].dataType.simpleString()

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        at = tuple(pair[c].to_numpy() for c in "xyz")
        cubes = np.zeros((4, *shape))
        for cube, name in zip(cubes, ("m1", "m2", "s1", "s2")):
            cube[at] = pair[name]
        some = (cubes[2] > 0) & (cubes[3] > 0)
        w = np.divide(1, cubes[2] * cubes[3], out=np.zeros(shape), where=some)
        w /= np.sqrt(np.mean(w**2))
        w[w < 10**-0.5] = 0

        def power(a, b):
            p = np.real(np.fft.fftn(a * w) * np.conj(np.fft.fftn(b * w))).ravel() * volume / cells
            return np.divide(np.histogram2d(k_across, k_along, bins, weights=p)[0], modes, out=np.zeros_like(modes), where=modes > 0)

        ids = pair["a"].iloc[0], pair["b"].iloc[0]
        rng = np.random.default_rng([seed, *map(int, ids)])
        noise = [power(rng.normal(size=shape) * cubes[2], rng.normal(size=shape) * cubes[3]) for _ in range(sims)]
        sigma = np.std(noise, axis=0, ddof=1) if sims > 1 else np.full(modes.shape, np.nan)
        i, j = np.nonzero(modes)
        return pd.DataFrame({"a": ids[0], "b": ids[1], "across": i, "along": j, "power": power(cubes[0], cubes[1])[i, j], "sigma": sigma[i, j], "modes": modes[i, j].astype(int)})

    ok = maps.filter("map is not null and sigma > 0").select(F.col(unit), "x", "y", "z", "map", "sigma")
    pairs = ok.withColumnsRenamed({unit: "a", "map": "m1", "sigma": "s1"}).join(ok.withColumnsRenamed({unit: "b", "map": "m2", "sigma": "s2"}), ["x", "y", "z"]).filter("a < b")
    return pairs.groupBy("a", "b").applyInPandas(run, f"a {kind}, b {kind}, across int, along int, power double, sigma double, modes long")


def transfer_function(injected: DataFrame, noise: DataFrame, signal: DataFrame, by: list[str]) -> DataFrame:
    """(injected - noise) / signal of spectra in the same bins; null where the signal has no power."""
    three = injected.select(*by, F.col("power").alias("_i")).join(noise.select(*by, F.col("power").alias("_n")), by).join(signal.select(*by, F.col("power").alias("_s")), by)
    return three.select(*by, ((F.col("_i") - F.col("_n")) / F.nullif("_s", F.lit(0.0))).alias("transfer"))


def cross_transfer(cross: DataFrame, signal: DataFrame, by: list[str]) -> DataFrame:
    """Transfer from the cross spectrum of a map with the signal alone over the signal's own spectrum, in the same bins; null where that is 0."""
    both = cross.select(*by, F.col("power").alias("_c")).join(signal.select(*by, F.col("power").alias("_s")), by)
    return both.select(*by, (F.col("_c") / F.nullif("_s", F.lit(0.0))).alias("transfer"))


def beam_transfer(k: Column, sigma: float, pixel: float) -> Column:
    """Power left by a Gaussian beam and by averaging over a pixel: exp(-k^2 sigma^2) sinc^2(k pixel / 2)."""
    half = k * F.lit(pixel / 2)
    return F.exp(-(k**2) * F.lit(sigma**2)) * F.when(half == 0, 1.0).otherwise((F.sin(half) / half) ** 2)


def convolve(cells: DataFrame, by: list[str], x: str, y: str, value: str, sigma: float, reach: int) -> DataFrame:
    """Convolution with a Gaussian cut at `reach` cells: every cell is dealt to its neighbours and summed."""
    g = [float(np.exp(-0.5 * (i / sigma) ** 2)) for i in range(-reach, reach + 1)]
    kernel = F.array(*[F.lit(v / sum(g)) for v in g])

    def along(rows, axis):
        dealt = rows.select("*", F.posexplode(kernel).alias("_p", "_g")).withColumn(axis, F.col(axis) + F.col("_p") - reach)
        return dealt.groupBy(*by, x, y).agg(F.sum(F.col(value) * F.col("_g")).alias(value))

    return along(along(cells.select(*by, x, y, value), x), y)


def counts_above(rows: DataFrame, value: str, lo: float, step: float) -> DataFrame:
    """Bins of a value with the number of rows in them and in them or above."""
    bins = rows.groupBy(F.floor((F.col(value) - lo) / step).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # ordered as a whole, but over bins, whose number doesn't grow with the rows
    return bins.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("bin"))))


def match_abundance(masses: DataFrame, brightness: DataFrame) -> DataFrame:
    """Each mass bin and the brightest bin that holds as many or more in it and above (`counts_above` of each).

    Null where even the lowest brightness bin holds fewer. Both lists lie in one order of counts;
    it is one task's work, over bins, whose number doesn't grow with the rows.
    """
    both = masses.select("bin", F.lit(None).cast("int").alias("bright"), "above", F.lit(1).alias("side"))
    both = both.union(brightness.select(F.lit(None).cast("int"), "bin", "above", F.lit(0)))
    w = Window.orderBy(F.desc("above"), "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("bright", F.max("bright").over(w)).filter("side = 1").select("bin", "bright")


def block_means(pairs: DataFrame, by: list[str], a: str, b: str, value: str, size: int) -> DataFrame:
    """Means and largest size of a channel-by-channel matrix in blocks, for box and stripe masks."""
    return pairs.groupBy(*by, F.floor(F.col(a) / size).cast("int").alias("i"), F.floor(F.col(b) / size).cast("int").alias("j")).agg(
        F.avg(value).alias("mean"), F.max(F.abs(value)).alias("largest"), F.count("*").alias("n")
    )


def comoving(z: np.ndarray | float, matter: float = 0.286, hubble: float = 70.0, steps: int = 4096) -> np.ndarray:
    """Comoving distance in Mpc to redshift z in a flat universe, by Simpson's rule."""
    z = np.atleast_1d(np.asarray(z, dtype=float))
    x = np.linspace(0, 1, 2 * steps + 1)
    w = np.ones_like(x)
    w[1:-1:2], w[2:-1:2] = 4, 2
    f = 1 / np.sqrt(matter * (1 + z[:, None] * x) ** 3 + 1 - matter)
    return 299_792.458 / hubble * z * (f @ w) / (6 * steps)


def box_steps(z_mid: float, rest_ghz: float, lo_ghz: float, hi_ghz: float, channels: int, ra_step: float, dec_step: float, dec0: float, matter: float = 0.286, hubble: float = 70.0) -> dict[str, float]:
    """Cell sizes in Mpc of a map as a box: dx, dy (degrees at z_mid, right ascension by cos(dec0)), dz (one channel at
    z_mid), their volume, and the smallest and largest k of each side for a cell count."""
    per_degree = float(comoving(z_mid, matter, hubble)[0]) * np.pi / 180
    width = (1 + z_mid) ** 2 * (hi_ghz - lo_ghz) / (channels - 1) / rest_ghz
    ends = comoving([z_mid - width / 2, z_mid + width / 2], matter, hubble)
    steps = {"dx": ra_step * abs(float(np.cos(np.radians(dec0)))) * per_degree, "dy": dec_step * per_degree, "dz": float(ends[1] - ends[0])}
    return {**steps, "volume": steps["dx"] * steps["dy"] * steps["dz"], "mpc_per_arcmin": per_degree / 60}


def as_box(maps: DataFrame, channels: int) -> DataFrame:
    """Cells of a box: x, y and z (channels of all bands in order), map and sigma in microkelvin, w = 1 / sigma^2; unseen cells are 0."""
    seen = F.col("sigma").isNotNull() & (F.col("sigma") > 0) & F.col("map").isNotNull()
    return maps.withColumn("x", F.col("ra_i")).withColumn("y", F.col("dec_i")).withColumn("z", F.col("sb") * channels + F.col("chan")).withColumns({
        "map": F.when(seen, F.col("map") * 1e6).otherwise(0.0), "w": F.when(seen, 1 / (F.col("sigma") * 1e6) ** 2).otherwise(0.0), "sigma": F.when(seen, F.col("sigma") * 1e6).otherwise(0.0),
    })


def _k_grid(shape, steps):
    kx, ky, kz = (2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(shape, steps))
    across = np.sqrt(kx[:, None, None] ** 2 + ky[None, :, None] ** 2 + 0 * kz).ravel()
    return across, np.abs(0 * kx[:, None, None] + 0 * ky[None, :, None] + kz).ravel()


def auto_spectra(cells: DataFrame, unit: str, shape: tuple[int, int, int], steps: tuple[float, float, float], across: list[float], along: list[float] | None = None) -> DataFrame:
    """Spectra of single maps (unit, x, y, z, map, sigma), weighted by w over its root mean square, w = 1 / sigma^2.

    With `along`, in bins of k across and along; without, in bins of |k| without k = 0.
    """
    volume, n = float(np.prod(steps)), int(np.prod(shape))
    k_across, k_along = _k_grid(shape, steps)
    k = np.sqrt(k_across**2 + k_along**2)
    bins = [np.asarray(across), np.asarray(along if along is not None else [-np.inf, np.inf])]
    first = k_across if along is not None else np.where(k > 0, k, -1.0)
    modes = np.histogram2d(first, k_along, bins)[0] if along is not None else np.histogram(first, bins[0])[0][:, None]
    kind = cells.schema[unit].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = tuple(group[c].to_numpy() for c in "xyz")
        m, w = np.zeros(shape), np.zeros(shape)
        m[at], w[at] = group["map"], 1 / group["sigma"] ** 2
        p = np.abs(np.fft.fftn(m * w / np.sqrt(np.mean(w**2)))).ravel() ** 2 * volume / n
        total = np.histogram2d(first, k_along, bins, weights=p)[0] if along is not None else np.histogram(first, bins[0], weights=p)[0][:, None]
        i, j = np.nonzero(modes)
        return pd.DataFrame({unit: group[unit].iloc[0], "across": i, "along": j, "power": total[i, j] / modes[i, j], "modes": modes[i, j].astype(int)})

    ok = cells.filter("map is not null and sigma > 0").select(unit, "x", "y", "z", "map", "sigma")
    return ok.groupBy(unit).applyInPandas(run, f"{unit} {kind}, across int, along int, power double, modes long")


def random_fields(keys: DataFrame, key: str, shape: tuple[int, ...], steps: tuple[float, ...], power, seed: int = 1) -> DataFrame:
    """key and `cells`, a random field (row after row) of each key whose spectrum is power(k), k in cycles a length. Seeded by (seed, key)."""
    k = np.sqrt(sum(np.meshgrid(*[np.fft.fftfreq(n, d) ** 2 for n, d in zip(shape, steps)], indexing="ij")))
    scale = np.sqrt(np.asarray(power(k), dtype=float) / np.prod([n * d for n, d in zip(shape, steps)])) * np.prod(shape)

    def run(batches):
        for batch in batches:
            out = []
            for name in batch[key]:
                g = np.random.default_rng([seed, int(name)])
                out.append(np.real(np.fft.ifftn((g.normal(size=shape) + 1j * g.normal(size=shape)) * scale)).ravel())
            yield pd.DataFrame({key: batch[key], "cells": out})

    return keys.select(key).mapInPandas(run, f"{key} {keys.schema[key].dataType.simpleString()}, cells array<double>")
