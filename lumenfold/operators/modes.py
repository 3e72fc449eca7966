"""Principal-component filters of detector streams: count the modes above noise, and subtract them.

Rows are channels with one array of samples. A scan may hold more channels than a task can, so its
leading modes come from subspace iteration: every round sums samples x modes arrays over parts of at
most a few hundred channels, and only those sums meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modes beyond those asked for that the iteration carries along.
SPARE = 8


def noise_edge(samples: int, channels: int, sigma: float, factor: float) -> float:
    """The singular value that noise alone reaches, by a fitted correction of sqrt(N) + sqrt(P). Fixed values."""
    x = np.log10(samples) * np.log10(channels)
    return factor * (1.00476 - 3.957e-3 * x + 8.757e-5 * x * x) * (np.sqrt(channels) + np.sqrt(samples)) * sigma


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(s, dtype=float) for s in column])


def _start(chans, width: int) -> np.ndarray:
    """Random signs of each channel, by its key alone."""
    keys = np.array([hash(int(c)) & 0xFFFFFFFF for c in chans], dtype=np.uint64)[:, None]
    mixed = (keys * np.uint64(width) + np.arange(width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    return np.where((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) > 0, 1.0, -1.0)


def _white(m: np.ndarray) -> np.ndarray:
    return np.std(np.diff(m, axis=1), axis=1) / np.sqrt(2) if m.shape[1] > 1 else np.zeros(len(m))


def _parted(rows: DataFrame, by: str, chan: str, channels: int) -> tuple[DataFrame, DataFrame]:
    """rows with the part of its group that each belongs to, of about so many channels, and all parts."""
    counted = rows.groupBy(by).agg(F.ceil(F.count("*") / channels).cast("int").alias("_parts"))
    dealt = rows.join(counted, by).withColumn("_part", F.pmod(F.xxhash64(chan), F.col("_parts")).cast("int")).drop("_parts")
    places = counted.select(by, F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part"))
    return dealt, places.toDF(by, "_part")


def leading_modes(rows: DataFrame, by: str, chan: str, samples: str, part_channels: int = 512, most: int = 12, rounds: int = 6) -> DataFrame:
    """Per group: modes (samples x `most`, row after row), singular values, channels, n_samples and sigma,
    the mean white-noise level. Channels are centred first, as principal components are.

    rows: by (long), chan (long) and samples, all of one length within a group, without nulls.
    Exact up to how far `rounds` rounds separate modes; 6 do for modes that stand out of noise.
    """
    shape, width = f"{by} long, y array<double>", most + SPARE
    rows, places = _parted(rows.select(by, chan, samples), by, chan, part_channels)

    def centred(group: pd.DataFrame) -> np.ndarray:
        m = _matrix(group[samples])
        return m - m.mean(axis=1, keepdims=True)

    def first(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: group[by].iloc[0], "y": [(centred(group).T @ _start(group[chan], width)).ravel()]})

    def again(group: pd.DataFrame, basis: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(basis):
            return pd.DataFrame({by: [], "y": []})
        m, q = centred(group), np.asarray(basis["y"].iloc[0]).reshape(-1, width)
        return pd.DataFrame({by: group[by].iloc[0], "y": [(m.T @ (m @ q)).ravel()]})

    def orthogonal(group: pd.DataFrame) -> pd.DataFrame:
        y = np.sum(_matrix(group["y"]), axis=0).reshape(-1, width)
        q = np.zeros_like(y)
        part = np.linalg.qr(y)[0]
        q[:, : part.shape[1]] = part
        return pd.DataFrame({by: group[by].iloc[0], "y": [q.ravel()]})

    def facts(group: pd.DataFrame, basis: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(basis):
            return pd.DataFrame({by: [], "gram": [], "n": [], "sigma": []})
        b = centred(group) @ np.asarray(basis["y"].iloc[0]).reshape(-1, width)
        return pd.DataFrame({by: group[by].iloc[0], "gram": [(b.T @ b).ravel()], "n": len(group), "sigma": _white(_matrix(group[samples])).sum()})

    def solve(parts: pd.DataFrame, basis: pd.DataFrame) -> pd.DataFrame:
        q = np.asarray(basis["y"].iloc[0]).reshape(-1, width)
        values, turn = np.linalg.eigh(np.sum(_matrix(parts["gram"]), axis=0).reshape(width, width))
        values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
        n = int(parts["n"].sum())
        return pd.DataFrame({by: basis[by].iloc[0], "modes": [(q @ turn).ravel()], "singular": [np.sqrt(np.maximum(values, 0))], "channels": n, "n_samples": len(q), "sigma": parts["sigma"].sum() / n})

    dealt = rows.groupBy(by, "_part")
    basis = dealt.applyInPandas(first, shape).groupBy(by).applyInPandas(orthogonal, shape)
    for _ in range(rounds):
        spread = basis.join(places, by).groupBy(by, "_part")
        basis = dealt.cogroup(spread).applyInPandas(again, shape).groupBy(by).applyInPandas(orthogonal, shape)
    parts = dealt.cogroup(basis.join(places, by).groupBy(by, "_part")).applyInPandas(facts, f"{by} long, gram array<double>, n long, sigma double")
    return parts.groupBy(by).cogroup(basis.groupBy(by)).applyInPandas(solve, f"{by} long, modes array<double>, singular array<double>, channels long, n_samples long, sigma double")


def count_modes(modes: DataFrame, factor: float, least: int, fewest_channels: int) -> DataFrame:
    """modes with n_modes: how many singular values exceed the noise edge, at least `least`; none where there are too few channels."""
    x = F.log10(F.col("n_samples")) * F.log10(F.col("channels"))
    edge = factor * (1.00476 - 3.957e-3 * x + 8.757e-5 * x * x) * (F.sqrt("channels") + F.sqrt("n_samples")) * F.col("sigma")
    above = F.size(F.filter("singular", lambda s: s > F.col("edge")))
    return modes.withColumn("edge", edge).withColumn("n_modes", F.when(F.col("channels") >= fewest_channels, F.greatest(above, F.lit(least))).otherwise(0))


def subtract_streams(rows: DataFrame, modes: DataFrame, by: str, chan: str, samples: str, part_channels: int = 512) -> DataFrame:
    """by, chan, cleaned (samples less their projection on the group's first n_modes modes) and amplitudes.

    All rows are cleaned, those that had no say in the modes too; groups without modes stay as they are.
    """
    dealt, places = _parted(rows.select(by, chan, samples), by, chan, part_channels)
    spread = modes.select(by, "modes", "n_modes", "n_samples").join(places, by)

    def change(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({by: [], chan: [], "cleaned": [], "amplitudes": []})
        m = _matrix(group[samples])
        u = np.zeros((m.shape[1], 0))
        if len(known):
            u = np.asarray(known["modes"].iloc[0]).reshape(int(known["n_samples"].iloc[0]), -1)[:, : int(known["n_modes"].iloc[0])]
        a = m @ u
        return pd.DataFrame({by: group[by], chan: group[chan], "cleaned": list(m - a @ u.T), "amplitudes": list(a)})

    return dealt.groupBy(by, "_part").cogroup(spread.groupBy(by, "_part")).applyInPandas(change, f"{by} long, {chan} long, cleaned array<double>, amplitudes array<double>")


def pca_filter(rows: DataFrame, by: str, chan: str, samples: str, kept: str, factor: float = 1.005, most: int = 12, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Streams of a scan without the modes that its unmasked channels share, and the modes: (cleaned, modes)."""
    modes = count_modes(leading_modes(rows.filter(kept), by, chan, samples, most=most), factor, least, 21)
    return subtract_streams(rows, modes, by, chan, samples), modes


def block_streams(rows: DataFrame, by: str, chan: str, samples: str, weight: str, size: int) -> DataFrame:
    """Weighted sums of blocks of `size` channels, over the root of the summed squared weights and the size: by, block, stream.

    Parts of a block are summed where they lie; blocks without weight are left out.
    """
    def partial(batches):
        for batch in batches:
            for (g, b), part in batch.groupby([by, "block"]):
                w = part["_w"].to_numpy(dtype=float)
                yield pd.DataFrame({by: [g], "block": [b], "s": [w @ _matrix(part[samples])], "ww": [float((w * w).sum())]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        ww = group["ww"].sum()
        return pd.DataFrame({by: [group[by].iloc[0]], "block": [group["block"].iloc[0]], "stream": [_matrix(group["s"]).sum(axis=0) / ww / (size / np.sqrt(ww))]})

    some = rows.filter(F.col(weight) > 0).select(by, F.floor(F.col(chan) / size).cast("long").alias("block"), samples, F.col(weight).cast("double").alias("_w"))
    parts = some.mapInPandas(partial, f"{by} long, block long, s array<double>, ww double")
    return parts.groupBy(by, "block").applyInPandas(whole, f"{by} long, block long, stream array<double>")


def pca_feed_filter(rows: DataFrame, by: str, chan: str, samples: str, weight: str, size: int, factor: float = 1.033, most: int = 12, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Like `pca_filter`, detector by detector, with modes from blocks of channels weighted by `weight` (0: masked).

    Detectors with fewer than 15 blocks stay as they are.
    """
    blocks = block_streams(rows, by, chan, samples, weight, size)
    modes = count_modes(leading_modes(blocks, by, "block", "stream", most=most), factor, least, 15)
    return subtract_streams(rows, modes, by, chan, samples), modes
