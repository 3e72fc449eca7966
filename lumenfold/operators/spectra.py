"""Spectra and linear algebra: k-binning, cross spectra, correlation, principal components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def long_matrix(rows: DataFrame, channel: str, samples: str, keep: list[str] = ()) -> DataFrame:
    """Array rows as (channel, t, value)."""
    return rows.select(channel, *keep, F.posexplode(samples).alias("t", "value")).withColumn("value", F.col("value").cast("double"))


def _meet(long: DataFrame, by: list[str], channel: str, at: str, parts: Column) -> DataFrame:
    """Channels as arrays of times and values, in order dealt into parts (of a group's number `_n` of channels) and repeated for each two parts _x <= _y that meet."""
    cells = long.groupBy(*by, channel).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col("value").cast("double").alias("v")))).alias("_c"))
    w = Window.partitionBy(*by)
    placed = cells.select(*by, channel, F.col("_c.t").alias("_t"), F.col("_c.v").alias("_v"), (F.row_number().over(w.orderBy(channel)) - 1).alias("_at"))
    numbers = long.groupBy(*by).agg(F.count_distinct(channel).alias("_n")).withColumn("_parts", parts.cast("int"))
    dealt = placed.join(F.broadcast(numbers), by).withColumn("_part", F.floor(F.col("_at") * F.col("_parts") / F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.expr("sequence(0, _parts - 1)")))
    return dealt.select(*by, channel, "_t", "_v", "_part", F.least("_part", "_other").alias("_x"), F.greatest("_part", "_other").alias("_y"))


def _tiles(group: pd.DataFrame, channel: str, size: int = 1024):
    """Correlations of two parts that meet, by tiles: names of rows, names of columns, matrix (NaN where one doesn't vary or no time is common), common times or None for all."""
    group = group.sort_values(channel)
    names, part = group[channel].to_numpy(), group["_part"].to_numpy()
    lengths = group["_t"].map(len).to_numpy()
    column, times = pd.factorize(np.concatenate(group["_t"].to_list()))
    row, values = np.repeat(np.arange(len(group)), lengths), np.concatenate(group["_v"].to_list()).astype(float)
    m, seen = np.zeros((len(group), len(times))), np.zeros((len(group), len(times)))
    ok = ~np.isnan(values)
    m[row[ok], column[ok]], seen[row[ok], column[ok]] = values[ok], 1
    m -= seen * (m.sum(axis=1) / np.maximum(seen.sum(axis=1), 1))[:, None]
    whole = bool(seen.all())
    if whole:
        length = np.sqrt((m * m).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            m = m / length[:, None]  # NaN where nothing varies
        del seen
    x, y = group["_x"].iloc[0], group["_y"].iloc[0]
    rows, columns = np.flatnonzero(part == x), np.flatnonzero(part == y)
    for i in (rows[k : k + size] for k in range(0, len(rows), size)):
        for j in (columns[k : k + size] for k in range(0, len(columns), size)):
            if j[-1] <= i[0]:
                continue
            if whole:
                yield names[i], names[j], m[i] @ m[j].T, None
                continue
            a, b, sa, sb = m[i], m[j], seen[i], seen[j]
            n, ma, mb = sa @ sb.T, a @ sb.T, sa @ b.T
            with np.errstate(invalid="ignore", divide="ignore"):
                va, vb = (a * a) @ sb.T - ma * ma / n, sa @ (b * b).T - mb * mb / n
                corr = (a @ b.T - ma * mb / n) / np.sqrt(va * vb)
            yield names[i], names[j], np.where(np.isfinite(corr), corr, np.nan), n


def _grouped(group: pd.DataFrame, by: list[str], out: pd.DataFrame) -> pd.DataFrame:
    for name in reversed(by):
        value, kind = group[name].iloc[0], group[name].dtype
        # as the group has it: an object for each of millions of pairs takes longer than the pairs; null stays an object
        out.insert(0, name, pd.Series(value, index=out.index, dtype=object if pd.isna(value) else kind))
    return out


def _fields(long: DataFrame, columns: list[str]) -> str:
    return "".join(f"{c} {long.schema[c].dataType.simpleString()}, " for c in columns)


def correlation(long: DataFrame, by: list[str], channel: str, at: str = "t", block: int = 2048, digits: int | None = None) -> DataFrame:
    """Pearson correlations of channel pairs of a group, over the times both have: by, a, b (a < b) and corr (to so many digits, halves away from 0); null where one doesn't vary.

    Channels become arrays and are dealt into blocks of about `block` in order; each two blocks meet in one task, as
    products of matrices, so what is shuffled is every array once for each block, and rows are made for pairs only.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        some = [(group[channel].to_numpy()[:0], group[channel].to_numpy()[:0], np.empty(0))]
        for a, b, corr, n in _tiles(group, channel):
            if digits is not None:
                corr = np.copysign(np.floor(np.abs(corr) * 10**digits + 0.5) / 10**digits, corr) + 0.0
            p, q = np.nonzero((a[:, None] < b[None, :]) & (True if n is None else n > 0))
            some.append((a[p], b[q], corr[p, q]))
        return _grouped(group, by, pd.DataFrame({name: np.concatenate([t[k] for t in some]) for k, name in enumerate(("a", "b", "corr"))}))

    kind = long.schema[channel].dataType.simpleString()
    out = _meet(long, by, channel, at, F.ceil(F.col("_n") / block)).groupBy(*by, "_x", "_y").applyInPandas(run, f"{_fields(long, by)}a {kind}, b {kind}, corr double")
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


#: Where pairs needn't be listed: eight parts of a group, or as many as hold 65,536 channels each, so that arrays are shuffled a fixed number of times.
FEW = "greatest(ceil(_n / 65536), least(8, ceil(_n / 256)))"


def correlation_sums(long: DataFrame, by: list[str], channel: str, key: Callable[[np.ndarray], np.ndarray], apart: int = 1, at: str = "t") -> DataFrame:
    """What the correlations of all pairs a < b of numbered channels, `apart` or more from each other, come to by i = key(a) and j = key(b).

    by, i, j, pairs, valid (those whose correlation isn't null), nonzero, total, squares, largest (of sizes). Sums are taken where the matrix is, tile by tile: pairs are never rows.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for a, b, c, n in _tiles(group, channel):
            i, j = key(a), key(b)
            p, q = np.argsort(i, kind="stable"), np.argsort(j, kind="stable")
            c, i, j = c[np.ix_(p, q)], i[p], j[q]
            pair = None if b.min() - a.max() >= apart and n is None else (b[q][None, :] - a[p][:, None] >= apart) & (True if n is None else n[np.ix_(p, q)] > 0)
            ok = ~np.isnan(c) if pair is None else pair & ~np.isnan(c)
            if not ok.all():
                c = np.where(ok, c, 0.0)
            (ki, si), (kj, sj) = np.unique(i, return_index=True), np.unique(j, return_index=True)

            def over(x, f=np.add):
                return f.reduceat(f.reduceat(x, sj, axis=1), si, axis=0)

            count = np.outer(np.diff([*si, len(i)]), np.diff([*sj, len(j)]))
            pairs = count if pair is None else over(pair.astype(np.int64))
            valid = count if ok.all() else over(ok.astype(np.int64))
            nonzero = count if c.all() else over((c != 0).astype(np.int64))
            there = pairs > 0
            u, v = np.nonzero(there)
            kept.append((ki[u], kj[v], pairs[there], valid[there], nonzero[there], over(c)[there], over(c * c)[there], over(np.abs(c), np.maximum)[there]))
        names = ("i", "j", "pairs", "valid", "nonzero", "total", "squares", "largest")
        return _grouped(group, by, pd.DataFrame({name: np.concatenate([t[k] for t in kept]) if kept else [] for k, name in enumerate(names)}))

    parts = _meet(long, by, channel, at, F.expr(FEW)).groupBy(*by, "_x", "_y").applyInPandas(run, f"{_fields(long, by)}i long, j long, pairs long, valid long, nonzero long, total double, squares double, largest double")
    sums = parts.groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in ("pairs", "valid", "nonzero", "total", "squares")], F.max("largest").alias("largest"))
    return sums.withColumns({c: F.when(F.col("valid") > 0, F.col(c)) for c in ("total", "squares", "largest")})


def largest_correlation(long: DataFrame, by: list[str], channel: str, apart: int = 2, at: str = "t") -> DataFrame:
    """by, channel and `largest`: of a channel's |corr| with those whose numbers are `apart` or more from its own; null where none is valid."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(group[channel].to_numpy())
        best, met = np.full(len(names), -1.0), np.zeros(len(names), dtype=bool)
        for a, b, c, n in _tiles(group, channel):
            i, j = np.searchsorted(names, a), np.searchsorted(names, b)
            pair = np.ones(c.shape, dtype=bool) if n is None else n > 0
            if b.min() - a.max() < apart:
                pair &= b[None, :] - a[:, None] >= apart
            c = np.where(pair & ~np.isnan(c), np.abs(c), -1.0)
            best[i], met[i] = np.maximum(best[i], c.max(axis=1)), met[i] | pair.any(axis=1)
            best[j], met[j] = np.maximum(best[j], c.max(axis=0)), met[j] | pair.any(axis=0)
        return _grouped(group, by, pd.DataFrame({channel: names[met], "largest": best[met]}))

    parts = _meet(long, by, channel, at, F.expr(FEW)).groupBy(*by, "_x", "_y").applyInPandas(run, f"{_fields(long, [*by, channel])}largest double")
    return parts.groupBy(*by, channel).agg(F.max(F.when(F.col("largest") >= 0, F.col("largest"))).alias("largest"))


def principal_components(rows: DataFrame, by: str, samples: str, components: int) -> DataFrame:
    """Leading singular values per group of channels, from the Gram matrix over time.

    Gram matrices of parts add, so each task sums its own channels per group and only matrices of
    samples x samples are shuffled, however many channels a group has.
    """
    def partial(batches):
        grams: dict = {}
        for batch in batches:
            for key, group in batch.groupby(by):
                m = np.stack([np.asarray(s, dtype=float) for s in group[samples]])
                grams[key] = grams.get(key, 0) + m.T @ m
        for key, g in grams.items():
            yield pd.DataFrame({by: [key], "gram": [g.ravel()]})

    kind = rows.schema[by].dataType.simpleString()
    parts = rows.select(by, samples).mapInPandas(partial, f"{by} {kind}, gram array<double>")
    cells = parts.select(by, F.posexplode("gram").alias("at", "g")).groupBy(by, "at").agg(F.sum("g").alias("g"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        n = int(round(len(group) ** 0.5))
        values = np.linalg.eigvalsh(group.sort_values("at")["g"].to_numpy().reshape(n, n))[::-1][:components]
        return pd.DataFrame({by: group[by].iloc[0], "component": range(len(values)), "singular": np.sqrt(np.maximum(values, 0))})

    return cells.groupBy(by).applyInPandas(solve, f"{by} {kind}, component int, singular double")


def highpass(rows: DataFrame, key: str, samples: str, cutoff: float, power: float) -> DataFrame:
    """Samples without their slow part: W = 1 / (1 + (f / cutoff)^power) in Fourier space, f in cycles a sample."""
    def run(batches):
        for batch in batches:
            out = []
            for s in batch[samples]:
                d = np.asarray(s, dtype=float)
                f = np.fft.rfftfreq(len(d))
                out.append(d - np.fft.irfft(np.fft.rfft(d) / (1 + (f / cutoff) ** power), n=len(d)))
            yield pd.DataFrame({key: batch[key], "filtered": out})

    return rows.select(key, samples).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, filtered array<double>")


def k_average(spectra: DataFrame, by: list[str], k: str, power: str, edges: list[float]) -> DataFrame:
    """Means and mode counts in k bins; an edge belongs to the bin above it."""
    bin_ = sum(F.when(F.col(k) >= e, 1).otherwise(0) for e in edges) - 1
    return spectra.withColumn("bin", bin_).filter(F.col("bin").between(0, len(edges) - 2)).groupBy(*by, "bin").agg(F.avg(power).alias("power"), F.count("*").alias("modes"))
