"""Filters of detector time streams: calibration, gain, templates, notches and noise.

Streams are rows with one array of samples; NumPy works on a row at a time inside Arrow batches, so
no shuffle is needed. What sums can express works on one row a sample instead. Samples must be
finite; null and empty arrays come back as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kelvin of the sky background; seconds of the decay after a repointing. Fixed values.
SKY, DECAY = 2.725, 19.2


def per_row(rows: DataFrame, key: str, samples: str, change: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """key and `filtered`: change(samples, key) of every row."""
    def run(batches):
        for batch in batches:
            arrays = [np.empty(0) if s is None else np.asarray(s, dtype=float) for s in batch[samples]]
            yield pd.DataFrame({key: batch[key], "filtered": [change(d, k) if len(d) else d for k, d in zip(batch[key], arrays)]})

    return rows.select(key, samples).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, filtered array<double>")


def system_temperature(hot: DataFrame, cold: DataFrame, by: list[str], power: str, t_hot: str) -> DataFrame:
    """Gain and system temperature per channel from mean powers on the hot load and on the sky.

    Channels that never saw the load get nulls and `calibrated` false.
    """
    h = hot.groupBy(*by).agg(F.avg(power).alias("p_hot"), F.avg(t_hot).alias("t_hot"))
    both = cold.groupBy(*by).agg(F.avg(power).alias("p_cold")).join(h, by, "left")
    above = F.col("t_hot") - SKY
    tsys = above / F.nullif(F.col("p_hot") / F.nullif("p_cold", F.lit(0.0)) - 1, F.lit(0.0))
    return both.select(*by, ((F.col("p_hot") - F.col("p_cold")) / F.nullif(above, F.lit(0.0))).alias("gain"), tsys.alias("tsys"), tsys.isNotNull().alias("calibrated"))


def calibrate(tod: DataFrame, tsys: DataFrame, by: list[str], value: str) -> DataFrame:
    """Normalised samples in kelvin; null where a channel has no system temperature."""
    return tod.join(tsys.select(*by, "tsys"), by, "left").withColumn("kelvin", F.col(value) * F.col("tsys"))


def slow_part(d: np.ndarray, cutoff: float, power: float) -> np.ndarray:
    f = np.fft.rfftfreq(len(d))
    return np.fft.irfft(np.fft.rfft(d) / (1 + (f / cutoff) ** power), n=len(d))


def smooth_length(least: int) -> int:
    """The smallest length from `least` on without prime factors over 5."""
    n = max(1, least)
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def normalise_gain(rows: DataFrame, key: str, samples: str, cutoff: float, power: float = 4.0) -> DataFrame:
    """d / slow(d) - 1, padded with zeros to half as much again; the slow part of the mask makes up for them."""
    def change(d, _):
        room = np.zeros((2, smooth_length(-(-3 * len(d) // 2))))
        room[0, : len(d)], room[1, : len(d)] = d, 1
        low = slow_part(room[0], cutoff, power)[: len(d)] / slow_part(room[1], cutoff, power)[: len(d)]
        return d / np.where(low == 0, np.nan, low) - 1

    return per_row(rows, key, samples, change)


def normalise_gain_gaussian(rows: DataFrame, key: str, samples: str, block: int = 20, sigma: float = 4.0) -> DataFrame:
    """d / slow(d) - 1 where slow(d) joins Gaussian-smoothed block means by lines."""
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)

    def change(d, _):
        starts = np.arange(0, len(d), block)
        sizes = np.diff(np.r_[starts, len(d)])
        means = np.pad(np.add.reduceat(d, starts) / sizes, reach, mode="symmetric")
        low = np.interp(np.arange(len(d)), starts + (sizes - 1) / 2, np.convolve(means, kernel / kernel.sum(), mode="valid"))
        return d / np.where(low == 0, np.nan, low) - 1

    return per_row(rows, key, samples, change)


def mirrored(d: np.ndarray, ends: int = 100) -> np.ndarray:
    """Three times as long: reflected oddly about weighted means of the `ends` samples at either end,
    the outermost with weight 1, the innermost with 0."""
    n = min(ends, len(d))
    w = np.linspace(1, 0, n) if n > 1 else np.ones(1)
    return np.r_[2 * np.average(d[:n], weights=w) - d[::-1], d, 2 * np.average(d[-n:], weights=w[::-1]) - d[::-1]]


def padded_highpass(rows: DataFrame, key: str, samples: str, cutoff: float, power: float = 8.0) -> DataFrame:
    """Samples without their slow part, mirrored at the ends first."""
    return per_row(rows, key, samples, lambda d, _: d - slow_part(mirrored(d), cutoff, power)[len(d) : 2 * len(d)])


def notch(rows: DataFrame, key: str, samples: str, centre: float | list[float], width: float) -> DataFrame:
    """Take out frequencies (cycles a sample) within width / 2 of each centre, with a cosine taper from there out to width.

    The taper rises outwards, as a notch's must.
    """
    def change(d, _):
        wide = mirrored(d)
        keep = np.ones(len(wide) // 2 + 1)
        for c in np.atleast_1d(centre):
            off = np.abs(np.fft.rfftfreq(len(wide)) - c) / width
            keep *= 0.5 - 0.5 * np.cos(np.pi * np.clip(2 * off - 1, 0, 1))
        return np.fft.irfft(np.fft.rfft(wide) * keep, n=len(wide))[len(d) : 2 * len(d)]

    return per_row(rows, key, samples, change)


def notch_coefficients(centres: float | list[float], quality: float | list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of second-order notches in a row; frequencies in cycles a sample, quality = frequency / width."""
    b, a = np.ones(1), np.ones(1)
    for f, q in zip(np.atleast_1d(centres), np.broadcast_to(quality, np.shape(np.atleast_1d(centres)))):
        w = 2 * np.pi * f
        gain = 1 / (1 + np.tan(w / q / 2))
        b, a = np.convolve(b, gain * np.array([1, -2 * np.cos(w), 1])), np.convolve(a, [1, -2 * gain * np.cos(w), 2 * gain - 1])
    return b, a


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The recursive filter b / a over the last axis of many rows at once, from a state for each."""
    out, z = np.empty_like(x), np.concatenate([state, np.zeros((len(x), 1))], axis=1)
    for i in range(x.shape[1]):
        now = x[:, i]
        out[:, i] = y = b[0] * now + z[:, 0]
        z[:, :-1] = z[:, 1:] + now[:, None] * b[1:] - y[:, None] * a[1:]
    return out


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows filtered forwards and then backwards, extended oddly about their end samples by three times the
    filter's length (less where rows are shorter), from the state of a steady input."""
    pad, order = min(3 * len(a), x.shape[1] - 1), len(a) - 1
    if pad < 1:
        return x.copy()
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    steady = np.eye(order) + np.outer(a[1:], np.eye(order)[0]) - np.eye(order, k=1)
    start = np.linalg.solve(steady, b[1:] - a[1:] * b[0])
    for _ in range(2):
        wide = recursive(b, a, wide, wide[:, :1] * start)[:, ::-1]
    return wide[:, pad:-pad]


def per_length(rows: DataFrame, key: str, samples: str, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key and `filtered`: change(matrix) of the rows of a batch that have one length. Empty and null arrays come back empty."""
    def run(batches):
        for batch in batches:
            arrays = [np.empty(0) if s is None else np.asarray(s, dtype=float) for s in batch[samples]]
            out, sizes = list(arrays), np.array([len(d) for d in arrays])
            for n in set(sizes[sizes > 0].tolist()):
                at = np.flatnonzero(sizes == n)
                for i, d in zip(at, change(np.stack([arrays[i] for i in at]))):
                    out[i] = d
            yield pd.DataFrame({key: batch[key], "filtered": out})

    return rows.select(key, samples).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, filtered array<double>")


def notch_both_ways(rows: DataFrame, key: str, samples: str, centre: float | list[float], quality: float | list[float]) -> DataFrame:
    """Recursive notches in a row, run forwards and then backwards so that phases stay."""
    b, a = notch_coefficients(centre, quality)
    return per_length(rows, key, samples, lambda x: both_ways(b, a, x))


def peaks(x: np.ndarray, distance: int) -> np.ndarray:
    """Local maxima (of flat ones the middle, rounded down), of those nearer than `distance` the highest, ties to the later one."""
    change = np.flatnonzero(np.diff(x) != 0)
    lo, hi = np.r_[0, change + 1], np.r_[change, len(x) - 1]
    inner = (lo > 0) & (hi < len(x) - 1)
    lo, hi = lo[inner], hi[inner]
    top = (x[lo - 1] < x[lo]) & (x[hi + 1] < x[hi])
    at = (lo[top] + hi[top]) // 2
    keep = np.ones(len(at), dtype=bool)
    for i in np.lexsort((np.arange(len(at)), x[at]))[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    return at[keep]


def notch_at_turns(rows: DataFrame, key: str, samples: str, azimuth: str, centre: float | list[float], quality: float | list[float], reach: int = 500, distance: int = 100) -> DataFrame:
    """Notches around turning points only: `reach` samples to either side of each peak of |azimuth - median|, one after
    the other; peaks too near an end are left out. rows: key, samples, azimuth, of one length each."""
    b, a = notch_coefficients(centre, quality)

    def run(batches):
        for batch in batches:
            out = []
            for d, az in zip(batch[samples], batch[azimuth]):
                d = np.empty(0) if d is None else np.array(d, dtype=float)
                az = np.empty(0) if az is None else np.asarray(az, dtype=float)
                for at in peaks(np.abs(az - np.median(az)), distance) if len(az) > 2 else ():
                    if at - reach >= 0 and at + reach < len(d):
                        d[at - reach : at + reach] = both_ways(b, a, d[None, at - reach : at + reach])[0]
                out.append(d)
            yield pd.DataFrame({key: batch[key], "filtered": out})

    return rows.select(key, samples, azimuth).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, filtered array<double>")


def subtract_start_decay(rows: DataFrame, key: str, samples: str, seconds: float) -> DataFrame:
    """Fit 1, t, e and t e with e = exp(-t / DECAY), t = sample x seconds; take out the last two."""
    def change(d, _):
        t = np.arange(len(d)) * seconds
        e = np.exp(-t / DECAY)
        m = np.stack([np.ones_like(t), t, e, t * e], axis=1)
        size = np.linalg.norm(m, axis=0)
        m = m / np.where(size == 0, 1, size)
        return d - m[:, 2:] @ np.linalg.lstsq(m, d, rcond=None)[0][2:]

    return per_row(rows, key, samples, change)


def subtract_slope_by_direction(rows: DataFrame, by: list[str], at: str, x: str, y: str) -> DataFrame:
    """Slopes through the origin on x less its mean, one while x rises and one while it doesn't, taken out of y.

    The first row of a stream has the direction of the second.
    """
    w = Window.partitionBy(*by).orderBy(at)
    step = F.coalesce(F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x), F.lit(0.0))
    lined = rows.withColumn("rising", step > 0).withColumn("_x", F.col(x) - F.avg(x).over(Window.partitionBy(*by)))
    fit = lined.groupBy(*by, "rising").agg((F.sum(F.col("_x") * F.col(y)) / F.nullif(F.sum(F.col("_x") ** 2), F.lit(0.0))).alias("amplitude"))
    return lined.join(fit, [*by, "rising"]).withColumn("residual", F.col(y) - F.coalesce("amplitude", F.lit(0.0)) * F.col("_x")).drop("_x")


def frequency_filter(rows: DataFrame, by: list[str], y: str, p: str, q: str) -> DataFrame:
    """Least squares of y on 1, p and q over the channels of each time sample: offset, and y without all three.

    Nine sums per sample settle it; Cramer's rule solves for the three numbers.
    """
    one = F.lit(1.0)
    cols = {"f": one, "p": F.col(p), "q": F.col(q), "y": F.col(y)}
    names = ["ff", "fp", "fq", "pp", "pq", "qq", "fy", "py", "qy"]
    sums = rows.groupBy(*by).agg(*[F.sum(cols[n[0]] * cols[n[1]]).alias(f"_{n}") for n in names])
    s = {n: F.col(f"_{n}") for n in names}

    def det(a, b, c):
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - b[0] * (a[1] * c[2] - a[2] * c[1]) + c[0] * (a[1] * b[2] - a[2] * b[1])

    m = [(s["ff"], s["fp"], s["fq"]), (s["fp"], s["pp"], s["pq"]), (s["fq"], s["pq"], s["qq"])]
    rhs = (s["fy"], s["py"], s["qy"])
    whole = F.nullif(det(*m), F.lit(0.0))
    fit = sums.select(*by, *[(det(*[rhs if i == k else m[i] for i in range(3)]) / whole).alias(f"_a{k}") for k in range(3)])
    left = F.col(y) - F.col("_a0") - F.col("_a1") * F.col(p) - F.col("_a2") * F.col(q)
    return rows.join(fit, by).withColumn("offset", F.col("_a0")).withColumn("residual", F.coalesce(left, F.col(y))).drop("_a0", "_a1", "_a2")


def noise_streams(keys: DataFrame, key: str, n: int, sigma: float, knee: float = 0.0, alpha: float = 0.0, seed: int = 1) -> DataFrame:
    """key and n samples of white noise, with (f / knee)^alpha added to its power where knee > 0.

    Seeded by (seed, key): the same however rows are partitioned or tasks repeated.
    """
    def change(_, k):
        d = np.random.default_rng([seed, int(k)]).normal(0, sigma, n)
        if knee > 0:
            f = np.fft.rfftfreq(n)
            f[0] = f[1] if n > 1 else 1.0
            d = np.fft.irfft(np.fft.rfft(d) * np.sqrt(1 + (f / knee) ** alpha), n=n)
        return d

    return per_row(keys.withColumn("_d", F.array(F.lit(0.0))), key, "_d", change)


def binned_power(d: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean frequency, mean power and modes of the bins that aren't empty."""
    f, p = np.fft.rfftfreq(len(d))[1:], np.abs(np.fft.rfft(d))[1:] ** 2 / len(d)
    modes = np.histogram(f, edges)[0]
    some = (modes > 0) & (np.histogram(f, edges, weights=p)[0] > 0)
    return (*(np.histogram(f, edges, weights=v)[0][some] / modes[some] for v in (f, p)), modes[some])


def noise_parameters(streams: list[np.ndarray], bins: int = 19) -> list[np.ndarray]:
    """sigma, knee and alpha of each stream; streams whose power lies in the same bins are fitted together, each by its own steps."""
    out, alike = [np.full(3, np.inf) if len(d) else d for d in streams], {}
    for k, d in enumerate(streams):
        if len(d) >= 8 and np.ptp(d):
            f, p, modes = binned_power(d, np.geomspace(1 / len(d), 0.5 + 1e-9, bins + 1))
            alike.setdefault((f.tobytes(), modes.tobytes()), (f, modes, [], []))[2].append(k)
            alike[f.tobytes(), modes.tobytes()][3].append(p)
    for f, modes, rows, powers in alike.values():
        p, root = np.stack(powers), np.sqrt(modes)
        best, found = np.full(len(p), np.inf), np.full((len(p), 3), np.inf)
        for knee in (f[0], f[len(f) // 2]):
            x, damp = np.stack([np.log(p[:, p.shape[1] // 2 :].mean(axis=1)), np.full(len(p), np.log(knee)), np.full(len(p), -1.0)], axis=1), np.full(len(p), 1e-2)

            def error(x):
                z = x[:, 2:] * (np.log(f) - x[:, 1:2])
                return root * (np.log(p) - x[:, :1] - np.logaddexp(0, z)), z

            r, z = error(x)
            for _ in range(100):
                s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                jac = root[:, None] * np.stack([np.ones_like(z), -s * x[:, 2:], s * (np.log(f) - x[:, 1:2])], axis=2)
                turned = jac.transpose(0, 2, 1)
                h = turned @ jac
                trial = x + np.linalg.solve(h + damp[:, None, None] * (h * np.eye(3)) + 1e-9 * np.eye(3), turned @ r[:, :, None])[:, :, 0]
                with np.errstate(all="ignore"):
                    r2, z2 = error(trial)
                    better = np.isfinite(trial).all(axis=1) & ((r2 * r2).sum(axis=1) < (r * r).sum(axis=1))
                x, r, z = (np.where(better[:, None], new, old) for new, old in ((trial, x), (r2, r), (z2, z)))
                damp = np.where(better, damp / 3, np.minimum(damp * 4, 1e9))
            size = (r * r).sum(axis=1)
            found = np.where((size < best)[:, None], np.stack([np.exp(x[:, 0] / 2), np.exp(np.clip(x[:, 1], -700, 700)), x[:, 2]], axis=1), found)
            best = np.where(size < best, size, best)
        for k, one in zip(rows, found):
            out[k] = one
    return out


def fit_noise(rows: DataFrame, key: str, samples: str, bins: int = 19) -> DataFrame:
    """`filtered` holds sigma, knee and alpha of sigma^2 (1 + (f / knee)^alpha), fitted to the binned power.

    Damped Gauss-Newton steps on logarithms from two starts, of a batch's rows at once; infinite where neither settles.
    """
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "filtered": noise_parameters([np.empty(0) if s is None else np.asarray(s, dtype=float) for s in batch[samples]], bins)})

    return rows.select(key, samples).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, filtered array<double>")
