"""Spikes, binned power, gain priors and noise tests of streams and small maps; one bounded array a row or group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import binned_power, peaks

#: What a spike's fit may be: amplitude, position about the peak (s), width (s), offset. Fixed values.
SPIKE_BOUNDS = ((0.0, 5000.0), (-0.5, 0.5), (0.0, 2.0), (-1.0, 1.0))


def smooth_cubic(d: np.ndarray, window: int = 151) -> np.ndarray:
    """Each sample by the cubic through the `window` samples around it; near the ends by that of the outermost window."""
    n, half = len(d), window // 2
    if n < window:
        return np.polynomial.Polynomial.fit(np.arange(n), d, min(3, n - 1))(np.arange(n))
    powers = np.vander(np.arange(-half, half + 1) / half, 4, increasing=True)
    fit = np.linalg.pinv(powers)
    out = np.convolve(d, fit[0][::-1], mode="same")
    out[:half] = powers[:half] @ (fit @ d[:window])
    out[n - half :] = powers[half + 1 :] @ (fit @ d[-window:])
    return out


def fit_spike(t: np.ndarray, d: np.ndarray, at: float, rounds: int = 60) -> np.ndarray | None:
    """Amplitude, position, width and offset of a Gaussian by damped Gauss-Newton steps within SPIKE_BOUNDS; None if it finds no better one."""
    lo, hi = np.array(SPIKE_BOUNDS).T
    p, damp = np.array([0.1, 0.0, 0.1, 0.0]), 1e-3
    x = t - at

    def model(p):
        z = (x - p[1]) / max(p[2], 1e-6)
        e = np.exp(-z * z / 2)
        return p[0] * e + p[3], np.stack([e, p[0] * e * z / max(p[2], 1e-6), p[0] * e * z * z / max(p[2], 1e-6), np.ones_like(x)], axis=1)

    first = np.sum((d - model(p)[0]) ** 2)
    best = first
    for _ in range(rounds):
        y, jac = model(p)
        h = jac.T @ jac
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-9), jac.T @ (d - y))
        trial = np.clip(p + step, lo, hi)
        now = np.sum((d - model(trial)[0]) ** 2)
        p, best, damp = (trial, now, damp / 3) if now < best else (p, best, min(damp * 4, 1e9))
    return p if best < first else None


def find_spikes(rows: DataFrame, key: str, samples: str, seconds: float, height: float = 0.01, distance: int = 50, reach: int = 70, most: int = 50) -> DataFrame:
    """Spikes of each stream's mean-normalised samples above a cubic smooth: key, n_spikes and spikes, of the first `most` an
    array of (amplitude, position, width, offset, chi2). A spike that no Gaussian fits has its position and nulls.

    Streams with null or no samples, or mean 0, have none.
    """
    def one(d):
        if d is None or len(d) < 4 or not np.isfinite(m := np.mean(d)) or m == 0:
            return 0, []
        d = d / m - 1
        rest = d - smooth_cubic(d)
        t = np.arange(len(d)) * seconds
        at = peaks(rest, 1)
        at = at[rest[at] >= height]
        keep = np.isin(at, peaks(np.where(np.isin(np.arange(len(rest)), at), rest, -np.inf), distance))
        at, out, std = at[keep], [], rest.std()
        for k in at[:most]:
            lo, hi = max(0, k - reach), min(len(d), k + reach)
            p = fit_spike(t[lo:hi], d[lo:hi], t[k])
            if p is None:
                out.append((None, float(t[k]), None, None, None))
                continue
            left = d[lo:hi] - p[0] * np.exp(-((t[lo:hi] - t[k] - p[1]) ** 2) / (2 * max(p[2], 1e-6) ** 2)) - p[3]
            out.append((*map(float, (p[0], t[k] + p[1], p[2], p[3])), float((np.sum((left / std) ** 2) - (hi - lo)) / np.sqrt(2 * (hi - lo)))))
        return len(at), out

    def run(batches):
        for batch in batches:
            found = [one(None if s is None else np.asarray(s, dtype=float)) for s in batch[samples]]
            yield pd.DataFrame({key: batch[key], "n_spikes": [n for n, _ in found], "spikes": [[dict(zip(("amplitude", "position", "width", "offset", "chi2"), s)) for s in x] for _, x in found]})

    shape = "array<struct<amplitude:double,position:double,width:double,offset:double,chi2:double>>"
    return rows.select(key, samples).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_spikes int, spikes {shape}")


def stream_power(rows: DataFrame, key: str, samples: str, bins: int = 100) -> DataFrame:
    """Mean power of each stream in logarithmic bins of frequency (cycles a sample): key, frequency, power, modes; empty bins are left out."""
    def run(batches):
        for batch in batches:
            for k, s in zip(batch[key], batch[samples]):
                if s is not None and len(s) > 2:
                    f = np.fft.rfftfreq(len(s))[1:]
                    mean, power, modes = binned_power(np.asarray(s, dtype=float), np.geomspace(f[0] * (1 - 1e-6), f[-1] * (1 + 1e-6), bins))
                    yield pd.DataFrame({key: k, "frequency": mean, "power": power, "modes": modes})

    return rows.select(key, samples).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, frequency double, power double, modes long")


def frequency_filter_prior(rows: DataFrame, by: list[str], at: str, y: str, p: str, q: str, sigma: float, prior: tuple[float, float, float], rate: float) -> DataFrame:
    """`frequency_filter` with a prior on the common gain: a 1 / f process of (level, knee, slope) weighs its Fourier modes.

    Per sample, sums over channels take p and q out of y and of 1; the stream of what is left, one array a
    group, is filtered by 1 / (z + sigma^2 / C(f)) and comes back as the offset of each sample. p and q
    must be the same at all samples of a channel.
    """
    cols = {"f": F.lit(1.0), "p": F.col(p), "q": F.col(q), "y": F.col(y)}
    names = ["ff", "fp", "fq", "pp", "pq", "qq", "fy", "py", "qy"]
    s = rows.groupBy(*by, at).agg(*[F.sum(cols[n[0]] * cols[n[1]]).alias(f"_{n}") for n in names])
    c = {n: F.col(f"_{n}") for n in names}
    det = F.nullif(c["pp"] * c["qq"] - c["pq"] ** 2, F.lit(0.0))

    def without(a: str, b: str):
        """The product of f with another column, both less their projections on p and q."""
        x, z = c[a], c[b]
        return (c["fp"] * (x * c["qq"] - z * c["pq"]) + c["fq"] * (z * c["pp"] - x * c["pq"])) / det

    reduced = s.select(*by, at, (c["fy"] - without("py", "qy")).alias("_r"), (c["ff"] - without("fp", "fq")).alias("_z"), *[c[n] for n in ("pp", "pq", "qq", "fp", "fq", "py", "qy")])
    streams = reduced.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(at, "_r"))).alias("_s"), F.avg("_z").alias("_zz"))
    level, knee, slope = prior
    fields = ", ".join(f"{b} {rows.schema[b].dataType.simpleString()}" for b in [*by, at])

    def run(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                places, r = zip(*((x[at], x["_r"]) for x in row["_s"]))
                f = np.fft.rfftfreq(len(r), 1 / rate)
                f[0] = f[1] / 2 if len(f) > 1 else knee
                gain = np.fft.irfft(np.fft.rfft(r) / (row["_zz"] + sigma**2 / (level**2 * (f / knee) ** slope)), n=len(r))
                yield pd.DataFrame({**{b: row[b] for b in by}, at: places, "offset": gain})

    gains = streams.mapInPandas(run, f"{fields}, offset double")
    both = reduced.join(gains, [*by, at])
    py, qy = c["py"] - c["fp"] * F.col("offset"), c["qy"] - c["fq"] * F.col("offset")
    fit = both.select(*by, at, "offset", ((py * c["qq"] - qy * c["pq"]) / det).alias("_mp"), ((qy * c["pp"] - py * c["pq"]) / det).alias("_mq"))
    out = rows.join(fit, [*by, at])
    return out.withColumn("residual", F.col(y) - F.col("offset") - F.coalesce(F.col("_mp") * F.col(p) + F.col("_mq") * F.col(q), F.lit(0.0))).drop("_mp", "_mq")


def map_chi2(cells: DataFrame, unit: str, shape: tuple[int, int, int], steps: tuple[float, float, float], edges: list[float], sims: int = 100, seed: int = 1) -> DataFrame:
    """Signed chi-square of the spectrum of small weighted maps (unit, x, y, z, map, sigma) against noise maps: unit, chi2 and bins.

    Weights are 1 / sigma^2; `sims` noise maps, seeded by (seed, unit), give each bin's mean and spread.
    The sign is that of the sum of cubes. Maps without seen cells have none.
    """
    k = np.sqrt(sum(np.meshgrid(*[(2 * np.pi * np.fft.fftfreq(n, d)) ** 2 for n, d in zip(shape, steps)], indexing="ij"))).ravel()
    which = np.where(k > 0, np.digitize(k, edges) - 1, -1)
    which[k == edges[-1]] = len(edges) - 2
    ok = (which >= 0) & (which < len(edges) - 1)
    modes = np.bincount(which[ok], minlength=len(edges) - 1)
    kind = cells.schema[unit].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = tuple(group[c].to_numpy() for c in "xyz")
        m, s = np.zeros(shape), np.zeros(shape)
        m[at], s[at] = group["map"], group["sigma"]
        w = np.divide(1, s * s, out=np.zeros(shape), where=s > 0)

        def power(x):
            p = np.abs(np.fft.fftn(w * x)).ravel()[ok] ** 2 * np.prod(steps) / np.prod(shape)
            return (np.bincount(which[ok], weights=p, minlength=len(modes)) / np.maximum(modes, 1))[modes > 0]

        rng = np.random.default_rng([seed, int(group[unit].iloc[0])])
        noise = np.array([power(rng.normal(size=shape) * s) for _ in range(sims)])
        z = (power(m) - noise.mean(axis=0)) / noise.std(axis=0)
        return pd.DataFrame({unit: group[unit].iloc[0], "chi2": [np.sign(np.sum(z**3)) * abs((np.sum(z * z) - len(z)) / np.sqrt(2 * len(z)))], "bins": len(z)})

    seen = cells.filter("map is not null and sigma > 0").select(unit, "x", "y", "z", "map", "sigma")
    return seen.groupBy(unit).applyInPandas(run, f"{unit} {kind}, chi2 double, bins int")
