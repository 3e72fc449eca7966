"""Averages of power spectra: which bins and pairs count, ensembles of random splits, and one-dimensional spectra."""

from __future__ import annotations

from math import exp, lgamma, log, log10

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .accept import signed_chi2


def log_edges(lo: float, hi: float, bins: int) -> list[float]:
    return [10 ** (log10(lo) + (log10(hi) - log10(lo)) * i / bins) for i in range(bins + 1)]


def bin_of(value: Column, edges: list[float]) -> Column:
    """The bin [edge, next edge) of a value, the last one closed; null outside."""
    at = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        at = F.when((value >= edges[i]) & ((value < edges[i + 1]) if i < len(edges) - 2 else (value <= edges[i + 1])), i).otherwise(at)
    return at


def usable_bins(bins: DataFrame, share: float = 0.2, across=(0.11, 0.96), along=(0.0, 0.62), ring=(0.0, 2.0)) -> DataFrame:
    """bins (i, j, k_perp, k_par, transfer) with `usable`: a transfer over `share` of the largest inside the outermost bins,
    and k within a rectangle and a ring, edges included."""
    ends = bins.agg(F.max("i").alias("_i"), F.max("j").alias("_j"))
    rows = bins.crossJoin(F.broadcast(ends))
    inner = F.when((F.col("i") > 0) & (F.col("j") > 0) & (F.col("i") < F.col("_i")) & (F.col("j") < F.col("_j")), F.col("transfer"))
    largest = rows.agg(F.max(inner).alias("_most"))  # one row
    k = F.sqrt(F.col("k_perp") ** 2 + F.col("k_par") ** 2)
    ok = (F.col("transfer") > share * F.col("_most")) & F.col("k_perp").between(*across) & F.col("k_par").between(*along) & k.between(*ring)
    return rows.crossJoin(F.broadcast(largest)).withColumn("usable", F.coalesce(ok, F.lit(False))).drop("_i", "_j", "_most")


def accepted_pairs(spectra: DataFrame, pair: list[str], chi2_limit: float = 5.0, overlap_limit: float = 0.6) -> DataFrame:
    """Pairs of detectors with chi2 and `accepted`: different detectors, finite chi2 that isn't 0 and is under the limit, overlap over its.

    spectra: pair (..., feed1, feed2), overlap, value, sigma, usable. chi2 has the sign of the sum of cubes.
    """
    z = F.when(F.col("usable"), F.col("value") / F.nullif(F.col("sigma"), F.lit(0.0)))
    out = spectra.groupBy(*pair).agg(signed_chi2(z).alias("chi2"), F.max("overlap").alias("overlap"))
    ok = (F.col("feed1") != F.col("feed2")) & (F.col("chi2") != 0) & (F.abs("chi2") < chi2_limit) & (F.col("overlap") > overlap_limit)
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def averaged(spectra: DataFrame, accepted: DataFrame, pair: list[str], by: list[str]) -> DataFrame:
    """Inverse-variance mean and its error of the accepted pairs' spectra, bin by bin."""
    good = spectra.join(accepted.filter("accepted").select(*pair), pair, "left_semi")
    w = 1 / F.nullif(F.col("sigma") ** 2, F.lit(0.0))
    sums = good.groupBy(*by).agg(F.sum(F.col("value") * w).alias("_n"), F.sum(w).alias("_w"), F.count("*").alias("pairs"))
    return sums.select(*by, (F.col("_n") / F.col("_w")).alias("mean"), (1 / F.sqrt("_w")).alias("error"), "pairs")


def spherical(bins: DataFrame, by: list[str], edges: list[float], shown: tuple[float, float] = (0.0, float("inf"))) -> DataFrame:
    """One-dimensional spectra of (k_perp, k_par, mean, error, transfer, usable): means of value / transfer weighted by (transfer / error)^2.

    Bins with their middle out of `shown` have nulls.
    """
    k = F.sqrt(F.col("k_perp") ** 2 + F.col("k_par") ** 2)
    w = F.when(F.col("usable"), (F.col("transfer") / F.nullif("error", F.lit(0.0))) ** 2).otherwise(0.0)
    rows = bins.withColumn("bin", bin_of(k, edges)).filter((k > 0) & F.col("bin").isNotNull())
    sums = rows.groupBy(*by, "bin").agg(F.sum(w * F.col("mean") / F.nullif("transfer", F.lit(0.0))).alias("_n"), F.sum(w).alias("_w"), F.count("*").alias("modes"))
    mids = F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])]), F.col("bin") + 1)
    some = mids.between(*shown)
    weight = F.nullif("_w", F.lit(0.0))
    return sums.select(*by, "bin", mids.alias("k"), F.when(some, F.col("_n") / weight).alias("power"), F.when(some, 1 / F.sqrt(weight)).alias("error"), "modes")


def ensemble_moments(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample standard deviation over an ensemble."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("runs"))


def ensemble_covariance(runs: DataFrame, run: str, cell: str, value: str) -> DataFrame:
    """Sample covariance of all pairs of bins (a <= b) over an ensemble; as many rows as pairs of bins."""
    x = runs.select(run, F.col(cell).alias("a"), F.col(value).alias("x"))
    y = runs.select(run, F.col(cell).alias("b"), F.col(value).alias("y"))
    return x.join(y, run).filter("a <= b").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("covariance"))


def random_split_noise(runs: DataFrame, run: str, by: list[str], value: str, overlap: str, share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """From an ensemble of random splits: (sigma and median overlap by bin, the runs that remain as noise).

    The first `share` of all run numbers (from 0) gives sigma, the rest are simulations; zeros count as missing.
    """
    total = runs.agg((F.max(run) + 1).alias("_runs"))
    rows = runs.crossJoin(F.broadcast(total)).withColumn("_first", F.col(run) < F.floor(F.col("_runs") * share)).withColumn(value, F.nullif(F.col(value), F.lit(0.0)))
    sigma = rows.groupBy(*by).agg(F.stddev_samp(F.when(F.col("_first"), F.col(value))).alias("sigma"), F.percentile(overlap, F.lit(0.5)).alias("overlap"))
    return sigma, rows.filter("not _first").drop("_runs", "_first")


def chi2_survival(chi2: float, dof: float) -> float:
    """P(X > chi2) of a chi-square distribution: the upper regularised gamma function, by series or continued fraction."""
    a, x = dof / 2, chi2 / 2
    if x <= 0:
        return 1.0
    scale = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def digamma(x: Column) -> Column:
    """Derivative of the logarithm of the gamma function, for x > 0: by its recurrence up to 8 and more, then by its series."""
    shift = sum((1 / (x + k) for k in range(8)), F.lit(0.0))
    y = x + 8
    z = 1 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - shift


def trigamma(x: Column) -> Column:
    """Derivative of `digamma`."""
    shift = sum((1 / ((x + k) * (x + k)) for k in range(8)), F.lit(0.0))
    y = x + 8
    z = 1 / (y * y)
    return 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * 5 / 66)))) + shift


def fitted_dof(sims: DataFrame, by: list[str], chi2: str, steps: int = 12) -> DataFrame:
    """Degrees of freedom of each group's chi-squares, by maximum likelihood: by, dof and n.

    The likelihood depends on them through the mean logarithm alone, so one grouped sum settles it; Newton's steps solve
    digamma(dof / 2) = mean log(chi2 / 2) in columns, from an inverse of digamma that is right at both ends. Values of 0 or less don't count.
    """
    some = sims.filter(F.col(chi2) > 0).groupBy(*by).agg(F.avg(F.log(F.col(chi2) / 2)).alias("_log"), F.count("*").alias("n"))
    half = some.withColumn("_a", F.when(F.col("_log") >= -2.22, F.exp("_log") + 0.5).otherwise(-1 / (F.col("_log") + 0.5772156649015329)))
    for _ in range(steps):
        half = half.withColumn("_a", F.greatest(F.col("_a") - (digamma(F.col("_a")) - F.col("_log")) / trigamma(F.col("_a")), F.col("_a") / 10))
    return half.select(*by, (2 * F.col("_a")).alias("dof"), "n")


def numeric_pte(found: DataFrame, sims: DataFrame, by: list[str], chi2: str) -> DataFrame:
    """found (by, chi2, one row a group) with `numeric`: the share of the group's simulated chi-squares that are larger."""
    both = sims.select(*by, F.col(chi2).alias("_sim")).join(found, by)
    return both.groupBy(*found.columns).agg((1 - F.avg((F.col("_sim") <= F.col(chi2)).cast("double"))).alias("numeric"))


def with_survival(rows: DataFrame, chi2: str, dof: str) -> DataFrame:
    """rows with `pte`, the chance of a larger chi-square."""
    @F.pandas_udf("double")
    def pte(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_survival(a, b) for a, b in zip(x, n)])

    return rows.withColumn("pte", pte(F.col(chi2).cast("double"), F.col(dof).cast("double")))


def block_inverses(runs: DataFrame, pair: list[str], run: str, block: str, cell: str, value: str, tie: float = 1e-10) -> DataFrame:
    """Inverse sample covariances of an ensemble: pair, block, a, b and inverse, of the cells a and b of each block.

    Covariances are grouped sums over the ensemble; each block's matrix, as large as the cells of a block, gets its Cholesky
    factor in one row. A block whose smallest pivot is under `tie` of its largest has no rows: too few runs, or cells that depend on others.
    """
    x = runs.select(*pair, block, run, F.col(cell).alias("a"), F.col(value).alias("_x"))
    y = runs.select(*pair, block, run, F.col(cell).alias("b"), F.col(value).alias("_y"))
    cov = x.join(y, [*pair, block, run]).groupBy(*pair, block, "a", "b").agg(F.covar_samp("_x", "_y").alias("c"))
    one = cov.groupBy(*pair, block).agg(F.collect_list(F.struct("a", "b", "c")).alias("cells"))
    kind = runs.schema[cell].dataType.simpleString()

    @F.pandas_udf(f"array<struct<a:{kind},b:{kind},inverse:double>>")
    def invert(matrices: pd.Series) -> pd.Series:
        out = []
        for rows in matrices:
            names = sorted({r["a"] for r in rows})
            at = {n: i for i, n in enumerate(names)}
            m = np.full((len(names), len(names)), np.nan)
            for r in rows:
                m[at[r["a"]], at[r["b"]]] = np.nan if r["c"] is None else r["c"]
            out.append([])
            if not np.isfinite(m).all():
                continue
            try:
                pivots = np.diag(low := np.linalg.cholesky(m))
            except np.linalg.LinAlgError:
                continue
            if pivots.min() ** 2 > tie * pivots.max() ** 2:
                half = np.linalg.solve(low, np.eye(len(low)))
                inverse = half.T @ half
                out[-1] = [{"a": a, "b": b, "inverse": float(inverse[at[a], at[b]])} for a in names for b in names]
        return pd.Series(out)

    return one.select(*pair, block, F.explode(invert("cells")).alias("_i")).select(*pair, block, "_i.*")


def covariance_average(spectra: DataFrame, inverses: DataFrame, pair: list[str], block: str, cell: str, value: str) -> DataFrame:
    """Generalised least squares over pairs: block, cell, mean and error.

    Sums inverse covariances and what they make of each spectrum over all pairs, and solves each block's system. Pairs without an
    inverse of a block take no part in it. error is the root of the summed inverse's inverse on the diagonal.
    """
    kind = spectra.schema[cell].dataType.simpleString()
    x = spectra.select(*pair, block, F.col(cell).alias("b"), F.col(value).alias("_v"))
    both = inverses.join(x, [*pair, block, "b"]).groupBy(block, "a", "b").agg(F.sum("inverse").alias("m"), F.sum(F.col("inverse") * F.col("_v")).alias("s"))
    one = both.groupBy(block).agg(F.collect_list(F.struct("a", "b", "m", "s")).alias("cells"))

    @F.pandas_udf(f"array<struct<cell:{kind},mean:double,error:double>>")
    def solve(systems: pd.Series) -> pd.Series:
        out = []
        for rows in systems:
            names = sorted({r["a"] for r in rows})
            at = {n: i for i, n in enumerate(names)}
            m, s = np.zeros((len(names), len(names))), np.zeros(len(names))
            for r in rows:
                m[at[r["a"]], at[r["b"]]] = r["m"]
                s[at[r["a"]]] += r["s"]
            inverse = np.linalg.inv(m)
            out.append([{"cell": n, "mean": float(v), "error": float(e)} for n, v, e in zip(names, inverse @ s, np.sqrt(np.diag(inverse)))])
        return pd.Series(out)

    return one.select(block, F.explode(solve("cells")).alias("_o")).select(block, F.col("_o.cell").alias(cell), "_o.mean", "_o.error")


def uniformity(ptes: DataFrame, by: list[str], pte: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of a group's PTEs from even ones: null tests of one kind, a few hundred numbers each."""
    rows = ptes.filter(F.col(pte).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.collect_list(pte).alias("_all")).select(*by, "n", F.posexplode(F.array_sort("_all")).alias("_i", "_p"))
    far = F.greatest((F.col("_i") + 1) / F.col("n") - F.col("_p"), F.col("_p") - F.col("_i") / F.col("n"))
    return rows.groupBy(*by).agg(F.max("n").alias("n"), F.max(far).alias("distance"))


def kolmogorov(distance: Column, n: Column, terms: int = 40) -> Column:
    """The chance of a larger Kolmogorov-Smirnov distance of n even numbers, by the limiting distribution with Stephens' correction for few."""
    x = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * distance
    total = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, terms + 1)), F.lit(0.0))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def pte_table(ptes: DataFrame, test: str, column: str, pte: str, columns: list[str]) -> DataFrame:
    """Null tests as a table: a row for each test with its PTE in each of `columns` (fields or splits), and a last row, KS, with the chance
    that a column's PTEs are even. Of several PTEs of a cell the smallest stands."""
    rows = ptes.filter(F.col(column).isin(columns)).select(F.col(test).cast("string").alias("test"), F.col(column).alias("_c"), F.col(pte).alias("_p"))
    cells = rows.groupBy("test").pivot("_c", columns).agg(F.min("_p")).withColumn("last", F.lit(False))
    even = uniformity(rows, ["_c"], "_p").select(F.lit("KS").alias("test"), "_c", kolmogorov(F.col("distance"), F.col("n")).alias("_p"))
    return cells.unionByName(even.groupBy("test").pivot("_c", columns).agg(F.min("_p")).withColumn("last", F.lit(True)))


def model_chi2(bins: DataFrame, model: DataFrame, by: list[str], cell: float = 0.05) -> DataFrame:
    """Chi-square of one-dimensional spectra (by, k, power, error) against models (model, k, power), which are joined by lines between their k.

    Lines are dealt into cells of k, so that an equi-join finds the one for a bin.
    """
    ends = model.selectExpr("model", "k as k0", "power as p0", "lead(k) over (partition by model order by k) as k1", "lead(power) over (partition by model order by k) as p1").filter("k1 is not null")
    ends = ends.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("k0") / cell), F.floor(F.col("k1") / cell))))
    both = bins.withColumn("_cell", F.floor(F.col("k") / cell)).join(ends, "_cell").filter((F.col("k") >= F.col("k0")) & (F.col("k") < F.col("k1")))
    want = F.col("p0") + (F.col("p1") - F.col("p0")) * (F.col("k") - F.col("k0")) / (F.col("k1") - F.col("k0"))
    return both.groupBy(*by, "model").agg(F.sum(((F.col("power") - want) / F.nullif("error", F.lit(0.0))) ** 2).alias("chi2"), F.count("power").alias("bins"))


def transfer_estimates(spectra: DataFrame, by: list[str]) -> DataFrame:
    """Transfer functions (injected - noise) / signal of rows with all three: mean and spread over realisations, and the noise over its largest."""
    one = (F.col("injected") - F.col("noise")) / F.nullif("signal", F.lit(0.0))
    out = spectra.groupBy(*by).agg(F.avg(one).alias("transfer"), F.stddev_samp(one).alias("spread"), F.avg("noise").alias("_noise"))
    most = out.agg(F.max("_noise").alias("_most"))
    return out.crossJoin(F.broadcast(most)).withColumn("noise_share", F.col("_noise") / F.nullif("_most", F.lit(0.0))).drop("_noise", "_most")


def pair_table(maps: DataFrame, unit: str, splits: DataFrame) -> DataFrame:
    """The pairs of maps to cross: detectors with detectors for every pair of splits (split1, split2); of one split with itself each pair once.

    maps: split, unit. As many rows as results, so the joins are on the split's name.
    """
    a = maps.select(F.col("split").alias("split1"), F.col(unit).alias("feed1"))
    b = maps.select(F.col("split").alias("split2"), F.col(unit).alias("feed2"))
    return splits.join(a, "split1").join(b, "split2").filter((F.col("split1") != F.col("split2")) | (F.col("feed2") >= F.col("feed1"))).select("split1", "split2", "feed1", "feed2")
