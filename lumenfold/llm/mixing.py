"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts' text: its first 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: float) -> list[float]:
    """Cumulative probabilities of a Poisson distribution, as far as they differ from 1 by 2^-52."""
    term = total = exp(-rate)
    steps, k = [total], 0
    while 1 - total > 2.0**-52 and k < 10 * rate + 100:
        k += 1
        term *= rate / k
        total += term
        steps.append(total)
    return steps


def mixing_rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source") -> tuple[dict[str, float], float]:
    """The mean repetition of each named source, and of all others together.

    Targets are shares of as many rows as docs has; what the named ones leave of 1 goes to the
    others, null sources among them, at one common rate. Rows are counted over all of docs; as
    many numbers as there are names reach the driver.
    """
    named = F.when(F.col(source_col).isin(list(weights)), F.col(source_col))
    counts = {r["s"]: r["n"] for r in docs.groupBy(named.alias("s")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    left = max(0.0, 1 - sum(weights.values()))
    rates = {s: w * total / counts[s] for s, w in weights.items() if counts.get(s)}
    return rates, left * total / counts[None] if counts.get(None) else 0.0


def mix_sources(docs: DataFrame, weights: dict[str, float], seed: int = 0, id_col: str = "doc_id", source_col: str = "source", max_rate: float = 200.0) -> DataFrame:
    """docs with each row repeated by a Poisson count of its source's rate, in a global shuffle.

    A row's count inverts the distribution at a hash of the seed and its id, so it is the same on
    every run and independent of partitioning; rows that repeat an id repeat alike, and null ids
    count as empty text. Adds copy (from 0) and shuffle_key; rows stand by shuffle_key inside
    hash partitions of it and of their columns, which is a random order of the whole. Columns of those names in docs
    are replaced. A rate over max_rate raises: such a target can't be met from so few rows.
    """
    rates, rest = mixing_rates(docs, weights, source_col)
    if max([rest, *rates.values()]) > max_rate:
        raise ValueError(f"a source would be repeated more than {max_rate} times on average")
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = uniform(F.lit(str(seed)), ids)

    def count(rate: float) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, poisson_steps(rate))), lambda step: step <= u))

    times = count(rest)
    for source, rate in sorted(rates.items()):
        times = F.when(F.col(source_col).eqNullSafe(F.lit(source)), count(rate)).otherwise(times)
    n = free_name(docs, "_lf_times")
    copies = docs.withColumn(n, times).filter(F.col(n) > 0)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order {seed}"), ids, F.col("copy").cast("string"))))
    # ids that are null or repeat share a key, so the row's other columns help to deal it out
    return copies.repartition("shuffle_key", F.xxhash64(*docs.columns)).sortWithinPartitions("shuffle_key", "copy")
