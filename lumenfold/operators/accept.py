"""Scan bookkeeping: catalogue filters, acceptance cuts, split bits and reason masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runlist_filter(scans: DataFrame, excluded: DataFrame, allowed: int, min_length: float, reach: int = 1000) -> DataFrame:
    """Scans of an allowed type that are longer than min_length and outside all excluded id ranges, which are dealt into blocks of `reach` ids for an equi-join."""
    ok = scans.filter((F.col("scantype").bitwiseAND(F.lit(allowed)) != 0) & (F.col("length") > min_length))
    blocks = excluded.select("first", "last", F.explode(F.expr(f"sequence(first div {reach}, last div {reach})")).alias("_block"))
    return ok.join(blocks, (F.expr(f"scanid div {reach}") == F.col("_block")) & F.col("scanid").between(F.col("first"), F.col("last")), "left_anti")


def accept_cuts(stats: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Per statistic in long form whether it is rejected: closed intervals, a null bound never cuts,
    a null statistic is rejected where the cut has a bound. Statistics without a cut pass."""
    joined = stats.join(cuts, "stat", "left")
    bounded = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    out = F.coalesce(F.col("value") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("hi"), F.lit(False))
    return joined.withColumn("rejected", out | (F.col("value").isNull() & bounded))


def accept_list(judged: DataFrame, keys: list[str]) -> DataFrame:
    return judged.groupBy(*keys).agg((~F.bool_or("rejected")).alias("accepted"), F.count_if("rejected").alias("n_rejected"))


def median_split(rows: DataFrame, by: list[str], value: str, bit: int) -> DataFrame:
    """Bit `bit` set where the value is above its group's median, bit 0 for every accepted row."""
    mid = rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("mid"))
    bits = F.lit(1).bitwiseOR(F.when(F.col(value) > F.col("mid"), F.lit(1 << bit)).otherwise(0)).cast("long")
    return rows.join(mid, by).withColumn("bits", bits).drop("mid")


def rank_split(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Halves by rank: the upper one is True."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("upper", 2 * (place - 1) >= n)


def split_keys(rows: DataFrame, bits: str, primary: int, secondary: list[int]) -> DataFrame:
    """One row per secondary split with its key: the primary bit, then the secondary one."""
    bit = lambda n: F.shiftright(F.col(bits), n).bitwiseAND(F.lit(1)).cast("string")
    keys = [F.concat(F.lit(f"s{n}_"), bit(primary), bit(n)) for n in secondary]
    return rows.withColumn("split_key", F.explode(F.array(*keys)))


def night_hours(mjd: Column) -> Column:
    """Hours from two at night, local time at UTC - 7."""
    h = F.pmod(mjd * 24 - 7, F.lit(24.0))
    return F.least(F.abs(2 - h), F.abs(26 - h))


def sidereal(mjd: Column) -> Column:
    return 360 * F.pmod(F.lit(1.002737811) * mjd, F.lit(1.0))


def signed_chi2(value: Column) -> Column:
    """|chi2| with the sign of the sum of cubes."""
    n = F.count(value).cast("double")
    return F.signum(F.sum(F.pow(value, F.lit(3.0)))) * F.abs((F.sum(value * value) - n) / F.sqrt(2 * n))


def reason_table(rows: DataFrame, reason: str, bits: int) -> DataFrame:
    """Share of rows with each reason bit set, all bits in one pass."""
    sums = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(reason).bitwiseAND(F.lit(1 << b)) != 0).alias(f"b{b}") for b in range(bits)])
    return sums.select("n", F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.col(f"b{b}").alias("hits")) for b in range(bits)])).alias("x")).select("x.bit", "x.hits", (F.col("x.hits") / F.col("n")).alias("share"))
