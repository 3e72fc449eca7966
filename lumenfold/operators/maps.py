"""Sky maps: inverse-variance binning, coadds, noise masks and overlaps of long-form maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIXEL = ["feed", "dec_i", "ra_i", "sb", "chan"]


def pixel_index(value: Column, first: float, step: float) -> Column:
    """Nearest pixel of an equidistant axis, halves to even."""
    return F.rint((value - F.lit(first)) / F.lit(step)).cast("int")


def bin_map(tod: DataFrame, keys: list[str] = PIXEL) -> DataFrame:
    """Sums per pixel of value * w and w over unmasked samples, and hits. One pre-aggregated shuffle."""
    return tod.filter("ok").groupBy(*keys).agg(F.sum(F.col("value") * F.col("w")).alias("num"), F.sum("w").alias("den"), F.count("*").alias("nhit"))


def finalise(sums: DataFrame) -> DataFrame:
    """map = num / den and sigma = 1 / sqrt(den); null where nothing was seen."""
    den = F.nullif("den", F.lit(0.0))
    return sums.withColumn("map", F.col("num") / den).withColumn("sigma", 1 / F.sqrt(den))


def coadd_levels(sums: DataFrame) -> DataFrame:
    """Feed maps, maps of four feed groups of five, and the whole, in one grouping-sets pass.

    level is 0 for feeds, 1 for groups, 2 for the whole. All three add the same sums.
    """
    grouped = sums.withColumn("bag", F.floor((F.col("feed") - 1) / 5).cast("int"))
    pixel = [F.col(c) for c in ("dec_i", "ra_i", "sb", "chan")]
    out = grouped.groupingSets(
        [["feed", "bag", *pixel], ["bag", *pixel], pixel], "feed", "bag", *pixel
    ).agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("nhit").alias("nhit"), (F.grouping("feed") + F.grouping("bag")).cast("int").alias("level"))
    return finalise(out)


def inverse_variance_coadd(maps: DataFrame, keys: list[str], value: str = "map", sigma: str = "sigma") -> DataFrame:
    """Coadd of maps that share pixels: sum(m / s^2) / sum(1 / s^2), sigma 1 / sqrt(sum(1 / s^2))."""
    weight = 1 / F.nullif(F.col(sigma) * F.col(sigma), F.lit(0.0))
    sums = maps.groupBy(*keys).agg(F.sum(F.col(value) * weight).alias("num"), F.sum(weight).alias("den"))
    return finalise(sums).drop("num", "den")


def noise_mask(maps: DataFrame, lowest: int = 100, factor: float = 8.0) -> DataFrame:
    """Pixels of a feed whose sigma is within factor times the mean of the feed's lowest ones.

    The lowest are ranked with a partial limit before the shuffle, then averaged and joined back.
    """
    order = Window.partitionBy("feed").orderBy("sigma", "dec_i", "ra_i", "sb", "chan")
    seen = maps.filter("sigma is not null")
    low = seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= lowest).groupBy("feed").agg(F.avg("sigma").alias("floor"))
    return seen.join(low, "feed").withColumn("keep", F.col("sigma") <= factor * F.col("floor"))


def difference_map(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Half the difference of two maps where both are seen, and its sigma."""
    b = b.select(*keys, F.col("map").alias("map_b"), F.col("sigma").alias("sigma_b"))
    both = a.select(*keys, "map", "sigma").join(b, keys)
    return both.select(*keys, ((F.col("map") - F.col("map_b")) / 2).alias("map"), (F.sqrt(F.col("sigma") ** 2 + F.col("sigma_b") ** 2) / 2).alias("sigma"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per group, the share of pixels that both maps see and the overlap of their weights."""
    w = 1 / (F.col("sigma") * F.col("sigma"))
    x, y = a.select(*keys, w.alias("wa")), b.select(*keys, w.alias("wb"))
    both = x.join(y, keys, "full")
    return both.groupBy(*by).agg(
        (F.count_if(F.col("wa").isNotNull() & F.col("wb").isNotNull()) / F.count("*")).alias("iou"),
        (F.sum(F.col("wa") * F.col("wb")) / F.nullif(F.sqrt(F.sum(F.col("wa") ** 2) * F.sum(F.col("wb") ** 2)), F.lit(0.0))).alias("weighted"),
    )


def noisy_channels(maps: DataFrame, factor: float = 8.0) -> DataFrame:
    """Mean sigma of each channel of a feed, and whether it is over `factor` times the mean of all pixels of all feeds."""
    channels = maps.filter("sigma is not null").groupBy("feed", "sb", "chan").agg(F.sum("sigma").alias("_s"), F.count("*").alias("_n"))
    whole = channels.agg((F.sum("_s") / F.sum("_n")).alias("_mean"))
    return channels.crossJoin(F.broadcast(whole)).select("feed", "sb", "chan", (F.col("_s") / F.col("_n")).alias("noise"), (F.col("_s") / F.col("_n") > factor * F.col("_mean")).alias("noisy"))


def significance(maps: DataFrame) -> DataFrame:
    return maps.withColumn("significance", F.col("map") / F.nullif("sigma", F.lit(0.0)))


def unweighted_map(tod: DataFrame, keys: list[str] = PIXEL) -> DataFrame:
    """Means and hits per pixel, every unmasked sample with the same weight."""
    return tod.filter("ok").groupBy(*keys).agg(F.avg("value").alias("map"), F.count("*").alias("nhit"))


def stack_levels(maps: DataFrame, pixel: list[str]) -> DataFrame:
    """Inverse-variance stacks of scans' maps (obsid, scan, feed, sb, pixel, map, sigma): by scan and by observation, and
    within each by band, by detector and as a whole, in one grouping-sets pass.

    level names the stack: 0 scan, feed and band; 1 scan and feed; 3 scan; 4 to 7 the same of observations.
    """
    w = 1 / F.nullif(F.col("sigma") ** 2, F.lit(0.0))
    rows = maps.withColumn("_w", w).withColumn("_n", F.col("map") * w)
    sets = [["obsid", *some, *pixel] for some in (["scan", "feed", "sb"], ["scan", "feed"], ["scan"], ["feed", "sb"], ["feed"], [])]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "obsid", "scan", "feed", "sb", *pixel).agg(
        F.sum("_n").alias("num"), F.sum("_w").alias("den"), (4 * F.grouping("scan") + 2 * F.grouping("feed") + F.grouping("sb")).cast("int").alias("level"),
    )
    return finalise(out).drop("num", "den")


def mean_correlation(pairs: DataFrame, by: list[str], samples: str) -> DataFrame:
    """Mean correlation of channel pairs over scans, weighted by their numbers of samples (by, a, b, corr)."""
    ok = pairs.filter(F.col("corr").isNotNull() & ~F.isnan("corr"))
    return ok.groupBy(*by, "a", "b").agg((F.sum(F.col("corr") * F.col(samples)) / F.nullif(F.sum(samples), F.lit(0))).alias("corr"), F.count("*").alias("scans"))
