"""Scans: their catalogue, lookups of calibration, weather and detectors, and the statistics of each scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import circular_mean

#: Bits of a scan's type, in the order in which the first that is set names it. Fixed values.
SCAN_TYPES = ((4, "circ"), (5, "ces"), (7, "stationary"), (15, "liss"))
#: Feeds of the four groups of five. Fixed values.
SADDLEBAGS = ((1, 4, 5, 12, 13), (6, 14, 15, 16, 17), (2, 7, 18, 19, 20), (3, 8, 9, 10, 11))
#: The feature word of a calibration, and the bit of an engineering run. Fixed values.
CALIBRATION, ENGINEERING = 8192, 10


def slice_scan(tod: DataFrame, at: str, start: float, stop: float, feed: str, feeds: list[int]) -> DataFrame:
    """Samples of some detectors within [start, stop]; both reach the scan of the files."""
    return tod.filter(F.col(at).between(start, stop) & F.col(feed).isin(feeds))


def scan_type(bits: Column) -> Column:
    """The name of the first type bit that is set, else null."""
    out = F.lit(None).cast("string")
    for bit, name in reversed(SCAN_TYPES):
        out = F.when(bits.bitwiseAND(F.lit(1 << bit)) != 0, name).otherwise(out)
    return out


def judge_scans(scans: DataFrame, fields: list[str], allowed: int, first: int, last: int, excluded: DataFrame, min_seconds: float, trim: tuple[float, float] = (0.0, 1.0), reach: int = 1000) -> DataFrame:
    """Every scan with `verdict`: why it goes (the first reason that holds), or "kept", and its trimmed start and stop.

    Reasons: field, obsid (outside first..last or in an excluded range), type, length. Excluded ranges
    are dealt into blocks of `reach` ids, so that an equi-join finds them. trim: seconds off both ends.
    """
    start, stop = F.col("mjd_start") + trim[0] / 86400, F.col("mjd_stop") - trim[1] / 86400
    obsid = F.floor(F.col("scanid") / 100).cast("long")
    blocks = excluded.select("first", "last", F.explode(F.expr(f"sequence(first div {reach}, last div {reach})")).alias("_block"))
    rows = scans.withColumn("_obsid", obsid).withColumn("_block", F.expr(f"_obsid div {reach}"))
    hit = rows.join(blocks, "_block").filter(F.col("_obsid").between(F.col("first"), F.col("last"))).select("scanid").distinct().withColumn("_hit", F.lit(True))
    verdict = (
        F.when(~F.col("field").isin(fields), "field").when(~F.col("_obsid").between(first, last) | F.col("_hit"), "obsid")
        .when(F.col("scantype").bitwiseAND(F.lit(allowed)) == 0, "type").when((stop - start) * 86400 <= min_seconds, "length").otherwise("kept")
    )
    return rows.join(hit, "scanid", "left").select(*scans.columns, start.alias("start"), stop.alias("stop"), verdict.alias("verdict"))


def shuffled_part(scans: DataFrame, key: str, part: int, parts: int, seed: int = 42) -> DataFrame:
    """The part-th of `parts` groups of scans, dealt by a hash of the key and a seed: the same on every run, no sort."""
    return scans.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts)) == part)


def usable_scans(scans: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Scans that have an accept row with a band accepted and aren't an observation's first (number 02)."""
    good = accepted.filter("accepted").select(key).distinct()
    return scans.join(good, key, "left_semi").filter(F.col(key) % 100 != 2)


def decode_feature(feature: Column) -> Column:
    """The lowest bit that is set in a feature word, as a number; -1 for none."""
    return F.when(feature == 0, -1).otherwise(F.bit_count(feature.bitwiseAND(-feature) - 1))


def usable_observations(ranges: DataFrame, obsid: str, order: str, feature: str) -> DataFrame:
    """Observations that begin and end with a calibration and whose second range isn't an engineering run's."""
    at = F.struct(order, feature)
    placed = ranges.withColumn("_place", F.row_number().over(Window.partitionBy(obsid).orderBy(order)))
    facts = placed.groupBy(obsid).agg(
        F.min(at)[feature].alias("first"), F.max(at)[feature].alias("last"), F.max(F.when(F.col("_place") == 2, F.col(feature))).alias("second"), F.count("*").alias("ranges"),
    )
    tested = F.coalesce(F.col("second").bitwiseAND(F.lit(1 << ENGINEERING)) != 0, F.lit(False))
    return facts.filter((F.col("first") == CALIBRATION) & (F.col("last") == CALIBRATION) & ~tested).select(obsid, "ranges")


def every_feed(rows: DataFrame, by: list[str], feed: str, feeds: int = 20) -> DataFrame:
    """rows with one row for each of the feeds 1 to `feeds` per group; what wasn't there is null."""
    whole = rows.select(*by).distinct().withColumn(feed, F.explode(F.sequence(F.lit(1), F.lit(feeds))))
    return whole.join(rows, [*by, feed], "left")


def saddlebag(feed: Column) -> Column:
    out = F.lit(None).cast("int")
    for bag, feeds in enumerate(SADDLEBAGS, 1):
        out = F.when(feed.isin(*feeds), bag).otherwise(out)
    return out


def calibration_at(scans: DataFrame, calibration: DataFrame, by: list[str], at: str) -> DataFrame:
    """Load power and temperature at each scan's centre: between an observation's two calibrations by a line,
    from the one that worked where the other didn't, else null with `n_cal` 0.

    calibration: by, slot (0 or 1), time, p_hot, t_hot, ok.
    """
    def of(slot: int, name: str) -> Column:
        return F.max(F.when((F.col("slot") == slot) & F.col("ok"), F.col(name))).alias(f"{name}_{slot}")

    wide = calibration.groupBy(*by).agg(*[of(s, n) for s in (0, 1) for n in ("time", "p_hot", "t_hot")])
    rows = scans.join(wide, by, "left")
    share = (F.col(at) - F.col("time_0")) / F.nullif(F.col("time_1") - F.col("time_0"), F.lit(0.0))

    def between(name: str) -> Column:
        a, b = F.col(f"{name}_0"), F.col(f"{name}_1")
        return F.when(a.isNotNull() & b.isNotNull(), a + (b - a) * share).otherwise(F.coalesce(a, b))

    n = F.col("time_0").isNotNull().cast("int") + F.col("time_1").isNotNull().cast("int")
    return rows.select(*scans.columns, between("p_hot").alias("p_hot"), between("t_hot").alias("t_hot"), n.alias("n_cal"))


def bucket_forecast(scans: DataFrame, forecast: DataFrame, by: list[str], start: str, stop: str, first: str, minutes: float = 10.0) -> DataFrame:
    """The larger forecast of the buckets of `minutes` in which a scan starts and stops, counted from `first`.

    Places beyond the last bucket take the last. forecast: by, bucket, value.
    """
    last = forecast.groupBy(*by).agg(F.max("bucket").alias("_last"))
    rows = scans.join(last, by, "left")

    def at(time: str) -> Column:
        return F.least(F.greatest(F.floor((F.col(time) - F.col(first)) * (1440 / minutes)), F.lit(0)), F.col("_last")).cast("int")

    rows = rows.withColumn("_a", at(start)).withColumn("_b", at(stop))
    for place in ("_a", "_b"):
        rows = rows.join(forecast.select(*by, F.col("bucket").alias(place), F.col("value").alias(f"_v{place}")), [*by, place], "left")
    return rows.withColumn("weather", F.greatest("_v_a", "_v_b")).drop("_a", "_b", "_v_a", "_v_b", "_last")


def listed(rows: DataFrame, table: DataFrame, by: list[str], name: str) -> DataFrame:
    """Whether a row's keys are in a table, as `name` (0 or 1)."""
    return rows.join(table.select(*by).distinct().withColumn(name, F.lit(1)), by, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def imported_mask(channels: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """channels with `kept` cleared where another run's mask (by, kept) has it cleared; what it lacks stays."""
    rows = channels.join(other.select(*by, F.col("kept").alias("_other")), by, "left")
    return rows.withColumn("kept", F.col("kept") & F.coalesce("_other", F.lit(True))).drop("_other")


def scan_facts(scans: DataFrame) -> DataFrame:
    """obsid, middle (MJD), minutes, feature and the group of the detector of every row of scanid, mjd_start, mjd_stop, scantype, feed."""
    return scans.select(
        "scanid", "feed", F.floor(F.col("scanid") / 100).cast("long").alias("obsid"), ((F.col("mjd_start") + F.col("mjd_stop")) / 2).alias("mjd"),
        ((F.col("mjd_stop") - F.col("mjd_start")) * 1440).alias("minutes"), F.col("scantype").alias("fbit"), saddlebag(F.col("feed")).alias("saddlebag"),
    )


def pointing_facts(pointing: DataFrame, scans: DataFrame, by: list[str], at: str, az: str, el: str, block: float = 0.01) -> DataFrame:
    """Mean azimuth and elevation and the spread of elevation of the samples within (start, stop] of each scan.

    Samples and scans meet in blocks of time: a scan in blocks of `block`, doubled until it stands in two at most, so that a long one
    is no more rows than a short one; samples in blocks of the lengths that the scans of their detector have.
    """
    length = F.col("stop") - F.col("start")
    level = F.greatest(F.ceil(F.log2(length / block)), F.lit(0)).cast("int")
    spans = scans.select(*by, "scanid", "start", "stop", level.alias("_level")).withColumn("_size", F.pow(F.lit(2.0), "_level") * block)
    spans = spans.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / F.col("_size")), F.floor(F.col("stop") / F.col("_size")))))
    levels = spans.groupBy(*by).agg(F.collect_set("_level").alias("_levels"))
    rows = pointing.join(levels, by).withColumn("_level", F.explode("_levels")).withColumn("_block", F.floor(F.col(at) / (F.pow(F.lit(2.0), "_level") * block)))
    rows = rows.drop("_levels").join(spans.drop("_size"), [*by, "_level", "_block"]).filter((F.col(at) > F.col("start")) & (F.col(at) <= F.col("stop")))
    return rows.groupBy("scanid").agg(circular_mean(F.col(az)).alias("mean_az"), F.avg(el).alias("mean_el"), F.stddev_pop(el).alias("std_el"), F.count("*").alias("n"))


def masked_means(channels: DataFrame, by: list[str], columns: list[str], kept: str = "kept") -> DataFrame:
    """Means of channel statistics over unmasked channels, and the share of those."""
    means = [F.avg(F.when(F.col(kept), F.col(c))).alias(c) for c in columns]
    return channels.groupBy(*by).agg(F.avg(F.col(kept).cast("double")).alias("accept_rate"), *means)


def band_chi2(channels: DataFrame, by: list[str], chi2: str, kept: str = "kept") -> DataFrame:
    """Sum, largest and median of channels' chi-squares over unmasked channels; the sum over the root of their number."""
    value = F.when(F.col(kept), F.col(chi2))
    return channels.groupBy(*by).agg(
        (F.sum(value) / F.nullif(F.sqrt(F.count(value).cast("double")), F.lit(0.0))).alias("chi2"), F.max(value).alias("max_chi2"), F.percentile(value, F.lit(0.5)).alias("median_chi2"),
    )


def mode_amplitude(channels: DataFrame, by: list[str], amplitude: str, spread: Column, radiometer: float, kept: str = "kept") -> DataFrame:
    """100 sqrt(mean(|a|)^2 spread^2 / radiometer^2) over unmasked channels: how strong a subtracted mode was, in percent of noise."""
    size = F.avg(F.when(F.col(kept), F.abs(amplitude)))
    return channels.groupBy(*by).agg((100 * F.sqrt(size**2 * F.max(spread) ** 2 / radiometer**2)).alias("amplitude"))


def sidelobe_score(az: Column, el: Column, body_az: Column, body_el: Column) -> tuple[Column, Column]:
    """Distance and position angle (degrees) of a body from where the telescope points: the body's
    direction turned into the frame in which the beam is the pole."""
    a, e, b, h = (F.radians(x) for x in (az, el, body_az, body_el))
    x = F.cos(h) * F.cos(b - a) * F.sin(e) - F.sin(h) * F.cos(e)
    y = F.cos(h) * F.sin(b - a)
    z = F.cos(h) * F.cos(b - a) * F.cos(e) + F.sin(h) * F.sin(e)
    return F.degrees(F.acos(F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0)))), F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def summary(scans: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Counts and means of a field's scans by detector, with a row for every detector: the summary of a reduction."""
    means = scans.groupBy(*by, "feed").agg(F.count("*").alias("scans"), *[F.avg(c).alias(c) for c in columns])
    return every_feed(means, by, "feed").withColumn("scans", F.coalesce("scans", F.lit(0)))


def accept_trace(judged: DataFrame, keys: list[str], order: str, weight: str, total: float | None = None) -> DataFrame:
    """Share of all bands that is still accepted after each statistic in order: `order` and accept_rate; of `total`, or of all weights.

    The first statistic that rejects a band is a minimum, so bands are summed by it and accumulated
    over the statistics, of which there are few.
    """
    first = judged.groupBy(*keys).agg(F.min(F.when(F.col("rejected"), F.col(order))).alias("_out"), F.max(weight).alias("_w"))
    lost = first.groupBy("_out").agg(F.sum("_w").alias("_lost"))
    stats = judged.select(order).distinct()
    sums = stats.join(lost, F.col("_out") > F.col(order), "left").groupBy(order).agg(F.sum("_lost").alias("_later"))
    whole = lost.agg(F.sum(F.when(F.col("_out").isNull(), F.col("_lost"))).alias("_never"), F.sum("_lost").alias("_all"))
    total = F.col("_all") if total is None else total
    return sums.crossJoin(F.broadcast(whole)).select(order, ((F.coalesce("_later", F.lit(0.0)) + F.coalesce("_never", F.lit(0.0))) / total).alias("accept_rate"))
