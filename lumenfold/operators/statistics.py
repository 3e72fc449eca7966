"""Statistics of scans as one product: noise levels, azimuth chi-squares, housekeeping, modes, side lobes, standing waves, and the long table of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pole of the galaxy (J2000) and the galactic longitude of the pole of the sky, degrees. Fixed values.
GALACTIC_POLE, POLE_LONGITUDE = (192.85948, 27.12825), 122.93192
#: Far side lobes: degrees off the axis, and their azimuths about it. Fixed values.
LOBE_ANGLE, LOBES = 65.0, (0.0, 180.0, 90.0, 270.0)


def thermal_noise(tsys: Column, width_hz: Column | float, rate_hz: Column | float) -> Column:
    """Noise of a sample from the system temperature: tsys / sqrt(width / rate); null where either is missing."""
    return tsys / F.sqrt(F.nullif((width_hz if isinstance(width_hz, Column) else F.lit(float(width_hz))) / rate_hz, F.lit(0.0)))


def azimuth_chi2(samples: DataFrame, by: list[str], chan: str, az: str, value: str, sigma0: str, bins: int = 15) -> DataFrame:
    """az_chi2, max_az_chi2 and med_az_chi2 of each group: chi-squares of channels over equal bins of azimuth.

    samples: unmasked ones, with their channel's noise. A bin's term is (sum of value / sigma0)^2 / hits; bins span the azimuths
    of the group's channel, the last one closed, and empty ones count 0. Sums are taken by channel and bin, and again by channel.
    """
    keys = [*by, chan]
    span = samples.groupBy(*keys).agg(F.min(az).alias("_lo"), F.max(az).alias("_hi"))
    bin_ = F.least(F.floor((F.col(az) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    cells = samples.join(span, keys).groupBy(*keys, F.coalesce(bin_, F.lit(0)).alias("_bin")).agg(F.sum(F.col(value) / F.nullif(sigma0, F.lit(0.0))).alias("_s"), F.count("*").alias("_n"))
    chi2 = ((F.sum(F.col("_s") ** 2 / F.col("_n")) - bins) / (2.0 * bins) ** 0.5).alias("_chi2")
    channels = cells.groupBy(*keys).agg(chi2)
    return channels.groupBy(*by).agg((F.sum("_chi2") / F.sqrt(F.count("_chi2").cast("double"))).alias("az_chi2"), F.max("_chi2").alias("max_az_chi2"), F.percentile("_chi2", F.lit(0.5)).alias("med_az_chi2"))


def housekeeping_means(readings: DataFrame, scans: DataFrame, by: list[str], names: list[str], block: float = 0.01) -> DataFrame:
    """Means of housekeeping readings (by, name, at, value) over each scan (by, scanid, start, stop), ends included: a column for each name.

    Readings and scans are dealt into blocks of time, in which they are joined.
    """
    spans = scans.select(*by, "scanid", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("stop") / block))).alias("_block"))
    rows = readings.withColumn("_block", F.floor(F.col("at") / block)).join(spans, [*by, "_block"]).filter(F.col("at").between(F.col("start"), F.col("stop")))
    return rows.groupBy("scanid").agg(*[F.avg(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def mode_statistics(amplitudes: DataFrame, spreads: DataFrame, by: list[str], radiometer: float) -> DataFrame:
    """npca, npcaf, pca1 to pca4, pcf1, pcf2 and pcsm of each band: how many modes were taken, and how strong they were in percent of noise.

    amplitudes: by, kind (pca: of a scan, pcf: of a detector), mode (from 1), chan and amplitude; spreads: by without the band, kind,
    mode and spread (of the mode's samples). A mode's strength is 100 mean |amplitude| spread / radiometer, over channels that have
    one; pcsm sums the first four of both kinds.
    """
    scan = [c for c in by if c in spreads.columns]
    size = amplitudes.groupBy(*by, "kind", "mode").agg(F.avg(F.abs("amplitude")).alias("_a"))
    each = size.join(spreads, [*scan, "kind", "mode"], "left").withColumn("_p", 100 * F.col("_a") * F.abs("spread") / radiometer)

    def of(kind: str, mode: int) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("mode") == mode), F.col("_p")))

    return each.groupBy(*by).agg(
        F.count_if(F.col("kind") == "pca").alias("npca"), F.count_if(F.col("kind") == "pcf").alias("npcaf"),
        *[F.coalesce(of("pca", m), F.lit(0.0)).alias(f"pca{m}") for m in (1, 2, 3, 4)], *[F.coalesce(of("pcf", m), F.lit(0.0)).alias(f"pcf{m}") for m in (1, 2)],
        F.coalesce(F.sum(F.when(F.col("mode") <= 4, F.col("_p"))), F.lit(0.0)).alias("pcsm"),
    )


def _turned(lon: Column, lat: Column, about_z: Column, down: Column) -> tuple[Column, Column]:
    """A direction, in degrees, tilted from the pole by `down` and then turned about it by `about_z`."""
    a, d, t = F.radians(lon), F.radians(lat), F.radians(down)
    x, y, z = F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)
    x, z = x * F.cos(t) + z * F.sin(t), z * F.cos(t) - x * F.sin(t)
    return F.pmod(F.degrees(F.atan2(y, x)) + about_z, F.lit(360.0)), F.degrees(F.asin(F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0))))


def sky_of(az: Column, alt: Column, sidereal: Column, latitude: float) -> tuple[Column, Column]:
    """Right ascension and declination of a horizontal direction (azimuth from north over east), at a local sidereal angle; all degrees, no refraction or precession."""
    a, h, p = F.radians(az), F.radians(alt), F.radians(F.lit(latitude))
    dec = F.asin(F.least(F.greatest(F.sin(h) * F.sin(p) + F.cos(h) * F.cos(p) * F.cos(a), F.lit(-1.0)), F.lit(1.0)))
    hour = F.atan2(-F.sin(a) * F.cos(h), F.sin(h) * F.cos(p) - F.cos(h) * F.sin(p) * F.cos(a))
    return F.pmod(sidereal - F.degrees(hour), F.lit(360.0)), F.degrees(dec)


def galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Galactic longitude and latitude, degrees."""
    a, d, p = F.radians(ra - GALACTIC_POLE[0]), F.radians(dec), F.radians(F.lit(GALACTIC_POLE[1]))
    lat = F.asin(F.least(F.greatest(F.sin(d) * F.sin(p) + F.cos(d) * F.cos(p) * F.cos(a), F.lit(-1.0)), F.lit(1.0)))
    lon = F.atan2(F.cos(d) * F.sin(a), F.sin(d) * F.cos(p) - F.cos(d) * F.sin(p) * F.cos(a))
    return F.pmod(POLE_LONGITUDE - F.degrees(lon), F.lit(360.0)), F.degrees(lat)


def side_lobes(rows: DataFrame, az: str, alt: str, sidereal: str, latitude: float) -> DataFrame:
    """rows with galaxy_sl1_lon, galaxy_sl1_lat and galactic_center_dist_sl1, and so on for the four far side lobes, from mean pointing."""
    out = {}
    for k, around in enumerate(LOBES, 1):
        at = _turned(F.lit(around), F.lit(90 - LOBE_ANGLE), F.col(az), 90 - F.col(alt))
        lon, lat = galactic(*sky_of(*at, F.col(sidereal), latitude))
        far = F.acos(F.least(F.greatest(F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.lit(-1.0)), F.lit(1.0)))
        out |= {f"galaxy_sl{k}_lon": lon, f"galaxy_sl{k}_lat": lat, f"galactic_center_dist_sl{k}": F.degrees(far)}
    return rows.withColumns(out)


def with_standing_waves(rows: DataFrame, waves: DataFrame, count: int = 14) -> DataFrame:
    """rows (scanid, feed) with sw_01, sw_02, ... of a table by obsid, scan number (from 0) and feed; null where it has none. An observation's first scan is number 02."""
    names = [f"sw_{k:02d}" for k in range(1, count + 1)]
    placed = rows.withColumn("_obsid", F.floor(F.col("scanid") / 100)).withColumn("_scan", F.col("scanid") % 100 - 2)
    there = waves.select(F.col("obsid").alias("_obsid"), F.col("scan").alias("_scan"), "feed", *names)
    return placed.join(there, ["_obsid", "_scan", "feed"], "left").drop("_obsid", "_scan")


def long_statistics(keys: list[str], *tables: DataFrame) -> DataFrame:
    """Tables of statistics by the same keys as one: keys, statistic and value. Tables that are long already (statistic, value) are taken as they are."""
    out = None
    for table in tables:
        if "statistic" not in table.columns:
            names = [c for c in table.columns if c not in keys]
            table = table.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "statistic", "value")
        rows = table.select(*keys, "statistic", F.col("value").cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def wide_statistics(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and a column for each of names; null where a row has no such statistic."""
    return rows.groupBy(*keys).pivot("statistic", names).agg(F.max("value"))
