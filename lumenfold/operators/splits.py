"""Splits of scans into halves: one pass sets the bits of all variables, quadrant by quadrant."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import ordered

#: Variables that split at the median of a statistic of the accepted rows of each detector and band. Fixed values.
MEDIAN_SPLITS = {
    "half": "mjd", "tsys": "tsys", "ambt": "airtemp", "dtmp": "dewtemp", "elev": "el", "wind": "windspeed", "hmty": "humidity", "pres": "pressure", "rain": "rain",
    "wthr": "weather", "sune": "sun_el", "modi": "moon_dist", "sudi": "sun_dist", "azmp": "az_amp", "fpol": "fknee_poly1", "fpoO": "fknee_poly0", "fpoI": "fknee_poly1",
    "apoO": "alpha_poly0", "apoI": "alpha_poly1", "spoO": "sigma_poly0", "spoI": "sigma_poly1", "pcaa": "pcsm", "s01f": "sigma_mean", "fk1f": "fknee_mean",
    "al1f": "alpha_mean", "gdi1": "galactic_center_dist_sl1", "gdi2": "galactic_center_dist_sl2", "gdi3": "galactic_center_dist_sl3", "gdi4": "galactic_center_dist_sl4",
}
#: Sidereal angles that part rising from setting, by field.
RISING = {"co2": 87.0, "co6": 290.0, "co7": 231.0}
#: The middle of a winter (modified Julian date).
MID_WINTER = 58863.0


def winter_distance(mjd: Column) -> Column:
    """Days from the nearest middle of a winter."""
    days = F.pmod(mjd - MID_WINTER, F.lit(365.0))
    return F.least(F.abs(days), F.abs(365 - days))


def median_statistic(name: str) -> Column:
    """The statistic whose median splits a variable's rows."""
    if name in MEDIAN_SPLITS:
        return F.col(MEDIAN_SPLITS[name])
    if name in ("gab1", "gab2", "gab3", "gab4"):
        return F.abs(F.col(f"galaxy_sl{name[-1]}_lat"))
    return {
        "widr": F.cos(F.radians("winddir")), "wint": winter_distance(F.col("mjd")), "npca": F.col("npca") + F.col("npcaf"), "obhf": F.floor(F.col("scanid") / 100).cast("double"),
        "dayn": F.col("night"), "sidr": F.col("sidereal"), "sid1": F.abs(F.col("sidereal") - 160), "sid2": F.abs(F.col("sidereal") - 200), "sid3": F.abs(F.col("sidereal") - 240),
    }[name]


#: Of these the median is taken over all detectors and bands together.
GLOBAL_SPLITS = ("dayn", "sidr", "sid1", "sid2", "sid3")


def sidereal_unwrapped(sidereal: Column, field: str) -> Column:
    """Sidereal angles of a field on one branch: those under 50 of the field that passes 360 come after it."""
    return F.when(sidereal < 50, sidereal + 360).otherwise(sidereal) if field == "co6" else sidereal


def fixed_split(name: str, field: str) -> Column | None:
    """Variables that need no statistics of other rows."""
    return {
        "odde": F.pmod(F.floor(F.col("scanid") / 100), F.lit(2)) == 1, "sdlb": F.col("saddlebag") > 2.5, "cesc": F.col("fbit") == 32, "snup": F.col("sun_el") > -5.0,
        "rise": sidereal_unwrapped(F.col("sidereal"), field) < RISING.get(field, 0.0),
    }.get(name)


def split_bits(rows: DataFrame, names: list[str], field: str, accepted: str = "accepted", by: tuple[str, ...] = ("feed", "sb"), seed: int = 0, key: str = "scanid") -> DataFrame:
    """`bits` of each row: bit 0 where it is accepted, bit n where it is in the upper half by the n-th name; 0 where it isn't accepted.

    All variables but elev are split within quadrants (elevation against the median of its detector
    and band, sidereal angle against the field's), so that halves are even in both. A value on the
    median is below; rows without a value are below too. Names that begin with rnd, in any case, and
    trtp are halves in a random order of hash(key, name, seed). Medians of all names come from two
    aggregates, which are joined back.
    """
    ok = rows.filter(accepted)
    el = ok.groupBy(*by).agg(F.percentile("el", F.lit(0.5)).alias("_el"))
    ok = ok.join(el, list(by)).withColumn("_quadrant", (F.col("el") < F.col("_el")).cast("int") * 2 + (sidereal_unwrapped(F.col("sidereal"), field) < RISING.get(field, 0.0)).cast("int"))
    drawn = [n for n in names if n.lower().startswith("rnd") or n == "trtp"]
    for n in drawn:  # as a number from 0 to 1, so that its median splits it as it does others
        ok = ok.withColumn(f"_d_{n}", F.pmod(F.xxhash64(F.col(key), F.lit(n), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    medians = {n: F.col(f"_d_{n}") if n in drawn else median_statistic(n) for n in names if fixed_split(n, field) is None}

    def of(some: list[str], groups: list[str]) -> DataFrame:
        return ok.groupBy(*groups).agg(*[F.percentile(medians[n], F.lit(0.5)).alias(f"_m_{n}") for n in some])

    whole = [n for n in medians if n == "elev"]
    every = [n for n in medians if n in GLOBAL_SPLITS]
    local = [n for n in medians if n not in whole and n not in every]
    for some, groups in ((local, [*by, "_quadrant"]), (whole, list(by)), (every, ["_quadrant"])):
        if some:
            ok = ok.join(of(some, groups), groups)
    bits = F.lit(1).cast("long")
    for place, n in enumerate(names, 1):
        upper = fixed_split(n, field)
        upper = medians[n] > F.col(f"_m_{n}") if upper is None else upper
        bits = bits.bitwiseOR(F.when(upper, F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long")))
    out = ok.select(key, *by, bits.alias("bits"))
    return rows.join(out, [key, *by], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))


def central_difference(rows: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """Half the difference of the two neighbours; one-sided at the ends; null where a stream has one sample."""
    w = ordered(by, at)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    ends = F.coalesce(after - F.col(value), F.col(value) - before)
    return rows.withColumn(out, F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(ends))


def temporal_splits(pointing: DataFrame, by: list[str], at: str, az: str) -> DataFrame:
    """Halves of a scan's samples: azdr by the direction of its motion, azmd by the side of its median,
    schf by time and azdi by the distance from its median. Null where a sample is in neither half.
    """
    mid = pointing.groupBy(*by).agg(F.percentile(az, F.lit(0.5)).alias("_mid"), F.count("*").alias("_n"))
    rows = central_difference(pointing, by, at, az, "_step").join(mid, by).withColumn("_far", F.abs(F.col(az) - F.col("_mid")))
    rows = rows.withColumn("_place", F.row_number().over(ordered(by, at)) - 1)
    rows = rows.join(rows.groupBy(*by).agg(F.percentile("_far", F.lit(0.5)).alias("_mid_far")), by)

    def half(lower: Column, upper: Column) -> Column:
        return F.when(lower, 0).when(upper, 1)

    return (
        rows.withColumn("azdr", half(F.col("_step") > 0, F.col("_step") < 0)).withColumn("azmd", half(F.col(az) < F.col("_mid"), F.col(az) > F.col("_mid")))
        .withColumn("schf", F.when(F.col("_place") < F.floor(F.col("_n") / 2), 0).otherwise(1))
        .withColumn("azdi", F.when(F.col("_far") <= F.col("_mid_far"), 0).otherwise(1)).drop("_step", "_mid", "_n", "_far", "_place", "_mid_far")
    )


def secondary_names(secondary: list[str], bins: int = 2) -> list[str]:
    return ["".join(f"{n}{b}" for n, b in zip(secondary, combo)) for combo in product(range(bins), repeat=len(secondary))]


def _with_bins(name: str, cross: list[str], bin_: int, secondary: list[str]) -> str:
    return "".join(f"{n}{bin_ if n in cross else name[i * 5 + 4]}" for i, n in enumerate(secondary))


def map_keys(bits: Column, order: list[str], primary: list[str], secondary: list[str], temporal: list[str] = ()) -> Column:
    """The maps that a scan goes to, as names primary + half + last secondary + half + ... + first secondary + half; empty if it isn't accepted.

    bits: of `split_bits`; order: names of its bits from 1. Variables in temporal halve samples instead of scans, so a scan goes to both
    their halves: each of those names stands with 0 and with 1, in every combination.
    """
    def half(name: str) -> Column:
        if name in temporal:
            return F.array(F.lit(f"{name}0"), F.lit(f"{name}1"))
        bit = F.shiftright(bits, order.index(name) + 1).bitwiseAND(F.lit(1)).cast("string")
        return F.array(F.concat(F.lit(name), bit))

    def all_of(names: list[str]) -> Column:
        out = F.array(F.lit(""))
        for name in names:
            out = _product(out, half(name))
        return out

    keys = F.flatten(F.array(*[all_of([p, *reversed(secondary)]) for p in primary]))
    return F.when(bits.bitwiseAND(F.lit(1)) == 1, keys).otherwise(F.array().cast("array<string>"))


def _product(heads: Column, tails: Column) -> Column:
    """Every head with every tail behind it."""
    return F.flatten(F.transform(heads, lambda head: F.transform(tails, lambda tail: F.concat(head, tail))))


def split_pairs(primary: list[str], secondary: list[str], cross: list[str], null_difference: bool = False) -> list[tuple]:
    """The pairs of split maps whose spectra are crossed, as names primary + bin + secondary + bin ....

    Where a primary variable is crossed: its two bins with each other, and each with itself, in every
    combination of the secondaries. Else the crossed secondaries' bins, and each with itself, in every
    bin of the primary; for null tests pairs of pairs, whose differences are crossed. Names are four
    characters long.
    """
    if any(p in cross for p in primary):
        out = []
        for p in (p for p in primary if p in cross):
            for name in secondary_names(secondary):
                out += [(f"{p}0{name}", f"{p}1{name}"), (f"{p}0{name}", f"{p}0{name}"), (f"{p}1{name}", f"{p}1{name}")]
        return out
    pairs = []
    for name in secondary_names(secondary):
        for a, b in ((0, 1), (0, 0), (1, 1)):
            pair = _with_bins(name, cross, a, secondary), _with_bins(name, cross, b, secondary)
            if pair not in pairs:
                pairs.append(pair)
    if null_difference:
        return [((f"{p}0{x}", f"{p}1{x}"), (f"{p}0{y}", f"{p}1{y}")) for p in primary for x, y in pairs]
    return [(f"{p}{b}{x}", f"{p}{b}{y}") for p in primary for b in range(2) for x, y in pairs]
