"""Channel masks: range, running medians, aliasing, noise, correlation boxes and stripes, with reason bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.settled import settled
from .series import ordered

#: Reasons by bit.
REASONS = (
    "not finite", "marked", "no calibration", "not calibrated", "below range", "above running median", "aliasing", "radiometer", "correlated", "lonely", "band almost masked",
    "box 32 chi2", "box 32 prod", "box 32 sum", "box 128 chi2", "box 128 prod", "box 128 sum", "box 512 chi2", "box 512 prod", "box 512 sum",
    "stripe 32 chi2", "stripe 32 prod", "stripe 128 chi2", "stripe 128 prod", "stripe 1024 chi2", "stripe 1024 prod", "imported",
)


def reason(name: str) -> int:
    return 1 << REASONS.index(name)


def flag(channels: DataFrame, bad: Column, name: str) -> DataFrame:
    """channels with `kept` cleared and the bit of a reason set where `bad` is true. Bits are OR-ed, never added."""
    bad = F.coalesce(bad, F.lit(False))
    bits = F.when(bad, F.col("reason").bitwiseOR(F.lit(reason(name)).cast("long"))).otherwise(F.col("reason"))
    return channels.withColumn("_bad", bad).withColumn("reason", bits).withColumn("kept", F.col("kept") & ~F.col("_bad")).drop("_bad")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def count_not_finite(tod: DataFrame, by: list[str], value: str) -> DataFrame:
    """Samples that are null, not a number or infinite, per channel."""
    return tod.groupBy(*by).agg(F.count_if(~finite(F.col(value))).alias("n_bad"), F.count("*").alias("n"))


def marked(feed: Column, sb: Column, chan: Column, channels: int = 1024, last: int = 179) -> Column:
    """Channels that are always masked, numbered as they were read. Fixed values."""
    odd = feed.isin(4, 10) & (((sb == 2) & (chan >= 952)) | ((sb == 3) & (chan < 72)))
    return (chan < 2) | (chan == channels // 2) | (sb.isin(0, 1) & (chan >= channels - last)) | odd


def upward_bands(freqs: DataFrame, sb: str = "sb", chan: str = "chan", freq: str = "freq") -> DataFrame:
    """Channels renumbered so that frequencies rise: sb, chan, flipped, lo, hi and centre (the mean of its edges).

    A channel reaches from its frequency to that of the next one read; the last by the step of the first two.
    """
    first = freqs.groupBy(sb).agg((F.max(F.when(F.col(chan) == 1, F.col(freq))) - F.max(F.when(F.col(chan) == 0, F.col(freq)))).alias("_step"), F.max(chan).alias("_top"))
    edge = F.coalesce(F.lead(freq).over(ordered([sb], chan)), F.col(freq) + F.col("_step"))
    out = freqs.join(first, sb).withColumn("_edge", edge).withColumn("flipped", F.col("_step") < 0)
    renumbered = F.when(F.col("flipped"), F.col("_top") - F.col(chan)).otherwise(F.col(chan))
    return out.select(
        sb, renumbered.alias(chan), "flipped", F.least(freq, "_edge").alias("lo"), F.greatest(freq, "_edge").alias("hi"), ((F.col(freq) + F.col("_edge")) / 2).alias("centre"),
    )


def low_band(centres: DataFrame, centre: str, first: float, width: float, bins: int) -> DataFrame:
    """Low-resolution bin of each channel, its centre strictly inside: channels on an edge belong to none."""
    at = (F.col(centre) - first) / (width / bins)
    inside = (at > 0) & (at < bins) & (at != F.floor(at))
    return centres.withColumn("low", F.when(inside, F.floor(at).cast("int")))


def running_median_mask(rows: DataFrame, by: list[str], at: str, value: str, lo: float, hi: float, widths: tuple[int, int] = (400, 150), cut: float = 5.0) -> DataFrame:
    """`kept` is false out of [lo, hi] and above running medians: first by cut + 10 in the wide window, then,
    without what that took, by cut in the narrow one. Windows of a fifth good values or fewer have median 0.
    Null values stay kept: another mask takes them.
    """
    left = rows.withColumn("_v", F.when(F.col(value).between(lo, hi), F.col(value)))
    for width, above in ((widths[0], cut + 10), (widths[1], cut)):
        window = ordered(by, at).rowsBetween(-(width // 2), width // 2 - 1)
        median = F.when(F.count("_v").over(window) > width // 5, F.percentile("_v", F.lit(0.5)).over(window)).otherwise(0.0)
        left = left.withColumn("_m", median).withColumn("_v", F.when(F.col("_v") <= F.col("_m") + above, F.col("_v"))).drop("_m")
    return left.withColumn("kept", F.col("_v").isNotNull() | F.col(value).isNull()).drop("_v")


def aliasing_bad(channels: DataFrame, table: DataFrame, by: list[str], obsid: str, until: int, least: float = 15.0) -> DataFrame:
    """`aliased` where a suppression in the table is under `least` dB; only observations before `until` have a table."""
    rows = channels.join(table.select(*by, "ab", "leak"), by, "left")
    bad = (F.col(obsid) < until) & ((F.col("ab") < least) | (F.col("leak") < least))
    return rows.withColumn("aliased", F.coalesce(bad, F.lit(False))).drop("ab", "leak")


def radiometer_bad(tod: DataFrame, by: list[str], value: str, width_hz: float, seconds: float, most: float = 1.15) -> DataFrame:
    """Channels whose variance is above that of `most` times the radiometer noise."""
    limit = (most / (width_hz * seconds) ** 0.5) ** 2
    return tod.groupBy(*by).agg(F.var_pop(value).alias("variance")).withColumn("noisy", F.col("variance") > limit)


def strongest_correlation(pairs: DataFrame, by: list[str], most: float = 0.1) -> DataFrame:
    """Per channel its largest |corr| with channels that aren't its neighbours, and whether that is over `most`.

    pairs: by, a, b, corr, each pair once.
    """
    far = pairs.filter(F.abs(F.col("a") - F.col("b")) > 1)
    both = far.select(*by, F.col("a").alias("chan"), "corr").unionByName(far.select(*by, F.col("b").alias("chan"), "corr"))
    return both.groupBy(*by, "chan").agg(F.max(F.abs("corr")).alias("strongest")).withColumn("correlated", F.col("strongest") > most)


def mask_thin_bands(channels: DataFrame, by: list[str], least: float = 0.1) -> DataFrame:
    """A band with `least` of its channels kept or fewer loses them all; only those get the reason's bit."""
    share = F.avg(F.col("kept").cast("double")).over(Window.partitionBy(*by))
    return flag(channels.withColumn("_share", share), F.col("kept") & (F.col("_share") <= least), "band almost masked").drop("_share")


def accept_rate(channels: DataFrame, by: list[str]) -> DataFrame:
    return channels.groupBy(*by).agg(F.avg(F.col("kept").cast("double")).alias("accept_rate"), F.count("*").alias("channels"))


def _panels(rows: DataFrame, by: list[str], samples: str, width: int, halo: int) -> DataFrame:
    """Channels (at their places `_at` of `_of`) in panels of places, repeated for each two panels _i, _j that meet: `_row` as a row of i's, else as a column of j's.

    A group has eight panels, or as many as hold 65,536 channels each, of multiples of `width`; columns reach `halo` beyond their panel.
    """
    wide = F.greatest(F.lit(1), F.least(F.ceil(F.col("_of") / (8 * width)), F.lit(max(1, 65536 // width)))) * width
    rows = rows.withColumn("_wide", wide).withColumn("_all", F.expr("sequence(0L, (_of - 1) div _wide)")).withColumn("_own", F.expr("_at div _wide"))
    keep = [*by, "_at", "_of", "_wide", "kept", samples]
    as_rows = rows.select(*keep, F.lit(True).alias("_row"), F.col("_own").alias("_i"), F.explode("_all").alias("_j"))
    near = F.expr(f"if(_own > 0 and _at % _wide < {halo}, array(_own, _own - 1), array(_own))")
    as_columns = rows.withColumn("_j", F.explode(near)).select(*keep, F.lit(False).alias("_row"), F.explode("_all").alias("_i"), "_j")
    return as_rows.unionByName(as_columns)


def _strips(group: pd.DataFrame, samples: str, size: int, halo: int):
    """Correlations of a row panel with a column panel, strip by strip of whole multiples of `size` rows: first row, first column, matrix with 0 for neighbours and what is masked."""
    wide, of, i, j = (int(group[c].iloc[0]) for c in ("_wide", "_of", "_i", "_j"))
    sides = []
    for row, lo, hi in ((True, i * wide, (i + 1) * wide), (False, j * wide, (j + 1) * wide + halo)):
        side = group[group["_row"] == row]
        m = np.stack([np.asarray(s, dtype=float) for s in side[samples]])
        m = m - m.mean(axis=1, keepdims=True)
        length = np.sqrt((m * m).sum(axis=1))
        z = np.zeros((min(hi, of) - lo, m.shape[1]))
        z[side["_at"].to_numpy() - lo] = m / np.where((length > 0) & side["kept"].to_numpy(dtype=bool), length, np.inf)[:, None]
        sides.append(z)
    high = size * max(1, 512 // size)
    columns = np.arange(len(sides[1])) + j * wide
    for k in range(0, len(sides[0]), high):
        c = sides[0][k : k + high] @ sides[1].T
        first = i * wide + k
        if first - 1 <= columns[-1] and columns[0] <= first + len(c):
            c[np.abs(np.arange(first, first + len(c))[:, None] - columns[None, :]) <= 1] = 0
        yield first, j * wide, c


def _box_hits(group: pd.DataFrame, samples: str, size: int, jump: int, limits: tuple, times: int) -> list[tuple[int, str]]:
    """Boxes off the diagonal that are too strong: each box's number on either side, and the test."""
    hits, of = set(), int(group["_of"].iloc[0])
    for first, begin, c in _strips(group, samples, size, 0):
        n, m = (min(len(c), of // size * size - first) // size, min(c.shape[1], of // size * size - begin) // size)
        if n <= 0 or m <= 0:
            continue
        boxes = c[: n * size, : m * size].reshape(n, size, m, size)
        prod = boxes[:, :-jump:2] * boxes[:, jump::2]
        dof, n_prod = np.maximum((boxes != 0).sum(axis=(1, 3)), 1), np.maximum((prod != 0).sum(axis=(1, 3)), 1)
        strong = {"chi2": ((boxes**2).sum(axis=(1, 3)) * times - dof) / np.sqrt(2 * dof) > limits[0], "prod": prod.sum(axis=(1, 3)) * times / np.sqrt(n_prod) > limits[1]}
        strong["sum"] = np.abs(boxes.sum(axis=(1, 3))) * np.sqrt(times / dof) > limits[2]
        upper = (first // size + np.arange(n))[:, None] < (begin // size + np.arange(m))[None, :]
        for test, bad in strong.items():
            p, q = np.nonzero(bad & upper)
            hits |= {(int(x), test) for x in first // size + p} | {(int(x), test) for x in begin // size + q}
    return sorted(hits)


def _stripe_sums(group: pd.DataFrame, samples: str, size: int, jump: int) -> list[tuple]:
    """Of each stripe of rows, over the panel's columns: squares, numbers that aren't 0, products of columns `jump` apart, and those that aren't 0."""
    out, of, wide = [], int(group["_of"].iloc[0]), int(group["_wide"].iloc[0])
    for first, begin, c in _strips(group, samples, size, jump):
        n = min(len(c), of // size * size - first) // size
        if n <= 0:
            continue
        c = c[: n * size]
        if begin < size:  # as if each stripe began the diagonal
            c[np.tile(np.arange(size), n)[:, None] >= (begin + np.arange(c.shape[1]))[None, :]] = 0
        own = min(wide, of - begin)
        even = np.arange(begin % 2, min(own, c.shape[1] - jump), 2)
        prod, square = c[:, even] * c[:, even + jump], c[:, :own]
        sums = [x.reshape(n, -1).sum(axis=1) for x in (square**2, square != 0, prod, prod != 0)]
        out += zip(first // size + np.arange(n), *sums)
    return out


def mask_correlated(
    rows: DataFrame, by: list[str], chan: str, samples: str, jump: int = 16, most: float = 0.1, boxes=(32, 128, 512), stripes=(32, 128, 1024),
    box_limits=((16.0, 5.0, 9.0), (4.8, 4.2, 8.0), (5.2, 3.1, 3.8)), stripe_limits=((9.0, 3.5), (6.0, 3.0), (7.0, 2.5)),
) -> DataFrame:
    """Half-bands of channels (samples at unmasked times; kept, reason) after box, stripe and largest-correlation masks: by, chan, kept, reason, strongest.

    Masked are channels whose correlations are too strong in a box off the diagonal or in a stripe: by chi-square, by products of
    neighbouring lines, and in boxes by their sum. Limits are in standard deviations, by size: (chi2, product, sum) and (chi2,
    product). What one size takes is 0 for the next; sizes that no group holds take nothing. Neighbouring channels never count, nor do masked ones.

    A group's channels lie in panels, each two of which meet in one task; a matrix is there in strips only, and what it comes to
    (by box or stripe) is written before the next size. So groups may have any number of channels.
    """
    width = int(np.lcm.reduce([*boxes, *stripes, 2]))
    w = Window.partitionBy(*by)
    base = settled(rows.select(*by, chan, F.col(samples).alias("_s"), "kept", F.col("reason").cast("long").alias("reason"), (F.row_number().over(w.orderBy(chan)) - 1).cast("long").alias("_at"), F.count("*").over(w).alias("_of")))
    fields = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    state = base.select(*by, "_at", "kept", "reason")

    def met(halo: int, ordered_pairs: bool) -> DataFrame:
        both = _panels(base.drop("kept", "reason").join(state, [*by, "_at"]), by, "_s", width, halo)
        return (both.filter("_i <= _j") if ordered_pairs else both).groupBy(*by, "_i", "_j")

    def keyed(group: pd.DataFrame, found: list, columns: list[str]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=columns)
        for name in reversed(by):
            out.insert(0, name, pd.Series([group[name].iloc[0]] * len(out), dtype=object))
        return out

    def largest(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for first, begin, c in _strips(group, "_s", 1, 0):
            c = np.abs(c)
            found += [*zip(range(first, first + len(c)), c.max(axis=1)), *zip(range(begin, begin + c.shape[1]), c.max(axis=0))]
        return keyed(group, found, ["_at", "strongest"])

    strongest = settled(met(0, True).applyInPandas(largest, f"{fields}_at long, strongest double").groupBy(*by, "_at").agg(F.max("strongest").alias("strongest")))

    def bit(kind: str, size: int, test: str) -> int:
        name = f"{kind} {size} {test}"
        return reason(name) if name in REASONS else 0

    def box_stage(size: int, limits: tuple) -> DataFrame:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            found = _box_hits(group, "_s", size, jump, limits, len(group["_s"].iloc[0]))
            return keyed(group, [(x, bit("box", size, test)) for x, test in found], ["_block", "_bit"])

        return met(0, True).applyInPandas(run, f"{fields}_block long, _bit long")

    def stripe_stage(size: int, limits: tuple) -> DataFrame:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            times = len(group["_s"].iloc[0])
            return keyed(group, [(*x, times) for x in _stripe_sums(group, "_s", size, jump)], ["_block", "s", "dof", "p", "n", "times"])

        sums = met(jump, False).applyInPandas(run, f"{fields}_block long, s double, dof long, p double, n long, times long").groupBy(*by, "_block")
        sums = sums.agg(F.sum("s").alias("s"), F.greatest(F.sum("dof"), F.lit(1)).alias("dof"), F.sum("p").alias("p"), F.greatest(F.sum("n"), F.lit(1)).alias("n"), F.max("times").alias("times"))
        tests = {"chi2": (F.col("s") * F.col("times") - F.col("dof")) / F.sqrt(2.0 * F.col("dof")) > limits[0], "prod": F.col("p") * F.col("times") / F.sqrt(F.col("n").cast("double")) > limits[1]}
        bits = F.array_compact(F.array(*[F.when(bad, F.lit(bit("stripe", size, test)).cast("long")) for test, bad in tests.items()]))
        return sums.select(*by, "_block", F.explode(bits).alias("_bit"))

    for k, sizes in enumerate(zip(boxes, stripes)):
        for size, stage, limits in ((sizes[0], box_stage, box_limits[k]), (sizes[1], stripe_stage, stripe_limits[k])):
            hits = stage(size, limits).groupBy(*by, "_block").agg(F.bit_or("_bit").alias("_bits"))
            after = state.withColumn("_block", F.expr(f"_at div {size}")).join(hits, [*by, "_block"], "left")
            state = settled(after.select(*by, "_at", (F.col("kept") & F.col("_bits").isNull()).alias("kept"), F.col("reason").bitwiseOR(F.coalesce("_bits", F.lit(0).cast("long"))).alias("reason")))
    out = base.select(*by, chan, "_at").join(state, [*by, "_at"]).join(strongest, [*by, "_at"])
    return flag(out, F.col("strongest") > most, "correlated").select(*by, chan, "kept", "reason", "strongest")


def box_sums(pairs: DataFrame, by: list[str], size: int, samples: int) -> DataFrame:
    """The box statistics of one size as plain sums over pairs (by, a < b, corr; what doesn't count is 0): box_a, box_b, dof, chi2, total."""
    far = pairs.filter(F.col("b") - F.col("a") > 1).withColumn("box_a", F.floor(F.col("a") / size).cast("int")).withColumn("box_b", F.floor(F.col("b") / size).cast("int"))
    sums = far.filter("box_a < box_b").groupBy(*by, "box_a", "box_b").agg(F.sum(F.col("corr") ** 2).alias("s"), F.sum("corr").alias("t"), F.greatest(F.count_if(F.col("corr") != 0), F.lit(1)).alias("dof"))
    return sums.select(*by, "box_a", "box_b", "dof", ((F.col("s") * samples - F.col("dof")) / F.sqrt(2.0 * F.col("dof"))).alias("chi2"), (F.col("t") * F.sqrt(F.lit(float(samples)) / F.col("dof"))).alias("total"))


def box_statistics(sums: DataFrame, by: list[str], samples: int) -> DataFrame:
    """The same from sums over pairs (`spectra.correlation_sums` by box, of channels that aren't neighbours)."""
    out = sums.filter("i < j").select(*by, F.col("i").cast("int").alias("box_a"), F.col("j").cast("int").alias("box_b"), F.col("squares").alias("s"), F.col("total").alias("t"), F.greatest("nonzero", F.lit(1).cast("long")).alias("dof"))
    return out.select(*by, "box_a", "box_b", "dof", ((F.col("s") * samples - F.col("dof")) / F.sqrt(2.0 * F.col("dof"))).alias("chi2"), (F.col("t") * F.sqrt(F.lit(float(samples)) / F.col("dof"))).alias("total"))
