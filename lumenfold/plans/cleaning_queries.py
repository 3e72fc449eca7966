"""Map cleaning on the tables at hand, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, maps
from .queries import QUERIES, TOD, query, r, tod  # noqa: F401

BY, PIXEL, CHANNELS = ["feed"], ["dec_i", "ra_i"], 64
#: Channels averaged for each weighted mode, and steps.
WEIGHTED = ([1, 4], 5)


def cells(spark, sf_dir):
    return cleaning.seen_cells(maps.finalise(maps.bin_map(tod(spark, sf_dir))), BY, PIXEL, CHANNELS)


CELLS = f"{TOD}, c AS (SELECT feed, dec_i, ra_i, sb * 64 + chan AS f, num / den AS m, den AS w FROM m)"


@query(f"""WITH {CELLS}, a AS (SELECT feed, f, sum(w) AS wf FROM c GROUP BY ALL), b AS (SELECT feed, dec_i, ra_i, sum(w) AS wp FROM c GROUP BY ALL),
n AS (SELECT feed, count(DISTINCT f) AS nf, count(DISTINCT (dec_i, ra_i)) AS np FROM c GROUP BY feed)
SELECT feed, dec_i, ra_i, CAST(f AS INTEGER) AS f, round(sqrt(sqrt(np / wf) * sqrt(nf / wp)), 5) AS smooth FROM c JOIN a USING (feed, f) JOIN b USING (feed, dec_i, ra_i) JOIN n USING (feed)""")
def separable_noise(spark, sf_dir):
    return cleaning.separable_noise(cells(spark, sf_dir), BY, PIXEL).select("feed", "dec_i", "ra_i", "f", r("smooth", 5).alias("smooth"))


@query(f"""WITH {CELLS} SELECT feed, dec_i, ra_i, CAST(f AS INTEGER) AS f, round(m - avg(m) OVER (PARTITION BY feed, dec_i, ra_i), 3) + 0 AS rest FROM c""")
def line_of_sight_mean(spark, sf_dir):
    out = cleaning.without_line_mean(cells(spark, sf_dir), BY, PIXEL, "m")
    return out.select("feed", "dec_i", "ra_i", "f", (r("m", 3) + 0.0).alias("rest"))


@query(f"""WITH {CELLS}, s AS (SELECT feed, dec_i, ra_i, sum(m) AS s FROM c GROUP BY ALL), p AS (SELECT feed, dec_i, ra_i, s / sqrt(sum(s * s) OVER (PARTITION BY feed)) AS a FROM s)
SELECT feed, CAST(f AS INTEGER) AS f, round(sum(m * a * w) / sum(a * a * w), 1) AS factor FROM c JOIN p USING (feed, dec_i, ra_i) GROUP BY feed, f""")
def weighted_mode_step(spark, sf_dir):
    """The first half-step of a weighted mode: channel factors, given the pixels' sums."""
    c = cells(spark, sf_dir)
    across = cleaning.of_length_one(c.groupBy(*BY, *PIXEL).agg(F.sum("m").alias("now")), BY)
    return cleaning.solved(c, across, BY, ["f"], PIXEL).select("feed", "f", r("_to", 1).alias("factor"))


@query()
def weighted_map_modes(spark, sf_dir):
    return cleaning.as_maps(cleaning.subtract_weighted(cells(spark, sf_dir), BY, PIXEL, *WEIGHTED)[0], CHANNELS)


@query()
def separable_map_modes(spark, sf_dir):
    return cleaning.as_maps(cleaning.subtract_normalised(cells(spark, sf_dir), BY, PIXEL, 2, "sigma_wn", True, True), CHANNELS)


@query()
def cleaned_map_levels(spark, sf_dir):
    """Two modes less, then the coadds of groups of detectors and of all."""
    m = maps.finalise(maps.bin_map(tod(spark, sf_dir)))
    return cleaning.clean_maps(m, CHANNELS, 2, "sigma_wn", noise_limit=(20, 8.0))
