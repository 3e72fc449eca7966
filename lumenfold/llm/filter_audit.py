"""How document filters interact: a histogram of failure masks, read in every order of the filters. DataFrame functions only."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The filters; filter k fails where bit k of a mask is set.
FILTERS = "ABCDE"


def failure_mask(text: Column) -> Column:
    """Bits 0 to 3: under 100 words; under four distinct words in five; over a tenth capitals; holds one of #$%&*|."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def mask(w: Column) -> Column:
        fails = (
            F.size(w) < 100, 100 * F.size(F.array_distinct(w)).cast("long") < 80 * F.size(w).cast("long"),
            100 * capitals.cast("long") > 10 * F.length(text).cast("long"), F.rlike(text, F.lit("[#$%&*|]")),
        )
        return sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(fails)), F.lit(0))

    return F.element_at(F.transform(F.array(words), mask), 1)


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good and toxic: rows of each part by the filters that they fail, with those labelled good and toxic.

    Bit 4 of a mask is a text that a smaller id has too, anywhere in the table. Texts are compared by
    their SHA-256. Groups of equal texts are reduced to their smallest id before anything is joined, and
    that join is by text and id, so no task meets a whole group. Null texts are empty and null parts the
    empty string. A null id is smaller than none and none is smaller than it. Rows that repeat an id are
    rows of their own; labels that do count once, 1 if any of them is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failure_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    exact = materialize(
        rows.join(marks, "id", "left").groupBy("digest", "id", "part", "mask")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    )
    first = exact.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    whole = F.col("mask") + F.when(again, 16).otherwise(0)
    return exact.join(first, ["digest", "id"], "left").groupBy("part", whole.alias("mask")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def read_orders(cells: DataFrame) -> DataFrame:
    """What each order of the filters does at each step, from at most 32 cells of each part: see `audit_filters`."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = [F.locate(f, F.col("filter_order")) for f in FILTERS]
    before = sum((F.when(p < F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    bit = sum((F.when(p == F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    steps = steps.withColumn("before", before).withColumn("bit", bit)

    def total(keep, value) -> Column:
        return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda a, c: a + value(c).cast("long"))

    def fails(c: Column) -> Column:
        return c["mask"].bitwiseAND(F.col("bit")) != 0

    def gone(c: Column) -> Column:
        return c["mask"].bitwiseAND(F.col("before")) != 0

    # a row that fails m filters is removed by each of them in 120 / m orders
    share = F.lit(len(list(permutations(FILTERS))))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: ~gone(c) & ~fails(c), lambda c: c["n"]).alias("kept"),
        total(lambda c: ~gone(c) & fails(c), lambda c: c["n"]).alias("removed"),
        total(lambda c: gone(c) & fails(c), lambda c: c["n"]).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit"), lambda c: c["n"]).alias("unique_fails"),
        total(lambda c: ~gone(c) & fails(c), lambda c: c["good"]).alias("good_lost"),
        total(lambda c: ~gone(c) & fails(c), lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (share / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    kept and removed count rows after and by this step, redundant those that fail its filter and went
    before, unique_fails those that fail nothing else, good_lost and toxic_lost removed rows labelled so;
    shapley is what its filter removes, summed over all orders. 600 rows a part, zeros included. An empty
    table has no part and gives no rows. Nulls and repeats: see `failure_cells`; other columns are ignored.
    """
    return read_orders(failure_cells(docs, labels, id_col, text_col, part_col))
