"""Exact dedup by progressive refinement: length, then a hash of the prefix, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_hot, materialize, unfold


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest_all: bool = False) -> DataFrame:
    """Per row of docs: id_col, keep_id, group_size, kept and digest.

    Rows are equal when their texts are after deleting white space. Of equal rows the one with
    the most code points in the original text stays, then the smallest id (null ids last). Rows
    are grouped by normalised length; where a length is shared, by a hash of the first `prefix`
    characters; where that is shared too, by SHA-256 of the whole normalised text. digest is that
    hash; rows proven unique before have none unless digest_all is set, which takes the digest of
    every row while its text is read first. Rows that repeat an id are rows of their own: if they
    are equal, both carry the same keep_id and exactly one of each set of full copies is kept.
    An empty table gives an empty result; other columns are ignored. Ids may be of any type that can be
    ordered. With digest_all nothing is saved by refinement but shuffles of digests: who wants every
    row's digest reads every text for it.
    """
    norm = normalised(F.col(text_col))
    keys = docs.select(
        F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), norm.alias("norm")
    ).select(
        "_id", "points", F.length("norm").alias("length"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head"),
        (F.unhex(F.sha2("norm", 256)) if digest_all else F.lit(None).cast("binary")).alias("digest"),
    )
    keys = materialize(keys)
    lengths = keys.groupBy("length").agg(F.count("*").alias("c")).filter("c > 1").select("length")
    heads = keys.join(lengths, "length", "left_semi").groupBy("length", "head").agg(F.count("*").alias("c")).filter("c > 1").select("length", "head")
    if digest_all:
        surviving = keys.join(heads, ["length", "head"], "left_semi").select("_id", "points", "length", "head", "digest")
        alone = keys.join(heads, ["length", "head"], "left_anti")
    else:
        heads = materialize(heads)
        texts = docs.select(F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), norm.alias("norm"))
        texts = texts.withColumn("length", F.length("norm")).withColumn("head", F.xxhash64(F.substring("norm", 1, prefix)))
        surviving = texts.join(heads, ["length", "head"], "left_semi").select("_id", "points", "length", "head", F.unhex(F.sha2("norm", 256)).alias("digest"))
        surviving = materialize(surviving)
        alone = keys.join(heads, ["length", "head"], "left_anti")
    order = F.struct((-F.col("points")).alias("most"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    groups = surviving.groupBy("length", "digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    groups = materialize(groups.select("length", "digest", "group_size", "best"))
    # rows that repeat both id and text are counted, so that one of them stays
    copies = surviving.groupBy("_id", "points", "length", "digest").agg(F.count("*").alias("times"))
    judged = join_hot(copies, groups, ["length", "digest"], "group_size", keys.count())
    best = F.col("_id").eqNullSafe(F.col("best.id")) & (-F.col("points") == F.col("best.most"))
    judged = unfold(judged, "times", "_copy").select("_id", F.col("best.id").alias("keep_id"), "group_size", (best & (F.col("_copy") == 0)).alias("kept"), "digest")
    single = alone.select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return judged.unionByName(single).withColumnRenamed("_id", id_col)
