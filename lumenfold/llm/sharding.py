"""Shards that all match the mixture: rows of each source in seeded order, interleaved by fractional rank, and cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, unfold

def seeded(seed: int, *parts: Column) -> Column:
    """A whole number below 2^52 from the MD5 of seed and parts, nulls as empty texts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rank_in_buckets(rows: DataFrame, by: list[str], bucket: Column, order: list[str], rank: str, count: str) -> DataFrame:
    """rows with their place from 1 by (bucket, order) inside each value of `by`, which has no nulls, and how many rows that value has.

    Only one bucket is ever ordered in a task; where it starts comes from the counts of those before it.
    """
    rows = rows.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    starts = starts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias(count))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return rows.join(starts, keys).withColumn(rank, F.col("_before") + place).drop("_bucket", "_before")


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 4096) -> DataFrame:
    """Where each row of docs goes: id, source, mark (a hash of the text), size, text_crc32, copy, shard and slot.

    Rows of a source stand in an order that the seed, id and text decide; a row of rank r of n has the
    fractional rank (r - 1/2) / n. All rows are ordered by it, ties by source, and cut into parts whose
    counts differ by one at most, so that every shard has each source's share of its rows. slot is the
    place in the shard, from 0. Hash and fractional rank are spread evenly, so equal buckets of either
    hold equal numbers of rows, whatever source is large.

    size is the text's UTF-8 bytes plus 1. Null texts are empty with size 1; a null source and the empty one are one
    stratum; null ids count as empty text. Rows alike in all of these are told apart by copy, from 0, and are
    spread like others. The result doesn't depend on partitioning. An empty table gives an empty result. Texts
    equal under different ids may go to different shards. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.xxhash64(text).alias("mark"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    alike = ["id", "source", "mark", "size", "text_crc32"]
    rows = unfold(keys.groupBy(*alike).agg(F.count("*").alias("times")), "times", "copy").drop("times")
    rows = materialize(rows.withColumn("h", seeded(seed, F.col("id"), F.col("size"), F.col("text_crc32"), F.col("copy"))))
    ranked = rank_in_buckets(rows, ["source"], F.shiftright("h", 52 - (buckets - 1).bit_length()), ["h", "id", "size", "text_crc32", "mark", "copy"], "r", "n")
    part = (2.0 * F.col("r") - 1) / (2.0 * F.col("n"))
    spread = materialize(ranked.select(*alike, "copy", part.alias("part"), F.lit(0).alias("all")))
    at = rank_in_buckets(spread, ["all"], F.floor(F.col("part") * buckets), ["part", "source"], "p", "total").withColumn("p", F.col("p") - 1)
    at = at.withColumn("shard", F.expr(f"p * {shards}L div total"))
    return at.select(*alike, "copy", F.col("shard").cast("int").alias("shard"), F.expr(f"p - (shard * total + {shards - 1}) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """docs as Parquet under path, a folder for each shard, whose files hold its rows in the order of slot.

    Columns are id, source, text and slot. Many tasks write a shard, each a run of slots. Rows alike in
    id, source and text read their text once.
    """
    placed = materialize(shard_rows(docs, shards, seed, id_col, text_col, source_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    alike = {"id": F.col(id_col), "source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "mark": F.xxhash64(text), "size": F.octet_length(text).cast("long") + 1}
    texts = docs.select(*[c.alias(f"_{name}") for name, c in alike.items()], text.alias("text")).groupBy(*[f"_{name}" for name in alike]).agg(F.first("text").alias("text"))
    same = [placed[name].eqNullSafe(texts[f"_{name}"]) for name in alike]
    out = placed.join(texts, same[0] & same[1] & same[2] & same[3]).select("id", "source", "text", "slot", "shard")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
