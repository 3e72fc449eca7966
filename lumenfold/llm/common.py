"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
SPACES = " \t\n\x0b\x0c\r"


_SCOPES: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in spark.checkpoint.dir. Only a session on this machine alone
    (master local) may do without: there a temporary folder is made and set for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(named)
    return "/".join([named.rstrip("/"), f"lumenfold-{spark.sparkContext.applicationId}", *_SCOPES])


def new_path(spark: SparkSession) -> str:
    """A free name in the shared folder."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder (or to path, for those who delete it early) and read it back, which cuts its lineage.

    With `by` each value of that column has a folder of its own, so that a filter by it reads no other.
    A lost executor costs only its running tasks: the files are in shared storage.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def release(spark: SparkSession) -> None:
    """Let the files of shuffles go that no plan needs any more. Spark drops them when the driver collects its garbage, and a driver
    with little to do hardly ever does: between large steps, each written out, it is worth asking. Twice, since what Python lets go
    reaches Spark a little later."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def purge_scratch(spark: SparkSession) -> None:
    """Delete this session's intermediate tables (in `scratch`: those of the block), once all results that use them are written."""
    delete(spark, scratch_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside the block are deleted at its end: results must be written by then."""
    _SCOPES.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        purge_scratch(spark)
        _SCOPES.pop()


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined (inner) with side, which has one row for each value of keys and, as `size`, how many of rows it meets.

    Values that hold more than a thousandth of `total` rows, of which there are fewer than a
    thousand, are broadcast, so that no task gets all rows of one; the others meet by a shuffle.
    Keys must not be null.
    """
    hot = F.col(size) * 1000 > total
    few, many = F.broadcast(side.filter(hot)), side.filter(~hot)
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(side.filter(hot).select(*keys)), keys, "left_anti").join(many, keys))


#: So many elements one row unfolds into at a time.
UNFOLD = 4096


def unfold(rows: DataFrame, times: str, at: str) -> DataFrame:
    """rows with each repeated `times` times, numbered in `at` from 0. No row becomes an array of more than a few thousand elements at once."""
    block = free_name(rows, "_block")
    blocks = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / UNFOLD / UNFOLD))))
    left = F.col(times) - F.col(block) * UNFOLD * UNFOLD
    blocks = blocks.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.least(left, F.lit(UNFOLD * UNFOLD)) - 1) / UNFOLD))))
    left = left - F.col(at) * UNFOLD
    start = (F.col(block) * UNFOLD + F.col(at)) * UNFOLD
    one = free_name(blocks, "_one")
    out = blocks.withColumn(one, F.explode(F.sequence(F.lit(0).cast("long"), F.least(left, F.lit(UNFOLD)) - 1)))
    return out.withColumn(at, start + F.col(one)).drop(block, one)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows of the held-out fold: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge list with the smallest node it can reach.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): each round is two pre-aggregated minima joined back to the edges,
    so no neighbour list is ever collected. Rounds end when the edge list no longer changes.
    Returns (node, component); nodes without edges are not listed. Null ends and self loops
    are ignored.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u is not null and v is not null and u <> v").distinct()
    )
    seen = _checksum(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lowest")).select("u", F.least("lowest", "u").alias("m"))
        large = (
            both.filter("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        now = materialize(small)
        was, seen = seen, _checksum(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots.join(leaves.select("node"), "node", "left_anti"))
