"""Results that are written out before they are used again, for iterations and for what is used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only a session on this machine alone may leave it unnamed: it gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenfold-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read back; what led to it is not planned again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df as a table in as many buckets as shuffles have partitions, by hash of keys, in the shared folder: joins and groups by
    all of them need no further shuffle of it, however often they are run."""
    spark, name = df.sparkSession, f"lumenfold_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).sortBy(*keys).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
