"""Incremental map making: scans arrive, their sums are added to the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maps import PIXEL, bin_map


def stream_map(spark: SparkSession, source: str, schema, checkpoint: str, out: str, keys: list[str] = PIXEL):
    """Bin each arriving batch of samples and write its sums under its batch number.

    A batch that is repeated after a failure overwrites its own folder, so nothing counts twice.
    """
    def add(batch: DataFrame, number: int) -> None:
        bin_map(batch, keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_map(spark: SparkSession, out: str, keys: list[str] = PIXEL) -> DataFrame:
    """The map so far: the batches' sums added up."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("nhit").alias("nhit"))
