"""Stores of results as partitioned Parquet: reduced streams, channels, statistics, splits, maps and spectra.

Spark's committer makes a write appear as a whole or not at all; a partition is replaced only by a
write that has rows for it, so scans can be redone one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each store is partitioned by.
STORES = {"streams": ["field", "scan"], "channels": ["field", "scan"], "statistics": ["field"], "accepted": ["field"], "splits": ["field"], "maps": ["split_key", "feed"], "spectra": ["split1", "split2"],
          "noise_runs": ["split1", "split2"], "average_spectra": ["field1", "field2"], "transfer": ["name"], "models": ["name"], "null_tests": ["field"],
          "modes": ["scan"], "calibrations": ["obsid"], "aliasing": ["feed"], "standing_waves": ["field"]}


def write_store(rows: DataFrame, root: str, store: str) -> None:
    """Replace the partitions that rows has."""
    by = STORES[store]
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(f"{root}/{store}")


def append_store(rows: DataFrame, root: str, store: str, keys: list[str]) -> None:
    """Add the rows whose keys the store doesn't have yet; what it has stays as it is. A store that isn't there begins with them."""
    spark, path = rows.sparkSession, f"{root}/{store}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    rows.write.mode("append").option("compression", "zstd").partitionBy(*STORES[store]).parquet(path)


def read_store(spark: SparkSession, root: str, store: str, columns: list[str] | None = None, **values) -> DataFrame:
    """Rows of a store, of some columns and of partitions by value (a value or a list): only those are read."""
    rows = spark.read.parquet(f"{root}/{store}")
    for name, value in values.items():
        rows = rows.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return rows.select(*columns) if columns else rows


def read_or_none(spark: SparkSession, root: str, store: str, schema: str, **values) -> DataFrame:
    """A store's rows, or none of the schema where the store isn't there: what joins it gets nulls, and its users mask those."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{store}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return read_store(spark, root, store, **values)
    return spark.createDataFrame([], schema)


def map_name(kind: str, modes: int = 0, norm: str = "", highpass: int = 0, cube: bool = False) -> str:
    """The name of a map product with the suffixes of what was done to it."""
    return kind + (f"_highpass_{highpass}" if highpass else "") + (f"_n{modes}_subtr_{norm}" if modes else "") + ("_simcube" if cube else "")


def missing_scans(runlist: DataFrame, spark: SparkSession, root: str, store: str, key: str = "scan") -> DataFrame:
    """Scans of a runlist that a store has no rows of."""
    return runlist.join(spark.read.parquet(f"{root}/{store}").select(key).distinct(), key, "left_anti")


def unread_files(spark: SparkSession, path: str, pattern: str, seen: DataFrame, bad: DataFrame) -> DataFrame:
    """Files under a folder whose names match and that are neither in `seen` nor in `bad` (column path): path, modified, size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    known = seen.select("path").unionByName(bad.select("path")).distinct()
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).join(known, "path", "left_anti")
