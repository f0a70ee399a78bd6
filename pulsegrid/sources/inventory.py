"""What files there are, without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.paths import asset_of, hour_of, sensor_of


def file_inventory(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """One row per file: path, size, modification time, and what its path says.

    The content column is never selected, so no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    path = F.col("path")
    return files.select(
        path,
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        sensor_of(path).alias("sensor_name"),
        asset_of(path).alias("asset_id"),
        hour_of(path).alias("file_hour"),
    )


def file_time_range(inventory: DataFrame) -> DataFrame:
    """First and last hour that has a file. The end is the start of the last hour."""
    return inventory.agg(
        F.min("file_hour").alias("start_time"), F.max("file_hour").alias("end_time")
    )


def count_files(inventory: DataFrame, *by: str) -> DataFrame:
    """Files and bytes in total, or per sensor and asset."""
    return inventory.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes")
    )


def with_row_counts(inventory: DataFrame, table: DataFrame) -> DataFrame:
    """The inventory with `n_rows` of each file, by a scan of `table` that reads no column; 0 for files without rows."""
    name = lambda path: F.regexp_replace(path, "^file:/+", "file:/")
    counts = table.groupBy(name(F.col("_metadata.file_path")).alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    return inventory.withColumn("file", name(F.col("path"))).join(counts, "file", "left").drop("file").fillna(0, ["n_rows"])
