"""Files that a scan passes over, named with a reason instead of lost without a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsegrid.sources.readings import read_parquet

VANISHED, NO_FOOTER, NO_ROWS = "vanished", "no Parquet footer", "no rows or a broken footer"
# Fixed value: the last bytes of every Parquet file.
MAGIC = b"PAR1"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path and size_bytes of the Parquet files below a folder, listed by Spark; contents are not read."""
    return _contents(spark, root).select(_plain("path").alias("path"), F.col("length").alias("size_bytes"))


def _contents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)


def _plain(column: str) -> Column:
    """A path as all readers spell it."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def readable_files(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """path and n_rows of the files whose footers can be read; nothing else of them is."""
    df = read_parquet(spark, root, schema=schema, skip_unreadable=True, recursive=True)
    return df.groupBy(_plain("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))


def quarantine(spark: SparkSession, root: str, listed: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """path, size_bytes, reason of the files of a listing that `skip_unreadable` passes over.

    `listed` is what `list_files` found before, kept as a table. Of files that give no rows, and only of them, the last bytes are looked at: a
    whole file that holds no rows cannot be told from one with a broken footer. Give a `schema` if the first file may be a broken one.
    """
    bad = listed.join(readable_files(spark, root, schema), "path", "left_anti")
    content = _contents(spark, root).withColumn("path", _plain("path"))
    tail = F.expr("substring(content, greatest(length(content) - 3, 1), 4)")
    ends = content.join(bad.select("path"), "path", "left_semi").select("path", (tail == F.lit(MAGIC)).alias("whole"))
    reason = F.when(F.col("whole").isNull(), VANISHED).when(F.col("whole"), NO_ROWS).otherwise(NO_FOOTER)
    # One row for each file on both sides.
    return bad.join(ends, "path", "left").select("path", "size_bytes", reason.alias("reason"))
