"""Reading tables: partitioned tables, trees of hourly files, several sources at once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulsegrid.functions.paths import LAYOUTS, TreeLayout, asset_of, folder_time, sensor_of
from pulsegrid.functions.time import ntz, utc_time
from pulsegrid.operators.filters import PARTITION, select_readings, time_range
from pulsegrid.schema import SERIES_KEYS, TIMESTAMP, normalize, series_keys

# Names that the bucket column of stored aggregates may have.
BUCKET_NAMES = ("time_bucket", "minute_bucket", "hour_bucket", "day_bucket", "bucket", "timestamp")
GLOB_CHARACTERS = "{}[]*?,\\/"


def read_parquet(
    spark: SparkSession,
    *paths: str,
    schema: T.StructType | None = None,
    merge_schema: bool = False,
    skip_unreadable: bool = False,
    recursive: bool = False,
    base_path: str | None = None,
    names: str | None = None,
) -> DataFrame:
    """Parquet files as they are. One read for any number of paths; below `base_path`, folders are partitions.

    `names` is a pattern for the names of files.

    Without a `schema` that of one file is taken; `merge_schema` outer-unions those of all files,
    which opens every one of them. `skip_unreadable` passes over corrupt and vanished files, which
    otherwise fail the job. Ids stay text even as partition directories.
    """
    options = {
        "mergeSchema": merge_schema,
        "ignoreCorruptFiles": skip_unreadable,
        "ignoreMissingFiles": skip_unreadable,
        "recursiveFileLookup": recursive,
    }
    if base_path is not None:
        options["basePath"] = base_path
    if names is not None:
        options["pathGlobFilter"] = names
    reader = spark.read.options(**options)
    if schema is not None:
        return reader.schema(schema).parquet(*paths)
    df = reader.parquet(*paths)
    # Directory names such as asset_id=001 are inferred as numbers; read them as the text they are.
    numeric = [
        field.name
        for field in df.schema.fields
        if field.name in SERIES_KEYS and isinstance(field.dataType, T.NumericType)
    ]
    if not numeric or recursive:
        return df
    stored = spark.read.options(**{**options, "recursiveFileLookup": True}).parquet(*paths)
    fields = [
        T.StructField(field.name, T.StringType())
        if field.name in numeric and field.name not in stored.columns
        else field
        for field in df.schema.fields
    ]
    return spark.read.options(**options).schema(T.StructType(fields)).parquet(*paths)


def read_raw(
    spark: SparkSession,
    root: str,
    sensors: Sequence[str] | DataFrame | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    assets: Sequence[str] | DataFrame | None = None,
    *,
    schema: T.StructType | None = None,
    merge_schema: bool = False,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Readings of a table written by `write_raw`, with all predicates at the scan."""
    df = read_parquet(
        spark, root, schema=schema, merge_schema=merge_schema, skip_unreadable=skip_unreadable
    )
    return select_readings(df, sensors, start, end, assets).drop(PARTITION)


def read_series(
    spark: SparkSession,
    root: str,
    sensors: Sequence[str] | DataFrame | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    assets: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """`read_raw`, in time order."""
    df = read_raw(spark, root, sensors, start, end, assets)
    return df.orderBy(TIMESTAMP, *series_keys(df))


def write_raw(
    df: DataFrame,
    root: str,
    *,
    partition_by: Sequence[str] = (PARTITION,),
    mode: str = "overwrite",
    dedup: bool = True,
) -> None:
    """Store readings by day, sorted by series so that row groups can be skipped.

    Whole-row copies are removed here, once, so that queries need not do it again.

    The rebalance lets AQE split a day, or an asset of a day, that is larger than a file should be.
    Overwriting replaces only the partitions at hand.
    """
    rows = df.dropDuplicates() if dedup else df
    write_partitioned(rows.withColumn(PARTITION, F.to_date(TIMESTAMP)), root, partition_by, mode)


def write_partitioned(
    df: DataFrame, root: str, partition_by: Sequence[str], mode: str = "overwrite"
) -> None:
    time = "bucket" if "bucket" in df.columns else TIMESTAMP
    order = [*partition_by, *[k for k in series_keys(df) if k not in partition_by], time]
    (
        df.hint("rebalance", *partition_by)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(root)
    )


def read_hourly_tree(
    spark: SparkSession,
    root: str,
    sensors: Sequence[str] | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    assets: Sequence[str] | None = None,
    *,
    schema: T.StructType | None = None,
    merge_schema: bool = True,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Readings of a tree `asset/yyyy/mm/dd/hh/sensor[_yyyymmdd_hh].parquet`.

    Asset and sensor come from the path where the file lacks them. Give a `schema` for large trees, or every listed file is
    opened to merge theirs.
    """
    options = dict(schema=schema, merge_schema=merge_schema, skip_unreadable=skip_unreadable)
    df = _tree_files(spark, root, LAYOUTS["raw"], sensors, start, end, assets, options)
    return select_readings(df, sensors, start, end, assets)


def read_rollup_tree(
    spark: SparkSession,
    root: str,
    layout: str,
    sensors: Sequence[str] | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    assets: Sequence[str] | None = None,
    *,
    schema: T.StructType | None = None,
    merge_schema: bool = True,
    skip_unreadable: bool = False,
) -> DataFrame:
    """Rows of a tree of stored aggregates, one of `LAYOUTS`, whose bucket starts in `[start, end)`.

    The bucket column may have any of its names and is `time_bucket` in the result, so `extract_statistic` applies to it.
    """
    options = dict(schema=schema, merge_schema=merge_schema, skip_unreadable=skip_unreadable)
    df = _tree_files(spark, root, LAYOUTS[layout], sensors, start, end, assets, options)
    buckets = [name for name in BUCKET_NAMES if name in df.columns]
    if not buckets:
        raise ValueError(f"no bucket column among {', '.join(df.columns)}")
    # Files of other layouts beside these may have brought columns of their own.
    both = F.coalesce(*[F.col(name) for name in buckets]) if len(buckets) > 1 else F.col(buckets[0])
    renamed = df.select(both.alias(TIMESTAMP), *[name for name in df.columns if name not in buckets])
    return normalize(time_range(renamed, start, end)).withColumnRenamed(TIMESTAMP, BUCKET_NAMES[0])


def _tree_files(spark, root, layout: TreeLayout, sensors, start, end, assets, options: dict) -> DataFrame:
    """Rows of the files that the paths leave in question, with asset and sensor.

    Only the directories of the assets and months asked for are listed. The other path predicates use file metadata alone, so
    Spark drops the files before it schedules a scan. A start within a folder's time keeps that folder.
    """
    top = f"{root}/{layout.prefix}" if layout.prefix else root
    options = options | {"recursive": True, "names": f"*{layout.suffix}.parquet"}
    try:
        df = read_parquet(spark, listing_glob(top, start, end, assets), **options)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Nothing of these assets and months: the tree supplies the columns of an empty result.
        df = read_parquet(spark, top, **options)
    path = F.col("_metadata.file_path")
    df = df.where(path.rlike(layout.pattern))
    if start is not None:
        df = df.where(folder_time(path, layout) >= F.date_trunc(layout.period, ntz(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(folder_time(path, layout) < ntz(end))
    if sensors:
        df = df.where(sensor_of(path, layout).isin(list(sensors)))
    if assets:
        df = df.where(asset_of(path, layout).isin(list(assets)))
    if "sensor_name" not in df.columns:
        df = df.withColumn("sensor_name", sensor_of(path, layout))
    if "asset_id" not in df.columns and "daqid" not in df.columns:
        df = df.withColumn("asset_id", asset_of(path, layout))
    return df


def listing_glob(
    root: str,
    start: datetime | str | None,
    end: datetime | str | None,
    assets: Sequence[str] | None,
) -> str:
    """Pattern for the asset and month directories a query needs; the root where that is all."""
    if (start is None or end is None) and not assets:
        return root
    plain = assets and not any(set(name) & set(GLOB_CHARACTERS) for name in assets)
    pattern = "{" + ",".join(assets) + "}" if plain else "*"
    if start is None or end is None:
        return f"{root}/{pattern}"
    first, last = utc_time(start), utc_time(end)
    numbers = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    months = ",".join(f"{n // 12:04d}/{n % 12 + 1:02d}" for n in numbers)
    return f"{root}/{pattern}/{{{months}}}"


def with_path_columns(df: DataFrame, layout: str = "raw") -> DataFrame:
    """Add asset, start of the folder and sensor of each row's file. `df` must come straight from a file scan."""
    path, kind = F.col("_metadata.file_path"), LAYOUTS[layout]
    return df.select(
        "*",
        sensor_of(path, kind).alias("file_sensor"),
        asset_of(path, kind).alias("file_asset"),
        folder_time(path, kind).alias(f"file_{kind.period}"),
    )


def union_sources(*sources: DataFrame, dedup: bool = True) -> DataFrame:
    """Readings of several sources, columns outer-unioned, whole-row copies removed."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return merged.dropDuplicates() if dedup else merged
