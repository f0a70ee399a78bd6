"""What series exist, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.time import micros
from pulsegrid.operators.filters import only_assets, only_sensors
from pulsegrid.schema import TIMESTAMP


def list_sensors(df: DataFrame, asset: str | None = None) -> DataFrame:
    """Distinct sensors, of one asset if given, sorted."""
    rows = only_assets(df, [asset]) if asset is not None else df
    return rows.select("sensor_name").dropna().distinct().orderBy("sensor_name")


def list_assets(df: DataFrame) -> DataFrame:
    return df.select("asset_id").dropna().distinct().orderBy("asset_id")


def list_union(*lists: DataFrame) -> DataFrame:
    """Names that occur in any of several lists, sorted."""
    merged = lists[0]
    for other in lists[1:]:
        merged = merged.union(other)
    return merged.distinct().orderBy(*merged.columns)


def series_catalog(df: DataFrame) -> DataFrame:
    """One row per (sensor, asset): its number of readings, first and last time."""
    return df.groupBy("sensor_name", "asset_id").agg(
        F.count(F.lit(1)).alias("data_count"),
        F.min(TIMESTAMP).alias("first_seen"),
        F.max(TIMESTAMP).alias("last_seen"),
    )


def sensor_catalog(df: DataFrame) -> DataFrame:
    """One row per sensor. Its assets are the rows of `series_catalog`, not a list in one cell."""
    return sensors_of(series_catalog(df))


def asset_catalog(df: DataFrame) -> DataFrame:
    """One row per asset. Its sensors are the rows of `series_catalog`."""
    return assets_of(series_catalog(df))


def sensors_of(series: DataFrame) -> DataFrame:
    """The sensors of a catalogue of series."""
    return _summarise(series, "sensor_name", "asset_id", "asset_count")


def assets_of(series: DataFrame) -> DataFrame:
    """The assets of a catalogue of series."""
    return _summarise(series, "asset_id", "sensor_name", "sensor_count")


def _summarise(series: DataFrame, by: str, other: str, count: str) -> DataFrame:
    return series.groupBy(by).agg(
        F.count(other).alias(count),
        F.sum("data_count").alias("data_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def time_range_of(
    df: DataFrame,
    sensors: list[str] | None = None,
    assets: list[str] | None = None,
    *,
    granularity: str | None = None,
) -> DataFrame:
    """First and last time of the readings and the hours between; `hour` floors both ends."""
    rows = only_assets(only_sensors(df, sensors), assets)
    ends = rows.agg(F.min(TIMESTAMP).alias("start_time"), F.max(TIMESTAMP).alias("end_time"))
    return range_columns(ends, granularity)


def range_columns(ends: DataFrame, granularity: str | None = None) -> DataFrame:
    """start_time and end_time, floored if asked, and the hours between."""
    if granularity is not None:
        ends = ends.select(
            *[
                F.date_trunc(granularity, F.col(name)).cast("timestamp_ntz").alias(name)
                for name in ends.columns
            ]
        )
    hours = (micros(F.col("end_time")) - micros(F.col("start_time"))) / F.lit(3_600_000_000)
    return ends.withColumn("duration_hours", hours)
