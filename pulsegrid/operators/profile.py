"""Variability and density of series, and what bucket width suits each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.intervals import RECOMMENDED_POINTS, aggregated_interval_column
from pulsegrid.functions.time import bucket_start, span_millis
from pulsegrid.schema import TIMESTAMP, drop_null_keys, series_keys


def series_profile(df: DataFrame, field: str) -> DataFrame:
    """Sample deviation, mean and their ratio per series. Low ratios mark smooth series."""
    stats = df.groupBy(*series_keys(df)).agg(
        F.stddev_samp(field).alias("std_dev"), F.avg(field).alias("mean")
    )
    size = F.abs(F.col("mean"))
    ratio = F.when(size > 0, F.col("std_dev") / size)
    return stats.withColumn("variability", ratio)


def series_density(df: DataFrame, interval_ms: int) -> DataFrame:
    """Readings, span and milliseconds per reading, and the points a bucket width would give."""
    stats = drop_null_keys(df).groupBy(*series_keys(df)).agg(
        F.count(F.lit(1)).alias("points"),
        span_millis(F.min(TIMESTAMP), F.max(TIMESTAMP)).alias("span_ms"),
    )
    return stats.select(
        *series_keys(df),
        "points",
        (F.col("span_ms") / F.lit(3_600_000)).alias("duration_hours"),
        (F.col("span_ms") / F.col("points")).alias("density_ms_per_point"),
        F.floor(F.col("span_ms") / F.lit(interval_ms)).alias("estimated_points"),
    )


def recommend_intervals(df: DataFrame, target_points: int = RECOMMENDED_POINTS) -> DataFrame:
    """Recommended bucket width of every series and the points to expect from it."""
    keys = series_keys(df)
    stats = drop_null_keys(df).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        span_millis(F.min(TIMESTAMP), F.max(TIMESTAMP)).alias("span_ms"),
    )
    width = aggregated_interval_column(F.col("span_ms"), target_points)
    return stats.select(
        *keys,
        "points",
        (F.col("span_ms") / F.lit(3_600_000)).alias("duration_hours"),
        width.alias("recommended_interval_ms"),
        F.floor(F.col("span_ms") / width).alias("estimated_points"),
    )


def estimate_and_actual(df: DataFrame, interval_ms: int) -> DataFrame:
    """Estimated points of every series next to the buckets that really hold readings."""
    keys = series_keys(df)
    per_bucket = (
        drop_null_keys(df)
        .groupBy(bucket_start(TIMESTAMP, interval_ms).alias("bucket"), *keys)
        .agg(F.min(TIMESTAMP).alias("first_ts"), F.max(TIMESTAMP).alias("last_ts"))
    )
    span = span_millis(F.min("first_ts"), F.max("last_ts"))
    return per_bucket.groupBy(*keys).agg(
        F.floor(span / F.lit(interval_ms)).alias("estimated_points"),
        F.count(F.lit(1)).alias("actual_points"),
    )
