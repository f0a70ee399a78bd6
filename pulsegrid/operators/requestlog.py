"""Statistics of a request log: a table with a key, time, tier, hit flag and duration per request."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.time import iso8601, ntz, utc_time

# Fixed value: more requests than this make a key popular.
POPULAR_ABOVE = 5


def key_usage(log: DataFrame, key: str = "key", timestamp: str = "timestamp") -> DataFrame:
    """Frequency and last access of every key."""
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("frequency"), F.max(timestamp).alias("last_access")
    )


def popular_keys(
    log: DataFrame, limit: int = 10, key: str = "key", timestamp: str = "timestamp"
) -> DataFrame:
    """The most frequent keys; equal frequencies in key order."""
    return key_usage(log, key, timestamp).orderBy(F.desc("frequency"), key).limit(limit)


def key_totals(log: DataFrame, key: str = "key", timestamp: str = "timestamp") -> DataFrame:
    """Tracked keys, total accesses and how many keys are popular."""
    return key_usage(log, key, timestamp).agg(
        F.count(F.lit(1)).alias("tracked_queries"),
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_accesses"),
        F.count(F.when(F.col("frequency") > POPULAR_ABOVE, 1)).alias("popular_queries"),
    )


def stale_keys(
    log: DataFrame,
    now: datetime | str,
    max_age_hours: float = 24,
    key: str = "key",
    timestamp: str = "timestamp",
) -> DataFrame:
    """Keys not accessed for longer than the given age."""
    cutoff = utc_time(now) - timedelta(hours=max_age_hours)
    return key_usage(log, key, timestamp).where(F.col("last_access") < ntz(cutoff))


def usage_summary(log: DataFrame, hit: str = "hit", millis: str = "execution_ms") -> DataFrame:
    """Requests, hits, the share of hits and the average duration."""
    total = F.count(F.lit(1))
    hits = F.count(F.when(F.col(hit), 1))
    return log.agg(
        total.alias("total_queries"),
        hits.alias("cache_hits"),
        F.when(total > 0, hits / total).otherwise(0.0).alias("cache_hit_rate"),
        F.coalesce(F.avg(millis), F.lit(0.0)).alias("avg_execution_time_ms"),
    )


def tier_usage(log: DataFrame, tier: str = "tier", hit: str = "hit") -> DataFrame:
    """Requests per tier that were not answered from a cache."""
    return log.where(~F.col(hit)).groupBy(tier).agg(F.count(F.lit(1)).alias("queries"))


def request_fingerprint(
    sensors: Column,
    start: Column,
    end: Column,
    assets: Column,
    interval_ms: Column,
    aggregation: Column,
    max_points: Column,
) -> Column:
    """MD5 of a request's parameters, independent of the order of its lists."""
    canonical = F.struct(
        F.array_sort(sensors).alias("sensors"),
        iso8601(start).alias("start_time"),
        iso8601(end).alias("end_time"),
        F.array_sort(assets).alias("asset_ids"),
        interval_ms.alias("interval_ms"),
        aggregation.alias("aggregation"),
        max_points.alias("max_datapoints"),
    )
    return F.md5(F.to_json(canonical, {"ignoreNullFields": "false"}))
