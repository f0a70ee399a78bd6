"""Fixed time buckets: the seven aggregation methods and the pre-aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.time import bucket_start, bucket_start_by, order_key, pack_ties
from pulsegrid.operators.partials import (
    build_partials,
    finalize,
    is_ordered,
    resolve_method,
    statistic,
    stats_for,
)
from pulsegrid.schema import TIMESTAMP, drop_null_keys, numeric_fields, series_keys


def aggregate_by_interval(
    df: DataFrame,
    interval_ms: int,
    method: str | Mapping[str, str] = "avg",
    *,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    first_ts: bool = False,
) -> DataFrame:
    """One row per (bucket, series).

    `method` is one of avg, min, max, last, first, count, sum, or a mapping from field to method.
    `tie` names columns that order readings of equal time for first and last; the ranges of several integer
    ties are measured by a job of its own, so that they fit into one key of a hash aggregate. Without
    numeric fields, the first non-missing value of every other column is kept.
    """
    fields = numeric_fields(df, tie) if fields is None else list(fields)
    if isinstance(method, Mapping):
        method = {field: resolve_method(method[field]) for field in fields}
        stats = {field: stats_for([chosen]) for field, chosen in method.items()}
    else:
        method = resolve_method(method)
        stats = stats_for([method])
        if not fields and method != "count":
            return _first_values(df, interval_ms, tie)
    if method == "count":
        fields, stats = [], {}
    if is_ordered(stats if isinstance(stats, dict) else {"": stats}):
        df, tie = pack_ties(df, tie)
    partials = build_partials(df, interval_ms, fields=fields, tie=tie, stats=stats)
    return finalize(partials, method, first_ts=first_ts)


def _first_values(df: DataFrame, interval_ms: int, tie: Sequence[str]) -> DataFrame:
    keys = series_keys(df)
    others = [name for name in df.columns if name not in {TIMESTAMP, *keys, *tie}]
    df, tie = pack_ties(df, tie)
    rows = drop_null_keys(df).select(
        bucket_start(TIMESTAMP, interval_ms).alias("bucket"),
        *keys,
        *others,
        order_key(df, tie).alias("order_key"),
    )
    kept = [
        F.min_by(name, F.when(F.col(name).isNotNull(), F.col("order_key"))).alias(name)
        for name in others
    ]
    grouped = rows.groupBy("bucket", *keys)
    out = grouped.agg(*kept) if kept else rows.select("bucket", *keys).distinct()
    return out.withColumnRenamed("bucket", TIMESTAMP)


def preaggregate(
    df: DataFrame, interval_minutes: int = 1, *, fields: Sequence[str] | None = None
) -> DataFrame:
    """Mean, minimum and maximum of every field per bucket, in one aggregate."""
    fields = numeric_fields(df) if fields is None else list(fields)
    stats = ("sum", "cnt", "min", "max")
    partials = build_partials(df, interval_minutes * 60_000, fields=fields, stats=stats)
    columns = [F.col("bucket").alias(TIMESTAMP), *series_keys(df)]
    for field in fields:
        columns.append(statistic(partials, field, "avg").alias(field))
        columns.append(F.col(f"`{field}_min`"))
        columns.append(F.col(f"`{field}_max`"))
    return partials.select(*columns)


def aggregate_by_row_interval(
    df: DataFrame, interval: str, *, fields: Sequence[str] | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """Averages where each row names its own bucket width in column `interval`."""
    fields = numeric_fields(df, (*tie, interval)) if fields is None else list(fields)
    keys = series_keys(df)
    rows = drop_null_keys(df).withColumn(
        "bucket", bucket_start_by(F.col(TIMESTAMP), F.col(interval))
    )
    averages = [F.avg(f"`{field}`").alias(field) for field in fields]
    grouped = rows.groupBy("bucket", *keys, interval).agg(*averages)
    return grouped.withColumnRenamed("bucket", TIMESTAMP)
