"""Mergeable aggregates per (bucket, series): the one algebra behind buckets and rollups.

For each field f a frame of partials may hold f_sum, f_cnt, f_min, f_max, f_first_key, f_first_v,
f_last_key and f_last_v, besides n_rows, first_ts and last_ts of the bucket. Partials of finer
buckets merge into those of coarser ones without loss, so an average of a day from minutes equals
that from the readings.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.time import bucket_start, order_key
from pulsegrid.schema import drop_null_keys, numeric_fields, series_keys
from pulsegrid.session import require_utc

METHODS = ("avg", "min", "max", "last", "first", "count", "sum")
ALL_STATS = ("sum", "cnt", "min", "max", "first", "last")
# The sum of squared distances from the bucket's mean; with sum and count it gives variances.
MOMENT = "m2"

_STATS_OF = {
    "avg": ("sum", "cnt"),
    "sum": ("sum",),
    "min": ("min",),
    "max": ("max",),
    "first": ("first",),
    "last": ("last",),
    "count": (),
}


def resolve_method(name: str) -> str:
    """Canonical method name; `mean` is `avg`. Unknown names are an error."""
    method = "avg" if name.lower() == "mean" else name.lower()
    if method not in METHODS:
        raise ValueError(f"unknown aggregation {name!r}; expected one of {', '.join(METHODS)}")
    return method


def stats_for(methods: Iterable[str]) -> tuple[str, ...]:
    needed = {stat for method in methods for stat in _STATS_OF[method]}
    return tuple(stat for stat in ALL_STATS if stat in needed)


def build_partials(
    df: DataFrame,
    interval_ms: int,
    *,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    stats: Mapping[str, Sequence[str]] | Sequence[str] = ALL_STATS,
) -> DataFrame:
    """Partials of readings. `stats` may be given per field; one shuffle, combined map-side."""
    require_utc(df.sparkSession)
    fields = numeric_fields(df, tie) if fields is None else list(fields)
    per_field = stats if isinstance(stats, Mapping) else {field: stats for field in fields}
    keys = series_keys(df)
    rows = drop_null_keys(df).withColumn("bucket", bucket_start("timestamp", interval_ms))
    if is_ordered(per_field):
        rows = rows.withColumn("order_key", order_key(df, tie))
    return rows.groupBy("bucket", *keys).agg(*partial_aggregates(fields, per_field))


def partial_aggregates(fields: Sequence[str], per_field: Mapping[str, Sequence[str]]) -> list[Column]:
    """Aggregate expressions over readings; first and last expect a column `order_key`."""
    aggregates = [
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    ]
    for field in fields:
        value = F.col(f"`{field}`")
        wanted = per_field.get(field, ())
        simple = {"sum": F.sum, "cnt": F.count, "min": F.min, "max": F.max, MOMENT: _squares}
        aggregates += [simple[s](value).alias(f"{field}_{s}") for s in wanted if s in simple]
        key = F.when(value.isNotNull(), F.col("order_key"))
        aggregates += _ordered(field, value, key, wanted)
    return aggregates


def is_ordered(per_field: Mapping[str, Sequence[str]]) -> bool:
    return any({"first", "last"} & set(names) for names in per_field.values())


def merge_partials(partials: DataFrame, interval_ms: int) -> DataFrame:
    """Partials of a coarser interval from those of finer ones, or from several sources."""
    keys = ["merged", *series_keys(partials)]
    rows = _around_means(partials.withColumn("merged", bucket_start("bucket", interval_ms)), keys)
    merged = rows.groupBy(*keys).agg(*_merging(partials))
    return merged.withColumnRenamed("merged", "bucket")


def add_partials(partials: DataFrame, also_by: Sequence[str] = ()) -> DataFrame:
    """One row for each bucket and series from several of the same interval; filters of the keys still reach the scans."""
    keys = ["bucket", *series_keys(partials), *also_by]
    return _around_means(partials, keys).groupBy(*keys).agg(*_merging(partials))


def sum_partials(partials: DataFrame) -> DataFrame:
    """One row for each series, over all buckets."""
    keys = series_keys(partials)
    return _around_means(partials, keys).groupBy(*keys).agg(*_merging(partials))


def _squares(value: Column) -> Column:
    """Spark combines variances around their own means, so large means do not cost digits."""
    return F.var_pop(value) * F.count(value)


def _around_means(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Squared distances moved to the mean of all rows that are to become one; the aggregation needs no shuffle of its own then."""
    for field, stats in partial_stats(partials).items():
        if MOMENT not in stats:
            continue
        total, count, squares = (F.col(f"`{field}_{stat}`") for stat in ("sum", "cnt", MOMENT))
        group = Window.partitionBy(*keys)
        mean = F.sum(total).over(group) / F.sum(count).over(group)
        apart = total / count - mean
        partials = partials.withColumn(f"{field}_{MOMENT}", F.when(count > 0, squares + count * apart * apart))
    return partials


def _merging(partials: DataFrame) -> list[Column]:
    aggregates = [
        F.sum("n_rows").alias("n_rows"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    ]
    for field, stats in partial_stats(partials).items():
        for stat in stats:
            if stat in ("first", "last"):
                value = F.col(f"`{field}_{stat}_v`")
                key = F.col(f"`{field}_{stat}_key`")
                aggregates += _ordered(field, value, key, (stat,))
            else:
                merge = {"sum": F.sum, "cnt": F.sum, "min": F.min, "max": F.max, MOMENT: F.sum}[stat]
                aggregates.append(merge(F.col(f"`{field}_{stat}`")).alias(f"{field}_{stat}"))
    return aggregates


def _ordered(field: str, value: Column, key: Column, wanted: Sequence[str]) -> list[Column]:
    """First and last non-missing value with their keys; the key is NULL where the value is."""
    out = []
    if "first" in wanted:
        out += [
            F.min(key).alias(f"{field}_first_key"),
            F.min_by(value, key).alias(f"{field}_first_v"),
        ]
    if "last" in wanted:
        out += [
            F.max(key).alias(f"{field}_last_key"),
            F.max_by(value, key).alias(f"{field}_last_v"),
        ]
    return out


def partial_stats(partials: DataFrame) -> dict[str, list[str]]:
    """Which statistics of which fields a frame of partials holds."""
    found: dict[str, list[str]] = {}
    base = {"bucket", "n_rows", "first_ts", "last_ts", "dt", *series_keys(partials)}
    for name in partials.columns:
        if name in base:
            continue
        for suffix in ("_sum", "_cnt", "_min", "_max", "_first_v", "_last_v", f"_{MOMENT}"):
            if name.endswith(suffix):
                stat = suffix.removesuffix("_v").lstrip("_")
                found.setdefault(name.removesuffix(suffix), []).append(stat)
    return found


def finalize(
    partials: DataFrame,
    method: str | Mapping[str, str] = "avg",
    *,
    first_ts: bool = False,
) -> DataFrame:
    """Readings per bucket: the chosen statistic of each field, `timestamp` the bucket start."""
    keys = series_keys(partials)
    columns = [F.col("bucket").alias("timestamp"), *keys]
    if method == "count":
        columns.append(F.col("n_rows").alias("count"))
    else:
        for field in partial_stats(partials):
            chosen = method[field] if isinstance(method, Mapping) else method
            columns.append(statistic(partials, field, chosen).alias(field))
    if first_ts:
        columns.append(F.col("first_ts"))
    return partials.select(*columns)


def statistic(partials: DataFrame, field: str, method: str) -> Column:
    """One statistic of a field as a column of partials."""
    if method == "avg":
        return (F.col(f"`{field}_sum`") / F.col(f"`{field}_cnt`")).cast("double")
    if method == "sum":
        total = F.col(f"`{field}_sum`")
        return F.coalesce(total, F.lit(0).cast(partials.schema[f"{field}_sum"].dataType))
    suffix = {"min": "min", "max": "max", "first": "first_v", "last": "last_v"}[method]
    return F.col(f"`{field}_{suffix}`")


def keep_stats(
    partials: DataFrame, stats: Iterable[str], fields: Sequence[str] | None = None
) -> DataFrame:
    """Only the named statistics, so that a scan of stored partials reads no other columns."""
    wanted = set(stats)
    columns = ["bucket", *series_keys(partials), "n_rows", "first_ts", "last_ts"]
    for field, held in partial_stats(partials).items():
        if fields is not None and field not in fields:
            continue
        for stat in held:
            if stat in wanted and stat in ("first", "last"):
                columns += [f"{field}_{stat}_key", f"{field}_{stat}_v"]
            elif stat in wanted:
                columns.append(f"{field}_{stat}")
    return partials.select(*[F.col(f"`{name}`") for name in columns])
