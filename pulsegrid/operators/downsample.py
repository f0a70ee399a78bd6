"""Fitting a series into a budget of points."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.intervals import aggregated_interval_column, smart_interval
from pulsegrid.functions.time import millis_between, span_millis
from pulsegrid.operators.bucket import aggregate_by_interval, aggregate_by_row_interval
from pulsegrid.operators.lookup import lookup_join
from pulsegrid.operators.partials import (
    build_partials,
    finalize,
    merge_partials,
    resolve_method,
    stats_for,
)
from pulsegrid.operators.sample import stride_sample
from pulsegrid.schema import TIMESTAMP, drop_null_keys, numeric_fields, series_keys
from pulsegrid.session import materialize

SMALLEST_INTERVAL_MS = 1000
# Field names that hold a state rather than a measurement.
STATE_FIELDS = ("status", "state", "mode", "alarm")


@dataclass(frozen=True)
class Extent:
    """Number of rows and their time range: the three scalars that decide a downsampling."""

    rows: int
    first: datetime | None
    last: datetime | None

    @property
    def span_ms(self) -> float:
        return millis_between(self.first, self.last) if self.first else 0.0


def extent(df: DataFrame, timestamp: str = TIMESTAMP) -> Extent:
    row = df.agg(F.count(F.lit(1)), F.min(timestamp), F.max(timestamp)).first()
    return Extent(row[0], row[1], row[2])


def required_interval(span_ms: float, max_points: int) -> int:
    return max(SMALLEST_INTERVAL_MS, int(span_ms / max_points))


def downsample_to_max_points(
    df: DataFrame,
    max_points: int,
    method: str = "avg",
    *,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """At most `max_points` rows: unchanged if they fit, else bucketed, else also stride-sampled."""
    size = extent(df)
    if size.rows <= max_points:
        return df
    interval = required_interval(size.span_ms, max_points)
    bucketed = aggregate_by_interval(df, interval, method, fields=fields, tie=tie)
    return stride_sample(bucketed, max_points, distinct_rows=True)


def choose_methods(
    df: DataFrame, duration_hours: float, *, fields: Sequence[str], per_field: bool = False
) -> str | dict[str, str]:
    """Average, but the last value for states over an hour or more.

    One state field makes the whole frame use last; `per_field` confines that to the state fields.
    """
    states = [field for field in fields if field.lower() in STATE_FIELDS]
    if duration_hours < 1 or not states:
        return "avg"
    if per_field:
        return {field: "last" if field in states else "avg" for field in fields}
    return "last"


@dataclass(frozen=True)
class Fitted:
    """Rows that fit, how many there were, and the width they were widened to, None where they fitted.

    `method` and `source_rows` are known where the readings themselves were fitted.
    """

    data: DataFrame
    points: int
    truncated: bool
    interval_ms: int | None = None
    method: str | dict[str, str] | None = None
    source_rows: int | None = None


def smart_downsample(
    df: DataFrame,
    target_interval_ms: int,
    max_points: int,
    duration_hours: float,
    *,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    method: str | None = None,
    per_field: bool = False,
) -> DataFrame:
    """The rows of `smart_fit`."""
    return smart_fit(df, target_interval_ms, max_points, duration_hours, fields=fields, tie=tie, method=method, per_field=per_field).data


def smart_fit(
    df: DataFrame,
    target_interval_ms: int,
    max_points: int,
    duration_hours: float,
    *,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    method: str | None = None,
    per_field: bool = False,
) -> Fitted:
    """Standard bucket width and method chosen from the data, then fitted into the budget, with a report of both.

    The first pass keeps mergeable partials, so a second, coarser bucketing stays exact. Readings that fit stay as they are:
    no width, no method.
    """
    fields = numeric_fields(df, tie) if fields is None else list(fields)
    rows = df.count()
    if rows <= max_points:
        return Fitted(df, rows, False, source_rows=rows)
    chosen = (
        resolve_method(method)
        if method
        else choose_methods(df, duration_hours, fields=fields, per_field=per_field)
    )
    interval = smart_interval(rows, duration_hours * 3_600_000, max_points, target_interval_ms)
    stats = (
        {field: stats_for([name]) for field, name in chosen.items()}
        if isinstance(chosen, dict)
        else stats_for([chosen])
    )
    width = max(interval, target_interval_ms)
    fitted = fit_partials(build_partials(df, width, fields=fields, tie=tie, stats=stats), chosen, max_points)
    return replace(fitted, interval_ms=max(width, fitted.interval_ms or 0), method=chosen, source_rows=rows)


def fit_partials(
    partials: DataFrame, method: str | dict[str, str], max_points: int
) -> Fitted:
    """Final rows of `partials`, re-bucketed and stride-sampled when there are too many."""
    stored = materialize(partials, "partials")
    size = extent(stored, "bucket")
    if size.rows <= max_points:
        return Fitted(finalize(stored, method), size.rows, False)
    interval = required_interval(size.span_ms, max_points)
    coarser = finalize(merge_partials(stored, interval), method)
    return Fitted(stride_sample(coarser, max_points, distinct_rows=True), size.rows, True, interval)


def adaptive_bucket(
    df: DataFrame,
    points_per_series: int,
    *,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Averages with a bucket width of its own for every series, from that series' time span."""
    fields = numeric_fields(df, tie) if fields is None else list(fields)
    keys = series_keys(df)
    rows = drop_null_keys(df).select(TIMESTAMP, *keys, *fields)
    if not keys:
        span = F.lit(extent(rows).span_ms)
        width = aggregated_interval_column(span, points_per_series)
        return aggregate_by_row_interval(
            rows.withColumn("interval_ms", width), "interval_ms", fields=fields
        )
    spans = rows.groupBy(*keys).agg(
        span_millis(F.min(TIMESTAMP), F.max(TIMESTAMP)).alias("span_ms")
    )
    interval = aggregated_interval_column(F.col("span_ms"), points_per_series)
    widths = spans.select(*keys, interval.alias("interval_ms"))
    paired = lookup_join(rows, widths, keys)
    return aggregate_by_row_interval(paired, "interval_ms", fields=fields)
