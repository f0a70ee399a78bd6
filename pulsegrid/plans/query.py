"""The three queries: general series, raw seconds, and aggregates with an automatic interval."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from pulsegrid.functions.intervals import TARGET_POINTS, aggregated_interval, query_interval
from pulsegrid.functions.time import millis_between, utc_time
from pulsegrid.operators.bucket import aggregate_by_interval
from pulsegrid.operators.downsample import fit_partials
from pulsegrid.operators.filters import select_readings
from pulsegrid.operators.partials import build_partials, finalize, partial_stats, resolve_method, stats_for
from pulsegrid.plans.routing import Request, tier_by_duration, tier_by_interval, tiered_partials
from pulsegrid.schema import TIMESTAMP, numeric_fields, series_keys
from pulsegrid.sources.ledger import Span
from pulsegrid.sources.rollups import GRAINS, RollupStore

HOUR_MS = 3_600_000
SECOND_MS = 1000


@dataclass(frozen=True)
class SeriesResult:
    """Rows of a query and how they were obtained.

    `interval_ms` is the width of the rows' buckets, also where a limit made it wider than asked, and `truncated`
    says that it did; `points` is then the number of rows of the width asked for, else None, as nothing was counted.
    `uncovered` names parts of the range whose readings have gone and that no rollup answers for.
    """

    data: DataFrame
    tier_used: str
    interval_ms: int
    truncated: bool
    actual_end: datetime | None
    method: str | None = None
    points: int | None = None
    uncovered: tuple[Span, ...] = ()

    @property
    def points_per_hour(self) -> float:
        """Rows an hour that one series has at most at this width."""
        return HOUR_MS / self.interval_ms


def validate_range(
    sensors: Sequence[str] | DataFrame,
    start: datetime | str,
    end: datetime | str,
    max_duration_hours: float | None = None,
) -> tuple[datetime, datetime]:
    start, end = utc_time(start), utc_time(end)
    if start >= end:
        raise ValueError("start must be before end")
    if max_duration_hours is not None and end - start > timedelta(hours=max_duration_hours):
        raise ValueError(f"query duration exceeds the maximum of {max_duration_hours} hours")
    if not isinstance(sensors, DataFrame) and not sensors:
        raise ValueError("at least one sensor must be given")
    return start, end


def query_series(
    raw: DataFrame | None,
    sensors: Sequence[str] | DataFrame,
    start: datetime | str,
    end: datetime | str,
    assets: Sequence[str] | DataFrame | None = None,
    interval_ms: int | None = None,
    max_points: int | None = None,
    aggregation: str = "avg",
    *,
    store: RollupStore | None = None,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    dedup: bool = False,
    max_duration_hours: float | None = None,
    allow_gaps: bool = False,
) -> SeriesResult:
    """Buckets of the chosen series in time order, from the cheapest table that is exact.

    `raw` is a frame of readings, as read or normalized, or None to use stored rollups only. `max_points`
    limits the rows; None, the default, returns every bucket and keeps the whole query lazy. `dedup` removes whole-row copies first; tables written by `write_raw` and unions
    made by `union_sources` have none. Parts of the range that neither readings nor rollups can answer for are an error
    unless `allow_gaps`; then the result names them.
    """
    start, end = validate_range(sensors, start, end, max_duration_hours)
    duration_ms = millis_between(start, end)
    interval_ms = interval_ms or query_interval(duration_ms, max_points or TARGET_POINTS)
    preferred = tier_by_duration(duration_ms / HOUR_MS)
    return _run(
        raw, sensors, start, end, assets, interval_ms, max_points, aggregation,
        store, fields, tie, dedup, preferred, allow_gaps,
    )


def aggregated_query(
    raw: DataFrame | None,
    sensors: Sequence[str],
    start: datetime | str,
    end: datetime | str,
    interval_ms: int | None = None,
    aggregation: str = "mean",
    *,
    max_points: int | None = None,
    store: RollupStore | None = None,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    dedup: bool = False,
    allow_gaps: bool = False,
) -> SeriesResult:
    """Buckets of a width chosen for all sensors together, from the coarsest rollup that fits."""
    start, end = validate_range(sensors, start, end)
    if interval_ms is None:
        limit = max_points or TARGET_POINTS
        interval_ms = aggregated_interval(millis_between(start, end), len(sensors), limit)
    result = _run(
        raw, sensors, start, end, None, interval_ms, max_points, aggregation,
        store, fields, tie, dedup, tier_by_interval(interval_ms), allow_gaps,
    )
    return _with_sensor_type(result)


def raw_query(
    raw: DataFrame,
    sensors: Sequence[str],
    start: datetime | str,
    end: datetime | str,
    *,
    max_points: int | None = None,
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    dedup: bool = False,
) -> SeriesResult:
    """Original values, the last of each second; with `max_points` at most that many, spread over the range."""
    start, end = validate_range(sensors, start, end)
    rows = select_readings(raw, sensors, start, end, dedup=dedup)
    tie = tuple(tie)
    if max_points is None:
        last = aggregate_by_interval(rows, SECOND_MS, "last", fields=fields, tie=tie)
        data = last.orderBy(TIMESTAMP, *series_keys(last))
        return _with_sensor_type(SeriesResult(data, "raw", SECOND_MS, False, end, "last"))
    partials = build_partials(rows, SECOND_MS, fields=fields or numeric_fields(raw, tie), tie=tie, stats=stats_for(["last"]))
    fitted = fit_partials(partials, "last", max_points)
    width = max(SECOND_MS, fitted.interval_ms or 0)
    data = fitted.data.orderBy(TIMESTAMP, *series_keys(fitted.data))
    return _with_sensor_type(SeriesResult(data, "raw", width, fitted.truncated, end, "last", fitted.points))


def _run(
    raw, sensors, start, end, assets, interval_ms, max_points, aggregation,
    store, fields, tie, dedup, preferred, allow_gaps,
) -> SeriesResult:
    method = resolve_method(aggregation)
    tie = tie or (store.tie if store else ())
    if fields is None:
        fields = _fields(raw, store, preferred, tie)
    request = Request(
        sensors, start, end, assets, interval_ms,
        () if method == "count" else fields, tie, stats_for([method]), dedup,
    )
    answer = tiered_partials(raw, store, request, preferred, allow_gaps)
    partials = answer.partials
    if max_points is None:
        data, width, truncated, points = finalize(partials, method), interval_ms, False, None
    else:
        fitted = fit_partials(partials, method, max_points)
        data, truncated, points = fitted.data, fitted.truncated, fitted.points
        width = max(interval_ms, fitted.interval_ms or 0)
    ordered = data.orderBy(TIMESTAMP, *series_keys(data))
    # The range is whole whatever the limit: rows are spread over it.
    return SeriesResult(ordered, answer.tier, width, truncated, end, method, points, answer.uncovered)


def _fields(raw, store, preferred, tie) -> list[str]:
    if raw is not None:
        return numeric_fields(raw, tie)
    grain = next(name for name in (preferred, *GRAINS) if name in GRAINS and store.exists(name))
    return list(partial_stats(store.read(grain)))


def _with_sensor_type(result: SeriesResult) -> SeriesResult:
    renamed = result.data.withColumnRenamed("sensor_name", "sensor_type")
    return replace(result, data=renamed)
