"""Row filters of a query: time range, sensors and assets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegrid.functions.time import EPOCH, ntz, utc_time
from pulsegrid.operators.lookup import lookup_join
from pulsegrid.schema import normalize, to_utc_ntz

PARTITION = "dt"


def time_range(
    df: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    *,
    column: str = "timestamp",
    partition_floor: str | None = "DAY",
) -> DataFrame:
    """Rows in `[start, end)`.

    The bounds are literals of the column's own type, so they reach the scan also where the
    column is a timestamp with a zone or a count of nanoseconds.

    Spark does not derive partition predicates from a timestamp range, so a frame with a `dt`
    partition column gets them here. `partition_floor` is the period (DAY, MONTH, YEAR) whose first
    day `dt` holds; with None, `dt` is left alone.
    """
    prune = partition_floor is not None and PARTITION in df.columns
    if start is not None:
        moment, bound = _comparable(df, column, start)
        df = df.where(moment >= bound)
        if prune:
            df = df.where(F.col(PARTITION) >= partition_day(utc_time(start), partition_floor))
    if end is not None:
        moment, bound = _comparable(df, column, end)
        df = df.where(moment < bound)
        if prune:
            df = df.where(F.col(PARTITION) <= F.lit(utc_time(end).date()))
    return df


def _comparable(df: DataFrame, column: str, value: datetime | str) -> tuple[Column, Column]:
    """The column and the bound in a type they share, the column untouched where possible."""
    data_type = df.schema[column].dataType
    moment = utc_time(value)
    if isinstance(data_type, T.TimestampType):
        return F.col(column), F.lit(moment.replace(tzinfo=timezone.utc))
    if isinstance(data_type, T.LongType):
        nanos = (moment - EPOCH) // timedelta(microseconds=1) * 1000
        return F.col(column), F.lit(nanos).cast("long")
    return to_utc_ntz(F.col(column), data_type), ntz(moment)


def partition_day(value: datetime, period: str):
    """Literal of the first day of the partition period a time falls in."""
    day = value.date()
    if period in ("MONTH", "YEAR"):
        day = day.replace(day=1)
    if period == "YEAR":
        day = day.replace(month=1)
    return F.lit(day)


def membership(df: DataFrame, column: str, values: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows whose `column` is among `values`: a list, or a one-column frame for very long lists.

    Nothing given, or an empty list, or a frame without the column, means no filter.
    """
    if values is None or column not in df.columns:
        return df
    if isinstance(values, DataFrame):
        wanted = values.toDF(column).dropna().distinct()
        return lookup_join(df, wanted, [column], how="left_semi")
    return df.where(F.col(column).isin(list(values))) if values else df


def only_sensors(df: DataFrame, sensors: Sequence[str] | DataFrame | None) -> DataFrame:
    return membership(df, "sensor_name", sensors)


def only_assets(df: DataFrame, assets: Sequence[str] | DataFrame | None) -> DataFrame:
    return membership(df, "asset_id", assets)


def select_readings(
    df: DataFrame,
    sensors: Sequence[str] | DataFrame | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    assets: Sequence[str] | DataFrame | None = None,
    *,
    dedup: bool = False,
) -> DataFrame:
    """All three filters, before any bucketing so that they reach the scan.

    `df` may be as it was read: it is normalized after the time range is applied. `dedup` then
    removes whole-row copies among the rows that are left.
    """
    rows = only_assets(only_sensors(normalize(time_range(df, start, end)), sensors), assets)
    return rows.dropDuplicates() if dedup else rows
