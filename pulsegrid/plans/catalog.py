"""A catalogue of series that builds and streams keep up to date, instead of a scan of all readings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.catalog import range_columns
from pulsegrid.plans.routing import Request, tiered_partials
from pulsegrid.sources.rollups import DAY_MS, RollupStore

# Whole days that a count of nanoseconds can hold.
FIRST, LAST = datetime(1678, 1, 1), datetime(2262, 1, 1)


def stored_days(raw: DataFrame | None, store: RollupStore, *, dedup: bool = False) -> DataFrame:
    """bucket, series, n_rows, first_ts, last_ts of every day and series.

    The day rollup has them for all days that are recorded and as they were; only days beyond the record, or of files that changed, are
    read from the readings. Rows without sensor, asset or time belong to no series.
    """
    whole = Request(None, FIRST, LAST, None, DAY_MS, (), store.tie, (), dedup)
    return tiered_partials(raw, store, whole, "1d").partials


def stored_catalog(raw: DataFrame | None, store: RollupStore, *, dedup: bool = False) -> DataFrame:
    """As `series_catalog`; lists of sensors and assets and `sensors_of`, `assets_of` apply to it."""
    return stored_days(raw, store, dedup=dedup).groupBy("sensor_name", "asset_id").agg(
        F.sum("n_rows").alias("data_count"), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen")
    )


def stored_time_range(raw: DataFrame | None, store: RollupStore, *, granularity: str | None = None) -> DataFrame:
    """As `time_range_of` over all series."""
    days = stored_days(raw, store)
    return range_columns(days.agg(F.min("first_ts").alias("start_time"), F.max("last_ts").alias("end_time")), granularity)
