"""Variability of series from stored rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.partials import MOMENT, sum_partials
from pulsegrid.plans.catalog import FIRST, LAST
from pulsegrid.plans.routing import Request, tiered_partials
from pulsegrid.schema import series_keys
from pulsegrid.sources.rollups import DAY_MS, RollupStore


def stored_profile(raw: DataFrame | None, store: RollupStore, field: str, sensors: Sequence[str] | None = None) -> DataFrame:
    """As `series_profile`, from day rollups built with `moments`; days that they do not answer for come from the readings."""
    whole = Request(sensors, FIRST, LAST, None, DAY_MS, (field,), store.tie, ("sum", "cnt", MOMENT))
    series = sum_partials(tiered_partials(raw, store, whole, "1d").partials)
    count, squares = F.col(f"`{field}_cnt`"), F.col(f"`{field}_{MOMENT}`")
    mean = F.when(count > 0, F.col(f"`{field}_sum`") / count)
    deviation = F.when(count > 1, F.sqrt(squares / (count - 1)))
    size = F.abs(F.col("mean"))
    return series.select(*series_keys(series), deviation.alias("std_dev"), mean.alias("mean")).withColumn(
        "variability", F.when(size > 0, F.col("std_dev") / size)
    )
