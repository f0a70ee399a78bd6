"""Building and checking stored rollups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.time import ceil_time, floor_time, utc_time
from pulsegrid.operators.coverage import bucket_number, observed_counts
from pulsegrid.operators.filters import only_sensors, select_readings
from pulsegrid.operators.partials import ALL_STATS, MOMENT, build_partials, merge_partials
from pulsegrid.schema import TIMESTAMP, numeric_fields
from pulsegrid.session import materialize
from pulsegrid.sources.ledger import source_state
from pulsegrid.sources.rollups import DAY_MS, GRAINS, RollupStore

# Lowest acceptable coverage of the readings and of each rollup.
RAW_COVERAGE = 0.9
TIER_COVERAGE = {"1m": 0.8, "1h": 0.8, "1d": 0.8}


def rebuild_rollups(
    raw: DataFrame,
    store: RollupStore,
    sensors: Sequence[str] | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    *,
    grains: Sequence[str] = ("1m", "1h", "1d"),
    fields: Sequence[str] | None = None,
    dedup: bool = False,
    moments: bool = False,
) -> None:
    """Recompute rollups of the given sensors and time, everything by default.

    The range is widened to whole days, which all grains divide, and back to where the recorded time ended within the
    day before, as that day may have grown since. Each grain is one job: minutes from the readings, every other
    grain by merging the stored next finer one. Running it twice leaves the same tables, and days of which the
    readings have gone lose their rows. `dedup` removes whole-row copies of readings first. The files of the source go into the
    ledger of the store (`moments` adds what variances need), so that later changes of them are noticed; rebuilds of some sensors leave it as it was.
    """
    start = floor_time(utc_time(start), DAY_MS) if start is not None else None
    end = ceil_time(utc_time(end), DAY_MS) if end is not None else None
    if start is not None and not sensors:
        start = min([start, *(floor_time(t, DAY_MS) for t in store.open_ends(start))])
    fields = numeric_fields(raw, store.tie) if fields is None else list(fields)
    # The state before the readings are read: what comes meanwhile counts as a change.
    state = None if sensors else source_state(raw)
    rows = select_readings(raw, sensors, start, end, dedup=dedup)
    finer = None
    for name in grains:
        grain = GRAINS[name]
        if finer is None:
            stats = (*ALL_STATS, MOMENT) if moments else ALL_STATS
            partials = build_partials(rows, grain.interval_ms, fields=fields, tie=store.tie, stats=stats)
        else:
            partials = merge_partials(store.read(finer, sensors, start, end), grain.interval_ms)
        store.replace(name, partials, start, end, sensors)
        finer = name
    span = start or datetime.min, end or datetime.max
    if sensors:
        # What the other sensors have keeps its record only if both were built alike.
        store.forget(grains, *span, unless=store.build(fields, dedup, moments))
    else:
        number = 0
        if state.files is not None:
            number = store.next_number()
            store.ledger.append(raw, state, number, start, end)
        store.record_build(grains, span, _known(raw, start, end), store.build(fields, dedup, moments), number)


def _known(raw: DataFrame, start: datetime | None, end: datetime | None) -> datetime | None:
    """How far a build from the readings of a span is complete.

    Everything before the readings' first was built too, unless a start was given. It reaches to `end` if the source has later
    readings; else the last minute with readings, and what follows, may still grow.
    """
    if end is not None and not select_readings(raw, None, end).isEmpty():
        return end
    latest = select_readings(raw, None, start, end).agg(F.max(TIMESTAMP)).first()[0]
    return None if latest is None else floor_time(latest, GRAINS["1m"].interval_ms)


def validate_rollups(
    raw: DataFrame,
    store: RollupStore,
    sensors: Sequence[str] | None = None,
    *,
    raw_interval_ms: int = 1000,
) -> DataFrame:
    """Coverage of the readings and of each stored grain per series, with a verdict.

    Every tier is measured between the first and last reading of the series; stored buckets outside of that do not
    count, and a tier that is not there has coverage 0.
    """
    raw = select_readings(raw, sensors)
    keys = ["sensor_name", "asset_id"]
    # One row per series, compared with every tier: the readings are scanned once.
    seen = materialize(observed_counts(raw, raw_interval_ms), "observed")
    tiers = [_verdict(seen, "raw", raw_interval_ms, raw_interval_ms, RAW_COVERAGE)]
    for name, grain in GRAINS.items():
        held = seen.drop("observed").withColumn("observed", F.lit(0).cast("long"))
        if store.exists(name):
            rows = only_sensors(store.read(name), sensors).select(*keys, bucket_number(F.col("bucket"), grain.interval_ms).alias("n"))
            first, last = _ends(grain.interval_ms, raw_interval_ms)
            inside = seen.select(*keys, first.alias("low"), last.alias("high")).join(rows, keys).where("n BETWEEN low AND high")
            counts = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
            # One row per series on both sides.
            held = seen.drop("observed").join(counts, keys, "left").fillna(0, ["observed"])
        tiers.append(_verdict(held, name, grain.interval_ms, raw_interval_ms, TIER_COVERAGE[name]))
    merged = tiers[0]
    for tier in tiers[1:]:
        merged = merged.unionByName(tier)
    return merged


def _verdict(
    series: DataFrame, tier: str, interval_ms: int, numbered_ms: int, threshold: float
) -> DataFrame:
    """Expected buckets of a tier between ends that are numbered in buckets of `numbered_ms`."""
    first, last = _ends(interval_ms, numbered_ms)
    expected = last - first + 1
    ratio = F.col("observed") / expected
    return series.select(
        "sensor_name",
        "asset_id",
        F.lit(tier).alias("tier"),
        "observed",
        expected.alias("expected"),
        ratio.alias("coverage"),
        (ratio >= F.lit(threshold)).alias("ok"),
    )


def _ends(interval_ms: int, numbered_ms: int) -> list[Column]:
    """Numbers of a series' first and last bucket of a width, from those of another."""
    return [F.floor(F.col(end) * F.lit(numbered_ms) / F.lit(interval_ms)) for end in ("first", "last")]
