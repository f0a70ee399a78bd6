"""Catalogue, profile, coverage and gaps."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import coverage as coverage_module
from pulsegrid.operators.catalog import (
    asset_catalog,
    list_assets,
    list_sensors,
    list_union,
    sensor_catalog,
    series_catalog,
    time_range_of,
)
from pulsegrid.operators.coverage import coverage, missing_buckets
from pulsegrid.operators.profile import (
    estimate_and_actual,
    recommend_intervals,
    series_density,
    series_profile,
)
from tests.conftest import ts

MINUTE, HOUR = 60_000, 3_600_000


@pytest.fixture
def gappy(one_series):
    return one_series.where("NOT minute(timestamp) IN (7, 8, 30)")


def test_coverage_counts_real_buckets(gappy):
    row = coverage(gappy, MINUTE).first()
    assert (row["observed"], row["expected"], row["coverage"]) == (57, 60, 0.95)
    row = coverage(gappy, MINUTE, "2024-01-01", "2024-01-01T02:00:00").first()
    assert (row["observed"], row["expected"]) == (57, 120)
    row = coverage(gappy, MINUTE, "2024-01-01T00:00:30", "2024-01-01T00:10:01").first()
    assert (row["observed"], row["expected"]) == (9, 11)


def test_coverage_before_the_epoch(spark):
    start = F.lit("1969-12-31 23:30:00").cast("timestamp_ntz")
    df = spark.range(0, 3600, 2).select(
        (start + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
        F.lit("s").alias("sensor_name"),
    )
    row = coverage(df.union(df), 1000).first()
    assert (row["observed"], row["expected"]) == (1800, 3599)


@pytest.mark.parametrize("chunk", [1, 4, 4096])
def test_missing_buckets(gappy, monkeypatch, chunk):
    monkeypatch.setattr(coverage_module, "CHUNK_WORDS", chunk)
    gaps = sorted(r["timestamp"] for r in missing_buckets(gappy, MINUTE).collect())
    assert gaps == [ts(f"2024-01-01T00:{m:02d}") for m in (7, 8, 30)]
    inside = missing_buckets(gappy, MINUTE, "2024-01-01T00:55:00", "2024-01-01T01:03:00")
    assert sorted(r["timestamp"].minute for r in inside.collect()) == [0, 1, 2]


def test_missing_seconds_equal_a_set_difference(spark):
    """Gaps within words, over whole words and on both sides of the epoch."""
    df = spark.range(-5000, 5000).where("id % 7 <> 3 AND NOT id BETWEEN 100 AND 900").select(
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("s"), F.pmod("id", F.lit(2))).alias("sensor_name"),
    )
    held = {(r["timestamp"], r["sensor_name"]) for r in df.collect()}
    expected = set()
    for sensor in ("s0", "s1"):
        times = [t for t, s in held if s == sensor]
        moment = min(times)
        while moment <= max(times):
            if (moment, sensor) not in held:
                expected.add((moment, sensor))
            moment += timedelta(seconds=1)
    found = [tuple(r) for r in missing_buckets(df, 1000).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_lists(six_series):
    assert [r[0] for r in list_sensors(six_series).collect()] == ["quad_ch1", "quad_ch2", "quad_ch3"]
    assert [r[0] for r in list_sensors(six_series, "asset_009").collect()] == []
    assert [r[0] for r in list_assets(six_series).collect()] == ["asset_001", "asset_002"]
    both = list_union(list_assets(six_series), list_assets(six_series))
    assert both.count() == 2


def test_catalogues(six_series):
    assert series_catalog(six_series).count() == 6
    sensor = sensor_catalog(six_series).where("sensor_name = 'quad_ch1'").first()
    assert (sensor["asset_count"], sensor["data_count"]) == (2, 3600)
    assert sensor["last_seen"] == ts("2024-01-01T00:29:59")
    asset = asset_catalog(six_series).first()
    assert (asset["sensor_count"], asset["data_count"]) == (3, 5400)


def test_time_range(one_series):
    row = time_range_of(one_series, ["test_sensor"]).first()
    assert (row["start_time"], row["end_time"]) == (ts("2024-01-01"), ts("2024-01-01T00:59:59"))
    assert row["duration_hours"] == pytest.approx(3599 / 3600)
    row = time_range_of(one_series, granularity="hour").first()
    assert (row["end_time"], row["duration_hours"]) == (ts("2024-01-01"), 0.0)
    assert time_range_of(one_series, ["none"]).first()["start_time"] is None


def test_profile(one_series):
    row = series_profile(one_series, "pressure").first()
    assert (row["std_dev"], row["variability"]) == pytest.approx((0.0, 0.0), abs=1e-9)
    row = series_profile(one_series.withColumn("zero", F.lit(0.0)), "zero").first()
    assert row["variability"] is None


def test_density_and_estimates(one_series):
    row = series_density(one_series, MINUTE).first()
    assert row["points"] == 3600 and row["estimated_points"] == 59
    assert row["density_ms_per_point"] == pytest.approx(3_599_000 / 3600)
    row = recommend_intervals(one_series, 100).first()
    assert (row["recommended_interval_ms"], row["estimated_points"]) == (60_000, 59)
    row = estimate_and_actual(one_series, MINUTE).first()
    assert (row["estimated_points"], row["actual_points"]) == (59, 60)
