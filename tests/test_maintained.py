"""Catalogue and variability from stored rollups, after changes of the source."""

import pytest
from pyspark.sql import functions as F

from pulsegrid import RollupStore, rebuild_rollups
from pulsegrid.operators.catalog import list_assets, list_sensors, series_catalog, time_range_of
from pulsegrid.operators.partials import ALL_STATS, MOMENT, build_partials, merge_partials, sum_partials
from pulsegrid.operators.profile import series_profile
from pulsegrid.plans.catalog import stored_catalog, stored_time_range
from pulsegrid.plans.profile import stored_profile
from pulsegrid.session import delete_path, scratch_path
from pulsegrid.sources.readings import write_raw

HOUR, DAY = 3_600_000, 86_400_000


def canonical(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect())


def close(got, want):
    """Deviations to 1e-6, means of 1e9 to their last digits."""
    left, right = canonical(got), canonical(want)
    assert [r[:2] for r in left] == [r[:2] for r in right]
    for a, b in zip(left, right):
        assert a[2] == pytest.approx(b[2], abs=1e-6) and a[3] == pytest.approx(b[3], rel=1e-12)


@pytest.fixture(scope="module")
def days(spark):
    """Ten days of three sensors on two assets; values near 1e9 that spread by about 1."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return spark.range(12_000).select(
        (start + F.make_dt_interval(secs=F.col("id") * 71)).alias("timestamp"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("sensor_name"),
        F.concat(F.lit("a"), (F.col("id") % 2).cast("string")).alias("asset_id"),
        F.when(F.col("id") % 11 > 0, 1e9 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 300).alias("value"),
    )


@pytest.fixture
def changing(spark, days):
    store, path = RollupStore(spark, scratch_path(spark, "maintained")), scratch_path(spark, "days")
    late = (F.dayofmonth("timestamp") == 6) & (F.col("sensor_name") == "s1")
    write_raw(days.where(~late), path)
    rebuild_rollups(spark.read.parquet(path), store, moments=True)
    delete_path(spark, f"{path}/dt=2024-01-04")
    rebuild_rollups(spark.read.parquet(path), store, start="2024-01-04", end="2024-01-05", moments=True)
    write_raw(days.where(late), path, mode="append")
    return spark.read.parquet(path), store, days.where("dayofmonth(timestamp) <> 4")


def test_the_catalogue_follows_builds_deletes_and_late_readings(changing):
    raw, store, left = changing
    stored = stored_catalog(raw, store)
    assert canonical(stored) == canonical(series_catalog(left))
    assert canonical(list_sensors(stored)) == canonical(list_sensors(left))
    assert canonical(list_assets(stored)) == canonical(list_assets(left))
    assert canonical(stored_time_range(raw, store, granularity="hour")) == canonical(time_range_of(left, granularity="hour"))


def test_recorded_days_are_not_read_again(spark, changing):
    raw, store, _ = changing
    plan = stored_catalog(raw, store)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "value" not in line.split("PartitionFilters")[0]]
    readings = [line for line in plan.splitlines() if "FileScan" in line and "/days-" in line]
    # The day that changed, and what is later than the record.
    assert len(readings) == 2 and all("dt#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in readings)
    assert scans


def test_variability_from_day_rollups(changing):
    raw, store, left = changing
    close(stored_profile(raw, store, "value"), series_profile(left, "value"))
    close(stored_profile(raw, store, "value", ["s2"]), series_profile(left.where("sensor_name = 's2'"), "value"))


def test_rollups_without_moments_do_not_answer(spark, days):
    store = RollupStore(spark, scratch_path(spark, "plain"))
    rebuild_rollups(days, store)
    close(stored_profile(days, store, "value"), series_profile(days, "value"))


def test_moments_merge_without_losing_digits(days):
    direct = {tuple(r)[:2]: r["std_dev"] for r in series_profile(days, "value").collect()}
    partials = build_partials(days, 60_000, stats=(*ALL_STATS, MOMENT))
    for widths in ((), (HOUR,), (HOUR, DAY)):
        merged = partials
        for width in widths:
            merged = merge_partials(merged, width)
        for r in sum_partials(merged).collect():
            deviation = (r["value_m2"] / (r["value_cnt"] - 1)) ** 0.5
            assert deviation == pytest.approx(direct[r["sensor_name"], r["asset_id"]], abs=1e-6)
    none = build_partials(days.withColumn("value", F.lit(None).cast("double")), HOUR, stats=(*ALL_STATS, MOMENT))
    assert sum_partials(none).where("value_m2 IS NOT NULL").count() == 0
