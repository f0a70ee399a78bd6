"""Tiered reads where the source has changed since the rollups were built."""

import pytest
from pyspark.sql import functions as F

from pulsegrid import RollupStore, query_series, rebuild_rollups
from pulsegrid.plans.routing import IncompleteRange
from pulsegrid.session import scratch_path
from pulsegrid.sources.ledger import merged, source_state, without
from tests.conftest import ts

HOUR, DAY = 3_600_000, 86_400_000
OPTIONS = dict(aggregation="sum", fields=["value"], tie=["tie"])


def canonical(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect())


@pytest.fixture(scope="module")
def days(spark):
    """Twelve days of two sensors, a row a minute each, in a file a day."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.range(12 * 1440 * 2).select(
        (start + F.make_dt_interval(mins=F.floor(F.col("id") / 2).cast("int"))).alias("timestamp"),
        F.concat(F.lit("s"), (F.col("id") % 2 + 1).cast("string")).alias("sensor_name"),
        F.lit("a").alias("asset_id"),
        (F.col("id") % 97).cast("double").alias("value"),
        F.col("id").alias("tie"),
    )
    path = scratch_path(spark, "days")
    for day in range(1, 13):
        rows.where(f"dayofmonth(timestamp) = {day}").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def store(spark):
    return RollupStore(spark, scratch_path(spark, "routing"), tie=["tie"])


def both(raw, whole, store, sensors, start, end, interval, **more):
    routed = query_series(raw, sensors, start, end, interval_ms=interval, store=store, **OPTIONS, **more)
    direct = query_series(whole, sensors, start, end, interval_ms=interval, **OPTIONS)
    return routed, canonical(routed.data) == canonical(direct.data)


def test_an_unchanged_source_is_not_read_again(days, store):
    rebuild_rollups(days, store)
    routed, same = both(days, days, store, ["s1"], "2024-01-02", "2024-01-12", DAY)
    assert same and routed.tier_used == "1h"
    files = [f for f in routed.data.inputFiles() if "/days-" in f]
    assert files == []


def test_late_readings_in_a_recorded_span_are_answered(spark, days, store):
    path = scratch_path(spark, "late")
    late = F.dayofmonth("timestamp") == 4
    days.where(~late | (F.minute("timestamp") < 5)).write.parquet(path)
    rebuild_rollups(spark.read.parquet(path), store)
    days.where(late & (F.minute("timestamp") >= 5)).write.mode("append").parquet(path)
    changed = spark.read.parquet(path)
    spans = store.spans("1h", ts("2024-01-01"), ts("2024-01-12"))
    assert store.ledger.doubtful(changed, spans) == [(ts("2024-01-04"), ts("2024-01-05"))]
    for interval, tier in ((DAY, "1h"), (HOUR, "1h"), (90_000, "raw")):
        routed, same = both(changed, days, store, ["s1", "s2"], "2024-01-02", "2024-01-12", interval)
        assert same and routed.tier_used == tier
    rebuild_rollups(changed, store, start="2024-01-04", end="2024-01-05")
    assert store.ledger.doubtful(changed, store.spans("1h", ts("2024-01-01"), ts("2024-01-12"))) == []
    assert both(changed, days, store, ["s1", "s2"], "2024-01-02", "2024-01-12", DAY)[1]


def test_another_definition_of_the_source_is_noticed(days, store):
    rebuild_rollups(days.where("value > 50"), store)
    assert both(days, days, store, ["s1"], "2024-01-02", "2024-01-12", DAY)[1]


def test_sources_without_files_are_always_asked(spark, days, store):
    two = days.unionByName(days.where("false"))
    assert source_state(two).files is None
    late = F.dayofmonth("timestamp") == 7
    rebuild_rollups(two.where(~late), store)
    assert both(two, days, store, ["s2"], "2024-01-01", "2024-01-12", DAY)[1]


def test_one_sensor_has_expired_and_another_not(days, store):
    rebuild_rollups(days, store)
    left = days.where("sensor_name <> 's1' OR timestamp >= '2024-01-06'")
    for sensors in (["s1"], ["s1", "s2"]):
        assert both(left, days, store, sensors, "2024-01-05T12:00:00", "2024-01-06T12:00:00", HOUR)[1]
        assert both(left, days, store, sensors, "2024-01-03", "2024-01-11", DAY)[1]


def test_expired_and_late_at_once(days, store):
    rebuild_rollups(days.where("dayofmonth(timestamp) <> 9"), store)
    left = days.where("timestamp >= '2024-01-06 10:30:00'")
    assert both(left, days, store, ["s1", "s2"], "2024-01-02", "2024-01-12", DAY)[1]


def test_an_edge_that_nothing_answers_for_is_named(days, store):
    rebuild_rollups(days, store, grains=["1m", "1h"])
    store.forget(["1m"], ts("0001-01-01"), ts("9999-01-01"))
    left = days.where("timestamp >= '2024-01-06'")
    query = (["s1"], "2024-01-05T12:30:00", "2024-01-06T13:00:00")
    with pytest.raises(IncompleteRange) as error:
        query_series(left, *query, interval_ms=HOUR, store=store, **OPTIONS)
    assert error.value.gaps == ((ts("2024-01-05T12:30"), ts("2024-01-05T13:00")),)
    routed = query_series(left, *query, interval_ms=HOUR, store=store, allow_gaps=True, **OPTIONS)
    direct = query_series(days, ["s1"], "2024-01-05T13:00:00", query[2], interval_ms=HOUR, **OPTIONS)
    assert canonical(routed.data) == canonical(direct.data) and routed.data.count() == 24
    assert routed.uncovered == error.value.gaps
    # With minutes the same query has no gap.
    rebuild_rollups(days, store)
    assert both(left, days, store, *query, HOUR)[1]


def test_a_rollup_of_some_days_alone_raises_or_says_so(days, store):
    rebuild_rollups(days, store, start="2024-01-01", end="2024-01-04")
    empty = days.where("false")
    query = (["s1"], "2024-01-01", "2024-01-12")
    for raw in (empty, None):
        with pytest.raises(IncompleteRange):
            query_series(raw, *query, interval_ms=HOUR, store=store, **OPTIONS)
        result = query_series(raw, *query, interval_ms=HOUR, store=store, allow_gaps=True, **OPTIONS)
        assert result.data.count() == 72 and result.uncovered == ((ts("2024-01-04"), ts("2024-01-12")),)


def test_a_range_before_the_first_reading_is_no_gap(days, store):
    rebuild_rollups(days, store, start="2024-01-03", end="2024-01-06")
    assert both(days, days, store, ["s1"], "2023-12-20", "2024-01-12", DAY)[1]


def test_the_record_survives_builds_at_the_same_time(spark, store, monkeypatch):
    build = store.build(["value"], False)
    store.mark_covered(["1h"], ts("2024-01-01"), ts("2024-01-02"), build)
    latest, once = type(store)._latest, []

    def slow(self):
        found = latest(self)
        if not once:
            once.append(1)
            store.mark_covered(["1m"], ts("2024-01-05"), ts("2024-01-06"), build)
        return found

    monkeypatch.setattr(type(store), "_latest", slow)
    store.mark_covered(["1h"], ts("2024-01-03"), ts("2024-01-04"), build)
    assert len(store.covered()) == 3


def test_spans():
    a, b, c, d = (ts(f"2024-01-0{n}") for n in (1, 2, 3, 4))
    assert merged([(c, d), (a, b), (b, c)]) == [(a, d)]
    assert without([(a, d)], [(b, c)]) == [(a, b), (c, d)]
    assert without([(a, b)], [(a, d)]) == [] and without([(a, b)], []) == [(a, b)]
