import pytest
from pyspark.sql import functions as F

from pulsegrid import RollupStore, query_series, rebuild_rollups, validate_rollups
from pulsegrid.operators.bucket import aggregate_by_interval
from pulsegrid.operators.partials import build_partials, finalize, merge_partials
from pulsegrid.plans.query import aggregated_query
from pulsegrid.session import scratch_path
from pulsegrid.sources.rollups import extract_statistic, rollup_view
from tests.conftest import ts

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
METHODS = ("avg", "min", "max", "first", "last", "sum", "count")


def canonical(df):
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect()
    )


@pytest.fixture(scope="module")
def month(spark):
    """Forty days of uneven readings over a year's end, a fifth of the values missing."""
    start = F.lit("2023-12-10 00:00:00").cast("timestamp_ntz")
    sensors = F.element_at(F.array(F.lit("s1"), F.lit("s2"), F.lit("s3")), (F.col("id") % 3 + 1).cast("int"))
    gap = F.col("id") * 331 + F.pmod(F.xxhash64("id"), F.lit(97))
    return spark.range(10_000).select(
        (start + F.make_dt_interval(secs=gap)).alias("timestamp"),
        sensors.alias("sensor_name"),
        F.concat(F.lit("00"), (F.col("id") % 2).cast("string")).alias("asset_id"),
        F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64(F.col("id") + 1), F.lit(1000)) / 8).alias("value"),
        F.col("id").alias("tie"),
    ).cache()


@pytest.fixture
def store(spark):
    return RollupStore(spark, scratch_path(spark, "test"), tie=["tie"])


@pytest.fixture(scope="module")
def built(spark, month):
    store = RollupStore(spark, scratch_path(spark, "test"), tie=["tie"])
    rebuild_rollups(month, store)
    return store


@pytest.mark.parametrize("method", METHODS)
def test_days_from_minutes_equal_days_from_readings(month, method):
    minutes = build_partials(month, MINUTE, fields=["value"], tie=["tie"])
    merged = finalize(merge_partials(merge_partials(minutes, HOUR), DAY), method)
    direct = aggregate_by_interval(month, DAY, method, fields=["value"], tie=["tie"])
    assert canonical(merged) == canonical(direct)


@pytest.mark.parametrize("grain, width", [("1m", MINUTE), ("1h", HOUR), ("1d", DAY)])
def test_stored_grains_equal_the_readings(built, month, grain, width):
    for method in ("avg", "last", "count"):
        stored = finalize(built.read(grain), method)
        direct = aggregate_by_interval(month, width, method, fields=["value"], tie=["tie"])
        assert canonical(stored) == canonical(direct)


def test_numeric_looking_assets_stay_text(spark, month):
    store = RollupStore(
        spark, scratch_path(spark, "test"), tie=["tie"], partition_by=("asset_id", "dt")
    )
    rebuild_rollups(month, store, grains=["1d"])
    assert {r[0] for r in store.read("1d").select("asset_id").distinct().collect()} == {"000", "001"}
    direct = aggregate_by_interval(month, DAY, "avg", fields=["value"], tie=["tie"])
    stored = finalize(store.read("1d"), "avg").select(*direct.columns)
    assert canonical(stored) == canonical(direct)


def test_rebuilding_twice_or_in_part_changes_nothing(store, month):
    rebuild_rollups(month, store)
    before = {g: canonical(finalize(store.read(g), "avg")) for g in ("1m", "1h", "1d")}
    rebuild_rollups(month, store, ["s1"])
    rebuild_rollups(month, store, start="2023-12-30T05:00:00Z", end="2024-01-02T07:00:00Z")
    rebuild_rollups(month, store, ["s2"], start="2024-01-10T23:30:00", end="2024-01-11T01:00:00")
    rebuild_rollups(month, store)
    assert {g: canonical(finalize(store.read(g), "avg")) for g in ("1m", "1h", "1d")} == before


def test_a_partial_rebuild_takes_up_late_readings(store, month):
    late = F.col("timestamp").between("2024-01-01 10:00:00", "2024-01-01 10:40:00")
    rebuild_rollups(month.where(~late), store)
    rebuild_rollups(month, store, start="2024-01-01", end="2024-01-02")
    direct = aggregate_by_interval(month, HOUR, "sum", fields=["value"], tie=["tie"])
    assert canonical(finalize(store.read("1h"), "sum")) == canonical(direct)


def test_read_prunes_partitions(built):
    plan = built.read("1m", ["s1"], "2024-01-01", "2024-01-02")._jdf.queryExecution().toString()
    scan = plan[plan.index("Physical Plan"):]
    assert "PartitionFilters: [isnotnull(dt" in scan
    assert "GreaterThanOrEqual(bucket" in scan and "EqualTo(sensor_name,s1)" in scan


def test_rollup_view_and_extraction(built, month):
    view = rollup_view(built.read("1h"))
    assert view.columns == [
        "time_bucket", "sensor_name", "asset_id", "value_mean", "value_min", "value_max",
        "timestamp_first",
    ]
    for stat, method in (("mean", "avg"), ("min", "min"), ("max", "max")):
        direct = aggregate_by_interval(month, HOUR, method, fields=["value"]).dropna(subset=["value"])
        assert canonical(extract_statistic(view, stat)) == canonical(direct)
    renamed = view.withColumnRenamed("time_bucket", "hour_bucket")
    assert "timestamp" in extract_statistic(renamed, "mean").columns
    with pytest.raises(ValueError):
        extract_statistic(view, "median")


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize(
    "start, end, interval, tier",
    [
        ("2023-12-12", "2024-01-15", DAY, "1h"),
        ("2023-12-12T05:17:33", "2024-01-15T21:44:10", 6 * HOUR, "1h"),
        ("2023-12-30T00:00:10", "2024-01-02T00:00:00", HOUR, "1m"),
        ("2023-12-30T00:00:10", "2024-01-02T00:00:00", 90_000, "raw"),
        ("2024-01-01", "2024-01-02", HOUR, "raw"),
    ],
)
def test_every_tier_answers_like_the_readings(built, month, method, start, end, interval, tier):
    query = dict(interval_ms=interval, aggregation=method, max_points=None, fields=["value"], tie=["tie"])
    routed = query_series(month, ["s1", "s2"], start, end, ["000"], store=built, **query)
    direct = query_series(month, ["s1", "s2"], start, end, ["000"], **query)
    assert (routed.tier_used, direct.tier_used) == (tier, "raw")
    assert canonical(routed.data) == canonical(direct.data)
    assert direct.data.count() > 0


def test_a_rollup_answers_as_far_as_it_is_complete(store, month):
    """Readings after the recorded end come from the readings themselves."""
    options = dict(interval_ms=DAY, aggregation="count", max_points=None, tie=["tie"])
    query = (["s1"], "2023-12-10", "2024-01-05")
    direct = canonical(query_series(month, *query, **options).data)
    assert query_series(month, *query, store=store, **options).tier_used == "raw"
    early = month.where("timestamp < '2023-12-25 10:00:30'")
    rebuild_rollups(early, store)
    result = query_series(month, *query, store=store, **options)
    assert result.tier_used == "1h" and canonical(result.data) == direct
    rebuild_rollups(month, store, start="2024-01-01", end="2024-01-06")
    gap = query_series(month, *query, store=store, **options)
    assert gap.tier_used == "1h" and canonical(gap.data) == direct
    uncovered = query_series(month, ["s1"], "2023-12-26", "2024-01-05", store=store, **options)
    assert uncovered.tier_used == "raw"
    rebuild_rollups(month, store, start="2023-12-25", end="2024-01-01")
    assert canonical(query_series(month, *query, store=store, **options).data) == direct


def test_fallback_where_the_readings_are_gone(built, month):
    gone = month.where("false")
    for raw in (gone, None):
        result = query_series(
            raw, ["s1"], "2024-01-01", "2024-01-01T12:00:00", interval_ms=HOUR,
            max_points=None, store=built, fields=["value"],
        )
        assert result.tier_used == "1m"
        direct = query_series(
            month, ["s1"], "2024-01-01", "2024-01-01T12:00:00", interval_ms=HOUR,
            max_points=None, fields=["value"], tie=["tie"],
        )
        assert canonical(result.data) == canonical(direct.data)
    nothing = query_series(gone, ["s1"], "2030-01-01", "2030-01-02", store=built, fields=["value"])
    assert nothing.tier_used == "none" and nothing.data.count() == 0


def test_aggregated_query_uses_the_coarsest_rollup(built, month):
    result = aggregated_query(
        month, ["s1", "s2", "s3"], "2023-12-11", "2024-01-10", DAY, "mean",
        max_points=None, store=built, fields=["value"], tie=["tie"],
    )
    assert result.tier_used == "1d"
    assert "sensor_type" in result.data.columns
    direct = aggregated_query(
        month, ["s1", "s2", "s3"], "2023-12-11", "2024-01-10", DAY, "mean",
        max_points=None, fields=["value"], tie=["tie"],
    )
    assert canonical(result.data) == canonical(direct.data)


def test_coverage_of_rollups(built, month):
    rows = validate_rollups(month, built, ["s1"], raw_interval_ms=HOUR).collect()
    assert {r["tier"] for r in rows} == {"raw", "1m", "1h", "1d"}
    by_tier = {(r["tier"], r["asset_id"]): r for r in rows}
    day = by_tier["1d", "000"]
    assert day["observed"] == day["expected"] and day["coverage"] == 1.0 and day["ok"]
    assert not by_tier["1m", "000"]["ok"]


def test_a_tier_that_is_missing_fails(store, month):
    rebuild_rollups(month, store, grains=["1h"])
    shorter = month.where("timestamp > '2024-01-01'")
    rows = validate_rollups(shorter, store, ["s1"], raw_interval_ms=HOUR).collect()
    assert all(r["coverage"] <= 1 for r in rows)
    assert {r["tier"] for r in rows if r["coverage"] == 0} == {"1m", "1d"}
    assert not any(r["ok"] for r in rows if r["tier"] in ("1m", "1d"))


def test_days_built_one_by_one_answer_together(store, month):
    days = ["2023-12-28", "2023-12-29", "2023-12-30", "2023-12-31", "2024-01-01"]
    for start, end in zip(days, days[1:]):
        # Only what had arrived by then.
        rebuild_rollups(month.where(f"timestamp < '{end}'"), store, start=start, end=end, grains=["1h"])
    query = (["s1"], days[0], "2023-12-31")
    options = dict(interval_ms=DAY, aggregation="count", tie=["tie"])
    assert store.covered_until("1h", ts(days[0])) > ts("2023-12-31")
    routed = query_series(month, *query, store=store, **options)
    assert canonical(routed.data) == canonical(query_series(month, *query, **options).data)


def test_what_was_built_otherwise_does_not_answer(store, month):
    twice = month.unionByName(month)
    rebuild_rollups(twice, store, grains=["1h"])
    query = (["s1"], "2023-12-12", "2024-01-14")
    options = dict(interval_ms=DAY, aggregation="sum", tie=["tie"], fields=["value"])
    direct = canonical(query_series(month, *query, **options).data)
    result = query_series(twice, *query, store=store, dedup=True, **options)
    assert result.tier_used == "raw" and canonical(result.data) == direct
    rebuild_rollups(month, store, grains=["1h"])
    rebuild_rollups(month, store, start="2023-12-20", end="2023-12-22", grains=["1h"], fields=["other"] if "other" in month.columns else [])
    result = query_series(month, *query, store=store, **options)
    assert canonical(result.data) == direct


def test_days_that_are_gone_leave_the_rollup(store, month):
    rebuild_rollups(month, store, grains=["1m", "1h"])
    left = month.where("to_date(timestamp) <> DATE'2024-01-02'")
    rebuild_rollups(left, store, grains=["1m", "1h"])
    assert store.read("1m", None, "2024-01-02", "2024-01-03").count() == 0
    assert store.read("1h", None, "2024-01-02", "2024-01-03").count() == 0


def test_readings_that_expired_are_answered_from_the_rollup(built, month):
    query = (["s1"], "2024-01-02T12:00:00", "2024-01-03T12:00:00")
    options = dict(interval_ms=HOUR, aggregation="avg", fields=["value"], tie=["tie"])
    left = month.where("timestamp >= '2024-01-03'")
    whole = query_series(month, *query, **options)
    assert canonical(query_series(left, *query, store=built, **options).data) == canonical(whole.data)


def test_a_rollup_alone_must_cover_the_range(store, month):
    rebuild_rollups(month, store, start="2023-12-20", end="2023-12-23")
    options = dict(interval_ms=HOUR, store=store, fields=["value"])
    assert query_series(None, ["s1"], "2023-12-20", "2023-12-23", **options).tier_used == "1m"
    with pytest.raises(ValueError):
        query_series(None, ["s1"], "2023-12-20", "2023-12-24", **options)


def test_copies_are_removed_on_request(store, month):
    twice = month.unionByName(month)
    rebuild_rollups(twice, store, dedup=True)
    for method in ("count", "sum"):
        direct = aggregate_by_interval(month, HOUR, method, fields=["value"], tie=["tie"])
        assert canonical(finalize(store.read("1h"), method)) == canonical(direct)
    args = (["s1"], "2023-12-12T05:17:33", "2024-01-15T21:44:10")
    options = dict(interval_ms=HOUR, aggregation="count", max_points=None, tie=["tie"])
    once = query_series(month, *args, **options)
    routed = query_series(twice, *args, store=store, dedup=True, **options)
    assert routed.tier_used == "1h"
    assert canonical(routed.data) == canonical(once.data)
    doubled = query_series(twice, *args, **options)
    assert sum(r["count"] for r in doubled.data.collect()) == 2 * sum(r["count"] for r in once.data.collect())


def test_coverage_record(store):
    def day(number):
        return ts(f"2024-01-{number:02d}")

    def until(grain, number):
        return store.covered_until(grain, day(number))

    assert until("1m", 1) is None
    store.mark_covered(["1m", "1h"], day(1), day(5), store.build(["value"], False))
    store.mark_covered(["1m"], day(8), day(10), store.build(["value"], False))
    assert until("1m", 1) == until("1m", 4) == day(5) and until("1m", 8) == day(10)
    assert until("1m", 5) is None and until("1h", 8) is None
    store.mark_covered(["1m"], day(4), day(8), store.build(["value"], False))
    assert until("1m", 1) == day(10) and until("1m", 10) is None
    assert len(store.covered()) == 2
    assert store.covered_until("1m", day(1), ["value"], dedup=True) is None
    assert store.covered_until("1m", day(1), ["other"]) is None
    store.forget(["1m"], day(3), day(4))
    assert until("1m", 1) == day(3) and until("1m", 3) is None and until("1m", 4) == day(10)


def test_coverage_ends_with_the_readings(store, month):
    rebuild_rollups(month, store, start="2023-12-10", end="2030-01-01")
    last = month.agg(F.max("timestamp")).first()[0]
    minute = last.replace(second=0, microsecond=0)
    assert store.covered_until("1h", ts("2023-12-10")) == minute
    assert store.covered_until("1h", ts("2020-01-01")) is None
    rebuild_rollups(month, store)
    assert store.covered_until("1h", ts("2020-01-01")) == minute
