import pytest
from pyspark.sql import functions as F

from pulsegrid import aggregated_query, normalize, query_series, raw_query
from pulsegrid.operators.filters import only_assets, only_sensors, time_range
from tests.conftest import ts

MINUTE, HOUR = 60_000, 3_600_000


def test_hour_at_one_minute(one_series):
    result = query_series(
        one_series, ["test_sensor"], "2024-01-01", "2024-01-01T01:00:00", interval_ms=MINUTE
    )
    rows = result.data.collect()
    assert len(rows) == 60 and not result.truncated and result.tier_used == "raw"
    assert [r["timestamp"] for r in rows] == sorted(r["timestamp"] for r in rows)


def test_interval_is_chosen_when_not_given(one_series):
    result = query_series(
        one_series, ["test_sensor"], "2024-01-01", "2024-01-01T01:00:00", max_points=100
    )
    assert result.interval_ms == 60_000
    assert result.data.count() == 60


def test_the_limit_truncates_and_is_reported(six_series):
    result = query_series(
        six_series, ["quad_ch1", "quad_ch2"], "2024-01-01", "2024-01-01T00:30:00",
        interval_ms=10_000, max_points=100,
    )
    assert result.truncated
    assert 0 < result.data.count() <= 100
    assert result.interval_ms > 10_000 and result.points == 720 and result.method == "avg"
    assert result.data.agg(F.max("timestamp")).first()[0] >= ts("2024-01-01T00:29:00")
    exact = query_series(
        six_series, ["quad_ch1"], "2024-01-01", "2024-01-01T00:30:00", ["asset_001"],
        interval_ms=60_000, max_points=30,
    )
    assert not exact.truncated and exact.data.count() == 30


@pytest.mark.parametrize(
    "start, end",
    [("2024-01-01T00:10:00Z", "2024-01-01T00:20:00Z"), ("2024-01-01T02:10:00+02:00", "2024-01-01T02:20:00+02:00")],
)
def test_request_times_may_carry_a_zone(one_series, start, end):
    result = query_series(one_series, ["test_sensor"], start, end, interval_ms=MINUTE)
    times = [r["timestamp"] for r in result.data.collect()]
    assert (times[0], times[-1]) == (ts("2024-01-01T00:10"), ts("2024-01-01T00:19"))


def test_the_leading_part_of_a_bucket_is_kept(one_series):
    result = query_series(
        one_series, ["test_sensor"], "2024-01-01T00:00:30", "2024-01-01T00:02:00",
        interval_ms=MINUTE, aggregation="count",
    )
    assert [(r["timestamp"], r["count"]) for r in result.data.collect()] == [
        (ts("2024-01-01T00:00"), 30),
        (ts("2024-01-01T00:01"), 60),
    ]


def test_the_range_is_half_open(readings):
    df = readings(
        [
            ("2023-12-31T23:59:59", "s", "a", 1.0, 0),
            ("2024-01-01T00:00:00", "s", "a", 2.0, 0),
            ("2024-01-02T00:00:00", "s", "a", 3.0, 0),
        ]
    )
    kept = time_range(df, "2024-01-01", "2024-01-02").collect()
    assert [r["value"] for r in kept] == [2.0]


@pytest.mark.parametrize(
    "start, end, expected",
    [
        ("2024-01-01T23:00:00", "2024-01-02T01:00:00", 2),
        ("2024-01-31T22:00:00", "2024-02-01T02:00:00", 4),
        ("2023-12-31T22:00:00", "2024-01-01T02:00:00", 4),
        ("2024-01-20", "2024-02-10", 504),
    ],
)
def test_ranges_over_day_month_and_year_ends(spark, start, end, expected):
    begin = F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(24 * 90).select(
        (begin + F.make_dt_interval(hours=F.col("id"))).alias("timestamp"),
        F.lit("s").alias("sensor_name"),
        F.lit("a").alias("asset_id"),
        F.lit(1.0).alias("value"),
    )
    result = query_series(df, ["s"], start, end, interval_ms=HOUR)
    assert result.data.count() == expected


def test_invalid_requests_are_errors(one_series):
    with pytest.raises(ValueError):
        query_series(one_series, ["s"], "2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        query_series(one_series, [], "2024-01-01", "2024-01-02")
    with pytest.raises(ValueError):
        query_series(one_series, ["s"], "2024-01-01", "2024-02-01", max_duration_hours=168)
    with pytest.raises(ValueError):
        query_series(one_series, ["s"], "2024-01-01", "2024-01-02", aggregation="mode")


def test_raw_query_returns_the_values_as_they_are(one_series):
    result = raw_query(one_series, ["test_sensor"], "2024-01-01", "2024-01-01T00:01:00")
    rows = result.data.collect()
    assert len(rows) == 60 and not result.truncated
    assert rows[3]["temperature"] == pytest.approx(25.03)
    assert "sensor_type" in result.data.columns and "sensor_name" not in result.data.columns


def test_raw_query_spreads_a_limit_over_the_range(six_series):
    args = (six_series, ["quad_ch1", "quad_ch2"], "2024-01-01", "2024-01-01T00:30:00")
    result = raw_query(*args, max_points=200)
    assert result.truncated and result.actual_end == ts("2024-01-01T00:30:00") and result.interval_ms > 1000
    assert 0 < result.data.count() <= 200
    assert result.data.agg(F.max("timestamp")).first()[0] >= ts("2024-01-01T00:29:00")
    assert raw_query(*args).data.count() == 1800 * 2 * 2


def test_rows_do_not_depend_on_how_series_are_named(six_series):
    args = (six_series, ["quad_ch1", "quad_ch2", "quad_ch3"], "2024-01-01", "2024-01-01T00:30:00")
    for limit in (None, 100_000, 500):
        plain = query_series(*args, interval_ms=1000, max_points=limit).data
        listed = query_series(*args, ["asset_001", "asset_002"], interval_ms=1000, max_points=limit).data
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, listed.collect()))
        assert plain.count() <= (limit or 10_800)


def test_aggregated_query_with_more_sensors_than_points(six_series):
    result = aggregated_query(
        six_series, ["quad_ch1", "quad_ch2", "quad_ch3"], "2024-01-01", "2024-01-01T00:30:00",
        max_points=2,
    )
    assert result.interval_ms == 1_800_000 and result.data.count() <= 2


def test_membership(spark, six_series):
    assert only_sensors(six_series, ["quad_ch1"]).count() == 3600
    assert only_sensors(six_series, None).count() == 10_800
    assert only_assets(six_series, []).count() == 10_800
    names = spark.createDataFrame([("quad_ch1",), ("quad_ch1",), (None,)], "name string")
    assert only_sensors(six_series, names).count() == 3600
    assert only_assets(six_series.drop("asset_id"), ["x"]).count() == 10_800


def test_normalize(spark):
    df = spark.createDataFrame(
        [("2024-01-01T00:00:00Z", 7, float("nan")), ("2024-01-01T02:00:00+02:00", 8, 1.0)],
        "timestamp string, daqid int, value double",
    )
    rows = normalize(df).collect()
    assert {r["timestamp"] for r in rows} == {ts("2024-01-01")}
    assert [r["asset_id"] for r in rows] == ["7", "8"]
    assert [r["value"] for r in rows] == [None, 1.0]
    kept = normalize(df.withColumn("asset_id", F.lit("own"))).first()
    assert kept["asset_id"] == "own"


def test_times_as_nanoseconds(spark):
    nanos = 1_704_067_200_123_456_789
    df = spark.createDataFrame([(nanos, 1.0), (-1, 2.0)], "timestamp long, value double")
    times = [r["timestamp"] for r in normalize(df).collect()]
    assert times == [ts("2024-01-01T00:00:00.123456"), ts("1969-12-31T23:59:59.999999")]


@pytest.mark.parametrize("cast", ["timestamp", "long", "string"])
def test_bounds_are_pushed_down_in_the_type_of_the_column(spark, one_series, tmp_path, cast):
    nanos = F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000
    moment = nanos if cast == "long" else F.col("timestamp").cast(cast)
    path = str(tmp_path / cast)
    one_series.withColumn("timestamp", moment).write.parquet(path)
    stored = spark.read.parquet(path)
    args = (["test_sensor"], "2024-01-01T00:10:00", "2024-01-01T00:20:00")
    result = query_series(stored, *args, interval_ms=MINUTE, max_points=None, fields=["humidity"])
    assert result.data.count() == 10
    if cast != "string":
        plan = result.data._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(timestamp," in plan and "LessThan(timestamp," in plan
