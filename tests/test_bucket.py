import random

import pytest
from pyspark.sql import functions as F

from pulsegrid import normalize
from pulsegrid.operators.bucket import aggregate_by_interval, preaggregate
from pulsegrid.operators.partials import METHODS, resolve_method
from pulsegrid.schema import drop_null_keys, numeric_fields
from tests.conftest import ts

MINUTE, HOUR = 60_000, 3_600_000


def rows(df, *columns):
    return sorted(tuple(row[c] for c in columns) for row in df.collect())


def test_minute_average_of_an_hour_at_1_hz(one_series):
    out = aggregate_by_interval(one_series, MINUTE, "avg").orderBy("timestamp").collect()
    assert len(out) == 60
    assert out[0]["timestamp"] == ts("2024-01-01")
    assert out[0]["temperature"] == pytest.approx(25 + 0.01 * 29.5)


def test_minimum_is_not_above_maximum(one_series):
    low = aggregate_by_interval(one_series, 5 * MINUTE, "min").alias("low")
    high = aggregate_by_interval(one_series, 5 * MINUTE, "max").alias("high")
    assert low.count() == high.count() == 12
    both = low.join(high, ["timestamp", "sensor_name", "asset_id"])
    assert both.where("low.temperature > high.temperature").count() == 0


@pytest.mark.parametrize("method", METHODS)
def test_every_method_has_rows_and_a_timestamp(one_series, method):
    out = aggregate_by_interval(one_series, MINUTE, method)
    assert out.count() == 60
    assert "timestamp" in out.columns


def test_mean_is_avg_and_unknown_methods_are_errors():
    assert resolve_method("mean") == resolve_method("AVG") == "avg"
    with pytest.raises(ValueError):
        resolve_method("median")


def test_missing_values_are_skipped(readings):
    df = normalize(
        readings(
            [
                ("2024-01-01T00:00:01", "s", "a", float("nan"), 0),
                ("2024-01-01T00:00:02", "s", "a", None, 0),
                ("2024-01-01T00:00:03", "s", "a", 4.0, 0),
                ("2024-01-01T00:01:00", "s", "a", float("nan"), 0),
            ]
        )
    )

    def values(method):
        out = aggregate_by_interval(df, MINUTE, method, tie=["tie"]).orderBy("timestamp")
        return [row["value"] for row in out.collect()]

    assert values("avg") == values("min") == values("max") == [4.0, None]
    assert values("first") == values("last") == [4.0, None]
    assert values("sum") == [4.0, 0.0]
    counted = aggregate_by_interval(df, MINUTE, "count", tie=["tie"]).orderBy("timestamp")
    assert [row["count"] for row in counted.collect()] == [3, 1]
    assert "value" not in counted.columns


def test_rows_without_a_key_are_left_out(readings):
    df = readings(
        [
            ("2024-01-01T00:00:01", "s", "a", 1.0, 0),
            ("2024-01-01T00:00:01", None, "a", 2.0, 0),
            ("2024-01-01T00:00:01", "s", None, 3.0, 0),
            (None, "s", "a", 4.0, 0),
        ]
    )
    assert drop_null_keys(df).count() == 1
    out = aggregate_by_interval(df, MINUTE, "sum", tie=["tie"]).collect()
    assert [row["value"] for row in out] == [1.0]


def test_first_and_last_take_each_field_by_itself(readings):
    df = readings(
        [
            ("2024-01-01T00:00:01", "s", "a", None, 5.0, 1),
            ("2024-01-01T00:00:02", "s", "a", 2.0, 6.0, 2),
            ("2024-01-01T00:00:03", "s", "a", 3.0, None, 3),
        ],
        "timestamp timestamp_ntz, sensor_name string, asset_id string, x double, y double, tie long",
    )
    first = aggregate_by_interval(df, MINUTE, "first", tie=["tie"]).first()
    last = aggregate_by_interval(df, MINUTE, "last", tie=["tie"]).first()
    assert (first["x"], first["y"]) == (2.0, 5.0)
    assert (last["x"], last["y"]) == (3.0, 6.0)


@pytest.mark.parametrize("wide", [False, True])
def test_several_ties_order_like_their_columns(spark, wide):
    rng = random.Random(7)
    pick = [None, -(1 << 62), 1 << 62] if wide else [None, -5, 0, 7]
    at = [ts("2024-01-01"), ts("2024-01-01T00:00:10")]
    data = [(rng.choice(at), "s", "a", float(i), rng.choice(pick), rng.choice([None, 1, 2]), i) for i in range(200)]
    df = spark.createDataFrame(data, "timestamp timestamp_ntz, sensor_name string, asset_id string, value double, a long, b int, c int")
    order = sorted(data, key=lambda r: (r[0], *[(v is not None, v or 0) for v in r[4:]]))
    for method, row in (("first", order[0]), ("last", order[-1])):
        out = aggregate_by_interval(df, MINUTE, method, fields=["value"], tie=["a", "b", "c"])
        assert [r["value"] for r in out.collect()] == [row[3]]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("SortAggregate" in plan) == wide
    none = aggregate_by_interval(df.limit(0), MINUTE, "last", fields=["value"], tie=["a", "b", "c"])
    assert none.collect() == []


@pytest.mark.parametrize("tie", [["tie"], ["label"]])
def test_equal_times_are_ordered_by_the_tie(readings, tie):
    df = readings(
        [
            ("2024-01-01T00:00:01", "s", "a", 1.0, 7, "7"),
            ("2024-01-01T00:00:01", "s", "a", 2.0, -3, "1"),
            ("2024-01-01T00:00:01", "s", "a", 3.0, 9, "9"),
        ],
        "timestamp timestamp_ntz, sensor_name string, asset_id string, value double, tie long, label string",
    )
    first = aggregate_by_interval(df, MINUTE, "first", fields=["value"], tie=tie).first()
    last = aggregate_by_interval(df, MINUTE, "last", fields=["value"], tie=tie).first()
    assert (first["value"], last["value"]) == (2.0, 3.0)


def test_buckets_start_at_multiples_since_the_epoch(readings):
    df = readings([("2024-01-01T00:00:00", "s", "a", 1.0, 0)])
    out = aggregate_by_interval(df, 6_048_000, "avg", tie=["tie"]).first()
    assert out["timestamp"] == ts("2023-12-31T23:45:36")
    early = readings([("1969-12-31T23:59:59", "s", "a", 1.0, 0)])
    out = aggregate_by_interval(early, MINUTE, "avg", tie=["tie"]).first()
    assert out["timestamp"] == ts("1969-12-31T23:59:00")


def test_first_timestamp_of_the_bucket(readings):
    df = readings(
        [
            ("2024-01-01T00:00:41", "s", "a", 1.0, 0),
            ("2024-01-01T00:00:07", "s", "a", 2.0, 0),
        ]
    )
    out = aggregate_by_interval(df, MINUTE, "avg", tie=["tie"], first_ts=True).first()
    assert out["first_ts"] == ts("2024-01-01T00:00:07")


def test_keys_are_those_the_frame_has(six_series):
    by_sensor = aggregate_by_interval(six_series.drop("asset_id"), HOUR, "count")
    assert rows(by_sensor, "sensor_name", "count") == [(f"quad_ch{n}", 3600) for n in (1, 2, 3)]
    overall = aggregate_by_interval(six_series.drop("asset_id", "sensor_name"), HOUR, "count")
    assert rows(overall, "count") == [(10_800,)]


def test_only_numbers_are_fields(spark):
    df = spark.sql(
        "SELECT 1 AS a, 2.5D AS b, 3.25 AS c, true AS d, 'x' AS e, INTERVAL 1 DAY AS f, 1 AS sensor_name"
    )
    assert numeric_fields(df) == ["a", "b", "c"]


def test_without_numbers_the_first_values_are_kept(readings):
    df = readings(
        [
            ("2024-01-01T00:00:02", "s", "a", "late"),
            ("2024-01-01T00:00:01", "s", "a", None),
            ("2024-01-01T00:00:01.500", "s", "a", "early"),
        ],
        "timestamp timestamp_ntz, sensor_name string, asset_id string, note string",
    )
    assert rows(aggregate_by_interval(df, MINUTE), "note") == [("early",)]


def test_a_method_for_each_field(one_series):
    methods = {"temperature": "max", "humidity": "min"}
    out = aggregate_by_interval(one_series, HOUR, methods, fields=list(methods)).first()
    assert out["temperature"] == pytest.approx(60.99)
    assert out["humidity"] == pytest.approx(60.0)


def test_preaggregate_has_mean_minimum_and_maximum(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(7200).select(
        (start + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
        F.lit("s").alias("sensor_name"),
        F.lit("a").alias("asset_id"),
        (F.col("id") % 60).cast("double").alias("temperature"),
    )
    out = preaggregate(df)
    assert out.count() == 120
    assert len([c for c in out.columns if "temperature" in c]) == 3
    assert rows(out.limit(1), "temperature", "temperature_min", "temperature_max") == [
        (29.5, 0.0, 59.0)
    ]


def test_empty_input_gives_an_empty_result_with_a_schema(one_series):
    out = aggregate_by_interval(one_series.limit(0), MINUTE)
    assert out.count() == 0
    assert out.columns[:3] == ["timestamp", "sensor_name", "asset_id"]
