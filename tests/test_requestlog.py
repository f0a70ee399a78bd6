import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.requestlog import (
    key_totals,
    popular_keys,
    request_fingerprint,
    stale_keys,
    tier_usage,
    usage_summary,
)
from tests.conftest import ts

SCHEMA = "key string, timestamp timestamp_ntz, tier string, hit boolean, execution_ms double"


@pytest.fixture
def log(spark):
    rows = []
    for key, times, last in (("a", 10, "2024-01-02T12:00"), ("b", 5, "2024-01-01T10:00"), ("c", 15, "2024-01-02T11:00")):
        rows += [(key, ts(last), "raw", n % 2 == 0, 10.0) for n in range(times)]
    return spark.createDataFrame(rows, SCHEMA)


def test_popular_keys(log):
    assert [(r["key"], r["frequency"]) for r in popular_keys(log, 2).collect()] == [("c", 15), ("a", 10)]


def test_key_totals(log):
    assert tuple(key_totals(log).first()) == (3, 30, 2)


def test_stale_keys(log):
    assert [r["key"] for r in stale_keys(log, "2024-01-02T12:00:00", 24).collect()] == ["b"]


def test_usage(log):
    row = usage_summary(log).first()
    assert (row["total_queries"], row["cache_hits"]) == (30, 16)
    assert row["cache_hit_rate"] == pytest.approx(16 / 30)
    assert row["avg_execution_time_ms"] == 10.0
    assert tuple(usage_summary(log.limit(0)).first()) == (0, 0, 0.0, 0.0)
    assert [tuple(r) for r in tier_usage(log).collect()] == [("raw", 14)]


def test_fingerprint_ignores_the_order_of_lists(spark):
    def mark(sensors, limit):
        start = F.lit("2024-01-01").cast("timestamp_ntz")
        return request_fingerprint(
            F.array(*map(F.lit, sensors)), start, start, F.lit(None).cast("array<string>"),
            F.lit(1000), F.lit("avg"), F.lit(limit),
        )

    row = spark.range(1).select(mark(["a", "b"], 1), mark(["b", "a"], 1), mark(["a", "b"], 2)).first()
    assert row[0] == row[1] != row[2] and len(row[0]) == 32
