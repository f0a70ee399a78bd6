import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Workers import the package too.
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pulsegrid import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__driver__memory="8g",
        spark__sql__maxMetadataStringLength="5000",
        spark__sql__debug__maxToStringFields="500",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture
def readings(spark):
    """Readings from (time, sensor, asset, value, tie) rows."""

    def make(rows, columns="timestamp timestamp_ntz, sensor_name string, asset_id string, value double, tie long"):
        typed = [(ts(row[0]) if isinstance(row[0], str) else row[0], *row[1:]) for row in rows]
        return spark.createDataFrame(typed, columns)

    return make


@pytest.fixture(scope="session")
def one_series(spark):
    """One hour at 1 Hz of one sensor with three fields."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return spark.range(3600).select(
        (start + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
        F.lit("test_sensor").alias("sensor_name"),
        F.lit("asset_001").alias("asset_id"),
        (25 + 0.01 * F.col("id")).alias("temperature"),
        (60 + 0.005 * F.col("id")).alias("humidity"),
        F.lit(1013.25).alias("pressure"),
    )


@pytest.fixture(scope="session")
def six_series(spark):
    """Half an hour at 1 Hz of three sensors on two assets."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    sensors = F.explode(F.array(*[F.lit(f"quad_ch{n}") for n in (1, 2, 3)]))
    assets = F.explode(F.array(F.lit("asset_001"), F.lit("asset_002")))
    return (
        spark.range(1800)
        .select("id", sensors.alias("sensor_name"))
        .select("id", "sensor_name", assets.alias("asset_id"))
        .select(
            (start + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
            "sensor_name",
            "asset_id",
            (0.1 * F.col("id") + F.substring("sensor_name", -1, 1).cast("int")).alias("value"),
        )
    )
