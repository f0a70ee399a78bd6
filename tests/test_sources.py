import os

import pytest
from pyspark.sql import functions as F

from pulsegrid import normalize
from pulsegrid.functions.paths import asset_of, hour_of, sensor_of
from pulsegrid.functions.time import iso8601, json_records
from pulsegrid.sources.inventory import count_files, file_inventory, file_time_range
from pulsegrid.sources.quarantine import list_files, quarantine
from pulsegrid.sources.readings import (
    listing_glob,
    read_hourly_tree,
    read_parquet,
    read_raw,
    read_rollup_tree,
    read_series,
    union_sources,
    write_raw,
)
from pulsegrid.sources.rollups import extract_statistic
from tests.conftest import ts


@pytest.fixture
def tree(spark, tmp_path):
    """The hourly layout: one file per asset, hour and sensor."""
    for path, moment in (
        ("asset_001/2024/01/01/00/test_sensor.parquet", "2024-01-01T00:10:00"),
        ("asset_001/2024/01/01/01/test_sensor.parquet", "2024-01-01T01:10:00"),
        ("asset_001/2024/01/31/23/quad_ch1_20240131_23.parquet", "2024-01-31T23:10:00"),
        ("asset_002/2024/01/01/00/temp_sensor.parquet", "2024-01-01T00:20:00"),
        ("asset_002/2024/02/05/00/temp_sensor.parquet", "2024-02-05T00:20:00"),
    ):
        target = tmp_path / "tree" / path
        os.makedirs(target.parent)
        df = spark.createDataFrame([(ts(moment), 1.0)], "timestamp timestamp_ntz, value double")
        df.toPandas().to_parquet(target)
    return str(tmp_path / "tree")


def names(df):
    return sorted((r["asset_id"], r["sensor_name"], r["timestamp"]) for r in df.collect())


def test_hourly_tree(spark, tree):
    assert len(names(read_hourly_tree(spark, tree))) == 5
    one = read_hourly_tree(spark, tree, ["test_sensor"], "2024-01-01T00:05:00", "2024-01-01T01:00:00")
    assert names(one) == [("asset_001", "test_sensor", ts("2024-01-01T00:10"))]
    over_month = read_hourly_tree(spark, tree, None, "2024-01-20", "2024-02-10")
    assert [row[1] for row in names(over_month)] == ["quad_ch1", "temp_sensor"]
    assert [row[0] for row in names(read_hourly_tree(spark, tree, assets=["asset_002"]))] == ["asset_002"] * 2


def test_hourly_tree_scans_only_matching_files(spark, tree):
    df = read_hourly_tree(spark, tree, ["temp_sensor"], "2024-01-01", "2024-01-02")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def visit(node):
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            found.append(metrics.apply("numFiles").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(plan)
    assert found == [1]


@pytest.mark.parametrize(
    "path, sensor, asset, hour",
    [
        ("/d/asset_001/2024/01/31/23/quad_ch1_20240131_23.parquet", "quad_ch1", "asset_001", "2024-01-31T23:00"),
        ("/d/asset_001/2024/01/01/00/test_sensor.parquet", "test_sensor", "asset_001", "2024-01-01T00:00"),
        ("/d/plain.parquet", "plain", None, None),
    ],
)
def test_path_columns(spark, path, sensor, asset, hour):
    p = F.lit(path)
    row = spark.range(1).select(sensor_of(p), asset_of(p), hour_of(p)).first()
    assert tuple(row) == (sensor, asset, ts(hour) if hour else None)


@pytest.fixture
def rollup_trees(spark, tmp_path):
    """Stored aggregates of all layouts below one root, beside readings."""
    files = {
        "asset_001/2024/01/31/23/s1.parquet": ("timestamp", "2024-01-31T23:10:07"),
        "aggregated/asset_001/2024/01/31/23/s1_minute.parquet": ("minute_bucket", "2024-01-31T23:10:00"),
        "aggregated/asset_001/2024/02/01/00/s1_minute.parquet": ("minute_bucket", "2024-02-01T00:05:00"),
        "aggregated/asset_002/2024/01/31/23/s2_minute.parquet": ("minute_bucket", "2024-01-31T23:11:00"),
        "aggregated/asset_001/2024/01/31/s1.parquet": ("timestamp", "2024-01-31T23:10:00"),
        "aggregated/asset_001/2024/01/31/s1_hour.parquet": ("hour_bucket", "2024-01-31T23:00:00"),
        "aggregated/asset_001/2024/02/01/s1_hour.parquet": ("hour_bucket", "2024-02-01T00:00:00"),
        "daily/asset_001/2024/01/s1.parquet": ("time_bucket", "2024-01-31T23:00:00"),
        "daily/asset_001/2024/01/s1_day.parquet": ("day_bucket", "2024-01-31T00:00:00"),
        "daily/asset_001/2024/02/s1_day.parquet": ("day_bucket", "2024-02-01T00:00:00"),
    }
    for path, (column, moment) in files.items():
        target = tmp_path / "trees" / path
        os.makedirs(target.parent, exist_ok=True)
        df = spark.createDataFrame([(ts(moment), 1.5, 1.0, 2.0)], f"{column} timestamp_ntz, v_mean double, v_min double, v_max double")
        df.toPandas().to_parquet(target)
    return str(tmp_path / "trees")


@pytest.mark.parametrize(
    "layout, times, later",
    [
        ("minute", ["2024-01-31T23:10", "2024-01-31T23:11", "2024-02-01T00:05"], 2),
        ("minute_by_day", ["2024-01-31T23:10"], 0),
        ("hour", ["2024-01-31T23:00", "2024-02-01T00:00"], 1),
        ("hour_by_month", ["2024-01-31T23:00"], 0),
        ("day", ["2024-01-31", "2024-02-01"], 1),
    ],
)
def test_trees_of_stored_aggregates(spark, rollup_trees, layout, times, later):
    rows = read_rollup_tree(spark, rollup_trees, layout)
    assert sorted(r["time_bucket"] for r in rows.collect()) == [ts(t) for t in times]
    start = "2024-01-31T23:10:30"
    assert read_rollup_tree(spark, rollup_trees, layout, start=start).count() == later
    assert read_rollup_tree(spark, rollup_trees, layout, ["s1"], start, "2024-02-02", ["asset_001"]).count() == min(later, 1)
    assert read_rollup_tree(spark, rollup_trees, layout, ["nobody"]).count() == 0
    one = extract_statistic(read_rollup_tree(spark, rollup_trees, layout, assets=["asset_001"]), "max").first()
    assert (one["sensor_name"], one["asset_id"], one["v"]) == ("s1", "asset_001", 2.0)


def test_trees_of_aggregates_are_no_readings(spark, rollup_trees):
    assert names(read_hourly_tree(spark, rollup_trees)) == [("asset_001", "s1", ts("2024-01-31T23:10:07"))]


def test_inventory(spark, tree):
    files = file_inventory(spark, tree)
    assert files.count() == 5
    per_sensor = {r["sensor_name"]: r["files"] for r in count_files(files, "sensor_name").collect()}
    assert per_sensor == {"test_sensor": 2, "temp_sensor": 2, "quad_ch1": 1}
    assert count_files(files).first()["files"] == 5
    ends = file_time_range(files).first()
    assert (ends["start_time"], ends["end_time"]) == (ts("2024-01-01"), ts("2024-02-05"))
    assert files.where("size_bytes > 0 AND modified IS NOT NULL").count() == 5


def test_differing_files_are_merged(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(2, 0.5)], "a int, c double").write.parquet(str(tmp_path / "two"))
    df = read_parquet(spark, str(tmp_path / "one"), str(tmp_path / "two"), merge_schema=True)
    assert sorted(df.columns) == ["a", "b", "c"]
    assert sorted(tuple(r) for r in df.select("a", "c").collect()) == [(1, None), (2, 0.5)]


def test_unreadable_files_fail_unless_skipped(spark, tmp_path):
    good = str(tmp_path / "data")
    spark.range(5).write.parquet(good)
    (tmp_path / "data" / "part-broken.parquet").write_bytes(b"not parquet at all")
    schema = "id long"
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        spark.read.schema(schema).parquet(good).collect()
    assert read_parquet(spark, good, skip_unreadable=True).count() == 5


def test_files_passed_over_are_named(spark, tmp_path):
    root = tmp_path / "data + more"
    spark.range(90).repartition(4).write.parquet(str(root))
    spark.range(0).coalesce(1).write.mode("append").parquet(str(root))
    listed = list_files(spark, str(root)).collect()
    listing = spark.createDataFrame(listed)
    files = sorted(root.glob("part-*.parquet"))
    filled = [f for f in files if spark.read.parquet(str(f)).count()]
    filled[0].write_bytes(b"not parquet at all")
    filled[1].write_bytes(filled[1].read_bytes()[:50])
    filled[2].unlink()
    for f in root.glob(".*.crc"):
        f.unlink()
    found = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in quarantine(spark, str(root), listing, spark.range(1).schema).collect()}
    empty = {f.name: "no rows or a broken footer" for f in files if f not in filled}
    assert found == {filled[0].name: "no Parquet footer", filled[1].name: "no Parquet footer", filled[2].name: "vanished"} | empty


def test_raw_table(spark, six_series, tmp_path):
    root = str(tmp_path / "raw")
    write_raw(six_series, root)
    df = read_raw(spark, root, ["quad_ch1"], "2024-01-01T00:10:00", "2024-01-01T00:20:00", ["asset_002"])
    assert df.count() == 600
    plan = df._jdf.queryExecution().toString()
    scan = plan[plan.index("Physical Plan"):]
    assert "PartitionFilters: [isnotnull(dt" in scan and "GreaterThanOrEqual(timestamp" in scan
    assert "ReadSchema: struct<timestamp:timestamp_ntz,sensor_name:string,asset_id:string,value:double>" in scan
    times = [r["timestamp"] for r in read_series(spark, root, ["quad_ch3"]).collect()]
    assert times == sorted(times) and len(times) == 3600
    empty = read_raw(spark, root, start="2030-01-01")
    assert empty.count() == 0 and "sensor_name" in empty.columns


def test_union_of_copies_is_one_copy(six_series):
    assert union_sources(six_series, six_series).count() == six_series.count()
    extra = six_series.limit(5).withColumn("status", F.lit("ok"))
    assert union_sources(six_series, extra).count() == six_series.count() + 5


def test_iso_text(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-01 00:00:00.25' b")
    out = row.select(iso8601(F.col("a")), iso8601(F.col("b"))).first()
    assert tuple(out) == ("2024-01-01T00:00:00", "2024-01-01T00:00:00.250000")


def test_json_records_keep_missing_values(readings):
    df = readings([("2024-01-01T00:00:00", "s", "a", None, 1)])
    assert json_records(df).first()["record"] == (
        '{"timestamp":"2024-01-01T00:00:00","sensor_name":"s","asset_id":"a","value":null,"tie":1}'
    )


def test_only_the_directories_asked_for_are_listed(spark, tree):
    assert listing_glob("r", None, None, None) == "r"
    assert listing_glob("r", None, None, ["a", "b"]) == "r/{a,b}"
    assert listing_glob("r", "2023-12-30", "2024-01-02", ["a*"]) == "r/*/{2023/12,2024/01}"
    empty = read_hourly_tree(spark, tree, start="2030-01-01", end="2030-01-02")
    assert empty.count() == 0 and "asset_id" in empty.columns


def test_another_session_zone_is_an_error(spark, one_series):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            normalize(one_series)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
