"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid import (
    aggregated_query,
    normalize,
    query_series,
    raw_query,
    rebuild_rollups,
    validate_rollups,
)
from pulsegrid.functions.time import json_records
from pulsegrid.operators.bucket import aggregate_by_interval, preaggregate
from pulsegrid.operators.catalog import (
    asset_catalog,
    list_assets,
    list_sensors,
    list_union,
    sensor_catalog,
    sensors_of,
    series_catalog,
    time_range_of,
)
from pulsegrid.operators.coverage import coverage, missing_buckets
from pulsegrid.operators.downsample import (
    adaptive_bucket,
    downsample_to_max_points,
    smart_downsample,
    smart_fit,
)
from pulsegrid.operators.filters import only_assets, only_sensors, select_readings, time_range
from pulsegrid.operators.partials import finalize, merge_partials, statistic
from pulsegrid.operators.profile import (
    estimate_and_actual,
    recommend_intervals,
    series_density,
    series_profile,
)
from pulsegrid.operators.requestlog import (
    key_totals,
    popular_keys,
    request_fingerprint,
    stale_keys,
    tier_usage,
    usage_summary,
)
from pulsegrid.operators.sample import stride_sample
from pulsegrid.plans.catalog import stored_catalog, stored_time_range
from pulsegrid.plans.profile import stored_profile
from pulsegrid.schema import drop_null_keys
from pulsegrid.session import delete_path, glob_paths, materialize, scratch_path, write_bytes
from pulsegrid.sources.inventory import file_inventory, with_row_counts
from pulsegrid.sources.quarantine import list_files, quarantine
from pulsegrid.sources.readings import (
    read_hourly_tree,
    read_parquet,
    read_raw,
    read_rollup_tree,
    read_series,
    union_sources,
    with_path_columns,
    write_raw,
)
from pulsegrid.sources.rollups import extract_statistic, rollup_view
from pulsegrid.streaming.rollup import read_stream, stream_into_store, stream_rollup
from workload import inputs
from workload.inputs import TIE, WIDE_FIELDS, WIDE_TIE, rounded, series, table, wide

HOUR = 3_600_000
SIX_HOURS = 6 * HOUR
DAY = 24 * HOUR
SENSORS = ["click", "error", "purchase", "signup", "view"]
TWO_SENSORS = ["click", "view"]
TWO_ASSETS = ["asset_001", "asset_002"]
# A range that is aligned with no bucket, one that is, and the whole time.
START, END = "2024-01-02T06:30:15", "2024-01-28T18:45:30"
DAY_START, DAY_END = "2024-01-03", "2024-01-29"
ALL_START, ALL_END = "2024-01-01", "2024-01-31"
TREE_START, TREE_END = "2024-01-04T05:20:00", "2024-01-13T02:00:00"
STRIDE_POINTS = 300
LIMIT_POINTS = 2000
FIT_POINTS = 500
SERIES_POINTS = 100
SMART_HOURS = 720
# Two hours in which some series have no reading.
SILENT_START, SILENT_END = "2024-01-09T03:00:00", "2024-01-09T05:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def bucket_query(method: str, *, first_ts: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = series(spark, sf_dir)
        return rounded(aggregate_by_interval(df, HOUR, method, tie=TIE, first_ts=first_ts))

    return run


def rollup_query(grain: str) -> Query:
    """All statistics of a stored grain."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        partials = inputs.store(spark, sf_dir).read(grain)
        methods = ("avg", "min", "max", "first", "last", "sum")
        columns = [statistic(partials, "value", m).alias(f"value_{m}") for m in methods]
        head = ["bucket", "sensor_name", "asset_id", "n_rows", "first_ts", "last_ts"]
        return rounded(partials.select(*head, *columns, F.col("k_sum"), F.col("k_last_v")))

    return run


def extract_query(stat: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(extract_statistic(rollup_view(inputs.store(spark, sf_dir).read("1h")), stat))

    return run


def scan_rollup(grain: str) -> Query:
    """A stored grain, restricted in time and series at the scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        partials = inputs.store(spark, sf_dir).read(
            grain, TWO_SENSORS, DAY_START, DAY_END, TWO_ASSETS
        )
        return rounded(rollup_view(partials))

    return run


def series_query(method: str, start: str = START, end: str = END) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = query_series(
            series(spark, sf_dir), TWO_SENSORS, start, end,
            interval_ms=HOUR, aggregation=method, max_points=None, fields=["value"], tie=TIE,
        )
        return rounded(result.data)

    return run


def aggregate_query(method: str) -> Query:
    """Automatic interval, answered from the stored rollups with edges from the readings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = aggregated_query(
            series(spark, sf_dir), SENSORS, START, END,
            aggregation=method, max_points=2000, store=inputs.store(spark, sf_dir), tie=TIE,
            fields=["value"],
        )
        return rounded(result.data)

    return run


def query_series_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = query_series(
        series(spark, sf_dir), SENSORS, ALL_START, ALL_END,
        interval_ms=HOUR, max_points=FIT_POINTS, fields=["value"], tie=TIE,
    )
    return rounded(result.data)


def query_series_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources that hold the same readings, whose copies the query removes."""
    df = series(spark, sf_dir)
    twice = union_sources(df, df, dedup=False)
    result = query_series(
        twice, TWO_SENSORS, START, END,
        interval_ms=HOUR, aggregation="sum", max_points=None, fields=["value"], tie=TIE, dedup=True,
    )
    return rounded(result.data)


def tiered_read(tier: str, interval_ms: int, start: str, end: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = query_series(
            series(spark, sf_dir), SENSORS, start, end,
            interval_ms=interval_ms, max_points=None, store=inputs.store(spark, sf_dir),
            fields=["value"],
        )
        if result.tier_used != tier:
            raise AssertionError(f"expected tier {tier}, not {result.tier_used}")
        return rounded(result.data)

    return run


def tiered_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings are gone, so the minute rollup answers a query that would prefer them."""
    gone = series(spark, sf_dir).where(F.lit(False))
    result = query_series(
        gone, SENSORS, "2024-01-09", "2024-01-10",
        interval_ms=HOUR, max_points=None, store=inputs.store(spark, sf_dir), fields=["value"],
    )
    return rounded(result.data)


def month(spark: SparkSession, readings: DataFrame, store, method: str, interval_ms: int, **more) -> DataFrame:
    """The whole month from a store, which must answer from a rollup."""
    options = dict(interval_ms=interval_ms, aggregation=method, store=store, fields=["value"]) | more
    result = query_series(readings, SENSORS, ALL_START, ALL_END, **options)
    if result.tier_used == "raw":
        raise AssertionError("expected a rollup")
    return rounded(result.data)


def tiered_daily_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups built a day at a time answer for the whole month."""
    readings, store = series(spark, sf_dir), inputs.new_store(spark)
    for day in range(1, 31):
        rebuild_rollups(readings, store, start=f"2024-01-{day:02d}", end=f"2024-01-{day + 1:02d}", grains=["1h"], fields=["value"])
    return month(spark, readings, store, "avg", SIX_HOURS)


def tiered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading is there twice; copies were removed when the rollup was built, as the query asks."""
    readings, store = series(spark, sf_dir), inputs.new_store(spark)
    twice = readings.unionByName(readings)
    rebuild_rollups(twice, store, grains=["1h"], fields=["value"], dedup=True)
    return month(spark, twice, store, "sum", DAY, dedup=True)


def tiered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later rebuild of some days without a field: those days come from the readings."""
    readings, store = series(spark, sf_dir), inputs.new_store(spark)
    rebuild_rollups(readings, store, grains=["1h"])
    rebuild_rollups(readings, store, start="2024-01-07", end="2024-01-12", grains=["1h"], fields=["value"])
    return month(spark, readings, store, "sum", DAY, fields=["k"])


def tiered_raw_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings before the 9th are gone; the rollup has them."""
    left = series(spark, sf_dir).where("timestamp >= '2024-01-09'")
    result = query_series(
        left, SENSORS, "2024-01-08T12:00:00", "2024-01-09T12:00:00",
        interval_ms=HOUR, store=inputs.store(spark, sf_dir), fields=["value"],
    )
    return rounded(result.data)


def tiered_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of two days arrive, in a file of their own, after the rollup was built: those days are not left to it."""
    readings, store = series(spark, sf_dir), inputs.new_store(spark)
    late = F.col("timestamp").between("2024-01-06", "2024-01-08") & (F.col("sensor_name") == "click")
    path = scratch_path(spark, "arrivals")
    write_raw(readings.where(~late), path)
    rebuild_rollups(read_parquet(spark, path), store, grains=["1h"], fields=["value"])
    write_raw(readings.where(late), path, mode="append")
    return month(spark, read_parquet(spark, path), store, "avg", SIX_HOURS)


def tiered_partly_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks before the 8th at noon are gone, other sensors are whole: the rollup answers for the clicks."""
    left = series(spark, sf_dir).where("sensor_name <> 'click' OR timestamp >= '2024-01-08 12:00:00'")
    result = query_series(
        left, SENSORS, "2024-01-05T06:00:00", "2024-01-11T18:00:00",
        interval_ms=SIX_HOURS, store=inputs.store(spark, sf_dir), fields=["value"],
    )
    return rounded(result.data)


def tiered_partial_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only hours of nine days are stored, and the readings of the first week are gone: both together have the month."""
    readings, store = series(spark, sf_dir), inputs.new_store(spark)
    rebuild_rollups(readings, store, start="2024-01-01", end="2024-01-10", grains=["1h"], fields=["value"])
    return month(spark, readings.where("timestamp >= '2024-01-08 07:30:00'"), store, "sum", SIX_HOURS)


def rebuild_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is deleted from the readings and everything is built again: the rollup has lost it, too."""
    readings, store = series(spark, sf_dir), inputs.new_store(spark)
    rebuild_rollups(readings, store, grains=["1m", "1h"], fields=["value"])
    left = readings.where("to_date(timestamp) <> DATE'2024-01-10'")
    rebuild_rollups(left, store, grains=["1m", "1h"], fields=["value"])
    return month(spark, left, store, "count", DAY)


def raw_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series(spark, sf_dir)
    return raw_query(df, SENSORS, ALL_START, ALL_END, tie=TIE).data


def raw_seconds_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series(spark, sf_dir)
    return raw_query(df, SENSORS, ALL_START, ALL_END, max_points=LIMIT_POINTS, fields=["value", "k"], tie=TIE).data


def scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = inputs.raw_table(spark, sf_dir)
    return read_raw(spark, path, TWO_SENSORS, START, END, TWO_ASSETS)


def partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_parquet(spark, inputs.raw_table(spark, sf_dir))
    pruned = time_range(df, START, END)
    per_day = pruned.groupBy("dt").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_day.withColumn("dt", F.col("dt").cast("string"))


def scan_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = inputs.raw_table(spark, sf_dir)
    return read_raw(spark, path, SENSORS, "2030-01-01", "2030-01-02")


def scan_merge_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [f"{sf_dir}/{name}.parquet" for name in ("customer", "supplier", "nation")]
    merged = read_parquet(spark, *paths, merge_schema=True)
    keys = [name for name in merged.columns if name.endswith("key")]
    return rounded(merged.withColumns({name: F.col(name).cast("double") for name in keys}))


def path_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [f"{sf_dir}/{name}.parquet" for name in ("events", "orders", "lineitem")]
    df = with_path_columns(read_parquet(spark, *paths, merge_schema=True))
    return df.groupBy("file_sensor").agg(F.count(F.lit(1)).alias("n_rows"))


def hourly_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of nine days from a tree of hourly files, the first hour in part."""
    rows = read_hourly_tree(spark, inputs.file_tree(spark, sf_dir, "raw"), ["events"], TREE_START, TREE_END, ["plant"])
    return rows.select("timestamp", "sensor_name", "asset_id", "value", "event_id")


def rollup_tree(layout: str, stat: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read_rollup_tree(spark, inputs.file_tree(spark, sf_dir, layout), layout, ["events"], TREE_START, TREE_END)
        return rounded(extract_statistic(rows, stat))

    return run


def path_columns_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = inputs.file_tree(spark, sf_dir, "raw")
    df = with_path_columns(read_parquet(spark, root, recursive=True))
    return df.groupBy("file_sensor", "file_asset", "file_hour").agg(F.count(F.lit(1)).alias("n_rows"))


def scan_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each day that a scan reads, and why the files of two days give none: one is cut off, one vanishes after the listing."""
    path = scratch_path(spark, "quarantine")
    write_raw(series(spark, sf_dir), path)
    schema = read_parquet(spark, path).schema
    listed = materialize(list_files(spark, path), "listing")
    for broken in glob_paths(spark, f"{path}/dt=2024-01-05/*.parquet"):
        write_bytes(spark, broken, b"PAR1 and no more")
    delete_path(spark, f"{path}/dt=2024-01-07")
    day = F.regexp_extract("path", "dt=([0-9-]+)", 1).alias("day")
    lost = quarantine(spark, path, listed, schema).groupBy(day, "reason").agg(F.lit(0).cast("long").alias("n_rows"))
    read = read_parquet(spark, path, schema=schema, skip_unreadable=True).groupBy(F.col("dt").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    return read.select("day", F.lit(None).cast("string").alias("reason"), "n_rows").unionByName(lost)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the files of each day of the stored readings hold."""
    path = inputs.raw_table(spark, sf_dir)
    files = with_row_counts(file_inventory(spark, path), spark.read.parquet(path))
    day = F.regexp_extract("path", "dt=([0-9-]+)", 1)
    return files.groupBy(day.alias("day")).agg(F.sum("n_rows").alias("n_rows"))


def daqid_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("sensor_name"),
        F.col("user_id").alias("daqid"),
        "value",
    )
    return normalize(df)


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO-8601 text: UTC, or two hours ahead of it."""
    ts = F.col("ts").cast("timestamp")
    utc = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ahead = F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    text = F.when(F.col("event_type") == "view", ahead).otherwise(utc)
    df = table(spark, sf_dir, "events").select(
        text.alias("timestamp"), F.col("event_type").alias("sensor_name"), "event_id"
    )
    return normalize(df)


def iso_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_records(series(spark, sf_dir))


def null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series(spark, sf_dir)
    holes = df.withColumn("sensor_name", F.nullif("sensor_name", F.lit("error")))
    return drop_null_keys(holes)


def sensors_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a frame of names instead of a list."""
    df = series(spark, sf_dir)
    names = list_sensors(df)
    return only_sensors(df, names.where(F.col("sensor_name").contains("i")))


def non_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = inputs.events_as_readings(table(spark, sf_dir, "events"), "props").drop("value", "k")
    return aggregate_by_interval(notes, HOUR, "avg", tie=TIE)


def without_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series(spark, sf_dir).drop("asset_id")
    return rounded(aggregate_by_interval(df, HOUR, "avg", tie=TIE))


def agg_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate_by_interval(wide(spark, sf_dir), 7 * DAY, "avg", tie=WIDE_TIE))


def agg_wide_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = dict(zip(WIDE_FIELDS, ("sum", "max", "min", "last")))
    df = wide(spark, sf_dir)
    return rounded(
        aggregate_by_interval(df, DAY, methods, fields=WIDE_FIELDS, tie=WIDE_TIE), 2
    )


def pre_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preaggregate(series(spark, sf_dir), 60, fields=["value", "k"]))


def rollup_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute partials through the store, merged into six hours."""
    stored = inputs.store(spark, sf_dir).read("1m")
    return rounded(finalize(merge_partials(stored, SIX_HOURS), "avg", first_ts=True))


def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full build, then one of a single sensor and one of a range, which change nothing."""
    df = series(spark, sf_dir)
    store = inputs.new_store(spark)
    rebuild_rollups(df, store)
    rebuild_rollups(df, store, ["click"])
    rebuild_rollups(df, store, start="2024-01-10T05:00:00", end="2024-01-12T07:00:00")
    merged = [
        finalize(store.read(grain), "avg").withColumn("grain", F.lit(grain))
        for grain in ("1h", "1d")
    ]
    return rounded(merged[0].unionByName(merged[1]))


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = inputs.store(spark, sf_dir)
    return rounded(validate_rollups(series(spark, sf_dir), store, raw_interval_ms=60_000))


def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_sources(*inputs.hybrid_sources(spark, sf_dir))


def hybrid_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud, local = inputs.hybrid_sources(spark, sf_dir)
    return list_union(list_sensors(cloud), list_sensors(local))


def hybrid_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = inputs.hybrid_sources(spark, sf_dir)
    # Copies change no minimum or maximum, so they need not be removed first.
    return rounded(time_range_of(union_sources(*sources, dedup=False)))


def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = aggregate_by_interval(series(spark, sf_dir), HOUR, "avg", fields=["value"])
    return rounded(stride_sample(hourly, STRIDE_POINTS, distinct_rows=True))


def stride_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without a time, in the order of their number."""
    df = series(spark, sf_dir).drop("timestamp")
    return stride_sample(df, STRIDE_POINTS, ["event_id"])


def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        downsample_to_max_points(series(spark, sf_dir), FIT_POINTS, "avg", fields=["value"])
    )


def downsample_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downsample_to_max_points(series(spark, sf_dir), 10**15, "avg")


def smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too many points for the limit: hours first, then wider buckets and a stride."""
    df = series(spark, sf_dir)
    return rounded(smart_downsample(df, 60_000, FIT_POINTS, SMART_HOURS, fields=["value"]))


def smart_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fit of `smart_downsample` did."""
    fit = smart_fit(series(spark, sf_dir), 60_000, FIT_POINTS, SMART_HOURS, fields=["value"])
    return fit.data.agg(F.count(F.lit(1)).alias("points_after")).select(
        F.lit(fit.source_rows).cast("long").alias("readings"), F.lit(fit.points).cast("long").alias("points_before"), "points_after",
        F.lit(fit.interval_ms).cast("long").alias("interval_ms"), F.lit(fit.method).alias("method"), F.lit(fit.truncated).alias("truncated"),
    )


def smart_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state field makes every field keep its last value."""
    df = series(spark, sf_dir).withColumnRenamed("k", "status")
    return rounded(smart_downsample(df, HOUR, FIT_POINTS, SMART_HOURS, tie=TIE))


def adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adaptive_bucket(series(spark, sf_dir), SERIES_POINTS, fields=["value"]))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a request for two sensors over the hour before it."""
    requests = table(spark, sf_dir, "events").select(
        "event_id",
        request_fingerprint(
            F.array(F.col("event_type"), F.lit("heartbeat")),
            F.col("ts") - F.expr("INTERVAL 1 HOUR"),
            F.col("ts"),
            F.array(F.col("user_id").cast("string")),
            F.lit(1000),
            F.lit("avg"),
            F.lit(10_000),
        ).alias("fingerprint"),
    )
    return requests


def stream_rollup_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the events through the incremental rollup and read what it has closed."""
    schema = table(spark, sf_dir, "events").schema
    events = read_stream(spark, f"{sf_dir}/events*.parquet", schema)
    out = scratch_path(spark, "stream")
    query = stream_rollup(
        inputs.events_as_readings(events), f"{out}/table", f"{out}/checkpoint",
        fields=["value"], tie=TIE,
    )
    query.awaitTermination()
    return rounded(finalize(read_parquet(spark, f"{out}/table"), "avg", first_ts=True))


_changed: dict[tuple[str, str], tuple] = {}


def changed_store(spark: SparkSession, sf_dir: str):
    """Readings and a store that has followed them: built, a day deleted and built again, clicks of a week arrived late."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _changed:
        path, store = _changed[key]
        return read_parquet(spark, path), store
    readings, store, path = series(spark, sf_dir), inputs.new_store(spark), scratch_path(spark, "changing")
    late = F.col("timestamp").between("2024-01-15", "2024-01-22") & (F.col("sensor_name") == "click")
    write_raw(readings.where(~late), path)
    rebuild_rollups(read_parquet(spark, path), store, grains=["1h", "1d"], fields=["value"], moments=True)
    delete_path(spark, f"{path}/dt=2024-01-10")
    rebuild_rollups(
        read_parquet(spark, path), store, start="2024-01-10", end="2024-01-11", grains=["1h", "1d"], fields=["value"], moments=True
    )
    write_raw(readings.where(late), path, mode="append")
    _changed[key] = path, store
    return read_parquet(spark, path), store


def catalog_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_catalog(*changed_store(spark, sf_dir))


def catalog_maintained_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors_of(stored_catalog(*changed_store(spark, sf_dir)))


def time_range_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stored_time_range(*changed_store(spark, sf_dir), granularity="hour"))


def profile_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stored_profile(*changed_store(spark, sf_dir), "value"))


def stream_late_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings stream into the rollups; those of three days come late, and their batch runs twice. The hours are as from the whole table."""
    readings, store = series(spark, sf_dir), inputs.new_store(spark)
    late = F.col("timestamp").between("2024-01-09", "2024-01-12")
    path, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "checkpoint")

    def arrive(rows: DataFrame) -> None:
        write_raw(rows, path, mode="append")
        schema = read_parquet(spark, path).schema
        stream = stream_into_store(read_stream(spark, path, schema), store, checkpoint, fields=["value"], source=read_parquet(spark, path))
        stream.awaitTermination()

    arrive(readings.where(~late))
    arrive(readings.where(late))
    # Without the note of its commit, the last batch runs again.
    delete_path(spark, max(glob_paths(spark, f"{checkpoint}/commits/[0-9]*")))
    arrive(readings.where("false"))
    store.compact("1h")
    return month(spark, read_parquet(spark, path), store, "avg", SIX_HOURS)


QUERIES: dict[str, Query] = {
    "query_series_avg": series_query("avg"),
    "query_series_max": series_query("max"),
    "query_series_last": series_query("last"),
    "query_series_capped": query_series_capped,
    "query_series_dedup": query_series_dedup,
    "scan_raw": scan_raw,
    "scan_rollup_1m": scan_rollup("1m"),
    "scan_rollup_1h": scan_rollup("1h"),
    "scan_merge_schema": scan_merge_schema,
    "path_columns": path_columns,
    "path_columns_hourly": path_columns_hourly,
    "scan_quarantine": scan_quarantine,
    "read_hourly_tree": hourly_tree,
    "read_minute_tree": rollup_tree("minute", "mean"),
    "read_minute_tree_by_day": rollup_tree("minute_by_day", "min"),
    "read_hour_tree": rollup_tree("hour", "max"),
    "read_day_tree": rollup_tree("day", "mean"),
    "daqid_alias": daqid_alias,
    "file_inventory": inventory,
    "rollup_roundtrip": rollup_roundtrip,
    "scan_empty": scan_empty,
    "read_series": lambda spark, sf: read_series(spark, inputs.raw_table(spark, sf)),
    "normalize": parse_timestamps,
    "filter_time_range": lambda spark, sf: time_range(series(spark, sf), START, END),
    "filter_sensors": lambda spark, sf: only_sensors(series(spark, sf), TWO_SENSORS),
    "filter_sensors_table": sensors_from_table,
    "filter_assets": lambda spark, sf: only_assets(series(spark, sf), TWO_ASSETS),
    "filter_readings": lambda spark, sf: select_readings(
        series(spark, sf), TWO_SENSORS, START, END, TWO_ASSETS
    ),
    "partition_pruning": partition_pruning,
    "drop_null_keys": null_keys,
    "rollup_extract_mean": extract_query("mean"),
    "rollup_extract_min": extract_query("min"),
    "rollup_extract_max": extract_query("max"),
    "sensors_of_asset": lambda spark, sf: list_sensors(series(spark, sf), "asset_001"),
    "missing_buckets": lambda spark, sf: missing_buckets(series(spark, sf), HOUR),
    "agg_avg": bucket_query("avg"),
    "agg_min": bucket_query("min"),
    "agg_max": bucket_query("max"),
    "agg_last": bucket_query("last"),
    "agg_first": bucket_query("first"),
    "agg_count": bucket_query("count"),
    "agg_sum": bucket_query("sum"),
    "agg_first_ts": bucket_query("max", first_ts=True),
    "agg_non_numeric": non_numeric,
    "preaggregate": pre_aggregate,
    "rollup_1m": rollup_query("1m"),
    "rollup_1h": rollup_query("1h"),
    "rollup_1d": rollup_query("1d"),
    "agg_no_asset": without_asset,
    "agg_wide": agg_wide,
    "agg_wide_per_field": agg_wide_per_field,
    "series_profile": lambda spark, sf: rounded(series_profile(series(spark, sf), "value")),
    "series_density": lambda spark, sf: rounded(series_density(series(spark, sf), HOUR), 3),
    "time_range": lambda spark, sf: rounded(time_range_of(series(spark, sf), TWO_SENSORS)),
    "time_range_hour": lambda spark, sf: rounded(
        time_range_of(series(spark, sf), granularity="hour")
    ),
    "stride_sample": stride,
    "stride_sample_ordered": stride_ordered,
    "list_sensors": lambda spark, sf: list_sensors(series(spark, sf)),
    "list_assets": lambda spark, sf: list_assets(series(spark, sf)),
    "series_catalog": lambda spark, sf: series_catalog(series(spark, sf)),
    "sensor_catalog": lambda spark, sf: sensor_catalog(series(spark, sf)),
    "asset_catalog": lambda spark, sf: asset_catalog(series(spark, sf)),
    "hybrid_union": hybrid_union,
    "list_sensors_hybrid": hybrid_sensors,
    "time_range_hybrid": hybrid_time_range,
    "iso_records": iso_records,
    "recommend_interval": lambda spark, sf: rounded(
        recommend_intervals(series(spark, sf), SERIES_POINTS), 3
    ),
    "estimate_points": lambda spark, sf: estimate_and_actual(series(spark, sf), HOUR),
    "raw_query": raw_seconds,
    "raw_query_truncated": raw_seconds_truncated,
    "aggregated_query_min": aggregate_query("min"),
    "aggregated_query_max": aggregate_query("max"),
    "aggregated_query_mean": aggregate_query("mean"),
    "rebuild_rollups": rebuild,
    "downsample_avg": downsample,
    "downsample_noop": downsample_noop,
    "smart_downsample": smart,
    "smart_report": smart_report,
    "smart_status_last": smart_status,
    "adaptive_bucket": adaptive,
    "coverage": lambda spark, sf: rounded(coverage(series(spark, sf), HOUR)),
    "coverage_range": lambda spark, sf: rounded(coverage(series(spark, sf), HOUR, START, END)),
    "validate_rollups": validate,
    "tiered_read_1h": tiered_read("1h", SIX_HOURS, START, END),
    "tiered_read_1m": tiered_read("1m", SIX_HOURS, "2024-01-05T00:10:30", "2024-01-11T21:00:00"),
    "tiered_fallback": tiered_fallback,
    "coverage_silent": lambda spark, sf: rounded(coverage(series(spark, sf), HOUR, SILENT_START, SILENT_END)),
    "missing_buckets_silent": lambda spark, sf: missing_buckets(series(spark, sf), HOUR, SILENT_START, SILENT_END),
    "tiered_daily_rebuilds": tiered_daily_rebuilds,
    "tiered_dedup": tiered_dedup,
    "tiered_fields": tiered_fields,
    "tiered_raw_expired": tiered_raw_expired,
    "tiered_late": tiered_late,
    "tiered_partly_expired": tiered_partly_expired,
    "tiered_partial_rollup": tiered_partial_rollup,
    "rebuild_after_delete": rebuild_after_delete,
    "popular_keys": lambda spark, sf: popular_keys(inputs.request_log(spark, sf)),
    "key_totals": lambda spark, sf: key_totals(inputs.request_log(spark, sf)),
    "usage_summary": lambda spark, sf: rounded(usage_summary(inputs.request_log(spark, sf))),
    "tier_usage": lambda spark, sf: tier_usage(inputs.request_log(spark, sf)),
    "stale_keys": lambda spark, sf: stale_keys(
        inputs.request_log(spark, sf), "2024-01-31T00:00:00", 12
    ),
    "request_fingerprint": fingerprint,
    "stream_rollup_1m": stream_rollup_1m,
    "stream_late_repair": stream_late_repair,
    "catalog_maintained": catalog_maintained,
    "catalog_maintained_sensors": catalog_maintained_sensors,
    "time_range_maintained": time_range_maintained,
    "profile_from_rollup": profile_from_rollup,
}
