import pytest
from pyspark.sql import Window, functions as F

from pulsegrid.operators.bucket import aggregate_by_interval
from pulsegrid.operators.downsample import (
    adaptive_bucket,
    choose_methods,
    downsample_to_max_points,
    fit_partials,
    smart_downsample,
)
from pulsegrid.operators import sample
from pulsegrid.operators.lookup import lookup_join
from pulsegrid.operators.partials import build_partials
from pulsegrid.operators.sample import stride_sample, with_position

SECOND = 1000


@pytest.mark.parametrize("n, limit", [(1999, 1000), (1000, 1000), (1001, 1000), (2500, 400), (7, 100)])
def test_stride_sample_is_spread_over_the_order(spark, n, limit):
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("rank"), "id")
    expected = [k * n // min(n, limit) + 1 for k in range(min(n, limit))]
    assert n - expected[-1] <= -(-n // limit)
    out = stride_sample(df, limit, ["rank"]).collect()
    assert sorted(row["rank"] for row in out) == expected


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_positions_are_exact_when_one_timestamp_holds_most_rows(spark, coalesce):
    """Also over several ranges, which AQE would merge for so few rows."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, coalesce)
    try:
        check_positions(spark)
    finally:
        spark.conf.set(setting, "true")


def check_positions(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(5)).alias("moment"), "id"
    )
    placed = with_position(df.repartition(5), ["moment", "id"])
    order = Window.orderBy("moment", "id")
    expected = df.withColumn("expected", F.row_number().over(order) - 1)
    wrong = placed.join(expected, ["id", "moment"]).where("row_position <> expected OR row_total <> 20000")
    assert wrong.count() == 0
    assert placed.count() == 20_000


def test_downsampling_keeps_to_the_limit(one_series, six_series):
    assert 0 < downsample_to_max_points(one_series, 100).count() <= 100
    assert 0 < downsample_to_max_points(six_series, 100, "last").count() <= 100


def test_downsampling_leaves_few_rows_alone(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(50).select(
        (start + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"), F.col("id").alias("value")
    )
    out = downsample_to_max_points(df, 100)
    assert sorted(out.collect()) == sorted(df.collect())
    assert smart_downsample(df, SECOND, 100, 1).count() == 50


def test_downsampling_an_empty_frame(one_series):
    assert downsample_to_max_points(one_series.limit(0), 10).count() == 0


def test_smart_downsampling_keeps_to_the_limit(one_series):
    out = smart_downsample(one_series, SECOND, 1000, 1.0)
    assert out.count() == 720  # 3.6 s needed, 5 s taken


def test_state_fields_choose_the_last_value():
    fields = ["temperature", "Status"]
    assert choose_methods(None, 0.5, fields=fields) == "avg"
    assert choose_methods(None, 2, fields=["temperature"]) == "avg"
    assert choose_methods(None, 2, fields=fields) == "last"
    per_field = choose_methods(None, 2, fields=fields, per_field=True)
    assert per_field == {"temperature": "avg", "Status": "last"}


def test_smart_downsampling_per_field(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(7200).select(
        (start + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
        F.lit("s").alias("sensor_name"),
        F.lit("a").alias("asset_id"),
        F.col("id").cast("double").alias("temperature"),
        F.col("id").cast("int").alias("alarm"),
    )
    out = smart_downsample(df, SECOND, 720, 2.0, per_field=True).orderBy("timestamp").first()
    assert (out["temperature"], out["alarm"]) == (4.5, 9)


@pytest.mark.parametrize("method", ["avg", "sum", "count", "min", "max"])
def test_fitting_merges_partials_without_loss(six_series, method):
    """A second bucketing equals one from the readings, for counts and averages too."""
    df = six_series.where("second(timestamp) < 17 OR minute(timestamp) % 2 = 0")
    partials = build_partials(df, 60_000)
    fitted = fit_partials(partials, method, 60)
    assert fitted.truncated
    assert fitted.points == 180
    # 29 minutes / 60 points: buckets of 29 s hold single minutes, so nothing is merged.
    once = aggregate_by_interval(df, 60_000, method)
    column = "count" if method == "count" else "value"
    want = {(r["timestamp"], r["sensor_name"], r["asset_id"]): r[column] for r in once.collect()}
    floors = {}
    for (moment, *series), value in want.items():
        floor = moment.timestamp() // 29 * 29
        floors[(floor, *series)] = value
    for row in fitted.data.collect():
        key = (row["timestamp"].timestamp(), row["sensor_name"], row["asset_id"])
        assert floors[key] == pytest.approx(row[column])


def test_adaptive_buckets_follow_the_span_of_each_series(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.range(1000).select(
        F.explode(F.array(F.lit(1), F.lit(60))).alias("gap"), "id"
    ).select(
        (start + F.make_dt_interval(secs=F.col("id") * F.col("gap"))).alias("timestamp"),
        F.concat(F.lit("every_"), "gap").alias("sensor_name"),
        F.col("id").cast("double").alias("value"),
    )
    out = adaptive_bucket(df, 100)
    chosen = out.select("sensor_name", "interval_ms").distinct().collect()
    widths = {row["sensor_name"]: row["interval_ms"] for row in chosen}
    assert widths == {"every_1": 10_000, "every_60": 600_000}
    keyless = df.where("sensor_name = 'every_1'").drop("sensor_name")
    assert adaptive_bucket(keyless, 100).count() == 100


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_below_and_above_its_limit(spark, how):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 20).alias("key"), "id"
    )
    lookup = spark.range(10).select(F.col("id").alias("key"), (F.col("id") * 2).alias("double"))
    small = lookup_join(rows, lookup, ["key"], how)
    large = lookup_join(rows, lookup, ["key"], how, broadcast_bytes=0)
    assert sorted(small.collect()) == sorted(large.collect())
    assert small.count() > 0
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", [1, 7, 100, 1900, 5000])
def test_copies_of_a_row_are_counted(spark, limit):
    """A third of all rows are one row."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") % 900).alias("rank"),
        F.lit("x").alias("label"),
    )
    ordered = sorted(row["rank"] for row in df.collect())
    kept = min(3000, limit)
    expected = [ordered[k * 3000 // kept] for k in range(kept)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = stride_sample(df, limit, ["rank"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(row["rank"] for row in out) == expected


def test_fields_may_have_any_name(spark):
    df = spark.range(100).selectExpr("id AS position", "id AS slice", "id AS total", "id AS size")
    assert stride_sample(df, 10, ["position"]).count() == 10
    assert stride_sample(df, 10, ["position"], distinct_rows=True).columns == df.columns


@pytest.mark.parametrize("skew, points", [("time", 13), ("hash", 1000), ("text", 13), ("long text", 13), ("nulls", 13), ("numbers", 1000)])
def test_large_slices_are_cut_again(spark, monkeypatch, skew, points):
    """Slices of a few rows, so that every column and the hash have to tell rows apart."""
    monkeypatch.setattr(sample, "RANKED_ROWS", 200)
    n = 4000
    base = spark.range(n).withColumn("mark", F.xxhash64("id"))
    rank = {
        "time": F.timestamp_seconds(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))),
        "hash": F.lit(1),
        "text": F.concat(F.lit("a common beginning "), F.when(F.col("id") % 2 == 0, F.lit("x")).otherwise(F.col("mark").cast("string"))),
        "long text": F.concat(F.lit("x" * 40), (F.col("id") % 3).cast("string")),
        "nulls": F.when(F.col("id") % 3 == 1, F.col("id") % 5),
        "numbers": F.when(F.col("id") % 7 == 0, F.lit(float("inf"))).when(F.col("id") % 7 == 1, F.lit(float("nan")))
        .when(F.col("id") % 7 == 2, F.lit(float("-inf"))).when(F.col("id") % 7 == 3, F.col("id") * 1e-12).otherwise(F.exp("id")),
    }[skew]
    df = base.select(rank.alias("rank"), "id")
    order = [F.col("rank"), F.xxhash64("rank", "id")]
    ordered = [r["id"] for r in df.repartition(1).sortWithinPartitions(*order).collect()]
    got = sorted(r["id"] for r in sample.stride_sample(df, points, ["rank"]).collect())
    assert got == sorted(ordered[k * n // points] for k in range(points))


def test_only_a_part_of_the_rows_moves(spark, monkeypatch):
    """No range exchange and no scratch table; the rows of one slice in sixteen or so are ranked."""
    monkeypatch.setattr(sample, "RANKED_ROWS", 1000)
    df = spark.range(200_000).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"), F.lit("s").alias("sensor_name"))
    out = sample.stride_sample(df, 100)
    assert out.count() == 100
    plan = out._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "/position-" not in plan
    ranked = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in ranked or "BroadcastHashJoin" in plan
