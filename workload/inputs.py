"""The given tables in the shape of readings and of a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulsegrid import RollupStore, normalize, rebuild_rollups
from pulsegrid.functions.paths import LAYOUTS
from pulsegrid.operators.partials import build_partials
from pulsegrid.session import delete_path, glob_paths, rename_new, scratch_path, use_scratch_root
from pulsegrid.sources.readings import read_parquet, write_raw
from pulsegrid.sources.rollups import GRAINS, rollup_view

TIE = ["event_id"]
WIDE_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
WIDE_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_built: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The warehouse is the other folder that driver and executors share.
    use_scratch_root(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch")
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def events_as_readings(events: DataFrame, *others: str) -> DataFrame:
    """The event type is the sensor, four groups of users the assets."""
    asset = F.lpad((F.col("user_id") % 4).cast("string"), 3, "0")
    return events.select(
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("sensor_name"),
        F.concat(F.lit("asset_"), asset).alias("asset_id"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_id",
        *others,
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as readings."""
    return normalize(events_as_readings(table(spark, sf_dir, "events")))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as readings with four fields."""
    return normalize(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_shipdate").alias("timestamp"),
            F.col("l_returnflag").alias("sensor_name"),
            F.col("l_linestatus").alias("asset_id"),
            *WIDE_FIELDS,
            *WIDE_TIE,
        )
    )


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as readings, with a field of their own."""
    return normalize(
        table(spark, sf_dir, "orders").select(
            F.col("o_orderdate").alias("timestamp"),
            F.col("o_orderpriority").alias("sensor_name"),
            F.col("o_orderstatus").alias("asset_id"),
            F.col("o_totalprice").alias("total_price"),
        )
    )


def hybrid_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two sources that share every event; one of them holds the orders as well."""
    fields = ["value", F.col("k").cast("double").alias("k")]
    cloud = series(spark, sf_dir).select("timestamp", "sensor_name", "asset_id", *fields)
    local = cloud.unionByName(order_readings(spark, sf_dir), allowMissingColumns=True)
    return cloud, local


def file_tree(spark: SparkSession, sf_dir: str, layout: str) -> str:
    """All events as one sensor of one asset in a tree of files: readings, or their aggregates of a minute, hour or day."""
    key = (spark.sparkContext.applicationId, sf_dir, f"tree {layout}")
    if key not in _built:
        kind, root = LAYOUTS[layout], scratch_path(spark, "tree")
        rows = series(spark, sf_dir).select("timestamp", "value", "event_id")
        if layout != "raw":
            grain = {"minute": "1m", "hour": "1h", "day": "1d"}[layout.split("_")[0]]
            named = rows.withColumn("sensor_name", F.lit("events")).withColumn("asset_id", F.lit("plant"))
            view = rollup_view(build_partials(named, GRAINS[grain].interval_ms, fields=["value"]))
            rows = view.drop("sensor_name", "asset_id").withColumnRenamed("time_bucket", f"{layout.split('_')[0]}_bucket")
        folder = F.date_format(rows.columns[0], {2: "yyyy/MM", 3: "yyyy/MM/dd", 4: "yyyy/MM/dd/HH"}[kind.levels])
        aside = scratch_path(spark, "tree-aside")
        rows.withColumn("folder", F.replace(folder, F.lit("/"), F.lit("-"))).repartition("folder").write.partitionBy("folder").parquet(aside)
        # Spark names its files itself; each gets the name that the layout asks for.
        for path in glob_paths(spark, f"{aside}/folder=*/part-*"):
            name = path.split("folder=")[1].split("/")[0].replace("-", "/")
            top = f"{root}/{kind.prefix}" if kind.prefix else root
            rename_new(spark, path, f"{top}/plant/{name}/events{kind.suffix}.parquet")
        delete_path(spark, aside)
        _built[key] = root
    return _built[key]


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a request log."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("tier"),
        (F.col("event_type") == "view").alias("hit"),
        F.col("value").alias("execution_ms"),
    )


def raw_table(spark: SparkSession, sf_dir: str) -> str:
    """Path of the readings stored as a partitioned table, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "raw")
    if key not in _built:
        path = scratch_path(spark, "raw")
        write_raw(series(spark, sf_dir), path)
        _built[key] = path
    return _built[key]


def new_store(spark: SparkSession) -> RollupStore:
    return RollupStore(spark, scratch_path(spark, "rollups"), tie=TIE)


def store(spark: SparkSession, sf_dir: str) -> RollupStore:
    """Rollups of the readings in all grains, built on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, "rollups")
    if key not in _built:
        fresh = new_store(spark)
        rebuild_rollups(series(spark, sf_dir), fresh)
        _built[key] = fresh.root
    return RollupStore(spark, _built[key], tie=TIE)


# Averages of hundredths over 32 readings may lie halfway between two roundings. This moves them
# off it, so that the order of a sum cannot decide the last digit.
SHIFT = 1.37e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the last digits of a sum depend on the order of its terms."""
    return df.select(
        *[
            F.round(F.col(field.name) + SHIFT, digits).alias(field.name)
            if isinstance(field.dataType, T.DoubleType)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )
