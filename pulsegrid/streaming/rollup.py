"""Incremental rollup of a stream of readings."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pulsegrid.functions.time import order_key
from pulsegrid.operators.partials import ALL_STATS, build_partials, merge_partials, partial_aggregates
from pulsegrid.schema import drop_null_keys, normalize, numeric_fields, series_keys
from pulsegrid.session import delete_path, scratch_path
from pulsegrid.sources.ledger import canonical, definition
from pulsegrid.sources.rollups import GRAINS, RollupStore

EVENT_TIME = "event_time"
# Columns with the file of a reading.
FILE = {"file_path": "source_path", "file_modification_time": "source_modified", "file_size": "source_length"}


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    *,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream over Parquet files that arrive below `path`."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_partials(
    readings: DataFrame,
    *,
    grain: str = "1m",
    watermark: str = "10 minutes",
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Partials of closed buckets, with the columns of the stored rollup.

    A bucket is emitted once, when the watermark passes its end; newer buckets come from the
    readings until then. Readings later than the watermark are left out; `stream_into_store` takes them up.
    """
    readings = normalize(readings)
    fields = numeric_fields(readings, tie) if fields is None else list(fields)
    keys = series_keys(readings)
    rows = (
        drop_null_keys(readings)
        .withColumn("order_key", order_key(readings, tie))
        # A watermark needs a timestamp with a zone.
        .withColumn(EVENT_TIME, F.col("timestamp").cast("timestamp"))
        .withWatermark(EVENT_TIME, watermark)
    )
    width = f"{GRAINS[grain].interval_ms} milliseconds"
    grouped = rows.groupBy(F.window(EVENT_TIME, width).alias("window"), *keys)
    partials = grouped.agg(*partial_aggregates(fields, {field: ALL_STATS for field in fields}))
    bucket = F.col("window.start").cast("timestamp_ntz").alias("bucket")
    return partials.select(bucket, *[F.col(f"`{n}`") for n in partials.columns if n != "window"])


def stream_rollup(
    readings: DataFrame,
    path: str,
    checkpoint: str,
    *,
    grain: str = "1m",
    watermark: str = "10 minutes",
    fields: Sequence[str] | None = None,
    tie: Sequence[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append closed buckets to a Parquet table of their own, each exactly once.

    Both paths must be shared by all executors. The table has the columns of a stored rollup, so
    `merge_partials` and `finalize` apply to it; a rebuild writes to the store, not here.
    """
    partials = stream_partials(
        readings, grain=grain, watermark=watermark, fields=fields, tie=tie
    )
    return (
        partials.withColumn("dt", F.to_date("bucket"))
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("dt")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def stream_into_store(
    readings: DataFrame,
    store: RollupStore,
    checkpoint: str,
    *,
    name: str = "stream",
    grains: Sequence[str] = ("1m", "1h", "1d"),
    fields: Sequence[str] | None = None,
    source: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Add every reading of a stream to the rollups of a store as it arrives, however late.

    A batch becomes partials that come on top of what is stored for its buckets, so there is no watermark and no state. They
    are named after the stream and the number of the batch: a batch that runs again after a failure takes its own place.
    `store.compact` folds them into the tables. `name` belongs to one checkpoint.

    `source` is the table that the stream reads, as queries will be given it. With it the files of each batch go into the ledger
    and the time up to the latest reading is recorded, so queries trust the rollups but for days of files the stream
    has not read yet. The store must not have been built from the same readings otherwise.
    """
    rows = normalize(readings)
    fields = numeric_fields(rows, store.tie) if fields is None else list(fields)
    plan = None
    if source is not None:
        plan = definition(source)
        try:
            rows = normalize(readings.select("*", *[F.col(f"_metadata.{inner}").alias(outer) for inner, outer in FILE.items()]))
        except AnalysisException:
            plan = None  # not a stream of files: queries always ask the readings, too
    writer = rows.writeStream.foreachBatch(_into_store(store, name, list(grains), fields, plan))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _into_store(store: RollupStore, name: str, grains: list[str], fields: list[str], plan: str | None) -> Callable[[DataFrame, int], None]:
    number = zlib.crc32(f"{store.root} {name}".encode()) + 1

    def run(rows: DataFrame, batch: int) -> None:
        spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "batch")
        partials = build_partials(rows.drop(*FILE.values()), GRAINS[grains[0]].interval_ms, fields=fields, tie=store.tie)
        partials.write.parquet(path)
        written = spark.read.schema(partials.schema).parquet(path)
        for grain in grains:
            store.add_delta(grain, merge_partials(written, GRAINS[grain].interval_ms), name, batch)
        delete_path(spark, path)
        if plan is not None:
            _enter(rows, store, number, grains, fields, plan)

    return run


def _enter(rows: DataFrame, store: RollupStore, number: int, grains: list[str], fields: list[str], plan: str) -> None:
    """The files of a batch and the time they reach to. One row for each file comes to the driver."""
    day = F.to_date("timestamp")
    path, modified, length = FILE.values()
    files = rows.groupBy(path, F.unix_micros(modified).alias(modified), length)
    ends = files.agg(F.min(day), F.max(day), F.max("timestamp")).collect()
    entries = [(number, plan, canonical(r[0]), r[1], r[2], r[3], r[4]) for r in ends]
    store.ledger.write(entries)
    latest = max((r[5] for r in ends if r[5] is not None), default=None)
    if latest is not None:
        known = latest.replace(second=0, microsecond=0)
        store.mark_covered(grains, datetime.min, known, store.build(fields, False), number)
