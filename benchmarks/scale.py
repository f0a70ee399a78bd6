"""Readings, minute and hour rollup compared on a 1 Hz table larger than the given ones.

`python benchmarks/scale.py [series] [days]` writes the table to a new folder under /tmp, measures
this library on it, and prints the folder for `pandas_baseline.py`.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
from datetime import datetime, timedelta

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pulsegrid import RollupStore, build_session, query_series, rebuild_rollups  # noqa: E402
from pulsegrid.operators.coverage import coverage  # noqa: E402
from pulsegrid.operators.sample import stride_sample  # noqa: E402
from pulsegrid.sources.readings import read_raw, write_raw  # noqa: E402

START = datetime(2024, 1, 1)


def clock(label, run, rows=None):
    began = time.perf_counter()
    result = run()
    taken = time.perf_counter() - began
    rate = f"  {rows / taken / 1e6:.1f} M rows/s" if rows else ""
    print(f"{label:34s} {taken:8.2f} s{rate}", flush=True)
    return result


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    n_series = int(sys.argv[1]) if len(sys.argv) > 1 else 20
    days = int(sys.argv[2]) if len(sys.argv) > 2 else 14
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = build_session(
        "scale",
        f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="16",
        spark__driver__memory="16g",
        spark__checkpoint__dir=f"{folder}/shared",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = days * 86_400
    total = n_series * seconds
    second = F.col("id") % seconds
    series = (F.col("id") / seconds).cast("int")
    df = spark.range(total).select(
        F.timestamp_seconds(second + int(START.timestamp())).cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("sensor_"), series % 5).alias("sensor_name"),
        F.concat(F.lit("asset_"), (series / 5).cast("int")).alias("asset_id"),
        (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("value"),
    )
    print(f"{total / 1e6:.1f} M rows, {n_series} series, {days} days in {folder}")
    raw_path = f"{folder}/raw"
    clock("write the readings", lambda: write_raw(df, raw_path, dedup=False), total)
    raw = read_raw(spark, raw_path)
    store = RollupStore(spark, f"{folder}/rollups")
    clock("build all rollups", lambda: rebuild_rollups(raw, store), total)
    end = START + timedelta(days=days)
    sensors = [f"sensor_{n}" for n in range(5)]

    def query(interval, store=None, start=START, method="avg"):
        result = query_series(
            raw, sensors, start, end, interval_ms=interval, aggregation=method,
            max_points=None, store=store,
        )
        drain(result.data)
        return result.tier_used

    minute, hour = 60_000, 3_600_000
    for label, run in (
        ("hourly avg from the readings", lambda: query(hour)),
        ("hourly avg from rollups", lambda: query(hour, store)),
        ("hourly last from the readings", lambda: query(hour, method="last")),
        ("hourly last from rollups", lambda: query(hour, store, method="last")),
        ("the same, unaligned start", lambda: query(hour, store, START + timedelta(seconds=4711))),
        ("5 minute avg from the readings", lambda: query(5 * minute)),
        ("coverage at 1 s", lambda: drain(coverage(raw, 1000))),
        ("10 000 points by stride of all rows", lambda: drain(stride_sample(raw, 10_000, distinct_rows=True))),
    ):
        run()
        tier = clock(label, run, total)
        if tier:
            print(f"{'':34s}          tier {tier}")
    spark.stop()


if __name__ == "__main__":
    main()
