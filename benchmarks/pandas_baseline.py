"""The same questions in pandas, in one process: `python benchmarks/pandas_baseline.py <folder>`.

Written for comparison only. It reads the table `scale.py` wrote and buckets it in memory.
"""

from __future__ import annotations

import sys
import time

import pandas as pd
import pyarrow.dataset as ds


def clock(label, run):
    began = time.perf_counter()
    result = run()
    print(f"{label:34s} {time.perf_counter() - began:8.2f} s", flush=True)
    return result


def main() -> None:
    folder = sys.argv[1]
    columns = ["timestamp", "sensor_name", "asset_id", "value"]

    def read():
        return ds.dataset(f"{folder}/raw", partitioning="hive").to_table(columns=columns).to_pandas()

    def bucket(df, width, method):
        floor = df["timestamp"].dt.floor(width)
        groups = df.assign(bucket=floor).groupby(["bucket", "sensor_name", "asset_id"])["value"]
        return getattr(groups, method)()

    df = clock("read the readings", read)
    print(f"{len(df) / 1e6:.1f} M rows")
    clock("hourly avg", lambda: bucket(df, "3600s", "mean"))
    clock("5 minute avg", lambda: bucket(df, "300s", "mean"))
    clock("hourly last", lambda: bucket(df.sort_values("timestamp"), "3600s", "last"))


if __name__ == "__main__":
    main()
