"""Headline queries at `$BENCH_SF_DIR` on `local[$BENCH_CPUS]`; prints one line of JSON.

Every query is run once to warm up and then three times; the median counts. Rollup tables are built
(and timed) once, as they are in use.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulsegrid import build_session, query_series  # noqa: E402
from pulsegrid.operators.partials import build_partials  # noqa: E402
from workload import inputs  # noqa: E402
from workload.queries import ALL_END, ALL_START, DAY, HOUR, QUERIES, SENSORS  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "query_series_avg",
    "agg_avg",
    "agg_last",
    "agg_wide",
    "agg_wide_per_field",
    "preaggregate",
    "raw_query",
    "aggregated_query_mean",
    "downsample_avg",
    "smart_downsample",
    "stride_sample",
    "adaptive_bucket",
    "coverage",
    "missing_buckets",
    "series_catalog",
    "hybrid_union",
    "popular_keys",
]


def drain(df) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def measure(run) -> float:
    run()
    return round(statistics.median(timed(run) for _ in range(RUNS)), 4)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__log__level="ERROR",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    drain(inputs.series(spark, SF_DIR))
    seconds["rollup_all_grains_stored"] = round(timed(lambda: inputs.store(spark, SF_DIR)), 4)
    for name in HEADLINE:
        seconds[name] = measure(lambda: drain(QUERIES[name](spark, SF_DIR)))

    readings = inputs.series(spark, SF_DIR)
    for grain, width in (("1m", 60_000), ("1h", HOUR), ("1d", DAY)):
        partials = build_partials(readings, width, tie=inputs.TIE)
        seconds[f"rollup_{grain}_compute"] = measure(lambda: drain(partials))

    def month(store):
        result = query_series(
            readings, SENSORS, ALL_START, ALL_END, interval_ms=DAY, max_points=None,
            store=store, fields=["value"], tie=inputs.TIE,
        )
        drain(result.data)

    seconds["month_by_day_from_readings"] = measure(lambda: month(None))
    seconds["month_by_day_from_rollup"] = measure(lambda: month(inputs.store(spark, SF_DIR)))
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
