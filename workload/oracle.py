"""The queries in DuckDB SQL, from the definitions of the operators."""

from __future__ import annotations

from workload.inputs import SHIFT
from workload.queries import (
    ALL_END,
    ALL_START,
    DAY_END,
    DAY_START,
    END,
    FIT_POINTS,
    HOUR,
    LIMIT_POINTS,
    SERIES_POINTS,
    SILENT_END,
    SILENT_START,
    SIX_HOURS,
    SMART_HOURS,
    START,
    STRIDE_POINTS,
    TREE_END,
    TREE_START,
)

SERIES = """series AS (
  SELECT ts AS "timestamp", event_type AS sensor_name,
         'asset_' || lpad(CAST(user_id % 4 AS VARCHAR), 3, '0') AS asset_id,
         value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id
  FROM events)"""
ORDER_READINGS = """order_readings AS (
  SELECT o_orderdate AS "timestamp", o_orderpriority AS sensor_name, o_orderstatus AS asset_id,
         CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS k, o_totalprice AS total_price
  FROM orders)"""
HYBRID = f"""{SERIES}, {ORDER_READINGS}, hybrid AS (
  SELECT "timestamp", sensor_name, asset_id, value, CAST(k AS DOUBLE) AS k,
         CAST(NULL AS DOUBLE) AS total_price FROM series
  UNION SELECT * FROM order_readings)"""
LOG = """log AS (
  SELECT user_id AS key, ts AS "timestamp", event_type AS tier, event_type = 'view' AS hit,
         value AS execution_ms FROM events)"""

# A day has been deleted.
LEFT = """NOT ("timestamp" >= TIMESTAMP '2024-01-10' AND "timestamp" < TIMESTAMP '2024-01-11')"""

METHOD_SQL = {
    "avg": "avg({f})",
    "min": "min({f})",
    "max": "max({f})",
    "sum": "coalesce(sum({f}), 0)",
    "first": 'first({f} ORDER BY "timestamp", event_id)',
    "last": 'last({f} ORDER BY "timestamp", event_id)',
}


def bucket(interval_ms: int, column: str = '"timestamp"') -> str:
    return (
        f"time_bucket(INTERVAL '{interval_ms} milliseconds', {column}, TIMESTAMP '1970-01-01')"
    )


def stat(method: str, field: str) -> str:
    """A statistic with the type the library gives it."""
    text = METHOD_SQL[method].format(f=field)
    if field == "k" and method == "sum":
        return f"CAST({text} AS BIGINT)"
    if field == "k" and method != "avg":
        return text
    return f"round({text}, 6)"


def within(start: str, end: str, column: str = '"timestamp"') -> str:
    return f"{column} >= TIMESTAMP '{start}' AND {column} < TIMESTAMP '{end}'"


def buckets(
    method: str,
    interval_ms: int = HOUR,
    fields: tuple[str, ...] = ("value", "k"),
    where: str = "true",
    extra: str = "",
) -> str:
    columns = "".join(f', {stat(method, f)} AS "{f}"' for f in fields)
    return f"""WITH {SERIES}
SELECT {bucket(interval_ms)} AS "timestamp", sensor_name, asset_id{columns}{extra}
FROM series WHERE {where} GROUP BY 1, 2, 3"""


def range_query(
    method: str, start: str, end: str, interval_ms: int = HOUR, two_sensors: bool = False
) -> str:
    where = within(start, end)
    if two_sensors:
        where += " AND sensor_name IN ('click', 'view')"
    return buckets(method, interval_ms, ("value",), where)


def rollup(grain_ms: int) -> str:
    columns = ", ".join(
        f"{stat(m, 'value')} AS value_{m}" for m in ("avg", "min", "max", "first", "last", "sum")
    )
    return f"""WITH {SERIES}
SELECT {bucket(grain_ms)} AS bucket, sensor_name, asset_id, count(*) AS n_rows,
       min("timestamp") AS first_ts, max("timestamp") AS last_ts, {columns},
       {stat('sum', 'k')} AS k_sum, {stat('last', 'k')} AS k_last_v
FROM series GROUP BY 1, 2, 3"""


def tree_scan(grain_ms: int, function: str) -> str:
    return f"""SELECT * FROM (
  SELECT {bucket(grain_ms, 'ts')} AS "timestamp", 'events' AS sensor_name, 'plant' AS asset_id, round({function}(value), 6) AS value
  FROM events GROUP BY 1) WHERE {within(TREE_START, TREE_END)} AND value IS NOT NULL"""


def rollup_scan(grain_ms: int) -> str:
    columns = ", ".join(
        f"round({fn}({f}), 6) AS {f}_{name}" if f == "value" or fn == "avg"
        else f"{fn}({f}) AS {f}_{name}"
        for f in ("value", "k")
        for fn, name in (("avg", "mean"), ("min", "min"), ("max", "max"))
    )
    return f"""WITH {SERIES}
SELECT {bucket(grain_ms)} AS time_bucket, sensor_name, asset_id, {columns},
       min("timestamp") AS timestamp_first
FROM series WHERE {within(DAY_START, DAY_END)} AND sensor_name IN ('click', 'view')
  AND asset_id IN ('asset_001', 'asset_002') GROUP BY 1, 2, 3"""


def strided(source: str, columns: str, order: str, points: int) -> str:
    """`points` rows of `source` at even distances, from the first on; all if they are fewer."""
    return f"""placed AS (
  SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM {source})
SELECT {columns} FROM placed
WHERE n <= {points} OR pos = 0 OR (pos * {points} - 1) // n < ((pos + 1) * {points} - 1) // n"""


ORDER = '"timestamp", sensor_name, asset_id'
RESULT = '"timestamp", sensor_name, asset_id, round(value, 6) AS value'


def floor_by(column: str, interval: str) -> str:
    return f"epoch_ms(epoch_ms({column}) - epoch_ms({column}) % {interval})"


def refit(partials: str) -> str:
    """Partials re-bucketed to the width the limit asks for, then strided."""
    return f"""{partials}, span AS (
  SELECT greatest(1000, CAST(floor((epoch_ms(max(b)) - epoch_ms(min(b))) / {FIT_POINTS}) AS BIGINT))
         AS width FROM partials),
merged AS (
  SELECT {floor_by('b', 'width')} AS "timestamp", sensor_name, asset_id,
         sum(s) / sum(c) AS value FROM partials, span GROUP BY 1, 2, 3),
{strided('merged', RESULT, ORDER, FIT_POINTS)}"""


# Width of the first pass: the time span needs more than an hour per point, so it is exact.
SMART_WIDTH = SMART_HOURS * HOUR // FIT_POINTS


def average_partials(interval_ms: int) -> str:
    return f"""WITH {SERIES}, partials AS (
  SELECT {bucket(interval_ms)} AS b, sensor_name, asset_id, sum(value) AS s, count(value) AS c
  FROM series GROUP BY 1, 2, 3)"""


# Standard bucket widths in milliseconds.
LADDER = (
    "[1000, 5000, 10000, 30000, 60000, 300000, 600000, 1800000, 3600000, 7200000, 14400000, "
    "21600000, 43200000, 86400000]"
)


def rung(needed: str) -> str:
    fitting = f"list_filter({LADDER}, lambda x: x >= {needed})[1]"
    return f"CAST(coalesce({fitting}, greatest(floor({needed}), 60000)) AS BIGINT)"


SPANS = """spans AS (
  SELECT sensor_name, asset_id, count(*) AS points,
         (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1000.0::DOUBLE AS span_ms
  FROM series GROUP BY 1, 2)"""
WIDE_TIE_SQL = '"l_shipdate", l_orderkey, l_linenumber, l_partkey, l_suppkey'
ISO = """strftime("timestamp", '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN epoch_us("timestamp") % 1000000 = 0 THEN ''
       ELSE '.' || lpad(CAST(epoch_us("timestamp") % 1000000 AS VARCHAR), 6, '0') END"""


def iso(column: str) -> str:
    return ISO.replace('"timestamp"', column)


def auto_interval(points: int, n_sensors: int) -> int:
    """Narrowest standard width for the unaligned range."""
    from datetime import datetime

    seconds = (datetime.fromisoformat(END) - datetime.fromisoformat(START)).total_seconds()
    needed = seconds * 1000 / (points // n_sensors)
    rungs = [int(text) for text in LADDER.strip("[]").split(",")]
    return next(step for step in rungs if step >= needed)


def aggregated(method: str) -> str:
    """The automatic interval; its rows exceed the limit, so they are widened and strided."""
    points = 2000
    width = auto_interval(points, 5)
    merge = {"avg": "sum(s) / sum(c)", "min": "min(lo)", "max": "max(hi)"}[method]
    return f"""WITH {SERIES}, partials AS (
  SELECT {bucket(width)} AS b, sensor_name, asset_id, sum(value) AS s, count(value) AS c,
         min(value) AS lo, max(value) AS hi
  FROM series WHERE {within(START, END)} GROUP BY 1, 2, 3),
size AS (SELECT count(*) AS n, CAST(floor((epoch_ms(max(b)) - epoch_ms(min(b))) / {points}) AS BIGINT)
         AS needed FROM partials),
span AS (SELECT CASE WHEN n > {points} THEN greatest(1000, needed) ELSE {width} END AS width FROM size),
merged AS (
  SELECT {floor_by('b', 'width')} AS "timestamp", sensor_name AS sensor_type, asset_id,
         {merge} AS value FROM partials, span GROUP BY 1, 2, 3),
{strided('merged', '"timestamp", sensor_type, asset_id, round(value, 6) AS value',
         '"timestamp", sensor_type, asset_id', points)}"""


def limited_seconds() -> str:
    """The last value of each second, widened and strided to the limit."""
    last = ", ".join(f'last({f} ORDER BY t, event_id) AS {f}' for f in ("value", "k"))
    return f"""WITH {SERIES}, placed_in AS (SELECT *, "timestamp" AS t, {bucket(1000)} AS b FROM series),
size AS (SELECT count(DISTINCT (b, sensor_name, asset_id)) AS n, max(b) AS hi, min(b) AS lo FROM placed_in),
span AS (
  SELECT CASE WHEN n > {LIMIT_POINTS} THEN greatest(1000, CAST(floor((epoch_ms(hi) - epoch_ms(lo)) / {LIMIT_POINTS}) AS BIGINT))
         ELSE 1000 END AS width FROM size),
merged AS (
  SELECT {floor_by('b', 'width')} AS "timestamp", sensor_name AS sensor_type, asset_id, {last}
  FROM placed_in, span GROUP BY 1, 2, 3),
{strided('merged', '"timestamp", sensor_type, asset_id, value, k', '"timestamp", sensor_type, asset_id', LIMIT_POINTS)}"""


def coverage_sql(where: str, ends: str) -> str:
    return f"""WITH {SERIES}, seen AS (
  SELECT DISTINCT {bucket(HOUR)} AS b, sensor_name, asset_id FROM series WHERE {where}),
ends AS (SELECT sensor_name, asset_id, count(*) AS observed, {ends} FROM seen GROUP BY 1, 2)
SELECT sensor_name, asset_id, observed,
       (epoch_ms(hi) - epoch_ms(lo)) // {HOUR} + 1 AS expected,
       round(observed / ((epoch_ms(hi) - epoch_ms(lo)) // {HOUR} + 1), 6) AS coverage FROM ends"""


def tier_check(tier: str, interval_ms: int, threshold: float) -> str:
    return f"""SELECT sensor_name, asset_id, '{tier}' AS tier, observed, expected,
       round(observed / expected, 6) AS coverage, observed / expected >= {threshold} AS ok
FROM (SELECT sensor_name, asset_id, count(DISTINCT {bucket(interval_ms)}) AS observed,
             epoch_ms(max("timestamp")) // {interval_ms}
             - epoch_ms(min("timestamp")) // {interval_ms} + 1 AS expected
      FROM series GROUP BY 1, 2)"""




_PLAIN: dict[str, str] = {
    "query_series_avg": range_query("avg", START, END, two_sensors=True),
    "query_series_max": range_query("max", START, END, two_sensors=True),
    "query_series_last": range_query("last", START, END, two_sensors=True),
    "query_series_dedup": range_query("sum", START, END, two_sensors=True),
    "query_series_capped": refit(average_partials(HOUR)),
    "scan_raw": f"""WITH {SERIES} SELECT * FROM series
WHERE {within(START, END)} AND sensor_name IN ('click', 'view')
  AND asset_id IN ('asset_001', 'asset_002')""",
    "scan_rollup_1m": rollup_scan(60_000),
    "scan_rollup_1h": rollup_scan(HOUR),
    "scan_merge_schema": """SELECT * REPLACE (
  CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
  CAST(s_suppkey AS DOUBLE) AS s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey,
  CAST(n_nationkey AS DOUBLE) AS n_nationkey, CAST(n_regionkey AS DOUBLE) AS n_regionkey,
  round(c_acctbal, 6) AS c_acctbal, round(s_acctbal, 6) AS s_acctbal)
FROM (SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier
      UNION ALL BY NAME SELECT * FROM nation)""",
    "path_columns": """SELECT 'events' AS file_sensor, count(*) AS n_rows FROM events
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem""",
    "daqid_alias": """SELECT ts AS "timestamp", event_type AS sensor_name, user_id AS daqid, value,
       CAST(user_id AS VARCHAR) AS asset_id FROM events""",
    "rollup_roundtrip": buckets("avg", SIX_HOURS, extra=', min("timestamp") AS first_ts'),
    "scan_empty": f"WITH {SERIES} SELECT * FROM series WHERE false",
    "read_series": f"WITH {SERIES} SELECT * FROM series",
    "normalize": 'SELECT ts AS "timestamp", event_type AS sensor_name, event_id FROM events',
    "filter_time_range": f"WITH {SERIES} SELECT * FROM series WHERE {within(START, END)}",
    "filter_sensors": f"WITH {SERIES} SELECT * FROM series WHERE sensor_name IN ('click', 'view')",
    "filter_sensors_table": f"WITH {SERIES} SELECT * FROM series WHERE sensor_name LIKE '%i%'",
    "filter_assets": f"""WITH {SERIES} SELECT * FROM series
WHERE asset_id IN ('asset_001', 'asset_002')""",
    "filter_readings": f"""WITH {SERIES} SELECT * FROM series
WHERE {within(START, END)} AND sensor_name IN ('click', 'view')
  AND asset_id IN ('asset_001', 'asset_002')""",
    "partition_pruning": f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n_rows FROM events
WHERE {within(START, END, 'ts')} GROUP BY 1""",
    "drop_null_keys": f"WITH {SERIES} SELECT * FROM series WHERE sensor_name <> 'error'",
    "rollup_extract_mean": buckets("avg"),
    "rollup_extract_min": buckets("min"),
    "rollup_extract_max": buckets("max"),
    "sensors_of_asset": f"""WITH {SERIES} SELECT DISTINCT sensor_name FROM series
WHERE asset_id = 'asset_001'""",
    "missing_buckets": f"""WITH {SERIES}, seen AS (
  SELECT DISTINCT {bucket(HOUR)} AS "timestamp", sensor_name, asset_id FROM series),
ends AS (SELECT sensor_name, asset_id, min("timestamp") AS lo, max("timestamp") AS hi
         FROM seen GROUP BY 1, 2),
grid AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS "timestamp",
                sensor_name, asset_id FROM ends)
SELECT "timestamp", sensor_name, asset_id FROM grid
ANTI JOIN seen USING ("timestamp", sensor_name, asset_id)""",
    **{f"agg_{m}": buckets(m) for m in METHOD_SQL},
    "agg_count": buckets("avg", fields=(), extra=', count(*) AS "count"'),
    "agg_first_ts": buckets("max", extra=', min("timestamp") AS first_ts'),
    "agg_non_numeric": f"""SELECT {bucket(HOUR, 'ts')} AS "timestamp", event_type AS sensor_name,
       'asset_' || lpad(CAST(user_id % 4 AS VARCHAR), 3, '0') AS asset_id,
       first(props ORDER BY ts, event_id) AS props FROM events GROUP BY 1, 2, 3""",
    "preaggregate": f"""WITH {SERIES}
SELECT {bucket(HOUR)} AS "timestamp", sensor_name, asset_id,
       round(avg(value), 6) AS value, round(min(value), 6) AS value_min,
       round(max(value), 6) AS value_max, round(avg(k), 6) AS k, min(k) AS k_min, max(k) AS k_max
FROM series GROUP BY 1, 2, 3""",
    "rollup_1m": rollup(60_000),
    "rollup_1h": rollup(HOUR),
    "rollup_1d": rollup(24 * HOUR),
    "agg_no_asset": f"""WITH {SERIES}
SELECT {bucket(HOUR)} AS "timestamp", sensor_name, round(avg(value), 6) AS value,
       round(avg(k), 6) AS k FROM series GROUP BY 1, 2""",
    "agg_wide": f"""SELECT {bucket(7 * 24 * HOUR, 'l_shipdate')} AS "timestamp",
       l_returnflag AS sensor_name, l_linestatus AS asset_id,
       round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax
FROM lineitem GROUP BY 1, 2, 3""",
    "agg_wide_per_field": f"""SELECT {bucket(24 * HOUR, 'l_shipdate')} AS "timestamp",
       l_returnflag AS sensor_name, l_linestatus AS asset_id,
       round(sum(l_quantity), 2) AS l_quantity, round(max(l_extendedprice), 2) AS l_extendedprice,
       round(min(l_discount), 2) AS l_discount,
       round(last(l_tax ORDER BY {WIDE_TIE_SQL}), 2) AS l_tax
FROM lineitem GROUP BY 1, 2, 3""",
    "series_profile": f"""WITH {SERIES}
SELECT sensor_name, asset_id, round(stddev_samp(value), 6) AS std_dev,
       round(avg(value), 6) AS mean, round(stddev_samp(value) / abs(avg(value)), 6) AS variability
FROM series GROUP BY 1, 2""",
    "series_density": f"""WITH {SERIES}, {SPANS}
SELECT sensor_name, asset_id, points, round(span_ms / 3600000 + {SHIFT}, 3) AS duration_hours,
       round(span_ms / points + {SHIFT}, 3) AS density_ms_per_point,
       CAST(floor(span_ms / {HOUR}) AS BIGINT) AS estimated_points FROM spans""",
    "time_range": """SELECT min(ts) AS start_time, max(ts) AS end_time,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE, 6) AS duration_hours
FROM events WHERE event_type IN ('click', 'view')""",
    "time_range_hour": """SELECT date_trunc('hour', min(ts)) AS start_time,
       date_trunc('hour', max(ts)) AS end_time,
       round((epoch_us(date_trunc('hour', max(ts))) - epoch_us(date_trunc('hour', min(ts))))
             / 3600000000.0::DOUBLE, 6) AS duration_hours FROM events""",
    "stride_sample": f"""WITH {SERIES}, hourly AS (
  SELECT {bucket(HOUR)} AS "timestamp", sensor_name, asset_id, avg(value) AS value
  FROM series GROUP BY 1, 2, 3), {strided('hourly', RESULT, ORDER, STRIDE_POINTS)}""",
    "stride_sample_ordered": f"""WITH {SERIES}, {strided(
        'series', 'sensor_name, asset_id, value, k, event_id', 'event_id', STRIDE_POINTS)}""",
    "list_sensors": "SELECT DISTINCT event_type AS sensor_name FROM events",
    "list_assets": f"WITH {SERIES} SELECT DISTINCT asset_id FROM series",
    "series_catalog": f"""WITH {SERIES}
SELECT sensor_name, asset_id, count(*) AS data_count, min("timestamp") AS first_seen,
       max("timestamp") AS last_seen FROM series GROUP BY 1, 2""",
    "sensor_catalog": f"""WITH {SERIES}
SELECT sensor_name, count(DISTINCT asset_id) AS asset_count, count(*) AS data_count,
       min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM series GROUP BY 1""",
    "asset_catalog": f"""WITH {SERIES}
SELECT asset_id, count(DISTINCT sensor_name) AS sensor_count, count(*) AS data_count,
       min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM series GROUP BY 1""",
    "hybrid_union": f"WITH {HYBRID} SELECT * FROM hybrid",
    "list_sensors_hybrid": f"WITH {HYBRID} SELECT DISTINCT sensor_name FROM hybrid",
    "time_range_hybrid": f"""WITH {HYBRID}
SELECT min("timestamp") AS start_time, max("timestamp") AS end_time,
       round((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 3600000000.0::DOUBLE, 6)
       AS duration_hours FROM hybrid""",
    "iso_records": f"""WITH {SERIES}
SELECT '{{"timestamp":"' || {ISO} || '","sensor_name":"' || sensor_name || '","asset_id":"'
       || asset_id || '","value":' || CAST(value AS VARCHAR) || ',"k":' || CAST(k AS VARCHAR)
       || ',"event_id":' || CAST(event_id AS VARCHAR) || '}}' AS record FROM series""",
    "recommend_interval": f"""WITH {SERIES}, {SPANS},
widths AS (SELECT *, {rung(f'span_ms / {SERIES_POINTS}')} AS width FROM spans)
SELECT sensor_name, asset_id, points, round(span_ms / 3600000 + {SHIFT}, 3) AS duration_hours,
       width AS recommended_interval_ms,
       CAST(floor(span_ms / width) AS BIGINT) AS estimated_points FROM widths""",
    "estimate_points": f"""WITH {SERIES}
SELECT sensor_name, asset_id,
       CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1000.0::DOUBLE / {HOUR})
            AS BIGINT) AS estimated_points,
       count(DISTINCT {bucket(HOUR)}) AS actual_points FROM series GROUP BY 1, 2""",
    "raw_query": f"""WITH {SERIES}
SELECT {bucket(1000)} AS "timestamp", sensor_name AS sensor_type, asset_id,
       last(value ORDER BY "timestamp", event_id) AS value,
       last(k ORDER BY "timestamp", event_id) AS k
FROM series WHERE {within(ALL_START, ALL_END)} GROUP BY 1, 2, 3""",
    "raw_query_truncated": limited_seconds(),
    "aggregated_query_min": aggregated("min"),
    "aggregated_query_max": aggregated("max"),
    "aggregated_query_mean": aggregated("avg"),
    "rebuild_rollups": f"""WITH {SERIES}
SELECT {bucket(HOUR)} AS "timestamp", sensor_name, asset_id, round(avg(value), 6) AS value,
       round(avg(k), 6) AS k, '1h' AS grain FROM series GROUP BY 1, 2, 3
UNION ALL
SELECT {bucket(24 * HOUR)}, sensor_name, asset_id, round(avg(value), 6), round(avg(k), 6), '1d'
FROM series GROUP BY 1, 2, 3""",
    "downsample_avg": f"""WITH {SERIES}, span AS (
  SELECT greatest(1000, CAST(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp")))
         / 1000.0::DOUBLE / {FIT_POINTS}) AS BIGINT)) AS width FROM series),
merged AS (
  SELECT {floor_by('"timestamp"', 'width')} AS "timestamp", sensor_name, asset_id,
         avg(value) AS value FROM series, span GROUP BY 1, 2, 3),
{strided('merged', RESULT, ORDER, FIT_POINTS)}""",
    "downsample_noop": f"WITH {SERIES} SELECT * FROM series",
    "smart_downsample": refit(average_partials(SMART_WIDTH)),
    "smart_report": f"""{average_partials(SMART_WIDTH)}, sizes AS (
  SELECT count(*) AS n, greatest({SMART_WIDTH}, CAST(floor((epoch_ms(max(b)) - epoch_ms(min(b))) / {FIT_POINTS}) AS BIGINT)) AS width FROM partials),
merged AS (SELECT DISTINCT {floor_by('b', 'width')}, sensor_name, asset_id FROM partials, sizes)
SELECT (SELECT count(*) FROM events) AS readings, n AS points_before,
       CASE WHEN n <= {FIT_POINTS} THEN n ELSE least({FIT_POINTS}, (SELECT count(*) FROM merged)) END AS points_after,
       CASE WHEN n <= {FIT_POINTS} THEN {SMART_WIDTH} ELSE width END AS interval_ms, 'avg' AS method, n > {FIT_POINTS} AS truncated
FROM sizes""",
    "smart_status_last": f"""WITH {SERIES}, partials AS (
  SELECT {bucket(SMART_WIDTH)} AS b, sensor_name, asset_id, max(("timestamp", event_id)) AS latest,
         last(value ORDER BY "timestamp", event_id) AS v,
         last(k ORDER BY "timestamp", event_id) AS s FROM series GROUP BY 1, 2, 3),
span AS (SELECT greatest(1000, CAST(floor((epoch_ms(max(b)) - epoch_ms(min(b))) / {FIT_POINTS})
         AS BIGINT)) AS width FROM partials),
merged AS (
  SELECT {floor_by('b', 'width')} AS "timestamp", sensor_name, asset_id,
         last(v ORDER BY latest) AS value, last(s ORDER BY latest) AS status
  FROM partials, span GROUP BY 1, 2, 3),
{strided('merged', RESULT + ', status', ORDER, FIT_POINTS)}""",
    "adaptive_bucket": f"""WITH {SERIES}, {SPANS},
widths AS (SELECT sensor_name, asset_id, {rung(f'span_ms / {SERIES_POINTS}')} AS interval_ms FROM spans)
SELECT {floor_by('"timestamp"', 'interval_ms')} AS "timestamp", sensor_name, asset_id, interval_ms,
       round(avg(value), 6) AS value
FROM series JOIN widths USING (sensor_name, asset_id) GROUP BY 1, 2, 3, 4""",
    "coverage": coverage_sql("true", "min(b) AS lo, max(b) AS hi"),
    "coverage_range": coverage_sql(
        within(START, END),
        f"""time_bucket(INTERVAL '1 hour', TIMESTAMP '{START}', TIMESTAMP '1970-01-01') AS lo,
        time_bucket(INTERVAL '1 hour', TIMESTAMP '{END}', TIMESTAMP '1970-01-01') AS hi""",
    ),
    "validate_rollups": f"""WITH {SERIES}
{tier_check('raw', 60_000, 0.9)} UNION ALL {tier_check('1m', 60_000, 0.8)}
UNION ALL {tier_check('1h', HOUR, 0.8)} UNION ALL {tier_check('1d', 24 * HOUR, 0.8)}""",
    "tiered_read_1h": range_query("avg", START, END, SIX_HOURS),
    "tiered_read_1m": range_query("avg", "2024-01-05T00:10:30", "2024-01-11T21:00:00", SIX_HOURS),
    "tiered_fallback": range_query("avg", "2024-01-09", "2024-01-10"),
    "file_inventory": 'SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_rows FROM events GROUP BY 1',
    "coverage_silent": f"""WITH {SERIES}, keys AS (SELECT DISTINCT sensor_name, asset_id FROM series),
seen AS (SELECT DISTINCT {bucket(HOUR)} AS b, sensor_name, asset_id FROM series WHERE {within(SILENT_START, SILENT_END)})
SELECT sensor_name, asset_id, count(b) AS observed, CAST(2 AS BIGINT) AS expected, count(b) / 2 AS coverage
FROM keys LEFT JOIN seen USING (sensor_name, asset_id) GROUP BY 1, 2""",
    "missing_buckets_silent": f"""WITH {SERIES},
keys AS (SELECT DISTINCT sensor_name, asset_id FROM series),
grid AS (SELECT *, unnest([TIMESTAMP '2024-01-09 03:00:00', TIMESTAMP '2024-01-09 04:00:00']) AS "timestamp" FROM keys)
SELECT "timestamp", sensor_name, asset_id FROM grid
WHERE ("timestamp", sensor_name, asset_id) NOT IN (SELECT ({bucket(HOUR)}, sensor_name, asset_id) FROM series)""",
    "tiered_daily_rebuilds": range_query("avg", ALL_START, ALL_END, SIX_HOURS),
    "tiered_dedup": range_query("sum", ALL_START, ALL_END, 24 * HOUR),
    "tiered_fields": f"""WITH {SERIES}
SELECT {bucket(24 * HOUR)} AS "timestamp", sensor_name, asset_id, CAST(sum(k) AS BIGINT) AS k FROM series GROUP BY 1, 2, 3""",
    "tiered_late": range_query("avg", ALL_START, ALL_END, SIX_HOURS),
    "tiered_partly_expired": range_query("avg", "2024-01-05T06:00:00", "2024-01-11T18:00:00", SIX_HOURS),
    "tiered_partial_rollup": range_query("sum", ALL_START, ALL_END, SIX_HOURS),
    "tiered_raw_expired": range_query("avg", "2024-01-08T12:00:00", "2024-01-09T12:00:00", HOUR),
    "rebuild_after_delete": f"""WITH {SERIES}
SELECT {bucket(24 * HOUR)} AS "timestamp", sensor_name, asset_id, count(*) AS count
FROM series WHERE CAST("timestamp" AS DATE) <> DATE '2024-01-10' GROUP BY 1, 2, 3""",
    "popular_keys": f"""WITH {LOG}
SELECT key, count(*) AS frequency, max("timestamp") AS last_access FROM log GROUP BY 1
ORDER BY frequency DESC, key LIMIT 10""",
    "key_totals": f"""WITH {LOG}
SELECT count(*) AS tracked_queries, CAST(sum(n) AS BIGINT) AS total_accesses,
       count(*) FILTER (n > 5) AS popular_queries
FROM (SELECT key, count(*) AS n FROM log GROUP BY 1)""",
    "usage_summary": f"""WITH {LOG}
SELECT count(*) AS total_queries, count(*) FILTER (hit) AS cache_hits,
       round(count(*) FILTER (hit) / count(*), 6) AS cache_hit_rate,
       round(avg(execution_ms), 6) AS avg_execution_time_ms FROM log""",
    "tier_usage": f"WITH {LOG} SELECT tier, count(*) AS queries FROM log WHERE NOT hit GROUP BY 1",
    "stale_keys": f"""WITH {LOG}
SELECT key, count(*) AS frequency, max("timestamp") AS last_access FROM log GROUP BY 1
HAVING max("timestamp") < TIMESTAMP '2024-01-30 12:00:00'""",
    "request_fingerprint": f"""SELECT event_id, md5(
  '{{"sensors":["' || least(event_type, 'heartbeat') || '","' || greatest(event_type, 'heartbeat')
  || '"],"start_time":"' || {iso('(ts - INTERVAL 1 HOUR)')} || '","end_time":"' || {iso('ts')}
  || '","asset_ids":["' || CAST(user_id AS VARCHAR)
  || '"],"interval_ms":1000,"aggregation":"avg","max_datapoints":10000}}') AS fingerprint
FROM events""",
    "read_hourly_tree": f"""SELECT ts AS "timestamp", 'events' AS sensor_name, 'plant' AS asset_id, value, event_id
FROM events WHERE {within(TREE_START, TREE_END, 'ts')}""",
    "read_minute_tree": tree_scan(60_000, "avg"),
    "read_minute_tree_by_day": tree_scan(60_000, "min"),
    "read_hour_tree": tree_scan(HOUR, "max"),
    "read_day_tree": tree_scan(24 * HOUR, "avg"),
    "scan_quarantine": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       CASE CAST(ts AS DATE) WHEN DATE '2024-01-05' THEN 'no Parquet footer' WHEN DATE '2024-01-07' THEN 'vanished' END AS reason,
       count(*) FILTER (CAST(ts AS DATE) NOT IN (DATE '2024-01-05', DATE '2024-01-07')) AS n_rows
FROM events GROUP BY 1, 2""",
    "path_columns_hourly": """SELECT 'events' AS file_sensor, 'plant' AS file_asset, date_trunc('hour', ts) AS file_hour, count(*) AS n_rows
FROM events GROUP BY 3""",
    "catalog_maintained": f"""WITH {SERIES}
SELECT sensor_name, asset_id, count(*) AS data_count, min("timestamp") AS first_seen, max("timestamp") AS last_seen
FROM series WHERE {LEFT} GROUP BY 1, 2""",
    "catalog_maintained_sensors": f"""WITH {SERIES}
SELECT sensor_name, count(DISTINCT asset_id) AS asset_count, count(*) AS data_count, min("timestamp") AS first_seen,
       max("timestamp") AS last_seen FROM series WHERE {LEFT} GROUP BY 1""",
    "time_range_maintained": f"""SELECT date_trunc('hour', min(ts)) AS start_time, date_trunc('hour', max(ts)) AS end_time,
       round((epoch_us(date_trunc('hour', max(ts))) - epoch_us(date_trunc('hour', min(ts)))) / 3600000000.0::DOUBLE, 6) AS duration_hours
FROM (SELECT ts, ts AS "timestamp" FROM events) WHERE {LEFT}""",
    "profile_from_rollup": f"""WITH {SERIES}
SELECT sensor_name, asset_id, round(stddev_samp(value), 6) AS std_dev,
       round(avg(value), 6) AS mean, round(stddev_samp(value) / abs(avg(value)), 6) AS variability
FROM series WHERE {LEFT} GROUP BY 1, 2""",
    "stream_late_repair": range_query("avg", ALL_START, ALL_END, SIX_HOURS),
    "stream_rollup_1m": f"""WITH {SERIES}, closed AS (
  SELECT max("timestamp") - INTERVAL 10 MINUTE AS watermark FROM series)
SELECT {bucket(60_000)} AS "timestamp", sensor_name, asset_id, round(avg(value), 6) AS value,
       min("timestamp") AS first_ts FROM series, closed
GROUP BY 1, 2, 3 HAVING {bucket(60_000)} + INTERVAL 1 MINUTE <= any_value(watermark)""",
}

ORACLE = {name: sql.replace(", 6)", f" + {SHIFT}, 6)") for name, sql in _PLAIN.items()}
