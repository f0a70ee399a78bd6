"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from tools.check_oracle import compare, connect
from workload.inputs import series, wide
from workload.oracle import ORACLE
from workload.queries import QUERIES

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_and_the_reverse():
    assert set(QUERIES) - ROWS_ONLY == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    if name in ORACLE:
        assert compare(got, duck.execute(ORACLE[name]).df()) is None
    else:
        assert len(got) > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF"):
        assert banned not in plan


@pytest.mark.parametrize("name", [f"agg_{m}" for m in ("avg", "min", "max", "last", "first", "count", "sum")])
def test_buckets_take_one_shuffle_and_hash_aggregates(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert plan.count("HashAggregate") == 2
    assert "SortAggregate" not in plan and "ObjectHash" not in plan


def test_scans_read_only_what_is_asked(spark, sf_dir):
    from pulsegrid.operators.bucket import aggregate_by_interval
    from pulsegrid.operators.filters import time_range

    df = time_range(series(spark, sf_dir), "2024-01-03", "2024-01-06")
    plan = aggregate_by_interval(df, 3_600_000, fields=["value"])._jdf.queryExecution().toString()
    scan = plan[plan.rindex("FileScan parquet"):]
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in scan
    assert "LessThan(ts,2024-01-06T00:00)" in scan
    assert "props" not in scan.split("ReadSchema")[1]
    narrow = aggregate_by_interval(wide(spark, sf_dir), 3_600_000, fields=["l_tax"])
    scan = narrow._jdf.queryExecution().toString().split("ReadSchema")[-1]
    assert "l_quantity" not in scan and "l_tax" in scan
