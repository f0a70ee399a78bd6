import pytest
from pyspark.sql import functions as F

from pulsegrid import RollupStore, query_series, rebuild_rollups
from pulsegrid.operators.bucket import aggregate_by_interval
from pulsegrid.operators.partials import finalize, merge_partials
from pulsegrid.session import delete_path, scratch_path
from pulsegrid.sources import rollups
from pulsegrid.streaming.rollup import read_stream, stream_into_store, stream_rollup
from tests.conftest import ts

MINUTE = 60_000


def canonical(df):
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.collect()
    )


def test_closed_buckets_equal_the_batch(spark, six_series):
    """Files arrive one at a time, in the order of time; the last ten minutes stay open."""
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    for quarter in range(4):
        part = six_series.where((F.minute("timestamp") / 8).cast("int") == quarter)
        part.coalesce(1).write.mode("append").parquet(source)
    stream = read_stream(spark, source, six_series.schema, files_per_batch=1)
    query = stream_rollup(stream, f"{out}/table", f"{out}/checkpoint")
    query.awaitTermination()
    table = spark.read.parquet(f"{out}/table")
    closed = six_series.where("minute(timestamp) < 19")
    for method in ("avg", "last", "count"):
        direct = aggregate_by_interval(closed, MINUTE, method)
        assert canonical(finalize(table, method)) == canonical(direct)
    coarse = finalize(merge_partials(table, 19 * MINUTE * 60), "max")
    assert coarse.count() == 6


def test_a_restart_continues_where_it_stopped(spark, six_series):
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    for bounds in ("minute(timestamp) < 15", "minute(timestamp) >= 15"):
        six_series.where(bounds).coalesce(1).write.mode("append").parquet(source)
        stream = read_stream(spark, source, six_series.schema)
        stream_rollup(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    table = spark.read.parquet(f"{out}/table")
    direct = aggregate_by_interval(six_series.where("minute(timestamp) < 19"), MINUTE, "sum")
    assert canonical(finalize(table, "sum")) == canonical(direct)


def arrivals(spark, six_series):
    """The readings in four parts, the second the latest of all."""
    minute = F.minute("timestamp")
    return [six_series.where(c) for c in (minute < 10, minute >= 20, (minute >= 10) & (minute < 15), (minute >= 15) & (minute < 20))]


def streamed(spark, store, source, checkpoint, part):
    part.coalesce(1).write.mode("append").parquet(source)
    raw = spark.read.parquet(source)
    stream = read_stream(spark, source, raw.schema, files_per_batch=1)
    stream_into_store(stream, store, checkpoint, source=raw).awaitTermination()
    return raw


@pytest.fixture
def live(spark):
    return RollupStore(spark, scratch_path(spark, "live")), scratch_path(spark, "arrivals"), scratch_path(spark, "checkpoint")


def test_the_store_equals_the_batch_after_late_readings_and_replays(spark, six_series, live):
    store, source, checkpoint = live
    direct = {m: canonical(aggregate_by_interval(six_series, MINUTE, m)) for m in ("avg", "last", "count", "sum")}
    for number, part in enumerate(arrivals(spark, six_series)):
        raw = streamed(spark, store, source, checkpoint, part)
        if number:
            delete_path(spark, f"{checkpoint}/commits/{number}")  # the batch runs again
        if number == 2:
            for grain in ("1m", "1h"):
                store.compact(grain)
            assert not store._deltas("1m") and store._deltas("1d")
    raw = streamed(spark, store, source, checkpoint, six_series.where("false"))
    for method, want in direct.items():
        assert canonical(finalize(store.read("1m"), method)) == want
    hours = canonical(aggregate_by_interval(six_series, 60 * MINUTE, "sum"))
    for grain in ("1h", "1d"):
        assert canonical(finalize(store.read(grain), "sum"))[0][3:] == hours[0][3:]
    store.compact("1d")
    assert canonical(finalize(store.read("1d"), "sum"))[0][3:] == hours[0][3:]
    spans = store.spans("1m", ts("2024-01-01"), ts("2024-01-02"))
    assert [s[:2] for s in spans] == [(ts("2024-01-01"), ts("2024-01-01T00:29"))]
    assert store.ledger.doubtful(raw, spans) == []


def test_files_the_stream_has_not_read_are_asked(spark, six_series, live):
    store, source, checkpoint = live
    parts = arrivals(spark, six_series)
    streamed(spark, store, source, checkpoint, parts[0].unionByName(parts[1]))
    parts[2].unionByName(parts[3]).write.mode("append").parquet(source)
    raw = spark.read.parquet(source)
    query = (["quad_ch1"], "2024-01-01", "2024-01-01T00:30:00")
    options = dict(interval_ms=MINUTE, aggregation="sum")
    routed, whole = query_series(raw, *query, store=store, **options), query_series(six_series, *query, **options)
    assert canonical(routed.data) == canonical(whole.data)
    # They expire before the stream reads them: what it had is still answered.
    left = raw.where("timestamp > '2030-01-01'")
    kept = query_series(left, *query, store=store, allow_gaps=True, **options)
    assert kept.data.count() == 2 * 19 and kept.tier_used == "1m"


@pytest.mark.parametrize("broken", ["before", "after"])
def test_a_compaction_that_breaks_off_changes_nothing(spark, six_series, live, monkeypatch, broken):
    store, source, checkpoint = live
    for part in arrivals(spark, six_series)[:2]:
        streamed(spark, store, source, checkpoint, part)
    before = canonical(finalize(store.read("1m"), "sum"))

    def fails(*args):
        raise OSError("gone")

    # The folder gets its name or does not; what comes then does not happen.
    if broken == "before":
        monkeypatch.setattr("pulsegrid.sources.rollups.rename_new", fails)
    else:
        monkeypatch.setattr("pulsegrid.sources.rollups.write_partitioned", _but_second(rollups.write_partitioned, fails))
    with pytest.raises(OSError):
        store.compact("1m")
    monkeypatch.undo()
    assert canonical(finalize(store.read("1m"), "sum")) == before
    store.compact("1m")
    assert canonical(finalize(store.read("1m"), "sum")) == before and not store._deltas("1m")


def _but_second(first, second):
    calls = []

    def run(*args):
        calls.append(1)
        return first(*args) if len(calls) == 1 else second(*args)

    return run


def test_a_rebuild_folds_in_the_stream_first(spark, six_series, live):
    store, source, checkpoint = live
    for part in arrivals(spark, six_series):
        raw = streamed(spark, store, source, checkpoint, part)
    rebuild_rollups(raw, store, ["quad_ch1"])
    assert canonical(finalize(store.read("1h"), "sum")) == canonical(aggregate_by_interval(six_series, 60 * MINUTE, "sum"))
