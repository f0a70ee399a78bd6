"""Stored rollups: mergeable partials per minute, hour and day."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from pulsegrid.functions.time import ceil_time, floor_time, ntz, utc_time
from pulsegrid.operators.filters import PARTITION, only_assets, only_sensors, time_range
from pulsegrid.operators.partials import MOMENT, add_partials, partial_stats, statistic
from pulsegrid.schema import series_keys
from pulsegrid.session import delete_path, glob_paths, list_paths, materialize, rename_new
from pulsegrid.sources.ledger import Ledger
from pulsegrid.sources.readings import BUCKET_NAMES, read_parquet, write_partitioned


@dataclass(frozen=True)
class Grain:
    """A bucket width and the period whose first day names the partition of a bucket."""

    name: str
    interval_ms: int
    period: str


GRAINS = {
    grain.name: grain
    for grain in (
        Grain("1m", 60_000, "DAY"),
        Grain("1h", 3_600_000, "MONTH"),
        Grain("1d", 86_400_000, "YEAR"),
    )
}
DAY_MS = GRAINS["1d"].interval_ms
COVERED = "grain string, start timestamp_ntz, end timestamp_ntz, build string, number long"


class RollupStore:
    """Rollup tables below one root folder, each with a record of the time it covers.

    Rows are partitioned by date only and sorted by series within: the number of assets may be
    large, and a folder for each would drown the data in small files. `partition_by` may name
    `asset_id` as well where assets are few. `tie` orders readings of equal time.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        *,
        tie: Sequence[str] = (),
        partition_by: Sequence[str] = (PARTITION,),
    ) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.tie = tuple(tie)
        self.partition_by = tuple(partition_by)
        self.ledger = Ledger(spark, f"{self.root}/sources")

    def path(self, grain: str) -> str:
        return f"{self.root}/{GRAINS[grain].name}"

    def exists(self, grain: str) -> bool:
        return self.open(grain) is not None

    def open(self, grain: str) -> DataFrame | None:
        """The whole table of a grain, or None where there is none; deltas that are not folded in yet are added."""
        table, pending = self._table(self.path(grain)), self._table(f"{self.root}/pending/{grain}/rows")
        if pending is not None:
            days = [r[0] for r in pending.select(PARTITION).distinct().collect()]  # one row per partition
            rest = None if table is None else table.where(~F.col(PARTITION).isin(days))
            table = pending if rest is None else rest.unionByName(pending, allowMissingColumns=True)
        deltas = self._deltas(grain)
        if not deltas:
            return table
        added = read_parquet(self.spark, *deltas, base_path=f"{self.root}/deltas/{grain}").drop("batch")
        both = added if table is None else table.unionByName(added.select(*table.columns))
        return add_partials(both, [PARTITION])

    def _deltas(self, grain: str) -> list[str]:
        """Folders of deltas that were written to their end and are in neither the table nor what is about to be folded in."""
        found = glob_paths(self.spark, f"{self.root}/deltas/{grain}/batch=*/_SUCCESS")
        folded = self._folded(grain) if found else {}
        named = [(path, *_batch(path)) for path in (p.rsplit("/", 1)[0] for p in found)]
        return [path for path, stream, number in named if number > folded.get(stream, -1)]

    def _folded(self, grain: str) -> dict[str, int]:
        """The last batch of each stream that was folded in; batches come in order."""
        out: dict[str, int] = {}
        for path in (f"{self.root}/folded/{grain}", f"{self.root}/pending/{grain}/folded"):
            names = self._table(path)
            for stream, number in [] if names is None else names.groupBy("stream").agg(F.max("number")).collect():
                out[stream] = max(number, out.get(stream, -1))
        return out

    def add_delta(self, grain: str, partials: DataFrame, stream: str, number: int) -> None:
        """Store partials that come on top of all others. The same batch again takes the place of the first, or is there already."""
        if number <= self._folded(grain).get(stream, -1) or partials.isEmpty():
            return
        dated = partials.withColumn(PARTITION, F.to_date(F.date_trunc(GRAINS[grain].period, F.col("bucket"))))
        path = f"{self.root}/deltas/{grain}/batch={stream}-{number:012d}"
        dated.repartition(PARTITION).write.mode("overwrite").partitionBy(PARTITION).parquet(path)

    def compact(self, grain: str) -> None:
        """Fold deltas into the partitions they belong to.

        The new partitions are written aside and count, in place of the old ones and the deltas, from the moment their folder gets
        its name. What follows can be done again after any failure, and is, before anything else is folded.
        """
        self._finish(grain)
        deltas = self._deltas(grain)
        if not deltas:
            return
        aside, final = f"{self.root}/aside-{uuid.uuid4().hex}", f"{self.root}/pending/{grain}"
        touched = read_parquet(self.spark, *deltas, base_path=f"{self.root}/deltas/{grain}").select(PARTITION).distinct()
        days = [r[0] for r in touched.collect()]  # one row per partition
        write_partitioned(self.open(grain).where(F.col(PARTITION).isin(days)), f"{aside}/rows", self.partition_by)
        names = [_batch(path) for path in deltas]
        self.spark.createDataFrame(names, "stream string, number long").coalesce(1).write.parquet(f"{aside}/folded")
        if not rename_new(self.spark, aside, final):
            raise RuntimeError(f"another compaction of {self.path(grain)} is under way")
        self._finish(grain)

    def _finish(self, grain: str) -> None:
        """Move a pending compaction into the table."""
        pending = f"{self.root}/pending/{grain}"
        rows = self._table(f"{pending}/rows")
        if rows is None:
            return
        write_partitioned(rows, self.path(grain), self.partition_by)
        read_parquet(self.spark, f"{pending}/folded").coalesce(1).write.mode("append").parquet(f"{self.root}/folded/{grain}")
        folded = self._folded(grain)
        for path in glob_paths(self.spark, f"{self.root}/deltas/{grain}/batch=*"):
            stream, number = _batch(path)
            if number <= folded.get(stream, -1):
                delete_path(self.spark, path)
        delete_path(self.spark, pending)

    def _table(self, path: str) -> DataFrame | None:
        if not glob_paths(self.spark, path):
            return None
        try:
            return read_parquet(self.spark, path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def read(
        self,
        grain: str,
        sensors: Sequence[str] | DataFrame | None = None,
        start: datetime | str | None = None,
        end: datetime | str | None = None,
        assets: Sequence[str] | DataFrame | None = None,
    ) -> DataFrame:
        """Partials whose bucket starts in `[start, end)`; only the partitions of that time."""
        table = self.open(grain)
        if table is None:
            raise FileNotFoundError(f"no rollup at {self.path(grain)}")
        return self.select(table, grain, sensors, start, end, assets)

    def select(self, table: DataFrame, grain: str, sensors=None, start=None, end=None, assets=None):
        """`read` on a table opened before."""
        return select_rows(table, grain, sensors, start, end, assets)

    def write(self, grain: str, partials: DataFrame) -> None:
        """Store partials; partitions that get rows are replaced whole, others stay."""
        start_of_period = F.date_trunc(GRAINS[grain].period, F.col("bucket"))
        dated = partials.withColumn(PARTITION, F.to_date(start_of_period))
        write_partitioned(dated, self.path(grain), self.partition_by)

    def replace(
        self,
        grain: str,
        partials: DataFrame,
        start: datetime | None = None,
        end: datetime | None = None,
        sensors: Sequence[str] | None = None,
    ) -> None:
        """Put `partials` in place of the rows of the given time and sensors.

        A partition is the unit of replacement, so its other rows are carried over. They are
        written aside first: a table cannot be overwritten while it is read.
        """
        self.compact(grain)
        if not self.exists(grain):
            self.write(grain, partials)
            return
        if start is None and end is None and not sensors:
            self.clear(grain, materialize(partials, "rollup"))
            return
        replaced = F.lit(True)
        if start is not None:
            replaced &= F.col("bucket") >= ntz(start)
        if end is not None:
            replaced &= F.col("bucket") < ntz(end)
        if sensors:
            replaced &= F.col("sensor_name").isin(list(sensors))
        lower, upper = self._partition_bounds(grain, start, end)
        kept = self.read(grain, None, lower, upper).where(~replaced)
        rows = materialize(partials.unionByName(kept, allowMissingColumns=True), "rollup")
        self.clear(grain, rows, lower, upper)

    def clear(self, grain: str, rows: DataFrame, lower: datetime | None = None, upper: datetime | None = None) -> None:
        """Write `rows`, and delete partitions between the bounds that they leave empty."""
        table = time_range(read_parquet(self.spark, self.path(grain)), lower, upper, column="bucket", partition_floor=GRAINS[grain].period)
        there = {r[0] for r in table.select(PARTITION).distinct().collect()}  # one row per partition
        left = {r[0] for r in rows.select(F.to_date(F.date_trunc(GRAINS[grain].period, "bucket"))).distinct().collect()}
        self.write(grain, rows)
        empty = there - left
        for path in list_paths(self.spark, self.path(grain), self.partition_by):
            if any(f"{PARTITION}={day}" in path for day in empty):
                delete_path(self.spark, path)

    def _partition_bounds(self, grain: str, start: datetime | None, end: datetime | None):
        """The time range widened to whole partitions."""
        period = GRAINS[grain].period
        lower = upper = None
        if start is not None:
            lower = start.replace(hour=0, minute=0, second=0, microsecond=0)
            lower = lower.replace(day=1) if period in ("MONTH", "YEAR") else lower
            lower = lower.replace(month=1) if period == "YEAR" else lower
        if end is not None:
            upper = ceil_time(end, DAY_MS)
            if period == "MONTH" and upper.day != 1:
                upper = upper.replace(day=1)
                upper = (
                    upper.replace(year=upper.year + 1, month=1)
                    if upper.month == 12
                    else upper.replace(month=upper.month + 1)
                )
            if period == "YEAR" and (upper.month, upper.day) != (1, 1):
                upper = upper.replace(year=upper.year + 1, month=1, day=1)
        return lower, upper

    def build(self, fields: Sequence[str], dedup: bool, moments: bool = False) -> str:
        """How rollups were made: fields, those with moments, order of equal times, copies removed or not."""
        held = [*fields, *(f"{field}_{MOMENT}" for field in fields if moments)]
        return json.dumps({"fields": sorted(held), "tie": list(self.tie), "dedup": dedup}, sort_keys=True)

    def covered(self) -> list[Row]:
        """The record: one row per grain, build and span without a gap, as it is merged when written."""
        return self._latest()[1]

    def _latest(self) -> tuple[int, list[Row]]:
        """The newest version of the record that was written to its end, and its rows."""
        done = glob_paths(self.spark, f"{self.root}/record/version=*/_SUCCESS")
        numbers = [int(path.rsplit("version=", 1)[1].split("/")[0]) for path in done]
        if not numbers:
            return 0, []
        path = f"{self.root}/record/version={max(numbers)}"
        return max(numbers), self.spark.read.schema(COVERED).parquet(path).collect()

    def _change_record(self, change: Callable[[list[tuple]], list[tuple]]) -> None:
        """Write the record anew, as a version of its own; it counts once it has its final name.

        A build at the same time may have been faster, so the change is made again on what is there then.
        """
        for _ in range(100):
            version, rows = self._latest()
            before = list(map(tuple, rows))
            after = _merged_record(change(before))
            if after == before:
                return
            aside = f"{self.root}/record/aside-{uuid.uuid4().hex}"
            self.spark.createDataFrame(after, COVERED).coalesce(1).write.parquet(aside)
            if rename_new(self.spark, aside, f"{self.root}/record/version={version + 1}"):
                for path in glob_paths(self.spark, f"{self.root}/record/version={version - 1}"):
                    delete_path(self.spark, path)
                return
            delete_path(self.spark, aside)
        raise RuntimeError(f"the record of {self.root} changes all the time")

    def mark_covered(self, grains: Sequence[str], start: datetime, end: datetime, build: str, number: int = 0) -> None:
        """Record that rollups hold everything the readings had in `[start, end)`, as build `number` of the ledger found them."""
        self._change_record(lambda rows: [*rows, *[(grain, start, end, build, number) for grain in grains]])

    def next_number(self) -> int:
        """A number for a build that no other has."""
        return uuid.uuid4().int >> 66

    def spans(
        self, grain: str, start: datetime, end: datetime, fields: Sequence[str] = (), tie: Sequence[str] | None = None, dedup: bool | None = None
    ) -> list[tuple[datetime, datetime, int]]:
        """The recorded parts of `[start, end)` on whole buckets that were built so, in order, with the numbers of their builds."""
        width, at, out = GRAINS[grain].interval_ms, start, []
        for row in sorted(self.covered(), key=lambda r: (r["start"], r["end"])):
            build = json.loads(row["build"])
            fits = row["grain"] == grain and set(fields) <= set(build["fields"]) and (dedup is None or build["dedup"] == dedup)
            fits = fits and (tie is None or build["tie"] == list(tie))
            low, high = max(at, row["start"]), min(end, row["end"])
            if fits and low < high:
                low, high = ceil_time(low, width), floor_time(high, width)
                if low < high:
                    out.append((low, high, row["number"]))
                    at = high
        return out

    def forget(self, grains: Sequence[str], start: datetime, end: datetime, unless: str | None = None) -> None:
        """Take `[start, end)` out of the record, but for the build named."""
        self._change_record(lambda rows: _outside(rows, grains, start, end, unless))

    def record_build(self, grains: Sequence[str], span: tuple[datetime, datetime], known: datetime | None, build: str, number: int) -> None:
        """Put a build in place of what the record says of a span: it holds everything up to `known`."""
        new = [(grain, span[0], known, build, number) for grain in grains] if known is not None and span[0] < known else []
        self._change_record(lambda rows: [*_outside(rows, grains, *span), *new])

    def open_ends(self, start: datetime) -> list[datetime]:
        """Ends of recorded spans that stop within the day before `start`."""
        return [r["end"] for r in self.covered() if timedelta(0) < start - r["end"] < timedelta(milliseconds=DAY_MS)]

    def covered_until(
        self, grain: str, start: datetime | str, fields: Sequence[str] = (), tie: Sequence[str] | None = None, dedup: bool | None = None
    ) -> datetime | None:
        """End of the recorded time that includes `start` without a gap and was built so, or None."""
        start, until = utc_time(start), None
        for row in sorted(self.covered(), key=lambda r: (r["start"], r["end"])):
            build = json.loads(row["build"])
            fits = set(fields) <= set(build["fields"]) and (dedup is None or build["dedup"] == dedup)
            fits &= tie is None or build["tie"] == list(tie)
            if fits and row["grain"] == grain and row["start"] <= (until or start) and start < row["end"]:
                until = max(until or start, row["end"])
        return until


def _batch(path: str) -> tuple[str, int]:
    stream, _, number = path.rsplit("batch=", 1)[1].rpartition("-")
    return stream, int(number)


def select_rows(table: DataFrame, grain: str, sensors=None, start=None, end=None, assets=None) -> DataFrame:
    """Partials of a stored table whose bucket starts in `[start, end)`; only the partitions of that time."""
    df = time_range(table, start, end, column="bucket", partition_floor=GRAINS[grain].period)
    return only_assets(only_sensors(df, sensors), assets).drop(PARTITION)


def _outside(rows: list[tuple], grains: Sequence[str], start: datetime, end: datetime, unless: str | None = None) -> list[tuple]:
    """The record without a span of some grains, but for the build named."""
    left = []
    for row in rows:
        grain, lower, upper, build, number = row
        if grain not in grains or build == unless or upper <= start or lower >= end:
            left.append(row)
            continue
        if lower < start:
            left.append((grain, lower, start, build, number))
        if upper > end:
            left.append((grain, end, upper, build, number))
    return left


def _merged_record(rows: list[tuple]) -> list[tuple]:
    """Touching spans of the same grain and build as one."""
    merged: list[list] = []
    for grain, build, number, start, end in sorted((r[0], r[3], r[4], r[1], r[2]) for r in rows):
        last = merged[-1] if merged else None
        if last and (last[0], last[3], last[4]) == (grain, build, number) and start <= last[2]:
            last[2] = max(last[2], end)
        else:
            merged.append([grain, start, end, build, number])
    return [tuple(row) for row in merged]


def rollup_view(partials: DataFrame) -> DataFrame:
    """Partials as mean, minimum and maximum columns: `<f>_mean`, `<f>_min`, `<f>_max`."""
    columns = [F.col("bucket").alias("time_bucket"), *series_keys(partials)]
    for field in partial_stats(partials):
        columns.append(statistic(partials, field, "avg").alias(f"{field}_mean"))
        columns += [F.col(f"`{field}_min`"), F.col(f"`{field}_max`")]
    return partials.select(*columns, F.col("first_ts").alias("timestamp_first"))


def extract_statistic(rollup: DataFrame, stat: str) -> DataFrame:
    """One of mean, min and max of a rollup view as readings named by field.

    Accepts any of the bucket column names; rows without a value in any field are dropped.
    """
    # The suffixes of a view's columns.
    suffix = f"_{'mean' if stat == 'avg' else stat}"
    if suffix not in ("_mean", "_min", "_max"):
        raise ValueError(f"a rollup view holds mean, min and max, not {stat!r}")
    bucket = next(name for name in BUCKET_NAMES if name in rollup.columns)
    fields = {
        name.removesuffix(suffix): F.col(f"`{name}`")
        for name in rollup.columns
        if name.endswith(suffix)
    }
    columns = [column.alias(field) for field, column in fields.items()]
    out = rollup.select(F.col(bucket).alias("timestamp"), *series_keys(rollup), *columns)
    return out.dropna(how="all", subset=list(fields))


def whole_days(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """A range widened to whole days, which every grain divides."""
    return floor_time(start, DAY_MS), ceil_time(end, DAY_MS)
