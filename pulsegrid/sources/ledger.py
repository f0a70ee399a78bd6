"""What a rollup was built from: the files of the source and the days in them, so that later changes are noticed.

A table of readings changes when files come, go or are rewritten. The ledger holds path, time of change and length of every
file that a build read, with the first and last day in it, and the definition of the frame on top of the files. A span of a build is
trusted where all of that is as it was; finding out reads file listings only, and the time column of files never seen before. The
lists have one entry per file, like the listing that the driver holds for any scan.
"""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.schema import TIMESTAMP, normalize

Span = tuple[datetime, datetime]
File = tuple[str, int, int]
Days = tuple[date | None, date | None]
LEDGER = "number long, plan string, path string, modified long, length long, first_day date, last_day date"


@dataclass(frozen=True)
class SourceState:
    """Definition and files (path, microsecond of change, length) of a source; no files where they cannot be known."""

    plan: str
    files: frozenset[File] | None


def source_state(raw: DataFrame) -> SourceState:
    """The state of a frame; its files are known if it is rows of one table of files, filtered or projected."""
    plan = definition(raw)
    lines = plan.splitlines()
    if any(":- " in line for line in lines) or not re.search(r"^\W*Relation\b", lines[-1]):
        return SourceState(plan, None)
    try:
        raw.select("_metadata.file_path")
        paths = raw.inputFiles()
        return SourceState(plan, _listed(raw.sparkSession, paths) if paths else frozenset())
    except AnalysisException:
        return SourceState(plan, None)


def definition(raw: DataFrame) -> str:
    """The analyzed plan without the numbers that differ from one session to the next."""
    spark, limit = raw.sparkSession, "spark.sql.debug.maxToStringFields"
    before, text = spark.conf.get(limit), io.StringIO()
    spark.conf.set(limit, "100000")
    try:
        with contextlib.redirect_stdout(text):
            raw.explain("extended")
    finally:
        spark.conf.set(limit, before)
    analyzed = text.getvalue().split("== Analyzed Logical Plan ==\n")[1].split("\n== Optimized")[0]
    return re.sub(r"#\d+L?", "", analyzed).strip()


def _listed(spark: SparkSession, paths: Sequence[str]) -> frozenset[File]:
    """Listed by Spark, in tasks where there are many; contents are not read."""
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(path)) for path in paths]
    files = spark.read.format("binaryFile").load(literal)
    rows = files.select("path", F.unix_micros("modificationTime"), "length").collect()
    return frozenset((canonical(path), modified, length) for path, modified, length in rows)


def canonical(path: str) -> str:
    return re.sub(r"^file:/+", "file:/", unquote(path))


def days_of_files(raw: DataFrame, files: Iterable[File]) -> dict[str, Days]:
    """First and last day of the readings in each of the files; nothing else is read."""
    names = {path for path, _, _ in files}
    if not names:
        return {}
    spelled = [p for p in raw.inputFiles() if canonical(p) in names]
    spellings = {s for p in spelled for s in (p, unquote(p), re.sub("^file:/+", "file:/", p), canonical(p), re.sub("^file:/+", "file:///", p))}
    named = raw.select(F.col("_metadata.file_path").alias("path"), TIMESTAMP).where(F.col("path").isin(sorted(spellings)))
    ends = normalize(named).groupBy("path").agg(F.to_date(F.min(TIMESTAMP)).alias("low"), F.to_date(F.max(TIMESTAMP)).alias("high"))
    found = {canonical(r["path"]): (r["low"], r["high"]) for r in ends.collect()}
    return {name: found.get(name, (None, None)) for name in names}


class Ledger:
    """The entries of one store, appended by each build."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def rows(self) -> list:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path).collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def append(self, raw: DataFrame, state: SourceState, number: int, start: datetime | None, end: datetime | None) -> None:
        """Enter the files of a build that hold days of its span."""
        known = {(r["path"], r["modified"], r["length"]): (r["first_day"], r["last_day"]) for r in self.rows()}
        days = days_of_files(raw, state.files - known.keys())
        rows = []
        for file in state.files:
            low, high = known[file] if file in known else days[file[0]]
            inside = low is None or ((end is None or _begin(low) < end) and (start is None or start < _after(high)))
            if inside:
                rows.append((number, state.plan, *file, low, high))
        # A source without files has an entry of its own.
        rows = rows or [(number, state.plan, None, None, None, None, None)]
        self.write(rows)

    def write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(self.path)

    def doubtful(self, raw: DataFrame, spans: Sequence[tuple[datetime, datetime, int]]) -> list[Span]:
        """The parts of recorded spans (start, end, number of the build) whose readings may have changed since."""
        if not spans:
            return []
        state = source_state(raw)
        if state.files is None:
            return merged((start, end) for start, end, _ in spans)
        rows = self.rows()
        held: dict[int, set[File]] = {}
        plans = {r["number"]: r["plan"] for r in rows}
        days: dict[File, Days] = {}
        for r in rows:
            own = held.setdefault(r["number"], set())
            if r["path"] is not None:
                own.add((r["path"], r["modified"], r["length"]))
                days[r["path"], r["modified"], r["length"]] = r["first_day"], r["last_day"]
        fresh = state.files - days.keys()
        ends = days_of_files(raw, fresh)
        days |= {file: ends[file[0]] for file in fresh}
        out = []
        for start, end, number in spans:
            if plans.get(number) != state.plan:
                out.append((start, end))
                continue
            for file in held[number] ^ state.files:
                low, high = days[file]
                if low is not None and _begin(low) < end and start < _after(high):
                    out.append((max(start, _begin(low)), min(end, _after(high))))
        return merged(out)


def _begin(day: date) -> datetime:
    return datetime.combine(day, time())


def _after(day: date) -> datetime:
    return _begin(day) + timedelta(days=1)


def merged(spans: Iterable[Span]) -> list[Span]:
    """Spans in order, those that touch as one."""
    out: list[Span] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        elif start < end:
            out.append((start, end))
    return out


def without(spans: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """What is left of spans when others are taken out."""
    left = merged(spans)
    for low, high in taken:
        left = [piece for start, end in left for piece in ((start, min(end, low)), (max(start, high), end)) if piece[0] < piece[1]]
    return left
