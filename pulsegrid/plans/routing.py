"""Which table answers a query: the readings or one of their rollups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.time import ceil_time, floor_time, millis_between
from pulsegrid.operators.filters import select_readings
from pulsegrid.operators.partials import (
    MOMENT,
    build_partials,
    keep_stats,
    merge_partials,
    partial_stats,
)
from pulsegrid.schema import TIMESTAMP, series_keys
from pulsegrid.sources.ledger import Span, merged, without
from pulsegrid.sources.rollups import GRAINS, RollupStore, select_rows

RAW = "raw"
NONE = "none"
# Longest duration in hours the readings and the minute rollup are preferred for.
RAW_MAX_HOURS = 24
MINUTE_MAX_HOURS = 168


def tier_by_duration(duration_hours: float) -> str:
    if duration_hours <= RAW_MAX_HOURS:
        return RAW
    return "1m" if duration_hours <= MINUTE_MAX_HOURS else "1h"


def tier_by_interval(interval_ms: int) -> str:
    """The coarsest grain that divides the bucket width."""
    fitting = [g for g in GRAINS.values() if interval_ms % g.interval_ms == 0]
    return max(fitting, key=lambda g: g.interval_ms).name if fitting else RAW


@dataclass(frozen=True)
class Request:
    """A validated query."""

    sensors: Sequence[str] | DataFrame
    start: datetime
    end: datetime
    assets: Sequence[str] | DataFrame | None
    interval_ms: int
    fields: Sequence[str]
    tie: Sequence[str]
    stats: Sequence[str]
    dedup: bool = False

    @property
    def recorded_fields(self) -> list[str]:
        """The fields as builds record them."""
        return [*self.fields, *(f"{field}_{MOMENT}" for field in self.fields if MOMENT in self.stats)]

    @property
    def duration_ms(self) -> float:
        return millis_between(self.start, self.end)


def tier_order(preferred: str) -> list[str]:
    """The preferred tier, then finer ones before coarser ones."""
    return [preferred, *[tier for tier in (RAW, *GRAINS) if tier != preferred]]


class IncompleteRange(ValueError):
    """Readings of a part of the range have gone and no stored rollup can answer for it exactly."""

    def __init__(self, gaps: Sequence[Span]):
        self.gaps = tuple(gaps)
        named = ", ".join(f"{start.isoformat()} to {end.isoformat()}" for start, end in self.gaps)
        super().__init__(f"readings and rollups leave gaps: {named}")


@dataclass(frozen=True)
class Answer:
    """Partials of the requested buckets, the tier they came from, and what of the range nothing could answer for."""

    partials: DataFrame
    tier: str
    uncovered: tuple[Span, ...] = ()


@dataclass(frozen=True)
class Candidate:
    """A rollup and the recorded parts of the range; those that may have changed at the source since; what nothing answers for."""

    grain: str
    table: DataFrame
    spans: list[Span]
    doubtful: list[Span]
    gaps: list[Span]

    @property
    def missing(self) -> float:
        return sum(millis_between(*gap) for gap in self.gaps)


def tiered_partials(
    raw: DataFrame | None,
    store: RollupStore | None,
    request: Request,
    preferred: str,
    allow_gaps: bool = False,
) -> Answer:
    """The requested buckets from the preferred tier, or another that can answer.

    A rollup is used where its grain divides the buckets, as far as it is recorded to be complete and was built as the request asks
    (fields, order of equal times, copies); what lies outside comes from the readings. Where the ledger cannot tell that the source
    is as it was at the build, both are bucketed, and each series and bucket is taken from the one with more readings: late
    ones are in the readings, expired ones in the rollup. Parts of the range where readings have gone without a rollup are an
    error, or named in the answer with `allow_gaps`.
    """
    # Copies do not make rows, so nothing is deduplicated for this.
    has_raw = raw is not None and not _select(raw, replace(request, dedup=False)).isEmpty()
    best: tuple[Candidate, str] | None = None
    for tier in tier_order(preferred):
        if tier != RAW:
            found = _candidate(raw, store, request, tier, from_start=has_raw)
        elif has_raw:
            found = _any_grain(raw, store, request)
            if found is None:
                return Answer(_from_raw(_select(raw, request), request), RAW)
        else:
            continue
        if found is not None and (best is None or found.missing < best[0].missing):
            best = found, tier
        if best is not None and not best[0].gaps:
            break
    if best is not None:
        found, tier = best
        if found.gaps and not allow_gaps:
            raise IncompleteRange(found.gaps)
        return Answer(_partials(raw, request, found, from_rollup=tier != RAW), tier, tuple(found.gaps))
    if raw is None:
        raise ValueError("no stored rollup can answer this query exactly")
    return Answer(_from_raw(_select(raw, request), request), NONE)


def _any_grain(raw: DataFrame, store: RollupStore | None, request: Request) -> Candidate | None:
    """The rollup that fills in best for readings that have gone: of those without gaps the coarsest."""
    fitting = [name for name, grain in GRAINS.items() if request.interval_ms % grain.interval_ms == 0]
    best = None
    for name in reversed(fitting):
        found = _candidate(raw, store, request, name)
        if found is not None and (best is None or found.missing < best.missing):
            best = found
        if best is not None and not best.gaps:
            break
    return best


def _candidate(raw: DataFrame | None, store: RollupStore | None, request: Request, name: str, from_start: bool = False) -> Candidate | None:
    """The recorded and stored parts of the range in a grain; with `from_start` they must reach back to the first whole bucket."""
    if store is None or request.interval_ms % GRAINS[name].interval_ms:
        return None
    start, end = _inner(name, request)
    recorded = store.spans(name, start, end, request.recorded_fields, request.tie, request.dedup)
    if not recorded or (from_start and recorded[0][0] > start):
        return None
    table = store.open(name)
    if table is None or not _holds(table, request):
        return None
    spans = merged((low, high) for low, high, _ in recorded)
    if all(select_rows(table, name, request.sensors, *span, request.assets).isEmpty() for span in spans):
        return None
    doubtful = [] if raw is None else store.ledger.doubtful(raw, recorded)
    width = GRAINS[name].interval_ms
    doubtful = merged((floor_time(low, width), ceil_time(high, width)) for low, high in doubtful)
    outside = without([(request.start, request.end)], spans)
    gaps = outside if raw is None else _gaps(raw, table, name, request, outside)
    return Candidate(name, table, spans, doubtful, gaps)


def _gaps(raw: DataFrame, table: DataFrame, name: str, request: Request, pieces: Sequence[Span]) -> list[Span]:
    """The pieces before the first reading that is left, if stored rows tell that there were earlier ones."""
    if not pieces or not select_readings(raw, request.sensors, None, pieces[0][0], request.assets).isEmpty():
        return []
    first = _select(raw, replace(request, dedup=False)).agg(F.min(TIMESTAMP)).first()[0]
    pieces = without(pieces, [(first, datetime.max)]) if first else list(pieces)
    reached = floor_time(first, GRAINS[name].interval_ms) if first else None
    rows = select_rows(table, name, request.sensors, None, reached, request.assets)
    return [] if not pieces or rows.isEmpty() else pieces


def _partials(raw: DataFrame | None, request: Request, found: Candidate, from_rollup: bool) -> DataFrame:
    """Partials of the range: trusted parts from the rollup if wanted, doubtful ones from both, the rest from the readings."""
    if not from_rollup and not found.doubtful:
        return _from_raw(_select(raw, request), request)
    trusted = without(found.spans, found.doubtful)
    width = GRAINS[found.grain].interval_ms

    def read(span: Span) -> DataFrame:
        rows = select_rows(found.table, found.grain, request.sensors, *span, request.assets)
        return keep_stats(rows, request.stats, request.fields)

    def fresh(span: Span) -> DataFrame:
        inside = replace(request, start=span[0], end=span[1], interval_ms=width)
        return _from_raw(_select(raw, inside), inside)

    parts = [_more_complete(read(span), fresh(span)) for span in found.doubtful]
    if from_rollup:
        parts += [read(span) for span in trusted]
    if raw is not None:
        parts += [fresh(span) for span in without([(request.start, request.end)], found.spans if from_rollup else found.doubtful)]
    return merge_partials(_joined(parts[0], parts[1:]), request.interval_ms)


def _more_complete(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each bucket of a series from the side that counts more readings in it; from the readings if both count the same."""
    keys = ["bucket", *series_keys(stored)]
    rest = [name for name in stored.columns if name not in keys]
    left = stored.select(*keys, F.struct(*[F.col(f"`{n}`") for n in rest]).alias("stored"))
    right = fresh.select(*keys, F.struct(*[F.col(f"`{n}`").cast(stored.schema[n].dataType).alias(n) for n in rest]).alias("fresh"))
    both = left.join(right, keys, "full")
    late = F.col("stored").isNull() | (F.col("fresh.n_rows") >= F.col("stored.n_rows"))
    chosen = both.select(*keys, F.when(late, F.col("fresh")).otherwise(F.col("stored")).alias("chosen"))
    return chosen.select(*keys, *[F.col(f"chosen.`{n}`").alias(n) for n in rest])


def _select(raw: DataFrame, request: Request) -> DataFrame:
    return select_readings(
        raw, request.sensors, request.start, request.end, request.assets, dedup=request.dedup
    )


def _from_raw(rows: DataFrame, request: Request) -> DataFrame:
    return build_partials(
        rows, request.interval_ms, fields=request.fields, tie=request.tie, stats=request.stats
    )


def _inner(tier: str, request: Request) -> tuple[datetime, datetime]:
    """The whole buckets of a grain within the range."""
    grain = GRAINS[tier].interval_ms
    return ceil_time(request.start, grain), floor_time(request.end, grain)


def _holds(table: DataFrame, request: Request) -> bool:
    held = partial_stats(table)
    return all(set(request.stats) <= set(held.get(field, ())) for field in request.fields)


def _joined(stored: DataFrame, edges: Iterable[DataFrame]) -> DataFrame:
    for edge in edges:
        stored = stored.unionByName(edge.select(*stored.columns))
    return stored
