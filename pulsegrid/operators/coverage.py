"""How complete series are, and where they have gaps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.time import micros, ntz, utc_time
from pulsegrid.operators.filters import time_range
from pulsegrid.schema import TIMESTAMP, drop_null_keys, series_keys
from pulsegrid.session import materialize

CHUNK_WORDS = 4096


def observed_words(df: DataFrame, interval_ms: int) -> DataFrame:
    """Which buckets of each series hold readings, 64 in a row as the bits of one long.

    Buckets are numbered since the epoch. The bits are combined before the shuffle, so dense series
    move as a 64th of their buckets, and all of it is hash aggregation.
    """
    keys = series_keys(df)
    number = bucket_number(F.col(TIMESTAMP), interval_ms).alias("n")
    numbered = drop_null_keys(df).select(*keys, number)
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n").bitwiseAND(63).cast("int"))
    return numbered.groupBy(*keys, F.shiftright("n", 6).alias("word")).agg(
        F.bit_or(mark).alias("marks"), F.min("n").alias("first"), F.max("n").alias("last")
    )


def observed_counts(df: DataFrame, interval_ms: int) -> DataFrame:
    """Number of distinct buckets per series, with the number of the first and the last."""
    return observed_words(df, interval_ms).groupBy(*series_keys(df)).agg(
        F.sum(F.bit_count("marks")).alias("observed"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def coverage(
    df: DataFrame,
    interval_ms: int,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    *,
    series: DataFrame | None = None,
) -> DataFrame:
    """Observed and expected buckets per series and their ratio.

    Without a range, each series is measured between its own first and last bucket. With both ends of one, series
    that are silent in it have a row as well: those of `series`, a frame of keys, else all that `df` ever holds.
    """
    counts = observed_counts(time_range(df, start, end), interval_ms)
    if start is not None and end is not None:
        counts = all_series(df, series).join(counts, series_keys(df), "left").fillna(0, ["observed"])
    first, last = _grid_ends(interval_ms, start, end)
    expected = last - first + 1
    return counts.select(
        *series_keys(df),
        "observed",
        expected.alias("expected"),
        (F.col("observed") / expected).alias("coverage"),
    )


def all_series(df: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """The keys of a catalogue, or of all readings."""
    keys = series_keys(df)
    return drop_null_keys(df if series is None else series).select(*keys).distinct()


def missing_buckets(
    df: DataFrame,
    interval_ms: int,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    *,
    series: DataFrame | None = None,
) -> DataFrame:
    """The expected buckets of each series that hold no reading; series and range as in `coverage`.

    The expected time is laid out in words of 64 buckets and matched with the observed words on
    series and word; only words with a gap are taken apart. The grid unfolds in chunks of at most
    `CHUNK_WORDS`, so no row ever carries a whole series.
    """
    keys = series_keys(df)
    # Used twice below, and much smaller than the readings they come from.
    words = materialize(observed_words(time_range(df, start, end), interval_ms), "words")
    ends = words.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    if start is not None and end is not None:
        ends = all_series(df, series).join(ends, keys, "left")
    first, last = _grid_ends(interval_ms, start, end)
    spans = ends.select(*keys, first.alias("first"), last.alias("last"))
    last_word = F.shiftright("last", 6)
    step = F.lit(CHUNK_WORDS).cast("long")
    chunks = spans.withColumn(
        "chunk", F.explode(F.sequence(F.shiftright("first", 6), last_word, step))
    )
    stop = F.least(F.col("chunk") + step - 1, last_word)
    grid = chunks.withColumn("word", F.explode(F.sequence("chunk", stop))).drop("chunk")
    marked = grid.join(words.select(*keys, "word", "marks"), [*keys, "word"], "left")
    gaps = marked.where(F.coalesce(F.col("marks"), F.lit(0)) != -1)
    numbers = F.sequence(F.shiftleft("word", 6), F.shiftleft("word", 6) + 63)
    missing = F.filter(
        numbers,
        lambda n: n.between(F.col("first"), F.col("last"))
        & (_bit(F.coalesce(F.col("marks"), F.lit(0).cast("long")), n) == 0),
    )
    moment = F.timestamp_micros(F.col("number") * F.lit(interval_ms * 1000).cast("long"))
    return gaps.select(*keys, F.explode(missing).alias("number")).select(
        moment.cast("timestamp_ntz").alias(TIMESTAMP), *keys
    )


def _bit(word: Column, number: Column) -> Column:
    place = number.bitwiseAND(63).cast("int")
    return F.call_function("shiftright", word, place).bitwiseAND(1)


def bucket_number(moment: Column, interval_ms: int) -> Column:
    """Buckets since the epoch."""
    return F.floor(micros(moment) / F.lit(interval_ms * 1000))


def _last_moment(end: datetime | str) -> Column:
    """The end is exclusive: its own bucket counts only if some of it lies before the end."""
    return ntz(utc_time(end) - datetime.resolution)


def _grid_ends(
    interval_ms: int, start: datetime | str | None, end: datetime | str | None
) -> tuple[Column, Column]:
    first, last = F.col("first"), F.col("last")
    if start is not None:
        first = bucket_number(ntz(start), interval_ms)
    if end is not None:
        last = bucket_number(_last_moment(end), interval_ms)
    return first, last
