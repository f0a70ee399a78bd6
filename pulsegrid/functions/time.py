"""Timestamps: request times, bucket floors, ordering keys and ISO-8601 text."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone
from math import prod

from pyspark.sql import Column, DataFrame, functions as F, types as T

EPOCH = datetime(1970, 1, 1)


def utc_time(value: datetime | date | str) -> datetime:
    """A request time as UTC without a zone. Text is ISO-8601; no zone means UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    elif not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def ntz(value: datetime | date | str) -> Column:
    """Literal of type TIMESTAMP_NTZ; a constant, so comparisons with it are pushed down."""
    return F.lit(utc_time(value).isoformat(sep=" ")).cast("timestamp_ntz")


def floor_time(value: datetime, interval_ms: int) -> datetime:
    step = timedelta(milliseconds=interval_ms)
    return value - (value - EPOCH) % step


def ceil_time(value: datetime, interval_ms: int) -> datetime:
    floored = floor_time(value, interval_ms)
    return floored if floored == value else floored + timedelta(milliseconds=interval_ms)


def millis_between(start: datetime, end: datetime) -> float:
    return (end - start) / timedelta(milliseconds=1)


def bucket_start(timestamp: Column | str, interval_ms: int) -> Column:
    """Floor to multiples of the interval since the Unix epoch."""
    return F.window(timestamp, f"{int(interval_ms)} milliseconds")["start"]


def bucket_start_by(timestamp: Column, interval_ms: Column) -> Column:
    """The same floor with an interval per row. Needs a UTC session."""
    millis = F.unix_millis(timestamp.cast("timestamp"))
    return F.timestamp_millis(millis - F.pmod(millis, interval_ms)).cast("timestamp_ntz")


def micros(timestamp: Column) -> Column:
    """Microseconds since the epoch. Needs a UTC session."""
    return F.unix_micros(timestamp.cast("timestamp"))


def span_millis(first: Column, last: Column) -> Column:
    """Milliseconds from `first` to `last`, with fraction."""
    return (micros(last) - micros(first)) / F.lit(1000)


# One timestamp step is 10^20, above any shifted 64-bit tie; the shift is 2^63.
_STEP = "100000000000000000000"
_SHIFT = "9223372036854775808"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PACKED = "__packed_tie"


def order_key(df: DataFrame, tie: Sequence[str] = ()) -> Column:
    """Total order of readings: time first, then the tie columns.

    One integer tie is packed with the time into a decimal(38,0). Aggregation buffers hold that in
    place, so min_by/max_by over it run as hash aggregates; a struct would force sorts. Other ties
    use a struct.
    """
    moment = micros(F.col("timestamp"))
    if not tie:
        return moment
    if len(tie) == 1 and isinstance(df.schema[tie[0]].dataType, _INTEGRAL):
        packed = (
            moment.cast("decimal(18,0)") * F.lit(_STEP).cast("decimal(21,0)")
            + F.coalesce(F.col(tie[0]), F.lit(0)).cast("decimal(20,0)")
            + F.lit(_SHIFT).cast("decimal(20,0)")
        )
        return packed.cast("decimal(38,0)")
    return F.struct(moment.alias("moment"), *[F.col(name) for name in tie])


def pack_ties(df: DataFrame, tie: Sequence[str]) -> tuple[DataFrame, Sequence[str]]:
    """The readings with several integer ties as one column, and its name in a list.

    One aggregate of two numbers a tie measures their ranges; a tie takes as many values as its range is wide, and NULL, which comes
    first. Where the product of these widths goes beyond 63 bits, or a tie is no integer, all stays as it is. The packed numbers
    belong to these readings alone, so they must not be stored.
    """
    if len(tie) < 2 or not all(isinstance(df.schema[name].dataType, _INTEGRAL) for name in tie):
        return df, tie
    bounds = [end(F.col(f"`{name}`")).cast("long") for name in tie for end in (F.min, F.max)]
    found = df.agg(*[bound.alias(str(i)) for i, bound in enumerate(bounds)]).first()
    lows = [low or 0 for low in found[::2]]
    widths = [(high or 0) - low + 2 for low, high in zip(lows, found[1::2])]
    if prod(widths) >= 1 << 63:
        return df, tie
    packed = F.lit(0).cast("long")
    for name, low, width in zip(tie, lows, widths):
        packed = packed * F.lit(width) + F.coalesce(F.col(f"`{name}`").cast("long") - F.lit(low) + 1, F.lit(0))
    return df.withColumn(_PACKED, packed), [_PACKED]


def iso8601(timestamp: Column) -> Column:
    """ISO-8601 text with microseconds only where there are any."""
    fraction = F.date_format(timestamp, "SSSSSS")
    text = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(fraction == "000000", text).otherwise(F.concat(text, F.lit("."), fraction))


def json_records(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Each row as one JSON object, its timestamp in ISO-8601. Missing values are null."""
    columns = [
        iso8601(F.col(name)).alias(name) if name == timestamp else F.col(f"`{name}`")
        for name in df.columns
    ]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record"))
