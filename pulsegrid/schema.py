"""The reading model: timestamp, the two series keys, and any number of numeric fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegrid.session import require_utc

TIMESTAMP = "timestamp"
SERIES_KEYS = ("sensor_name", "asset_id")
ASSET_ALIAS = "daqid"


def normalize(df: DataFrame) -> DataFrame:
    """Bring a frame to the reading model.

    `daqid` becomes `asset_id` where that is absent, `timestamp` becomes UTC without a zone, the
    keys become strings and NaN becomes NULL.
    """
    require_utc(df.sparkSession)
    if ASSET_ALIAS in df.columns and "asset_id" not in df.columns:
        df = df.withColumn("asset_id", F.col(ASSET_ALIAS))
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.name == TIMESTAMP:
            column = to_utc_ntz(column, field.dataType)
        elif field.name in SERIES_KEYS and not isinstance(field.dataType, T.StringType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = F.when(~F.isnan(column), column)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def to_utc_ntz(column: Column, data_type: T.DataType) -> Column:
    """UTC wall-clock value of a timestamp, date, ISO-8601 text or count of nanoseconds."""
    if isinstance(data_type, T.TimestampNTZType):
        return column
    if isinstance(data_type, T.LongType):
        # Decimal division, since a double cannot hold that many digits.
        column = F.timestamp_micros(F.floor(column / F.lit(1000).cast("decimal(4,0)")).cast("long"))
    elif isinstance(data_type, T.StringType):
        column = column.cast("timestamp")
    elif not isinstance(data_type, T.TimestampType):
        return column.cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))


def series_keys(df: DataFrame) -> list[str]:
    """Those of the series keys the frame has."""
    return [key for key in SERIES_KEYS if key in df.columns]


def numeric_fields(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns outside the key, in schema order. Booleans and intervals do not count."""
    skip = {TIMESTAMP, *SERIES_KEYS, ASSET_ALIAS, *exclude}
    return [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, T.NumericType) and field.name not in skip
    ]


def drop_null_keys(df: DataFrame) -> DataFrame:
    """Remove rows without a timestamp, sensor or asset: they belong to no bucket."""
    for key in (TIMESTAMP, *series_keys(df)):
        df = df.where(F.col(key).isNotNull())
    return df
