"""Equi-join of many rows with a lookup table whose size is not known in advance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import materialize

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 64


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join `rows` with `lookup`, which has one row per key.

    The lookup is written once and measured. Up to `broadcast_bytes` of text it is broadcast and
    the rows do not move. Beyond that both sides shuffle, with every key split over `SALTS` parts
    so that no single key fills a task; copies of one row, which a hash cannot part, are left to
    the skew handling of AQE.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    stored = materialize(lookup, "lookup")
    if text_bytes(stored) <= broadcast_bytes:
        return rows.join(F.broadcast(stored), list(keys), how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in rows.columns]), F.lit(SALTS))
    salted = rows.withColumn("lookup_salt", salt.cast("int"))
    copies = stored.withColumn("lookup_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "lookup_salt"], how).drop("lookup_salt")


def text_bytes(df: DataFrame) -> int:
    """Size of all rows as JSON text, names included: an upper estimate of their values."""
    size = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return df.agg(F.sum(size)).first()[0] or 0
