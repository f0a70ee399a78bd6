"""Exact positions in a total order, and rows at even distances in it, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pulsegrid.functions.time import micros
from pulsegrid.schema import TIMESTAMP, series_keys
from pulsegrid.session import materialize

_ROW_BITS = 33
_COPIES = "row_copies"


def with_position(
    df: DataFrame, order_by: Sequence[str], copies: str | None = None
) -> DataFrame:
    """Add `row_position`, the 0-based rank in the order of `order_by`, and `row_total`.

    With `copies`, a row stands for that many equal ones and its position is that of the first.

    Rows are range-partitioned on the whole ordering key and, within equal keys, on a hash of the
    row, so that neither a timestamp nor a key that holds a third of all rows fills one task. They
    are written once, because a second evaluation may cut the ranges elsewhere. Then only the size
    of each range is summed up and sent to the tasks.
    """
    spread = F.xxhash64(*[F.col(f"`{name}`") for name in df.columns])
    order = [*[F.col(f"`{name}`") for name in order_by], spread]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Within a partition the generated id counts rows in their sorted order.
    generated = F.monotonically_increasing_id()
    stored = materialize(ranged.withColumn("row_generated", generated), "position")
    rows = stored.withColumn("row_slice", F.shiftright("row_generated", _ROW_BITS))
    size = F.count(F.lit(1)) if copies is None else F.sum(copies)
    # One row per partition of the range shuffle, so both the window and the broadcast are small.
    sizes = rows.groupBy("row_slice").agg(size.alias("row_size"))
    offsets = sizes.select(
        "row_slice",
        _sum_before("row_size", Window.orderBy("row_slice")).alias("row_before"),
        F.sum("row_size").over(Window.partitionBy()).alias("row_total"),
    )
    if copies is None:
        inside = F.col("row_generated") - F.shiftleft(F.col("row_slice"), _ROW_BITS)
    else:
        # The ranges are of like size, whatever the keys.
        inside = _sum_before(copies, Window.partitionBy("row_slice").orderBy("row_generated"))
    placed = rows.withColumn("row_inside", inside).join(F.broadcast(offsets), "row_slice")
    return placed.withColumn("row_position", F.col("row_before") + F.col("row_inside")).select(
        *df.columns, "row_position", "row_total"
    )


def _sum_before(column: str, order) -> Column:
    frame = order.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(frame), F.lit(0))


def stride_sample(
    df: DataFrame,
    max_points: int,
    order_by: Sequence[str] | None = None,
    *,
    distinct_rows: bool = False,
) -> DataFrame:
    """`max_points` rows at even distances from the first on; all rows when they fit.

    Of n rows those at the positions floor(k * n / max_points) are kept, so the last one lies in the last stride.
    Without `order_by` the order is that of time and series.

    Nothing is sorted as a whole. The leading column is cut into slices, many more than there are points, and their rows are
    counted; the sums of earlier slices say which hold a chosen position, and only rows of these move and are ranked. A
    slice much larger than others is cut again, by the next columns where one value fills it, and last by a hash of the row; what is
    left then are copies of rows, which are counted. `distinct_rows` says that there are none, as after any bucketing; it changes
    no result. The slices that are hit, a row each, pass the driver: at most `max_points`.
    """
    sampling = _Sampling(df, max_points, list(order_by or (TIMESTAMP, *series_keys(df))))
    return sampling.pick(df.select("*", F.lit(0).cast("long").alias("row_group"), F.lit(0).cast("long").alias("row_before")), 0)


# Slices to a point, the most slices, and rows that one task ranks at least.
SLICES_TO_A_POINT = 16
MOST_SLICES = 1 << 20
RANKED_ROWS = 1 << 20


class _Sampling:
    def __init__(self, df: DataFrame, points: int, order_by: list[str]):
        self.df = df
        self.points = points
        self.total: int | None = None
        self.slices = min(MOST_SLICES, max(1 << 10, SLICES_TO_A_POINT * points))
        spread = F.xxhash64(*[F.col(f"`{name}`") for name in df.columns])
        self.order = [*[F.col(f"`{name}`") for name in order_by], spread]
        # Each with the column that it is the last digit of, if any.
        self.digits: list[tuple[Column, Column | None]] = []
        for column, digits in [*((F.col(f"`{name}`"), _digits(df, name)) for name in order_by), (spread, [spread.cast("double")])]:
            self.digits += [(digit, column if digit is digits[-1] else None) for digit in digits]

    def pick(self, rows: DataFrame, level: int) -> DataFrame:
        """The chosen ones among rows of some groups; `row_before` rows come before a group. Groups agree in the digits before `level`."""
        if level == len(self.digits):
            return self._copies(rows)
        spark, (x, column) = rows.sparkSession, self.digits[level]
        inf = float("inf")
        finite = F.when((x > -inf) & (x < inf), x)
        bounds = rows.groupBy("row_group").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("row_low"), F.max(finite).alias("row_high")).collect()
        if self.total is None:
            self.total = sum(r["n"] for r in bounds)
            if self.total <= self.points:
                return self.df
            if self.total <= RANKED_ROWS:
                return self._ranked(rows)
        limits = spark.createDataFrame([(r[0], r[2], r[3]) for r in bounds], "row_group long, row_low double, row_high double")
        share = F.coalesce((x - F.col("row_low")) / F.nullif(F.col("row_high") - F.col("row_low"), F.lit(0.0)), F.lit(0.0))
        number = (
            F.when(x.isNull(), 0).when(x == -inf, 1).when(F.isnan(x), 4 + self.slices).when(x == inf, 3 + self.slices)
            .otherwise(2 + F.floor(share * self.slices))
        )
        numbered = rows.join(F.broadcast(limits), "row_group").withColumn("row_slice", number.cast("long")).drop("row_low", "row_high")

        size = F.count(F.lit(1))
        # Whether the next column may tell rows apart: this one does not, not even beyond its digits.
        same = F.lit(True) if column is None else F.min(column).eqNullSafe(F.max(column)) & F.count(column).isin(F.lit(0), size)
        sizes = numbered.groupBy("row_group", "row_before", "row_slice").agg(size.alias("row_size"), same.alias("row_same"))
        group = Window.partitionBy("row_group")  # of slices, not of rows
        before = (F.col("row_before") + _sum_before("row_size", group.orderBy("row_slice"))).alias("before")
        placed = sizes.select("row_group", "row_slice", "row_size", "row_same", before, F.count(F.lit(1)).over(group).alias("row_slices"))
        hits = placed.where(self._strides("before + row_size") > self._strides("before")).collect()
        most = max(RANKED_ROWS, 8 * self.total // self.slices)
        large = [h for h in hits if h["row_size"] > most]
        again = [h for h in large if h["row_slices"] > 1]
        further = [h for h in large if h["row_slices"] == 1 and h["row_same"]]
        ranked = [h for h in hits if h["row_size"] <= most or (h["row_slices"] == 1 and not h["row_same"])]
        parts = [self._ranked(self._within(numbered, ranked))] if ranked else []
        parts += [self.pick(self._within(numbered, some), at) for some, at in ((again, level), (further, level + 1)) if some]
        return reduce(DataFrame.unionByName, parts)

    def _within(self, numbered: DataFrame, hits: list) -> DataFrame:
        """Rows of the given slices, each a group of its own; `row_before` counts the rows before it."""
        listed = [(h["row_group"], h["row_slice"], h["before"], i) for i, h in enumerate(hits)]
        table = numbered.sparkSession.createDataFrame(listed, "row_group long, row_slice long, row_start long, row_number long")
        rows = numbered.drop("row_before").join(F.broadcast(table), ["row_group", "row_slice"]).withColumnRenamed("row_start", "row_before")
        return rows.drop("row_group", "row_slice").withColumnRenamed("row_number", "row_group")

    def _ranked(self, rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("row_group").orderBy(*self.order))
        placed = rows.withColumn("row_position", F.col("row_before") + rank - 1)
        chosen = self._strides("row_position + 1") > self._strides("row_position")
        return placed.where(chosen).select(*self._columns())

    def _copies(self, rows: DataFrame) -> DataFrame:
        """Copies are counted and placed together."""
        counted = rows.groupBy(*self._columns(), "row_group", "row_before").agg(F.count(F.lit(1)).alias(_COPIES))
        inside = _sum_before(_COPIES, Window.partitionBy("row_group").orderBy(*self.order))
        placed = counted.withColumn("row_position", F.col("row_before") + inside)
        begin, end = self._strides("row_position"), self._strides(f"row_position + {_COPIES}")
        chosen = placed.withColumn("row_begin", begin).withColumn("row_end", end).where("row_begin < row_end")
        return chosen.withColumn("row_hit", F.explode(F.sequence("row_begin", F.col("row_end") - 1))).select(*self._columns())

    def _columns(self) -> list[Column]:
        return [F.col(f"`{name}`") for name in self.df.columns]

    def _strides(self, position: str) -> Column:
        """How many strides begin before a position."""
        share = F.expr(position).cast("decimal(19,0)") * F.lit(self.points).cast("decimal(19,0)")
        return F.ceil(share / F.lit(self.total).cast("decimal(19,0)")).cast("long")


def _digits(df: DataFrame, name: str) -> list[Column]:
    """Numbers in the order of a column: equal or rising where the column rises. Text gives its bytes, six at a time.

    They only cut slices. Where text beyond 30 bytes, or digits that a double cannot hold, still tell rows of a large slice apart,
    one task ranks that slice.
    """
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return [micros(column).cast("double")]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = column.cast("double")
        return [F.signum(x) * F.log1p(F.abs(x)), x]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = column.cast("binary")
        piece = lambda at: F.conv(F.rpad(F.hex(F.substring(raw, at, 6)), 12, "0"), 16, 10).cast("double")
        return [piece(at) for at in range(1, 31, 6)]
    return [column.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else F.lit(0.0)]
