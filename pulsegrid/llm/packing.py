"""Packing of documents into sequences of a fixed number of tokens by linear grouping and best fit.

Only lengths decide, and there are at most `capacity` of them, so the plan is made on their histogram, whose size
does not depend on the number of documents:

1. Pieces longer than `capacity * small` are large. Sorted by length they form groups of equal cardinality, and
   every length is rounded up to the longest of its group.
2. A linear program over the few group lengths finds how often each configuration (a multiset of groups
   that fits) is used; columns come from a knapsack over the duals. Its fractions are rounded down.
3. Actual pieces take the places of their group in order of length, and the last place of a configuration the longest
   piece that still fits. So a range of sequences holds pieces of the same actual lengths, and the plan stays a
   short list of ranges.
4. What is left over, large pieces first, goes by length to the open sequence with the least sufficient space, a range
   at a time; only what fits nowhere opens a sequence.

Spark numbers the pieces of each length and looks up the range of each number.
Null texts are empty documents, which hold the end id alone; repeated rows are documents of their own, of which
pieces keep together through a number that tells them apart. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm.common import Scratch, slices
from pulsegrid.llm.tokens import encoder

SLICE = 6 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, offsets = code.encode(part.column(1))
                rows = []
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    raw = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    total = len(raw) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        rows.append((doc_id, piece, start, length, crc))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return run


def group_lengths(counts: np.ndarray, smallest: int, groups: int) -> list[tuple[int, int]]:
    """(rounded length, number of pieces) of groups of about equal cardinality, longest first."""
    out, most, left = [], 0, int(counts[smallest:].sum())
    share = -(-left // groups) if left else 1
    held = 0
    for length in range(len(counts) - 1, smallest - 1, -1):
        n = int(counts[length])
        if not n:
            continue
        most = most or length
        held += n
        if held >= share:
            out.append((most, held))
            most = held = 0
    if held:
        out.append((most, held))
    return out


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[np.ndarray, float]]:
    """The linear program: (pieces of each group, times used) of configurations that hold all pieces.

    Revised simplex from one configuration per group; a knapsack over the duals gives the next column.
    """
    sizes = np.array([size for size, _ in groups])
    need = np.array([n for _, n in groups], float)
    k = len(sizes)
    if not k:
        return []
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * k):
        duals = np.linalg.solve(columns.T, np.ones(k))
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = np.where(sizes <= room, best[np.maximum(room - sizes, 0)] + duals, -1.0)
            top = int(fits.argmax())
            if fits[top] > best[room - 1]:
                best[room], choice[room] = fits[top], top
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if choice[room] < 0:
                room -= 1
                continue
            column[choice[room]] += 1
            room -= int(sizes[choice[room]])
        values, step = np.linalg.solve(columns, need), np.linalg.solve(columns, column)
        ratios = np.where(step > 1e-9, values / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratios.argmin())] = column
    values = np.linalg.solve(columns, need)
    return [(columns[:, i].astype(int), float(v)) for i, v in enumerate(values) if v > 1e-9]


class Plan:
    """Ranges: the pieces `first .. first + count - 1` of a length go to sequences from `sequence` on, at `offset`."""

    def __init__(self, histogram: dict[int, int], capacity: int, small: float = 0.25, groups: int = 48):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.counts[length] = n
        self.taken = np.zeros(capacity + 1, np.int64)
        self.ranges: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        # Open sequences by the space left: runs of (first sequence, how many).
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []
        self._large(max(1, int(capacity * small)), groups)
        self._best_fit()

    def _put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.ranges.append((length, int(self.taken[length]), count, sequence, offset))
        self.taken[length] += count

    def _free(self, space: int, first: int, count: int) -> None:
        if space not in self.open:
            bisect.insort(self.spaces, space)
        self.open.setdefault(space, []).append((first, count))

    def _large(self, smallest: int, groups: int) -> None:
        rounded = group_lengths(self.counts, smallest, groups)
        chosen = configurations(rounded, self.capacity)
        bounds = [size for size, _ in rounded] + [smallest - 1]
        for column, value in sorted(chosen, key=lambda c: -c[1]):
            times = int(value + 1e-6)
            self._fill([(g, int(n)) for g, n in enumerate(column) if n], times, bounds)

    def _fill(self, column: list[tuple[int, int]], times: int, bounds: list[int]) -> None:
        """`times` sequences of one configuration; each of its places takes the longest actual pieces left."""
        places = [g for g, n in column for _ in range(n)]
        # Runs of sequences whose pieces so far have the same lengths: (first, how many, used).
        runs = [(self.sequences, times, 0)] if times else []
        self.sequences += times
        for at, group in enumerate(places):
            filled = []
            for first, count, used in runs:
                # The last place takes the longest piece that fits, also one of a longer group.
                length = self.capacity - used if at == len(places) - 1 else bounds[group]
                while count:
                    while length > bounds[group + 1] and self.taken[length] >= self.counts[length]:
                        length -= 1
                    if length <= bounds[group + 1]:  # the group has no piece left
                        filled.append((first, count, used))
                        break
                    n = int(min(count, self.counts[length] - self.taken[length]))
                    self._put(length, n, first, used)
                    filled.append((first, n, used + length))
                    first, count = first + n, count - n
            runs = filled
        for first, count, used in runs:
            if self.capacity > used:
                self._free(self.capacity - used, first, count)

    def _best_fit(self) -> None:
        for length in range(self.capacity, 0, -1):
            while left := int(self.counts[length] - self.taken[length]):
                at = bisect.bisect_left(self.spaces, length)
                if at == len(self.spaces):
                    each = self.capacity // length
                    if left >= each:
                        count = left // each
                        for i in range(each):
                            self._put(length, count, self.sequences, i * length)
                        used = each * length
                    else:
                        count, used = 1, left * length
                        for i in range(left):
                            self._put(length, 1, self.sequences, i * length)
                    if used < self.capacity:
                        self._free(self.capacity - used, self.sequences, count)
                    self.sequences += count
                    continue
                space = self.spaces[at]
                first, count = self.open[space].pop()
                if not self.open[space]:
                    del self.open[space], self.spaces[at]
                n = min(count, left)
                self._put(length, n, first, self.capacity - space)
                if space > length:
                    self._free(space - length, first, n)
                if count > n:
                    self._free(space, first + n, count - n)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted by (length, first): keys, first numbers, sequences, offsets."""
        table = np.array(sorted(self.ranges), np.int64).reshape(-1, 5)
        return table[:, 0], table[:, 1], table[:, 3], table[:, 4]


def _place(arrays: tuple[np.ndarray, ...]) -> Callable:
    lengths, firsts, sequences, offsets = arrays
    shift = np.int64(40)  # pieces of one length are numbered below 2 ** 40
    keys = (lengths << shift) | firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            number = batch.column(batch.schema.get_field_index("number")).to_numpy()
            at = np.searchsorted(keys, (length << shift) | number, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [pa.array(sequences[at] + number - firsts[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return run


def number_within(df: DataFrame, key: str, order: list[str], buckets: int) -> DataFrame:
    """`number`: 0, 1, ... within each value of `key`, in an order fixed by `order`.

    A value of the key may hold most rows, so it is split into buckets; a bucket's first number is the sum of
    the buckets before it, from a table of one row per key and bucket.
    """
    split = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = split.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    sums = sums.select(key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(key, "bucket").orderBy(*order)
    numbered = split.withColumn("inside", F.row_number().over(inside))
    return numbered.join(sums, [key, "bucket"]).withColumn("number", F.col("before") + F.col("inside") - 1).drop(
        "bucket", "before", "inside"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, small: float = 0.25, groups: int = 48,
    buckets: int = 64,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver holds the histogram of lengths and the plan, whose sizes depend on `capacity` and `groups` alone.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.write(source.mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, capacity, small, groups)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    numbered = number_within(pieces, "length", order, buckets)
    return numbered.select(*PIECES_NAMES, "number").mapInArrow(
        _place(plan.arrays()), PIECES + ", sequence_id long, offset long"
    )


PIECES_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
