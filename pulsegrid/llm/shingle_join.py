"""Exact n-gram Jaccard self join of documents, by relations between sets.

A document is the set of its word n-grams. Equal sets are one class from the start. Then:

1. Order. A sketch of fixed size counts n-grams over all documents; rare ones come first in every set. The sketch only
   decides the order, so its error costs time and never a link.
2. Relations. Sets that share a min-hash are compared with one of them, the leader. A set that links with a leader
   inherits its component, and with it the answers of all sets found that way.
3. Index. Sets are listed under the n-grams of their prefix, of which similar sets share one, in order of size. Of a list only
   pairs of different components count; sizes and positions in the prefix leave few rows, and only these get bitmaps of the parity
   of hashes, which bound the difference of two sets from below. The largest component of a long list is passed over as a block.
4. Each set that has such a pair is compared with its nearest one by bitmaps, a pair per set and task, and links join components; this
   goes on for `ROUNDS` rounds while it finds links.
5. All pairs of different components that are left then are compared exactly inside their lists, whose rows that still have such a
   pair bring their sets along. A task gives no pairs away but links that join components, fewer than it has sets. So rounds save
   work and decide nothing.

So a group of thousands of near copies moves rows per member, not per pair, and no link is lost.

Null texts and texts without words are empty sets, linked with nothing. Repeated rows are equal sets. A null doc_id takes part
in links; if a component has null ids only, its id is null. Other columns are not used. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.common import Scratch, free_shuffles, ragged, release_held, slices
from pulsegrid.llm.components import connected_components
from pulsegrid.llm.words import SOLID, find_words, hash_words, joined, mixed

SLICE = 4 << 20
SEGMENT = 1 << 16
MIN_HASHES = 8
_SALTS = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_MEMBERS = "doc_id long, sid long, n long, low array<long>, bits binary, segment int, counts binary"


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct n-grams of each text; of a text with fewer words, of all its words."""
    raw, bounds = joined(texts)
    starts, ends = find_words(raw, SOLID)
    words = hash_words(raw, starts, ends)
    first = np.searchsorted(starts, bounds)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        grams = grams * np.uint64(0xD1342543DE82EF95) + words[i : i + len(grams)]
    grams = mixed(grams)
    out = []
    for begin, end in zip(first[:-1], first[1:]):
        if end - begin >= size:
            out.append(np.unique(grams[begin : end - size + 1]))
        elif end > begin:
            whole = np.full(1, end - begin, np.uint64)
            for word in words[begin:end]:
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + word
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(doc_id, id of the set, its digest, the set) of every row."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            for doc_id, values in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), size)):
                full = xxhash.xxh3_128_digest(values.tobytes())
                yield doc_id, int.from_bytes(full[:8], "little", signed=True), full, values


def parity(values: np.ndarray) -> bytes:
    """A bitmap of two bits or more for each element: whether an odd number of them falls on each."""
    width = 64
    while width < 2 * len(values):
        width *= 2
    odd = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_distance(a: bytes, n: int, b: bytes, m: int) -> float:
    """A lower bound of the Jaccard distance: sets differ in at least as many elements as their bitmaps do."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        # The lowest bits number the cells, so a narrower bitmap is the sum of the halves.
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    odd = max(abs(n - m), int(np.bitwise_count(x ^ y).sum()))
    return 2 * odd / (n + m + odd)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) with the lower bound of their distance."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("x", "nx", "y", "ny")))
        low = [least_distance(*row) for row in rows]
        rest = [c for c in batch.schema.names if c not in ("x", "nx", "y", "ny")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(low, pa.float64())], [*rest, "low"]
        )


def _gathered(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _members(size: int, bits: int) -> Callable:
    """Of every document its set and min-hashes; at the end, in rows of their own, the task's counts of n-grams."""
    pack = lambda data: zstandard.ZstdCompressor(level=1).compress(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        counts = np.zeros(1 << bits, np.uint32)

        def rows():
            for doc_id, sid, _, values in _sets(batches, size):
                counts[(values >> np.uint64(64 - bits)).astype(np.int64)] += 1
                low = [int(mixed(values ^ s).min() >> np.uint64(1)) for s in _SALTS[:MIN_HASHES]] if len(values) else []
                yield doc_id, sid, len(values), low, parity(values), None, None
            for number, part in enumerate(counts.reshape(-1, SEGMENT)):
                if part.any():
                    yield None, None, None, None, None, number, pack(part.tobytes())

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
        yield from _gathered(rows(), ["doc_id", "sid", "n", "low", "bits", "segment", "counts"], kinds)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the segments of a partition, as they come, in steps of powers of two."""
    sums: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(unpack.decompress(data), np.uint32)
            sums[number] = sums[number] + part if number in sums else part.astype(np.int64)
    for number, total in sums.items():
        steps = np.floor(np.log2(total + 1)).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([steps], pa.binary())], ["segment", "counts"])


def frequency_steps(parts: DataFrame, bits: int) -> np.ndarray:
    """The logarithm of how many documents hold the n-grams of each of 2 ** bits cells; one byte a cell."""
    sums = parts.repartition("segment").mapInArrow(_add, "segment int, counts binary")
    steps = np.zeros(1 << bits, np.uint8)
    for number, data in sums.toLocalIterator():
        steps[number * SEGMENT : (number + 1) * SEGMENT] = np.frombuffer(bytes(data), np.uint8)
    return steps


def prefix_length(n: int, percent: int) -> int:
    """So many of the first elements of a set, in any common order, hold one of each similar set's."""
    return n - -(-percent * n // 100) + 1


def _prefixes(size: int, bits: int, percent: int, steps) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = steps.value
        seen: set[bytes] = set()
        held = []
        for _, sid, full, values in _sets(batches, size):
            n = len(values)
            if not n or full in seen:
                continue
            seen.add(full)
            if len(seen) > 1 << 18:
                seen.clear()
            level = table[(values >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.argsort(level, kind="stable")[: prefix_length(n, percent)]
            held.append((values[order].view(np.int64), sid, n))
            if len(held) >= 500:
                yield _prefix_rows(held)
                held = []
        if held:
            yield _prefix_rows(held)

    return run


def _prefix_rows(held: list[tuple]) -> pa.RecordBatch:
    lengths = np.array([len(h[0]) for h in held])
    tops = np.cumsum(lengths)
    position = np.arange(tops[-1]) - np.repeat(tops - lengths, lengths)
    sids, sizes = np.array([h[1] for h in held]), np.array([h[2] for h in held])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h[0] for h in held])), pa.array(np.repeat(sids, lengths)),
            pa.array(np.repeat(sizes, lengths).astype(np.int32)), pa.array(position.astype(np.int32)),
        ],
        ["gram", "sid", "n", "place"],
    )


# Sets wanted for a comparison: a Bloom filter of fixed size; what passes by chance is dropped by the join.
def _bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits set by two hashes of each (sid, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            for at in _bloom_places(own_keys(batch.column(0), batch.column(1)), bits):
                np.bitwise_or.at(held, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        pack = zstandard.ZstdCompressor(level=1)
        for number, part in enumerate(held.reshape(-1, SEGMENT)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())], ["segment", "bits"]
                )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        either: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(unpack.decompress(data), np.uint8)
                either[number] = either[number] | part if number in either else part
        for number, part in either.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["segment", "bits"])

    parts = keys.select("sid", "doc").mapInArrow(run, "segment int, bits binary").repartition("segment")
    out = np.zeros(1 << bits >> 3, np.uint8)
    for number, data in parts.mapInArrow(join, "segment int, bits binary").toLocalIterator():
        out[number * SEGMENT : (number + 1) * SEGMENT] = np.frombuffer(bytes(data), np.uint8)
    return out


def _bloom_places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    one, two = mixed(values), mixed(values ^ np.uint64(0x5851F42D4C957F2D))
    return [(v >> np.uint64(64 - bits)).astype(np.int64) for v in (one, two)]


def own_keys(sids: pa.Array, docs: pa.Array) -> np.ndarray:
    """One number for a set and the document that stands for it; -1 where that has no id."""
    sid = sids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    doc = docs.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mixed(sid ^ doc * np.uint64(0x9E3779B97F4A7C15))


def _wanted(size: int, bits: int, bloom) -> Callable:
    """The sets of documents that stand for a wanted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bloom.value

        def rows():
            for doc_id, sid, _, values in _sets(batches, size):
                if not len(values):
                    continue
                key = own_keys(pa.array([sid], pa.int64()), pa.array([doc_id], pa.int64()))
                if all(table[at[0] >> 3] >> (7 - (at[0] & 7)) & 1 for at in _bloom_places(key, bits)):
                    yield sid, values.tobytes()

        yield from _gathered(rows(), ["sid", "grams"], [pa.int64(), pa.binary()], 500)

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [batch.column(i).to_pylist() for i in range(4)]
        shared, unions = [], []
        for a, b in zip(rows[2], rows[3]):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            shared.append(common)
            unions.append(len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(unions, pa.int64())], ["a", "b", "shared", "whole"]
        )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of n-grams that stand in the prefix of several sets, once for a set; rows come in order of n-gram and set."""
    carried = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        carried = table if carried is None else pa.concat_tables([carried, table])
        gram = carried.column(0).to_numpy()
        last = int(np.searchsorted(gram, gram[-1]))  # the last n-gram may go on in the next batch
        if last:
            yield from _several(carried.slice(0, last))
            carried = carried.slice(last)
    if carried is not None:
        yield from _several(carried)


def _several(table: pa.Table) -> Iterator[pa.RecordBatch]:
    gram, sid = table.column(0).to_numpy(), table.column(1).to_numpy()
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])
    table = table.filter(pa.array(first))
    gram = gram[first]
    same = gram[1:] == gram[:-1]
    keep = np.zeros(len(gram), bool)
    keep[1:] |= same
    keep[:-1] |= same
    yield from table.filter(pa.array(keep)).to_batches()


class Listed:
    """The sets of one list, in order of size, with their components and bitmaps."""

    def __init__(self, rows: pa.Table):
        col = lambda name: rows.column(name).to_numpy()
        order = np.argsort(col("n"), kind="stable")
        self.sid, self.group = col("sid")[order], col("group")[order]
        self.n, self.place = col("n")[order].astype(np.int64), col("place")[order].astype(np.int64)
        bits = rows.column("bits").take(pa.array(order)).to_pylist()
        self.width = np.array([len(b) for b in bits])
        # Bitmaps of one width together; a set's place among them.
        self.maps, self.at = {}, np.zeros(len(order), np.int64)
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.maps[width] = np.frombuffer(b"".join(bits[i] for i in own), np.uint8).reshape(len(own), width)
            self.at[own] = np.arange(len(own))

    def _differ(self, i: int, others: np.ndarray) -> np.ndarray:
        """In how many elements a set and others differ at least."""
        out = np.abs(self.n[others] - self.n[i])
        mine = self.maps[int(self.width[i])][self.at[i]]
        for width in np.unique(self.width[others]).tolist():
            own = self.width[others] == width
            theirs, less = self.maps[width][self.at[others[own]]], mine
            # The lowest bits number the cells, so a narrower bitmap is the sum of the halves.
            while len(less) > theirs.shape[1]:
                less = less[: len(less) // 2] ^ less[len(less) // 2 :]
            while theirs.shape[1] > len(less):
                half = theirs.shape[1] // 2
                theirs = theirs[:, :half] ^ theirs[:, half:]
            out[own] = np.maximum(out[own], np.bitwise_count(theirs ^ less).sum(axis=1))
        return out

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs (a, b, least distance) of different components that sizes, positions and bitmaps leave open.

        In the list of the first element that two sets share, nothing before it is shared: those elements count as
        different, and what can be shared stands after it.
        """
        groups, counts = np.unique(self.group, return_counts=True)
        largest = self.group == groups[counts.argmax()]
        rest = self.n - self.place - 1
        most = 1 - percent / 100 + 1e-9
        for i in np.flatnonzero(~largest).tolist():
            # The list is in order of size: only a slice of it can match.
            begin = int(np.searchsorted(self.n, -(-self.n[i] * percent // 100)))
            end = int(np.searchsorted(self.n, self.n[i] * 100 // percent, side="right"))
            others = np.arange(begin, end)
            least = -(-percent * (self.n[i] + self.n[others]) // (100 + percent))
            room = (1 + np.minimum(rest[i], rest[others]) >= least) & (
                self.place[i] + self.place[others] <= self.n[i] + self.n[others] - 2 * least
            )
            # Each pair once: with the largest component, or with a later one of the others.
            others = others[room & (self.group[others] != self.group[i]) & (largest[others] | (others > i))]
            if not len(others):
                continue
            odd = self._differ(i, others)
            low = 2 * odd / (self.n[i] + self.n[others] + odd)
            near, mine = self.sid[others[low <= most]], self.sid[i]
            yield np.minimum(near, mine), np.maximum(near, mine), low[low <= most]


class Rows:
    """Rows of many short lists, compared pair by pair in arrays."""

    def __init__(self, table: pa.Table):
        self.sid, self.group = table.column("sid").to_numpy(), table.column("group").to_numpy()
        self.n, self.place = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "place"))
        if "bits" not in table.column_names:
            return
        bits = table.column("bits").combine_chunks()
        bits = pa.concat_arrays(bits.chunks) if isinstance(bits, pa.ChunkedArray) else bits
        offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
        self.begin, self.width = offsets[:-1].astype(np.int64), np.diff(offsets)
        self.data = np.frombuffer(bits.buffers()[2], np.uint8)

    def possible(self, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of rows components, sizes and positions leave open; see `Listed.pairs`."""
        n, m = self.n[left], self.n[right]
        keep = (self.group[left] != self.group[right]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        left, right = left[keep], right[keep]
        n, m, p, q = self.n[left], self.n[right], self.place[left], self.place[right]
        least = -(-percent * (n + m) // (100 + percent))
        keep = (1 + np.minimum(n - p - 1, m - q - 1) >= least) & (p + q <= n + m - 2 * least)
        return left[keep], right[keep]

    def pairs(self, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
        """Which of them bitmaps leave open, too, once each, as pairs of sets with their least distance."""
        left, right, low = self.near(left, right, percent)
        return self.sid[left], self.sid[right], low

    def near(self, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
        """The same as pairs of rows."""
        left, right = self.possible(left, right, percent)
        swap = self.sid[left] > self.sid[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        order = np.lexsort((self.sid[right], self.sid[left]))
        left, right = left[order], right[order]
        a, b = self.sid[left], self.sid[right]
        first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        left, right = left[first], right[first]
        odd = np.abs(self.n[left] - self.n[right])
        widths = self.width[left].astype(np.int64) << 32 | self.width[right]
        for both in np.unique(widths).tolist():
            at = np.flatnonzero(widths == both)
            for part in np.array_split(at, 1 + len(at) * (both & 0xFFFF) // (1 << 24)):
                x, y = self._maps(left[part], both >> 32), self._maps(right[part], both & 0xFFFFFFFF)
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                odd[part] = np.maximum(odd[part], np.bitwise_count(x ^ y).sum(axis=1))
        low = 2 * odd / (self.n[left] + self.n[right] + odd)
        near = low <= 1 - percent / 100 + 1e-9
        return left[near], right[near], low[near]

    def _maps(self, rows: np.ndarray, width: int) -> np.ndarray:
        return self.data[self.begin[rows][:, None] + np.arange(width)]


LONG_LIST = 512
ROUNDS = 1
_PAIRS = 1 << 20


def _whole_lists(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[tuple]:
    """Tables of whole lists, and where those begin and end that hold several components; rows come list by list."""

    def several(table: pa.Table) -> tuple:
        gram, group = table.column("gram").to_numpy(), table.column("group").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        more = np.minimum.reduceat(group, cuts) != np.maximum.reduceat(group, cuts)
        return table, cuts[more], np.append(cuts[1:], len(gram))[more]

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < most:
            continue
        gram = held.column("gram").to_numpy()
        last = int(np.searchsorted(gram, gram[-1]))  # the last list may go on
        if last:
            yield several(held.slice(0, last).combine_chunks())
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield several(held.combine_chunks())


def short_pairs(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each of the lists begin:end, about `_PAIRS` at a time."""
    if not len(begin):
        return
    row = ragged(begin, end - begin)
    more = np.repeat(end, end - begin) - row - 1
    cuts = np.searchsorted(np.cumsum(more), np.arange(_PAIRS, int(more.sum()) + _PAIRS, _PAIRS)) + 1
    for part in np.split(np.arange(len(row)), np.unique(np.minimum(cuts, len(row)))):
        if len(part):
            yield np.repeat(row[part], more[part]), ragged(row[part] + 1, more[part])


def _possible(percent: int) -> Callable:
    """Rows (gram, sid, group, n, place) that components, sizes and positions let match another of their list; all of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin, end in _whole_lists(batches):
            keep, rows = np.zeros(table.num_rows, bool), Rows(table)
            long = end - begin > LONG_LIST
            keep[ragged(begin[long], (end - begin)[long])] = True
            for left, right in short_pairs(begin[~long], end[~long]):
                for side in rows.possible(left, right, percent):
                    keep[side] = True
            yield from table.filter(pa.array(keep)).to_batches()

    return run


def _list_pairs(percent: int, nearest: bool = False) -> Callable:
    """Pairs of sets to compare, or of each set only its nearest; rows (gram, sid, group, n, place, bits) come list by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        best: dict[int, tuple[float, int]] = {}

        def add(a: np.ndarray, b: np.ndarray, low: np.ndarray):
            if not nearest:
                found.update(zip(a.tolist(), b.tolist()))
                return
            own, other, low = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([low, low])
            order = np.lexsort((other, low, own))
            own, other, low = own[order], other[order], low[order]
            first = np.append(True, own[1:] != own[:-1])[: len(own)]
            for sid, *pair in zip(own[first].tolist(), low[first].tolist(), other[first].tolist()):
                best[sid] = min(best.get(sid, (2.0, 0)), tuple(pair))

        def flush():
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for table, begin, end in _whole_lists(batches):
            long = end - begin > LONG_LIST
            rows = Rows(table)
            for left, right in short_pairs(begin[~long], end[~long]):
                add(*rows.pairs(left, right, percent))
            for at, stop in zip(begin[long].tolist(), end[long].tolist()):
                for pairs in Listed(table.slice(at, stop - at)).pairs(percent):
                    add(*pairs)
            if len(found) > 100_000:
                yield flush()
        found.update((min(sid, other), max(sid, other)) for sid, (_, other) in best.items())
        yield flush()

    return run


def _open_rows(percent: int) -> Callable:
    """Rows (gram, sid, group, n, place, bits) that have a pair of different components in their list which bitmaps leave open, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin, end in _whole_lists(batches):
            long = end - begin > LONG_LIST
            keep, rows = np.zeros(table.num_rows, bool), Rows(table)
            for left, right in short_pairs(begin[~long], end[~long]):
                for side in rows.near(left, right, percent)[:2]:
                    keep[side] = True
            for at, stop in zip(begin[long].tolist(), end[long].tolist()):
                for pair in Listed(table.slice(at, stop - at)).pairs(percent):
                    for sids in pair[:2]:
                        keep[at:stop] |= np.isin(rows.sid[at:stop], sids)
            yield from table.filter(pa.array(keep)).to_batches()

    return run


class Joined:
    """Components that links found so far have joined."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, node: int) -> int:
        while (above := self.above.get(node, node)) != node:
            self.above[node] = self.above.get(above, above)
            node = above
        return node

    def join(self, one: int, other: int) -> None:
        self.above[one] = other


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, have so many of their elements in common."""
    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _list_links(percent: int) -> Callable:
    """Links between different components; rows (gram, sid, group, n, place, bits, grams) come list by list.

    Of a task those that join what no earlier one has joined: fewer than there are components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined_, found = Joined(), []
        apart: set[tuple[int, int]] = set()
        for table, begin, end in _whole_lists(batches, 2000):
            sids, groups = table.column("sid").to_pylist(), table.column("group").to_pylist()
            row = dict(zip(sids, range(len(sids))))
            grams = table.column("grams")

            def check(a: np.ndarray, b: np.ndarray, low: np.ndarray):
                order = np.argsort(low, kind="stable")
                for one, other in zip(a[order].tolist(), b[order].tolist()):
                    i, j = row[one], row[other]
                    x, y = joined_.top(groups[i]), joined_.top(groups[j])
                    if x == y or (one, other) in apart:
                        continue
                    if linked(*(np.frombuffer(grams[k].as_buffer(), np.uint64) for k in (i, j)), percent):
                        joined_.join(x, y)
                        found.append((one, other))
                    else:
                        if len(apart) > 1 << 18:
                            apart.clear()
                        apart.add((one, other))

            long = end - begin > LONG_LIST
            rows = Rows(table)
            for left, right in short_pairs(begin[~long], end[~long]):
                check(*rows.pairs(left, right, percent))
            for at, stop in zip(begin[long].tolist(), end[long].tolist()):
                for pairs in Listed(table.slice(at, stop - at)).pairs(percent):
                    check(*pairs)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def label_documents(docs: DataFrame, size: int = 4, percent: int = 85, bits: int = 24, bloom_bits: int = 27) -> DataFrame:
    """doc_id, sid (of its set), n (size of the set) and component of every document; empty sets have no component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = scratch.write(source.mapInArrow(_members(size, bits), _MEMBERS), "members")
    members = first.where("segment IS NULL").select("doc_id", "sid", "n", "low", "bits")
    steps = spark.sparkContext.broadcast(frequency_steps(first.where("segment IS NOT NULL").select("segment", "counts"), bits))

    index = source.mapInArrow(_prefixes(size, bits, percent, steps), "gram long, sid long, n int, place int")
    index = index.repartition("gram").sortWithinPartitions("gram", "sid")
    lists = scratch.write(index.mapInArrow(_repeated, "gram long, sid long, n int, place int"), "lists")

    most = 1 - percent / 100 + 1e-9
    sets = members.where("n > 0").groupBy("sid").agg(
        F.min("doc_id").alias("doc"), F.first("low").alias("low"), F.first("bits").alias("bits"), F.first("n").alias("n")
    )
    sets = scratch.write(sets, "classes")

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs with a lower bound of their distance."""
        left = sets.select(F.col("sid").alias("a"), F.col("bits").alias("x"), F.col("n").alias("nx"))
        right = sets.select(F.col("sid").alias("b"), F.col("bits").alias("y"), F.col("n").alias("ny"))
        return pairs.join(left, "a").join(right, "b").mapInArrow(_bounded, "b long, a long, low double")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()

    def fetched(used: DataFrame, name: str) -> DataFrame:
        """The n-grams of sets, each from one document."""
        bloom = spark.sparkContext.broadcast(_bloom(used.join(sets.select("sid", "doc"), "sid"), bloom_bits))
        wanted = source.mapInArrow(_wanted(size, bloom_bits, bloom), "sid long, grams binary").dropDuplicates(["sid"])
        return scratch.write(wanted, f"{name}-sets")

    def compare(pairs: DataFrame, grams: DataFrame, name: str) -> DataFrame:
        """The pairs with their exact distance."""
        left = grams.select(F.col("sid").alias("a"), F.col("grams").alias("x"))
        right = grams.select(F.col("sid").alias("b"), F.col("grams").alias("y"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
        counted = both.mapInArrow(_overlap, "a long, b long, shared long, whole long")
        linked = F.col("shared") * 100 >= F.col("whole") * percent
        distance = (1 - F.col("shared") / F.col("whole")).alias("d")
        out = scratch.write(counted.select("a", "b", distance, linked.alias("linked")), name)
        free_shuffles(spark)
        return out

    # One leader for all sets with the same min-hash: the set whose min-hashes are the commonest, as the middle of its copies.
    hashes = sets.select("sid", F.posexplode("low").alias("which", "value"))
    common = hashes.groupBy("which", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.write(hashes.join(common, ["which", "value"]), "hashes")
    score = shared.groupBy("sid").agg(F.sum("n").alias("score"))
    leader = F.max(F.struct("score", "sid"))["sid"].alias("a")
    groups = shared.join(score, "sid").groupBy("which", "value").agg(leader)
    hashes = shared.select("sid", "which", "value")
    near = hashes.join(groups, ["which", "value"]).where("sid <> a").select("a", F.col("sid").alias("b")).distinct()
    near = scratch.write(bounded(near).where(F.col("low") <= most), "near")
    grams = fetched(ends(near), "direct")
    links = compare(near, grams, "direct").where("linked").select("a", "b")
    scratch.drop(grams)

    component = connected_components(links, scratch, "first")

    def grouped(rows: DataFrame) -> DataFrame:
        """Rows of lists, list by list, with the components so far."""
        names = component.select(F.col("node").alias("sid"), F.col("component").alias("group"))
        rows = rows.join(names, "sid", "left").withColumn("group", F.coalesce("group", "sid"))
        own = [c for c in ("gram", "sid", "group", "n", "place", "bits") if c in rows.columns]
        return rows.select(*own).repartition("gram").sortWithinPartitions("gram")

    possible = grouped(lists).mapInArrow(_possible(percent), "gram long, sid long, group long, n int, place int")
    possible = scratch.write(possible, "possible")
    scratch.drop(lists)
    free_shuffles(spark)
    bits_of = sets.select("sid", "bits")
    parted = possible.join(bits_of, "sid").select("gram", "sid", "group", "n", "place", "bits").repartition("gram").sortWithinPartitions("gram")
    pairs = scratch.write(parted.mapInArrow(_list_pairs(percent, True), "a long, b long").distinct(), "nearest-pairs-0")
    free_shuffles(spark)
    # Components only grow, so later pairs are of sets that have a pair now; these are fetched once.
    used = scratch.write(ends(pairs), "open-ids")
    grams = fetched(used, "open")
    rows = scratch.write(possible.drop("group").join(used, "sid").join(bits_of, "sid"), "open-rows")
    scratch.drop(possible)
    number = 1
    while True:
        exact = compare(pairs, grams, f"exact-{number}").where("linked").select("a", "b")
        none = exact.isEmpty()
        if not none:
            links = links.unionByName(exact)
            component = connected_components(links, scratch, f"round-{number}")
        if none or number == ROUNDS:
            break
        found = grouped(rows).mapInArrow(_list_pairs(percent, True), "a long, b long").distinct()
        pairs, number = scratch.write(found, f"pairs-{number}"), number + 1
    fields = "gram long, sid long, group long, n int, place int, bits binary"
    rest = scratch.write(grouped(rows).mapInArrow(_open_rows(percent), fields), "rest")
    whole = rest.join(grams, "sid").select("gram", "sid", "group", "n", "place", "bits", "grams")
    whole = whole.repartition("gram").sortWithinPartitions("gram")
    exact = scratch.write(whole.mapInArrow(_list_links(percent), "a long, b long").distinct(), "last-links")
    if not exact.isEmpty():
        component = connected_components(links.unionByName(exact), scratch, "last")
    scratch.drop(grams, rows, rest)
    free_shuffles(spark)

    named = component.select(F.col("node").alias("sid"), "component")
    whole = members.select("doc_id", "sid", "n").join(named, "sid", "left")
    return whole.withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "sid")))


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: links have 100 * shared >= percent * union."""
    whole = label_documents(docs, size, percent)
    names = whole.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    name = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return whole.join(names, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))


def _with_set(size: int, at: int, text: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                two = pa.RecordBatch.from_arrays([part.column(at), part.column(text)], ["doc_id", "text"])
                rows = [(sid, len(values)) for _, sid, _, values in _sets(iter([two]), size)]
                sids, sizes = zip(*rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())], names)

    return run


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component, that with the smallest doc_id, and all documents without shingles."""
    sid, n = "__set", "__size"
    whole = label_documents(docs, size, percent).where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("first")
    kept = whole.groupBy("component").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.sid").alias(sid))
    fields = [*docs.schema.fields, T.StructField(sid, T.LongType()), T.StructField(n, T.LongType())]
    places = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = docs.mapInArrow(_with_set(size, *places, [f.name for f in fields]), T.StructType(fields))
    full = rows.where(F.col(n) > 0).join(kept, sid).where(F.col("doc_id").eqNullSafe(F.col("__id")))
    return full.dropDuplicates([sid, "doc_id"]).select(*docs.columns).unionByName(rows.where(F.col(n) == 0).select(*docs.columns))
