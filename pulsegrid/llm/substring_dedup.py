"""Removal of long substrings that start in more than one place, by prefix doubling over a parse of the texts.

A suffix array of every byte would move many times the input. Texts are therefore parsed into phrases that begin at
anchors: places whose `GRAM` bytes have the smallest hash of some window of `reach` places. A string of `span` bytes holds two
such windows side by side. Its core are the phrases from the first smallest place of its first window to the last one of its last
window; its bytes alone decide where these are and which anchors lie between, so equal strings have equal cores:

1. Spark counts (rank, rank) pairs of positions at growing offsets of 1, 2, ... phrases and gives new ranks, until a position is
   unique, its run is `span` bytes long or of `RUN` phrases. Unique positions drop out of all later rounds. Longer cores are of
   periodic bytes, where every period has an anchor; these are named by the hash of their bytes, once a text for all equal ones.
2. A repeated run of `span` bytes settles the strings inside it as repeated. A string whose core is unique occurs
   once. Runs of any number of phrases have the pair of ranks at their ends
   (of the largest power of two) as their name; a string inside a repeated run of that kind is settled, too.
3. What is left are strings at the borders of repeats. They are compared with all strings of the same core by digests of
   128 bits: first in blocks of starts at equal distances from an anchor, then, where a border runs through a block, one by
   one.

Null is an empty text. Texts shorter than `span` keep all bytes. Rows with equal id and text count as two places, so all of
them lose what is at least `span` long. No place is preferred: every occurrence is removed. Matches never cross
rows; ids may be null. Other columns are not used. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm.common import Scratch, free_shuffles, ragged, slices, text_bytes
from pulsegrid.llm.words import joined, mixed

SLICE = 4 << 20
GRAM = 8
STEP = 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
LONG, COVERED = -1, -2  # in place of a phrase's number
_LONG = np.uint64(0x7B1F0C4D5A9E3361)
_START, _END = np.uint64(0xA5A5F00DD00DFACE), np.uint64(0x3C3C1DEA5EED0BAD)
RUN = 8
PARSE = "key long, idx int, pos int, nxt int, flo int, fhi int, llo int, lhi int, size int, name long, wide long"
# Of starts behind all texts: no string has its first or last anchor there.
_NEVER = np.iinfo(np.int32).max


def row_id(doc_id, raw: bytes) -> int:
    head = b"-" if doc_id is None else b"+" + str(doc_id).encode()
    return int.from_bytes(xxhash.xxh3_64_digest(head + b"\0" + raw), "little", signed=True)


def reach_of(span: int) -> int:
    """So wide that two windows fit in a string side by side: every core has two anchors, and phrases are as long as can be."""
    return max(1, (span - GRAM + 1) // 2)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over values[i:i + width] for each i, by running bests of blocks from both sides."""
    n = len(values)
    fill = values.dtype.type(np.iinfo(values.dtype).max if best is np.minimum else 0)
    padded = np.full(-(-(n + width) // width) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = best.accumulate(blocks, axis=1).ravel()
    backward = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, bounds: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of texts that end one byte before the next begins, and their hashes."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)]).tobytes()
    grams = np.empty(n + 8 - n % 8, np.uint64)
    for shift in range(8):
        grams[shift::8] = np.frombuffer(padded, "<u8", len(grams) // 8, shift)
    hashes = mixed(grams[:n]) >> np.uint64(1)
    sizes = np.diff(bounds) - 1
    place = np.arange(n) - np.repeat(bounds[:-1], sizes + 1)
    left = np.repeat(sizes, sizes + 1) - place  # bytes from here to the end of the text
    most = np.iinfo(np.uint64).max
    hashes[left < GRAM] = most
    least = _sliding(hashes, reach, np.minimum)
    least[left < GRAM + reach - 1] = 0  # windows that do not fit in the text select nothing
    chosen = _sliding(np.concatenate([np.zeros(reach - 1, np.uint64), least]), reach, np.maximum)[:n]
    at = np.flatnonzero((chosen == hashes) & (hashes != most))
    return at, hashes[at]


def smallest(at: np.ndarray, hashes: np.ndarray, first: np.ndarray, base: np.ndarray, stop: np.ndarray, reach: int, last: bool):
    """(lowest, highest) starts of the windows of which an anchor is the first smallest place, or the last one; none if lowest > highest.

    An anchor takes over where it enters the window, but not before a lower one has left it; of equal ones in a row, that is the one
    before them all, and the first of them counts as lower for first places. `first` marks a text's first anchors; its windows
    start from `base` to `stop`.
    """
    heads = first | (hashes != np.roll(hashes, 1)) | (not last)
    head = np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))
    before = head - 1
    waits = ~first[head] & ((hashes[before] < hashes) if last else (hashes[before] <= hashes))
    low = np.maximum(at - reach + 1, np.where(waits, at[before] + 1, base))
    low[first] = base[first]
    after = np.minimum.accumulate(low[::-1])[::-1]
    high = np.minimum(np.append(after[1:], _NEVER << 31) - 1, stop)
    return low, high


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    powers = np.full(len(raw), _BASE, np.uint64)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    spread = mixed(np.arange(1, 257, dtype=np.uint64))
    return np.concatenate([[np.uint64(0)], np.cumsum(spread[raw] * powers)])


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of raw[begin:end]; equal bytes have equal hashes wherever they stand."""
    back = np.full(len(sums), _INVERSE, np.uint64)
    back[:1] = 1
    back = np.multiply.accumulate(back)
    return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _parse(span: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out = parse_texts(part.column(0).to_pylist(), part.column(1), span)
                if out is not None:
                    yield out

    return run


def parse_texts(ids: list, texts: pa.Array, span: int) -> pa.RecordBatch | None:
    """The phrases of the texts that are `span` bytes long: from an anchor, or the start, to beyond the next, or the end."""
    raw, bounds = joined(texts)
    reach = reach_of(span)
    at, hashes = anchors(raw, bounds, reach)
    sizes = np.diff(bounds) - 1
    long = np.flatnonzero(sizes >= span)
    if not len(long):
        return None
    doc = np.searchsorted(bounds, at, side="right") - 1
    keep = sizes[doc] >= span
    at, hashes, doc = at[keep], hashes[keep], doc[keep]
    new = np.append(True, doc[1:] != doc[:-1])
    base = bounds[doc]
    stop = base + sizes[doc] - GRAM - reach + 1
    further = span - GRAM - reach + 1  # from a string's first window to its last
    flo, fhi = smallest(at, hashes, new, base, stop, reach, last=False)
    llo, lhi = (x - further for x in smallest(at, hashes, new, base, stop, reach, last=True))
    # Pairs of an anchor and a later one that are the ends of a core, with the range of its starts.
    highest = np.minimum(fhi, base + sizes[doc] - span)
    tail = np.searchsorted(lhi, flo)
    tails = np.maximum(np.searchsorted(lhi, highest) - tail + 1, 0) * (flo <= highest)
    head, tail = np.repeat(np.arange(len(at)), tails), ragged(tail, tails)
    head, tail = head[tail < len(at)], tail[tail < len(at)]
    lo, hi = np.maximum(flo[head], llo[tail]), np.minimum(highest[head], lhi[tail])
    good = (lo <= hi) & (doc[head] == doc[tail])
    head, tail, lo, hi = head[good], tail[good], lo[good], hi[good]
    far = tail - head > RUN
    # Phrases in or beside cores that are not too long.
    border = np.zeros(len(at) + 4, np.int64)
    np.add.at(border, np.maximum(head[~far] - 2, 0), 1)
    np.add.at(border, tail[~far] + 2, -1)
    used = np.cumsum(border)[: len(at)] > 0
    # Starts and ends of texts are anchors of their own, of no string's core.
    bare = long[~np.isin(bounds[long], at)]
    places = np.concatenate([at, bounds[bare], bounds[long] + sizes[long]])
    docs = np.concatenate([doc, bare, long])
    own = np.concatenate([np.arange(len(at)), np.full(len(bare) + len(long), -1)])
    order = np.lexsort((places, docs))
    places, docs, own = places[order], docs[order], own[order]
    last = np.append(docs[1:] != docs[:-1], True)
    first = np.append(True, last[:-1])
    i = np.flatnonzero(~last & ((own < 0) | used[own]))
    start, size = bounds[docs[i]], sizes[docs[i]]
    end = np.minimum(places[i + 1] + GRAM, start + size)
    sums = prefix_hashes(raw)
    names = range_hashes(sums, places[i], end)
    opening, closing = own[i] < 0, own[i + 1] < 0
    names[opening] = mixed(names[opening] ^ _START)
    names[closing] = mixed(names[closing] ^ _END)
    heads = np.flatnonzero(first)
    index = i - np.repeat(heads, np.diff(np.append(heads, len(places))))[i]
    view = raw.tobytes()
    keys = np.zeros(len(sizes), np.int64)
    for d in long.tolist():
        keys[d] = row_id(ids[d], view[bounds[d] : bounds[d] + sizes[d]])
    starts = lambda x, k: np.where(k < 0, _NEVER, x[k] - start)
    rows = [
        keys[docs[i]], index, places[i] - start, places[i + 1] - start, starts(flo, own[i]), starts(fhi, own[i]),
        starts(llo, own[i + 1]), starts(lhi, own[i + 1]), size, names.view(np.int64), names.view(np.int64),
    ]
    more = long_cores(sums, span, bounds[doc[head[far]]], at[head[far]], at[tail[far]], lo[far], hi[far])
    more[0] = keys[doc[head[far]][more[0]]]
    columns = [np.concatenate(two) for two in zip(rows, more)]
    kinds = [pa.int64()] + [pa.int32()] * 8 + [pa.int64()] * 2
    names = ["key", "idx", "pos", "nxt", "flo", "fhi", "llo", "lhi", "size", "name", "wide"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def long_cores(sums: np.ndarray, span: int, base: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list:
    """Cores of more than `RUN` phrases: which one, LONG, its place, 0, lowest and highest start, whether settled, 0, 0, hash, hash around.

    Those that a text has several times with the same bytes around stand in several places: one stays for other texts to meet, and
    the starts of all are ranges, marked by COVERED.
    """
    core = mixed(range_hashes(sums, begin, end + GRAM) ^ _LONG)
    wide = mixed(range_hashes(sums, lo, hi + span) ^ mixed((begin - lo).astype(np.uint64)))
    order = np.lexsort((lo, wide, base))
    new = np.append(True, (wide[order][1:] != wide[order][:-1]) | (base[order][1:] != base[order][:-1]))[: len(order)]
    group = np.cumsum(new) - 1
    several = np.bincount(group, minlength=1)[group] > 1
    one = order[new]
    again = np.sort(order[several])
    # Ranges that follow each other are one.
    again = again[np.lexsort((lo[again], base[again]))]
    cut = np.append(True, (lo[again][1:] > hi[again][:-1] + 1) | (base[again][1:] != base[again][:-1]))[: len(again)]
    stops = np.append(np.flatnonzero(cut)[1:], len(again))[: int(cut.sum())] - 1
    from_, to = again[cut], again[stops]
    n, m = len(one), len(from_)
    none, zero = np.zeros(n + m, np.int64), np.zeros(m, np.int64)
    return [
        np.concatenate([one, from_]), np.repeat([LONG, COVERED], [n, m]), np.concatenate([begin[one] - base[one], zero]), none,
        np.concatenate([lo[one] - base[one], lo[from_] - base[from_]]), np.concatenate([hi[one] - base[one], hi[to] - base[from_]]),
        np.concatenate([several[new].astype(np.int64), zero]), none, none,
        np.concatenate([core[one].view(np.int64), zero]), np.concatenate([wide[one].view(np.int64), zero]),
    ]


def repeated_runs(docs: DataFrame, span: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Phrases that stand in several places, with the ranks of their runs of 1, 2, 4, ... `RUN` phrases; rows of longer cores.

    ranks[h] is null once the run is unique; `top` is the end of a repeated run of `span` bytes or more.
    """
    spark = docs.sparkSession
    whole = scratch.write(docs.mapInArrow(_parse(span), PARSE), "parsed")
    parsed = whole.where("idx >= 0").drop("wide")
    names = parsed.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    state = parsed.join(names, "name", "left_semi").groupBy("key", "idx").agg(
        *[F.first(c).alias(c) for c in ("pos", "nxt", "flo", "fhi", "llo", "lhi", "size")],
        F.first("name").alias("rank"), F.count("*").alias("copies"),
    )
    state = scratch.write(state.withColumn("end", F.least(F.col("nxt") + GRAM, "size")), "runs")
    covered = F.col("idx") == COVERED
    long = whole.where("idx < 0").select(
        "key", covered.alias("covered"), (F.col("llo") > 0).alias("settled"), F.col("flo").alias("lo"), F.col("fhi").alias("hi"),
        F.col("pos").alias("at"), F.col("name").alias("core"), "wide",
    )
    long = scratch.write(long, "long")
    scratch.drop(whole)
    free_shuffles(spark)
    active = state.select("key", "idx", "pos", "end", "rank", "copies")
    levels, offset, number = [], 1, 1
    while offset < RUN:
        order = Window.partitionBy("key").orderBy("idx")
        ahead = F.lead(F.struct("idx", "rank", "end"), offset).over(order)
        meets = (F.col("ahead.idx") == F.col("idx") + offset) & (F.col("end") - F.col("pos") < span)
        pairs = active.withColumn("ahead", ahead).where(meets)
        pairs = pairs.select("key", "idx", "pos", "copies", "rank", F.col("ahead.rank").alias("other"), F.col("ahead.end").alias("end"))
        pairs = scratch.write(pairs, f"pairs-{number}")
        # Distinct pairs are numbered: their numbers are the new ranks.
        again = pairs.groupBy("rank", "other").agg(F.sum("copies").alias("n")).where("n > 1").select("rank", "other")
        ranks = again.withColumn("new", F.monotonically_increasing_id())
        ranks = scratch.write(ranks, f"ranks-{number}")
        active = pairs.join(ranks, ["rank", "other"]).select("key", "idx", "pos", "end", F.col("new").alias("rank"), "copies")
        active = scratch.write(active, f"active-{number}")
        scratch.drop(pairs, ranks)
        free_shuffles(spark)
        if active.isEmpty():
            break
        levels.append(active.select("key", "idx", "rank", "end", F.lit(number).alias("level")))
        offset, number = offset * 2, number + 1
    # One row a phrase: the ranks of all levels it has, which are the first ones.
    first = F.array("rank")
    if not levels:
        top = F.when(F.col("end") - F.col("pos") >= span, F.col("end"))
        return state.select("*", first.alias("ranks"), top.alias("top")).drop("rank", "end"), long
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    have = every.groupBy("key", "idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "rank"))), lambda x: x["rank"]).alias("more"), F.max("end").alias("far")
    )
    both = state.join(have, ["key", "idx"], "left")
    top = F.coalesce("far", "end")
    both = both.withColumn("ranks", F.concat(first, F.coalesce("more", F.array().cast("array<long>"))))
    return both.withColumn("top", F.when(top - F.col("pos") >= span, top)).drop("rank", "end", "more", "far"), long


_NAMES = ["key", "covered", "settled", "lo", "hi", "at", "core", "wide"]
INTERVALS = "key long, covered boolean, settled boolean, lo int, hi int, at int, core long, wide long"


def _named(*parts: np.ndarray) -> np.ndarray:
    """One hash of several numbers."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = mixed(out ^ part.astype(np.int64).view(np.uint64)) + _BASE
    return out.view(np.int64)


class Runs:
    """Phrases of whole documents, in order of key and idx, as arrays; documents lie apart on one line of bytes."""

    def __init__(self, table: pa.Table, span: int):
        self.span = span
        for name in ("idx", "pos", "nxt", "flo", "fhi", "llo", "lhi", "size"):
            setattr(self, name, table.column(name).to_numpy().astype(np.int64))
        self.key = table.column("key").to_numpy()
        self.n = len(self.key)
        lists = table.column("ranks").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        lengths = np.diff(lists.offsets.to_numpy())
        self.depth = int(lengths.max())
        flat = lists.flatten()
        at = (np.cumsum(lengths) - lengths)[:, None] + np.arange(self.depth)
        at = np.where(np.arange(self.depth) < lengths[:, None], at, len(flat))
        self.ranks = np.append(flat.fill_null(0).to_numpy(zero_copy_only=False), 0)[at]
        self.has = np.append(flat.is_valid().to_numpy(zero_copy_only=False), False)[at]
        new = np.append(True, self.key[1:] != self.key[:-1])
        room = self.size[new] + 2 * span
        self.bases, self.keys = np.cumsum(room) - room, self.key[new]
        self.base = self.bases[np.cumsum(new) - 1]
        self.top = table.column("top").fill_null(-1).to_numpy().astype(np.int64)

    def covered(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of starts, to the last, that lie in a repeated run of `span` bytes; on the line."""
        good = self.top >= 0
        begin, end = (self.base + self.pos)[good], (self.base + self.top)[good] - self.span
        if not len(begin):
            return begin, end
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        cut = np.append(True, begin[1:] > end[:-1] + 1)
        return begin[cut], end[np.append(np.flatnonzero(cut)[1:], len(begin)) - 1]

    def _run_name(self, first: np.ndarray, t: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, rank, rank) of the runs of t phrases from rows `first` on."""
        level = np.floor(np.log2(np.maximum(t, 1))).astype(np.int64)
        back = np.clip(first + t - (1 << level), 0, self.n - 1)
        first, deep = np.clip(first, 0, self.n - 1), np.minimum(level, self.depth - 1)
        known = (level < self.depth) & self.has[first, deep] & self.has[back, deep]
        return known, self.ranks[first, deep], self.ranks[back, deep]

    def cores(self) -> Iterator[tuple]:
        """(row, lowest start, highest start, core) of strings whose core is not known to be unique."""
        highest = np.minimum(self.fhi, self.size - self.span)
        rows, t = np.flatnonzero(self.flo <= highest), 1
        while len(rows):
            rows = rows[rows + t - 1 < self.n] if t <= RUN else rows[:0]
            tail = rows + t - 1
            rows = rows[(self.key[tail] == self.key[rows]) & (self.idx[tail] == self.idx[rows] + t - 1)]
            tail = rows + t - 1
            lo, hi = np.maximum(self.flo[rows], self.llo[tail]), np.minimum(highest[rows], self.lhi[tail])
            known, ra, rb = self._run_name(rows, t)
            use = known & (lo <= hi)
            yield rows[use], lo[use], hi[use], _named(np.full(int(use.sum()), t), ra[use], rb[use])
            rows = rows[self.lhi[tail] < highest[rows]]
            t += 1

    def wider(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """The name of the run of phrases around all strings that start in lo .. hi, with the place of lo; null if it is unique."""
        if not len(rows):
            return pa.array([], pa.int64())
        first = np.searchsorted(self.base + self.pos, self.base[rows] + lo, side="right") - 1
        stop = np.minimum(self.nxt + GRAM, self.size)
        last = np.searchsorted(self.base + stop, self.base[rows] + hi + self.span)
        last = np.minimum(last, self.n - 1)
        first = np.maximum(first, 0)
        t = last - first + 1
        good = (self.key[first] == self.key[rows]) & (self.key[last] == self.key[rows]) & (t > 0)
        good &= (self.idx[last] - self.idx[first] == last - first) & (self.pos[first] <= lo) & (lo < self.nxt[first])
        good &= stop[last] >= hi + self.span
        known, xa, xb = self._run_name(first, t)
        return pa.array(_named(t, lo - self.pos[first], xa, xb), mask=~(good & known))

    def batches(self) -> Iterator[pa.RecordBatch]:
        begin, end = self.covered()
        doc = np.searchsorted(self.bases, begin, side="right") - 1
        none = np.zeros(len(begin), np.int64)
        low, high = begin - self.bases[doc], end - self.bases[doc]
        yield self._batch(self.keys[doc], True, none > 0, low, high, none, none, pa.array(none))
        for rows, lo, hi, core in self.cores():
            # Known already as a whole: then only other strings may need these.
            at = np.searchsorted(begin, self.base[rows] + lo, side="right") - 1
            settled = (at >= 0) & (self.base[rows] + hi <= end[np.maximum(at, 0)]) if len(end) else np.zeros(len(rows), bool)
            yield self._batch(self.key[rows], False, settled, lo, hi, self.pos[rows], core, self.wider(rows, lo, hi))

    @staticmethod
    def _batch(key, covered, settled, lo, hi, at, core, wide) -> pa.RecordBatch:
        small = lambda x: pa.array(np.asarray(x).astype(np.int32))
        columns = [pa.array(key), pa.array(np.full(len(key), covered)), pa.array(settled), small(lo), small(hi), small(at), pa.array(core), wide]
        return pa.RecordBatch.from_arrays(columns, _NAMES)


def _intervals(span: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 200_000:
                continue
            key = held.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last document may go on
            if last:
                yield from Runs(held.slice(0, last), span).batches()
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from Runs(held, span).batches()

    return run


def _blocks(span: int) -> Callable:
    """Digests of blocks of `STEP` starts, counted back from an anchor: of the bytes that their strings share, and of all their bytes.

    Strings that are equal lie in blocks that share the first; blocks that share the second hold equal strings only.
    Of settled blocks with the same bytes one stands for all of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            rows = []
            for key, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "ranges"))):
                raw = text_bytes(text)
                starts: dict[int, bool] = {}
                for part in ranges:
                    for block in range((part["at"] - part["hi"]) // STEP, (part["at"] - part["lo"]) // STEP + 1):
                        start = part["at"] - STEP * block
                        starts[start] = starts.get(start, True) and part["settled"]
                for start, settled in starts.items():
                    inner = xxhash.xxh3_128_digest(raw[start : start - STEP + 1 + span])
                    fits = start - STEP + 1 >= 0 and start + span <= len(raw)
                    outer = xxhash.xxh3_128_digest(raw[start - STEP + 1 : start + span]) if fits else None
                    if settled and fits:
                        if outer in seen:
                            continue
                        seen.add(outer)
                    rows.append((key, start, inner, outer, not settled))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "start", "inner", "outer", "open"]
            )

    return run


def _enumerate(span: int) -> Callable:
    """Digests of the strings of the given blocks; of settled ones each digest once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            rows = []
            for key, text, blocks in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "blocks"))):
                raw = text_bytes(text)
                places: dict[int, bool] = {}
                for block in blocks:
                    for p in range(max(0, block["start"] - STEP + 1), min(block["start"], len(raw) - span) + 1):
                        places[p] = places.get(p, False) or block["open"]
                for p, open_ in places.items():
                    digest = xxhash.xxh3_128_digest(raw[p : p + span])
                    if not open_:
                        if digest in seen:
                            continue
                        seen.add(digest)
                    rows.append((key, p, digest, open_))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "p", "digest", "open"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        keys = [row_id(i, text_bytes(t)) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids, texts], ["key", "doc_id", "text"])


def repeated_starts(docs: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """key, lo, hi: ranges of places at which a string of `span` bytes starts that also starts elsewhere."""
    runs, long = repeated_runs(docs, span, scratch)
    runs = scratch.write(runs, "all-runs")
    scratch.keep_only(runs, long)
    columns = ["key", "idx", "pos", "nxt", "flo", "fhi", "llo", "lhi", "size", "ranks", "top"]
    ordered = runs.select(*columns).repartition("key").sortWithinPartitions("key", "idx")
    parts = scratch.write(ordered.mapInArrow(_intervals(span), INTERVALS), "intervals")
    copies = scratch.write(runs.groupBy("key").agg(F.max("copies").alias("copies")).where("copies > 1"), "copies")
    scratch.keep_only(parts, copies, long)
    # Rows of longer cores stand there once for each copy of a row.
    parts = parts.join(copies, "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    parts = parts.unionByName(long.withColumn("copies", F.lit(1).cast("long")))
    covered = parts.where("covered").select("key", "lo", "hi")

    # Bytes around a string that stand in several places settle it.
    inner = parts.where("NOT covered").drop("covered")
    again = inner.where("wide IS NOT NULL").groupBy("wide").agg(F.sum("copies").alias("places"), F.min("settled").alias("all"))
    again = again.where("places > 1 AND NOT all").select("wide", F.lit(True).alias("proven"))
    states = inner.join(again, "wide", "left").withColumn("proven", F.col("proven") & ~F.col("settled"))
    states = states.select("key", "lo", "hi", "at", "core", "copies", F.coalesce("proven", F.lit(False)).alias("proven"), "settled")
    states = scratch.write(states.withColumn("settled", F.col("settled") | F.col("proven")), "states")
    free_shuffles(docs.sparkSession)
    # Cores that an open string has and that stand in several places.
    asked = states.groupBy("core").agg(F.sum("copies").alias("n"), F.min("settled").alias("settled"))
    asked = asked.where("n > 1 AND NOT settled").select("core")
    proven = states.where("proven")
    wanted = states.join(asked, "core", "left_semi")
    ranges = wanted.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "at", "settled")).alias("ranges"))
    texts = docs.mapInArrow(_keyed, "key long, doc_id long, text string").select("key", "text")
    blocks = texts.join(ranges, "key").mapInArrow(_blocks(span), "key long, start int, inner binary, outer binary, open boolean")
    blocks = scratch.write(blocks, "blocks")
    proven = scratch.write(proven.select("key", "lo", "hi"), "proven")
    scratch.drop(states)
    free_shuffles(docs.sparkSession)
    same = blocks.where("outer IS NOT NULL").groupBy("outer").agg(F.count("*").alias("n")).where("n > 1").select("outer")
    equal = scratch.write(blocks.where("open").join(same, "outer", "left_semi").select("key", "start").distinct(), "equal")
    rest = blocks.join(equal.withColumn("done", F.lit(True)), ["key", "start"], "left").withColumn(
        "open", F.col("open") & F.col("done").isNull()
    )
    near = rest.groupBy("inner").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 AND open").select("inner")
    asked = rest.join(near, "inner", "left_semi").groupBy("key").agg(F.collect_list(F.struct("start", "open")).alias("blocks"))
    asked = scratch.write(asked, "asked")
    strings = texts.join(asked, "key").mapInArrow(_enumerate(span), "key long, p int, digest binary, open boolean")
    strings = scratch.write(strings, "strings")
    free_shuffles(docs.sparkSession)
    twice = strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    found = strings.where("open").join(twice, "digest", "left_semi").select("key", F.col("p").alias("lo"), F.col("p").alias("hi"))
    # All starts of equal blocks: those before the block's last that are in the text.
    whole = equal.select("key", (F.col("start") - STEP + 1).alias("lo"), F.col("start").alias("hi"))
    return covered.unionByName(proven.select("key", "lo", "hi")).unionByName(whole).unionByName(found)


def _remove(span: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            sizes, removed, counts, shas, kept = [], [], [], [], []
            for text, starts in zip(rows["text"], rows["starts"]):
                raw = text_bytes(text)
                spans = []
                for lo, hi in sorted((s["lo"], s["hi"] + span) for s in starts or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
                at, parts = 0, []
                for lo, hi in spans:
                    parts.append(raw[at:lo])
                    at = hi
                rest = b"".join(parts) + raw[at:]
                sizes.append(len(raw))
                removed.append(sum(hi - lo for lo, hi in spans))
                counts.append(len(spans))
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [rows["doc_id"], sizes, removed, counts, shas, kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_repeated_substrings(docs: DataFrame, span: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes of every row."""
    scratch = Scratch(docs.sparkSession, "substrings")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    starts = repeated_starts(source, span, scratch)
    starts = scratch.write(starts.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("starts")), "starts")
    scratch.keep_only(starts)
    both = source.mapInArrow(_keyed, "key long, doc_id long, text string").join(starts, "key", "left")
    return both.mapInArrow(
        _remove(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
