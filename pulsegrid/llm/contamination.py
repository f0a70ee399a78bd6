"""Benchmark decontamination by suffix arrays over the training text.

Every slice of documents is a shard. Its words become numbers of the benchmark's vocabulary, a suffix array sorts the
positions at which a window can start, and every benchmark suffix is looked up in it by binary search. That gives the
longest verbatim match of each suffix with its location, and the range of all occurrences of its window. A shard needs
no other shard, so nothing is shuffled.

The benchmark is a query set: it goes to the tasks in blocks of `block_words` words, one pass over the documents per
block, so what a task holds has a fixed bound.

Null texts and texts without words have no words, no hit and no item; items without words are in no document. Rows with
the same id are documents of their own. An item id that occurs in several rows is one item; a null id is the id "".
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import row_key, slices
from pulsegrid.llm.words import LETTERS, find_words, hash_words, joined

SLICE = 4 << 20
BLOCK_WORDS = 1 << 18
FOUND = "key binary, doc_id long, n_words long, spans array<long>, items array<string>"
MATCHES = "doc_id long, item_id string, length long, doc_word long, item_word long"


class Items:
    """A block of the benchmark: vocabulary, windows and suffixes."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        texts = pa.array([text or "" for _, text in rows], pa.string())
        raw, bounds = joined(texts)
        starts, ends = find_words(raw, LETTERS)
        self.names = [name for name, _ in rows]
        self.vocabulary, coded = np.unique(hash_words(raw, starts, ends), return_inverse=True)
        first = np.searchsorted(starts, bounds)
        self.longest = int(np.diff(first).max(initial=1))
        self.windows: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        by_size: dict[int, dict[tuple, set[int]]] = {}
        self.suffixes = []
        for i in range(len(rows)):
            words = coded[first[i] : first[i + 1]]
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(tuple(words[at : at + size].tolist()), set()).add(i)
            self.suffixes += [(i, at, words[at:]) for at in range(len(words))]
        for size, found in by_size.items():
            self.windows[size] = np.array(list(found), np.int64), [sorted(s) for s in found.values()]
        self.shortest = min(self.windows, default=0)


def number_words(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places in the vocabulary, -1 for other words."""
    if not len(vocabulary):
        return np.full(len(hashes), -1, np.int64)
    # A table of the upper 16 bits leaves few words for the search.
    seen = np.zeros(1 << 16, bool)
    seen[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes[maybe]
    out = np.full(len(hashes), -1, np.int64)
    out[maybe[hit]] = at[hit]
    return out


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts` in the order of the suffixes of `text` there, by their first `depth` numbers.

    Prefix doubling: ranks of twice the length from pairs of ranks, until all differ or `depth` is reached.
    """
    rank = np.append(text + 1, 0)
    length = 1
    while length < depth and len(starts):
        ahead = np.minimum(np.arange(len(rank)) + length, len(rank) - 1)
        pair = rank * (int(rank.max()) + 1) + rank[ahead]
        _, rank = np.unique(pair, return_inverse=True)
        length *= 2
        at = rank[starts]
        if len(np.unique(at)) == len(at):
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def _rows(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return text[np.minimum(at[:, None] + np.arange(width), len(text) - 1)]


def _after(rows: np.ndarray, wanted: np.ndarray, equal: bool) -> np.ndarray:
    """Which rows come before `wanted`, or are equal to it if `equal`."""
    differs = rows != wanted
    where = differs.argmax(axis=1)
    line = np.arange(len(rows))
    some = differs[line, where]
    return np.where(some, rows[line, where] < wanted[line, where], equal)


def search(text: np.ndarray, array: np.ndarray, wanted: np.ndarray, equal: bool) -> np.ndarray:
    """For each row of `wanted` the number of suffixes before it (with equal prefixes if `equal`)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(array), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less = _after(_rows(text, array[middle], wanted.shape[1]), wanted[open_], equal)
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


class Shard:
    """Documents of a slice as one text of numbers, with its suffix array."""

    def __init__(self, texts: pa.Array, items: Items):
        raw, bounds = joined(texts)
        starts, ends = find_words(raw, LETTERS)
        numbers = number_words(hash_words(raw, starts, ends), items.vocabulary)
        self.first = np.searchsorted(starts, bounds)
        # A text ends with a number of no word, so no match leaves it.
        at = np.arange(len(numbers)) + np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.text = np.full(len(numbers) + len(texts) + 1, -1, np.int64)
        self.text[at] = numbers
        self.begin = self.first[:-1] + np.arange(len(texts))
        # Where `shortest` known words follow each other.
        known = np.concatenate([[0], np.cumsum(self.text >= 0)])
        self.shortest = max(items.shortest, 1)
        run = known[self.shortest :] - known[: max(0, len(known) - self.shortest)]
        self.starts = np.flatnonzero(run == self.shortest)
        self.array = np.zeros(0, np.int64)
        if len(self.starts):
            # Only what these positions can reach is ranked.
            cover = np.zeros(len(self.text) + 1, np.int64)
            np.add.at(cover, self.starts, 1)
            np.add.at(cover, np.minimum(self.starts + self.shortest, len(self.text)), -1)
            near = np.cumsum(cover[:-1]) > 0
            near[1:] |= near[:-1]
            self.places = np.flatnonzero(near)
            small = self.text[self.places]
            inner = np.searchsorted(self.places, self.starts)
            self.small = np.append(small, -1)
            self.array = suffix_array(self.small[:-1], inner, items.longest)

    def occurrences(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of all occurrences."""
        if not len(self.array):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = search(self.small, self.array, windows, False)
        high = search(self.small, self.array, windows, True)
        n = high - low
        which = np.repeat(np.arange(len(windows)), n)
        tops = np.cumsum(n)
        at = np.arange(int(tops[-1])) + np.repeat(low - (tops - n), n)
        return which, self.places[self.array[at]]

    def longest(self, suffixes: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(length, position) of the longest match of each suffix."""
        wanted = np.full((len(suffixes), width), -2, np.int64)
        for i, words in enumerate(suffixes):
            wanted[i, : len(words)] = words
        best, where = np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), np.int64)
        if not len(self.array):
            return best, where
        at = search(self.small, self.array, wanted, False)
        for near in (at - 1, at):
            there = (near >= 0) & (near < len(self.array))
            rows = _rows(self.small, self.array[np.clip(near, 0, len(self.array) - 1)], width)
            same = np.cumprod((rows == wanted) & (wanted >= 0), axis=1).sum(axis=1) * there
            better = same > best
            best[better] = same[better]
            where[better] = self.places[self.array[near[better]]]
        return best, where


def _find(items: Items) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                shard = Shard(part.column(1), items)
                n = part.num_rows
                spans: list[list[np.ndarray]] = [[] for _ in range(n)]
                found: list[set] = [set() for _ in range(n)]
                for size, (windows, owners) in items.windows.items():
                    which, at = shard.occurrences(windows)
                    doc = np.searchsorted(shard.begin, at, side="right") - 1
                    order = np.lexsort((at, doc))
                    which, at, doc = which[order], at[order], doc[order]
                    cuts = np.flatnonzero(np.diff(doc)) + 1
                    for w, a, d in zip(np.split(which, cuts), np.split(at, cuts), np.split(doc, cuts)):
                        if len(d):
                            begin = a - shard.begin[d[0]]
                            spans[d[0]].append(merged(begin, begin + size))
                            for one in np.unique(w):
                                found[d[0]].update(owners[one])
                ids, texts = part.column(0).to_pylist(), part.column(1)
                counts = np.diff(shard.first)
                keys = [row_key(i, t.as_buffer().to_pybytes() if t.is_valid else b"") for i, t in zip(ids, texts)]
                flat = [np.concatenate(s) if s else np.zeros(0, np.int64) for s in spans]
                names = [sorted(items.names[i] for i in f) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()),
                        pa.array(flat, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())),
                    ],
                    ["key", "doc_id", "n_words", "spans", "items"],
                )

    return run


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges without overlap, as begin, end, begin, end, ..."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    last = np.append(new[1:], len(begin)) - 1
    return np.stack([begin[new], end[last]], axis=1).ravel()


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Items]:
    """The items in blocks of at most `block_words` words (an item that is longer is a block)."""
    rows, held = [], 0
    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    for name, text in source.toLocalIterator():
        n = len(text or "") // 2 + 1  # at least the number of words
        if rows and held + n > block_words:
            yield Items(rows, window)
            rows, held = [], 0
        rows.append((name, text))
        held += n
    if rows:
        yield Items(rows, window)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: key, doc_id, n_words, spans of hit words (begin, end, ...), items."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes = [source.mapInArrow(_find(items), FOUND) for items in _blocks(benchmark, window, block_words)]
    if not passes:
        passes = [source.mapInArrow(_find(Items([], window)), FOUND)]
    if len(passes) == 1:
        return passes[0]
    rows = passes[0]
    for other in passes[1:]:
        rows = rows.unionByName(other)
    together = rows.groupBy("key", "doc_id", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / len(passes)).cast("int").alias("copies"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return together.withColumn("copy", each).drop("copies", "copy")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        hits, shas, counts = [], [], []
        for spans, items in zip(rows["spans"], rows["items"]):
            pairs = np.array(spans, np.int64).reshape(-1, 2)
            ranges = merged(pairs[:, 0], pairs[:, 1]).reshape(-1, 2) if len(pairs) else pairs
            hits.append(int((ranges[:, 1] - ranges[:, 0]).sum()))
            names = sorted(set(items))
            counts.append(len(names))
            shas.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        columns = [rows["doc_id"], rows["n_words"], hits, counts, shas, [h > 0 for h in hits]]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def report_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, hit words, items with a window in it, and a digest of their ids."""
    return find_contamination(docs, benchmark, window, block_words).mapInArrow(
        _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per document and item with a match of `window` words or the whole item: the longest, and where it is."""

    def matcher(items: Items) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # A document is a shard of its own here, as the longest match of each is asked for.
                for i, doc_id in enumerate(batch.column(0).to_pylist()):
                    shard = Shard(batch.column(1).slice(i, 1), items)
                    if not len(shard.array):
                        continue
                    length, at = shard.longest([words for _, _, words in items.suffixes], items.longest)
                    best: dict[int, tuple] = {}
                    for (item, place, words), n, p in zip(items.suffixes, length, at):
                        if n >= min(window, len(words) + place):
                            best[item] = max(best.get(item, (0,)), (int(n), -int(p), -place))
                    rows = [(doc_id, items.names[k], v[0], -v[1], -v[2]) for k, v in best.items()]
                    if rows:
                        kinds = [pa.int64(), pa.string()] + [pa.int64()] * 3
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                            ["doc_id", "item_id", "length", "doc_word", "item_word"],
                        )

        return run

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = [source.mapInArrow(matcher(items), MATCHES) for items in _blocks(benchmark, window, block_words)]
    out = rows[0] if rows else source.sparkSession.createDataFrame([], MATCHES)
    for other in rows[1:]:
        out = out.unionByName(other)
    return out


def _keep_clean(items: Items, column: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[column], SLICE):
                shard = Shard(part.column(column), items)
                hit = np.zeros(part.num_rows, bool)
                for windows, _ in items.windows.values():
                    _, at = shard.occurrences(windows)
                    hit[np.searchsorted(shard.begin, at, side="right") - 1] = True
                yield part.filter(pa.array(~hit))

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns. Nothing is shuffled."""
    for items in _blocks(benchmark, window, block_words):
        docs = docs.mapInArrow(_keep_clean(items, docs.columns.index("text"), 0), docs.schema)
    return docs
