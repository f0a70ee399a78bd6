"""Deletion of later repeated runs of lines, found through winnowed fingerprints.

The lines of a document that hold a word are a sequence of hashes; other lines always stay. A window is the shortest run of
lines from a line on that has `words` words or more, and selects the smallest line hash in it. The selected lines, each once,
are the document's fingerprints: documents that share `words` words in whole lines share one, and that is guaranteed. Only fingerprints
are joined; those that stand in one place drop out.

Around each place of a repeated fingerprint the match is extended both ways: through the windows that selected it, and through the
shortest runs of `words` words that end at a line and begin where such a window begins. Both kinds are compared whole, and of
equal ones all but the first, in the order of (doc_id, line), are deleted with all their lines. Together they cover maximal runs: a line
of a repeated run lies in the window from the run's start or in the shortest run that ends at the line, each of which lies in
the run. So a line goes exactly if it lies in a run of `words` words or more that stands earlier in the same or another document. Runs are
judged on the input. No pairs of places are made: a group of equal runs is reduced to its first place before it moves.

Null and empty texts have no lines and stay as they are. Null ids come first; rows with equal ids are in the order of a
digest of their texts, and rows that repeat both id and text count as one and stay alike. Columns other than doc_id and text are carried along.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegrid.llm.common import Scratch, row_key, text_bytes

WORDS = 50
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LINES = "key binary, id long, line array<int>, n array<int>, hashes binary"
PRINTS = "key binary, mark long, spot int"
RUNS = "key binary, id long, line int, last int, content binary"
_SIZE = 16


def solid_lines(raw: bytes) -> tuple[list[int], list[int], bytes]:
    """Numbers, counts of words and hashes, one after the other, of the lines of a text that hold a word."""
    lines = raw.split(b"\n")
    counts = [len(_WORD.findall(line)) for line in lines]
    at = [i for i, n in enumerate(counts) if n]
    return at, [counts[i] for i in at], b"".join(xxhash.xxh3_128_digest(lines[i]) for i in at)


def select_lines(counts: list[int], hashes: bytes, words: int) -> tuple[list[int], list[int], np.ndarray]:
    """(end of the window from each line on, the line that it selects, marks of all lines); lines count from 0, lines too near the end have no
    window."""
    sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    ends = np.searchsorted(sums, sums[:-1] + words).tolist()
    ends = [end for end in ends if end <= len(counts)]
    marks = np.frombuffer(hashes, "<i8")[::2]
    held = marks.tolist()
    spots: list[int] = []
    queue: deque[int] = deque()
    at = 0
    for i, end in enumerate(ends):
        # The last one among equal smallest hashes; ends never fall.
        for k in range(at, end):
            while queue and held[queue[-1]] >= held[k]:
                queue.pop()
            queue.append(k)
        at = end
        while queue[0] < i:
            queue.popleft()
        spots.append(queue[0])
    return ends, spots, marks


def runs_around(counts: list[int], hashes: bytes, words: int, chosen: set[int]) -> Iterator[tuple[int, int, bytes]]:
    """(first line, end, digest) of the windows that select one of the chosen lines, and of the shortest runs that end at a line and begin
    with such a window."""
    ends, spots, _ = select_lines(counts, hashes, words)
    spans = {(i, end) for i, (end, spot) in enumerate(zip(ends, spots)) if spot in chosen}
    sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    begins = (np.searchsorted(sums, sums[1:] - words, side="right") - 1).tolist()
    spans.update((i, end) for end, i in enumerate(begins, 1) if i >= 0 and spots[i] in chosen)
    for i, end in sorted(spans):
        yield i, end, xxhash.xxh3_128_digest(hashes[i * _SIZE : end * _SIZE])


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    arrays = [pa.array(column, kinds[kind]) for column, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = text_bytes(text)
            rows.append((row_key(doc_id, raw), doc_id, *solid_lines(raw)))
        yield _table(rows, LINES)


def _prints(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, counts, hashes in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "hashes"))):
                _, spots, marks = select_lines(counts, hashes, words)
                rows += [(key, int(marks[spot]), spot) for spot in dict.fromkeys(spots)]
            yield _table(rows, PRINTS)

    return run


def _extend(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "id", "line", "n", "hashes", "spots"))
            for key, doc_id, line, counts, hashes, spots in zip(*columns):
                for i, end, content in runs_around(counts, hashes, words, set(spots)):
                    rows.append((key, doc_id, line[i], line[end - 1], content))
            yield _table(rows, RUNS)

    return run


def _key(names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "text"))
            keys = [row_key(i, text_bytes(t)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names)

    return run


def _delete(key: str, found: str) -> Callable:
    """Deletes lines of the given runs; adds what became of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, counts, gone = [], [], []
            for text, later in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index(found)).to_pylist()):
                raw = text_bytes(text)
                lines = raw.split(b"\n") if raw else []
                drop = set()
                for run_of in later or ():
                    # Lines without a word between deleted ones stay.
                    drop.update(i for i in range(run_of["line"], run_of["last"] + 1) if i not in drop and _WORD.search(lines[i]))
                counts.append(len(lines))
                gone.append(len(drop))
                kept = b"\n".join(line for i, line in enumerate(lines) if i not in drop)
                texts.append(text if not drop else kept.decode("utf-8", "surrogatepass"))
            names = [n for n in batch.schema.names if n not in (key, found)]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed"]
            )

    return run


def fingerprints(lines: DataFrame, words: int = WORDS) -> DataFrame:
    """key, mark, spot: the lines that windows select, each once, from a table of `LINES`."""
    return lines.select("key", "n", "hashes").mapInArrow(_prints(words), PRINTS)


def later_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """key, line, last: runs that stand earlier too; together they cover the later places of all maximal repeated runs."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.write(source.mapInArrow(_lines, LINES), "lines")
    prints = scratch.write(fingerprints(lines, words), "prints")
    spot = F.struct("key", "spot")
    marks = prints.groupBy("mark").agg(F.min(spot).alias("low"), F.max(spot).alias("high"))
    chosen = prints.join(marks.where("low <> high").select("mark"), "mark").groupBy("key").agg(F.collect_set("spot").alias("spots"))
    runs = scratch.write(lines.join(chosen, "key").mapInArrow(_extend(words), RUNS), "runs")
    place = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "key", "line")
    firsts = runs.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.where("first <> last").select("content", "first")
    later = runs.join(firsts, "content").where(~place.eqNullSafe(F.col("first")))
    return later.select("key", "line", "last").distinct()


def delete_repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with what is left of their texts, and n_lines, n_removed (these replace columns of such names)."""
    docs = docs.drop("n_lines", "n_removed")
    key, found = "__line_key", "__line_found"
    keyed_schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])
    keyed = docs.mapInArrow(_key([*docs.columns, key]), keyed_schema)
    runs = later_runs(docs, words).groupBy("key").agg(F.collect_list(F.struct("line", "last")).alias(found))
    later = runs.withColumnRenamed("key", key)
    both = keyed.join(later, key, "left")
    more = [T.StructField(name, T.LongType()) for name in ("n_lines", "n_removed")]
    schema = T.StructType([*docs.schema.fields, *more])
    return both.mapInArrow(_delete(key, found), schema)

