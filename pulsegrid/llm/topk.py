"""Exact top-k inner products by exhaustive accumulation, term at a time.

Vectors become integers `floor(scale * x)`. Candidates are stored in blocks of columns: for each term (component) the
weights of all candidates of the block. A query is a sparse row of terms. For a block of queries and a block of
candidates, every term scatters query weight times posting weight into a dense array of scores; the best of each
query are selected by partition, and the selections of all blocks are merged.

Blocks of candidates are dealt into groups of bounded size, blocks of queries into groups of their own. Each pair of groups is
a cell: its task holds the candidates, and the queries pass by in blocks. Candidates move once per group of queries, queries once
per group of candidates; the numbers of groups follow from the sizes of both sides, and nothing but these sizes reaches the driver.
Vectors that are null or empty, or hold a null or non-finite component, take no part. Of vectors of different lengths the common
components count. Ties go to the smaller id; a candidate is any row but the query's own, and rows that repeat an id count each as
a candidate for queries with another id. Scores must fit 64 bits, else the query fails. A null id takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm.common import Scratch, partitions, ragged

BLOCK = "ids binary, data binary, terms int, width int"
TOP = "query_row long, query_id long, vec_id long, score long"
_TILE = 64
_UNIT = 256  # candidates that are stored and dealt together
_GROUP = 32 << 20  # bytes of candidates that a task holds
_CELL = 1 << 29  # products that are worth a task of their own
_FOUND = 12  # bytes of a selected row on its way to the merge
_KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def _quantized(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors that take part: ids, lengths, and all components one after the other."""
    lists = batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(scale * pc.cast(lists.flatten(), pa.float64(), safe=False).to_numpy(zero_copy_only=False))  # a null is NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    kept = (lengths > 0) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    kept[row[~np.isfinite(values)]] = False
    ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inside = kept[row]
    values = values[inside]
    beyond = np.abs(values) >= 2.0**62
    if beyond.any():
        raise OverflowError(f"vector {ids[row[inside][beyond.argmax()]]} has components beyond 64 bits")
    return ids[kept], lengths[kept], values.astype(np.int64)


def _packed(ids: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    matrix = np.zeros((len(ids), int(lengths.max())), np.int64)
    matrix[np.repeat(np.arange(len(ids)), lengths), ragged(np.zeros(len(ids), np.int64), lengths)] = values
    most = int(np.abs(matrix).max())
    width = next(w for w in _KINDS if most < 1 << (8 * w - 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.T.astype(_KINDS[width]).tobytes()], pa.binary()),
            pa.array([matrix.shape[1]], pa.int32()), pa.array([width], pa.int32()),
        ],
        ["ids", "data", "terms", "width"],
    )


def _blocks(scale: float, size: int) -> Callable:
    """Blocks of at most `size` vectors: ids, and a matrix of terms by vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lengths = values = np.empty(0, np.int64)
        for batch in batches:
            ids, lengths, values = (np.concatenate(x) for x in zip((ids, lengths, values), _quantized(batch, scale)))
            at = begin = 0
            while len(ids) - at >= size:
                end = begin + int(lengths[at : at + size].sum())
                yield _packed(ids[at : at + size], lengths[at : at + size], values[begin:end])
                at, begin = at + size, end
            ids, lengths, values = ids[at:], lengths[at:], values[begin:]
        if len(ids):
            yield _packed(ids, lengths, values)

    return run


def _numbered(blocks: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Blocks with numbers of their own, which deal them into groups."""
    schema = f"number long, {BLOCK}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            numbers = pa.array(range(number, number + batch.num_rows), pa.int64())
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([numbers, *batch.columns], ["number", *batch.schema.names])

    return scratch.write(blocks.mapInArrow(run, schema), name)


def _matrix(ids: bytes, data: bytes, terms: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, _KINDS[width]).reshape(terms, -1)


def _joined(units: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of about `size` vectors out of smaller ones; missing terms are 0."""
    out, at = [], 0
    while at < len(units):
        end, n = at + 1, len(units[at][0])
        while end < len(units) and n + len(units[end][0]) <= size:
            n += len(units[end][0])
            end += 1
        part = units[at:end]
        matrix = np.zeros((max(len(m) for _, m in part), n), np.result_type(*(m.dtype for _, m in part)))
        left = 0
        for _, m in part:
            matrix[: len(m), left : left + m.shape[1]] = m
            left += m.shape[1]
        out.append((np.concatenate([ids for ids, _ in part]), matrix))
        units[at:end] = [None] * (end - at)  # so that both are not held at once
        at = end
    return out


def select(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids: a partition on the score, then a sort of what can matter."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _most(queries: np.ndarray, candidates: np.ndarray) -> int:
    """What no score of the two blocks exceeds, nor a part of its sum: the greatest sum of a query's weights, times the greatest weight."""
    weights = np.abs(queries.astype(np.int64))
    if len(weights) * int(weights.max(initial=0)) >= 1 << 63:
        weights = weights.astype(object)
    return int(weights.sum(axis=0).max(initial=0)) * int(np.abs(candidates.astype(np.int64)).max(initial=0))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries and candidates of two blocks (terms by vectors), term at a time."""
    terms = min(len(queries), len(candidates))
    most = _most(queries[:terms], candidates[:terms])
    if most >= 1 << 63:
        raise OverflowError("scores beyond 64 bits")
    kind = next(_KINDS[w] for w in (2, 4, 8) if most < 1 << (8 * w - 1))
    scores = np.zeros((queries.shape[1], candidates.shape[1]), kind)
    weights, postings = queries[:terms].astype(kind), candidates[:terms].astype(kind)
    product = np.empty((_TILE, candidates.shape[1]), kind)
    for at in range(0, queries.shape[1], _TILE):
        tile = scores[at : at + _TILE]
        for term in range(terms):
            weight = weights[term, at : at + _TILE]
            if weight.any():
                part = product[: len(tile)]
                np.multiply(weight[:, None], postings[term][None, :], out=part)
                tile += part
    return scores


def _best(q_ids: np.ndarray, q: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k best candidates of every query of a block; of later blocks of candidates only what reaches the k-th score counts."""
    none = np.empty(0, np.int64)
    best = [(none, none)] * len(q_ids)
    least = np.full(len(q_ids), np.iinfo(np.int64).min)
    for c_ids, c in held:
        scores = accumulate(q, c)
        limits = np.iinfo(scores.dtype)
        able = scores >= np.clip(least, limits.min, limits.max).astype(scores.dtype)[:, None]
        able &= q_ids[:, None] != c_ids[None, :]
        for i in np.flatnonzero(able.any(axis=1)):
            places = np.flatnonzero(able[i])
            ids, line = np.concatenate([best[i][0], c_ids[places]]), np.concatenate([best[i][1], scores[i, places].astype(np.int64)])
            found = select(ids, line, k)
            best[i] = ids[found], line[found]
            if len(found) == k:
                least[i] = line[found[-1]]
    return best


def _meet(k: int, block: int) -> Callable:
    """Of every cell first the candidates, which are held, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, units, held = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                ids, matrix = _matrix(row["ids"], row["data"], row["terms"], row["width"])
                if row["cell"] != cell:
                    cell, units, held = row["cell"], [], []
                if not row["asks"]:
                    units.append((ids, matrix))
                    continue
                if units:
                    held, units = _joined(units, block), []
                best = _best(ids, matrix, held, k)
                counts = [len(x) for x, _ in best]
                out = [
                    np.repeat((row["number"] << 16) + np.arange(len(ids)), counts), np.repeat(ids, counts),
                    np.concatenate([x for x, _ in best]), np.concatenate([x for _, x in best]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_row", "query_id", "vec_id", "score"])

    return run


def _size(blocks: DataFrame) -> tuple[int, int, int]:
    """Vectors, bytes and components of all blocks."""
    vectors = F.length("ids") / 8
    row = blocks.agg(F.sum(vectors), F.sum(vectors * F.col("terms") * F.col("width")), F.sum(vectors * F.col("terms"))).first()
    return tuple(int(x or 0) for x in row)


def _grid(held: tuple[int, int, int], asked: tuple[int, int, int], k: int, tasks: int) -> tuple[int, int]:
    """Groups of candidates and of queries: cells for all tasks, and the least moved.

    Candidates move once per group of queries; queries, and the best of each, once per group of candidates.
    """
    cells = max(1, min(2 * tasks, held[2] * asked[0] // _CELL))
    columns = round(math.sqrt(cells * held[1] / max(1, asked[1] + _FOUND * k * asked[0])))
    columns = max(1, min(columns, cells), -(-held[1] // _GROUP))
    return columns, -(-cells // columns)


def exact_top_k(
    vectors: DataFrame, is_query: str, k: int = 20, scale: float = 64.0, block: int = 4096, query_block: int = 512
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row for which `is_query` holds."""
    scratch = Scratch(vectors.sparkSession, "topk")
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = source.where(is_query)
    held = _numbered(source.mapInArrow(_blocks(scale, min(block, _UNIT)), BLOCK), scratch, "candidates")
    asked = _numbered(queries.mapInArrow(_blocks(scale, query_block), BLOCK), scratch, "queries")
    columns, rows = _grid(_size(held), _size(asked), k, partitions(vectors.sparkSession))

    def dealt(blocks: DataFrame, asks: bool) -> DataFrame:
        """A row per cell of the group that a block is in."""
        own, others = (rows, columns) if asks else (columns, rows)
        group, other = F.pmod(F.xxhash64("number"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        parts = blocks.select(other.alias("other"), group.alias("group"), F.lit(asks).alias("asks"), *blocks.columns)
        cell = F.col("other") * rows + F.col("group") if asks else F.col("group") * rows + F.col("other")
        return parts.select(cell.cast("long").alias("cell"), "asks", *blocks.columns)

    # Exchanged by cell: the planner takes a block for one row however many cells it goes to, so no side may be broadcast.
    cells = dealt(held, False).unionByName(dealt(asked, True)).repartition(columns * rows, "cell")
    best = cells.sortWithinPartitions("cell", "asks").mapInArrow(_meet(k, block), TOP)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
