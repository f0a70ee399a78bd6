"""Prefix trie of conversations: which sequences of turns conversations share, and what sharing saves.

1. A turn becomes an id of 120 bits, a digest of its role and text, and the length of its text; texts move no further. Turns of a conversation
   are collected in order.
2. Shards. Conversations are range-partitioned and sorted on their whole sequence of ids and on conv_id, so a first
   turn, and even a conversation, that a third of all have is spread over many shards. A shard is cut into blocks of bounded cells.
3. Blocks. Ids are ranked and padded to a matrix, sorted with lexsort. Where an id differs from the row above, a mask is
   set; ORed along the columns it marks where nodes start, at every depth at once, and reduceat over all of it gives their members.
   Sums over subtrees are differences of running sums in the order of the nodes (row, then depth).
4. Boundaries. Only the prefixes of the first and last row of a block can go on in others. They are kept as parts,
   recombined by the digest of their path, and their subtree sums come from running sums over blocks, from the block where
   a node starts to the one where it ends.

Turns with a null number come first; turns with equal numbers stand in the order of their digests, repeated rows count each. A
null role or text is empty. Rows without conv_id belong to no conversation. Empty texts are turns that save nothing. A conversation must fit in a task, without its
texts. Other columns are not used. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.common import Scratch, partitions

CELLS = 1 << 20
ROWS = 1 << 16
PIECE = 2048

_FIELDS = [
    ("kind", pa.int32()), ("block", pa.int64()), ("path", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved", pa.int64()), ("n_bytes", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("leaves_before", pa.int64()),
    ("leaves_end", pa.int64()), ("saved_before", pa.int64()), ("saved_end", pa.int64()), ("ends", pa.string()),
]
_NAMES = [name for name, _ in _FIELDS]
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
SCHEMA = ", ".join(f"{name} {_SQL[kind]}" for name, kind in _FIELDS)
# Whole nodes; parts of nodes on the borders of blocks; pieces of the conversations that end at such nodes; sums of blocks.
NODE, PART, ENDS, TOTAL = 0, 1, 2, 3


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: of every conversation its turns in order, each as hi, lo (of the digest) and n_bytes."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "hi"), (16, "lo"))]
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", *halves, F.octet_length(text).alias("n_bytes")).alias("t")
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["hi"], t["lo"], t["n_bytes"])).alias("turns"))


def branched(turns: DataFrame, base: Column, shared: Column, longest: int) -> DataFrame:
    """Conversations rebuilt: the first `shared` turns of conversation `base`, then the own ones after so many; `shared` is `longest` at most."""
    heads = turns.select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, longest).alias("head"))
    own = turns.withColumn("head_id", base).withColumn("n_head", shared)
    both = own.join(heads, "head_id", "left")
    tail = F.slice("turns", F.col("n_head") + 1, F.greatest(F.size("turns") - F.col("n_head"), F.lit(0)))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("n_head")))
    return both.select("conv_id", F.concat(head, tail).alias("turns"))


def _paths(hi: np.ndarray, lo: np.ndarray) -> list[bytes]:
    """The digests of all prefixes of a row, the empty one first."""
    state, out = xxhash.xxh3_128(), [b""]
    for pair in np.stack([hi, lo], axis=1):
        state.update(pair.tobytes())
        out.append(state.digest())
    return out


def analyse(convs: np.ndarray, lengths: np.ndarray, hi: np.ndarray, lo: np.ndarray, sizes: np.ndarray, block: int) -> Iterator[dict]:
    """Columns of the nodes, parts, pieces and sums of a block of conversations; ids of turns are given one row after the other."""
    n, deepest = len(convs), int(lengths.max())
    pairs = np.stack([hi, lo], axis=1).astype(np.int64)
    order = np.lexsort((lo, hi))
    ranked = pairs[order]
    rank = np.empty(len(hi), np.int64)
    rank[order] = np.cumsum(np.append(False, (ranked[1:] != ranked[:-1]).any(axis=1))) if len(hi) else 0
    starts = np.cumsum(lengths) - lengths
    row, col = np.repeat(np.arange(n), lengths), np.arange(len(hi)) - np.repeat(starts, lengths)
    # Column 0 stands for the root, which all rows share; -1 pads.
    ids, size = np.full((n, deepest + 1), -1, np.int64), np.zeros((n, deepest + 1), np.int64)
    ids[:, 0] = 0
    ids[row, col + 1], size[row, col + 1] = rank, sizes
    # Beyond the second longest row there is nothing to compare.
    compared = int(np.partition(lengths, -2)[-2]) if n > 1 else 0
    order = np.lexsort((convs, *(ids[:, c] for c in range(min(compared + 1, deepest), 0, -1))))
    ids, size, convs, lengths = ids[order], size[order], convs[order], lengths[order]

    change = np.ones(ids.shape, bool)
    change[1:] = ids[1:] != ids[:-1]
    change[1:] = np.logical_or.accumulate(change[1:], axis=1)
    # Runs of equal prefixes at every depth, one depth after the other.
    flat = np.flatnonzero(change.T.ravel())
    depth, begin = flat // n, flat % n
    end = np.append(flat[1:], n * (deepest + 1)) - depth * n
    members = np.minimum.reduceat(np.broadcast_to(convs, (deepest + 1, n)).ravel(), flat)
    here = (ids.T.ravel() >= 0)[flat]
    ending = np.add.reduceat((np.arange(deepest + 1)[:, None] == lengths[None, :]).ravel().astype(np.int64), flat)[here]
    depth, begin, end, members = depth[here], begin[here], end[here], members[here]
    n_bytes = size[begin, depth]
    counts = end - begin
    open_ = (begin == 0) | (end == n)

    # Children of each node that start in this block: whole ones here, those on the borders are counted where parts meet.
    children = np.zeros(len(depth), np.int64)
    parent = np.searchsorted(depth * n + begin, (depth - 1) * n + begin, side="right") - 1
    whole = np.flatnonzero(~open_)
    np.add.at(children, parent[whole], 1)

    # Running sums over whole nodes in the order of (row, depth).
    leaf = np.where(open_, 0, children == 0).astype(np.int64)
    saved = np.where(open_, 0, (counts - 1) * n_bytes)
    sorted_ = np.lexsort((depth, begin))
    place = np.empty(len(depth), np.int64)
    place[sorted_] = np.arange(len(depth))
    after = np.searchsorted(begin[sorted_], end)  # the first node that starts in a later row than all members
    sums = {}
    for name, values in (("leaves", leaf), ("saved", saved)):
        running = np.append(0, np.cumsum(values[sorted_]))
        sums[name] = running[place], running[after], int(running[-1])

    def text(i: int, piece: slice) -> str:
        return ",".join(map(str, convs[begin[i] : begin[i] + ending[i]][piece].tolist()))

    none = hashlib.sha256(b"").hexdigest()
    inner = [slice(starts[order[at]], starts[order[at]] + lengths[at]) for at in (0, n - 1)]
    borders = [_paths(hi[own], lo[own]) for own in inner]
    paths = {int(i): borders[0 if begin[i] == 0 else 1][depth[i]] for i in np.flatnonzero(open_)}
    above = parent[whole]
    yield {
        "kind": np.full(len(whole), NODE), "block": np.full(len(whole), block), "depth": depth[whole], "conv_id": members[whole],
        "parent": [paths.get(int(p)) for p in above], "parent_conv_id": members[above], "n_convs": counts[whole],
        "n_children": children[whole], "n_leaves": (sums["leaves"][1] - sums["leaves"][0])[whole],
        "saved": (sums["saved"][1] - sums["saved"][0])[whole],
        "ends": [hashlib.sha256(text(i, slice(None)).encode()).hexdigest() if ending[i] else none for i in whole],
    }
    parts = np.flatnonzero(open_)
    yield {
        "kind": np.full(len(parts), PART), "block": np.full(len(parts), block), "path": [paths[i] for i in parts.tolist()],
        "parent": [paths.get(p) for p in parent[parts].tolist()], "depth": depth[parts], "conv_id": members[parts],
        "n_convs": counts[parts], "n_children": children[parts], "n_bytes": n_bytes[parts], "begin": begin[parts], "end": end[parts],
        "leaves_before": sums["leaves"][0][parts], "leaves_end": sums["leaves"][1][parts],
        "saved_before": sums["saved"][0][parts], "saved_end": sums["saved"][1][parts],
    }
    pieces = [(paths[i], at, text(i, slice(at, at + PIECE))) for i in parts.tolist() for at in range(0, int(ending[i]), PIECE)]
    yield {
        "kind": np.full(len(pieces), ENDS), "block": np.full(len(pieces), block), "path": [p[0] for p in pieces],
        "begin": [p[1] for p in pieces], "ends": [p[2] for p in pieces],
    }
    yield {"kind": [TOTAL], "block": [block], "n_leaves": [sums["leaves"][2]], "saved": [sums["saved"][2]]}


def _nodes(cells: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        n = deepest = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n, deepest, number
            columns = [np.concatenate(part) for part in zip(*held)]
            for found in analyse(*columns, number):
                size = len(found["kind"])
                if size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[name], kind) if name in found else pa.nulls(size, kind) for name, kind in _FIELDS], _NAMES
                    )
            held.clear()
            number, n, deepest = number + 1, 0, 0

        for batch in batches:
            convs, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = lists.value_lengths().to_numpy().astype(np.int64)
            starts = np.append(0, np.cumsum(lengths))
            hi, lo, sizes = (part.to_numpy(zero_copy_only=False).astype(np.int64) for part in lists.flatten().flatten())
            begin = 0
            while begin < len(convs):
                # As many rows as keep the matrix within its cells, one at least.
                widest = np.maximum(np.maximum.accumulate(lengths[begin : begin + rows]), deepest) + 1
                fits = int(np.searchsorted((n + 1 + np.arange(len(widest))) * widest, cells, side="right"))
                fits = min(fits, rows - n) or (0 if n else 1)
                if fits:
                    own, inner = slice(begin, begin + fits), slice(starts[begin], starts[begin + fits])
                    held.append((convs[own], lengths[own], hi[inner], lo[inner], sizes[inner]))
                    n, deepest, begin = n + fits, int(widest[fits - 1]) - 1, begin + fits
                if begin < len(convs):
                    yield from flush()
        if held:
            yield from flush()

    return run


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, ends: the digest of the texts of a path's pieces, which come in order."""
    at, state = None, None
    for batch in batches:
        done = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if path != at:
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = path, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield _digests(done)
    if state is not None:
        yield _digests([(at, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["path", "ends"])


def _running(rows: DataFrame, values: list[str]) -> DataFrame:
    """block and, for each value, its sum over all earlier blocks; first within the shards, then over them."""
    shard = F.shiftright("block", 32)
    sums = rows.groupBy("block").agg(*[F.sum(v).alias(v) for v in values]).withColumn("shard", shard)
    shards = sums.groupBy("shard").agg(*[F.sum(v).alias(v) for v in values])
    before = lambda v, order: F.coalesce(F.sum(v).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = shards.select("shard", *[before(v, Window.orderBy("shard")).alias(f"{v}_shard") for v in values])
    inside = Window.partitionBy("shard").orderBy("block")
    within = sums.select("shard", "block", *[before(v, inside).alias(v) for v in values])
    return within.join(above, "shard").select("block", *[(F.col(v) + F.col(f"{v}_shard")).alias(v) for v in values])


def recombine(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The nodes on borders of blocks, whole again; and for each block the paths there with the smallest member."""
    parts = found.where(f"kind = {PART}")
    start, stop = F.struct("block", "begin", "leaves_before", "saved_before"), F.struct("block", "end", "leaves_end", "saved_end")
    merged = parts.groupBy("path").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"), F.min(start).alias("start"), F.max(stop).alias("stop"),
    )
    merged = scratch.write(merged, "merged")
    outer = merged.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("outer_children")).where("path IS NOT NULL")
    nodes = merged.join(outer, "path", "left").withColumn("n_children", F.col("inner_children") + F.coalesce("outer_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes"))
    nodes = scratch.write(nodes, "border-nodes")

    # Running sums over the border nodes in the order of (block, row, depth); ends of nodes ask for the sum before their row.
    starts = nodes.select("path", F.col("start.block").alias("block"), F.col("start.begin").alias("row"), "depth", "leaf", "own")
    asked = nodes.select("path", F.col("stop.block").alias("block"), F.col("stop.end").alias("row"), F.lit(-1).cast("long").alias("depth"))
    events = starts.unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy("block").orderBy("row", "depth", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.coalesce(F.sum(v).over(order), F.lit(0)) - F.coalesce(v, F.lit(0)) for v in ("leaf", "own")]
    inside = events.select("path", "block", "depth", sums[0].alias("leaf"), sums[1].alias("own"))
    totals = found.where(f"kind = {TOTAL}").select("block", F.col("n_leaves").alias("leaves"), "saved", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("own"))
    opened = starts.select("block", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "leaf", "own")
    before = scratch.write(_running(totals.unionByName(opened), ["leaves", "saved", "leaf", "own"]), "before-blocks")
    at = inside.join(before.select("block", F.col("leaf").alias("leaf_b"), F.col("own").alias("own_b"), "leaves", "saved"), "block")
    at = at.select("path", (F.col("depth") < 0).alias("stops"), (F.col("leaf") + F.col("leaf_b") + F.col("leaves")).alias("leaves"),
                   (F.col("own") + F.col("own_b") + F.col("saved")).alias("saved"))
    spans = at.groupBy("path").agg(
        *[F.sum(F.when(F.col("stops"), F.col(v)).otherwise(-F.col(v))).alias(f"{v}_span") for v in ("leaves", "saved")]
    )
    pieces = found.where(f"kind = {ENDS}").select("path", "ends", "block", "begin").repartition("path").sortWithinPartitions("path", "block", "begin")
    ends = pieces.select("path", "ends").mapInArrow(_digest_pieces, "path binary, ends string")
    parents = merged.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(spans, "path").join(ends, "path", "left").join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_span") + F.col("stop.leaves_end") - F.col("start.leaves_before")).alias("n_leaves"),
        (F.col("saved_span") + F.col("stop.saved_end") - F.col("start.saved_before")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    smallest = parts.select("block", F.col("path").alias("parent")).join(parents, "parent")
    return whole, smallest


def prefix_trie(rebuilt: DataFrame, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """The nodes of conversations (conv_id, turns as hi, lo and n_bytes)."""
    spark = rebuilt.sparkSession
    scratch = Scratch(spark, "trie")
    source = scratch.write(rebuilt, "conversations")
    key = [F.transform("turns", lambda t: F.struct(t["hi"], t["lo"])), F.col("conv_id")]
    shards = source.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key)
    found = scratch.write(shards.mapInArrow(_nodes(cells, rows), SCHEMA), "nodes")
    borders, smallest = recombine(found, scratch)
    whole = found.where(f"kind = {NODE}").select(
        "block", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"
    )
    inside = whole.where("parent IS NULL")
    # The parent of a node may go on in other blocks, where its smallest member is.
    named = whole.where("parent IS NOT NULL").drop("parent_conv_id").join(smallest, ["block", "parent"])
    both = inside.unionByName(named).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )
    return both.unionByName(borders)
