"""Merkle manifest of a dataset: a tree per group of rows and one over the groups, in van Emde Boas layout, with proofs.

1. Leaves. Each row is hashed with all its named columns. Rows are range-partitioned on (group, doc_id) and numbered inside the
   ranges; sizes of earlier ranges make the numbers positions, so a group that holds most rows is spread over many tasks.
2. Blocks. 256 leaves in a row that start at a multiple of 256 are an aligned subtree. Its nodes lie in one array in van Emde Boas
   order: the upper half of the levels first, then each subtree below it, all split again in the same way. Addresses
   come from arithmetic alone, for building and for the siblings of a leaf. Roots of blocks are the leaves of the next layer,
   until a group has one block; the roots of the groups are the leaves of one more tree.
3. Proofs go down again: the path above a block is joined to it once, and each leaf adds the path inside.

A node with one child hashes that child alone; a tree of one leaf is that leaf. Null doc_ids come first, rows with equal doc_ids in the order of
their hashes; rows that repeat all columns are leaves of their own. The null group comes first, others in the order of their bytes.
Empty texts have the length 0, which is not null. Columns that are not named are not used. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.common import Scratch, partitions

HEIGHT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# A step of a proof: where the sibling stands (or that there is none), and its digest.
ALONE, LEFT, RIGHT = 0, 1, 2
STEP = 33


def node_hash(*children: bytes) -> bytes:
    """The digest of digests, concatenated as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def veb_address(depth: np.ndarray, index: np.ndarray, levels: int) -> np.ndarray:
    """Where the nodes `index` of their level `depth` (0 is the root) lie in the array of a full tree of so many levels."""
    if levels == 1:
        return np.zeros(len(depth), np.int64)
    upper = levels // 2
    lower = levels - upper
    out = np.empty(len(depth), np.int64)
    top = depth < upper
    out[top] = veb_address(depth[top], index[top], upper)
    below = depth[~top] - upper
    tree = index[~top] >> below
    inside = veb_address(below, index[~top] & ((1 << below) - 1), lower)
    out[~top] = (1 << upper) - 1 + tree * ((1 << lower) - 1) + inside
    return out


def _layouts(height: int) -> list[list[np.ndarray]]:
    """For trees of 0 to `height` edges from root to leaf, the addresses of the nodes of each level."""
    return [
        [veb_address(np.full(1 << d, d), np.arange(1 << d), edges + 1) for d in range(edges + 1)]
        for edges in range(height + 1)
    ]


def build_block(leaves: Sequence[bytes], layout: list[list[np.ndarray]]) -> bytes:
    """The nodes of an aligned subtree in van Emde Boas order; what is missing at its end is zero."""
    edges = max(0, len(leaves) - 1).bit_length()
    nodes = bytearray(((2 << edges) - 1) * 32)
    level = list(leaves)
    for depth in range(edges, -1, -1):
        for address, digest in zip(layout[edges][depth].tolist(), level):
            nodes[32 * address : 32 * address + 32] = digest
        level = [node_hash(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return bytes(nodes)


def block_path(nodes: bytes, index: int, size: int, layout: list[list[np.ndarray]]) -> bytes:
    """The steps from a leaf of a block of `size` leaves to the block's root."""
    out = []
    edges = max(0, size - 1).bit_length()
    for depth in range(edges, 0, -1):
        sibling = index ^ 1
        if sibling < size:
            address = 32 * int(layout[edges][depth][sibling])
            out.append(bytes([LEFT if index & 1 else RIGHT]) + nodes[address : address + 32])
        else:
            out.append(bytes(STEP))
        index, size = index >> 1, (size + 1) >> 1
    return b"".join(out)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for at in range(0, len(path), STEP):
        side, sibling = path[at], path[at + 1 : at + STEP]
        leaf = node_hash(leaf) if side == ALONE else node_hash(sibling, leaf) if side == LEFT else node_hash(leaf, sibling)
    return leaf


def proof_digest(path: bytes) -> str:
    """The digest of all siblings of a path."""
    siblings = [path[at + 1 : at + STEP].hex() for at in range(0, len(path), STEP) if path[at] != ALONE]
    return hashlib.sha256("".join(siblings).encode()).hexdigest()


def encoded(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns]), 256))


_NUMBERED = "tree string, id long, leaf binary, tampered binary, range int, k long"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in their order, numbered within each tree."""
    number, tree, k = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        trees = batch.column(0).to_pylist()
        ks = []
        for name in trees:
            k = k + 1 if name == tree else 0
            tree = name
            ks.append(k)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([number] * len(ks), pa.int32()), pa.array(ks, pa.int64())], [p.split()[0] for p in _NUMBERED.split(", ")]
        )


def _placed(ordered: DataFrame, k: Column) -> DataFrame:
    """Positions and the size of the tree, from numbers `k` inside ranges that lie in order."""
    # One row for each range, and one for each tree that begins inside a range.
    parts = ordered.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy("tree")
    before = F.sum("size").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("tree", "range", F.coalesce(before, F.lit(0)).alias("start"), F.sum("size").over(own).alias("total"))
    return ordered.join(starts, ["tree", "range"]).withColumn("pos", F.col("start") + k)


def positions(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """tree, pos, total (leaves of the tree), id, leaf, tampered of rows (tree, id, leaf, tampered, row) in the order of id and leaf."""
    order = ["tree", F.col("id").asc_nulls_first(), "leaf", "row"]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ordered = scratch.write(ranged.select("tree", "id", "leaf", "tampered").mapInArrow(_number, _NUMBERED), name)
    return _placed(ordered, F.col("k")).select("tree", "pos", "total", "id", "leaf", "tampered")


def positions_by_name(roots: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The same for the roots (name, root) of trees, as leaves of one tree in the order of their names."""
    ranged = roots.repartitionByRange(partitions(roots.sparkSession), "name").sortWithinPartitions("name")
    number = [F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("k")]
    ordered = scratch.write(ranged.select("*", F.lit("").alias("tree"), *number), name)
    none = F.lit(None)
    return _placed(ordered, F.col("k").bitwiseAND((1 << 33) - 1)).select(
        "tree", "pos", "total", none.cast("long").alias("id"), F.col("root").alias("leaf"), none.cast("binary").alias("tampered"), "name"
    )


_BLOCK = "tree string, block long, total long, size int, nodes binary, root binary, ids array<bigint>, tampered array<binary>"


def _blocks(height: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = _layouts(height)
        for batch in batches:
            out = []
            for tree, block, total, items in zip(*(c.to_pylist() for c in batch.columns)):
                leaves = [item["leaf"] for item in items]
                nodes = build_block(leaves, layout)
                root = nodes[:32]
                # Beside other blocks a short one is as high as they are.
                for _ in range(height - max(0, len(leaves) - 1).bit_length() if total > 1 << height else 0):
                    root = node_hash(root)
                out.append((tree, block, total, len(leaves), nodes, root, [item["id"] for item in items], [item["tampered"] for item in items]))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
            columns = list(zip(*out)) if out else [[]] * 8
            names = ["tree", "block", "total", "size", "nodes", "root", "ids", "tampered"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def build_forest(placed: DataFrame, scratch: Scratch, name: str, height: int = HEIGHT) -> list[DataFrame]:
    """The layers of blocks of all trees, from the leaves up; placed: tree, pos, total, id, leaf, tampered."""
    layers, width = [], 1 << height
    while True:
        block = F.shiftright("pos", height).alias("block")
        rows = placed.select("tree", block, "total", F.struct("pos", "id", "leaf", "tampered").alias("item"))
        grouped = rows.groupBy("tree", "block").agg(F.first("total").alias("total"), F.sort_array(F.collect_list("item")).alias("items"))
        layer = scratch.write(grouped.mapInArrow(_blocks(height), _BLOCK), f"{name}-{len(layers)}")
        layers.append(layer)
        if (layer.agg(F.max("total")).first()[0] or 0) <= width:
            return layers
        none = F.lit(None)
        placed = layer.where(f"total > {width}").select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("total") / width).cast("long").alias("total"),
            none.cast("long").alias("id"), F.col("root").alias("leaf"), none.cast("binary").alias("tampered"),
        )


def forest_roots(layers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """name, root, layer: of each tree the root of its highest block, which is its only one on that layer."""
    tops = [layer.where(f"total <= {1 << height}").select(F.col("tree").alias("name"), "root", F.lit(i).alias("layer")) for i, layer in enumerate(layers)]
    out = tops[0]
    for layer in tops[1:]:
        out = out.unionByName(layer)
    return out


def _lift(size: int, height: int, topmost: bool) -> bytes:
    return b"" if topmost else bytes(STEP) * (height - max(0, size - 1).bit_length())


_OPEN = ("tree", "block", "size", "nodes", "above", "topmost", "subroot")
_PATHS = "tree string, pos long, path binary, subroot binary"


def _paths(height: int) -> Callable:
    """The paths of the leaves of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = _layouts(height)
        for batch in batches:
            for tree, block, size, nodes, above, topmost, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                rest = _lift(size, height, topmost) + above
                paths = [block_path(nodes, i, size, layout) + rest for i in range(size)]
                columns = [[tree] * size, [(block << height) + i for i in range(size)], paths, [subroot] * size]
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "pos", "path", "subroot"])

    return run


_PROOFS = "id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def _proofs(height: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = _layouts(height)
        for batch in batches:
            for size, nodes, above, topmost, ids, tampered, subroot in zip(*(c.to_pylist() for c in batch.columns)):
                rest = _lift(size, height, topmost) + above
                edges = max(0, size - 1).bit_length()
                rows = []
                for i in range(size):
                    path = block_path(nodes, i, size, layout) + rest
                    at = 32 * int(layout[edges][edges][i])
                    leaf = nodes[at : at + 32]
                    rows.append((ids[i], leaf.hex(), subroot.hex(), proof_digest(path), fold(tampered[i] or leaf, path).hex()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), *[pa.string()] * 4])], [p.split()[0] for p in _PROOFS.split(", ")]
                )

    return run


def walk_down(layers: list[DataFrame], ends: DataFrame, scratch: Scratch, name: str, height: int) -> DataFrame:
    """The blocks of the lowest layer with the path above each; ends: tree, layer (of its highest block), end (the path above its root), subroot."""
    inner = None
    for number in range(len(layers) - 1, -1, -1):
        own = ends.where(F.col("layer") == number)
        above = own.select("tree", F.lit(0).cast("long").alias("block"), F.col("end").alias("above"), "subroot", F.lit(True).alias("topmost"))
        if inner is not None:
            rest = inner.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot", F.lit(False).alias("topmost"))
            above = above.unionByName(rest)
        # One row for each block on both sides.
        blocks = layers[number].join(above, ["tree", "block"])
        if not number:
            return blocks
        inner = scratch.write(blocks.select(*_OPEN).mapInArrow(_paths(height), _PATHS), f"{name}-{number}")


def write_manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", height: int = HEIGHT,
                   tamper: tuple[str, Column] | None = None) -> tuple[DataFrame, bytes | None]:
    """(doc_id, leaf, subroot, proof_sha256, folded_root of every row; the root), all digests as hex text.

    `tamper` is a column and a condition: rows where it holds are folded from a leaf whose column is one more.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    plain = [F.col(c) for c in columns]
    changed = F.lit(None).cast("binary")
    if tamper:
        name, where = tamper
        other = [F.col(c) + 1 if c == name else F.col(c) for c in columns]
        changed = F.when(where & F.col(name).isNotNull(), leaf_hash(other))
    # The null group has the empty name, so it comes first.
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree")
    row = F.monotonically_increasing_id().alias("row")
    leaves = docs.select(tree, F.col("doc_id").cast("long").alias("id"), leaf_hash(plain).alias("leaf"), changed.alias("tampered"), row)
    layers = build_forest(positions(scratch.write(leaves, "leaves"), scratch, "ordered"), scratch, "blocks", height)

    subroots = scratch.write(forest_roots(layers, height), "subroots")
    placed = scratch.write(positions_by_name(subroots.select("name", "root"), scratch, "ordered-subroots"), "placed-subroots")
    top = build_forest(placed.drop("name"), scratch, "top", height)
    first = forest_roots(top, height).first()
    if first is None:
        return spark.createDataFrame([], _PROOFS.replace("id", "doc_id", 1)), None
    root = bytes(first["root"])

    nothing = [("", len(top) - 1, b"", b"")]
    highest = spark.createDataFrame(nothing, "tree string, layer int, end binary, subroot binary")
    paths = walk_down(top, highest, scratch, "top-paths", height).select(*_OPEN).mapInArrow(_paths(height), _PATHS)
    ends = placed.select("pos", "name").join(paths.select("pos", F.col("path").alias("end")), "pos").join(subroots, "name")
    ends = scratch.write(ends.select(F.col("name").alias("tree"), "layer", "end", F.col("root").alias("subroot")), "ends")
    blocks = walk_down(layers, ends, scratch, "paths", height).select("size", "nodes", "above", "topmost", "ids", "tampered", "subroot")
    return blocks.mapInArrow(_proofs(height), _PROOFS).withColumnRenamed("id", "doc_id"), root
