"""Exact deduplication of documents against immutable snapshots, screened by binary-fuse filters.

Documents come in batches, here ranges of doc_id. Equal texts are identical after every run of `[\\x20\\x09-\\x0D]` became one space.

1. New batches. Digests (SHA-256) of a batch are grouped on their own: a count and the first row of each, combined before they
   move, so thousands of copies are one row from here on.
2. Snapshots. The distinct digests of a batch are its snapshot, which never changes. They are spread over buckets by
   hash; a static binary-fuse filter of 8 bits a key stands for each bucket of each snapshot.
3. Screening. The digests of a batch meet the filters of all earlier snapshots in their bucket. What no filter knows is new.
4. Exact buckets. Positives are joined with the digests of their snapshot, which removes the filter's errors.
5. Bytes. The texts of all digests that stand in several rows are fetched and grouped by digest and text. A digest with one text
   is settled; rows of digests with several texts are told apart by the texts themselves.

A null text is empty. Null doc_ids stand after all others and form no group of their own. Of rows that repeat both doc_id and
text one is kept. Columns other than doc_id and text are not used, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.common import Scratch, partitions
from pulsegrid.llm.words import mixed

BATCHES = 4
BUCKET_KEYS = 200_000
BROADCAST_ROWS = 300_000
SALTS = 64


class Fuse(NamedTuple):
    """A 3-wise binary-fuse filter: segments of a power of two in length, one byte a cell."""

    seed: int
    length: int
    segments: int
    prints: np.ndarray


def _cells(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(three cells in segments that follow each other, fingerprint) of each key."""
    h = mixed(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    mask, step = np.uint64(length - 1), np.uint64(length)
    second = (first + step) ^ ((h >> np.uint64(18)) & mask)
    third = (first + step + step) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> Fuse:
    """The filter of distinct 64-bit keys. Cells that one key alone falls on are peeled off in rounds, all of a round at once."""
    n = len(keys)
    length = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))))
    segments = max(1, -(-room // length) - 2)
    for attempt in range(1, 100):
        seed = attempt * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        cells, marks = _cells(keys, seed, length, segments)
        size = (segments + 2) * length
        load = np.bincount(cells.ravel(), minlength=size)
        # The sum of the keys' numbers on a cell names the key where only one is left.
        names = np.bincount(cells.ravel(), np.repeat(np.arange(n), 3), size).astype(np.int64)
        order, alone = [], np.flatnonzero(load == 1)
        while len(alone):
            key, at = np.unique(names[alone], return_index=True)
            order.append((key, alone[at]))
            touched = cells[key].ravel()
            np.subtract.at(load, touched, 1)
            np.subtract.at(names, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            alone = touched[load[touched] == 1]
        if sum(len(key) for key, _ in order) == n:
            prints = np.zeros(size, np.uint8)
            for key, at in reversed(order):
                prints[at] = marks[key] ^ np.bitwise_xor.reduce(prints[cells[key]], axis=1)
            return Fuse(seed, length, segments, prints)
        if attempt % 10 == 0:
            segments += 1
    raise ValueError("keys are not distinct")


def in_fuse(fuse: Fuse, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter knows: all it was built of, and one in 256 of the others."""
    cells, marks = _cells(keys, fuse.seed, fuse.length, fuse.segments)
    return np.bitwise_xor.reduce(fuse.prints[cells], axis=1) == marks


def _keys(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    raw = b"".join(d[:8] for d in digests.to_pylist())
    return np.frombuffer(raw, np.uint64)


def _runs(bucket: np.ndarray, batch: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(batch) != 0)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)])


_FILTERS = "bucket int, batch int, seed decimal(20,0), length int, segments int, prints binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter for each run of rows with the same bucket and batch."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}

    def flush(key: tuple[int, int]) -> pa.RecordBatch:
        fuse = build_fuse(np.unique(np.concatenate(held.pop(key))))
        columns = [[key[0]], [key[1]], [Decimal(fuse.seed)], [fuse.length], [fuse.segments], [fuse.prints.tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.decimal128(20, 0), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], _names(_FILTERS))

    for rows in batches:
        if not rows.num_rows:
            continue
        bucket, batch, keys = rows.column(0).to_numpy(), rows.column(1).to_numpy(), _keys(rows.column(2))
        for begin, end in _runs(bucket, batch):
            key = (int(bucket[begin]), int(batch[begin]))
            for done in [k for k in held if k != key]:
                yield flush(done)
            held.setdefault(key, []).append(keys[begin:end])
    for done in list(held):
        yield flush(done)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def build_filters(buckets: DataFrame) -> DataFrame:
    """A filter for each bucket and batch of (bucket, batch, digest)."""
    sorted_ = buckets.select("bucket", "batch", "digest").repartition("bucket").sortWithinPartitions("bucket", "batch")
    return sorted_.mapInArrow(_build, _FILTERS)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, batch, snapshot) for the filters of earlier batches that know a digest; a bucket's filters come before its digests."""
    at, filters = None, []
    for rows in batches:
        if not rows.num_rows:
            continue
        bucket = rows.column(0).to_numpy()
        seed, length, segments = (rows.column(i).to_pylist() for i in (3, 4, 5))
        digests, batch = rows.column(2), rows.column(1).to_numpy()
        for begin, end in _runs(bucket, bucket):
            if bucket[begin] != at:
                at, filters = bucket[begin], []
            while begin < end and seed[begin] is not None:
                prints = np.frombuffer(rows.column(6)[begin].as_py(), np.uint8)
                filters.append((int(batch[begin]), Fuse(int(seed[begin]), length[begin], segments[begin], prints)))
                begin += 1
            keys, own = _keys(digests.slice(begin, end - begin)), batch[begin:end]
            for snapshot, fuse in filters:
                asked = np.flatnonzero(own > snapshot)
                known = asked[in_fuse(fuse, keys[asked])]
                if len(known):
                    yield pa.RecordBatch.from_arrays(
                        [digests.take(pa.array(known + begin)), pa.array(own[known], pa.int32()), pa.array([snapshot] * len(known), pa.int32())],
                        ["digest", "batch", "snapshot"],
                    )


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """digest, batch, snapshot of the incoming (bucket, batch, digest) that a filter of an earlier batch knows."""
    none = {"seed": "decimal(20,0)", "length": "int", "segments": "int", "prints": "binary"}
    asked = incoming.select("bucket", "batch", "digest", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    known = filters.select("bucket", "batch", F.lit(None).cast("binary").alias("digest"), *none)
    both = asked.unionByName(known).repartition("bucket")
    return both.sortWithinPartitions("bucket", F.col("seed").isNull()).mapInArrow(_screen, "digest binary, batch int, snapshot int")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _spread_join(rows: DataFrame, lookup: DataFrame, n: int, how: str) -> DataFrame:
    """Join on the digest with a table of `n` rows, one a digest: broadcast up to a bound, else both sides move, every digest in parts."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), "digest", how)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("part")
    copies = lookup.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    return rows.select("*", part).join(copies, ["digest", "part"], how).drop("part")


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Where batches of about the same size begin; where exactly does not change the result."""
    if batches < 2:
        return []
    return docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []


def find_copies(docs: DataFrame, batches: int = BATCHES, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; `digest` of the normalised text is trusted only where bytes agree."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    source = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    cuts = sorted(set(_cuts(docs, batches)))
    batch = sum(((F.col("doc_id") >= cut).cast("int") for cut in cuts), F.lit(0))
    rows = source.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(batch, F.lit(0)).alias("batch"),
        _sha256(F.col("text")).alias("sha"), digest(F.col("text")).alias("digest"),
    )
    if digest is _sha256:
        rows = rows.drop("sha").withColumn("sha", F.col("digest"))
    rows = scratch.write(rows, "rows")

    # Copies inside a batch are one row from here on.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    grouped = rows.groupBy("batch", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    number = max(partitions(spark), -(-rows.count() // BUCKET_KEYS))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(number)).cast("int").alias("bucket")
    buckets = scratch.write(grouped.select(bucket, "*"), "buckets")

    filters = scratch.write(build_filters(buckets.where(F.col("batch") < len(cuts))), "filters")
    positive = screen(buckets.where("batch > 0"), filters)
    snapshot = buckets.select("digest", F.col("batch").alias("snapshot"))
    known = positive.join(snapshot, ["digest", "snapshot"], "left_semi").select("digest")
    several = known.unionByName(buckets.where("n > 1").select("digest")).distinct()
    groups = buckets.join(several, "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    groups = scratch.write(groups, "groups")
    n = groups.count()

    # One row for each text of a digest; copies are combined before they move.
    fetched = _spread_join(source.select("doc_id", "text", digest(F.col("text")).alias("digest")), groups.select("digest"), n, "left_semi")
    texts = fetched.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    mixed_up = scratch.write(texts.where("texts > 1").select("digest"), "several-texts")
    n_mixed = mixed_up.count()

    sha = F.lower(F.hex("sha")).alias("text_sha256")
    if n_mixed:
        settled = groups.join(mixed_up, "digest", "left_anti")
        rest = _spread_join(rows, mixed_up, n_mixed, "left_anti")
    else:
        settled, rest = groups, rows
    named = _spread_join(rest, settled.withColumnRenamed("n", "size"), n, "left")
    out = named.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        sha,
    )
    return out.unionByName(_by_text(source, mixed_up, n_mixed, digest, scratch)) if n_mixed else out


def _by_text(source: DataFrame, mixed_up: DataFrame, n: int, digest: Callable[[Column], Column], scratch: Scratch) -> DataFrame:
    """The same for rows of digests that several texts have, by the texts."""
    rows = _spread_join(source.select("doc_id", "text", digest(F.col("text")).alias("digest")), mixed_up, n, "left_semi")
    rows = scratch.write(rows.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "by-text")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = rows.groupBy("text").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first"))
    return rows.join(groups, "text").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("first.row") == F.col("row")).alias("kept"), F.sha2("text", 256).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = find_copies(docs, batches).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(normalised(F.col("text")), 256)
    marked = docs.withColumn("__sha", sha).dropDuplicates(["doc_id", "__sha"])
    both = (F.col("doc_id").eqNullSafe(F.col("k.__id"))) & (F.col("d.__sha") == F.col("k.__sha"))
    return marked.alias("d").join(kept.alias("k"), both, "left_semi").select(*[f"`{name}`" for name in docs.columns])
