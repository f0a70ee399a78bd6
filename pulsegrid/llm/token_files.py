"""Token ids of documents in binary files, each document compressed by itself with one shared dictionary.

A dictionary of zstandard is trained on the serialized id arrays of a bounded sample of documents. Every
document is one frame, compressed with it, so a short document costs few bytes and is read without its
neighbours. The files are Parquet tables of blocks in ascending order of doc_id:

    blocks/      shard, block, dictionary hash, first and last id, start of the block within its shard,
                 per document: id, number of tokens, offset of its frame; the frames one after another
    dictionary/  hash, bytes, width of an id in bytes
    manifest/    per shard: documents, tokens, and tokens of all shards before it

Null texts are empty documents, which hold the end id alone. Rows with the same doc_id are documents of their
own, in order of their ids' checksum. Null ids come first. An empty table gives empty files. Other columns
are not stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid.llm.common import Scratch, partitions, release_held, slices
from pulsegrid.llm.tokens import encoder

SLICE = 6 << 20
BLOCK = 1 << 20
WORDS = 1_500_000  # known to a worker that encodes; they go before frames are sorted
FRAMES = "doc_id long, n_tokens long, crc long, frame binary"
BLOCKS = (
    "shard int, block int, dictionary string, first_id long, last_id long, start long, tokens long, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, frames binary"
)
DOCUMENTS = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def _serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _each(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple]:
    """(doc_id, ids with the end id) of every row."""
    code = encoder(tokenizer, WORDS)
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            ids, offsets = code.encode(part.column(1))
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                yield doc_id, np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id))


def train_dictionary(
    docs: DataFrame, tokenizer: str, end_id: int, sample: int = 2000, size: int = 64 << 10, longest: int = 50_000
) -> tuple[bytes, int]:
    """(dictionary, bytes of an id). Fitted on `sample` documents of at most `longest` characters, in the
    order of a hash of doc_id, whatever the size of the table. Too few texts give no dictionary."""
    width = 2 if encoder(tokenizer, WORDS).size <= 1 << 16 and end_id < 1 << 16 else 4
    text = F.coalesce("text", F.lit(""))
    place = F.xxhash64("doc_id")
    fitting = docs.where(F.length(text) <= longest)
    # The last place that counts comes from ids alone; few texts are read out then.
    last = docs.select(place.alias("place")).orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    chosen = fitting.where(place <= last) if last is not None else fitting.limit(0)
    chosen = chosen.select("doc_id", text.alias("text")).orderBy(place, "doc_id", "text").limit(sample).toArrow()
    samples = [_serialized(ids, width) for _, ids in _each(iter(chosen.to_batches()), tokenizer, end_id)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes(), width
    except zstandard.ZstdError:  # it needs some samples
        return b"", width


def _codec(dictionary: bytes, level: int | None = None):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if level is None:
        return zstandard.ZstdDecompressor(dict_data=held)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=True)


def _compress(tokenizer: str, end_id: int, dictionary: bytes, width: int, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(dictionary, level)
        rows, held = [], 0
        for doc_id, ids in _each(batches, tokenizer, end_id):
            frame = codec.compress(_serialized(ids, width))
            rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), frame))
            held += len(frame)
            if held > 8 << 20:
                yield _frames(rows)
                rows, held = [], 0
        if rows:
            yield _frames(rows)

    return run


def _frames(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ("doc_id", "n_tokens", "crc", "frame")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def _pack(digest: str) -> Callable:
    """Blocks of sorted frames; a partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, held = [], [], [], 0

        def flush():
            nonlocal block, before, ids, counts, frames, held
            lengths = np.fromiter(map(len, frames), np.int64, len(frames))
            real = [i for i in ids if i is not None]
            row = {
                "shard": shard, "block": block, "dictionary": digest,
                "first_id": min(real, default=None), "last_id": max(real, default=None),
                "start": before, "tokens": sum(counts), "doc_ids": ids, "n_tokens": counts,
                "offsets": (np.cumsum(lengths) - lengths).tolist(), "frames": b"".join(frames),
            }
            kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))
            block, before = block + 1, before + row["tokens"]
            ids, counts, frames, held = [], [], [], 0
            return out

        for batch in batches:
            for doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                held += len(frame)
                if held >= BLOCK:
                    yield flush()
        if ids:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shards: int | None = None, level: int = 3, sample: int = 2000
) -> None:
    """Write the ids of all documents below `path`. Texts are encoded once; only compressed frames are sorted."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary, width = train_dictionary(docs, tokenizer, end_id, sample)
    digest = hashlib.sha256(dictionary).hexdigest()
    scratch = Scratch(spark, "frames")
    frames = scratch.write(docs.mapInArrow(_compress(tokenizer, end_id, dictionary, width, level), FRAMES), "frames")
    (
        frames.repartitionByRange(shards or partitions(spark), "doc_id", "crc")
        .sortWithinPartitions("doc_id", "crc")
        .mapInArrow(_pack(digest), BLOCKS)
        .write.parquet(f"{path}/blocks")
    )
    scratch.drop(frames)
    one = spark.createDataFrame([(digest, dictionary, width)], "hash string, bytes binary, width int")
    one.coalesce(1).write.parquet(f"{path}/dictionary")
    sums = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(
        F.sum(F.size("doc_ids")).alias("documents"), F.sum("tokens").alias("tokens")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    sums.select("*", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")).coalesce(1).write.parquet(
        f"{path}/manifest"
    )


def _unpack(dictionary: bytes, digest: str, width: int, before: dict[int, int], with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        codec = _codec(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError(f"block of another dictionary: {row['dictionary']}")
                raw, starts, at = row["frames"], [], before[row["shard"]] + row["start"]
                ends = [*row["offsets"][1:], len(raw)]
                crcs, lists = [], []
                for offset, end, n in zip(row["offsets"], ends, row["n_tokens"]):
                    ids = np.frombuffer(codec.decompress(raw[offset:end]), f"<u{width}").astype("<u4")
                    if len(ids) != n:
                        raise ValueError(f"a frame holds {len(ids)} ids instead of {n}")
                    crcs.append(zlib.crc32(ids.tobytes()))
                    lists.append(ids.astype(np.int32) if with_ids else None)
                    starts.append(at)
                    at += n
                columns = [[row["shard"]] * len(starts), row["doc_ids"], starts, row["n_tokens"], crcs, lists]
                kinds = [pa.int32()] + [pa.int64()] * 4 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["shard", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document, from its own frame. `doc_ids` reads only the blocks that can hold them."""
    digest, dictionary, width = spark.read.parquet(f"{path}/dictionary").first()
    # One row per shard, as many as tasks wrote the files.
    before = {r["shard"]: r["before"] for r in spark.read.parquet(f"{path}/manifest").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if doc_ids is not None:
        near = [(F.col("first_id") <= i) & (F.col("last_id") >= i) for i in doc_ids]
        wanted = F.lit(False)
        for condition in near:
            wanted = wanted | condition
        blocks = blocks.where(wanted)
    rows = blocks.mapInArrow(_unpack(bytes(dictionary), digest, width, before, with_ids), DOCUMENTS)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))
