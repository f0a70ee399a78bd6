"""What the operators share: scratch tables, shipping of code, row keys, batches of Arrow."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_left: dict[str, list] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it is not installed on them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "pulsegrid_llm.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of checkpoints, else the warehouse's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return root.rstrip("/")


class Scratch:
    """Tables that one run of an operator writes on its way, in the shared folder.

    A written table cuts the lineage and outlives any executor. `drop` deletes one as soon as later
    steps no longer read it; what a lazy result still reads goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/pulsegrid-llm/{label}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._tables: list[DataFrame] = []
        if not _left:
            atexit.register(_clear)
        _left.setdefault(spark.sparkContext.applicationId, []).append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        self._tables.append(back)  # so that its number stays its own
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self._paths.pop(id(table), None)
            if path:
                delete(self.spark, path)


    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all others that were written."""
        for number in set(self._paths) - {id(table) for table in tables}:
            delete(self.spark, self._paths.pop(number))
        free_shuffles(self.spark)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for held in _left.values():
        for spark, root in held:
            try:
                delete(spark, root)
            except Exception:  # the session may have ended before; nothing is read any more
                return


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's cleaner delete shuffle files of finished jobs now, not at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


_held: list[Callable[[], None]] = []


def on_release(clear: Callable[[], None]) -> None:
    """Name what lets go of things that a Python worker keeps from task to task."""
    _held.append(clear)


def release_held() -> None:
    """Before a task that needs much memory: what earlier tasks of this Python worker keep goes back to the system."""
    import ctypes

    for clear in _held:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def row_key(doc_id, raw: bytes) -> bytes:
    """A key of 16 bytes for a row: equal for rows with the same id and text, else different."""
    head = b"-" if doc_id is None else b"+" + str(doc_id).encode()
    return xxhash.xxh3_128_digest(head + b"\0" + raw)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of a text column, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices `starts[i] .. starts[i] + lengths[i] - 1` of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
