"""Session settings and the shared scratch folder for tables a job writes on its way."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_written: dict[str, tuple[SparkSession, set[str]]] = {}


def build_session(app: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC, AQE and skew handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Files written by pandas hold nanoseconds; `normalize` converts them.
        "spark.sql.legacy.parquet.nanosAsLong": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Timestamps are UTC without a zone; a session in another zone would shift them."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def use_scratch_root(spark: SparkSession, root: str) -> None:
    """Name the shared folder of this application, where `spark.checkpoint.dir` is not set."""
    _roots[spark.sparkContext.applicationId] = root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder all executors share; what is written there goes when the process ends."""
    application = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _roots.get(application)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir, or use_scratch_root, to a folder all executors share")
    path = f"{root.rstrip('/')}/pulsegrid/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_all)
    _written.setdefault(application, (spark, set()))[1].add(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def list_paths(spark: SparkSession, root: str, levels: tuple[str, ...]) -> list[str]:
    """Partition folders of a table, as deep as it has partition columns."""
    return glob_paths(spark, "/".join([root, *[f"{name}=*" for name in levels]]))


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in place of what is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Give a folder its final name; False if that is taken."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(make(target).getParent())
    return not files.exists(make(target)) and files.rename(make(source), make(target))


def release_scratch(spark: SparkSession) -> None:
    """Delete everything this application has in the scratch folder; lazy results that read it end here."""
    _, paths = _written.get(spark.sparkContext.applicationId, (spark, set()))
    while paths:
        delete_path(spark, paths.pop())


def _delete_all() -> None:
    for spark, _ in _written.values():
        if spark.sparkContext._jsc is not None:
            release_scratch(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back.

    Cuts the lineage and freezes the rows, and survives lost executors. Row counts of the
    result come from Parquet footers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
