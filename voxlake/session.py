"""Session settings, the shared folder, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only after it was measured and found within both bounds.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Repeated JSON keys keep the last value, as in Python's parser."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


# Bytes of a task that reads files: Spark's own default.
SPLIT_BYTES = 128 * 1024 * 1024


@contextmanager
def own_splits(spark: SparkSession) -> Iterator[None]:
    """Read tables of one's own in splits of the usual size, however small the session wants its input's."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() >= SPLIT_BYTES:
        yield
        return
    spark.conf.set(key, str(SPLIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# Rows that a scan holds at a time. A grouped batch is some 20 KB of texts, and Spark's own 4,096
# of them are vectors of more than 100 MB a task.
HELD_ROWS = 256


@contextmanager
def few_rows_held(spark: SparkSession) -> Iterator[None]:
    """Let scans hold fewer rows at a time, for tables whose rows are long."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(HELD_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scanned_bytes(df: DataFrame) -> int:
    """Size of the largest table the plan reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return max(
        int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the one the session names.

    Only a local session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/voxlake"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the unnamed tables written inside once the block is left.

    For steps whose outcome is stored elsewhere by then, such as one epoch of a
    stream that runs for months.
    """
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def write_table(
    df: DataFrame, name: str, path: str | None = None, by: str | None = None
) -> DataFrame:
    """Write `df` once and read it back: cuts lineage and survives lost executors.

    `by`, the last column, gets a folder for each of its values.
    """
    spark = df.sparkSession
    if path is None:
        path = new_path(spark, name)
        if (mine := _scratch.get()) is not None:
            mine.append(path)
    writer = df.write.mode("overwrite")
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Measure a written table: few rows, and few bytes once unpacked.

    The size on disk says little, as repeated texts compress to almost nothing.
    """
    kinds = dict(table.dtypes)
    if any(k.startswith(("array", "map", "struct", "variant", "binary")) for k in kinds.values()):
        return False
    held = table.count()  # from the file footers, without reading a column
    if held > rows:
        return False
    if held == 0 or "string" not in kinds.values():
        return 16 * len(kinds) * held <= BROADCAST_BYTES
    per_row = F.lit(16 * len(kinds))
    for name, kind in kinds.items():
        if kind == "string":
            per_row = per_row + F.coalesce(F.octet_length(name), F.lit(0))
    size = table.agg(F.sum(per_row.cast("bigint")).alias("bytes")).first()["bytes"]
    return (size or 0) <= BROADCAST_BYTES


def small_side(table: DataFrame) -> DataFrame:
    """Mark a written table for broadcast when its measured size allows it.

    Larger tables are returned as they are and joined by shuffle.
    """
    return F.broadcast(table) if is_small(table) else table


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all it holds, if it is there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, from one listing."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.globStatus(jpath) or [])


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, sorted; empty when it does not exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath))


def move_file(spark: SparkSession, folder: str, path: str) -> None:
    """Give the only data file of a written folder a name of its own."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    (name,) = [n for n in list_names(spark, folder) if n.startswith("part-")]
    fs.mkdirs(target.getParent())
    fs.rename(hadoop(f"{folder}/{name}"), target)
