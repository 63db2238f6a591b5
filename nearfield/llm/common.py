"""What the operators of this subpackage share: scratch tables in the shared folder, and small column helpers.

Scratch tables live under the folder in ``spark.checkpoint.dir``, which the driver and all executors
share, so that a lost executor costs only its running tasks.  A session without that setting gets a folder of
its own on one machine alone; on a cluster it is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts after each real id; stands for a null doc_id where an order is needed.
NO_ID = (1 << 63) - 1

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        existing = spark.sparkContext.getCheckpointDir()
        if existing:
            return existing
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="nearfield-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Scratch folders made inside the innermost ``scratch_scope``.
_MADE: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made inside, for steps whose result is written elsewhere before the end."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            delete(spark, path)


@contextmanager
def conf_of(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside alone."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, partition_by: str | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back: cuts lineage for good.

    keep: the table outlives the scratch scope that it is made in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if keep and _MADE:
        _MADE[-1].remove(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    # what the write shuffled goes with it: nothing reads it again; few partitions need no sort before the write
    with conf_of(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "8"}):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, _UPPER, _UPPER.lower())


def whole(c: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def literal_table(spark: SparkSession, schema: str, json_rows: str) -> DataFrame:
    """A small planned table as SQL: rows of a JSON literal, without any RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json_rows), f"array<struct<{schema}>>")))


def give_back() -> None:
    """Return freed memory of this Python worker to the machine: Spark keeps workers, the JVM beside them needs it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(batch_column) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null is empty."""
    import pyarrow as pa

    return [b"" if b is None else b for b in batch_column.cast(pa.large_binary() if pa.types.is_large_string(batch_column.type) else pa.binary()).to_pylist()]
