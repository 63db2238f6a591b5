"""Vector tables, index artifacts, manifests and versioned epochs.

Parquet is the primary format and goes through Spark's readers and writers; the small JSON documents
(manifests and the epoch registry) go through Hadoop's file systems, so any store that Spark reads works.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.validate import InvalidArgument, NotFound
from nearfield.operators.ivf import IVFIndex
from nearfield.operators.pq import Codebook


def read_vectors(spark: SparkSession, path: str, offset: int = 0, length: int = -1, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """(id, vector) of a Parquet table; a slice is by the order of ids over the whole table.  No row is an error."""
    rows = spark.read.parquet(path).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    if offset == 0 and length < 0:
        return rows
    out = slice_rows(rows, offset, length)
    if out.isEmpty():
        raise InvalidArgument("no rows in this slice")
    return out


def slice_rows(rows: DataFrame, offset: int, length: int, parts: int = 256) -> DataFrame:
    """Rows number offset to offset + length by id, numbered range by range and not in one task."""
    edges = rows.agg(F.percentile_approx("id", F.lit([i / parts for i in range(1, parts)]), F.lit(10_000))).head()[0] or []
    table = F.lit(sorted(set(edges))).cast("array<bigint>") if edges else F.lit([]).cast("array<bigint>")
    placed = rows.withColumn("_part", F.size(F.filter(table, lambda e: e <= F.col("id"))))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, seen = [], 0
    for p in range(len(edges) + 1):
        first.append(seen)
        seen += sizes.get(p, 0)
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1 + F.element_at(F.lit(first).cast("array<bigint>"), F.col("_part") + 1)
    numbered = placed.withColumn("_nth", nth)
    out = numbered.filter(F.col("_nth") >= offset)
    return (out if length < 0 else out.filter(F.col("_nth") < offset + length)).drop("_part", "_nth")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("id", "vector").write.mode("errorifexists").parquet(path)


def append_benchmark(rows: DataFrame, path: str) -> None:
    """Benchmark results as CSV, appended with a header in each file."""
    rows.write.mode("append").option("header", True).csv(path)


# ---- small documents ---------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so a reader sees the old document or the new one."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    _, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    beside, p = fs.makeQualified(beside), fs.makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, p, options)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise NotFound(path)
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@dataclass
class Manifest:
    """What an epoch of an index is made of."""

    index_name: str
    dimension: int
    nlist: int
    metric: str = "L2"
    epoch: str = ""
    m: int = 0
    nbits: int = 8
    shards: list[dict] = field(default_factory=list)
    created_at: int = 0

    def save(self, spark: SparkSession, path: str) -> None:
        write_text(spark, path, json.dumps(asdict(self), indent=1, sort_keys=True))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        try:
            return cls(**json.loads(read_text(spark, path)))
        except (ValueError, TypeError) as e:
            raise InvalidArgument(f"not a manifest: {path}") from e


def save_index(index: IVFIndex, path: str, book: Codebook | None = None, codes: DataFrame | None = None) -> list[dict]:
    """Centroids and lists (partitioned by list), codebook and codes; the shards written, with their sizes."""
    spark = index.lists.sparkSession
    index.centroid_rows(spark).coalesce(1).write.parquet(f"{path}/centroids")
    index.lists.repartition("list_id").write.partitionBy("list_id").parquet(f"{path}/lists")
    if book is not None:
        book.rows(spark).coalesce(1).write.parquet(f"{path}/codebook")
        codes.repartition("list_id").write.partitionBy("list_id").parquet(f"{path}/codes")
    sizes = spark.read.parquet(f"{path}/lists").groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).orderBy("list_id").collect()
    return [{"list_id": int(r["list_id"]), "path": f"lists/list_id={r['list_id']}", "num_vectors": r["n"]} for r in sizes]


def load_index(spark: SparkSession, path: str, metric: str) -> IVFIndex:
    got = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list_id"])
    lists = spark.read.parquet(f"{path}/lists").select("id", "vector", F.col("list_id").cast("long").alias("list_id"))
    return IVFIndex(np.array([r["centroid"] for r in got], dtype=np.float64), lists, metric)


def load_codebook(spark: SparkSession, path: str) -> tuple[Codebook, DataFrame]:
    got = spark.read.parquet(f"{path}/codebook").collect()
    m, ks = max(r["sub"] for r in got) + 1, max(r["code"] for r in got) + 1
    c = np.zeros((m, ks, len(got[0]["centroid"])))
    for r in got:
        c[r["sub"], r["code"]] = r["centroid"]
    return Codebook(c), spark.read.parquet(f"{path}/codes").select("id", "codes", F.col("list_id").cast("long").alias("list_id"))


class EpochRegistry:
    """Versions of one index: a directory each and a JSON state; at most one is active."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.state = {"active": None, "epochs": []}
        if exists(spark, f"{base}/epochs.json"):
            self.state = json.loads(read_text(spark, f"{base}/epochs.json"))
            self.state["epochs"] = [e for e in self.state["epochs"] if self._readable(e["id"])]
            if self.state["active"] not in [e["id"] for e in self.state["epochs"]]:
                self.state["active"] = None

    def _readable(self, epoch: str) -> bool:
        try:
            Manifest.load(self.spark, f"{self.path(epoch)}/manifest.json")
        except (NotFound, InvalidArgument):
            return False
        return True

    def _save(self) -> None:
        write_text(self.spark, f"{self.base}/epochs.json", json.dumps(self.state, indent=1))

    def path(self, epoch: str) -> str:
        return f"{self.base}/{epoch}"

    def new_id(self) -> str:
        return f"epoch_{int(time.time())}_{uuid.uuid4().int % 9000 + 1000}"

    def create(self, manifest: Manifest) -> str:
        """Record an epoch whose files are written; it is not active yet."""
        manifest.epoch = manifest.epoch or self.new_id()
        manifest.created_at = manifest.created_at or time.time_ns()
        manifest.save(self.spark, f"{self.path(manifest.epoch)}/manifest.json")
        self.state["epochs"].append({"id": manifest.epoch, "created_at": manifest.created_at})
        self._save()
        return manifest.epoch

    def get(self, epoch: str) -> Manifest:
        if epoch not in [e["id"] for e in self.state["epochs"]]:
            raise NotFound(f"epoch {epoch}")
        return Manifest.load(self.spark, f"{self.path(epoch)}/manifest.json")

    def activate(self, epoch: str) -> None:
        self.get(epoch)
        self.state["active"] = epoch
        self._save()

    def deactivate(self) -> None:
        self.state["active"] = None
        self._save()

    @property
    def active(self) -> str | None:
        return self.state["active"]

    def list(self) -> list[str]:
        """Epochs, the newest first."""
        return [e["id"] for e in sorted(self.state["epochs"], key=lambda e: -e["created_at"])]

    def clean(self, keep: int = 3) -> list[str]:
        """Delete all but the newest ``keep``; never the active one."""
        gone = [e for e in self.list()[keep:] if e != self.active]
        for e in gone:
            delete(self.spark, self.path(e))
        self.state["epochs"] = [e for e in self.state["epochs"] if e["id"] not in gone]
        self._save()
        return gone
