"""Product quantisation: codebooks per subspace, codes, distance tables, scans by table lookup, re-ranking.

Raw vectors are quantised, not residuals, because the distance table is made from the raw query.  Distances
are squared Euclidean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import kmeans, knn
from nearfield.operators.ivf import IVFIndex


#: Numbers that a task holds at once in distance tables, and in distances.
HELD = 1 << 22


@dataclass
class Codebook:
    """m x ks x dsub centroids."""

    centroids: np.ndarray

    @property
    def m(self) -> int:
        return self.centroids.shape[0]

    @property
    def ks(self) -> int:
        return self.centroids.shape[1]

    @property
    def dsub(self) -> int:
        return self.centroids.shape[2]

    @classmethod
    def train(cls, vectors: DataFrame, m: int, nbits: int = 8, max_train: int | None = None, iterations: int = kmeans.ITERATIONS) -> Codebook:
        """k-means of each subspace on all vectors, or about ``max_train`` of them."""
        return cls(kmeans.fit(vectors, 2**nbits, iterations, m=m, max_train=max_train))

    def encode_matrix(self, x: np.ndarray) -> np.ndarray:
        return np.stack([kmeans.nearest(np.ascontiguousarray(x[:, s * self.dsub : (s + 1) * self.dsub]), self.centroids[s]) for s in range(self.m)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x m x ks squared distances between subvectors and centroids."""
        return np.stack([knn.pair_distances(np.ascontiguousarray(q[:, s * self.dsub : (s + 1) * self.dsub]), self.centroids[s], "L2") for s in range(self.m)], axis=1)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(id, sub, code, centroid); id = sub << 16 | code."""
        got = [((s << 16) | c, s, c, [float(v) for v in self.centroids[s, c]]) for s in range(self.m) for c in range(self.ks)]
        return spark.createDataFrame(got, "id long, sub long, code long, centroid array<double>")


def encode(vectors: DataFrame, book: Codebook) -> DataFrame:
    """The rows of ``vectors`` (id, vector, and list_id if there) with codes; bad vectors are skipped."""
    listed = "list_id" in vectors.columns
    names = ["id", "list_id", "codes"] if listed else ["id", "codes"]
    held = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = knn.good_rows(b.column(1), held.value.m * held.value.dsub)
            if len(x):
                codes = held.value.encode_matrix(x).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel()))
                kept = b if at is None else b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column(0), *([kept.column(2)] if listed else []), lists], names)

    source = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *(["list_id"] if listed else []))
    return source.mapInArrow(run, "id long, " + ("list_id long, " if listed else "") + "codes array<int>")


def distance_table(queries: DataFrame, book: Codebook) -> DataFrame:
    """(query_id, sub, code, distance) of every query."""
    held = queries.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = held.value.tables(knn.matrix(b.column(1)))
                n, m, ks = t.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), m * ks)), pa.array(np.tile(np.repeat(np.arange(m), ks), n)), pa.array(np.tile(np.arange(ks), n * m)), pa.array(t.ravel())], ["query_id", "sub", "code", "distance"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "query_id long, sub long, code long, distance double")


def _nearest(tables: np.ndarray, codes: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query and all that tie with the last of them.

    tables: queries x m x ks.  codes: m x rows.  k: of each query.
    """
    d = np.zeros((len(tables), codes.shape[1]))
    for s, row in enumerate(codes):
        d += tables[:, s, row]
    last = np.minimum(k, codes.shape[1]) - 1
    limit = np.partition(d, np.unique(last), axis=1)[np.arange(len(d)), last]
    q, r = np.nonzero(d <= limit[:, None])
    return q, r, d[q, r]


def scan(codes: DataFrame, queries: DataFrame, book: Codebook, k: int | None, index: IVFIndex | None = None, nprobe: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) by table lookup over all codes, or over the lists that an index probes.

    k None: k and nprobe of each query's own row.
    """
    listed, out = index is not None, None
    source = codes.select("id", "codes", *(["list_id"] if listed else []))
    blocks = index._blocks(queries, k, nprobe) if listed else (knn.block_of(rows, k) for rows in knn.query_blocks(queries))
    for block in blocks:
        if not len(block.ids):
            continue
        held = codes.sparkSession.sparkContext.broadcast((block, book))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block, book = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                ids, rows = b.column(0).to_numpy(zero_copy_only=False), np.ascontiguousarray(knn.matrix(b.column(1)).astype(np.intp).T)
                lists = b.column(2).to_numpy(zero_copy_only=False) if listed else np.zeros(len(ids), dtype=np.int64)
                members = {c: np.flatnonzero(lists == c) for c in np.unique(lists).tolist()}
                per = max(1, min(HELD // (book.m * book.ks), HELD // len(ids)))
                for a in range(0, len(block.ids), per):  # tables are made where they are read, so many queries at a time
                    tables, found = book.tables(block.vectors[a : a + per]), []
                    for c, mine in members.items():
                        near = block.probes.get(c, np.zeros(0, dtype=np.int64)) if listed else np.arange(len(block.ids))
                        near = near[(near >= a) & (near < a + per)]
                        if len(near):
                            q, r, d = _nearest(tables[near - a], rows[:, mine], block.k[near])
                            found.append((block.ids[near[q]], ids[mine[r]], d))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "id", "distance"])

        part = source.mapInArrow(run, "query_id long, id long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = source.limit(0).select(F.lit(None).cast("long").alias("query_id"), "id", F.lit(None).cast("double").alias("distance"))
    return knn.ranked(out, k) if k is not None else knn.ranked(out.join(queries.select("query_id", "k"), "query_id"))


def rerank(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "L2") -> DataFrame:
    """The candidates again by exact distance: (query_id, rank, id, distance)."""
    from nearfield.functions.distance import BY_METRIC

    pairs = found.select("query_id", "id").join(queries.select("query_id", F.col("vector").cast("array<double>").alias("q")), "query_id").join(vectors.select("id", F.col("vector").cast("array<double>").alias("v")), "id")
    return knn.ranked(pairs.select("query_id", "id", BY_METRIC[metric](F.col("v"), F.col("q")).alias("distance")), k)


