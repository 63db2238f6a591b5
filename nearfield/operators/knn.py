"""Exact nearest neighbours, and the block scorer that all searches share.

Vectors are scanned where they lie: each task scores its Arrow batches against a block of queries of bounded
bytes and keeps the k nearest of each query in the batch, so only k rows per query and batch are shuffled for
the final ranking.  Queries beyond one block take further passes.  Order is (distance, id).

A matrix product finds the candidates, with a margin for its rounding; they alone get their distance summed
dimension by dimension, so results and ties are those of the plain sum.

Defined results: vectors that are null, of another dimension than the queries or not finite are skipped, as
ingest rejects them; queries of different dimensions, null or not finite are an InvalidArgument; no queries
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import EPSILON
from nearfield.functions.validate import InvalidArgument

#: Bytes of query vectors that go to the tasks at once.
QUERY_BLOCK_BYTES = 16 << 20


def pair_distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of x to all rows of q, summed dimension by dimension in double."""
    out = np.zeros((len(x), len(q)))
    if metric == "L2":
        for j in range(x.shape[1]):
            t = x[:, j, None] - q[None, :, j]
            out += t * t
        return out
    for j in range(x.shape[1]):
        out += x[:, j, None] * q[None, :, j]
    if metric == "InnerProduct":
        return -out
    norms = [np.zeros(len(a)) for a in (x, q)]
    for n, a in zip(norms, (x, q), strict=True):
        for j in range(a.shape[1]):
            n += a[:, j] * a[:, j]
    return 1.0 - out / (np.sqrt(norms[0])[:, None] * np.sqrt(norms[1])[None, :] + EPSILON)


def paired_distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of x to the same row of q, summed in the order of ``pair_distances``."""
    x, q = np.ascontiguousarray(x.T), np.ascontiguousarray(q.T)
    out = np.zeros(x.shape[1])
    if metric == "L2":
        for a, b in zip(x, q, strict=True):
            t = a - b
            out += t * t
        return out
    for a, b in zip(x, q, strict=True):
        out += a * b
    if metric == "InnerProduct":
        return -out
    norms = [np.zeros(len(out)), np.zeros(len(out))]
    for n, rows in zip(norms, (x, q), strict=True):
        for a in rows:
            n += a * a
    return 1.0 - out / (np.sqrt(norms[0]) * np.sqrt(norms[1]) + EPSILON)


def near_distances(x: np.ndarray, q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(distances by a matrix product, for each row of q a bound of twice their difference from the plain sum)."""
    dots = x @ q.T
    norm_x, norm_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    most = norm_x.max(initial=0.0)
    unit = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps
    if metric == "L2":
        return (norm_x * norm_x)[:, None] + (norm_q * norm_q)[None, :] - 2 * dots, unit * (most + norm_q) ** 2
    if metric == "InnerProduct":
        return -dots, unit * most * norm_q
    return 1.0 - dots / (norm_x[:, None] * norm_q[None, :] + EPSILON), np.full(len(q), 2 * unit)


def good_rows(column: pa.Array, dimension: int) -> tuple[np.ndarray | None, np.ndarray]:
    """(positions of rows with this many finite numbers, or None for all; those rows as a matrix of doubles)."""
    at = None
    fits = pc.equal(pc.list_value_length(column), dimension).fill_null(False).to_numpy(zero_copy_only=False)
    if not fits.all():
        at = np.flatnonzero(fits)
        column = column.take(pa.array(at))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)
    finite = np.isfinite(x).all(axis=1)
    if not finite.all():
        at, x = (np.arange(len(x)) if at is None else at)[finite], x[finite]
    return at, x


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@dataclass
class QueryBlock:
    """Queries of one pass; probes: for each list, the positions of the queries that probe it (None: all)."""

    ids: np.ndarray
    vectors: np.ndarray
    k: np.ndarray
    probes: dict[int, np.ndarray] | None = None


def nearest_in_batch(ids: np.ndarray, x: np.ndarray, lists: np.ndarray | None, block: QueryBlock, metric: str, rows_at_once: int = 4096, queries_at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(query_id, id, distance, list) of the k nearest rows to each query, and rows (almost) tied with the last."""
    groups = [(np.arange(len(ids)), np.arange(len(block.ids)), -1)] if block.probes is None else [(np.flatnonzero(lists == n), block.probes[n], n) for n in np.unique(lists).tolist() if n in block.probes]
    for rows, queries, listed in groups:
        for a in range(0, len(rows), rows_at_once):
            some = rows[a : a + rows_at_once]
            for b in range(0, len(queries), queries_at_once):
                asked = queries[b : b + queries_at_once]
                d, margin = near_distances(x[some], block.vectors[asked], metric)
                k = np.minimum(block.k[asked], len(some))
                r, c = np.nonzero(~(d > np.take_along_axis(np.sort(d, axis=0), (k - 1)[None, :], axis=0)[0] + margin))
                yield block.ids[asked[c]], ids[some[r]], paired_distances(x[some[r]], block.vectors[asked[c]], metric), listed


def query_blocks(queries: DataFrame, block_bytes: int = QUERY_BLOCK_BYTES) -> Iterator[list]:
    """Rows of the queries in blocks of bounded bytes (a query's array column counts)."""
    size = queries.agg(F.sum(F.size("vector") * 8 + 64)).head()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for i in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        yield part.collect()


def ranked(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the first k (or the row's own k) by (distance, id)."""
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    out = candidates.withColumn("rank", F.row_number().over(w).cast("long"))
    return out.filter(F.col("rank") <= (F.lit(k) if k is not None else F.col("k"))).select("query_id", "rank", "id", "distance")


def score(vectors: DataFrame, blocks: Iterator[QueryBlock], metric: str, with_lists: bool = False) -> DataFrame:
    """Candidates (query_id, id, distance and, with_lists, list_id) of all blocks; vectors: id, vector and, with_lists, list_id."""
    columns = ["id", "vector", "list_id"] if with_lists else ["id", "vector"]
    names = ["query_id", "id", "distance", "list_id"][: 4 if with_lists else 3]
    kinds = "query_id long, id long, distance double" + (", list_id long" if with_lists else "")
    source, out = vectors.select(*columns), None
    for block in blocks:
        if not len(block.ids):
            continue
        held = source.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = good_rows(b.column(1), held.value.vectors.shape[1])
                if not len(x):
                    continue
                ids, *lists = (c.to_numpy(zero_copy_only=False) for i, c in enumerate(b.columns) if i != 1)
                if at is not None:
                    ids, lists = ids[at], [c[at] for c in lists]
                for q, i, d, listed in nearest_in_batch(ids, x, lists[0] if lists else None, held.value, metric):
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64()), pa.array(np.full(len(q), listed), pa.int64())][: len(names)], names)

        part = source.mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kept = [F.lit(None).cast(k).alias(n) for n, k in (c.split() for c in kinds.split(", "))]
        out = source.limit(0).select(*kept)
    return out


def block_of(rows: list, k: int, probes: dict[int, np.ndarray] | None = None) -> QueryBlock:
    if not rows:
        return QueryBlock(np.zeros(0, dtype=np.int64), np.zeros((0, 0)), np.zeros(0, dtype=np.int64), probes)
    sizes = {len(r.vector) if r.vector is not None else 0 for r in rows}
    if 0 in sizes or len(sizes) > 1 or any(v is None for r in rows for v in r.vector):
        raise InvalidArgument("queries must be vectors of one dimension")
    vectors = np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), -1)
    if not np.isfinite(vectors).all():
        raise InvalidArgument("queries must have finite numbers")
    return QueryBlock(np.array([r.query_id for r in rows], dtype=np.int64), vectors, np.full(len(rows), k), probes)


def search_exact(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "L2") -> DataFrame:
    """The k nearest vectors (id, vector) to each query (query_id, vector): (query_id, rank, id, distance)."""
    return ranked(score(vectors, (block_of(rows, k) for rows in query_blocks(queries)), metric), k)


def merge_results(parts: list[DataFrame], k: int) -> DataFrame:
    """Results of several searches as one: the nearest row of each id, then the first k."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ranked(nearest_of_id(every), k)


def nearest_of_id(candidates: DataFrame) -> DataFrame:
    """(query_id, id, distance): the nearest row of each id; dealt by query, so that a ranking needs no further shuffle."""
    return candidates.repartition("query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the exact neighbours found."""
    hits = found.select("query_id", "id").join(exact.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return exact.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("recall"))
