"""k-means as the index trains it: a seed rule, then a fixed number of Lloyd steps, over all vectors.

Up to ``held_bytes`` of vectors are gathered and trained on the driver.  More stay where they are: each Lloyd step
is one pass whose tasks return sums and counts of their clusters, and a seeding pass returns the vectors farthest
from the seeds so far, of which the driver takes as many as no other vector can beat.  Both ways give the same
centroids: distances are the same sums, ties go to the lowest id, and centroids are rounded to 9 places after each
step, so that the order of sums cannot show.  ``max_train`` draws a sample by a hash of the id instead, for those who
want one.  Assignment of all vectors runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.knn import good_rows, near_distances, pair_distances, paired_distances

ITERATIONS, MAX_TRAIN, PLACES = 10, 100_000, 9
#: Bytes of vectors that are trained on the driver, and of candidates for seeds that a task or the driver holds.
HELD_BYTES, CANDIDATE_BYTES = 64 << 20, 1 << 20


def _training_rows(vectors: DataFrame, max_train: int | None) -> tuple[DataFrame, int]:
    """(id, vector) to train on, and their bytes."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter(F.size("vector") > 0)
    count, numbers = rows.agg(F.count(F.lit(1)), F.sum(F.size("vector").cast("long"))).head()
    if max_train is not None and count > max_train:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < (1 << 20) * max_train // count)
        numbers = numbers * max_train // count
    return rows, 8 * (numbers or 0)


def _gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) in the order of the ids; bad vectors are skipped."""
    got = rows.toArrow().sort_by("id").combine_chunks()
    if not got.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    column = got.column("vector").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ids = got.column("id").to_numpy()
    for size in dict.fromkeys(pc.list_value_length(column).to_pylist()):  # the first good vector decides
        at, x = good_rows(column, size)
        if len(x):
            break
    return ids if at is None else ids[at], x


def fit(vectors: DataFrame, k: int, iterations: int = ITERATIONS, seeding: str = "farthest", seed: int = 42, m: int = 1, max_train: int | None = None, held_bytes: int = HELD_BYTES) -> np.ndarray:
    """Centroids of each of m subspaces, m x k x (dimension / m); bad vectors are skipped."""
    rows, size = _training_rows(vectors, max_train)
    if size <= held_bytes:
        _, x = _gathered(rows)
        return np.stack([train(part, k, iterations, seeding, seed) for part in _subspaces(x, m)])
    _, centroids = _spread_seeds(rows, k, m, seeding, seed)
    for _ in range(iterations):
        centroids = _spread_lloyd(rows, centroids)
    return centroids


def seed_ids(vectors: DataFrame, k: int, held_bytes: int = HELD_BYTES) -> list[int]:
    """The ids of the vectors that ``fit`` starts from."""
    rows, size = _training_rows(vectors, None)
    if size <= held_bytes:
        ids, x = _gathered(rows)
        return ids[farthest_first(x, k)].tolist()
    return _spread_seeds(rows, k)[0][0]


def _subspaces(x: np.ndarray, m: int) -> list[np.ndarray]:
    if x.shape[1] % m:
        raise ValueError("dimension must be a multiple of m")
    return [np.ascontiguousarray(part) for part in np.split(x, m, axis=1)]


def _spread_seeds(rows: DataFrame, k: int, m: int = 1, seeding: str = "farthest", seed: int = 42) -> tuple[list[list[int]], np.ndarray]:
    """(ids, points) of the seeds of each subspace.

    Each pass finds the vectors farthest from the seeds so far.  Distances only shrink while seeds are added, so
    the farthest of these is the next seed as long as it is no nearer than the last of them was.  D² sampling takes
    one seed a pass: that whose exponential time, at the rate of its squared distance, is over first.
    """
    finite = rows.filter(F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    first = finite.agg(F.min("id").alias("id"), F.min_by("vector", "id").alias("vector")).head()
    if first.vector is None:
        raise ValueError("no vectors to train on")
    dimension, start = len(first.vector), np.array([first.vector], dtype=np.float64)
    k = min(k, finite.filter(F.size("vector") == dimension).count())
    ids, points = [[first.id] for _ in range(m)], _subspaces(start, m)
    most = 1 if seeding == "d2" else max(1, CANDIDATE_BYTES // (8 * (dimension + 2 * m)))
    kinds = "sub long, id long, far double, point array<double>"
    while short := [s for s in range(m) if len(ids[s]) < k]:
        held = rows.sparkSession.sparkContext.broadcast({s: points[s] for s in short})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for b in batches:
                at, x = good_rows(b.column(1), dimension)
                own = b.column(0).to_numpy(zero_copy_only=False)
                own, parts = own if at is None else own[at], _subspaces(x, m)
                for s, seeds in held.value.items():
                    far = paired_distances(parts[s], seeds[nearest(parts[s], seeds)], "L2")
                    if seeding == "d2":
                        far = _hurry(own, far, seed, s, len(seeds))
                    got = [np.concatenate(c) for c in zip(best[s], (own, far, parts[s]), strict=True)] if s in best else (own, far, parts[s])
                    kept = np.lexsort((got[0], -got[1]))[:most]
                    best[s] = tuple(c[kept] for c in got)
            for s, (own, far, part) in best.items():
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), s), pa.int64()), pa.array(own, pa.int64()), pa.array(far, pa.float64()), lists], ["sub", "id", "far", "point"])

        order = Window.partitionBy("sub").orderBy(F.desc("far"), "id")
        got = rows.mapInArrow(run, kinds).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).toArrow().sort_by([("sub", "ascending"), ("place", "ascending")])
        held.unpersist()
        for s in short:
            mine = got.filter(pc.equal(got.column("sub"), s)).combine_chunks()
            own, far, part = mine.column("id").to_numpy(), mine.column("far").to_numpy().copy(), np.array(mine.column("point").to_pylist(), dtype=np.float64)
            last = (far[-1], own[-1]) if len(own) == most else (-1.0, 0)
            by_dimension = np.ascontiguousarray(part.T)
            while len(ids[s]) < k:
                top = int(np.lexsort((own, -far))[0])
                if (far[top], -own[top]) < (last[0], -last[1]):
                    break
                ids[s].append(int(own[top]))
                points[s] = np.concatenate([points[s], part[top : top + 1]])
                if seeding == "d2":
                    break
                far = np.minimum(far, _to_one(by_dimension, part[top]))
    return ids, np.stack(points)


def _hurry(ids: np.ndarray, rate: np.ndarray, seed: int, sub: int, step: int) -> np.ndarray:
    """For each id an exponential speed: the greatest belongs to each with probability in proportion to its rate."""
    x = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + sub * 65_537 + step) % (1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return rate / -np.log(((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54)


def _spread_lloyd(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One step over vectors that stay where they are."""
    m, k, width = centroids.shape
    held = rows.sparkSession.sparkContext.broadcast(centroids)
    names, kinds = ["cell", "task", "n", "total"], "cell long, task long, n long, total array<double>"

    def told(cells: np.ndarray, task: int, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * width, pa.int32()), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.full(len(cells), task), pa.int64()), pa.array(n, pa.int64()), lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total = np.zeros(m * k, dtype=np.int64), np.zeros((m * k, width))
        for b in batches:
            _, x = good_rows(b.column(1), m * width)
            if not len(x):
                continue
            for s, part in enumerate(_subspaces(x, m)):
                found, counts, sums = _sums(part, nearest(part, held.value[s]))
                n[s * k + found] += counts
                total[s * k + found] += sums
        cells = np.flatnonzero(n)
        yield told(cells, TaskContext.get().partitionId(), n[cells], total[cells])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list] = {}
        for b in batches:
            for cell, n, total in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).flatten().to_numpy().reshape(-1, width), strict=True):
                had = made.get(cell)
                made[cell] = [n, total.copy()] if had is None else [had[0] + n, had[1] + total]
        if made:
            yield told(np.array(list(made)), 0, np.array([n for n, _ in made.values()]), np.stack([t for _, t in made.values()]))

    sums = rows.mapInArrow(run, kinds).repartition("cell").sortWithinPartitions("cell", "task").mapInArrow(add, kinds).collect()
    held.unpersist()
    out = centroids.copy()
    for r in sums:
        out[r.cell // k, r.cell % k] = np.round(np.array(r.total) / r.n, PLACES)
    return out


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows that seed k clusters: the first, then each time the row farthest from all seeds, ties to the first."""
    if not len(x):
        raise ValueError("no vectors to train on")
    rows, by_dimension = [0], np.ascontiguousarray(x.T)
    least = _to_one(by_dimension, x[0])
    while len(rows) < min(k, len(x)):
        rows.append(int(least.argmax()))
        least = np.minimum(least, _to_one(by_dimension, x[rows[-1]]))
    return np.array(rows)


def _to_one(by_dimension: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of all columns to one point, summed dimension by dimension."""
    out = np.zeros(by_dimension.shape[1])
    for row, p in zip(by_dimension, point, strict=True):
        t = row - p
        out += t * t
    return out


def d2_sampling(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k-means++: each next seed is drawn with probability in proportion to its squared distance."""
    rng = np.random.default_rng(seed)
    rows = [int(rng.integers(len(x)))]
    least = pair_distances(x, x[rows], "L2")[:, 0]
    while len(rows) < min(k, len(x)):
        total = least.sum()
        rows.append(int(rng.choice(len(x), p=least / total)) if total > 0 else int(rng.integers(len(x))))
        least = np.minimum(least, pair_distances(x, x[rows[-1:]], "L2")[:, 0])
    return np.array(rows)


def nearest(x: np.ndarray, centroids: np.ndarray, metric: str = "L2", rows_at_once: int = 4096) -> np.ndarray:
    """The nearest centroid of each row, ties to the lowest: by a matrix product, near ties by the plain sum."""
    out = np.zeros(len(x), dtype=np.int64)
    for a in range(0, len(x), rows_at_once):
        part = x[a : a + rows_at_once]
        # the centroids ask, as rows of the product, so that each vector has its own margin
        d, margin = near_distances(centroids, part, metric)
        row, c = np.nonzero(~(d > d.min(axis=0) + margin).T)
        exact = paired_distances(part[row], centroids[c], metric) if len(row) > len(part) else np.zeros(len(row))
        by = np.lexsort((c, exact, row))
        out[a + row[by][np.append(True, np.diff(row[by]) > 0)]] = c[by][np.append(True, np.diff(row[by]) > 0)]
    return out


def _sums(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clusters with rows, their numbers of rows, their sums)."""
    by = np.argsort(own, kind="stable")
    found, first, n = np.unique(own[by], return_index=True, return_counts=True)
    return found, n, np.add.reduceat(x[by], first, axis=0)


def lloyd(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """One step: means of the rows of each centroid; one without rows stays."""
    found, n, sums = _sums(x, nearest(x, centroids))
    out = centroids.copy()
    out[found] = np.round(sums / n[:, None], PLACES)
    return out


def train(x: np.ndarray, k: int, iterations: int = ITERATIONS, seeding: str = "farthest", seed: int = 42) -> np.ndarray:
    """k centroids (as many as rows, if those are fewer)."""
    rows = farthest_first(x, k) if seeding == "farthest" else d2_sampling(x, k, seed)
    centroids = x[rows]
    for _ in range(iterations):
        centroids = lloyd(x, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str = "L2") -> DataFrame:
    """``vectors`` (id, vector) with list_id, the nearest centroid; no shuffle.  Bad vectors are skipped."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = good_rows(b.column(1), held.value.shape[1])
            if len(x):
                kept = b if at is None else b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(nearest(x, held.value, metric), pa.int64())], ["id", "vector", "list_id"])

    return vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "id long, vector array<double>, list_id long")
