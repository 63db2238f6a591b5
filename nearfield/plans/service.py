"""The service's methods over a catalog directory: create, build, activate, load, warm up, search, statistics."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import validate
from nearfield.functions.validate import InvalidArgument, NotFound
from nearfield.operators import kmeans, pq
from nearfield.operators.ivf import IVFIndex
from nearfield.sources.storage import EpochRegistry, Manifest, exists, load_codebook, load_index, read_vectors, save_index


class VectorService:
    """A catalog of indexes under ``base``.  A loaded epoch is immutable, so a swap never disturbs a search."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.loaded: dict[str, tuple[str, IVFIndex, tuple | None]] = {}
        self.warm: dict[str, DataFrame] = {}

    def _config(self, name: str) -> Manifest:
        path = f"{self.base}/{name}/config.json"
        if not name or not exists(self.spark, path):
            raise NotFound(f"index {name!r}")
        return Manifest.load(self.spark, path)

    def epochs(self, name: str) -> EpochRegistry:
        self._config(name)
        return EpochRegistry(self.spark, f"{self.base}/{name}")

    def create_index(self, name: str, dimension: int, metric: str = "", nlist: int = 0, m: int = 0, nbits: int = 0) -> Manifest:
        nlist, nbits = validate.index_config(name, dimension, nlist, m, nbits)
        config = Manifest(name, dimension, nlist, validate.metric_of(metric), m=m, nbits=nbits)
        config.save(self.spark, f"{self.base}/{name}/config.json")
        return config

    def build_epoch(self, name: str, source: str | DataFrame, id_column: str = "id", vector_column: str = "vector") -> str:
        """Train, add all vectors of the source and save; the new epoch's id."""
        config = self._config(name)
        if isinstance(source, str) and not source:
            raise InvalidArgument("source path is empty")
        vectors = read_vectors(self.spark, source, 0, -1, id_column, vector_column) if isinstance(source, str) else source.select("id", "vector")
        vectors = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
        if not validate.mismatched(vectors, config.dimension).isEmpty():
            raise InvalidArgument(f"vectors must have {config.dimension} finite numbers")
        registry = self.epochs(name)
        manifest = Manifest(**asdict(config) | {"epoch": registry.new_id()})
        index = IVFIndex.build(vectors, config.nlist, config.metric, kmeans.MAX_TRAIN)
        book = codes = None
        if config.m:
            book = pq.Codebook.train(vectors, config.m, config.nbits, kmeans.MAX_TRAIN)
            codes = pq.encode(index.lists, book)
        manifest.nlist = index.nlist
        manifest.shards = save_index(index, registry.path(manifest.epoch), book, codes)
        return registry.create(manifest)

    def activate_epoch(self, name: str, epoch: str) -> None:
        self.epochs(name).activate(epoch)
        self.load_index(name, epoch)

    def load_index(self, name: str, epoch: str = "") -> IVFIndex:
        registry = self.epochs(name)
        epoch = epoch or registry.active or ""
        manifest = registry.get(epoch)
        index = load_index(self.spark, registry.path(epoch), manifest.metric)
        self.loaded[name] = (epoch, index, load_codebook(self.spark, registry.path(epoch)) if manifest.m else None)
        return index

    def _index(self, name: str) -> tuple[str, IVFIndex, tuple | None]:
        if name not in self.loaded:
            self.load_index(name)
        return self.loaded[name]

    def warmup(self, name: str, lists: list[int] | None = None) -> int:
        """Keep lists in storage memory; how many vectors that are."""
        self.evict(name)
        self.warm[name] = self._index(name)[1].warm(lists)
        return self.warm[name].count()

    def evict(self, name: str) -> None:
        if name in self.warm:
            self.warm.pop(name).unpersist()

    def search(self, name: str, queries: DataFrame, topk: int = 10, nprobe: int = 0, metric: str = "", rerank_exact: bool = False) -> DataFrame:
        """(query_id, rank, id, distance) for queries (query_id, vector)."""
        nprobe = validate.search_request(name, topk, nprobe, int(not queries.isEmpty()))
        _, index, quantised = self._index(name)
        if metric and validate.metric_of(metric) != index.metric:
            raise InvalidArgument(f"index {name} has the metric {index.metric}")
        bad = queries.filter(~validate.is_valid_vector(F.col("vector"), index.dimension))
        if not bad.isEmpty():
            raise InvalidArgument(f"queries must have {index.dimension} finite numbers")
        if quantised is None:
            return index.search(queries, topk, nprobe)
        book, codes = quantised
        found = pq.scan(codes, queries, book, topk if not rerank_exact else min(validate.MAX_TOPK, 4 * topk), index, nprobe)
        return pq.rerank(found, index.lists, queries, topk, index.metric) if rerank_exact else found

    def search_batch(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Requests (query_id, index, vector, k, nprobe): (results with index, requests whose index is missing).

        A request of a known index is checked like one of ``search``: k in 1..1000, nprobe of 0 or less means the
        default, the index's dimension.  A quantised index is searched by its codes.
        """
        names = [r["index"] for r in requests.select("index").distinct().collect()]
        known, out = [], None
        for name in names:
            try:
                _, index, quantised = self._index(name)
            except NotFound:
                continue
            known.append(name)
            own = requests.filter(F.col("index") == name)
            part = index.search_batch(own) if quantised is None else pq.scan(quantised[1], own, quantised[0], None, index)
            part = part.withColumn("index", F.lit(name))
            out = part if out is None else out.unionByName(part)
        empty = self.spark.createDataFrame([], "query_id long, rank long, id long, distance double, index string")
        return empty if out is None else out, requests.filter(~F.col("index").isin(known) | F.col("index").isNull())

    def stats(self, name: str) -> dict:
        epoch, index, _ = self._index(name)
        row = index.stats().head()
        return {"total_vectors": row.total_vectors, "indexed_vectors": row.total_vectors, "current_epoch": epoch, "memory_gb": row.memory_bytes / 2**30, "nlist": row.nlist}

    def health(self) -> str:
        return "SERVING" if self.spark.range(1).count() == 1 else "NOT_SERVING"
