"""Searches and index updates over streams, by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators import kmeans
from nearfield.operators.ivf import IVFIndex


def stream_search(queries: DataFrame, index: IVFIndex, k: int, nprobe: int, out: str, checkpoint: str) -> StreamingQuery:
    """Coalesce arriving queries (query_id, vector): each micro-batch is one search, written by batch."""

    def batch(rows: DataFrame, number: int) -> None:
        index.search(rows, k, nprobe).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_add(vectors: DataFrame, index: IVFIndex, out: str, checkpoint: str) -> StreamingQuery:
    """Add arriving vectors (id, vector) to lists under frozen centroids; a batch written again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        kmeans.assign(rows, index.centroids, index.metric).write.mode("overwrite").partitionBy("list_id").parquet(f"{out}/batch={number}")

    return vectors.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
