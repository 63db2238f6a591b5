"""Exact deduplication by a stateful stream.

Documents are staged once in the shared folder with a row locator and the SHA-256 of their text.  A
Structured Streaming query reads the staged table in micro-batches and keeps one state row per digest in
RocksDB, without watermark or expiry: the stable identifier of the row that stays, the locator of its
content in the staged table, and the number of rows.  Micro-batches aggregate before they shuffle, so a
digest that a third of the rows share reaches its state row as one partial row per task.  After the stream
the state is read back as a table; each hit is then checked on its full bytes against the staged content
that the locator names.  Should two texts share a digest, the rows of that digest are grouped by their full
texts instead.  All steps are DataFrame functions.

With a ``folder`` the staged table and the state outlive the call: a later call stages its documents beside the
earlier ones, the stream goes on from its own checkpoint and reads the new files alone, and the new rows are
judged against all that were ever staged.  A call that was cut short is taken up by the next: what it staged
counts as staged before.  Under ``max`` a new row may replace one that an earlier call kept.

Defined results: a null text equals the empty text; of equal texts the largest (or smallest) doc_id stays, a
null doc_id only among null doc_ids, and of repeated rows exactly one; an empty table gives no rows.  Other
columns are carried inside a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import conf_of, delete, materialize, release, scratch_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # only running tasks hold a store, however many partitions the state has
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # else each store reserves some MB of disk beyond what it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: While hits fetch their bytes: where the groups are small by Spark's own estimate, a Bloom filter of them
#: (8 MB at most) drops other rows before the shuffle; where they are not, all rows shuffle.
FETCH_CONF = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64MB",
}


def _order(keep: str) -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63) if keep == "max" else (1 << 63) - 1))


def stage(docs: DataFrame, digest=F.unhex, folder: str | None = None) -> tuple[DataFrame, int]:
    """(staged, base): row_id (the locator), doc_id, text_sha256, digest, content, and the row's other columns as struct ``doc``; rows of this call have row_id >= base."""
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(content, 256).alias("text_sha256"), F.col("text").alias("text"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc"))
    rows = rows.withColumn("digest", digest(F.col("text_sha256")))
    if folder is None:
        return materialize(rows, "exact-staged"), 0
    spark, path = docs.sparkSession, f"{folder.rstrip('/')}/staged"
    # exists before the stream does, with the schema that the first call gave it
    rows.limit(0).write.mode("append").parquet(path)
    base = spark.read.schema("row_id long").parquet(path).agg(F.coalesce(F.max("row_id") + 1, F.lit(0))).head()[0]
    rows.withColumn("row_id", F.col("row_id") + F.lit(base)).write.mode("append").option("compression", "zstd").parquet(path)
    staged = spark.read.schema(rows.schema).parquet(path)
    staged._scratch_path = path
    return staged, base


def keep_state(staged: DataFrame, keep: str, bytes_per_batch: int, folder: str | None = None) -> DataFrame:
    """Run the stream over what is new in the staged table; its state as a table (digest, locator, keep_id, group_size)."""
    spark = staged.sparkSession
    where = scratch_path(spark, "exact-state") if folder is None else f"{folder.rstrip('/')}/state-{keep}"
    pick = F.max_by if keep == "max" else F.min_by
    with conf_of(spark, STATE_CONF):
        rows = spark.readStream.schema(staged.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(staged._scratch_path)
        kept = rows.select("digest", "row_id", "doc_id").groupBy("digest").agg(pick("row_id", _order(keep)).alias("locator"), F.count(F.lit(1)).alias("group_size"))
        query = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", where).trigger(availableNow=True).start()
        query.awaitTermination()
        if not staged.head(1):
            if folder is None:
                delete(spark, where)
            return staged.limit(0).select("digest", F.col("row_id").alias("locator"), F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"))
        state = spark.read.format("statestore").load(where)
        named = state.select(F.col("key.digest").alias("digest"), F.col("value.valueWithExtremumOrdering").alias("locator"), F.col("value.extremumOrdering").alias("o"), F.col("value.count").alias("group_size"))
        out = materialize(named.withColumn("keep_id", F.when(F.col("o") != (-(1 << 63) if keep == "max" else (1 << 63) - 1), F.col("o"))).drop("o"), "exact-kept")
    if folder is None:
        delete(spark, where)
    return out


def colliding(staged: DataFrame, state: DataFrame, base: int = 0) -> DataFrame:
    """The digests under which a check of the full bytes against the located content fails (none, for SHA-256); written once.

    base: rows before it were checked by earlier calls; they are fetched only where they hold the located content,
    or where a new row has become the located one.
    """
    groups = state.filter("group_size > 1").select("digest", "locator")
    with conf_of(staged.sparkSession, FETCH_CONF):
        met = staged.select("row_id", "digest", F.coalesce("text", F.lit("")).alias("content")).join(groups, "digest")
        hits = materialize(met.filter((F.greatest("row_id", "locator") >= base) | (F.col("row_id") == F.col("locator"))) if base else met, "exact-hits")
    located = hits.filter("row_id = locator").select("digest", F.col("content").alias("located"))
    # made distinct after it is written: an aggregation in the join's own stage would keep a hot digest in one task
    out = materialize(hits.filter("row_id <> locator").join(located, "digest").filter(F.col("content") != F.col("located")).select("digest"), "exact-collisions")
    release(hits)
    return out.distinct()


def batch_bytes(spark: SparkSession) -> int:
    """Bytes of one micro-batch: sixteen input splits for each core, so that the number of batches does not grow with a cluster that grows with its tables."""
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return 16 * split * spark.sparkContext.defaultParallelism


def deduplicate(docs: DataFrame, keep: str = "max", bytes_per_batch: int | None = None, digest=F.unhex, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(judged, staged): row_id, doc_id, text_sha256, locator, keep_id, group_size, kept of each row; the staged table.

    keep: which doc_id of equal texts stays, ``max`` or ``min``.  bytes_per_batch: staged bytes that one
    micro-batch reads (None: by the cores of the cluster).  digest: makes the state's key from the SHA-256 in hex; a weak one costs checks, but
    never gives other results.  folder: a shared folder that keeps the staged table and the state for later calls
    (one at a time, always with the same ``keep`` and ``digest``); None: they are scratch tables.
    """
    staged, base = stage(docs, digest, folder)
    state = keep_state(staged, keep, bytes_per_batch or batch_bytes(docs.sparkSession), folder)
    new = staged.filter(F.col("row_id") >= base) if base else staged
    rows = new.select("row_id", "doc_id", "text_sha256", "digest")
    clash = colliding(staged, state, base)
    if folder is not None:  # a digest that once collided stays split
        known = f"{folder.rstrip('/')}/collisions"
        clash.write.mode("append").parquet(known)
        clash = docs.sparkSession.read.schema(clash.schema).parquet(known).distinct()
    judged = rows.join(state, "digest")
    if not clash.isEmpty():
        pick = F.max_by if keep == "max" else F.min_by
        pair = pick(F.struct("row_id", "doc_id"), _order(keep))
        texts = staged.select("row_id", "doc_id", "text_sha256", "digest", F.coalesce("text", F.lit("")).alias("content")).join(clash, "digest", "left_semi")
        groups = texts.groupBy("digest", "content").agg(pair.alias("p"), F.count(F.lit(1)).alias("group_size")).select("digest", "content", F.col("p.row_id").alias("locator"), F.col("p.doc_id").alias("keep_id"), "group_size")
        judged = rows.join(clash, "digest", "left_anti").join(state, "digest").unionByName(texts.filter(F.col("row_id") >= base).join(groups, ["digest", "content"]).drop("content"))
    return judged.select("row_id", "doc_id", "text_sha256", "locator", "keep_id", "group_size", (F.col("row_id") == F.col("locator")).alias("kept")), staged


def kept_documents(docs: DataFrame, keep: str = "max", folder: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    judged, staged = deduplicate(docs, keep, folder=folder)
    stay = judged.filter("kept").select("row_id")
    whole = staged.join(stay, "row_id", "left_semi")
    return whole.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
