"""Access patterns of readers: strides, the pattern of the last hundred accesses, predictions, hot lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accesses remembered per reader, predictions made, and the share that makes a pattern.
HISTORY, DEPTH, SHARE = 100, 4, 0.8


def strides(accesses: DataFrame) -> DataFrame:
    """reader, seq, offset, stride (null for a reader's first access)."""
    w = Window.partitionBy("reader").orderBy("seq")
    return accesses.select("reader", "seq", "offset", (F.col("offset") - F.lag("offset").over(w)).alias("stride"))


def recent(accesses: DataFrame, history: int = HISTORY) -> DataFrame:
    """The last accesses of each reader."""
    return accesses.withColumn("back", F.row_number().over(Window.partitionBy("reader").orderBy(F.desc("seq")))).filter(F.col("back") <= history).drop("back")


def patterns(accesses: DataFrame, history: int = HISTORY) -> DataFrame:
    """reader, n, pattern, stride, avg_size, last_offset.

    Under three accesses: Random.  The stride that occurs most (the smallest of those, and more than once) makes
    a pattern if it is positive and its share exceeds 0.8: Sequential if also more than 0.8 of the strides are
    positive, the smallest stride not counted; else Strided.
    """
    last = recent(accesses, history)
    base = last.groupBy("reader").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("size")).cast("long").alias("avg_size"), F.max_by("offset", "seq").alias("last_offset"))
    gaps = strides(last).filter("stride IS NOT NULL")
    common = gaps.groupBy("reader", "stride").agg(F.count(F.lit(1)).alias("times"))
    best = common.groupBy("reader").agg(F.min_by("stride", F.struct(-F.col("times"), F.col("stride"))).alias("mode"), F.max("times").alias("times"))
    positive = gaps.groupBy("reader").agg((F.sum((F.col("stride") > 0).cast("long")) - (F.min("stride") > 0).cast("long")).alias("positive"), F.count(F.lit(1)).alias("gaps"))
    met = base.join(best, "reader", "left").join(positive, "reader", "left")
    is_pattern = F.coalesce((F.col("n") >= 3) & (F.col("times") > 1) & (F.col("times") / F.col("gaps") > SHARE) & (F.col("mode") > 0), F.lit(False))
    kind = F.when(is_pattern, F.when(F.col("positive") / F.col("gaps") > SHARE, "Sequential").otherwise("Strided")).otherwise("Random")
    return met.select("reader", "n", kind.alias("pattern"), F.when(is_pattern, F.col("mode")).otherwise(0).cast("long").alias("stride"), "avg_size", "last_offset")


def predictions(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """reader, step, offset, size: the next offsets of readers with a pattern."""
    ahead = found.filter("pattern <> 'Random'").select("reader", "stride", "avg_size", "last_offset", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("step"))
    return ahead.select("reader", F.col("step").cast("long").alias("step"), (F.col("last_offset") + F.col("step") * F.col("stride")).alias("offset"), F.col("avg_size").alias("size"))


def list_access(probes: DataFrame) -> DataFrame:
    """list_id, accesses, last_query over probes (query_id, list_id)."""
    return probes.groupBy("list_id").agg(F.count(F.lit(1)).alias("accesses"), F.max("query_id").alias("last_query"))


def hot_lists(probes: DataFrame, n: int) -> DataFrame:
    """The n lists probed most, ties to the lowest."""
    return list_access(probes).orderBy(F.desc("accesses"), "list_id").limit(n)
