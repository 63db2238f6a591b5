"""Sharding by sampled splitters under the law ``bytes``: shard sizes near equal.

Records are ordered by a key, the hash of their text, so that equal texts are neighbours.

1. A size-weighted sample of keys is drawn: each record with probability size * m / total, decided by a hash
   of the record, so a retry draws the same sample.  Its quantiles are the boundaries of ``fine`` key ranges
   per shard.
2. Records are range-partitioned by a binary search over the boundaries; bytes and rows of each range are
   counted exactly.
3. Overfull ranges are subdivided: texts that alone exceed a range's share become units of their own, and
   one that exceeds a shard is cut into parts by doc_id; what is left of the range is cut evenly.
4. Units are laid on shards in key order by their cumulative bytes; large units go first, largest on the
   emptiest shard.  Group of equal texts stay in one shard unless they exceed the share of a shard.
5. Slots: each unit is numbered in cells of bounded size, each cell starting where the one before ends.

Everything that reaches the driver is bounded by shards * fine (boundaries and units), whatever the input.
No range, unit or cell grows with one hot text: cells are cut by bytes and by rows.

Defined results: a null text has no bytes and the checksum of the empty text; null doc_ids are placed like
others; repeated rows get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from nearfield.llm.common import literal_table, materialize

OVERHEAD = 8
#: Expected number of sampled keys per fine range.
SAMPLES_PER_RANGE = 16


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key of each document; written once, without the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key")),
        "shard-measured",
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Boundaries of ``ranges`` key ranges: quantiles of a size-weighted sample of about 16 keys a range."""
    per_sample = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    luck = F.pmod(F.xxhash64("doc_id", "key", "size", F.lit(20)), F.lit(1 << 30)).cast("double") / (1 << 30)
    drawn = rows.filter(luck < F.col("size") / per_sample).select("key", F.ceil(F.col("size") / per_sample).cast("long").alias("weight"))
    at = [i / ranges for i in range(1, ranges)]
    # key order of signed longs; percentile works on doubles, so cut the key to 52 bits first
    cut = F.shiftright("key", 12)
    found = drawn.agg(F.percentile(cut, F.array(*map(F.lit, at)), F.col("weight")).alias("b")).head()
    return sorted({int(x) << 12 for x in found.b}) if found and found.b else []


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at most the key: a binary search."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds).cast("array<bigint>")
    steps = len(bounds).bit_length()

    def step(lo: Column, width: Column) -> Column:
        mid = lo + width
        return F.when((mid <= len(bounds)) & (F.get(table, (mid - 1).cast("int")) <= key), mid).otherwise(lo)

    widths = F.lit([1 << i for i in reversed(range(steps))]).cast("array<bigint>")
    return F.aggregate(widths, F.lit(0).cast("long"), step)


def plan_units(units: list[dict], shards: int) -> dict[tuple, int]:
    """Shard of each unit (bytes, id): large ones first on the emptiest shard, the others in key order."""
    total = sum(u["bytes"] for u in units)
    share = total / shards
    load, where = [0] * shards, {}
    large = sorted((u for u in units if u["bytes"] * 64 > share), key=lambda u: (-u["bytes"], u["id"]))
    for u in large:
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += u["bytes"]
        where[u["id"]] = s
    s = 0
    rest = sum(u["bytes"] for u in units if u["id"] not in where)
    room = [max(0.0, share - x) for x in load]
    scale = rest / (sum(room) or 1)
    ends, acc = [], 0.0
    for x in room:
        acc += x * scale
        ends.append(acc)
    done = 0
    for u in sorted((u for u in units if u["id"] not in where), key=lambda u: u["id"]):
        middle = done + u["bytes"] / 2
        while s < shards - 1 and middle > ends[s]:
            s += 1
        where[u["id"]] = s
        done += u["bytes"]
    return where


def assign(docs: DataFrame, shards: int = 24, fine: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not law ``key``) of every document."""
    rows = measured(docs)
    spark = rows.sparkSession
    said = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).head()
    total, count, ranges = said.b or 0, said.n, shards * fine
    bounds = splitters(rows, total, ranges) if count else []
    placed = rows.withColumn("range", range_of(F.col("key"), bounds))
    fair_bytes, fair_rows = max(1, total // ranges), max(1, -(-count // ranges))
    share = max(1, total // shards)

    # texts that alone exceed a range's share of bytes or rows: at most 2 * ranges of them
    heavy = materialize(placed.groupBy("range", "key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).filter((F.col("bytes") > fair_bytes) & (F.col("rows") > 1) | (F.col("rows") > fair_rows)), "shard-heavy")
    # parts: units that one text is cut into; cells: pieces of bounded size in which slots are numbered
    heavy_plan = heavy.select("range", "key", F.when(F.col("bytes") > share, F.ceil(F.col("bytes") / F.lit(fair_bytes))).otherwise(1).cast("long").alias("parts"), F.greatest(F.ceil(F.col("bytes") / F.lit(fair_bytes)), F.ceil(F.col("rows") / F.lit(fair_rows))).cast("long").alias("cells"))
    spread = F.pmod(F.xxhash64("doc_id", "size", F.lit(7)), F.lit(1 << 30))
    marked = placed.join(F.broadcast(heavy_plan), ["range", "key"], "left")
    # what is left of a range: cut by the next bits of a hash of the key if overfull
    left = marked.filter("cells IS NULL").groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    left_plan = left.select("range", F.greatest(F.ceil(F.col("bytes") / F.lit(fair_bytes)), F.ceil(F.col("rows") / F.lit(2 * fair_rows))).cast("long").alias("cuts"))
    named = marked.join(F.broadcast(left_plan), "range", "left").select(
        "doc_id", "size", "text_crc32", "key", "range",
        F.when(F.col("cells").isNotNull(), F.col("key")).alias("hot"),
        F.when(F.col("cells").isNotNull(), F.pmod(spread, F.col("parts"))).otherwise(F.pmod(F.xxhash64("key", F.lit(9)), F.greatest(F.col("cuts"), F.lit(1)))).alias("part"),
        F.when(F.col("cells").isNotNull(), F.pmod(F.shiftright(spread, 5), F.greatest(F.ceil(F.col("cells") / F.col("parts")), F.lit(1)))).otherwise(0).alias("cell"),
    )
    cells = named.groupBy("range", "hot", "part", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()

    sizes: dict[tuple, int] = {}
    name = lambda c: (c.range, c.hot is not None, c.hot or 0, c.part)
    for c in cells:
        sizes[name(c)] = sizes.get(name(c), 0) + c.bytes
    where = plan_units([{"id": k, "bytes": v} for k, v in sizes.items()], shards)
    used, lines = [0] * shards, []
    for c in sorted(cells, key=lambda c: (name(c), c.cell)):
        s = where[name(c)]
        lines.append({"range": c.range, "h": c.hot or 0, "is_hot": c.hot is not None, "part": c.part, "cell": c.cell, "shard": s, "first": used[s]})
        used[s] += c.rows
    plan = literal_table(spark, "range:bigint,h:bigint,is_hot:boolean,part:bigint,cell:bigint,shard:int,first:bigint", json.dumps(lines))
    keyed = named.select("doc_id", "size", "text_crc32", "key", "range", F.coalesce("hot", F.lit(0).cast("long")).alias("h"), F.col("hot").isNotNull().alias("is_hot"), "part", F.col("cell").cast("long").alias("cell"))
    within = Window.partitionBy("range", "h", "is_hot", "part", "cell").orderBy("key", "doc_id", "size")
    numbered = keyed.withColumn("nth", F.row_number().over(within).cast("long") - 1)
    return numbered.join(F.broadcast(plan), ["range", "h", "is_hot", "part", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
