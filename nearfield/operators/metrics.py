"""Serving metrics over an event table (index, ts, event_id, latency, failed).

Percentiles are exact order statistics found without gathering a key: equal values are counted first, then
the bucket that holds the rank, then the value in it.  Folds that depend on the order of events (moving
average, token bucket, circuit breaker) stream each key's sorted rows through one task with constant state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the service: a latency window drops its oldest 5000 beyond 10,000 samples.
WINDOW_MOST, WINDOW_DROP = 10_000, 5_000
EMA_NEW, EMA_OLD = 0.1, 0.9
TIMEOUT_DEFAULT_MS, TIMEOUT_LEAST_MS, TIMEOUT_MOST_MS = 5000, 1000, 30_000
RATE_PER_SECOND, RATE_BURST = 10_000, 100
BREAKER_THRESHOLD, BREAKER_TIMEOUT_MS, BREAKER_DECAY, BREAKER_CHECK_MS = 0.5, 30_000, 0.95, 5_000
SPLITS = 64


def order_statistics(rows: DataFrame, key: str, value: str, p: list[float]) -> DataFrame:
    """(key, p, value): the value at place floor(p * (n - 1)) of each key's sorted values; null is a key like others.

    Buckets end at values drawn by their hash, which are the same wherever and in whatever order they are found.
    """
    # a struct, so that joins keep a null key
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.struct(key).alias("k"), value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("k").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values"))
    drawn = F.pmod(F.xxhash64(value, F.lit(7)), F.lit(1 << 30)) < F.lit(SPLITS << 30) / F.col("values")
    splits = counts.join(totals, "k").groupBy("k", "total").agg(F.sort_array(F.collect_list(F.when(drawn, F.col(value)))).alias("splits"))
    placed = counts.join(splits, "k").select("k", value, "n", "total", F.size(F.filter("splits", lambda s: s <= F.col(value))).alias("bucket"))
    buckets = placed.groupBy("k", "bucket", "total").agg(F.sum("n").alias("in_bucket"))
    before = buckets.withColumn("before", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = before.select("*", F.explode(F.lit(p).cast("array<double>")).alias("p")).withColumn("place", F.floor(F.col("p").cast("decimal(18,9)") * (F.col("total") - 1)).cast("long"))
    wanted = wanted.filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("in_bucket"))).select("k", "bucket", "p", "place", "before")
    inside = placed.join(wanted.select("k", "bucket").distinct(), ["k", "bucket"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("k", "bucket").orderBy(value))
    running = inside.select("k", "bucket", value, "n", upto.alias("upto"))
    met = running.join(wanted, ["k", "bucket"]).filter((F.col("before") + F.col("upto") > F.col("place")) & (F.col("before") + F.col("upto") - F.col("n") <= F.col("place")))
    return met.select(F.col(f"k.{key}").alias(key), "p", value)


def latency_percentiles(events: DataFrame) -> DataFrame:
    """index, p50, p95, p99, and the true mean; all null for an index without latencies."""
    at = order_statistics(events, "index", "latency", [0.5, 0.95, 0.99])
    wide = at.groupBy(F.struct("index").alias("k")).agg(*[F.max(F.when(F.col("p") == p, F.col("latency"))).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    means = events.groupBy(F.struct("index").alias("k")).agg(F.avg("latency").alias("mean"))
    return means.join(wide, "k", "left").select("k.index", "p50", "p95", "p99", "mean")


def latency_window(events: DataFrame) -> DataFrame:
    """index, n, dropped, retained: what the capped window of samples holds at the end."""
    n = events.groupBy("index").agg(F.count(F.lit(1)).alias("n"))
    dropped = F.when(F.col("n") > WINDOW_MOST, (F.floor((F.col("n") - WINDOW_MOST - 1) / WINDOW_DROP) + 1) * WINDOW_DROP).otherwise(0).cast("long")
    return n.select("index", "n", dropped.alias("dropped"), (F.col("n") - dropped).alias("retained"))


def search_counts(events: DataFrame) -> DataFrame:
    """index, searches, qps over the whole span of its events."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return events.groupBy("index").agg(F.count(F.lit(1)).alias("searches"), span.alias("seconds")).select("index", "searches", F.when(F.col("seconds") > 0, F.col("searches") / F.col("seconds")).alias("qps"))


def error_rate(events: DataFrame, by: str) -> DataFrame:
    """by, requests, errors, error_rate (0 without requests)."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("failed").cast("long")).alias("errors")).withColumn("error_rate", F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")).otherwise(0.0))


def _fold(events: DataFrame, columns: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict | None], schema: str, last: Callable[[dict], dict] | None = None) -> DataFrame:
    """Streams each key's rows in order through ``step``; rows of its own, or one per key from ``last``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, has = None, start(), [], False

        def told(rows: list[dict]) -> pa.RecordBatch:
            kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)], names)

        for b in batches:
            for row in b.to_pylist():
                if not has or row["key"] != key:
                    if has and last:
                        out.append({"key": key} | last(state))
                    key, state, has = row["key"], start(), True
                made = step(state, row)
                if made is not None:
                    out.append({"key": key} | made)
            if len(out) > 10_000:
                yield told(out)
                out = []
        if has and last:
            out.append({"key": key} | last(state))
        yield told(out)

    ordered = events.repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return ordered.select("key", *columns).mapInArrow(run, schema)


def latency_ema(events: DataFrame) -> DataFrame:
    """index, ema_ms, timeout_ms: moving average in whole milliseconds, and three times it within its bounds.

    The first sample seeds it, and one after an average of 0 seeds it again; failures do not count.
    """

    def step(state: dict, row: dict) -> None:
        x = int(row["latency"])
        state["ema"] = x if state["ema"] == 0 else int(state["ema"] * EMA_OLD + x * EMA_NEW)

    rows = events.filter("NOT failed AND latency IS NOT NULL").withColumnRenamed("index", "key")
    got = _fold(rows, ["latency"], lambda: {"ema": 0}, step, "key string, ema long", lambda s: {"ema": s["ema"]})
    timeout = F.greatest(F.lit(TIMEOUT_LEAST_MS), F.least(F.lit(TIMEOUT_MOST_MS), F.col("ema") * 3)).cast("long")
    return got.select(F.col("key").alias("index"), F.col("ema").alias("ema_ms"), timeout.alias("timeout_ms"))


def adaptive_batch_size(load: DataFrame) -> DataFrame:
    """Adds batch_size: 16 below a load of 0.3, 32 below 0.7, else 64."""
    return load.withColumn("batch_size", F.when(F.col("load") < 0.3, 16).when(F.col("load") < 0.7, 32).otherwise(64).cast("long"))


def rate_limit(events: DataFrame, per_second: int = RATE_PER_SECOND, burst: int = RATE_BURST) -> DataFrame:
    """key, event_id, admitted: a token bucket per key; a refill drops the part of a token left over."""
    period = 1_000_000_000 // per_second

    def step(state: dict, row: dict) -> dict:
        if state["at"] is None:
            state["at"] = row["us"] * 1000
        gone = row["us"] * 1000 - state["at"]
        if gone >= period:
            state["tokens"], state["at"] = min(burst, state["tokens"] + gone // period), row["us"] * 1000
        ok = state["tokens"] >= 1
        state["tokens"] -= ok
        return {"event_id": row["event_id"], "admitted": bool(ok)}

    rows = events.withColumnRenamed("index", "key").withColumn("us", F.unix_micros("ts"))
    return _fold(rows, ["event_id", "us"], lambda: {"tokens": burst, "at": None}, step, "key string, event_id long, admitted boolean").withColumnRenamed("key", "index")


def circuit_breaker(events: DataFrame, threshold: float = BREAKER_THRESHOLD) -> DataFrame:
    """key, event_id, open: whether the circuit is open after each event.

    Opens above the threshold of failures, closes below it or after the timeout; counts decay at each health
    check (here: by the events' own time), and a circuit open for twice the timeout starts anew.
    """

    def step(state: dict, row: dict) -> dict:
        now = row["us"] // 1000
        if state["check"] is None:
            state["check"] = now + BREAKER_CHECK_MS
        while state["check"] <= now:
            if state["ok"] == 0 and state["bad"] == 0 and not state["open"]:  # nothing left to decay
                state["check"] += -(-(now - state["check"] + 1) // BREAKER_CHECK_MS) * BREAKER_CHECK_MS
                break
            state["ok"], state["bad"] = int(state["ok"] * BREAKER_DECAY), int(state["bad"] * BREAKER_DECAY)
            if state["open"] and state["check"] - state["failed"] > 2 * BREAKER_TIMEOUT_MS:
                state |= {"open": False, "bad": 0, "ok": 1}
            state["check"] += BREAKER_CHECK_MS
        if state["open"] and now - state["failed"] > BREAKER_TIMEOUT_MS:
            state["open"] = False
        if row["failed"]:
            state["bad"], state["failed"] = state["bad"] + 1, now
            if state["bad"] / (state["ok"] + state["bad"]) > threshold:
                state["open"] = True
        else:
            state["ok"] += 1
            if state["bad"] / (state["ok"] + state["bad"]) < threshold:
                state["open"] = False
        return {"event_id": row["event_id"], "open": state["open"]}

    rows = events.withColumnRenamed("index", "key").withColumn("us", F.unix_micros("ts"))
    return _fold(rows, ["event_id", "us", "failed"], lambda: {"ok": 0, "bad": 0, "failed": 0, "open": False, "check": None}, step, "key string, event_id long, open boolean").withColumnRenamed("key", "index")


def priority_order(requests: DataFrame) -> DataFrame:
    """All requests, higher priority first, then the earlier (a range-partitioned sort)."""
    return requests.orderBy(F.col("priority").desc(), "ts", "event_id")


def prometheus(metrics: DataFrame, gauges: dict[str, float], prefix: str = "nearfield") -> str:
    """Exposition text of (index, p50, p95, p99, searches), one row per index, and of single gauges."""
    rows = metrics.orderBy("index").collect()
    head = lambda name, kind, says: [f"# HELP {prefix}_{name} {says}", f"# TYPE {prefix}_{name} {kind}"]
    lines = head("search_duration_milliseconds", "summary", "Latency of searches")
    lines += [f'{prefix}_search_duration_milliseconds{{index="{r["index"]}",quantile="{q}"}} {r[c]:g}' for r in rows for q, c in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))]
    lines += head("searches_total", "counter", "Searches so far")
    lines += [f'{prefix}_searches_total{{index="{r["index"]}"}} {r["searches"]}' for r in rows]
    for name, value in gauges.items():
        lines += [*head(name, "gauge", name.replace("_", " ")), f"{prefix}_{name} {value:g}"]
    return "\n".join(lines) + "\n"
