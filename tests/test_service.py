"""Storage, epochs, the service, streams and metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.validate import InvalidArgument, NotFound
from nearfield.operators import access, metrics
from nearfield.operators.ivf import IVFIndex
from nearfield.plans.service import VectorService
from nearfield.sources import storage
from nearfield.sources.arrow_ipc import ArrowVectors
from nearfield.streaming.micro_batch import stream_add, stream_search

X = np.random.default_rng(3).normal(size=(120, 4))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vector array<double>").repartition(2).cache()


def test_vectors_round_trip_and_slice(spark, rows, tmp_path):
    storage.write_vectors(rows, f"{tmp_path}/v")
    assert storage.read_vectors(spark, f"{tmp_path}/v").count() == 120
    assert sorted(r.id for r in storage.read_vectors(spark, f"{tmp_path}/v", 100, 5).collect()) == [100, 101, 102, 103, 104]
    assert storage.read_vectors(spark, f"{tmp_path}/v", 110).count() == 10
    with pytest.raises(InvalidArgument):
        storage.read_vectors(spark, f"{tmp_path}/v", 500, 5)


def test_arrow_source(spark, rows, tmp_path):
    spark.dataSource.register(ArrowVectors)
    rows.select("id", F.col("vector").cast("array<float>").alias("vector")).write.format("arrow_vectors").mode("append").save(f"{tmp_path}/a")
    back = spark.read.format("arrow_vectors").load(f"{tmp_path}/a")
    assert sorted(r.id for r in back.collect()) == list(range(120)) and back.dtypes == [("id", "bigint"), ("vector", "array<float>")]


def test_benchmark_sink(spark, tmp_path):
    for i in range(2):
        storage.append_benchmark(spark.range(1).withColumn("qps", F.lit(i)), f"{tmp_path}/b")
    assert spark.read.option("header", True).csv(f"{tmp_path}/b").count() == 2


def test_epochs(spark, tmp_path):
    registry = storage.EpochRegistry(spark, f"{tmp_path}/i")
    made = [registry.create(storage.Manifest("i", 4, 2, epoch=f"e{n}", created_at=n)) for n in range(1, 6)]
    registry.activate("e1")
    assert registry.clean(keep=3) == ["e2"]
    assert registry.list() == ["e5", "e4", "e3", "e1"] and made[0] == "e1"
    storage.delete(spark, registry.path("e4"))
    again = storage.EpochRegistry(spark, f"{tmp_path}/i")
    assert again.list() == ["e5", "e3", "e1"] and again.active == "e1"
    again.deactivate()
    assert again.active is None
    with pytest.raises(NotFound):
        again.activate("e9")
    assert again.get("e5").nlist == 2


def test_service(spark, rows, tmp_path):
    service = VectorService(spark, str(tmp_path))
    with pytest.raises(NotFound):
        service.search("nothing", rows.select(F.col("id").alias("query_id"), "vector"))
    service.create_index("flat", 4, nlist=3)
    service.create_index("pq", 4, nlist=3, m=2, nbits=4)
    first = service.build_epoch("flat", rows.filter("id < 100"))
    service.activate_epoch("flat", first)
    ask = rows.filter("id in (5, 110)").select(F.col("id").alias("query_id"), "vector")
    before = service.search("flat", ask, 1, 3)
    service.activate_epoch("flat", service.build_epoch("flat", rows))
    assert {r.query_id: r.id for r in service.search("flat", ask, 1, 3).collect()} == {5: 5, 110: 110}
    assert {r.query_id for r in before.collect() if r.distance == 0} == {5}  # the old epoch still answers
    assert service.stats("flat")["total_vectors"] == 120 and service.warmup("flat", [-1, 0, 1, 2]) == 120
    service.evict("flat")
    storage.write_vectors(rows, f"{tmp_path}/source")
    service.activate_epoch("pq", service.build_epoch("pq", f"{tmp_path}/source"))
    assert {r.query_id: r.id for r in service.search("pq", ask, 1, 3, rerank_exact=True).collect()} == {5: 5, 110: 110}
    for bad in (lambda: service.search("flat", ask, 1, 3, metric="Cosine"), lambda: service.search("flat", ask.withColumn("vector", F.lit([1.0])), 1), lambda: service.search("flat", ask.limit(0), 1), lambda: service.build_epoch("flat", rows.withColumn("vector", F.lit([1.0])))):
        with pytest.raises(InvalidArgument):
            bad()
    batch = ask.withColumns({"index": F.when(F.col("query_id") == 5, "flat").otherwise("gone"), "k": F.lit(2), "nprobe": F.lit(3)})
    found, missing = service.search_batch(batch)
    assert found.count() == 2 and [r.query_id for r in missing.collect()] == [110]
    assert service.health() == "SERVING"


def test_streams(spark, rows, tmp_path):
    index = IVFIndex.build(rows.filter("id < 60"), 3)
    rows.write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stream_add(source(), index, f"{tmp_path}/lists", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/lists").count() == 120
    stream_search(source().filter("id < 3").select(F.col("id").alias("query_id"), "vector"), index, 1, 3, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert {r.query_id: r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {0: 0, 1: 1, 2: 2}


def events(spark, rows):
    got = spark.createDataFrame(rows, "index string, us long, event_id long, latency double, failed boolean")
    return got.withColumn("ts", F.timestamp_micros("us")).drop("us")


def test_order_statistics_of_one_hot_key(spark):
    rows = events(spark, [("a", i, i, float(i % 7), False) for i in range(500)] + [("b", 0, 1000, 3.0, False)])
    got = {r["index"]: r for r in metrics.latency_percentiles(rows).collect()}
    v = sorted(float(i % 7) for i in range(500))
    assert (got["a"].p50, got["a"].p95, got["a"].p99) == tuple(v[int(p * 499)] for p in (0.5, 0.95, 0.99)) and got["b"].p99 == 3.0
    text = metrics.prometheus(metrics.latency_percentiles(rows).join(metrics.search_counts(rows), "index"), {"queries_per_second": 2.0})
    assert 'nearfield_searches_total{index="a"} 500' in text and text.count("# TYPE") == 3


def test_folds(spark):
    rows = events(spark, [("a", i * 10, i, x, False) for i, x in enumerate((0.0, 100.0, 200.0, 205.0))])
    assert [tuple(r) for r in metrics.latency_ema(rows).collect()] == [("a", int(int(100 * 0.9 + 200 * 0.1) * 0.9 + 205 * 0.1), 1000)]
    many = events(spark, [("a", i * 500_000, i, 1.0, False) for i in range(10)])
    ok = [r.admitted for r in metrics.rate_limit(many, 1, 2).orderBy("event_id").collect()]
    assert ok == [True, True, True, False, True, False, True, False, True, False]
    bad = events(spark, [("s", i * 1_000_000, i, 1.0, f) for i, f in enumerate((False, True, True, False, False))] + [("s", 60_000_000, 9, 1.0, True)])
    assert [r.open for r in metrics.circuit_breaker(bad).orderBy("event_id").collect()][:3] == [False, False, True]
    assert metrics.latency_window(events(spark, [("a", 0, 0, 1.0, False)]).select("index")).head().retained == 1


def test_access_patterns(spark):
    rows = spark.createDataFrame([("seq", i, 64 * i, 10) for i in range(10)] + [("few", 0, 0, 5), ("few", 1, 9, 5)] + [("mix", i, (i * i * 37) % 101, 1) for i in range(10)] + [("five", i, 8 * i, 2) for i in range(5)], "reader string, seq long, offset long, size long")
    got = {r.reader: (r.pattern, r.stride) for r in access.patterns(rows).collect()}
    assert got == {"seq": ("Sequential", 64), "few": ("Random", 0), "mix": ("Random", 0), "five": ("Strided", 8)}
    ahead = [r.offset for r in access.predictions(access.patterns(rows)).filter("reader = 'seq'").orderBy("step").collect()]
    assert ahead == [640, 704, 768, 832]
