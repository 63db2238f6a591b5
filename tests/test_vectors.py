"""Distances, exact search, index search and quantisation against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distance, validate
from nearfield.functions.validate import InvalidArgument
from nearfield.operators import kmeans, knn, pq
from nearfield.operators.ivf import IVFIndex

RNG = np.random.default_rng(7)
X = np.round(RNG.normal(size=(300, 8)), 3)
X[50], X[51] = 0.0, X[10]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vector array<double>").repartition(3).cache()


def asked(rows, ids=(0, 10, 50, 123)):
    return rows.filter(F.col("id").isin(*ids)).select(F.col("id").alias("query_id"), "vector")


def numpy_distance(a, b, metric):
    if metric == "L2":
        return float(((a - b) ** 2).sum())
    if metric == "InnerProduct":
        return float(-(a * b).sum())
    return float(1 - (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()) + 1e-8))


def brute(q, metric, k, among=range(300)):
    return sorted((round(numpy_distance(X[i], X[q], metric), 9), i) for i in among)[:k]


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((round(r.distance, 9), r.id))
    return out


@pytest.mark.parametrize("metric", validate.METRICS)
def test_exact_search(rows, metric):
    got = by_query(knn.search_exact(rows, asked(rows), 7, metric))
    for q in (0, 10, 50, 123):
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in brute(q, metric, 7)], abs=1e-8)
        assert got[q] == sorted(got[q])


def test_ties_go_to_the_lower_id(rows):
    got = by_query(knn.search_exact(rows, asked(rows, (10,)), 2))
    assert got[10] == [(0.0, 10), (0.0, 51)]


def test_query_blocks_give_the_same(rows):
    one = by_query(knn.search_exact(rows, asked(rows), 5))
    blocks = [r for part in knn.query_blocks(asked(rows), 130) for r in part]
    assert len(blocks) == 4
    parts = list(knn.query_blocks(asked(rows), 130))
    assert len(parts) > 1
    got = knn.ranked(knn.score(rows, (knn.block_of(p, 5) for p in parts if p), "L2"), 5)
    assert by_query(got) == one


@pytest.mark.parametrize("metric", validate.METRICS)
def test_columns_agree_with_numpy(spark, rows, metric):
    distance.register(spark)
    got = {r.id: r for r in rows.select("id", distance.BY_METRIC[metric](F.col("vector"), F.lit(X[3].tolist())).alias("d")).collect()}
    assert all(r.d == pytest.approx(numpy_distance(X[i], X[3], metric), abs=1e-9) for i, r in got.items())
    rows.createOrReplaceTempView("rows_of_test")
    name = {"L2": "l2_sq", "InnerProduct": "neg_inner_product", "Cosine": "cosine_distance"}[metric]
    again = spark.sql(f"SELECT a.id, {name}(a.vector, b.vector) AS d FROM rows_of_test a JOIN rows_of_test b ON b.id = 3").collect()
    assert all(r.d == pytest.approx(got[r.id].d, abs=1e-12) for r in again)


def test_zero_vector_is_at_cosine_distance_one(rows):
    assert rows.filter("id = 50").select(distance.cosine_distance(F.col("vector"), F.lit(X[3].tolist()))).head()[0] == 1.0


def test_unequal_lengths_give_null(spark):
    assert spark.range(1).select(distance.l2_sq(F.lit([1.0, 2.0]), F.lit([1.0]))).head()[0] is None


def test_invalid_vectors(spark):
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [float("inf"), 0.0])], "id long, vector array<double>")
    assert sorted(r.id for r in validate.mismatched(bad, 2).collect()) == [2, 3, 4, 5, 6]


def test_kmeans_keeps_empty_clusters_and_is_deterministic():
    x = np.array([[0.0], [0.0], [10.0]])
    c = kmeans.train(x, 3)
    assert len(c) == 3 and (c == kmeans.train(x, 3)).all()
    assert kmeans.farthest_first(x, 2).tolist() == [0, 2]
    assert len(set(kmeans.d2_sampling(X, 5).tolist())) == 5


def test_full_probe_equals_exact_and_recall_grows(rows):
    index = IVFIndex.build(rows, 6)
    exact = knn.search_exact(rows, asked(rows), 5)
    assert by_query(index.search(asked(rows), 5, 99)) == by_query(exact)
    recalls = [knn.recall(index.search(asked(rows), 5, n), exact, 5).agg(F.avg("recall")).head()[0] for n in (1, 3, 6)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    assert index.list_sizes().agg(F.sum("n")).head()[0] == 300


def test_add_and_repeated_ids(rows):
    index = IVFIndex.build(rows, 4).add(rows.filter("id < 20"))
    got = by_query(index.search(asked(rows, (10,)), 3, 4))
    assert [i for _, i in got[10]][:2] == [10, 51] and len({i for _, i in got[10]}) == 3
    assert index.stats().head().total_vectors == 320


def test_batch_parameters_of_each_query(rows):
    index = IVFIndex.build(rows, 4)
    mixed = asked(rows).withColumn("k", (F.col("query_id") % 3 + 1).cast("int")).withColumn("nprobe", F.lit(4))
    got = by_query(index.search_batch(mixed))
    assert {q: len(v) for q, v in got.items()} == {q: q % 3 + 1 for q in (0, 10, 50, 123)}


def test_quantisation(spark, rows):
    book = pq.Codebook.train(rows, 4, 4)
    codes = {r.id: r.codes for r in pq.encode(rows, book).collect()}
    for i in (0, 50, 299):
        for s in range(4):
            d = ((book.centroids[s] - X[i, 2 * s : 2 * s + 2]) ** 2).sum(axis=1)
            assert d[codes[i][s]] == pytest.approx(d.min())
    found = pq.scan(pq.encode(rows, book), asked(rows), book, 20)
    want = {q: sorted((round(sum(((book.centroids[s][codes[i][s]] - X[q, 2 * s : 2 * s + 2]) ** 2).sum() for s in range(4)), 9), i) for i in range(300))[:20] for q in (0, 123)}
    got = by_query(found)
    assert all([d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], abs=1e-8) for q in want)
    again = by_query(pq.rerank(found, rows, asked(rows), 5))
    assert all(again[q][0][0] == 0.0 for q in again)
    assert book.rows(spark).filter("id <> sub * 65536 + code").isEmpty()


@pytest.mark.parametrize("call", [
    lambda: validate.search_request("", 1, 1, 1), lambda: validate.search_request("a", 0, 1, 1), lambda: validate.search_request("a", 1001, 1, 1), lambda: validate.search_request("a", 1, 1, 0),
    lambda: validate.metric_of("Hamming"), lambda: validate.index_config("", 3), lambda: validate.index_config("a", 0), lambda: validate.index_config("a", 65537), lambda: validate.index_config("a", 10, m=3),
])
def test_bad_arguments(call):
    with pytest.raises(InvalidArgument):
        call()


def test_defaults():
    assert validate.metric_of("") == "L2" and validate.search_request("a", 1000, 0, 1) == 8 and validate.index_config("a", 4) == (1000, 8)


def test_bad_vectors_and_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, None), (4, [1.0, 2.0, 3.0, 4.0]), (5, [1.0, None, 3.0, 4.0]), (6, [float("nan"), 2.0, 3.0, 4.0]), (7, [0.0, 0.0, 0.0, 0.0])], "id long, vector array<double>")
    one = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "query_id long, vector array<double>")
    assert by_query(knn.search_exact(vectors, one, 5)) == {0: [(0.0, 4), (30.0, 7)]}
    assert knn.search_exact(vectors, one.limit(0), 5).count() == 0
    index = IVFIndex.build(vectors.filter("id > 3"), 2)
    assert sorted(r.id for r in index.add(vectors).lists.collect()) == [4, 4, 7, 7]
    assert index.search(one.limit(0), 3, 1).count() == 0
    for bad in ([(0, None)], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0, float("inf"), 0.0, 0.0])], [(0, [1.0, 2.0])]):
        with pytest.raises(InvalidArgument):
            index.search(spark.createDataFrame(bad, "query_id long, vector array<double>"), 3, 1)


def test_list_topk_with_a_repeated_id(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [9.0, 9.0])], "id long, vector array<double>")
    index = IVFIndex.build(vectors, 2).add(spark.createDataFrame([(1, [9.0, 8.0])], "id long, vector array<double>"))
    one = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, vector array<double>")
    got = index.list_topk(one, 5, 1).collect()
    assert [(r.query_id, r.id, r.distance) for r in got] == [(0, 1, 0.0)] and len({r.list_id for r in got}) == 1


def test_batch_requests_are_checked(spark, rows):
    index = IVFIndex.build(rows, 4)
    ask = lambda k, nprobe: asked(rows, (0,)).withColumns({"k": F.lit(k), "nprobe": F.lit(nprobe)})
    assert index.search_batch(ask(3, 0)).count() == 3
    for k in (0, 5000):
        with pytest.raises(InvalidArgument):
            index.search_batch(ask(k, 2)).count()
    book = pq.Codebook.train(rows, 4, 3)
    assert pq.scan(pq.encode(index.lists, book), ask(3, 0), book, None, index).count() == 3


@pytest.mark.parametrize("metric", validate.METRICS)
def test_the_product_keeps_order_and_ties(metric):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 24)), np.round(rng.normal(size=(400, 24))), np.zeros((2, 24))]) * 10.0 ** rng.integers(-3, 4, size=(802, 1))
    x[700:720] = x[5]
    plain = knn.pair_distances(x, x[:40], metric)
    block = knn.QueryBlock(np.arange(40), x[:40], np.full(40, 7))
    for q, i, d, _ in knn.nearest_in_batch(np.arange(len(x)), x, None, block, metric):
        assert (d == plain[i, q]).all()
        for one in range(40):
            want = np.lexsort((np.arange(len(x)), plain[:, one]))[:7]
            some = q == one
            assert i[some][np.lexsort((i[some], d[some]))][:7].tolist() == want.tolist()
    assert (kmeans.nearest(x, x[:40], metric) == plain.argmin(axis=1)).all()


@pytest.mark.parametrize(("m", "candidates"), [(1, 1 << 20), (1, 400), (4, 1 << 20), (4, 400)])
def test_training_where_the_vectors_lie_gives_the_same(rows, monkeypatch, m, candidates):
    monkeypatch.setattr(kmeans, "CANDIDATE_BYTES", candidates)
    bad = rows.sparkSession.createDataFrame([(-3, None), (-2, [1.0]), (-1, [float("nan")] * 8), (400, [1.0] * 7)], "id long, vector array<double>")
    here, there = (kmeans.fit(rows.unionByName(bad.filter("id <> -2")), 12, m=m, held_bytes=b) for b in (1 << 30, 0))
    assert here.shape == there.shape == (m, 12, 8 // m) and np.abs(here - there).max() < 1e-8
    assert kmeans.seed_ids(rows, 12, 0) == kmeans.seed_ids(rows, 12) == kmeans.farthest_first(X, 12).tolist()


def test_training_where_the_vectors_lie_by_squared_distances_and_of_few_or_no_vectors(rows):
    there = kmeans.fit(rows, 5, seeding="d2", held_bytes=0)
    assert there.shape == (1, 5, 8) and (there == kmeans.fit(rows, 5, seeding="d2", held_bytes=0)).all()
    for held in (0, 1 << 30):
        assert len(kmeans.fit(rows.filter("id < 3"), 7, held_bytes=held)[0]) == 3
    with pytest.raises(ValueError, match="no vectors"):
        kmeans.fit(rows.filter("id < 0"), 7, held_bytes=-1)


def test_all_vectors_train_however_many(spark):
    rows = spark.range(0, kmeans.MAX_TRAIN + 40_000, 1, 4).select("id", F.array((F.col("id") % 1000).cast("double")).alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("id") % 20_000 == 17, F.array(1e6 + F.col("id"))).otherwise(F.col("vector")))
    assert kmeans.seed_ids(rows, 2) == [0, 120_017] and IVFIndex.build(rows, 8).centroids.max() == 1e6 + 120_017
