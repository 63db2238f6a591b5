"""The queries of the vector engine over the test tables, each with its SQL.

Vectors are the embeddings scaled by 1 + vec_id mod 5, so that the metrics rank differently.  Searches take as
queries the rows whose id is divisible by 100.  Events stand for requests: event_type is the index, value the
latency, type ``error`` a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import distance, validate
from nearfield.operators import access, kmeans, knn, metrics, pq
from nearfield.operators.ivf import IVFIndex
from nearfield.sources import storage

K, NLIST, NPROBE, M, NBITS, DIMENSION = 10, 8, 7, 64, 7, 64

# ---- inputs ------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector, label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 5)).alias("vector"), "label")


def asked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_type").alias("index"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"), F.col("user_id").cast("long").alias("user_id"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as reads at offsets: reader, seq, offset, size."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").cast("long").alias("reader"), F.col("l_linenumber").cast("long").alias("seq"), (F.col("l_linenumber") * 100).cast("long").alias("offset"), F.floor("l_quantity").cast("long").alias("size"))


def _index(spark: SparkSession, sf_dir: str, metric: str = "L2") -> tuple[IVFIndex, DataFrame]:
    rows = vectors(spark, sf_dir)
    return IVFIndex.build(rows, NLIST, metric), rows


def _near(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance", 6))


def _six_places(column: str) -> Column:
    """Rounded as the SQL does, halves of the product away from zero; F.round takes the halves of the decimal digits."""
    value = F.col(column)
    product = F.abs(value) * 1e6
    whole = F.rint(product)  # halves to even
    return F.signum(value) * (whole + (product - whole == 0.5).cast("double")) / 1e6


# ---- SQL pieces --------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
_L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _d(metric: str, a: str, b: str) -> str:
    dot = lambda x, y: _DOT.format(x, y)
    return {"L2": _L2.format(a, b), "InnerProduct": f"-{dot(a, b)}", "Cosine": f"1.0 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}) + 1e-8)"}[metric]


_V = "v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5)) AS vector, label FROM embeddings), q AS (SELECT id AS query_id, vector FROM v WHERE id % 100 = 0)"
_R = "r AS (SELECT event_type AS index, ts, event_id, value AS latency, event_type = 'error' AS failed, user_id FROM events)"
_A = "a AS (SELECT l_orderkey::BIGINT AS reader, l_linenumber::BIGINT AS seq, (l_linenumber * 100)::BIGINT AS \"offset\", floor(l_quantity)::BIGINT AS size FROM lineitem)"


def _kmeans(points: str, k: int, steps: int, tag: str = "") -> str:
    """CTEs from points (sub, id, vector) to c{steps} (sub, c, vector): farthest-first seeds, then Lloyd steps."""
    s, d, c, a, m = (f"{x}{tag}" for x in "sdcam")
    out = [f"{s}0 AS MATERIALIZED (SELECT sub, 0 AS c, vector FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY id) AS n FROM {points}) WHERE n = 1)", f"{d}0 AS MATERIALIZED (SELECT p.sub, p.id, p.vector, {_L2.format('p.vector', 's.vector')} AS far FROM {points} p JOIN {s}0 s USING (sub))"]
    for i in range(1, k):
        out.append(f"{s}{i} AS MATERIALIZED (SELECT sub, {i} AS c, vector FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY far DESC, id) AS n FROM {d}{i - 1}) WHERE n = 1)")
        out.append(f"{d}{i} AS MATERIALIZED (SELECT p.sub, p.id, p.vector, least(p.far, {_L2.format('p.vector', 's.vector')}) AS far FROM {d}{i - 1} p JOIN {s}{i} s USING (sub))")
    out.append(f"{c}0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {s}{i}" for i in range(k)) + ")")
    for t in range(1, steps + 1):
        out.append(f"{a}{t} AS MATERIALIZED (SELECT p.sub, p.id, any_value(p.vector) AS vector, min({{'d': {_L2.format('p.vector', 'c.vector')}, 'c': c.c}}).c AS c FROM {points} p JOIN {c}{t - 1} c USING (sub) GROUP BY p.sub, p.id)")
        out.append(f"{m}{t} AS (SELECT sub, c, list(x ORDER BY pos) AS vector FROM (SELECT sub, c, pos, round(avg(x), 9) AS x FROM (SELECT sub, c, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM {a}{t}) GROUP BY ALL) GROUP BY ALL)")
        out.append(f"{c}{t} AS MATERIALIZED (SELECT c.sub, c.c, coalesce(m.vector, c.vector) AS vector FROM {c}{t - 1} c LEFT JOIN {m}{t} m ON c.sub = m.sub AND c.c = m.c)")
    return ", ".join(out)


_KM = f"{_V}, points AS (SELECT 0 AS sub, id, vector FROM v), {_kmeans('points', NLIST, kmeans.ITERATIONS)}, cent AS MATERIALIZED (SELECT c AS list_id, vector FROM c{kmeans.ITERATIONS})"


def _assign(metric: str = "L2") -> str:
    return f"lists AS MATERIALIZED (SELECT v.id, any_value(v.vector) AS vector, min({{'d': {_d(metric, 'v.vector', 'c.vector')}, 'c': c.list_id}}).c AS list_id FROM v CROSS JOIN cent c GROUP BY v.id)"


def _probes(metric: str = "L2") -> str:
    return f"probes AS MATERIALIZED (SELECT query_id, list_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, list_id) AS probe_rank FROM (SELECT q.query_id, c.list_id, {_d(metric, 'q.vector', 'c.vector')} AS d FROM q CROSS JOIN cent c))"


def _top(pairs: str, k: str = str(K), by: str = "query_id", extra: str = "") -> str:
    return f"SELECT {by}, rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY distance, id) AS rank FROM ({pairs})) WHERE rank <= {k}{extra}"


def _exact(metric: str, where: str = "true") -> str:
    return f"SELECT q.query_id, v.id, {_d(metric, 'v.vector', 'q.vector')} AS distance FROM q CROSS JOIN v WHERE {where}"


def _ivf_pairs(metric: str, nprobe: str = str(NPROBE)) -> str:
    return f"SELECT q.query_id, l.id, {_d(metric, 'l.vector', 'q.vector')} AS distance FROM q JOIN probes p ON p.query_id = q.query_id AND probe_rank <= {nprobe} JOIN lists l ON l.list_id = p.list_id"


_BOOK = f"subs AS MATERIALIZED (SELECT sub, id, list_slice(vector, sub * {DIMENSION // M} + 1, (sub + 1) * {DIMENSION // M}) AS vector FROM v CROSS JOIN (SELECT unnest(range({M})) AS sub)), {_kmeans('subs', 2**NBITS, kmeans.ITERATIONS, 'q')}, book AS MATERIALIZED (SELECT sub, c AS code, vector FROM cq{kmeans.ITERATIONS})"
_PQ = f"{_V}, {_BOOK}"
_CODES = f"codes AS MATERIALIZED (SELECT p.sub, p.id, min({{'d': {_L2.format('p.vector', 'b.vector')}, 'c': b.code}}).c AS code FROM subs p JOIN book b USING (sub) GROUP BY p.sub, p.id)"
_TABLE = f"tab AS MATERIALIZED (SELECT q.query_id, b.sub, b.code, {_L2.format(f'list_slice(q.vector, b.sub * {DIMENSION // M} + 1, (b.sub + 1) * {DIMENSION // M})', 'b.vector')} AS d FROM q CROSS JOIN book b)"
_ADC = "SELECT t.query_id, c.id, list_sum(list(t.d ORDER BY c.sub)) AS distance FROM codes c JOIN tab t ON t.sub = c.sub AND t.code = c.code GROUP BY t.query_id, c.id"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---- sources -----------------------------------------------------------------------------------------


@query("SELECT vec_id AS id, len(embedding)::BIGINT AS dimension, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def scan_vectors(spark, sf_dir):
    rows = storage.read_vectors(spark, f"{sf_dir}/embeddings.parquet", id_column="vec_id", vector_column="embedding")
    return rows.select("id", F.size("vector").cast("long").alias("dimension"), F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT id, dimension FROM (SELECT vec_id AS id, len(embedding)::BIGINT AS dimension, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings) WHERE n >= 100 AND n < 150")
def scan_vectors_slice(spark, sf_dir):
    rows = storage.read_vectors(spark, f"{sf_dir}/embeddings.parquet", 100, 50, "vec_id", "embedding")
    return rows.select("id", F.size("vector").cast("long").alias("dimension"))


@query(f"WITH {_KM} SELECT list_id::BIGINT AS list_id, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT list_id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS pos FROM cent)")
def centroids_table(spark, sf_dir):
    index, _ = _index(spark, sf_dir)
    return index.centroid_rows(spark).select("list_id", F.posexplode("centroid").alias("pos", "value")).select("list_id", F.col("pos").cast("long").alias("pos"), _six_places("value").alias("value"))


@query(f"WITH {_KM}, {_assign()} SELECT list_id::BIGINT AS list_id, count(*) AS num_vectors, (count(*) * ({DIMENSION} * 4 + 8))::BIGINT AS bytes FROM lists GROUP BY list_id")
def shard_stats(spark, sf_dir):
    index, _ = _index(spark, sf_dir)
    return index.list_sizes().filter("n > 0").select("list_id", F.col("n").alias("num_vectors"), (F.col("n") * (DIMENSION * 4 + 8)).alias("bytes"))


# ---- distances ---------------------------------------------------------------------------------------


def _distances(spark, sf_dir, metric):
    rows = vectors(spark, sf_dir)
    first = [float(x) for x in rows.orderBy("id").head()["vector"]]
    return rows.select("id", F.round(distance.BY_METRIC[metric](F.col("vector"), F.lit(first)), 6).alias("distance"))


def _distances_sql(metric):
    return f"WITH {_V} SELECT v.id, round({_d(metric, 'v.vector', 'f.vector')}, 6) AS distance FROM v CROSS JOIN (SELECT vector FROM v ORDER BY id LIMIT 1) f"


@query(_distances_sql("L2"))
def dist_l2(spark, sf_dir):
    return _distances(spark, sf_dir, "L2")


@query(_distances_sql("InnerProduct"))
def dist_inner_product(spark, sf_dir):
    return _distances(spark, sf_dir, "InnerProduct")


@query(_distances_sql("Cosine"))
def dist_cosine(spark, sf_dir):
    return _distances(spark, sf_dir, "Cosine")


@query(f"WITH {_V} SELECT id, pos::BIGINT AS pos, round(x / sqrt(n + 1e-8), 6) AS value FROM (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS pos, {_DOT.format('vector', 'vector')} AS n FROM v)")
def normalize_vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", F.posexplode(distance.normalize(F.col("vector"))).alias("pos", "value"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {_V}, w AS (SELECT id, CASE WHEN label = 3 THEN vector[1:60] ELSE vector END AS vector FROM v) SELECT id, len(vector)::BIGINT AS dimension FROM w WHERE len(vector) <> {DIMENSION}")
def dimension_mismatch_rows(spark, sf_dir):
    short = vectors(spark, sf_dir).withColumn("vector", F.when(F.col("label") == 3, F.slice("vector", 1, 60)).otherwise(F.col("vector")))
    return validate.mismatched(short, DIMENSION).select("id", F.size("vector").cast("long").alias("dimension"))


# ---- exact search ------------------------------------------------------------------------------------


def _brute(spark, sf_dir, metric):
    rows = vectors(spark, sf_dir)
    return _near(knn.search_exact(rows, asked(rows), K, metric))


@query(f"WITH {_V} {_top(_exact('L2'))}")
def knn_bruteforce_l2(spark, sf_dir):
    return _brute(spark, sf_dir, "L2")


@query(f"WITH {_V} {_top(_exact('InnerProduct'))}")
def knn_bruteforce_ip(spark, sf_dir):
    return _brute(spark, sf_dir, "InnerProduct")


@query(f"WITH {_V} {_top(_exact('Cosine'))}")
def knn_bruteforce_cosine(spark, sf_dir):
    return _brute(spark, sf_dir, "Cosine")


@query(f"WITH {_V} {_top(_exact('L2', 'label = 3'))}")
def knn_filtered(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _near(knn.search_exact(rows.filter("label = 3"), asked(rows), K))


@query(f"WITH {_V} {_top(_exact('L2', 'label = 3'), '1000')}")
def knn_short_list(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _near(knn.search_exact(rows.filter("label = 3"), asked(rows), validate.MAX_TOPK))


@query(f"WITH {_V} {_top(_exact('L2'))}")
def knn_two_phase(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    parts = [knn.search_exact(rows.filter(F.col("label") % 2 == i), asked(rows), K) for i in range(2)]
    return _near(knn.merge_results(parts, K))


@query(f"WITH {_V} {_top(_exact('L2', 'label <= 5 OR label >= 4'))}")
def merge_dedupe(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    parts = [knn.search_exact(rows.filter(c), asked(rows), K) for c in ("label <= 5", "label >= 4")]
    return _near(knn.merge_results(parts, K))


# ---- k-means -----------------------------------------------------------------------------------------


def _flat(spark, centroids):
    rows = spark.createDataFrame([(i, j, float(x)) for i, c in enumerate(centroids) for j, x in enumerate(c)], "list_id long, pos long, value double")
    return rows.withColumn("value", _six_places("value"))


def _flat_sql(table):
    return f"WITH {_KM} SELECT c::BIGINT AS list_id, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT c, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS pos FROM {table})"


@query(f"WITH {_KM} SELECT s.c::BIGINT AS list_id, v.id FROM c0 s JOIN v ON v.vector = s.vector")
def kmeans_seed(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(kmeans.seed_ids(vectors(spark, sf_dir), NLIST))), "list_id long, id long")


@query(_flat_sql("c1"))
def kmeans_lloyd_1(spark, sf_dir):
    return _flat(spark, kmeans.fit(vectors(spark, sf_dir), NLIST, 1)[0])


@query(_flat_sql(f"c{kmeans.ITERATIONS}"))
def kmeans_train(spark, sf_dir):
    return _flat(spark, kmeans.fit(vectors(spark, sf_dir), NLIST)[0])


# ---- inverted file -----------------------------------------------------------------------------------


@query(f"WITH {_KM}, {_assign()} SELECT id, list_id::BIGINT AS list_id FROM lists")
def ivf_assign(spark, sf_dir):
    return _index(spark, sf_dir)[0].lists.select("id", "list_id")


@query(f"WITH {_KM}, {_assign()} SELECT c.list_id::BIGINT AS list_id, count(l.id) AS n FROM cent c LEFT JOIN lists l USING (list_id) GROUP BY c.list_id")
def ivf_list_sizes(spark, sf_dir):
    return _index(spark, sf_dir)[0].list_sizes()


@query(f"WITH {_KM}, {_assign()} SELECT count(*) AS total_vectors, (SELECT count(*) FROM cent) AS nlist, count(DISTINCT list_id) AS filled_lists, (count(*) * ({DIMENSION} * 4 + 8))::BIGINT AS memory_bytes FROM lists")
def index_stats(spark, sf_dir):
    return _index(spark, sf_dir)[0].stats()


@query(f"WITH {_KM}, {_probes()} SELECT query_id, probe_rank, list_id::BIGINT AS list_id, round(d, 6) AS distance FROM probes WHERE probe_rank <= {NPROBE}")
def ivf_probe_lists(spark, sf_dir):
    index, rows = _index(spark, sf_dir)
    return _near(index.probe_lists(asked(rows), NPROBE))


def _ivf(spark, sf_dir, metric, nprobe=NPROBE):
    index, rows = _index(spark, sf_dir, metric)
    return _near(index.search(asked(rows), K, nprobe))


def _ivf_sql(metric, nprobe=NPROBE):
    return f"WITH {_KM}, {_assign(metric)}, {_probes(metric)} {_top(_ivf_pairs(metric, str(nprobe)))}"


@query(_ivf_sql("L2"))
def ivf_search_l2(spark, sf_dir):
    return _ivf(spark, sf_dir, "L2")


@query(_ivf_sql("InnerProduct"))
def ivf_search_ip(spark, sf_dir):
    return _ivf(spark, sf_dir, "InnerProduct")


@query(_ivf_sql("Cosine"))
def ivf_search_cosine(spark, sf_dir):
    return _ivf(spark, sf_dir, "Cosine")


@query(f"WITH {_V} {_top(_exact('L2'))}")
def ivf_full_probe(spark, sf_dir):
    return _ivf(spark, sf_dir, "L2", NLIST)


@query(f"WITH {_KM}, {_assign()}, {_probes()} SELECT query_id, list_id::BIGINT AS list_id, rank, id, distance FROM ({_top(f'SELECT q.query_id, l.list_id, l.id, {_L2.format("l.vector", "q.vector")} AS distance FROM q JOIN probes p ON p.query_id = q.query_id AND probe_rank <= {NPROBE} JOIN lists l ON l.list_id = p.list_id', by='query_id, list_id')})")
def ivf_list_topk(spark, sf_dir):
    index, rows = _index(spark, sf_dir)
    return _near(index.list_topk(asked(rows), K, NPROBE))


@query(f"WITH {_KM.replace('(SELECT 0 AS sub, id, vector FROM v)', '(SELECT 0 AS sub, id, vector FROM v WHERE label < 5)')}, {_assign()} SELECT list_id::BIGINT AS list_id, count(*) AS n, sum(id)::BIGINT AS id_sum FROM lists GROUP BY list_id")
def ivf_add_incremental(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    index = IVFIndex.build(rows.filter("label < 5"), NLIST).add(rows.filter("label >= 5"))
    return index.lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query(f"WITH {_KM}, {_assign()}, {_probes()} {_top(_ivf_pairs('L2', '(1 + q.query_id // 100 % 4)'), '(1 + query_id // 100 % 7)')}")
def search_batch_mixed_params(spark, sf_dir):
    index, rows = _index(spark, sf_dir)
    mixed = asked(rows).withColumns({"k": (1 + F.expr("query_id div 100") % 7).cast("int"), "nprobe": (1 + F.expr("query_id div 100") % 4).cast("int")})
    return _near(index.search_batch(mixed))


@query(f"WITH {_KM}, {_assign()}, {_probes()}, f AS ({_top(_ivf_pairs('L2'))}), e AS ({_top(_exact('L2'))}) SELECT e.query_id, count(f.id) / {K}.0::DOUBLE AS recall FROM e LEFT JOIN f ON f.query_id = e.query_id AND f.id = e.id GROUP BY e.query_id")
def recall_at_k(spark, sf_dir):
    index, rows = _index(spark, sf_dir)
    return knn.recall(index.search(asked(rows), K, NPROBE), knn.search_exact(rows, asked(rows), K), K)


@query(f"WITH {_KM}, {_probes()} SELECT list_id::BIGINT AS list_id, count(*) AS accesses, max(query_id) AS last_query FROM probes WHERE probe_rank <= {NPROBE} GROUP BY list_id")
def list_access_stats(spark, sf_dir):
    index, rows = _index(spark, sf_dir)
    return access.list_access(index.probe_lists(asked(rows), NPROBE))


@query(f"WITH {_KM}, {_probes()} SELECT list_id::BIGINT AS list_id, count(*) AS accesses, max(query_id) AS last_query FROM probes WHERE probe_rank <= {NPROBE} GROUP BY list_id ORDER BY accesses DESC, list_id LIMIT 3")
def hot_lists(spark, sf_dir):
    index, rows = _index(spark, sf_dir)
    return access.hot_lists(index.probe_lists(asked(rows), NPROBE), 3)


# ---- product quantisation ----------------------------------------------------------------------------


def _book(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return pq.Codebook.train(rows, M, NBITS), rows


@query(f"SELECT ((sub << 16) | code)::BIGINT AS id, sub::BIGINT AS sub, code::BIGINT AS code FROM (SELECT unnest(range({M})) AS sub) CROSS JOIN (SELECT unnest(range({2**NBITS})) AS code)")
def pq_codebook_ids(spark, sf_dir):
    return _book(spark, sf_dir)[0].rows(spark).select("id", "sub", "code")


@query(f"WITH {_PQ} SELECT sub::BIGINT AS sub, code::BIGINT AS code, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT sub, code, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS pos FROM book)")
def pq_train(spark, sf_dir):
    rows = _book(spark, sf_dir)[0].rows(spark).select("sub", "code", F.posexplode("centroid").alias("pos", "value"))
    return rows.select("sub", "code", F.col("pos").cast("long").alias("pos"), _six_places("value").alias("value"))


@query(f"WITH {_PQ}, {_CODES} SELECT id, sub::BIGINT AS sub, code::BIGINT AS code FROM codes")
def pq_encode(spark, sf_dir):
    book, rows = _book(spark, sf_dir)
    return pq.encode(rows, book).select("id", F.posexplode("codes").alias("sub", "code")).select("id", F.col("sub").cast("long").alias("sub"), F.col("code").cast("long").alias("code"))


@query(f"WITH {_PQ}, {_TABLE} SELECT query_id, sub::BIGINT AS sub, code::BIGINT AS code, round(d, 6) AS distance FROM tab")
def pq_distance_table(spark, sf_dir):
    book, rows = _book(spark, sf_dir)
    return _near(pq.distance_table(asked(rows), book))


@query(f"WITH {_PQ}, {_CODES}, {_TABLE} {_top(_ADC)}")
def pq_scan(spark, sf_dir):
    book, rows = _book(spark, sf_dir)
    return _near(pq.scan(pq.encode(rows, book), asked(rows), book, K))


@query(f"WITH {_PQ}, {_CODES}, {_TABLE}, f AS ({_top(_ADC, str(4 * K))}) {_top(f'SELECT q.query_id, v.id, {_L2.format("v.vector", "q.vector")} AS distance FROM f JOIN q ON f.query_id = q.query_id JOIN v ON v.id = f.id')}")
def pq_rerank(spark, sf_dir):
    book, rows = _book(spark, sf_dir)
    return _near(pq.rerank(pq.scan(pq.encode(rows, book), asked(rows), book, 4 * K), rows, asked(rows), K))


@query(f"WITH {_KM}, {_assign()}, {_probes()}, {_BOOK}, {_CODES}, {_TABLE} {_top(f'SELECT t.query_id, c.id, list_sum(list(t.d ORDER BY c.sub)) AS distance FROM codes c JOIN lists l ON l.id = c.id JOIN probes p ON p.list_id = l.list_id AND probe_rank <= {NPROBE} JOIN tab t ON t.query_id = p.query_id AND t.sub = c.sub AND t.code = c.code GROUP BY t.query_id, c.id')}")
def ivfpq_search(spark, sf_dir):
    book, rows = _book(spark, sf_dir)
    index = IVFIndex.build(rows, NLIST)
    return _near(pq.scan(pq.encode(index.lists, book), asked(rows), book, K, index, NPROBE))


# ---- service metrics ---------------------------------------------------------------------------------


def _pct(p):
    return f"list_extract(list(latency ORDER BY latency), floor({p} * (count(latency) - 1))::BIGINT + 1)"


@query(f"WITH {_R} SELECT index, {_pct(0.5)} AS p50, {_pct(0.95)} AS p95, {_pct(0.99)} AS p99, round(avg(latency), 6) AS mean FROM r GROUP BY index")
def latency_percentiles(spark, sf_dir):
    return metrics.latency_percentiles(requests(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_R}, u AS (SELECT 'all' AS index, count(*) AS n FROM r UNION ALL SELECT index, count(*) FROM r GROUP BY index), d AS (SELECT *, CASE WHEN n > 10000 THEN ((n - 10001) // 5000 + 1) * 5000 ELSE 0 END AS dropped FROM u) SELECT index, n, dropped::BIGINT AS dropped, (n - dropped)::BIGINT AS retained FROM d")
def latency_window(spark, sf_dir):
    rows = requests(spark, sf_dir)
    return metrics.latency_window(rows.select("index").unionByName(rows.select(F.lit("all").alias("index"))))


@query(f"WITH {_R} SELECT index, count(*) AS searches, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS qps FROM r GROUP BY index")
def search_counts(spark, sf_dir):
    return metrics.search_counts(requests(spark, sf_dir)).withColumn("qps", F.round("qps", 9))


@query(f"WITH {_R} SELECT user_id, count(*) AS requests, count(*) FILTER (failed) AS errors, round(count(*) FILTER (failed) / count(*), 9) AS error_rate FROM r GROUP BY user_id")
def error_rate(spark, sf_dir):
    return metrics.error_rate(requests(spark, sf_dir), "user_id").withColumn("error_rate", F.round("error_rate", 9))


@query(f"WITH {_R}, e AS (SELECT index, list_reduce(list_prepend(0::BIGINT, list(trunc(latency)::BIGINT ORDER BY ts, event_id)), lambda a, x: CASE WHEN a = 0 THEN x ELSE trunc(a * 0.9::DOUBLE + x * 0.1::DOUBLE)::BIGINT END) AS ema_ms FROM r WHERE NOT failed AND latency IS NOT NULL GROUP BY index) SELECT index, ema_ms, greatest(1000, least(30000, 3 * ema_ms))::BIGINT AS timeout_ms FROM e")
def latency_ema(spark, sf_dir):
    return metrics.latency_ema(requests(spark, sf_dir))


@query(f"WITH {_R} SELECT event_id, (CASE WHEN latency / 500 < 0.3 THEN 16 WHEN latency / 500 < 0.7 THEN 32 ELSE 64 END)::BIGINT AS batch_size FROM r")
def adaptive_batch_size(spark, sf_dir):
    return metrics.adaptive_batch_size(requests(spark, sf_dir).withColumn("load", F.col("latency") / 500)).select("event_id", "batch_size")


PER_SECOND, BURST, FAILING = 1, 5, 0.3


@query(f"""WITH RECURSIVE {_R}, e AS MATERIALIZED (SELECT index, event_id, epoch_us(ts) * 1000 AS ns, row_number() OVER (PARTITION BY index ORDER BY ts, event_id) AS n FROM r),
f AS (SELECT index, 0::BIGINT AS n, ns AS since, {BURST}::BIGINT AS tokens, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted FROM e WHERE n = 1
  UNION ALL SELECT index, n, CASE WHEN gone >= {10**9 // PER_SECOND} THEN ns ELSE since END, had - (had >= 1)::BIGINT, event_id, had >= 1
  FROM (SELECT *, CASE WHEN gone >= {10**9 // PER_SECOND} THEN least({BURST}, tokens + gone // {10**9 // PER_SECOND}) ELSE tokens END AS had
    FROM (SELECT e.index, e.n, e.event_id, e.ns, f.since, f.tokens, e.ns - f.since AS gone FROM f JOIN e ON e.index IS NOT DISTINCT FROM f.index AND e.n = f.n + 1)))
SELECT index, event_id, admitted FROM f WHERE n > 0""")
def rate_limit(spark, sf_dir):
    return metrics.rate_limit(requests(spark, sf_dir), PER_SECOND, BURST)


@query(f"""WITH RECURSIVE {_R}, e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) // 1000 AS now, failed AS bad_now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM r),
f AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS ok, 0::BIGINT AS bad, 0::BIGINT AS last, false AS open, now + {metrics.BREAKER_CHECK_MS} AS due, NULL::BIGINT AS event_id FROM e WHERE n = 1
  UNION ALL SELECT user_id,
    CASE WHEN checks THEN n ELSE n + 1 END,
    CASE WHEN anew THEN 1 WHEN checks THEN trunc(ok * {metrics.BREAKER_DECAY}::DOUBLE)::BIGINT ELSE ok2 END,
    CASE WHEN anew THEN 0 WHEN checks THEN trunc(bad * {metrics.BREAKER_DECAY}::DOUBLE)::BIGINT ELSE bad2 END,
    CASE WHEN NOT checks AND bad_now THEN now ELSE last END,
    CASE WHEN anew THEN false WHEN checks THEN open WHEN bad_now THEN (open AND now - last <= {metrics.BREAKER_TIMEOUT_MS}) OR bad2 / (ok2 + bad2) > {FAILING}::DOUBLE
         ELSE open AND now - last <= {metrics.BREAKER_TIMEOUT_MS} AND NOT bad2 / (ok2 + bad2) < {FAILING}::DOUBLE END,
    CASE WHEN checks AND ok = 0 AND bad = 0 AND NOT open THEN due + ((now - due) // {metrics.BREAKER_CHECK_MS} + 1) * {metrics.BREAKER_CHECK_MS} WHEN checks THEN due + {metrics.BREAKER_CHECK_MS} ELSE due END,
    CASE WHEN NOT checks THEN event_id END
  FROM (SELECT f.* EXCLUDE (event_id), e.event_id, e.now, e.bad_now, f.due <= e.now AS checks, f.due <= e.now AND f.open AND f.due - f.last > {2 * metrics.BREAKER_TIMEOUT_MS} AS anew,
      f.ok + (NOT e.bad_now)::BIGINT AS ok2, f.bad + e.bad_now::BIGINT AS bad2 FROM f JOIN e ON e.user_id IS NOT DISTINCT FROM f.user_id AND e.n = f.n + 1))
SELECT user_id::VARCHAR AS index, event_id, open FROM f WHERE event_id IS NOT NULL""")
def circuit_breaker(spark, sf_dir):
    rows = requests(spark, sf_dir).withColumn("index", F.col("user_id").cast("string"))
    return metrics.circuit_breaker(rows, FAILING)


@query(f"WITH {_R} SELECT event_id, (CASE index WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END)::BIGINT AS priority FROM r ORDER BY priority DESC, ts, event_id")
def priority_order(spark, sf_dir):
    rows = requests(spark, sf_dir).withColumn("priority", F.when(F.col("index") == "purchase", 3).when(F.col("index") == "signup", 2).when(F.col("index") == "click", 1).otherwise(0).cast("long"))
    return metrics.priority_order(rows).select("event_id", "priority")


@query(f"WITH {_R} SELECT index, count(*) AS requests FROM r WHERE index NOT IN ('view', 'click') GROUP BY index")
def batch_missing_index(spark, sf_dir):
    catalog = spark.range(1).select(F.explode(F.lit(["view", "click"])).alias("index"))
    return requests(spark, sf_dir).join(catalog, "index", "left_anti").groupBy("index").agg(F.count(F.lit(1)).alias("requests"))


# ---- access patterns ---------------------------------------------------------------------------------


@query(f'WITH {_A} SELECT * FROM (SELECT reader, seq, "offset", "offset" - lag("offset") OVER (PARTITION BY reader ORDER BY seq) AS stride FROM a) WHERE stride IS NOT NULL')
def access_strides(spark, sf_dir):
    return access.strides(accesses(spark, sf_dir)).filter("stride IS NOT NULL")


_PATTERN = f"""{_A}, g AS (SELECT reader, seq, size, "offset", "offset" - lag("offset") OVER (PARTITION BY reader ORDER BY seq) AS stride FROM (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY seq DESC) AS back FROM a) WHERE back <= 100),
t AS (SELECT reader, stride, count(*) AS times FROM g WHERE stride IS NOT NULL GROUP BY ALL),
m AS (SELECT reader, stride AS mode, times FROM (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY times DESC, stride) AS n FROM t) WHERE n = 1),
p AS (SELECT reader, count(*) FILTER (stride > 0) - (min(stride) > 0)::BIGINT AS positive, count(*) AS gaps FROM g WHERE stride IS NOT NULL GROUP BY reader),
b AS (SELECT reader, count(*) AS n, floor(avg(size))::BIGINT AS avg_size, arg_max("offset", seq) AS last_offset FROM g GROUP BY reader),
x AS (SELECT b.*, mode, coalesce(n >= 3 AND times > 1 AND times / gaps > 0.8 AND mode > 0, false) AS ok, positive / gaps AS share FROM b LEFT JOIN m USING (reader) LEFT JOIN p USING (reader)),
found AS (SELECT reader, n, CASE WHEN NOT ok THEN 'Random' WHEN share > 0.8 THEN 'Sequential' ELSE 'Strided' END AS pattern, (CASE WHEN ok THEN mode ELSE 0 END)::BIGINT AS stride, avg_size, last_offset FROM x)"""


@query(f"WITH {_PATTERN} SELECT * FROM found")
def access_pattern(spark, sf_dir):
    return access.patterns(accesses(spark, sf_dir))


@query(f'WITH {_PATTERN} SELECT reader, step::BIGINT AS step, (last_offset + step * stride)::BIGINT AS "offset", avg_size AS size FROM found CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS step) WHERE pattern <> \'Random\'')
def access_prediction(spark, sf_dir):
    return access.predictions(access.patterns(accesses(spark, sf_dir)))
