"""URL filter (5), quality classifier (7) and the pipeline against plain Python."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import exact_dedup, quality, queries, url_filter

from .conftest import ROWS, documents, plain
from .test_exact import slow_components, slow_fingerprint, slow_hits

SMALL = "/root/testdata/sf0.001"


# ---- 5 URL filter ------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.example.com/en/71", '<a href="/x">1</a><a href="http://good.test/">2</a>'),
    (2, "http://EXAMPLE.com/en/8?q=1", None),
    (3, "ftp://b.net/de/1#f", "<A HREF='//bad.test/p'>"),
    (4, "http://x.example.net/de/8", "<a href=http://linker.test/z>"),
    (5, "no scheme here", '<a href="/y">'),
    (6, None, None),
    (7, "http://linker.test/a", '<a class="c" href="HTTP://X.example.net/q">'),
    (8, "http://good.test", ""),
    (9, "://?x", None),
    (10, "http://com/en/", "x"),
    (10, "http://com/en/", "x"),
    (11, "http://wexample.com/en/7", "x"),
    (12, "http://a://b/c", None),
]


def test_rules_and_links(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "rule": F.lit(1), "verdict": F.lit("z")})
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, queries.URL_RULES).collect()}
    assert got[1] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[2] == ("example.com", "/en/8", "com/en/", "block")
    assert got[3] == ("b.net", "/de/1", "net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[10][2:] == ("com/en/", "block") and got[11][2:] == ("com/en/", "block") and got[12] == ("a:", "//b/c", None, "allow")
    # linker.test links to a blocked host, good.test is linked from an allowed one
    assert got[7] == ("linker.test", "/a", None, "block") and got[8] == ("good.test", "", None, "allow")
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0 and url_filter.judge(df, queries.URL_RULES).count() == len(PAGES)


def test_walks_against_plain_numbers(spark):
    edges = {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 2, ("c", "a"): 5, ("d", "d"): 1}
    seeds = {("trust", "a"): 1, ("trust", "d"): 3, ("distrust", "c"): 2}
    df = spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long")
    got = {(r.walk, r.host): r.score for r in url_filter.propagate(df, spark.createDataFrame([(*k, n) for k, n in seeds.items()], "walk string, host string, n long"), 5, 85).collect()}
    want = {}
    for walk in ("trust", "distrust"):
        links = [(a, b, n) if walk == "trust" else (b, a, n) for (a, b), n in edges.items()]
        out, total = defaultdict(int), sum(n for (w, _), n in seeds.items() if w == walk)
        for a, _, n in links:
            out[a] += n
        seed = {h: int(10**12 * (n / total)) for (w, h), n in seeds.items() if w == walk}
        score = dict(seed)
        for _ in range(5):
            new = defaultdict(int, {h: s * 15 // 100 for h, s in seed.items()})
            for a, b, n in links:
                new[b] += (score.get(a, 0) * int(10**6 * (n / out[a])) // 10**6) * 85 // 100
            score = new
        want |= {(walk, h): s for h, s in score.items()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_a_link_among_a_million_passes_score(spark):
    own = "<a href=/>" * 1_000_001
    rows = [(1, "http://x.com/en/1", own), (2, "http://linker.test/", "<a href=http://x.com/>"), (3, "http://other.test/", "<a href=/>")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES, steps=6).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_exact_walks_against_fractions(spark):
    from fractions import Fraction

    edges = {("a", "b"): 3 * 10**10, ("a", "c"): 1, ("b", "c"): 2, ("c", "a"): 5, ("c", "c"): 10**9, ("d", "d"): 1}
    seeds = {"a": 1, "d": 2 * 10**9}
    df = spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long")
    got = {r.host: r.score for r in url_filter.propagate(df, spark.createDataFrame([("trust", h, n) for h, n in seeds.items()], "walk string, host string, n long"), 5, 85, parts=None).collect()}
    start = {h: Fraction(n, sum(seeds.values())) for h, n in seeds.items()}
    score = dict(start)
    for _ in range(5):
        new = defaultdict(Fraction, {h: s * 15 / 100 for h, s in start.items()})
        for (a, b), n in edges.items():
            new[b] += score.get(a, 0) * n * 85 / sum(m for (x, _), m in edges.items() if x == a) / 100
        score = new
    assert set(got) == set(score) and all(abs(got[h] - s * url_filter.FINE_MASS) < 50 for h, s in score.items())


def test_judged_as_by_sql_over_links(spark):
    """A random graph and a chain of 30 hosts to a blocked one, which walks of six steps would not pass."""
    import duckdb
    import pandas as pd

    rng = np.random.default_rng(5)
    hosts = [f"h{i}.test" for i in range(40)] + ["a.example.com", "example.com", "x.net", "x.example.net", "y.org"]
    rows = [(i, f"http://{hosts[rng.integers(len(hosts))]}/{rng.choice(['en', 'de', 'es'])}/{rng.integers(10)}", " ".join(f"<a href=http://{hosts[j]}/>" for j in rng.integers(0, len(hosts), rng.integers(0, 6)))) for i in range(300)]
    rows += [(1000 + i, f"http://c{i}.chain/", f"<a href=//c{i + 1}.chain/>") for i in range(30)] + [(1030, "http://c30.chain/", "<a href=http://z.org/es/1>"), (1031, "http://z.org/es/1", None)]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841
    want = sorted(map(tuple, duckdb.sql(queries.ORACLE_SQL["op5_url_filter"]).df().astype(object).replace({np.nan: None})[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False)))
    got = sorted(tuple(r) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect())
    assert got == want
    verdicts = {r[0]: r[4] for r in got}
    assert all(verdicts[1000 + i] == "block" for i in range(31)) and len({v for i, v in verdicts.items() if i < 300}) == 2


# ---- 7 quality ---------------------------------------------------------------------------------------


def labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        good = bool(rng.integers(2))
        words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(int(rng.integers(20, 80)))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "en"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_no_leak(spark):
    rows, labels = labelled(600)
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]  # held-out labels play no part
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    got = plain(quality.scored(documents(spark, rows), frame(labels)), "doc_id", "held_out", "score", "predicted")
    assert got == plain(quality.scored(documents(spark, rows), frame(wrong)), "doc_id", "held_out", "score", "predicted")
    held = [(i, p) for i, h, _, p in got if h]
    assert {i for i, _ in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([p == labels[i][1] for i, p in held]) > 0.98


def test_scores_of_odd_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1), (7, 5, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = quality.scored(docs, some).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.scored(no_docs, labels).count() == 0 and quality.kept_documents(docs, labels).columns == docs.columns


def test_trees_walk_as_written():
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.fit(x, y, trees=40, depth=3)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert trees.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


# ---- pipeline ----------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    held = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        got = sorted(r.doc_id for r in docs.collect())
        if name == "quality":
            want = got
            assert 0.5 < len(got) / len(held) <= 1
        elif name == "exact_dedup":
            last = {}
            for i, t in held:
                last[t or ""] = max(i, last.get(t or "", i))
            want = sorted(last.values())
        elif name == "near_dedup":
            roots = slow_components([slow_fingerprint(t) for _, t in held])
            low = {}
            for (i, _), r in zip(held, roots, strict=True):
                low[r] = min(i, low.get(r, i))
            want = sorted(low.values())
        else:
            want = sorted(r[0] for r in slow_hits(held, bench) if not r[-1])
        assert got == want, name
        held = [(i, t) for i, t in held if i in set(got)]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(r.doc_id for r in pieces.select("doc_id").distinct().collect()) == sorted(i for i, _ in held)
    assert plain(corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n")), "doc_id", "n") == plain(pieces.groupBy("doc_id").agg(F.sum("length").alias("n")), "doc_id", "n")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    want = c.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    key = lambda f: sorted(map(repr, f[sorted(want.columns)].astype(object).where(f[sorted(want.columns)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_weak_digest_is_only_slower(spark):
    rows = [(i, f"t{i % 9}", "en") for i in range(60)]
    judged, _ = exact_dedup.deduplicate(documents(spark, rows), digest=lambda s: F.lit("same"))
    assert plain(judged.filter("kept"), "keep_id", "group_size") == sorted((max(i for i in range(60) if i % 9 == k), sum(1 for i in range(60) if i % 9 == k)) for k in range(9))
