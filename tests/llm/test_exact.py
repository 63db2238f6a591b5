"""Operators with exact contracts against plain Python on odd documents: 1, 2, 3, 4, 6, 8, 9, 10."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import chat, decontaminate, exact_dedup, packing, queries, secrets, sharding, simhash, substrings

from .conftest import ROWS, documents, plain

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- 1 sharding --------------------------------------------------------------------------------------


def check_shards(rows, got, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)


def test_shards_of_odd_documents(docs, no_docs):
    check_shards(ROWS, sharding.assign(docs, 4).collect(), 4)
    assert sharding.assign(no_docs).count() == 0


def test_shard_sizes_are_near_equal_and_groups_stay(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w" * int(rng.integers(1, 900)) + str(i % 700)) for i in range(4000)] + [(10_000 + i, "one group of copies " * 8) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.assign(df, 8, fine=32).collect()
    check_shards(rows, got, 8)
    size, where = defaultdict(int), defaultdict(set)
    text = dict(rows)
    for r in got:
        size[r.shard] += r.size
        where[text[r.doc_id]].add(r.shard)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean
    assert all(len(s) == 1 for s in where.values())


def test_a_third_of_all_rows_is_spread(spark):
    rows = [(i, "hot " * 50 if i % 3 else f"text {i} " * 20) for i in range(3000)] + [(i, None) for i in range(3000, 4500)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 6, fine=16).collect()
    check_shards(rows, got, 6)
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) < 1.1 * min(size.values())


# ---- 2 SimHash ---------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def slow_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_of_odd_documents(docs, no_docs):
    fps = [slow_fingerprint(t) for _, t, _ in ROWS]
    roots = slow_components(fps)
    low = {r: min((ROWS[i][0] for i in range(len(ROWS)) if roots[i] == r and ROWS[i][0] is not None), default=None) for r in roots}
    want = [(i, f"{f:016x}", low[r]) for (i, _, _), f, r in zip(ROWS, fps, roots, strict=True)]
    key = lambda r: tuple((v is None, v) for v in r)
    assert plain(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=key)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots)) and simhash.kept_documents(no_docs).count() == 0


def near_copies(n, seed=1, centres=6, spread=7):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, centres)]
    return sorted({base[int(rng.integers(centres))] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, spread)), replace=False)) for _ in range(n)})


@pytest.mark.parametrize("pairwise", [1 << 15, 2])
def test_links_connect_all_that_is_connected(spark, pairwise):
    fps = near_copies(250 if pairwise > 2 else 60)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3)
    found = simhash.links(df, pairwise)
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    roots = dict(zip(signed, slow_components(fps), strict=True))
    got = {r.node: r.root for r in simhash.components(found).collect()}
    groups = defaultdict(set)
    for s in signed:
        groups[roots[s]].add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(5)
    masks = [(s, v, simhash.key_mask(s, v)) for s in range(8) for v in range(3)]
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False))
        assert any(not diff & m and all((diff & c).bit_count() <= most for c, most in simhash.chains(s)) for s, v, m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1000), (5, 5)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got.get(i, i) == 0 for i in range(301)) and got[2000] == 1000
    assert simhash.components(edges.limit(0)).count() == 0


# ---- 3 secrets ---------------------------------------------------------------------------------------


def test_secrets_of_odd_documents(docs, no_docs):
    got = secrets.scan(docs)
    assert got.count() == len(ROWS) and got.filter("n_assign + n_access + n_hex > 0").count() == 0
    assert {r.base_sha256 for r in got.collect()} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan(no_docs).count() == 0


def test_base_patterns():
    text = "é token = \"abcdefghijkl\" PassWord:short Api_Key='0123456789abcdef' AKIAABCDEFGHIJKLMN AKIAABC ſecret=abcdefghijklmnop 0123456789abcdef"
    assert secrets.joined(secrets.base_spans(text)) == "assign:2:23,assign:40:65,hex:49:65,access:67:85,assign:95:96".replace(",assign:95:96", "") + ",hex:%d:%d" % (len(text) - 16, len(text))


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_structures_are_confirmed():
    import base64
    import json

    key = der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01")), der(0x04, bytes(range(200))))
    b64 = base64.b64encode(key).decode()
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln"
    ssh = base64.b64encode(b"\0\0\0\x07ssh-rsa\0\0\0\x03\x01\0\x01\0\0\0\x04abcd").decode()
    kinds = lambda t: [k for k, _, _ in secrets.confirmed_spans(t)]
    assert kinds(f"x {b64} y") == ["der"] and kinds(f"x {key.hex()} y") == ["der"]
    assert kinds(f"-----BEGIN\n{b64[:64]}\n{b64[64:128]}\n{b64[128:]}\n-----END") == ["der"]
    assert kinds(token) == ["jwt"] and kinds(ssh) == ["ssh"]
    broken = base64.b64encode(key[:-1] + b"\0\0").decode()
    assert kinds(broken) == [] and kinds(token.replace("eyJh", "eyJx")) == [] and kinds("A" * 5000) == []


def test_keys_inside_runs_and_in_texts():
    import base64
    import json

    key = der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"\x2a\x86\x48")), der(0x04, bytes(range(120))))
    b64 = base64.b64encode(key).decode()
    for before in ("path/", "a/M/MIIE/", "30/"):
        assert secrets.confirmed_spans(f"{before}{b64} end") == [("der", len(before), len(before + b64))]
    for before in ("ab", "3060", "30123", "f" * 33):
        assert secrets.confirmed_spans(f"{before}{key.hex()}ff end") == [("der", len(before), len(before + key.hex()))]
    part = lambda o: base64.urlsafe_b64encode(o.encode()).decode().rstrip("=")
    for head in ('{ "alg": "HS256"}', '{\n"alg":"none"}', ' {"alg":"a"}', '\n{"typ":"JWT","alg":"ES256"}'):
        token = f"{part(head)}.{part(json.dumps({'sub': 'é'}))}.c2ln"
        for before in ("", "x ", "www.example.", "tokenex"):
            assert secrets.confirmed_spans(before + token) == [("jwt", len(before), len(before + token))], (head, before)
    pem = f"-----BEGIN PRIVATE KEY-----\n{wrapped(key, 64)}\n-----END PRIVATE KEY-----\n".encode()
    for columns in (64, 76, 10**6):
        outer = wrapped(pem, columns)
        assert secrets.confirmed_spans(f"x {outer}\n.") == [("der", 2, 2 + len(outer))]
    assert secrets.confirmed_spans(wrapped(b"-----BEGIN NOTHING-----\n" + b"no key " * 9, 64)) == []
    assert secrets.confirmed_spans("e" + "w" * 200_000) == [] and secrets.confirmed_spans("30" * 100_000) == []


def test_op3_of_nulls_repeats_and_long_texts(spark):
    key = wrapped(der(0x30, der(0x02, b"\0"), der(0x04, bytes(range(120)))), 64)
    long = "lorem ipsum " * 50_000
    rows = [(1, None), (2, ""), (3, key), (3, key), (None, f"é {key}"), (4, long + "password = abcdefghijkl\n" + key)]
    got = {(r.doc_id, r.spans, r.n_confirmed, r.n_assign) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(long) + 24
    assert got == {(1, "", 0, 0), (2, "", 0, 0), (3, f"der:0:{len(key)}", 1, 0), (None, f"der:2:{2 + len(key)}", 1, 0), (4, f"assign:{len(long)}:{at - 1},der:{at}:{at + len(key)}", 1, 1)}


def wrapped(data, columns, brk="\n"):
    import base64

    b64 = base64.b64encode(data).decode()
    return brk.join(b64[i : i + columns] for i in range(0, len(b64), columns))


def ssh_private(size):
    field = lambda b: len(b).to_bytes(4, "big") + b
    return secrets.SSH_MAGIC + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"k" * size)


@pytest.mark.parametrize("columns", [64, 70, 76])
@pytest.mark.parametrize("brk", ["\n", "\r\n"])
def test_wrapped_keys_with_any_last_line(columns, brk):
    last = set()
    for size in range(300, 420):
        for kind, data in (("der", der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"\x2a\x86\x48")), der(0x04, bytes(i % 251 for i in range(size))))), ("ssh", ssh_private(size))):
            key = wrapped(data, columns, brk)
            last.add(len(key.rpartition("\n")[2].rstrip("=")))
            start = len("-----BEGIN-----" + brk)
            for after in ("-----END-----", "", "word", "word\nand another of more than twenty characters"):
                assert secrets.confirmed_spans(f"-----BEGIN-----{brk}{key}{brk}{after}") == [(kind, start, start + len(key))], (size, kind, after)
            # lines before a key, and a second key
            assert secrets.confirmed_spans(f"{'x' * 30}\nab\n{key}{brk}{key}") == [(kind, 34, 34 + len(key)), (kind, 34 + len(key + brk), 34 + len(key + brk + key))]
    assert last >= {n for n in range(1, columns + 1) if columns % 4 or n % 4 != 1}


def test_wrapped_keys_of_the_usual_sizes():
    for size in (241, 294, 634, 1190, 1216, 1217, 1218):
        rest = size - 4 - 3 - 4
        data = der(0x30, der(0x02, b"\0"), der(0x04, bytes(rest)))
        assert len(data) == size or size < 300
        key = wrapped(data, 64)
        assert secrets.confirmed_spans(f"{key}\n-----END") == [("der", 0, len(key))]
    cut = wrapped(ssh_private(400), 70)[:-100]
    assert secrets.confirmed_spans(cut) == [("ssh", 0, len(cut))]
    assert secrets.confirmed_spans(wrapped(der(0x30, der(0x02, b"\0"), der(0x04, bytes(300))), 64)[:-9]) == []


# ---- 4 repeated substrings ---------------------------------------------------------------------------


def slow_repeats(rows):
    ids = [2**63 if i is None else i for i, *_ in rows]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: ids[k]):
        t = (rows[k][1] or "").encode()
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], ids[k])
    out = []
    for k, (i, text, *_) in enumerate(rows):
        t = (text or "").encode()
        cover = np.zeros(len(t) + 1, dtype=int)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < ids[k]:
                cover[p] += 1
                cover[p + 50] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


FIELDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_of_odd_documents(docs, no_docs):
    want = slow_repeats(ROWS)
    assert plain(substrings.remove_repeats(docs), *FIELDS) == want
    assert plain(substrings.remove_repeats(docs, block_bytes=5000, batch_bytes=3000, hot_runs=1), *FIELDS) == want
    assert substrings.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("hot", [1, 32])
def test_a_passage_shared_by_many(spark, hot):
    rng = np.random.default_rng(2)
    passage = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 160))
    rows = [(i, "".join(chr(97 + int(c)) for c in rng.integers(0, 3, int(rng.integers(0, 200)))) + (passage if i % 3 else passage[20:90]) + "tail" * int(rng.integers(0, 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert plain(substrings.remove_repeats(df, block_bytes=1500, batch_bytes=2000, hot_runs=hot), *FIELDS) == slow_repeats(rows)


def test_a_text_and_a_passage_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    letters = lambda n, k=26: "".join(chr(97 + int(c)) for c in rng.integers(0, k, n))
    hot, passage = letters(300), letters(120)
    rows = [(i, hot if i % 3 == 0 else letters(int(rng.integers(1, 90)), 4) + passage + letters(int(rng.integers(1, 90)), 4) if i % 3 == 1 else letters(150)) for i in range(240)]
    rows += [(3, hot), (3, "a" * 5000), (900, "a" * 3000 + "b"), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = slow_repeats(rows)
    for hot_runs, most in ((2, 40), (1024, 1024)):
        assert plain(substrings.remove_repeats(df, block_bytes=3000, batch_bytes=4000, hot_runs=hot_runs, most_windows=most), *FIELDS) == want


def test_op4_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert plain(queries.op4_repeated_substrings(spark, "/root/testdata/sf0.001"), *FIELDS) == slow_repeats(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab\0", min_size=50, max_size=120), st.integers(0, 9)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
def test_suffix_array_finds_the_smallest_owner(pieces):
    texts = [t.encode() for t, _ in pieces]
    owners = {}
    for t, (_, o) in zip(texts, pieces, strict=True):
        for p in range(len(t) - 49):
            owners[t[p : p + 50]] = min(owners.get(t[p : p + 50], 9), o)
    got = substrings.smallest_owner(texts, np.array([o for _, o in pieces]))
    assert got.tolist() == [owners[t[p : p + 50]] for t in texts for p in range(len(t) - 49)]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(1 + c % 3 for c in b)))
def test_two_stage_order_is_that_of_suffixes(data):
    text = np.frombuffer(data + bytes(64), dtype=np.uint8)
    words = substrings.words_at(text)
    order = substrings.suffix_array(text, words, depth=320 if len(data) < 10 else 56)
    assert sorted(order.tolist()) == list(range(len(data)))
    cut = [data[i : i + 50] for i in order]
    assert cut == sorted(cut)
    lcp = substrings.common_prefixes(order, words)
    for k in range(1, len(cut)):
        a, b = (data[order[j] :] + bytes(60) for j in (k - 1, k))
        assert lcp[k] == min(50, next((i for i in range(60) if a[i : i + 1] != b[i : i + 1]), 60))


# ---- 6 decontamination -------------------------------------------------------------------------------


def slow_hits(rows, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UP))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if item is None else str(item))
    out = []
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    found |= got
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


ITEMS = [(1, "the QUICK brown, fox jumps over the lazy dog and runs far away"), (2, "déjà vu"), (3, None), (None, "ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (10, "déjà vu"), (4, "..."), (5, "never seen at all")]
REPORT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_hits_of_odd_documents(spark, docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = slow_hits(ROWS, ITEMS)
    assert plain(decontaminate.report(docs, bench), *REPORT) == want
    for shard_bytes, most_words in ((100, 20), (1 << 22, 37)):
        blocks = decontaminate.find(docs.withColumn("row_id", F.lit(0)), bench, block_bytes=60, shard_bytes=shard_bytes, most_words=most_words)
        told = blocks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
        assert plain(told, *REPORT) == want
    assert decontaminate.report(no_docs, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated OR n_items > 0").count() == 0
    kept = decontaminate.kept_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in want)
    assert decontaminate.kept_documents(docs, bench, block_bytes=60, shard_bytes=100).count() == kept.count()
    assert decontaminate.cut("Keep This, drop THAT word. end", [(2, 4)]) == "Keep This,  word. end"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.lists(st.integers(2, 4), min_size=1, max_size=4))
def test_fm_index_counts_and_locates(text, phrase):
    index = decontaminate.FMIndex(np.array([*text, 0]), 4)
    low, high = index.search(np.array([phrase[::-1] + [0] * (5 - len(phrase))]), np.array([len(phrase)]))
    want = [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


# ---- 8 exact deduplication ---------------------------------------------------------------------------


def slow_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("digest", [F.unhex, lambda s: s.substr(1, 1)], ids=["sha256", "weak"])
def test_groups_of_odd_documents(docs, digest):
    judged, _ = exact_dedup.deduplicate(docs, digest=digest)
    judged = judged.cache()
    assert plain(judged, "doc_id", "keep_id", "group_size", "text_sha256") == slow_groups(ROWS)
    kept = judged.filter("kept")
    assert kept.count() == len({t or "" for _, t, _ in ROWS}) and kept.filter("NOT (doc_id <=> keep_id)").count() == 0


def test_micro_batches_keep_state(spark):
    rows = [(i, f"text {i % 37}", "en") for i in range(400)]
    judged, staged = exact_dedup.deduplicate(documents(spark, rows).repartition(12), keep="min", bytes_per_batch=2000)
    assert plain(judged.filter("kept"), "doc_id") == [(i,) for i in range(37)]
    assert judged.count() == 400 and staged.count() == 400


@pytest.mark.parametrize("digest", [F.unhex, lambda s: s.substr(1, 1)], ids=["sha256", "weak"])
def test_state_outlives_a_call(spark, no_docs, tmp_path, digest):
    folder = str(tmp_path / "seen")
    more = [(20 + i, f"new text {i % 9}", "en") for i in range(30)] + [(90, ROWS[0][1], "en"), (0, "", "en"), (None, None, None)]
    seen = []
    for rows, df in ((ROWS[:7], documents(spark, ROWS[:7])), ([], no_docs), (ROWS[7:], documents(spark, ROWS[7:])), (more, documents(spark, more))):
        seen += rows
        judged, staged = exact_dedup.deduplicate(df, digest=digest, folder=folder)
        want = {(r[0], r[3]): r for r in slow_groups(seen)}
        assert plain(judged, "doc_id", "keep_id", "group_size", "text_sha256") == sorted((want[i, hashlib.sha256((t or "").encode()).hexdigest()] for i, t, *_ in rows), key=lambda r: tuple((v is None, v) for v in r))
        assert staged.count() == len(seen)


def test_kept_documents_and_empty(docs, no_docs):
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t, _ in ROWS})
    assert exact_dedup.deduplicate(no_docs)[0].count() == 0


# ---- 9 packing ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_packing_of_odd_documents(docs, no_docs, tokenizer):
    ids = defaultdict(list)
    for i, t, _ in ROWS:
        ids[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    got = packing.pack(docs, window=256).collect()
    seen, spans, places = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in got:
        fits = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32]
        assert fits and 0 < r.length <= 256
        seen[r.doc_id] += r.length
        spans[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert dict(seen) == {i: sum(map(len, x)) for i, x in ids.items()}
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(spans[6])[0][0] == 0 and packing.pack(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_give_the_ids_of_the_whole_text(text):
    from tokenizers import Tokenizer

    whole = test_words_give_the_ids_of_the_whole_text.__dict__.setdefault("t", Tokenizer.from_file(packing.default_tokenizer()))
    words = test_words_give_the_ids_of_the_whole_text.__dict__.setdefault("w", packing.WordTokenizer(packing.default_tokenizer(), 50))
    for t in (text, f"It's {text} <|endoftext|>{text}ÀB\x1c'll 12"):
        assert words.encode([t, ""])[0].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_neighbours_share_words_with_the_seed():
    docs = [np.array(x) for x in ([5, 6, 7, 1], [8, 9, 1], [5, 6, 1], [20, 21, 1])]
    index = packing.Bm25(docs, 24)
    assert index.neighbours(0, np.array([False, True, True, True]))[0] == 2
    seqs = packing.pack_shard(docs, 7, 24)
    assert [p[0] for p in seqs[0]] == [0, 2] and sum(n for s in seqs for _, _, n in s) == 13 and all(sum(n for _, _, n in s) == 7 for s in seqs[:-1])


def slow_bm25(docs, seed):
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    score = np.zeros(n)
    for t in set(docs[seed].tolist()):
        df = sum(t in d for d in docs)
        for i, d in enumerate(docs):
            tf = int((d == t).sum())
            score[i] += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return score


def test_all_terms_of_a_long_seed_score():
    rng = np.random.default_rng(3)
    docs = [rng.choice(400, size=int(k), p=1 / np.arange(1, 401) / (1 / np.arange(1, 401)).sum()).astype(np.int32) for k in rng.integers(80, 300, 60)]
    index = packing.Bm25(docs)
    for seed in range(0, 60, 7):
        unused = np.ones(60, dtype=bool)
        unused[seed] = False
        got, score = index.neighbours(seed, unused), slow_bm25(docs, seed)
        assert set(got.tolist()) == {i for i in range(60) if i != seed} and (np.diff(score[got]) < 1e-4).all()
    # documents that share only light terms of a seed of 40 terms
    docs = [np.arange(40, dtype=np.int32), np.array([99], dtype=np.int32), *[np.array([t, t + 100], dtype=np.int32) for t in range(30, 40)] * 3]
    assert packing.Bm25(docs).neighbours(0, np.arange(len(docs)) > 0).tolist() == list(range(2, len(docs)))
    seqs = packing.pack_shard(docs, 42)
    assert [i for i, _, _ in seqs[0]] == [0, 2]


def test_parts_by_kinds_of_bytes_are_those_of_the_pattern(tokenizer):
    words = packing.WordTokenizer(packing.default_tokenizer())
    assert words.by_kind
    rng = np.random.default_rng(5)
    letters = np.array([c for c in map(chr, range(0x21, 0x7F)) if c != "'"] + list("abcXYZ019") * 9)
    texts = ["".join(rng.choice(letters, n)).replace("<|", "<") for n in rng.integers(1, 30, 3000)]
    parts, first = words._ascii_parts(texts)
    found = parts.to_pylist()
    assert [found[a:b] for a, b in zip(first, [*first[1:], len(parts)], strict=True)] == [words.parts_of(t.lower()) for t in texts]
    odd = ["it's a 'test' we'll", "d\x7fel \x01 \x1b[0m", "x<|endoftext|>y <| z", "Ärger's Œuvre 日本 \U0001f600 naïve'", "A1b22,;c", ""]
    for text in [*odd, " ".join(texts), " ".join(odd + texts[:50])]:
        assert words.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# ---- 10 chat -----------------------------------------------------------------------------------------


def test_conversations(spark):
    rows = [(1, 1, "assistant", "[\\INST] then [INST] and </s>"), (1, 0, "user", "hi [/INST]"), (2, 0, None, None), (2, 1, "tool [TEXT]", "x"), (None, None, "user", " spaced "), (3, 0, "system", ""), (3, 0, "system", ""), (4, 0, "assistant", "<s>" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "source": F.lit(2), "formatted": F.lit("x")})
    made = chat.format_conversations(df).cache()
    assert made.filter("NOT identical").count() == 0 and made.count() == 5
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.collect()}
    assert got[1] == [("user", "hi [/INST]"), ("assistant", "[\\INST] then [INST] and </s>")] and got[2] == [("", ""), ("tool [TEXT]", "x")] and got[3] == [("system", "")] * 2
    told = {r.conv_id: r for r in chat.digest(made).collect()}
    assert told[1].loss_sha256 == hashlib.sha256(rows[0][3].encode()).hexdigest() and told[4].loss_chars == 150_000 and told[None].n_turns == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_any_turns_come_back(spark):
    rng = np.random.default_rng(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[TURN]", "[TEXT]", "\\", "[", "<", " ", "a", "]", "/"]
    rows = [(c, t, ["user", "assistant", "system", "tool", "["][int(rng.integers(5))], "".join(parts[int(i)] for i in rng.integers(0, len(parts), int(rng.integers(0, 9))))) for c in range(300) for t in range(3)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert made.filter("NOT identical").count() == 0
