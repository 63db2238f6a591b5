"""Benchmark decontamination by an FM-index per training shard.

Each task reads documents into shards of bounded size.  A shard's text is the sequence of all its words, as
numbers of the shard's own vocabulary, with a separator after each document.  Over that text the shard builds
a suffix array, its Burrows-Wheeler transform, a wavelet tree with rank counts and every eighth suffix
position.  All test phrases (10 consecutive words of an item, or a shorter item as a whole) are put into the
shard's numbers (a word that it lacks ends the phrase's search) and searched backward at once through wavelet
ranks; occurrences are located by walking to a sampled position, and their word ranges are merged into the
spans to remove.  A document longer than an index may be is indexed in slices that overlap by all but one
word of a phrase.

The documents are never shuffled.  The benchmark goes to all tasks, in blocks of ``block_bytes`` of text, as
arrays of some six bytes for each byte of text: one pass if it fits one block (the usual case), else one pass
per block over a staged copy, merged per document.

Defined results: a null text has no words; an item without words has no phrase; items with the same item_id
count once, a null item_id is the empty id; repeated documents are judged alike; an empty table gives no
rows and an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialize, text_bytes

WINDOW, SAMPLE = 10, 8
SHARD_BYTES = 4 << 20
#: A word is a run of bytes other than these; A-Z are lower-cased.
_OTHER = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if c in _OTHER and not 0x41 <= c <= 0x5A else c + 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))
_WORD = re.compile(b"[^ ]+")


def words_of(texts: list[bytes]):
    """(words, counts): the words of all texts, lower-cased, as one Arrow array, and how many each text has."""
    import pyarrow as pa

    data = np.frombuffer(b" ".join([*texts, b""]).translate(_TABLE), dtype=np.uint8)
    solid = data != 0x20
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[:1].any():
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]  # the last byte is a space
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    text_ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.diff(np.searchsorted(starts, text_ends))


class Phrases:
    """The test phrases of some benchmark items, as numbers of the items' own vocabulary."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        words, counts = words_of([(text or "").encode() for _, text in items])
        coded = words.dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy()
        self.names = sorted({item or "" for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        many = np.where(counts >= window, counts - window + 1, counts > 0)
        owner = np.repeat(np.arange(len(items)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start, length = (np.cumsum(counts) - counts)[owner] + nth, np.minimum(counts[owner], window)
        back = np.arange(window)
        at = np.maximum((start + length - 1)[:, None] - back, 0)
        #: Last word first, as backward search goes; -1 fills up.
        self.reversed, of = np.zeros((0, window), dtype=np.int32), np.zeros(0, dtype=np.int64)
        if len(owner):
            self.reversed, of = np.unique(np.where(back < length[:, None], ids[at], -1).astype(np.int32), axis=0, return_inverse=True)
        self.lengths = (self.reversed >= 0).sum(axis=1)
        # items of each phrase: item[first[p] : first[p + 1]]
        named = np.array([number[item or ""] for item, _ in items], dtype=np.int64)[owner] if len(owner) else of
        pairs = np.unique(of.reshape(-1) * max(1, len(self.names)) + named)
        self.first = np.searchsorted(pairs, np.arange(len(self.reversed) + 1) * max(1, len(self.names)))
        self.item = (pairs % max(1, len(self.names))).astype(np.int32)


class FMIndex:
    """FM-index of a sequence of numbers that ends with 0, which stands nowhere else in it."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        n = len(text)
        suffixes = suffix_array(text)
        bwt = text[suffixes - 1]
        self.n, self.bwt = n, bwt
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])  # rows of smaller symbols
        # wavelet tree in matrix form: per bit, the bits in words of 64 and how many ones before each word
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        level = bwt
        for shift in reversed(range(max(1, int(symbols).bit_length()))):
            bit = (level >> shift & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, dtype=np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            packed = packed.view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((shift, packed, ones, int(n - ones[-1])))
            level = np.concatenate([level[~bit], level[bit]])
        sampled = suffixes % sample == 0
        self.is_sampled = sampled
        self.sample_rank = np.cumsum(sampled, dtype=np.int32) - 1
        self.samples = suffixes[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        start, place = np.zeros_like(at), at
        for shift, packed, ones, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = (ones[p >> 6] + np.bitwise_count(packed[p >> 6] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))) for p in (start, place))
            start = np.where(one, zeros + a, start - a)
            place = np.where(one, zeros + b, place - b)
        return place - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the phrases, given last symbol first."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            on = np.flatnonzero((lengths > step) & (low < high))
            if not len(on):
                break
            c = phrases[on, step]
            low[on], high[on] = self.before[c] + self.rank(c, low[on]), self.before[c] + self.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix, counting the steps."""
        out = np.zeros(len(rows), dtype=np.int64)
        left, walked = np.arange(len(rows)), 0
        while len(left):
            done = self.is_sampled[rows]
            out[left[done]] = self.samples[self.sample_rank[rows[done]]] + walked
            left, rows = left[~done], rows[~done]
            c = self.bwt[rows]
            rows, walked = self.before[c] + self.rank(c, rows), walked + 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling: suffixes ordered by their first k symbols give the order by 2 k; ties alone are sorted again.

    The first order is by as many symbols as fit one number of 62 bits.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    k = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for j in range(k):
        key <<= bits
        key[: max(0, n - j)] |= text[j:]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, dtype=np.int64)
    first = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, dtype=bool)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~first | ~np.concatenate([first[1:], [True]])) if n else np.zeros(0, dtype=np.int64)
    while len(tied):
        some = order[tied]
        ahead = some + k
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + second
        by = np.argsort(key)
        order[tied] = some[by]
        key = key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[~first | ~np.concatenate([first[1:], [True]])]
        k *= 2
    return order


def search_shard(texts: list[bytes], phrases: Phrases, most_words: int = 1 << 20, block: int = 1 << 20):
    """(counts, spans, items) of a shard as Arrow arrays: words of each text, its merged spans, its item ids in order.

    most_words: under one index.  block: occurrences that are located at once.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    words, counts = words_of(texts)
    coded = words.dictionary_encode()
    own = coded.dictionary
    del words
    # numbers: 0 ends an index, 1 separates, words follow
    doc = np.repeat(np.arange(len(texts)), counts + 1)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts + 1) - counts - 1, counts + 1)
    separator = place == counts[doc]
    text = np.ones(len(doc), dtype=np.int32)
    text[~separator] = coded.indices.to_numpy() + 2
    del coded
    # the phrases in the shard's numbers; those with a word that the shard lacks cannot occur
    number = np.append(pc.fill_null(pc.index_in(phrases.words, value_set=own), -2).to_numpy() + 2, 0) if len(own) else np.zeros(len(phrases.words) + 1, dtype=np.int64)
    asked = number[phrases.reversed]
    known = np.flatnonzero(((asked > 0) | (phrases.reversed < 0)).all(axis=1))
    asked, lengths = asked[known].astype(np.int64), phrases.lengths[known]
    overlap = phrases.reversed.shape[1] - 1
    cover = np.zeros(len(text) + 1, dtype=np.int32)
    met = [np.zeros(0, dtype=np.int64)]  # doc * phrases + phrase
    step = max(1, most_words - overlap)
    for left in range(0, max(1, len(text) - overlap), step):
        index = FMIndex(np.append(text[left : left + step + overlap], np.int32(0)), len(own) + 1)
        low, high = index.search(asked, lengths)
        hits = np.flatnonzero(high > low)
        ends = np.cumsum(high[hits] - low[hits])
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, block):
            nth = np.arange(a, min(a + block, total))
            of = np.searchsorted(ends, nth, side="right")
            at, length = left + index.locate(high[hits[of]] - (ends[of] - nth)), lengths[hits[of]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            met.append(np.unique(doc[at] * len(phrases.lengths) + known[hits[of]]))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    each = np.arange(len(texts) + 1)
    pairs = pa.StructArray.from_arrays([pa.array(place[a], pa.int64()), pa.array(place[a] + b - a, pa.int64())], ["a", "b"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[a], each), pa.int32()), pairs)
    in_doc, phrase = np.divmod(np.unique(np.concatenate(met)), max(1, len(phrases.lengths)))
    many = phrases.first[phrase + 1] - phrases.first[phrase]
    which = np.repeat(phrases.first[phrase], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    found = np.unique(np.repeat(in_doc, many) * max(1, len(phrases.names)) + phrases.item[which])
    in_doc, name = np.divmod(found, max(1, len(phrases.names)))
    items = pa.ListArray.from_arrays(pa.array(np.searchsorted(in_doc, each), pa.int32()), pa.array(phrases.names, pa.string()).take(pa.array(name)))
    return pa.array(counts, pa.int64()), spans, items


_SCHEMA = "doc_id long, row_id long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"


def _pass(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int, shard_bytes: int, most_words: int) -> DataFrame:
    import pyarrow as pa

    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [[], []], [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ids), *search_shard(texts, phrases.value, most_words)], ["doc_id", "row_id", "n_words", "spans", "items"])

        for b in batches:
            for doc_id, row_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), strict=True):
                texts.append(text)
                ids[0].append(doc_id)
                ids[1].append(row_id)
                size += len(text) + 64
                if size >= shard_bytes:
                    yield told()
                    ids, texts, size = [[], []], [], 0
        if texts:
            yield told()

    return docs.select("doc_id", "row_id", F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 8 << 20, shard_bytes: int = SHARD_BYTES, most_words: int = 1 << 20) -> DataFrame:
    """doc_id, row_id, n_words, spans (of words, end exclusive), n_hit, items of every row of ``docs``.

    docs: doc_id, row_id, text (row_id is carried along).  block_bytes: of benchmark text sent to the tasks at
    once.  shard_bytes: of a shard's text (64 bytes more for each document).  most_words: under one index.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("row_id").cast("long").alias("row_id"), "text")
    items = _item_blocks(benchmark, block_bytes)
    first, second = next(items), next(items, None)
    if second is None:
        found = _pass(docs, first, window, shard_bytes, most_words)
        return found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]))
    staged = materialize(docs.withColumn("at", F.monotonically_increasing_id()), "decontaminate-staged")
    parts = [_pass(staged.select("doc_id", F.col("at").alias("row_id"), "text"), block, window, shard_bytes, most_words) for block in chain((first, second), items)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    met = every.groupBy(F.col("row_id").alias("at")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(done, F.array(s))),
    )
    whole = staged.select("at", "doc_id", "row_id").join(met, "at").select("doc_id", "row_id", "n_words", F.when(F.size("all") > 0, merged).otherwise(F.col("all")).alias("spans"), "items")
    return whole.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find(docs.select("doc_id", F.lit(0).alias("row_id"), "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data, out, at = text.encode(), [], 0
    places = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode()


def _clean(texts: list[bytes], phrases: Phrases) -> list[bool]:
    """Which texts of a shard have no hit."""
    import pyarrow.compute as pc

    return pc.equal(pc.list_value_length(search_shard(texts, phrases)[1]), 0).to_pylist()


def kept_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 8 << 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit, with all columns: a filter where they lie, one pass per benchmark block."""
    import pyarrow as pa

    text_at, schema = docs.columns.index("text"), docs.schema
    for items in _item_blocks(benchmark, block_bytes):
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            texts, size = [], 0
            for b in batches:
                clean: list[bool] = []
                for text in text_bytes(b.column(text_at)):
                    texts.append(text)
                    size += len(text) + 64
                    if size >= shard_bytes:
                        clean += _clean(texts, phrases.value)
                        texts, size = [], 0
                if texts:  # a batch ends a shard, so that it can go on
                    clean += _clean(texts, phrases.value)
                    texts, size = [], 0
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items in blocks of about ``block_bytes`` of text."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + 16)).head()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for i in range(blocks):
        yield [tuple(r) for r in (bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)).collect()]
