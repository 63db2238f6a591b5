"""Packing into sequences by lexical retrieval.

Each task reads documents into shards of bounded tokens and builds a BM25 inverted index of each shard over
its token ids.  The first unused document of the shard seeds a window; the index returns its unused
neighbours by their score for all terms of the seed, and they fill the window greedily: those that fit whole in the order of their scores,
then the best that did not fit is cut, and what is left of it stays for another window.  Documents of a
window or more give full windows first, and only their rest is packed.  So all sequences are full but the
last of a shard.  Documents are not shuffled; a shard never leaves its task.

Token ids are those of the given tokenizer file over the whole text, followed by ``end_id``.  Tokenizing a
text splits at white space before anything else, so each different word is encoded once and its ids are
looked up after that; letters outside Latin, and words with special tokens, go to the tokenizer unchanged.

Defined results: a null or blank text is the end id alone; a null doc_id stays null; repeated rows are packed
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import give_back

#: Words whose lower case and parts are the same in every library.
_PLAIN = re.compile("[\n\x21-\x7e\xa1-\xac\xae-įĲ-ſ]+")
#: White space to Python that is none to the tokenizer.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: The pattern whose parts ``_ascii_parts`` finds by the kinds of bytes.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Of each byte: 0 a line's end, 1 a letter, 2 a digit, 3 others.
_KIND = np.array([0 if b == 0x0A else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(128)], dtype=np.uint8)
K1, B = 1.2, 0.75


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by its rule."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Lists:
    """Growing lists of ids, one after the other in one array."""

    def __init__(self):
        self.pool, self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.used = self.n = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append lists of these sizes."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        if self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * (self.n + len(sizes))), np.resize(self.sizes, 2 * (self.n + len(sizes)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(ids), self.n + len(sizes)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of these lists, one after the other."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordTokenizer:
    """Ids of whole texts, encoding each different word once.

    It holds about ``most_words`` words and as many parts; beyond that it forgets all but those that the texts at
    hand and earlier ones share, which are the frequent ones.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.whole = Tokenizer.from_file(path)
        suffix = model["model"].get("end_of_word_suffix") or ""
        split = [p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.by_words = bool(suffix) and len(split) == 1
        if self.by_words:
            self.parts_of = regex.compile(rf"\n|{split[0]}").findall
            self.by_kind = split[0] == _SPLIT
            self.bare = Tokenizer.from_str(json.dumps(model | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.is_end = np.zeros(max(model["model"]["vocab"].values()) + 1, dtype=bool)
            for token, i in model["model"]["vocab"].items():
                self.is_end[i] = token.endswith(suffix)
            self.letters = {b: c for b, c in _byte_letters().items() if b != 0x20}
        self.most_words = most_words
        self.words, self.word_ids = {}, _Lists()
        self.parts, self.part_ids = {}, _Lists()
        #: Words and parts of the last texts, and those of them that were new: what is left is frequent.
        self.common = self.common_parts = ([], set())

    @staticmethod
    def _only(known: dict[str, int], lists: _Lists, met: Iterable[str], new: set[str]) -> tuple[dict[str, int], _Lists]:
        """The lists of the words met that are not new."""
        kept = [w for w in met if w not in new]
        at = np.fromiter(map(known.__getitem__, kept), dtype=np.int64, count=len(kept))
        out = _Lists()
        out.add(lists.gather(at), lists.sizes[at])
        return dict(zip(kept, range(len(kept)), strict=True)), out

    def rest(self) -> None:
        """Forget all but the frequent words until the next task."""
        self.words, self.word_ids = self._only(self.words, self.word_ids, *self.common)
        self.parts, self.part_ids = self._only(self.parts, self.part_ids, *self.common_parts)
        self.common = self.common_parts = ([], set())

    def _encode_parts(self, parts: list[str]) -> None:
        """Learn parts (runs that the tokenizer never merges across)."""
        for i in range(0, len(parts), 1 << 14):
            self._encode_some(parts[i : i + (1 << 14)])

    def _encode_some(self, parts: list[str]) -> None:
        step = 2000
        joined = [" ".join(parts[i : i + step]) for i in range(0, len(parts), step)]
        joined = [j if j.isascii() else j.encode().decode("latin-1").translate(self.letters) for j in joined]  # printable ASCII stands for itself
        ids = np.array([i for e in self.bare.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], dtype=np.int32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(parts):
            raise RuntimeError("the vocabulary does not mark ends of words")
        self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts)), strict=True))
        self.part_ids.add(ids, np.diff(ends, prepend=0))

    @staticmethod
    def _ascii_parts(words: list[str]):
        """(parts, first part of each word) of words of printable ASCII without apostrophes and special tokens."""
        import pyarrow as pa

        text = np.frombuffer("\n".join(words).lower().encode(), dtype=np.uint8)
        kind = _KIND[text]
        begins = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)]))
        kept = kind[begins] > 0
        offsets = np.concatenate([[0], np.cumsum(np.diff(begins, append=len(text))[kept])])
        begins = begins[kept]
        first = np.flatnonzero((begins == 0) | (text[begins - 1] == 0x0A))
        return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(text[kind > 0])), first

    def _learn(self, new: list[str]) -> None:
        import pyarrow as pa

        easy = [w for w in new if w.isascii() and w.isprintable() and "'" not in w and "<|" not in w] if self.by_kind else []
        if len(easy) < len(new):
            seen = set(easy)
            new = [w for w in new if w not in seen]
        else:
            new = []
        plain = [w for w in new if _PLAIN.fullmatch(w) and "<|" not in w]
        seen = set(plain)
        other = [w for w in new if w not in seen]
        of_word, found = [], []
        if easy:
            parts, first = self._ascii_parts(easy)
            of_word, found = [first], [parts]
        if plain:
            flat = self.parts_of("\n".join(plain).lower())
            breaks = np.array([i for i, p in enumerate(flat) if p == "\n"], dtype=np.int64)
            of_word.append(np.concatenate([[0], breaks - np.arange(len(breaks))]) + sum(map(len, found)))  # first part of each word
            found.append(pa.array([p for p in flat if p != "\n"], pa.large_string()))
        if found:
            coded = pa.concat_arrays(found).dictionary_encode()
            met = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            unknown = [p for p in met if p not in self.parts]
            self.common_parts = met, set(unknown)
            if len(self.parts) > self.most_words:
                self.parts, self.part_ids = self._only(self.parts, self.part_ids, *self.common_parts)
            if unknown:
                self._encode_parts(sorted(unknown, key=str.isascii))
            at = np.fromiter(map(self.parts.__getitem__, met), dtype=np.int64, count=len(met))[coded.indices.to_numpy()]
            sizes = np.add.reduceat(self.part_ids.sizes[at], np.concatenate(of_word))
            self.word_ids.add(self.part_ids.gather(at), sizes)
            self.words.update(zip(easy + plain, range(len(self.words), len(self.words) + len(sizes)), strict=True))
        if other:
            ids = [e.ids for e in self.whole.encode_batch_fast(other, add_special_tokens=False)]
            self.word_ids.add(np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64))
            self.words.update(zip(other, range(len(self.words), len(self.words) + len(other)), strict=True))

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text of a list or Arrow array; a null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = texts.fill_null("")
        if not self.by_words:
            return [np.array(e.ids, dtype=np.int32) for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        odd = pc.match_substring_regex(texts, f"[{_ODD_SPACE}]")
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        # words are told apart before they become Python strings
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        place = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(place < 0)
        unmet = [words[i] for i in missing.tolist()]
        new = [w for w in unmet if w]
        self.common = words, set(unmet)
        if len(self.words) > self.most_words:
            self.words, self.word_ids = self._only(self.words, self.word_ids, *self.common)
            place = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if "" in self.common[1]:  # before white space at the start, and after it at the end
            self.words[""] = len(self.words)
            self.word_ids.add(np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64))
        if new:
            self._learn(new)
        place[missing] = np.fromiter(map(self.words.__getitem__, unmet), dtype=np.int64, count=len(unmet))
        at = place[flat.indices.to_numpy()]
        ids, ends = self.word_ids.gather(at), np.cumsum(self.word_ids.sizes[at])
        offsets = lists.offsets.to_numpy()
        per_text = np.concatenate([[0], ends])[offsets - offsets[0]]
        out = [ids[a:b] for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.int32)
        return out


class Bm25:
    """Inverted index of a shard: for each term its documents and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], query_terms: int | None = None):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        term = np.concatenate(docs).astype(np.int64)
        width = int(term.max()) + 1
        key = term * n + np.repeat(np.arange(n), sizes)
        pairs, tf = np.unique(key.astype(np.int32) if width * n < 1 << 31 else key, return_counts=True)
        # the types that bincount works with, so that no search converts them
        self.term, self.doc = (x.astype(np.int64) for x in np.divmod(pairs, n))
        df = np.bincount(self.term, minlength=width)
        self.first = np.concatenate([[0], np.cumsum(df)])
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean()))
        self.weight = (self.idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32).astype(np.float64)
        # each document's terms, the heaviest first
        by_doc = np.lexsort((self.term, -self.weight, self.doc))
        self.terms = self.term[by_doc]
        self.of_doc = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])
        self.n, self.query_terms = n, query_terms
        # terms that many documents have: a row with the weight in every document, at most 16 MB of them
        most = np.argsort(-df, kind="stable")[: (4 << 20) // n]
        often = np.sort(most[df[most] * 6 > n])
        self.row_of = np.full(width, -1, dtype=np.int64)
        self.row_of[often] = np.arange(len(often))
        own = self.row_of[self.term]
        self.dense = np.zeros((len(often), n), dtype=np.float32)
        self.dense[own[own >= 0], self.doc[own >= 0]] = self.weight[own >= 0]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents with a score for the seed's terms (all, or the heaviest), best first, ties by order."""
        terms = np.sort(self.terms[self.of_doc[seed] : self.of_doc[seed + 1]][: self.query_terms])
        row = self.row_of[terms]
        spans = [slice(a, b) for a, b in zip(self.first[terms[row < 0]].tolist(), self.first[terms[row < 0] + 1].tolist(), strict=True)]
        score = self.dense[row[row >= 0]].sum(axis=0, dtype=np.float64)
        if spans:
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int, query_terms: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); all but the last are full."""
    out = []
    begin, left = np.zeros(len(docs), dtype=np.int64), np.array([len(d) for d in docs], dtype=np.int64)
    for i in np.flatnonzero(left >= window).tolist():
        full = left[i] // window
        out += [[(i, k * window, window)] for k in range(int(full))]
        begin[i], left[i] = full * window, left[i] - full * window
    index = Bm25(docs, query_terms)
    unused = left > 0
    next_seed = 0
    while True:
        while next_seed < len(docs) and not unused[next_seed]:
            next_seed += 1
        if next_seed == len(docs):
            return out
        seed, unused[next_seed] = next_seed, False
        pieces, room = [(seed, int(begin[seed]), int(left[seed]))], window - int(left[seed])
        ranked = index.neighbours(seed, unused)
        first_cut = None
        for candidates in (ranked, None):
            if not room:
                break
            if candidates is None:  # nothing alike is left: the next unused in order
                rest = np.flatnonzero(unused)
                candidates = rest[: window + 1]
            at, sizes = 0, left[candidates]
            while room and at < len(candidates):
                skip = int((sizes[at:] <= room).argmax())
                none_fits = sizes[at + skip] > room
                if first_cut is None and (skip or none_fits):
                    first_cut = int(candidates[at])
                if none_fits:
                    break
                i = int(candidates[at + skip])
                unused[i] = False
                pieces.append((i, int(begin[i]), int(left[i])))
                room, at = room - int(left[i]), at + skip + 1
            if room and first_cut is not None:
                pieces.append((first_cut, int(begin[first_cut]), room))
                begin[first_cut] += room
                left[first_cut] -= room
                room = 0
        out.append(pieces)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 1, shard_tokens: int = 3 << 19, query_terms: int | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    tokenizer: path of the vocabulary file (on every machine).  shard_tokens: of one index.  query_terms: of a
    seed, its heaviest by BM25, that ask for neighbours; None: all.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    path = tokenizer or default_tokenizer()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _worker_tokenizer(path)
        base = TaskContext.get().partitionId() << 32
        made = 0
        held: list[np.ndarray] = []
        names_held: list[int | None] = []
        size = 0

        def told() -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in names]
            for pieces in pack_shard(held, window, query_terms):
                offset = 0
                for i, start, length in pieces:
                    data = held[i][start : start + length].astype("<u4").tobytes()
                    for col, v in zip(cols, (names_held[i], start, length, zlib.crc32(data), len(held[i]), base + made, offset), strict=True):
                        col.append(v)
                    offset += length
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for b in batches:
            texts, doc_ids = b.column(1), b.column(0).to_pylist()
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
            at = 0
            while at < len(doc_ids):  # some MB of text at a time
                stop = min(len(doc_ids), 1 + int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (2 << 20))))
                part = texts.slice(at, stop - at)
                for doc_id, ids in zip(doc_ids[at:stop], ids_of.encode(part), strict=True):
                    held.append(np.append(ids, np.int32(end_id)))
                    names_held.append(doc_id)
                    size += len(ids) + 1
                    if size >= shard_tokens:
                        yield told()
                        held, names_held, size = [], [], 0
                at = stop
        if held:
            yield told()
        del held, names_held
        ids_of.rest()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _worker_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept between its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]
