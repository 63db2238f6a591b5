"""Removal of repeated substrings with suffix arrays built by two-stage sorting.

A byte is removed if a string of ``length`` bytes (50) that covers it also starts in a document with a smaller
doc_id.  The result is exact over all documents; matches never cross documents.

1. Documents are gathered into blocks of some MB, written once (compressed) to the shared folder.
   Documents whose whole text an earlier one has are folded by its digest: all of such a copy goes.
2. Each window of 50 bytes has a mark: the least hash of the 32 substrings of 19 bytes in it.  The mark depends
   on the window's bytes alone, so equal windows have equal marks, and neighbours mostly share theirs: a run of
   windows with one mark is one record.  Marks that two blocks or two documents share survive; all others are
   dropped here, some bytes each.
3. Equal runs are folded by digest (of 64 bits beside the mark's 40 or more): of each different run the smallest
   doc_id is found, and every other document that has the run loses all of it.  So a passage that a third of the
   documents share costs one small row per block.  What is left are the runs of first owners.
4. First owners' runs whose mark has other runs too go, as bytes and once each, to the task of the mark.  It builds
   a suffix array over them: it sorts only the suffixes that are smaller than their successors, induces all others
   by scans over the buckets of first bytes, computes the common prefix of neighbours, and so finds each group of
   equal windows and its smallest doc_id.  One bit per window goes back.  Where a mark has more than ``hot_runs``
   different runs (the ends of a passage in very many contexts), they are split into windows that are dealt by
   their own digest of 128 bits and folded like equal runs, so that no task grows with one passage.
5. Each block turns the answers into the removed spans of its documents.

Tasks talk in rows of a block and a cell (a range of hashes); a cell stands for 32 MB of text at any size, so its
rows stay bounded, and a key that all blocks have adds some bytes per block to its cell.

Defined results: a null text is empty; documents under 50 bytes lose nothing; rows with one doc_id never
remove from each other, as neither id is smaller; a null doc_id is larger than any other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import NO_ID, delete, give_back, materialize, release, text_bytes

LENGTH, GRAM = 50, 19
SPAN = LENGTH - GRAM + 1  # substrings of GRAM bytes in a window: 32
#: Marks with more different runs than this are split into windows.
HOT_RUNS = 1024
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# ---- suffix array by two-stage sorting ---------------------------------------------------------------


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers in byte order; ``text`` must be padded by 64 bytes."""
    n = len(text) - 8
    return np.lib.stride_tricks.as_strided(text.view(np.uint8), (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def sort_smaller(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by the ``depth`` bytes that start there; ties of one step alone are sorted in the next."""
    key = words[places]
    by = np.argsort(key, kind="stable")
    order, key = places[by], key[by]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    for at in range(8, depth, 8):
        tied = np.flatnonzero(~first | ~np.concatenate([first[1:], [True]]))
        if not len(tied):
            break
        some, key = order[tied], words[order[tied] + at]
        by = np.lexsort((key, group[tied]))
        order[tied], key = some[by], key[by]
        own = group[tied]
        differs = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        first[tied] = differs
        group[tied] = tied[np.maximum.accumulate(np.where(differs, np.arange(len(tied)), 0))]
    return order


def suffix_array(text: np.ndarray, words: np.ndarray, depth: int = 56) -> np.ndarray:
    """All suffixes of a text padded by 64 zero bytes, ordered by at least their first ``depth`` bytes.

    Suffixes smaller than their successors are sorted directly; a scan over the buckets of first bytes, from
    the smallest on, then puts each other suffix behind those already in its bucket, in the order in which its
    successor is met.
    """
    n = len(text) - 64
    step = np.zeros(n, dtype=np.int16)
    step[:-1] = text[1:n].astype(np.int16) - text[: n - 1]
    step[-1] = -1
    places = np.arange(n)
    decides = np.minimum.accumulate(np.where(step != 0, places, n)[::-1])[::-1]
    smaller = step[decides] > 0
    direct = sort_smaller(np.flatnonzero(smaller), words, depth) if smaller.any() else np.zeros(0, dtype=np.int64)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # the last suffix has no successor; it is the first of its bucket
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts = waiting[c]
        current = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        induced = [current]
        while len(current):  # successors in the same bucket
            current = current[current > 0] - 1
            current = current[text[current] == c]
            if len(current):
                induced.append(current)
        bucket = np.concatenate([*induced, direct[ends[c] : ends[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            waiting[text[part[0]]].append(part)
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before in order, up to ``most`` bytes; 0 for the first."""
    lcp = np.zeros(len(order), dtype=np.int64)
    same = np.arange(1, len(order))
    for at in range(0, most, 8):
        x = words[order[same] + at] ^ words[order[same - 1] + at]
        differ = x != 0
        zeros = np.zeros(int(differ.sum()), dtype=np.int64)
        for b in range(1, 8):
            zeros += x[differ] < np.uint64(1 << (64 - 8 * b))
        lcp[same[differ]] = at + zeros
        same = same[~differ]
    lcp[same] = most
    return np.minimum(lcp, most)


def smallest_owner(pieces: list[bytes], owners: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of each piece, one after the other: the smallest owner of an equal window anywhere."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    text = np.frombuffer(b"".join(pieces) + bytes(64), dtype=np.uint8)
    words = words_at(text)
    order = suffix_array(text, words)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(piece))
    order = order[left[order] >= length]  # suffixes that start a window
    group = np.cumsum(common_prefixes(order, words, length) < length) - 1
    if len(group):
        group -= group[0]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(owners[piece[order]], starts)
    out = np.zeros(len(piece), dtype=np.int64)
    out[order] = least[group]
    return out[left >= length]


# ---- blocks and marks --------------------------------------------------------------------------------


def marks(text: np.ndarray, slab: int = 1 << 20) -> np.ndarray:
    """The mark of the window at each place (0 to len - 50) of a text, hashed slab by slab."""
    n = len(text) - LENGTH + 1
    out = np.empty(max(0, n), dtype=np.uint64)
    for a in range(0, n, slab):
        b = min(n, a + slab)
        part = np.concatenate([text[a : b + LENGTH - 1], np.zeros(64, dtype=np.uint8)])
        words = words_at(part)
        m = b - a + SPAN - 1
        h = words[:m] * _MIX[0] + words[8 : m + 8] * _MIX[1] + words[GRAM - 8 : m + GRAM - 8] * _MIX[2]
        h ^= h >> np.uint64(29)
        h *= _MIX[3]
        h ^= h >> np.uint64(32)
        width = 1
        while width < SPAN:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        out[a:b] = h * _MIX[0]  # least hashes are small: spread them over all cells
    return out


def runs(text: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, mark, document) of each run of windows with one mark (its ``bits`` high bits) in one document."""
    none = np.zeros(0, dtype=np.int64)
    if len(text) < LENGTH:
        return none, none, np.zeros(0, dtype=np.uint64), none
    mark = marks(text)
    mark &= ~np.uint64((1 << (64 - bits)) - 1)
    ends = np.cumsum(sizes)
    crossing = np.zeros(len(text) + 1, dtype=np.int8)  # windows that would leave their document
    held = sizes > 0
    crossing[np.maximum(ends - sizes, ends - LENGTH + 1)[held]] += 1
    crossing[ends[held]] -= 1
    invalid = np.cumsum(crossing, dtype=np.int8)[: len(mark)] > 0
    new = np.ones(len(mark), dtype=bool)
    new[1:] = mark[1:] != mark[:-1]
    first = (ends - sizes)[held]
    new[first[first < len(mark)]] = True
    edge = np.flatnonzero(np.append(new | invalid, True))
    start, stop = edge[:-1], edge[1:]
    ok = ~invalid[start]
    start, stop = start[ok], stop[ok]
    return start, stop - start, mark[start], np.searchsorted(ends, start, side="right")


def _pack(a: np.ndarray, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(b), dtype=dtype)


def _pack_marks(sorted_marks: np.ndarray, bits: int) -> bytes:
    """Sorted marks by their differences."""
    gaps = np.diff(sorted_marks >> np.uint64(64 - bits), prepend=np.uint64(0))
    return _pack(gaps.view(np.uint8).reshape(-1, 8).T)  # byte by byte: the high ones are all alike


def _unpack_marks(b: bytes, bits: int) -> np.ndarray:
    gaps = np.ascontiguousarray(_unpack(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64) << np.uint64(64 - bits)


def _sub(keys: np.ndarray) -> np.ndarray:
    """One of 256 parts of a cell, from lower bits of the key."""
    return (keys >> np.uint64(24) & np.uint64(255)).astype(np.uint8)


def _cell(keys: np.ndarray, cells: int) -> np.ndarray:
    """The task of each key: its share of the range of 32 high bits."""
    return ((keys >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


#: All tables but the documents' blocks: rows of some kind for a block and a cell, with packed arrays.
_PARTS = "kind int, block long, cell long, parts array<binary>"
_PARTS_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("cell", pa.int64()), ("parts", pa.list_(pa.binary()))])
BODY, KEPT, ASKED, RULED, BITS = range(5)
#: What a block is told of each of its different runs.
ALONE, EARLIER, COMPARE, HOT = range(4)


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _PARTS_SCHEMA)


def _small(a: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte."""
    return _pack(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _large(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _flags(flag: np.ndarray) -> bytes:
    return len(flag).to_bytes(8, "little") + _pack(np.packbits(flag))


def _unflag(b: bytes) -> np.ndarray:
    return np.unpackbits(_unpack(b[8:], np.uint8))[: int.from_bytes(b[:8], "little")].astype(bool)


def _cuts(a: np.ndarray) -> list[np.ndarray]:
    """Places of each stretch of equal numbers."""
    return np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else []


def _wide(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of 16 bytes as two numbers each."""
    both = np.ascontiguousarray(raw).view("<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Block:
    """Documents in the order of their ids, with their texts one after the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, body: np.ndarray):
        self.ids, self.sizes, self.body = ids, sizes, body
        self.ends = np.cumsum(sizes)
        self.whole = body.tobytes()

    @classmethod
    def read(cls, parts: list[bytes]) -> Block:
        return cls(_unpack(parts[0], np.int64), _large(parts[1]), _unpack(parts[2], np.uint8))

    def parts(self) -> list[bytes]:
        return [_pack(self.ids), _small(self.sizes), _pack(self.body, 7)]

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, its number among the different digests, different digests) of texts that hold a window."""
        doc = np.flatnonzero(self.sizes >= LENGTH)
        starts = self.ends - self.sizes
        raw = np.frombuffer(b"".join(hashlib.sha256(self.whole[a:b]).digest()[:16] for a, b in zip(starts[doc].tolist(), self.ends[doc].tolist(), strict=True)), dtype="S16")
        own, of = np.unique(raw, return_inverse=True)
        # by the number that deals them to cells
        by = np.argsort(_wide(own)[0], kind="stable")
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        return doc, place[of], own[by]


def _first_owner(number: np.ndarray, doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The smallest doc_id of each number; documents are in the order of their ids."""
    least = np.full(n, len(ids), dtype=np.int64)
    np.minimum.at(least, number, doc)
    return ids[least] if n else np.zeros(0, dtype=np.int64)


def blocks(docs: DataFrame, cells: int, block_bytes: int, bits: int) -> DataFrame:
    """Rows of each block: its documents; its marks by cell; digests of its texts with their first owners, in the next ``cells`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            by = sorted(range(len(ids)), key=lambda i: (ids[i], len(texts[i])))
            own = Block(np.array([ids[i] for i in by], dtype=np.int64), np.array([len(texts[i]) for i in by], dtype=np.int64), np.frombuffer(b"".join(texts[i] for i in by), dtype=np.uint8))
            yield from _table([{"kind": BODY, "block": block, "cell": -1, "parts": own.parts()}]).to_batches()
            mark = np.unique(runs(own.body, own.sizes, bits)[2])
            cell = _cell(mark, cells)
            rows = [{"kind": ASKED, "block": block, "cell": int(cell[c[0]]), "parts": [_pack_marks(mark[c], bits)]} for c in _cuts(cell)]
            doc, number, digest = own.digests()
            if len(digest):
                owner, cell = _first_owner(number, doc, own.ids, len(digest)), cells + _cell(_wide(digest)[0], cells)
                rows += [{"kind": ASKED, "block": block, "cell": int(cell[c[0]]), "parts": [digest[c].tobytes(), _pack(owner[c])]} for c in _cuts(cell)]
            yield from _table(rows).to_batches(max_chunksize=4096)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text)
                held += len(text)
                if held >= block_bytes or len(ids) >= 1 << 16:
                    yield from told()
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield from told()
        del ids, texts
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PARTS)
    return materialize(rows, "substring-blocks", partition_by="kind")


def _kind(table: DataFrame, kind: int) -> DataFrame:
    """The rows of one kind of a table written by kinds, from their own files."""
    rows = table.sparkSession.read.schema(table.drop("kind").schema).parquet(f"{table._scratch_path}/kind={kind}")
    return rows.select(F.lit(kind).cast("int").alias("kind"), "block", "cell", "parts")


def _groups(table: DataFrame, one) -> DataFrame:
    """``one`` over the rows of each cell, in the order of blocks."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rows.sort(key=lambda r: r["block"])
        return _table(one(rows))

    return table.groupBy("cell").applyInArrow(run, _PARTS)


def _blockwise(bodies: DataFrame, told: DataFrame, one, schema: str) -> DataFrame:
    """``one`` over each block's body and what it has been told, by kind and in the order of cells."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        by_kind: dict[int, list[dict]] = {k: [] for k in (KEPT, ASKED, RULED, BITS)}
        for r in sorted(right.to_pylist(), key=lambda r: r["cell"]):
            by_kind[r["kind"]].append(r)
        return one(row["block"], Block.read(row["parts"]), by_kind)

    return bodies.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def _join(rows: list[dict], read, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=dtype), *map(read, rows)])


def _later(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a row with the same keys has a smaller owner."""
    by = np.lexsort((owner, *keys))
    first = np.append(True, np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)) if len(by) else np.zeros(0, dtype=bool)
    out = np.empty(len(by), dtype=bool)
    out[by] = owner[by] > owner[by][np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    return out


def shared_marks(table: DataFrame, cells: int, bits: int) -> DataFrame:
    """To each block: its marks that other blocks have too; which of its different texts have a smaller owner elsewhere."""

    def one(rows: list[dict]) -> list[dict]:
        cell, blocks_of = rows[0]["cell"], [r["block"] for r in rows]
        if cell >= cells:
            raw = [np.frombuffer(r["parts"][0], dtype="S16") for r in rows]
            owner = np.concatenate([_unpack(r["parts"][1], np.int64) for r in rows])
            later = _later(owner, *_wide(np.concatenate(raw)))
            return [{"kind": RULED, "block": b, "cell": cell, "parts": [_flags(x)]} for b, x in zip(blocks_of, np.split(later, np.cumsum([len(x) for x in raw])[:-1]), strict=True)]
        lists = [_unpack_marks(r["parts"][0], bits) for r in rows]
        mark = np.sort(np.concatenate(lists))
        twice = np.unique(mark[1:][mark[1:] == mark[:-1]])
        out = []
        for b, own in zip(blocks_of, lists, strict=True):
            both = own[np.isin(own, twice, assume_unique=True)]
            if len(both):
                out.append({"kind": ASKED, "block": b, "cell": cell, "parts": [_pack_marks(both, bits)]})
        return out

    return _groups(table, one)


class Kept:
    """The runs of a block that its copies do not settle and whose marks are shared, and the numbers of the different ones."""

    def __init__(self, own: Block, start, count, number, mark, is_copy):
        self.start, self.count, self.number, self.mark, self.is_copy = start, count, number, mark, is_copy
        self.doc = np.searchsorted(own.ends, start, side="right")
        self.owner = _first_owner(number, self.doc, own.ids, len(mark))
        first = np.full(len(mark), len(start), dtype=np.int64)
        np.minimum.at(first, number, np.arange(len(start)))
        self.at, self.windows = start[first], count[first]

    @classmethod
    def of(cls, own: Block, told: dict[int, list[dict]], cells: int, bits: int, most: int) -> tuple[Kept, np.ndarray]:
        """With the digests of the different runs."""
        import xxhash

        doc, number, digest = own.digests()
        later = _join(told[RULED], lambda r: _unflag(r["parts"][0]), bool)
        is_copy = np.zeros(len(own.ids), dtype=bool)
        if len(doc):
            is_copy[doc] = later[number] | (own.ids[doc] > _first_owner(number, doc, own.ids, len(digest))[number])
        start, count, mark, doc = runs(own.body, own.sizes, bits)
        keep = ~is_copy[doc]
        start, count, mark, doc = start[keep], count[keep], mark[keep], doc[keep]
        common = _join(told[ASKED], lambda r: _unpack_marks(r["parts"][0], bits), np.uint64)
        by = np.lexsort((doc, mark))
        twice = (mark[by][1:] == mark[by][:-1]) & (own.ids[doc[by]][1:] != own.ids[doc[by]][:-1])
        keep = np.isin(mark, np.append(common, mark[by][1:][twice]))
        start, count, mark = start[keep], count[keep], mark[keep]
        # long runs (of one repeated character, say) in parts, so that a piece is bounded
        times = -(-count // most)
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        start, count, mark = np.repeat(start, times) + nth * most, np.minimum(np.repeat(count, times) - nth * most, most), np.repeat(mark, times)
        whole, hashed = own.whole, xxhash.xxh3_64_intdigest
        digest = np.fromiter((hashed(whole[a:b]) for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)), dtype=np.uint64, count=len(start))
        by = np.lexsort((digest, mark))
        new = np.append(True, (mark[by][1:] != mark[by][:-1]) | (digest[by][1:] != digest[by][:-1])) if len(by) else np.zeros(0, dtype=bool)
        number = np.empty(len(by), dtype=np.int64)
        number[by] = np.cumsum(new) - 1
        return cls(own, start, count, number, mark[by][new], is_copy), digest[by][new]

    def parts(self, bits: int) -> list[bytes]:
        return [_small(np.diff(self.start, prepend=0)), _small(self.count), _small(self.number), _pack_marks(self.mark, bits), _flags(self.is_copy)]

    @classmethod
    def read(cls, own: Block, parts: list[bytes], bits: int) -> Kept:
        return cls(own, np.cumsum(_large(parts[0])), _large(parts[1]), _large(parts[2]), _unpack_marks(parts[3], bits), _unflag(parts[4]))

    def hot_windows(self, own: Block, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these runs, window by window: (number among the different digests, different digests in cell order, their first owners)."""
        import xxhash

        whole = own.whole
        raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[i : i + LENGTH]) for a, n in zip(self.at[hot].tolist(), self.windows[hot].tolist(), strict=True) for i in range(a, a + n)), dtype="S16")
        digest, of = np.unique(raw, return_inverse=True)
        by = np.argsort(_wide(digest)[0], kind="stable")
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        of = place[of]
        least = np.full(len(digest), NO_ID, dtype=np.int64)
        np.minimum.at(least, of, np.repeat(self.owner[hot], self.windows[hot]))
        return of, digest[by], least


def kept_runs(bodies: DataFrame, shared: DataFrame, cells: int, bits: int, most: int) -> DataFrame:
    """Of each block: its kept runs; by cell the marks, digests and first owners of the different ones."""

    def one(block: int, own: Block, told: dict[int, list[dict]]) -> pa.Table:
        kept, digest = Kept.of(own, told, cells, bits, most)
        cell = _cell(kept.mark, cells)
        rows = [{"kind": KEPT, "block": block, "cell": -1, "parts": kept.parts(bits)}]
        for c in _cuts(cell):
            ids, of = np.unique(kept.owner[c], return_inverse=True)
            rows.append({"kind": ASKED, "block": block, "cell": int(cell[c[0]]), "parts": [_pack_marks(kept.mark[c], bits), digest[c].tobytes(), _pack(ids), _small(of)]})
        return _table(rows)

    return materialize(_blockwise(bodies, shared, one, _PARTS), "substring-kept", partition_by="kind")


def ruled_runs(table: DataFrame, bits: int, hot_runs: int) -> DataFrame:
    """To each block, of its different runs: an earlier document has it; or it is the only one of its mark; or its windows need comparing."""

    def one(rows: list[dict]) -> list[dict]:
        lists = [_unpack_marks(r["parts"][0], bits) for r in rows]
        mark, digest = np.concatenate(lists), np.concatenate([np.frombuffer(r["parts"][1], dtype=np.uint64) for r in rows])
        owner = np.concatenate([_unpack(r["parts"][2], np.int64)[_large(r["parts"][3])] for r in rows])
        later = _later(owner, digest, mark)
        by = np.lexsort((digest, mark))
        new_mark = np.append(True, mark[by][1:] != mark[by][:-1])
        new = new_mark | np.append(True, digest[by][1:] != digest[by][:-1])
        group = np.cumsum(new_mark) - 1
        different = np.bincount(group[new])[group]
        code = np.empty(len(by), dtype=np.uint8)
        code[by] = np.where(different == 1, ALONE, np.where(different <= hot_runs, COMPARE, HOT))
        code[later] = EARLIER
        return [{"kind": RULED, "block": r["block"], "cell": r["cell"], "parts": [_pack(c)]} for r, c in zip(rows, np.split(code, np.cumsum([len(x) for x in lists])[:-1]), strict=True)]

    return _groups(table, one)


def _codes(told: dict[int, list[dict]]) -> np.ndarray:
    return _join(told[RULED], lambda r: _unpack(r["parts"][0], np.uint8), np.uint8)


def asked_windows(bodies: DataFrame, told: DataFrame, cells: int, bits: int) -> DataFrame:
    """By cell, the bytes of each block's runs that need comparing; in the next ``cells`` cells, digests of the windows of hot marks."""

    def one(block: int, own: Block, told: dict[int, list[dict]]) -> pa.Table:
        kept, code = Kept.read(own, told[KEPT][0]["parts"], bits), _codes(told)
        rows = []
        some = np.flatnonzero(code == COMPARE)
        cell, whole = _cell(kept.mark[some], cells), own.whole
        for c in _cuts(cell):
            ids, of = np.unique(kept.owner[some[c]], return_inverse=True)
            body = b"".join(whole[a : a + n + LENGTH - 1] for a, n in zip(kept.at[some[c]].tolist(), kept.windows[some[c]].tolist(), strict=True))
            rows.append({"kind": ASKED, "block": block, "cell": int(cell[c[0]]), "parts": [_pack(_sub(kept.mark[some[c]])), _pack(ids), _small(of), _small(kept.windows[some[c]]), _pack(np.frombuffer(body, dtype=np.uint8), 7)]})
        _, digest, least = kept.hot_windows(own, np.flatnonzero(code == HOT))
        cell = cells + _cell(_wide(digest)[0], cells)
        rows += [{"kind": ASKED, "block": block, "cell": int(cell[c[0]]), "parts": [digest[c].tobytes(), _pack(least[c])]} for c in _cuts(cell)]
        return _table(rows)

    return _blockwise(bodies, told, one, _PARTS)


def judged_windows(asked: DataFrame, cells: int, batch_bytes: int) -> DataFrame:
    """To each block, for each window that it sent: whether an equal one has a smaller owner."""

    def compared(rows: list[dict]) -> list[np.ndarray]:
        owners = [_unpack(r["parts"][1], np.int64)[_large(r["parts"][2])] for r in rows]
        seen: dict[bytes, int] = {}
        piece = []
        for r in rows:
            data, ends = _unpack(r["parts"][4], np.uint8).tobytes(), np.cumsum(_large(r["parts"][3]) + LENGTH - 1)
            piece += [seen.setdefault(data[a:b], len(seen)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        of, pieces = np.array(piece, dtype=np.int64), list(seen)
        least = np.full(len(pieces), NO_ID, dtype=np.int64)
        np.minimum.at(least, of, np.concatenate(owners))
        sub = np.zeros(len(pieces), dtype=np.uint8)
        sub[of] = np.concatenate([_unpack(r["parts"][0], np.uint8) for r in rows])
        # equal windows have one mark: batches of whole parts, of bounded bytes
        by = np.argsort(sub, kind="stable")
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)[by]
        total = np.append(0, np.cumsum(sizes))
        cut = [0]
        for part in _cuts(sub[by]):
            if total[part[-1] + 1] - total[cut[-1]] > batch_bytes and part[0] > cut[-1]:
                cut.append(int(part[0]))
        cut.append(len(by))
        found: list[np.ndarray | None] = [None] * len(pieces)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            some = by[a:b].tolist()
            smallest = smallest_owner([pieces[i] for i in some], least[by[a:b]])
            for i, x in zip(some, np.split(smallest, np.cumsum(sizes[a:b] - LENGTH + 1)[:-1]), strict=True):
                found[i] = x
        out, at = [], 0
        for o in owners:
            got = [found[i] for i in piece[at : at + len(o)]]
            out.append(np.concatenate(got) < np.repeat(o, [len(x) for x in got]))
            at += len(o)
        return out

    def looked_up(rows: list[dict]) -> list[np.ndarray]:
        raw = [np.frombuffer(r["parts"][0], dtype="S16") for r in rows]
        later = _later(np.concatenate([_unpack(r["parts"][1], np.int64) for r in rows]), *_wide(np.concatenate(raw)))
        return np.split(later, np.cumsum([len(x) for x in raw])[:-1])

    def one(rows: list[dict]) -> list[dict]:
        bits = (compared if rows[0]["cell"] < cells else looked_up)(rows)
        return [{"kind": BITS, "block": r["block"], "cell": r["cell"], "parts": [_flags(x)]} for r, x in zip(rows, bits, strict=True)]

    return _groups(asked, one)


def covered(own: Block, told: dict[int, list[dict]], cells: int, bits: int) -> np.ndarray:
    """Which bytes of a block go."""
    kept, code = Kept.read(own, told[KEPT][0]["parts"], bits), _codes(told)
    compared = _join([r for r in told[BITS] if r["cell"] < cells], lambda r: _unflag(r["parts"][0]), bool)
    looked_up = _join([r for r in told[BITS] if r["cell"] >= cells], lambda r: _unflag(r["parts"][0]), bool)
    n = len(own.body)
    cover = np.zeros(n + 1, dtype=np.int32)

    def goes(first: np.ndarray, stop: np.ndarray) -> None:
        cover[:] += (np.bincount(first, minlength=n + 1) - np.bincount(stop, minlength=n + 1)).astype(np.int32)

    whole = (code[kept.number] == EARLIER) | (own.ids[kept.doc] > kept.owner[kept.number])
    goes(kept.start[whole], (kept.start + kept.count + LENGTH - 1)[whole])
    goes((own.ends - own.sizes)[kept.is_copy], own.ends[kept.is_copy])
    # the first owners' runs, window by window
    hot = np.flatnonzero(code == HOT)
    of, _, least = kept.hot_windows(own, hot)
    looked_up = looked_up[of] | (np.repeat(kept.owner[hot], kept.windows[hot]) > least[of]) if len(hot) else looked_up
    for which, bit in ((np.flatnonzero(code == COMPARE), compared), (hot, looked_up)):
        first = np.full(len(code), -1, dtype=np.int64)
        first[which] = np.cumsum(kept.windows[which]) - kept.windows[which]
        own_runs = np.flatnonzero(~whole & (first[kept.number] >= 0))
        count = kept.count[own_runs]
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = (np.repeat(kept.start[own_runs], count) + nth)[bit[np.repeat(first[kept.number[own_runs]], count) + nth]]
        goes(at, at + LENGTH)
    return np.cumsum(cover)[:n] > 0


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"


def _spans(own: Block, gone: np.ndarray) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])
    whole, ends = own.whole, own.ends
    starts = ends - own.sizes
    bounds = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    edges_from, edges_to = bounds[::2], bounds[1::2]
    low, high = np.searchsorted(edges_to, starts, side="right"), np.searchsorted(edges_from, ends, side="left")
    out = []
    for i, (doc_id, a, b) in enumerate(zip(own.ids.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        spans = [(max(int(s), a) - a, min(int(e), b) - a) for s, e in zip(edges_from[low[i] : high[i]], edges_to[low[i] : high[i]], strict=True)] if b > a else []
        kept, at = hashlib.sha256(), a
        for s, e in spans:
            kept.update(whole[at : a + s])
            at = a + e
        kept.update(whole[at:b])
        out.append({"doc_id": None if doc_id == NO_ID else doc_id, "n_bytes": b - a, "n_removed": sum(e - s for s, e in spans), "n_spans": len(spans), "kept_sha256": kept.hexdigest(), "spans": [{"a": s, "b": e} for s, e in spans]})
    return pa.Table.from_pylist(out, schema)


def remove_repeats(docs: DataFrame, block_bytes: int = 4 << 20, batch_bytes: int = 1 << 20, hot_runs: int = HOT_RUNS, most_windows: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (of bytes, end exclusive) of every document.

    block_bytes: of text in a block.  batch_bytes: of text under one suffix array.  hot_runs: marks with more
    different runs go window by window.  most_windows: longer runs are cut.  None of them changes the result.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).head()[0] or 0
    if not total and docs.isEmpty():
        kinds = [c.split() for c in _RESULT.split(", ")]
        return docs.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.lit(None).cast(t).alias(n) for n, t in kinds[1:]])
    cells = max(48, -(-total // (32 << 20)))
    bits = min(64, max(40, (total // 16).bit_length() + 14))  # a mark meets another by chance in one of 2^14
    spark = docs.sparkSession
    table = blocks(docs, cells, block_bytes, bits)
    bodies = _kind(table, BODY)
    shared = materialize(shared_marks(_kind_or_none(table, ASKED), cells, bits), "substring-shared")
    delete(spark, f"{table._scratch_path}/kind={ASKED}")
    kept = kept_runs(bodies, shared, cells, bits, most_windows)
    release(shared)
    ruled = materialize(ruled_runs(_kind_or_none(kept, ASKED), bits, hot_runs), "substring-ruled")
    delete(spark, f"{kept._scratch_path}/kind={ASKED}")
    told = _kind(kept, KEPT).unionByName(ruled)
    bits_of = materialize(judged_windows(asked_windows(bodies, told, cells, bits), cells, batch_bytes), "substring-bits")
    return _blockwise(bodies, told.unionByName(bits_of), lambda _, own, said: _spans(own, covered(own, said, cells, bits)), _RESULT)


def _kind_or_none(table: DataFrame, kind: int) -> DataFrame:
    """The same for a kind that may have no rows, and so no files."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{table._scratch_path}/kind={kind}")
    if path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).exists(path):
        return _kind(table, kind)
    return table.limit(0).select(F.lit(kind).cast("int").alias("kind"), "block", "cell", "parts")
