"""Near-duplicates by SimHash with pigeonring filtering.

A fingerprint has 64 bits; two link if at most 3 differ.  Split into a ring of 8 segments of 8 bits, a linked
pair has a segment from which every chain of l segments differs in at most l * 3 / 8 bits (the pigeonring
principle): none in the first two, at most one in the first five.  Hence two of the segments three to five
are equal as well, and the pair shares one of 24 keys: a start of the chain, its first two segments, and two
of the next three (32 bits).  Distinct fingerprints are grouped by key; inside a group each candidate passes
the chain budgets of its start one by one before the full Hamming check.

A group returns a spanning forest of its links, never its pairs.  Groups of up to ``pairwise`` fingerprints
are searched breadth first, a fingerprint being compared with those not reached so far.  Larger ones look
up the neighbours of each fingerprint (all ways to flip up to 3 bits outside the key) instead, one flip at a
time over the whole group, so time and memory follow the group's size and not its square; only
fingerprints of one group, 8 bytes each, are in memory.  Copies were folded into one fingerprint before.
Components come from alternating large-star and small-star steps over the links, each step written to the
shared folder.

Defined results: a null or blank text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; a component without any doc_id has a null id; repeated rows are judged alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialize, release, text_bytes

BITS, DISTANCE, SEGMENT, RING, SHINGLE, SEED = 64, 3, 8, 8, 3, 42
#: For each start, the pairs of segments three to five that stay equal.
VARIANTS = ((2, 3), (2, 4), (3, 4))


def fingerprint(text: bytes) -> int:
    """The SimHash of one text given in UTF-8, as an unsigned number."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z alone are lower-cased; splits at \x20, \x09-\x0D alone
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        spans = [(0, len(joined))]
    else:
        starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
        spans = zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    return int(np.packbits(_ones(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, in blocks that bound memory for very long texts."""
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_id and fp (the fingerprint as a signed long) of every row; written once."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in text_bytes(b.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, row_id long, fp long"), "simhash-fps")


# ---- candidates -------------------------------------------------------------------------------------


def chain_mask(start: int, length: int) -> int:
    """The bits of ``length`` segments of the ring from ``start`` on."""
    mask = 0
    for i in range(length):
        mask |= ((1 << SEGMENT) - 1) << (SEGMENT * ((start + i) % RING))
    return mask


def key_mask(start: int, variant: int) -> int:
    """The bits that two fingerprints of one group share."""
    mask = chain_mask(start, 2)
    for i in VARIANTS[variant]:
        mask |= chain_mask((start + i) % RING, 1)
    return mask


def chains(start: int) -> list[tuple[int, int]]:
    """(mask, budget) of the chains from ``start`` whose budget says more than the one before."""
    return [(chain_mask(start, n), n * DISTANCE // RING) for n in (5, 7, 8)]


def near(fp: np.uint64, others: np.ndarray, budgets: list[tuple[int, int]]) -> np.ndarray:
    """Positions of those that pass each chain budget and at last the full Hamming check."""
    x = others ^ fp
    at = np.arange(len(others))
    for mask, most in budgets:
        ok = np.bitwise_count(x & np.uint64(mask)) <= most
        if not ok.all():
            at, x = at[ok], x[ok]
        if not len(at):
            break
    return at


def forest_pairwise(fps: np.ndarray, budgets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of a group's links, breadth first over the fingerprints not reached so far."""
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            a = queue.pop()
            hit = near(a, left, budgets)
            if len(hit):
                found = left[hit]
                out += [(int(a), int(b)) for b in found]
                queue += list(found)
                left = np.delete(left, hit)
    return out


def flips(free: int) -> Iterator[int]:
    """All ways to flip 1 to 3 of the free bits."""
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    for n in range(1, DISTANCE + 1):
        for some in combinations(bits, n):
            yield sum(some)


def forest_by_flips(fps: np.ndarray, free: int, budgets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same for a large group: for each flip, all its fingerprints look up their neighbour at once."""
    fps = np.sort(fps)
    root = np.arange(len(fps))
    out = []
    for flip in flips(free):
        if any((flip & mask).bit_count() > most for mask, most in budgets):
            continue
        other = fps ^ np.uint64(flip)
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        a = np.flatnonzero((fps[at] == other) & (fps < other))
        for one, two in zip(a.tolist(), at[a].tolist(), strict=True):
            i, j = one, two
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            while root[j] != j:
                root[j] = root[root[j]]
                j = root[j]
            if i != j:
                root[max(i, j)] = min(i, j)
                out.append((int(fps[one]), int(fps[two])))
    return out


def group_links(keys: np.ndarray, codes: np.ndarray, fps: np.ndarray, pairwise: int) -> list[tuple[int, int]]:
    """Links of rows sorted by (code, key): runs of equal (code, key) are the groups."""
    if len(fps) < 2:
        return []
    edge = np.flatnonzero((keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1])) + 1
    starts = np.concatenate([[0], edge])
    ends = np.concatenate([edge, [len(fps)]])
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(ends - starts > 1):
        a, b = starts[k], ends[k]
        start, variant = divmod(int(codes[a]), len(VARIANTS))
        group = fps[a:b].view(np.uint64)
        budgets = chains(start)
        out += forest_pairwise(group, budgets) if b - a <= pairwise else forest_by_flips(group, ((1 << BITS) - 1) & ~key_mask(start, variant), budgets)
    return out


def candidate_keys(distinct: DataFrame) -> DataFrame:
    """(code, key, fp): each fingerprint under its 24 keys."""
    rows = []
    for start in range(RING):
        for variant in range(len(VARIANTS)):
            mask = key_mask(start, variant)
            signed = mask - (1 << 64) if mask >> 63 else mask
            rows.append(F.struct(F.lit(start * len(VARIANTS) + variant).alias("code"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    return distinct.select("fp", F.explode(F.array(*rows)).alias("k")).select(F.col("k.code").alias("code"), F.col("k.key").alias("key"), "fp")


def links(distinct: DataFrame, pairwise: int = 1 << 15) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that are connected."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the group that may go on in the next batch

        def told(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            got = np.array(group_links(cols[1], cols[0], cols[2], pairwise), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
            goes_on = held and held[-1][0][-1] == cols[0][-1] and held[-1][1][-1] == cols[1][-1]
            if held and (cut or not goes_on):
                yield told([*held, [c[:cut] for c in cols]])
                held = []
            elif cut:
                yield told([[c[:cut] for c in cols]])
            held.append([c[cut:] for c in cols])
        if held:
            yield told(held)

    keyed = candidate_keys(distinct).repartition("code", "key").sortWithinPartitions("code", "key", "fp")
    return keyed.mapInArrow(run, "a long, b long").distinct()


# ---- components -------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node with an edge.

    Large-star and small-star steps until nothing changes, which takes some log^2 of the largest component.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            ways = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        met = ways.join(least, ways["a"] == least["n"]).select("a", "b", "m")
        if large:
            out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    said = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = said(now)
    while before[0]:
        after = materialize(star(star(now, True), False), "stars")
        release(now)
        now, told = after, said(after)
        if told == before:
            break
        before = told
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, pairwise: int = 1 << 15) -> DataFrame:
    """doc_id, row_id, fp of every row, and ``low``: the first (doc_id, row_id) of its component, null doc_ids last."""
    rows = fingerprints(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    distinct = materialize(rows.groupBy("fp").agg(first), "simhash-distinct")
    roots = components(materialize(links(distinct.select("fp"), pairwise), "simhash-links"))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").unionByName(distinct.join(roots.select(F.col("root").alias("fp")).distinct().withColumn("root", F.col("fp")), "fp"))
    lows = linked.groupBy("root").agg(F.min("first").alias("low"))
    of_linked = linked.join(lows, "root").select("fp", "low")
    table = materialize(distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("low", "first").alias("low")), "simhash-classes")
    return rows.join(table, "fp")


def near_duplicates(docs: DataFrame, pairwise: int = 1 << 15) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every document."""
    found = classes(docs.select("doc_id", "text", F.lit(0).alias("row_id")), pairwise)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low.doc_id").alias("component_id"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component exactly one row, that with the smallest doc_id."""
    staged = materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("doc")), "simhash-staged")
    stay = classes(staged.select("doc_id", "text", "row_id")).filter("row_id = low.row_id").select("row_id")
    return staged.join(stay, "row_id", "left_semi").select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
