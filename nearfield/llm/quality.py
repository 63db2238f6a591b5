"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are computed once, in Arrow batches.  The trees are fitted on the driver, on a
bounded sample of labelled rows (``max_rows``, drawn by a hash of doc_id), from histograms of binned
statistics.  They are complete binary trees flattened into three arrays, and a batch of documents walks all
of them with numpy, one level at a time.

Only the text's statistics are inputs: labels, lang, source and doc_id never are.  Rows with
crc32(doc_id as text) mod 5 = 0 are held out and never fitted.

Defined results: a null text is empty and scored like any other; a null doc_id counts as the empty id; labels
other than 0 and 1 are ignored; repeated labels of a document count once each; without labels of both kinds
the score is the share of label 1 among those there are, or 0.5; an empty table gives no rows; other columns
are carried or ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialize, text_bytes

FOLDS, HELD_OUT = 5, 0
STATISTICS = (
    "bytes", "words", "word_length", "word_length_spread", "longest_word", "upper", "digit", "space", "sentence_marks", "symbols", "non_ascii", "exclamations", "bars",
    "distinct_words", "commonest_word", "short_words", "marked_words", "upper_words", "repeated_pairs", "lines", "line_length", "repeated_lines", "marked_lines", "entropy", "digit_words",
)
_MARKS = frozenset(b"#$%&*!+=|<>~^@\\")


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    letters = int(count[65:91].sum() + count[97:123].sum()) or 1
    words = text.split()
    k = len(words) or 1
    sizes = np.array([len(w) for w in words] or [0])
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = count[count > 0] / n
    marked = sum(1 for w in words if w[-1] in _MARKS)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), count[65:91].sum() / letters, count[48:58].sum() / n,
        (count[9:14].sum() + count[32]) / n, (count[33] + count[46] + count[63]) / k, sum(int(count[c]) for c in _MARKS) / n, count[128:].sum() / n, count[33] / n, count[124] / n,
        len(seen) / k, max(seen.values(), default=0) / k, float((sizes <= 3).sum()) / k, marked / k, sum(1 for w in words if w.isupper() and len(w) > 1) / k, 1 - pairs / max(1, k - 1),
        float(np.log1p(len(lines))), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(1 for x in lines if x.lstrip()[:1] in (b"-", b"*", b"#", b"|", b">")) / max(1, len(lines)), float(-(share * np.log2(share)).sum()), sum(1 for w in words if w.isdigit()) / k,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc (the whole row as a struct), doc_id, row_id and stats of every row; written once."""
    @F.arrow_udf("array<float>")
    def stats(text: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in text_bytes(text)], pa.list_(pa.float32()))

    return materialize(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("doc_id").alias("doc_id"), stats(F.col("text").cast("string")).alias("stats")), "quality-stats")


@dataclass
class Trees:
    """Complete trees of one depth: split statistic and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.12, smooth: float = 1.0, least: float = 2.0) -> Trees:
    """Boost ``trees`` trees on the log loss, splitting at the edges of at most ``bins`` bins."""
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(y.mean()) if n else 0.5
    if n == 0 or mean in (0.0, 1.0):
        edge = min(max(mean, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(edge / (1 - edge))), np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    place = binned + np.arange(width) * bins
    out = Trees(float(np.log(mean / (1 - mean))), np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    total = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes = 2**level
            key = (place + (node * width * bins)[:, None]).ravel()
            hist = [np.bincount(key, weights=np.repeat(w, width), minlength=nodes * width * bins).reshape(nodes, width, bins) for w in (g, h)]
            left_g, left_h = (np.cumsum(a, axis=2) for a in hist)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + smooth) + (all_g - left_g) ** 2 / (all_h - left_h + smooth) - all_g**2 / (all_h + smooth)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            feature, cut = np.divmod(best, bins)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            first = nodes - 1
            for i in np.flatnonzero(good):
                out.feature[t, first + i] = feature[i]
                out.threshold[t, first + i] = edges[feature[i]][cut[i]]
            cut = np.where(good, cut, bins)
            node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
        sum_g, sum_h = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=h, minlength=leaves)
        out.value[t] = -rate * sum_g / (sum_h + smooth)
        total += out.value[t][node]
    return out


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def train(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fit on at most about ``max_rows`` labelled rows outside the held-out fold."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter((fold_of(F.col("doc_id")) != HELD_OUT) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    count = rows.count()
    parts = 1 << 20
    if count > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts)) < parts * max_rows // count)
    drawn = rows.join(stats.select("doc_id", "stats"), "doc_id").select("doc_id", "quality", "stats").collect()
    drawn.sort(key=lambda r: (r.doc_id, r.quality, r.stats))
    x = np.array([r.stats for r in drawn], dtype=np.float32).reshape(-1, len(STATISTICS)).astype(np.float64)
    return fit(x, np.array([r.quality for r in drawn], dtype=np.float64))


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """doc, doc_id, held_out, score, predicted of every row."""
    stats = with_statistics(docs)
    trees = train(stats, labels, max_rows)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64)
        return pa.array(trees.score(x), pa.float64())

    return stats.select("doc", "doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), score("stats").alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return scored(docs, labels).filter("predicted = 1").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
