"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver on a bounded sample of labelled rows (`sample_rows`) and flattened into arrays;
all documents are scored where they are read, by vectorised numpy traversal. The scoring job has no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, sampled, text_bytes, text_slices

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

#: Byte classes whose share of the text is a statistic each.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"*", b"$%", b"&#@", b"|", b"<>{}[]()", b"/\\_=+-~^", b"\"'`"]
_LUT = np.full(256, len(CLASSES), np.uint8)
for _i, _chars in enumerate(CLASSES):
    _LUT[list(_chars)] = _i
_LUT[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
N_FEATURES = N_CLASSES + 9


def statistics(column: pa.Array) -> np.ndarray:
    """A row of N_FEATURES document statistics for each whole text; null counts as empty, whose statistics are 0."""
    raw, offsets = text_bytes(column)
    n, lengths = len(column), np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n) * N_CLASSES, lengths) + _LUT[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_CLASSES] = counts / np.maximum(lengths, 1)[:, None]
    for i, text in enumerate(column.to_pylist()):
        if not text:
            continue
        words, lines = text.split(), text.split("\n")
        k = max(len(words), 1)
        distinct = set(words)
        out[i, N_CLASSES:] = (
            np.log1p(len(text)),
            len(text) / k,
            len(distinct) / k,
            sum(map(eq, words, words[1:])) / k,
            len(lines) / k,
            len(set(lines)) / len(lines),
            np.log1p(max(map(len, distinct), default=0)),
            sum(map(str.isupper, distinct)) / max(len(distinct), 1),
            sum(map(str.isalpha, distinct)) / max(len(distinct), 1),
        )
    return out


@dataclass
class Trees:
    """Complete binary trees of equal depth in level order: node i has children 2i + 1 and 2i + 2.

    feature and threshold: (trees, inner nodes); value: (trees, leaves). A row goes right where it exceeds threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.base)
        if len(self.feature):
            inner, tree = self.feature.shape[1], np.arange(len(self.feature))[None, :]
            at, rows = np.zeros((len(x), len(self.feature)), np.int64), np.arange(len(x))[:, None]
            while at.size and at[0, 0] < inner:
                at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
            total = total + self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 4, rate: float = 0.1, bins: int = 64, penalty: float = 2.0, least: int = 10) -> Trees:
    """Boost `rounds` trees on logistic loss with histograms of at most `bins` quantile bins a statistic.

    No rows score 0.5 for all; rows of one label only give that label's smoothed share.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    none = np.zeros((0, 2**depth - 1))
    if not len(y) or y.min() == y.max():
        return Trees(none.astype(np.int64), none, np.zeros((0, 2**depth)), base)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * bins
    out_f, out_t, out_v, margin = [], [], [], np.full(n, base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = ((at - first) * (width * bins))[:, None] + flat
            hist = [np.bincount(cell.ravel(), np.repeat(w, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for w in (g, h, np.ones(n))]
            (lg, lh, lc), (tg, th, tc) = hist, [s[:, :, -1:] for s in hist]
            gain = lg**2 / (lh + penalty) + (tg - lg) ** 2 / (th - lh + penalty) - tg**2 / (th + penalty)
            gain[(lc < least) | (tc - lc < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for node in range(nodes):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + node], threshold[first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        margin = margin + value[leaf]
        out_f.append(feature), out_t.append(threshold), out_v.append(value)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_v), base)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text: str = "text") -> Trees:
    """Fit on about `sample_rows` labelled, not held-out documents at most, chosen by a hash of their id.

    Ids labelled twice count by their mean label, rounded; null ids and labels are left out, repeated documents
    count once, by the least of their statistics. Without labels the trees score 0.5 everywhere. The sample is what is broadcast and gathered, so both are bounded by `sample_rows`.
    """
    known = labels.select(F.col(id_column).alias("__id"), F.col("quality").alias("__y")).where("__id is not null and __y is not null").where(~held_out(F.col("__id")))
    known = known.groupBy("__id").agg((F.avg("__y") >= 0.5).cast("double").alias("__y"))
    total = known.count()
    kept = known.where(sampled(sample_rows / max(total, 1), "__id"))
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(kept), "__id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            x = statistics(part.column("__text"))
            yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["__id", "__y", "x"])

    sample = mapped(rows.select(F.col("__id").cast("string"), "__y", "__text"), measure, "__id string, __y double, x array<double>")
    sample = sample.groupBy("__id").agg(F.min("__y").alias("__y"), F.min("x").alias("x")).orderBy("__id").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), N_FEATURES)
    return fit(x, sample["__y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' id and text with `score`, the probability of label 1, for every row; empty and null texts are scored too."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(trees.score(statistics(part.column(text))), pa.float64())], [id_column, "score"])

    return mapped(docs.select(id_column, text), run, f"`{id_column}` {kind}, score double")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, that score `threshold` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            yield part.filter(pa.array(trees.score(statistics(part.column(text))) >= threshold))

    return mapped(docs, run, docs.schema)
