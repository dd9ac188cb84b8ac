"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from a text alone, as numpy reductions over many texts at once. The trees are fitted on the driver, on
at most ``SAMPLE_ROWS`` labelled rows, chosen by the hash of their id: values are binned by quantiles, and every
level of a tree is split by one histogram of gradients. All trees have one depth and are flattened into arrays, so a
batch goes through a level of all trees at once, by indexing.

Defined cases: null and empty texts have all statistics 0 and get a score like others; labels without an id or a
quality aren't learned from; an id with several labels counts with each; without labels every score is 0.5,
and with labels of one kind the score is theirs; null doc_ids count as not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, chunks, shingle_hashes, word_bounds, word_hashes

FOLDS = 5
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 4, 0.15, 32, 20, 1.0

CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digits": range(48, 58),
    "spaces": (9, 10, 11, 12, 13, 32),
    "symbols": tuple(b"#*$%&<>^~_={}[]\\@"),
    "bars": tuple(b"|"),
    "calls": tuple(b"!?"),
    "stops": tuple(b".,;:"),
    "lines": (10,),
    "beyond": range(128, 256),
}
TABLES = np.zeros((len(CLASSES), 256), dtype=np.int32)
for _row, _members in enumerate(CLASSES.values()):
    TABLES[_row, list(_members)] = 1
STATISTICS = [*CLASSES, "size", "words", "word_length", "long_words", "distinct", "same_next", "common", "same_triples"]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's share of ``values``."""
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][offsets])


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for first, last, data, offsets in chunks(texts):
        size = np.diff(offsets)
        counts = [sums(table[data], offsets) for table in TABLES]
        _, starts, ends, firsts = word_bounds(data, offsets)
        hashes, _ = word_hashes(data, offsets)
        n = np.diff(firsts)
        lengths = ends - starts
        rows = out[first:last]
        for column, count in enumerate(counts):
            rows[:, column] = count / np.maximum(size, 1)
        base = len(counts)
        rows[:, base] = np.log1p(size)
        rows[:, base + 1] = np.log1p(n)
        rows[:, base + 2] = sums(lengths, firsts) / np.maximum(n, 1)
        rows[:, base + 3] = sums(lengths > 12, firsts) / np.maximum(n, 1)
        for i in range(last - first):
            words = hashes[firsts[i] : firsts[i + 1]]
            if len(words):
                _, seen = np.unique(words, return_counts=True)
                triples = shingle_hashes(words, 3)
                rows[i, base + 4] = len(seen) / len(words)
                rows[i, base + 5] = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0
                rows[i, base + 6] = seen.max() / len(words)
                rows[i, base + 7] = 1 - len(np.unique(triples)) / len(triples)
    return out


@dataclass
class Forest:
    """Flattened trees: for each, the inner nodes by level and then the leaves."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), dtype=np.int64)
        for _ in range(DEPTH if len(trees) else 0):
            beyond = np.take_along_axis(x, self.feature[trees, at], axis=1) > self.limit[trees, at]
            at = 2 * at + 1 + beyond
        return self.start + (self.leaf[trees, at - (2**DEPTH - 1)].sum(axis=1) if len(trees) else np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss."""
    inner, n_features = 2**DEPTH - 1, x.shape[1]
    none = (np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, 2**DEPTH)))
    if not len(y) or y.min() == y.max():
        return Forest(0.0 if not len(y) else (40.0 if y[0] else -40.0), *none)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), start)
    features, limits, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            wide, base = 2**depth, 2**depth - 1
            best, choice = np.full(wide, 1e-9), np.full((wide, 2), -1)
            for f in range(n_features):
                cell = (at - base) * BINS + binned[:, f]
                g, h, n = (np.cumsum(np.bincount(cell, w, wide * BINS).reshape(wide, BINS), axis=1) for w in (slope, bend, None))
                rest_g, rest_h, rest_n = g[:, -1:] - g, h[:, -1:] - h, n[:, -1:] - n
                gain = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain[(n < LEAST_ROWS) | (rest_n < LEAST_ROWS)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(wide), top] > best
                best[better] = gain[np.arange(wide), top][better]
                choice[better] = np.stack([np.full(wide, f), top], axis=1)[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                feature[base + k], limit[base + k] = choice[k, 0], edges[choice[k, 0]][choice[k, 1]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf_of = at - inner
        value = RATE * np.bincount(leaf_of, slope, 2**DEPTH) / (np.bincount(leaf_of, bend, 2**DEPTH) + RIDGE)
        raw = raw + value[leaf_of]
        features.append(feature)
        limits.append(limit)
        leaves.append(value)
    return Forest(start, np.array(features), np.array(limits), np.array(leaves))


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from at most ``rows`` labels outside fold 0. The chosen ids are few enough to be sent to every task."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(list(values), pa.list_(pa.float64()))], ["doc_id", "quality", "x"]
            )

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    measured = sample.mapInArrow(measure, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    found = measured.orderBy("doc_id", "quality", "x").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = np.asarray(found.column("x").combine_chunks().flatten()).reshape(found.num_rows, len(STATISTICS))
    return fit(x, (found.column("quality").to_numpy() > 0).astype(float))


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` rows (as a struct named row) with their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(forest.score(statistics(batch.column("text"))))], ["row", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: only the id goes along with the text."""
    forest = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(forest.score(statistics(batch.column("text"))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts to be good."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= THRESHOLD).select("row.*")
