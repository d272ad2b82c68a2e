"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level from gradient histograms over quantile bins and stored as heap
arrays (children of i: 2i+1 and 2i+2), so that a batch of documents walks all trees at once with
numpy indexing.  Rows to learn from are a bounded sample of the labelled ones.

Defined results: null and empty texts have zero statistics and are scored like any other row; no
labelled rows: every score is 0.5.  One row out per row in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, plain, table
from .docstats import doc_counts, labelled_sample, ratios

#: Bound on the labelled rows that trees are learned from.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS = 80, 4, 64
RATE, SHRINK, LEAST = 0.15, 1.0, 2.0
HELD_OUT = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Trees:
    """Flattened trees: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray  # (trees, 2**DEPTH - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**DEPTH)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        if not trees:
            return np.full(n, self.start)
        rows, each = np.arange(n)[:, None], np.arange(trees)[None, :]
        at = np.zeros((n, trees), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[each, at]] > self.threshold[each, at])
        return self.start + self.value[each, at - (2**DEPTH - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost log-loss; ``x`` (rows, features), ``y`` 0 or 1."""
    inner = 2**DEPTH - 1
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    slots = binned + np.arange(d) * BINS
    p = (y.sum() + 1) / (n + 2)
    start = float(np.log(p / (1 - p)))
    margin = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            wide, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (d * BINS) + slots).ravel()
            gs = np.bincount(key, np.repeat(g, d), wide * d * BINS).reshape(wide, d, BINS).cumsum(axis=2)
            hs = np.bincount(key, np.repeat(h, d), wide * d * BINS).reshape(wide, d, BINS).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + SHRINK) + (gt - gs) ** 2 / (ht - hs + SHRINK) - gt**2 / (ht + SHRINK)
            gain[(hs < LEAST) | (ht - hs < LEAST)] = -1
            for j in range(d):
                gain[:, j, len(edges[j]) :] = -1
            flat = gain.reshape(wide, -1)
            best = flat.argmax(axis=1)
            for k in range(wide):
                if flat[k, best[k]] > 1e-6:
                    j, b = divmod(int(best[k]), BINS)
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + SHRINK)
        margin = margin + value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Rows whose crc32 of the id leaves remainder 0 by HELD_OUT are never learned from.
    """
    scratch = Scratch(docs.sparkSession, "boosting")
    try:
        stats = scratch.save(doc_counts(docs, id_col, text_col), "counts")
        names = list(ratios())
        held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))
        full = stats.select("doc_id", held.alias("held_out"), *(c.alias(k) for k, c in ratios().items()))
        sample = labelled_sample(full.where("not held_out"), labels, label, MAX_LABELLED, names).toPandas()
        model = fit(sample[names].to_numpy(np.float64), sample["label"].to_numpy(np.float64))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000)):
                    x = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in names], axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

        scored = full.mapInArrow(score, "doc_id bigint, held_out boolean, score double")
        return scratch.keep(scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
    finally:
        scratch.close()


def op10_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    return classify(docs, plain(table(spark, sf_dir, "labels"), "doc_id", "quality"))
