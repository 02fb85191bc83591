"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics of every text are computed in one pass over the corpus. The trees are fitted on a bounded sample of labelled rows
(``TRAIN_ROWS``, chosen by a hash of the id): features become at most 64 bins, each level of a tree takes the best splits from
per-node histograms of gradients. All trees are flattened into arrays (feature, bin, leaf value) of perfect binary trees,
and a batch of rows walks down all of them at once in numpy.

Null and empty texts have zero statistics and a score like any other row. Repeated rows and null doc_ids keep their own rows. Repeated labels
count as bad if any is. Without labels of both kinds every score is the share of good ones (1 without any). Empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textstats import COUNTS, MORE, text_statistics

TRAIN_ROWS = 20_000
BINS, DEPTH, TREES, RATE, L2, MIN_ROWS = 64, 4, 80, 0.15, 1.0, 10
THRESHOLD = 0.3
STATISTICS = COUNTS + MORE


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios and sizes from the raw counts (columns as in STATISTICS)."""
    c = {k: stats[:, i].astype(float) for i, k in enumerate(STATISTICS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, words / lines, c["n_upper"] / chars, c["n_digits"] / chars,
            c["n_punct"] / words, c["n_unique"] / words, c["n_marked"] / words, c["n_piped"] / words, c["max_word"], c["n_ended"] / words, c["n_short"] / words, (c["n_chars"] - c["word_chars"]) / words,
        ]
    )


@dataclass
class Forest:
    """Trees of one depth side by side; node i has children 2i+1 and 2i+2."""

    edges: list[np.ndarray]  # of each feature's bins
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): rows of a higher bin go right
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.leaf) and len(x):
            b, trees = self.bins(x), np.arange(len(self.leaf))
            node, rows = np.zeros((len(x), len(trees)), np.int64), np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, self.feature[trees, node]] > self.cut[trees, node])
            total += self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 0.5) if len(y) else 1 - 1e-6
    share = float(np.clip(share, 1e-6, 1 - 1e-6))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    forest = Forest([np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) if len(c) else np.zeros(0) for c in x.T], *(np.zeros((0, n), d) for n, d in ((inner, int), (inner, int), (leaves, float))), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return forest
    b, (n, k) = forest.bins(x), x.shape
    flat = b + np.arange(k) * BINS
    raw, out = np.full(n, forest.base), ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node, feature, cut = np.zeros(n, np.int64), np.zeros(inner, int), np.full(inner, BINS)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * BINS) + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, k), wide * k * BINS).reshape(wide, k, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(nl < MIN_ROWS) | (na - nl < MIN_ROWS)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            use = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
            feature[first : first + wide] = np.where(use, best // BINS, 0)
            cut[first : first + wide] = np.where(use, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = -RATE * np.bincount(node - inner, g, leaves) / (np.bincount(node - inner, h, leaves) + L2)
        raw += leaf[node - inner]
        for to, v in zip(out, (feature, cut, leaf), strict=True):
            to.append(v)
    forest.feature, forest.cut, forest.leaf = map(np.array, out)
    return forest


def held_out(doc_id: Column) -> Column:
    """Rows kept from fitting: crc32 of the id as text leaves 0 modulo 5; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest:
    """Fit on the rows of at most ``train_rows`` labelled documents that aren't held out: those whose hash falls into the sample's share of all.

    Repeated rows of a document all count, up to twice ``train_rows`` rows."""
    truth = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    truth = truth.where(~held_out(F.col("doc_id")))
    if (n := truth.count()) > train_rows:  # 0.95: the sample's size varies by chance, and the limit then cuts nothing
        truth = truth.where(F.pmod(F.xxhash64("doc_id"), F.lit(n).cast("long")) < int(0.95 * train_rows))
    rows = stats.join(materialise(truth, "gbt-labels"), "doc_id").select("doc_id", *STATISTICS, "quality").limit(2 * train_rows)
    got = np.array(sorted(tuple(r)[1:] for r in rows.collect()), np.int64).reshape(-1, len(STATISTICS) + 1)
    return fit(features(got[:, :-1]), (got[:, -1] == 1).astype(float))


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = materialise(text_statistics(docs), "gbt-stats")
    forest = train(stats, labels, train_rows)

    def run(batches):
        for batch in batches:
            table = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            for at in range(0, len(table), 4096):
                values = forest.score(features(table[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 4096), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    found = stats.select("doc_id", *STATISTICS).mapInArrow(run, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
