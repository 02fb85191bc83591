"""Hard negatives by product quantisation with stored residual norms, exact.

Vectors become whole numbers. Codebooks, one for each pair of components, are fitted on a bounded sample; every row is encoded, and keeps the norm of what its
code leaves out. An anchor's lookup tables (its inner products with every codeword) give a score for each row; the true score lies within the
anchor's norm times the row's residual norm of it (Cauchy-Schwarz). First a few rows of the best table scores are scored exactly. Rows that can't
reach the last of those by this bound are dropped, and the rest get their exact score. So no row is lost, and codebooks of any quality give the same result.

Anchors are met with all rows in blocks: rows and anchors are dealt by hash into groups of about ``ROWS`` and ``ANCHORS``, and each pair of groups is
one cogroup. It gives out its best few for each anchor or window; Spark ranks those. No group depends on labels, so a label that holds any share of the rows is no
larger than others.

Rows with a null label, a null vector or any null, NaN or infinite component take no part. Vectors of different lengths are compared as if shorter ones ended in zeros.
Rows are told apart by their place: repeated rows are rows of their own, and null vec_ids are never anchors and come last among equals. An empty table, or one without anchors, gives an
empty result. Other columns are ignored. A scaled component beyond ``lloyd.largest`` of the longest vector's length stops the job with a message.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, batch_of, map_rows, materialise
from .lloyd import finite, floors, largest

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Rows the codebooks are fitted on, at most: those with the least hash of their vec_id.
SAMPLE_ROWS = 4096
#: Components of a codebook, its codewords, and the rounds of its fit.
WIDTH, WORDS, FIT_ROUNDS = 2, 256, 6
#: Rows and anchors of a block.
ROWS, ANCHORS = 8192, 4096
#: Rows of the best table scores that are scored exactly before others are dropped.
SEEDS = 8
#: Anchors whose table scores are held at a time.
_SOME = 256
_NO_ID = 2**63 - 1


def padded(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def codebooks(sample: np.ndarray) -> np.ndarray:
    """(books, words, WIDTH) whole codewords: k-means of each pair of components, from its first distinct values."""
    books = np.zeros((sample.shape[1] // WIDTH, WORDS, WIDTH), np.int64)
    for book, part in zip(books, np.moveaxis(sample.reshape(len(sample), -1, WIDTH), 1, 0), strict=True):
        _, first = np.unique(part, axis=0, return_index=True)
        start = part[np.sort(first)[:WORDS]]
        book[:] = start[np.arange(WORDS) % len(start)]
        for _ in range(FIT_ROUNDS):
            near = _code(part, book)
            n = np.bincount(near, minlength=WORDS)
            mean = np.stack([np.bincount(near, part[:, i], WORDS) for i in range(WIDTH)], 1) / np.maximum(n, 1)[:, None]
            book[n > 0] = np.rint(mean[n > 0])
    return books


def _code(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    p, b = part.astype(np.float64), book.astype(np.float64)
    return ((b * b).sum(1) - 2 * p @ b.T).argmin(axis=1)


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows with their code (a byte a codebook) and ``rest``, the norm of what it leaves out."""
    dims = books.shape[0] * WIDTH

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = padded(batch.column(4).to_pylist(), dims)
        parts = q.reshape(len(q), -1, WIDTH)
        code = np.stack([_code(parts[:, m], book) for m, book in enumerate(books)], 1)
        left = q - books[np.arange(len(books)), code].reshape(len(q), -1)
        rest = np.sqrt((left.astype(np.float64) ** 2).sum(1))
        return batch_of(
            row=(batch.column(0), pa.int64()), id=(batch.column(1), pa.int64()), label=(batch.column(2), pa.int64()), anchor=(batch.column(3), pa.bool_()),
            q=([x.tobytes() for x in q], pa.binary()), code=([x.tobytes() for x in code.astype(np.uint8)], pa.binary()), rest=(rest, pa.float64()),
        )

    return map_rows(rows, one, "row long, id long, label long, anchor boolean, q binary, code binary, rest double", SLICE_ROWS)


class _Block:
    """A block's rows in NumPy."""

    def __init__(self, rows: pa.Table, books: np.ndarray) -> None:
        self.row, self.id, self.label, self.rest = (rows.column(k).to_numpy() for k in ("row", "id", "label", "rest"))
        self.q = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int64).reshape(len(self.row), -1)
        self.code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(self.row), -1)
        self.books = books

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """Scores (anchors, rows) by lookup tables."""
        total = np.zeros((len(self.row), len(anchors)), np.int64)
        for m, book in enumerate(self.books):
            total += (book @ anchors[:, m * WIDTH : (m + 1) * WIDTH].T)[self.code[:, m]]
        return np.ascontiguousarray(total.T)

    def exact(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.q[at] @ anchor

    def best(self, at: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.lexsort((self.row[at], self.id[at], -score))[:most]
        return at[first], score[first]


def _within(block: _Block, anchor: np.ndarray, at: np.ndarray, table: np.ndarray, slack: np.ndarray, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` of the rows ``at`` whose exact score is from ``low`` to ``high``; table and slack are those of ``at``."""
    may = np.flatnonzero((table + slack >= low) & (table - slack <= high))
    at, table, slack = at[may], table[may], slack[may]
    inside = np.flatnonzero(table <= high)
    seeds = inside if len(inside) <= SEEDS else inside[np.argpartition(table[inside], -SEEDS)[-SEEDS:]]
    sure = block.exact(at[seeds], anchor)
    sure = np.sort(sure[(sure >= low) & (sure <= high)])
    if len(sure) >= most:
        at = at[table + slack >= sure[-most]]
    score = block.exact(at, anchor)
    keep = (score >= low) & (score <= high)
    return block.best(at[keep], score[keep], most)


def _met(coded: DataFrame, anchors: DataFrame, counts: tuple[int, int], books: np.ndarray, found, out: str) -> DataFrame:
    """found(block, anchor's fields, anchor, table scores, slack) gives output rows, for every anchor and block of rows."""
    parts, some = -(-counts[0] // ROWS), -(-counts[1] // ANCHORS)
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.select("row", "id", "label", "q", "code", "rest", deal(parts).cast("int").alias("part"), every(some).alias("some"))
    right = anchors.select("*", every(parts).alias("part"), deal(some).cast("int").alias("some"))
    names = [c.split()[0] for c in out.split(", ")]
    kind = pa.schema([(n, pa.int64()) for n in names])

    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        result = []
        if rows.num_rows and given.num_rows:
            block = _Block(rows, books)
            for start in range(0, given.num_rows, _SOME):
                fields = given.slice(start, _SOME).drop_columns(["q"]).to_pylist()
                q = np.frombuffer(b"".join(given.column("q").slice(start, _SOME).to_pylist()), np.int64).reshape(len(fields), -1)
                norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                for own, anchor, norm, table in zip(fields, q, norms, block.tables(q), strict=True):
                    result += found(block, own, anchor, table, np.ceil(norm * block.rest * (1 + 1e-9)) + 1)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*result, strict=True)] if result else [pa.array([], pa.int64()) for _ in names], schema=kind)

    return left.groupBy("part", "some").cogroup(right.groupBy("part", "some")).applyInArrow(run, out)


def _first(rows: DataFrame, by: list[str], score: str, ident: str, row: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), ident, row)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (vec_id, embedding, label).

    An anchor's positives are its first rows of the same label, without itself; its negatives for each the first rows of other labels with ``low`` to
    ``high`` percent of the positive's score.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kept = vectors.where(F.col("label").isNotNull() & finite(F.col("embedding")))
    size = kept.agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.max(F.size("embedding")).alias("dims")).first()
    if not size["anchors"]:
        return empty
    dims = max(WIDTH, -(-size["dims"] // WIDTH) * WIDTH)
    counts = size["n"], size["anchors"]
    rows = kept.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), floors(F.col("embedding"), scale, largest(dims)).alias("q"),
    )
    sample = rows.orderBy(F.xxhash64("id"), "q").select("q").limit(SAMPLE_ROWS).collect()
    books = codebooks(padded([r["q"] for r in sample], dims))
    coded = materialise(encoded(rows, books), "negatives-coded")  # rows get their numbers here, once
    anchors = materialise(coded.where("anchor").select("row", "id", "label", "q"), "negatives-anchors")

    def near(block, own, anchor, table, slack):
        at = np.flatnonzero((block.label == own["label"]) & (block.row != own["row"]))
        top = np.iinfo(np.int64).max
        at, score = _within(block, anchor, at, table[at], slack[at], -top, top, positives)
        return [(own["row"], int(block.id[i]), int(block.row[i]), int(s)) for i, s in zip(at, score, strict=True)]

    found = _met(coded, anchors, counts, books, near, "row long, positive_id long, positive_row long, positive_score long")
    found = _first(found, ["row"], "positive_score", "positive_id", "positive_row", positives)
    windows = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("windows"))
    windows = materialise(anchors.join(windows, "row"), "negatives-windows")

    def hard(block, own, anchor, table, slack):
        limits = [(w["rank"], w["positive_id"], w["positive_score"], -(-low * w["positive_score"] // 100), high * w["positive_score"] // 100) for w in own["windows"]]
        limits = [x for x in limits if x[3] <= x[4]]
        if not limits:
            return []
        least, most = min(x[3] for x in limits), max(x[4] for x in limits)
        at = np.flatnonzero((block.label != own["label"]) & (table + slack >= least) & (table - slack <= most))
        table, slack, out = table[at], slack[at], []
        for rank, positive, score, a, b in limits:
            who, scores = _within(block, anchor, at, table, slack, a, b, negatives)
            out += [(own["row"], own["id"], rank, positive, score, int(block.id[i]), int(block.row[i]), int(s)) for i, s in zip(who, scores, strict=True)]
        return out

    out = "row long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_row long, negative_score long"
    mined = _met(coded, windows, counts, books, hard, out)
    mined = _first(mined, ["row", "nth"], "negative_score", "negative_id", "negative_row", negatives)
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return mined.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
