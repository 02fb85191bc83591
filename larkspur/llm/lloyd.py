"""Plain Lloyd clustering of whole-number vectors, exact and repeatable at any partitioning.

Vectors become whole numbers once and are written to the shared folder; every round reads them, and neither they nor their assignment pass
through the driver. Centroids (``k`` times ``dims`` whole numbers, whatever the corpus) are broadcast. ``mapInPandas`` takes the squared
differences to one centroid after the other in NumPy, the lowest number of equally near ones, and gives out one row of sums a
centroid and task; ``groupBy`` adds those up. Whole numbers add up to the same in any order, so lost executors and other file splits change nothing.

Rows with a null vector, with another number of components than ``dims``, or with any null, NaN or infinite one take no part. Repeated rows are vectors of their
own. Fewer vectors than ``k`` give as many centroids; of equal hashes (repeated or null ids) the lesser vector comes first, null ids last. An empty table gives an empty result. Other columns
are ignored. A scaled component beyond ``largest(dims)`` stops the job with a message, as its squares might not fit a long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Rows whose differences are held at a time.
_ROWS = 4096


def largest(dims: int = DIMS) -> int:
    """How large a component may be for a squared distance to fit a long."""
    return math.isqrt(2**62 // dims) // 2


def finite(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite; null for a null vector."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def floors(vector: Column, scale: int, most: int) -> Column:
    """The floor of ``scale`` times each component, taken as a double."""
    scaled = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float(most)))
    return F.when(fits, F.transform(vector, scaled)).otherwise(F.raise_error(F.lit(f"a component is beyond {most} after scaling")))


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, q)`` of the rows that take part."""
    kept = vectors.where((F.size("embedding") == dims) & finite(F.col("embedding")))
    return kept.select(F.col("vec_id").cast("long"), floors(F.col("embedding"), scale, largest(dims)).alias("q"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the lowest number of several."""
    apart = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        apart[:, k] = np.einsum("ij,ij->i", d, d)
    near = apart.argmin(axis=1)
    return near, apart[np.arange(len(x)), near]


def _slices(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for rows in parts:
        for at in range(0, len(rows), _ROWS):
            some = rows.iloc[at : at + _ROWS]
            yield some, np.stack(some["q"].to_numpy()).astype(np.int64)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` smallest sha256 of ``seed:vec_id``, in that order."""
    of = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["q"] for r in rows.orderBy(of.asc_nulls_last(), "q").limit(k).collect()], np.int64)


def updated(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means; one without vectors stays."""
    shared, dims = rows.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(shared.value), dims + 1), np.int64)
        for _, x in _slices(parts):
            near, _ = nearest(x, shared.value)
            for k in np.unique(near):
                own = x[near == k]
                total[k] += [len(own), *own.sum(axis=0)]
        used = np.flatnonzero(total[:, 0])
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": total[used, 0], "sums": list(total[used, 1:])})

    parts = rows.select("q").mapInPandas(sums, "cluster int, n long, sums array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in merged.collect():  # k rows
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


@dataclass(frozen=True)
class Clusters:
    """``assigned`` has (vec_id, cluster, distance) of every vector; the other fields one entry a cluster."""

    assigned: DataFrame
    centroids: np.ndarray
    sizes: list[int]
    inertias: list[int]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> Clusters:
    rows = materialise(whole_vectors(vectors, dims, scale), "lloyd-vectors")
    centroids = first_centroids(rows, k, seed).reshape(-1, dims)
    for _ in range(rounds):
        before, centroids = centroids, updated(rows, centroids) if len(centroids) else centroids
        if np.array_equal(before, centroids):
            break  # a further round would give the same
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, x in _slices(parts):
            near, apart = nearest(x, shared.value)
            yield pd.DataFrame({"vec_id": some["vec_id"], "cluster": near.astype(np.int32), "distance": apart})

    assigned = materialise(rows.mapInPandas(assign, "vec_id long, cluster int, distance long"), "lloyd-assigned")
    found = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()}
    sizes, inertias = ([int(found[c][f]) if c in found else 0 for c in range(len(centroids))] for f in ("n", "inertia"))
    return Clusters(assigned, centroids, sizes, inertias)


def with_figures(found: Clusters) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256: what is known of each cluster, looked up by its number."""
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return found.assigned.select("*", at(found.inertias, "bigint").alias("cluster_inertia"), F.lit(sum(found.inertias)).cast("long").alias("inertia"), at(found.digests(), "string").alias("centroid_sha256"))
