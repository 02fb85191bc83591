"""Clustering and hard negatives against plain walks."""

import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import hard_negatives, lloyd, queries

SF = "/root/testdata/sf0.001"


def lloyd_walk(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = {j: sum(d for _, d, c in found if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for i, d, c in found), key=repr)


def odd_vectors(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(dims)]) for i in range(n)]
    bad = [None, [], [0.1] * (dims - 1), [0.1] * (dims + 1), [0.1] * (dims - 1) + [None], [float("nan")] + [0.0] * (dims - 1), [float("-inf")] * dims]
    return rows + rows[:7] + [(3, [0.9] * dims), (None, [0.2] * dims), (None, [-0.2] * dims)] + [(1_000 + i, v) for i, v in enumerate(bad)]


@pytest.mark.parametrize(("n", "k"), [(0, 4), (3, 8), (90, 6)])
def test_lloyd_equals_a_walk(spark, n, k):
    rows = odd_vectors(n, 6, n)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, q string").repartition(4)
    exact = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in frame.select("vec_id", "embedding").collect()]
    for parts in (1, 5):
        got = lloyd.with_figures(lloyd.cluster(frame.repartition(parts), k, 5, 6)).collect()
        assert sorted(map(tuple, got), key=repr) == lloyd_walk(exact, 6, k, 5)


def test_lloyd_ties_empty_clusters_and_bounds(spark):
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9)], "vec_id long, embedding array<float>")
    found = lloyd.cluster(same, 3, 4, 2)
    assert found.sizes == [9, 0, 0] and found.inertias == [0, 0, 0]
    assert {r.cluster for r in found.assigned.collect()} == {0}
    assert lloyd.with_figures(lloyd.cluster(same.limit(0), 3, 4, 2)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        lloyd.cluster(spark.createDataFrame([(1, [3e38, 0.0])], "vec_id long, embedding array<float>"), 3, 4, 2)


def mined_walk(rows, every, positives, negatives):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda i: math.inf if i is None else i
    out = []
    for at, (a, label, q) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=False)), order(i), k, i, other == label) for k, (i, other, v) in enumerate(kept) if k != at]
        scored.sort(key=lambda r: r[:3])
        for ps, _, _, p, _ in [r for r in scored if r[4]][:positives]:
            fit = [r for r in scored if not r[4] and 50 * -ps <= 100 * -r[0] <= 95 * -ps][:negatives]
            out += [(a, p, k + 1, r[3], -ps, -r[0]) for k, r in enumerate(fit)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("labels", [2, 5])
def test_mined_equals_a_walk(spark, monkeypatch, labels):
    rng = random.Random(labels)
    rows = [(i, None if i % 41 == 0 else rng.randrange(labels), [rng.choice([0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(rng.choice([5, 5, 5, 3]))]) for i in range(1, 260)]
    rows += [(i, 0, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(300, 340)]  # equal scores
    rows += [(400, 1, None), (400, 1, []), (405, 1, [None, 0.1]), (410, 1, [float("nan")]), (None, 1, [0.7] * 5), (None, 0, [0.4] * 5), (300, 0, [0.5] * 5)]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, label int, embedding array<float>, row int, anchor string").repartition(6)
    monkeypatch.setattr(hard_negatives, "ROWS", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    monkeypatch.setattr(hard_negatives, "_SOME", 5)
    exact = [(r.vec_id, r.label, r.embedding) for r in frame.collect()]
    got = hard_negatives.mine(frame, F.col("vec_id") % 5 == 0, 4, 2).collect()
    want = mined_walk(exact, 5, 4, 2)
    # Rows of one vec_id and score can't be told apart in the result, so those of repeated ids are compared as a set of values.
    assert sorted(map(tuple, got), key=repr) == want
    assert len({r.anchor_id for r in got}) > 20


def test_bad_codebooks_lose_nothing(spark, monkeypatch):
    rng = random.Random(8)
    frame = spark.createDataFrame([(i, i % 3, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(200)], "vec_id long, label int, embedding array<float>")
    exact = [(r.vec_id, r.label, r.embedding) for r in frame.collect()]
    for words, sample in ((2, 3), (256, 4096)):
        monkeypatch.setattr(hard_negatives, "WORDS", words)
        monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", sample)
        assert sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") % 10 == 0).collect()), key=repr) == mined_walk(exact, 10, 5, 3)


def test_no_anchors_and_no_rows(spark):
    frame = spark.createDataFrame([(7, 1, [0.1]), (None, 1, [0.2])], "vec_id long, label int, embedding array<float>")
    for rows in (frame, frame.limit(0)):
        out = hard_negatives.mine(rows, F.col("vec_id") % 5 == 0)
        assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("name", ["op12_lloyd", "op13_hard_negatives"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
