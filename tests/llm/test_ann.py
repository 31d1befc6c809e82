"""Multiprobe hashing: recall against brute force, exact scores, probing order, copies and bad vectors."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import ann


def brute(rows, queries, k):
    ok = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, w in {i: v for i, v in ok if i in queries}.items():
        scored = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, v in ok if i != q and len(v) == len(w))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_scores(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    vectors = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = {}
    for r in ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, near in want.items():
        found = sorted(got[q])
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        exact = dict(brute(rows, {q}, len(rows))[q])
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for i, _ in near} & {i for _, i, _ in found})
    assert hits >= 0.9 * 5 * len(want)


def test_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(8).tolist(), rng.standard_normal(8).tolist()
    rows = [(i, a, 1) for i in range(20)] + [(50, a, 1), (50, a, 1), (60, b, 2), (70, [2 * x for x in b], 2)]
    rows += [(100, None, 0), (150, [0.0] * 8, 0), (200, [float("nan")] * 8, 0), (250, [None] * 8, 0), (None, a, 0), (300, [1.0] * 3, 0), (350, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = {}
    for r in ann.search(vectors, vectors.filter("vec_id % 50 = 0 or vec_id = 60"), probes=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 50, 60} and got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[60][0] == 70
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_extreme_but_finite_vectors(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal(8)
    rows = [(50, (a * 1e-200).tolist()), (1, (a * 1e200).tolist()), (2, a.tolist()), (3, (-a * 1e150).tolist()), (4, [5e-324] + [0.0] * 7)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id = 50"), tables=8, width=2, scale=50.0, probes=20).orderBy("rank").collect()
    assert {r.vec_id for r in got[:2]} == {1, 2} and all(abs(r.score - 1) < 1e-12 for r in got[:2])
    assert all(math.isfinite(r.score) for r in got)


def test_probing_order():
    rng = np.random.default_rng(2)
    low = rng.uniform(0, 1, 4)
    costs = np.concatenate((low**2, (1 - low) ** 2))
    every = [c for n in range(1, 5) for c in itertools.combinations(range(8), n) if len({x % 4 for x in c}) == len(c)]
    want = sorted(sum(costs[x] for x in c) for c in every)
    got = [sum(costs[x] for x in c) for c in ann.perturbations(costs, 40)]
    assert np.allclose(got, want[:40]) and len(ann.perturbations(costs, 1_000)) == len(every)
