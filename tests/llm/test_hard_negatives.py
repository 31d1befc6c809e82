"""Hard negatives against all pairs, pruning that loses nothing, odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import hard_negatives as H


def brute(rows, anchors, positives=5, negatives=10):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [int(max(-(2**26), min(2**26, math.floor(256 * x)))) for x in v]
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    out = []
    for a in anchors:
        if a not in kept:
            continue
        label, q = kept[a]
        score = {i: (other, sum(x * y for x, y in zip(q, v, strict=True))) for i, (other, v) in kept.items() if i != a and len(v) == len(q)}
        first = sorted((-s, i) for i, (x, s) in score.items() if x == label)[:positives]
        for ps, p in first:
            ps = -ps
            near = sorted((-s, i) for i, (x, s) in score.items() if x != label and 30 * ps <= 100 * s <= 90 * ps)[:negatives]
            out += [(a, p, r + 1, n, ps, -s) for r, (s, n) in enumerate(near)]
    return sorted(out)


def clustered(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    at = rng.integers(0, 6, n)
    v = (centres[at] + spread * rng.standard_normal((n, dim))) * rng.uniform(0.2, 3, n)[:, None]
    return [(i, int((at[i] + (rng.random() < 0.3)) % 6), [float(x) for x in v[i]]) for i in range(n)]


def test_against_all_pairs(spark):
    rows = clustered(400, 8, 1)
    rows += [(1000 + i, 2, rows[0][2]) for i in range(30)]  # copies: ties go to smaller ids
    rows += [rows[5], (6, 5, [0.5] * 8), (2000, None, [0.1] * 8), (2100, 1, None), (2200, 1, [float("nan")] * 8), (2300, 1, [None] * 8), (None, 1, [0.1] * 8)]
    rows += [(2400, 1, [0.0] * 8), (2500, 2, [0.0] * 8), (2600, 1, [1.0, 2.0]), (2700, 2, [1.0, 1.5]), (2800, 1, [1.0, 1.0]), (2900, 3, []), (3000, 3, []), (3100, 3, [1e300] + [0.0] * 7)]
    frame = spark.createDataFrame([(i, x, v, "clash", 0) for i, x, v in rows], "vec_id bigint, label int, embedding array<double>, bucket string, rank int")
    anchors = [i for i in range(0, 400, 20)] + [1000, 2000, 2400, 2600, 2900, 3100, 9999]
    asked = spark.createDataFrame([(i,) for i in anchors + [0, None]], "vec_id bigint")
    for shard_rows, block_rows in ((16_384, 512), (20, 5)):
        got = H.mine(frame, asked, shard_rows=shard_rows, block_rows=block_rows).collect()
        assert sorted(map(tuple, got)) == brute(rows, sorted(set(anchors)))
    assert H.mine(frame.limit(0), asked).count() == 0 and H.mine(frame, asked.limit(0)).count() == 0


def test_pruning_keeps_every_row_that_reaches_the_score():
    rng = np.random.default_rng(5)
    pruned = 0
    for spread in (0.05, 0.3, 2.0):
        rows = clustered(300, 12, 7, spread)
        v = np.floor(256 * np.array([x for _, _, x in rows]))
        v = v[np.argsort(np.linalg.norm(v, axis=1))][100:200]
        shard = H.Shard(np.arange(100), np.zeros(100, np.int64), v)
        for _ in range(50):
            q = v[rng.integers(100)]
            scores = shard.scores(slice(None), q)
            focus = np.argsort(-np.abs(q))[:4]
            for least in (*np.quantile(scores, [0.0, 0.5, 0.9, 1.0]), scores.max() + 1.0):
                found = shard.candidates(q, focus, float(least))
                found = np.arange(100) if isinstance(found, slice) else found
                assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
                pruned += 100 - len(found)
    assert pruned > 1_000


def test_seeded_first_rows_equal_a_sort():
    random.seed(3)
    scores, ids = np.array([random.randint(-5, 5) for _ in range(200)]), np.random.default_rng(1).permutation(200)
    assert [(-scores[i], ids[i]) for i in H._best(scores, ids, 17)] == sorted((-s, i) for s, i in zip(scores, ids, strict=True))[:17]


def test_whole_floors(spark):
    v = spark.createDataFrame([(0, 1, [-0.001, 0.999, 1 / 256, -1.0])], "vec_id bigint, label int, embedding array<double>")
    assert list(H.usable(v, "vec_id", "embedding", "label", 256).select(F.col("v")).first()[0]) == [-1.0, 255.0, 1.0, -256.0]
