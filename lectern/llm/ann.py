"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables keys a unit vector by ``width`` quantised Gaussian projections. A
query visits, in each table, its own bucket and then perturbed ones in the order of estimated
success: least sum of squared distances to the crossed bucket borders first. The tables'
candidates are merged and ranked by exact cosine in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import materialise, small_enough


def projections(dim: int, tables: int, width: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dim x tables*width) and offsets; drawn from the seed, alike on every executor."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, tables * width)), rng.uniform(0, scale, tables * width)


def _keys(cells: np.ndarray) -> np.ndarray:
    """Hash of the last axis, int64."""
    h = np.full(cells.shape[:-1], 0x243F6A8885A308D3, np.uint64)
    for j in range(cells.shape[-1]):
        h = (h ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def perturbations(costs: np.ndarray, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` cheapest sets of perturbations (as indices into ``costs``, ascending order), best first.

    ``costs`` has 2 * width squared border distances; index i and its opposite belong to the same
    projection and never go together. Sets grow by shifting or expanding their costliest member.
    """
    order = np.argsort(costs, kind="stable")
    m, width = len(order), len(order) // 2
    found, heap = [], [(float(costs[order[0]]), (0,))]
    while heap and len(found) < probes:
        cost, members = heapq.heappop(heap)
        used = [order[i] % width for i in members]
        if len(set(used)) == len(used):
            found.append(tuple(int(order[i]) for i in members))
        last = members[-1]
        if last + 1 < m:
            ahead = float(costs[order[last + 1]])
            heapq.heappush(heap, (cost - float(costs[order[last]]) + ahead, (*members[:-1], last + 1)))
            heapq.heappush(heap, (cost + ahead, (*members, last + 1)))
    return found


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: cosines stay, squares cannot overflow or vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = _scaled(flat.reshape(batch.num_rows, -1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def entries_of(dim: int, tables: int, width: int, scale: float, seed: int, shards: int):
    """Batches of (g, v) to rows (table, shard, g, bucket, v): every vector once in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = projections(dim, tables, width, scale, seed)
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                keys = _keys(np.floor((_unit(part) @ a + b).reshape(part.num_rows, tables, width) / scale))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, t), pa.int32()), pa.array(keys[:, t] % shards, pa.int64()),
                         part.column(0), pa.array(keys[:, t], pa.int64()), part.column(1)],
                        ["table", "shard", "g", "bucket", "v"],
                    )

    return run


def visits_of(dim: int, tables: int, width: int, scale: float, seed: int, shards: int, probes: int):
    """Batches of (q, w) to rows (table, shard, q, buckets, w): a query's own and perturbed buckets, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = projections(dim, tables, width, scale, seed)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                at = (_unit(part) @ a + b).reshape(part.num_rows, tables, width) / scale
                cells, ids, vectors = np.floor(at), part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = []
                for i, q in enumerate(ids):
                    for t in range(tables):
                        low = at[i, t] - cells[i, t]
                        sets = perturbations(np.concatenate((low**2, (1 - low) ** 2)), probes)
                        moved = np.repeat(cells[i, t][None], len(sets) + 1, axis=0)
                        for r, members in enumerate(sets):
                            for x in members:
                                moved[r, x % width] += -1 if x < width else 1
                        keys = _keys(moved)
                        for shard in np.unique(keys % shards):
                            rows.append({"table": t, "shard": shard, "q": q, "buckets": keys[keys % shards == shard], "w": vectors[i]})
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), batch.column(1).type]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], kind) for c, kind in zip(rows[0], kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds],
                    ["table", "shard", "q", "buckets", "w"],
                )

    return run


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return _scaled(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1))


def _meet(keep: int):
    """One shard of one table: exact scores of each visit's candidates, those tied with the best ``keep``."""

    def run(entries: pa.Table, visits: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if entries.num_rows and visits.num_rows:
            bucket = entries["bucket"].to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket, g, v = bucket[order], entries["g"].to_numpy()[order], _matrix(entries["v"], entries.num_rows)[order]
            size = np.sqrt((v * v).sum(axis=1))
            w = _matrix(visits["w"], visits.num_rows)
            for i, (q, keys) in enumerate(zip(visits["q"].to_pylist(), visits["buckets"].combine_chunks(), strict=True)):
                keys = np.asarray(keys.values)
                first, last = np.searchsorted(bucket, keys), np.searchsorted(bucket, keys, "right")
                at = np.concatenate([np.arange(x, y) for x, y in zip(first, last, strict=True)])
                if not len(at):
                    continue
                # Row by row in a fixed order of additions: the same score in whichever table.
                score = (v[at] * w[i]).sum(axis=1) / (size[at] * np.sqrt((w[i] * w[i]).sum()))
                best = score >= np.partition(score, len(score) - keep)[len(score) - keep] if len(score) > keep else slice(None)
                out.append((q, g[at][best], score[best]))
        return pa.table({
            "q": pa.array(np.concatenate([np.full(len(x), q) for q, x, _ in out]) if out else [], pa.int64()),
            "g": pa.array(np.concatenate([x for _, x, _ in out]) if out else [], pa.int64()),
            "score": pa.array(np.concatenate([x for _, _, x in out]) if out else [], pa.float64()),
        })

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id whose vector is not null, not zero and has only finite numbers."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(F.coalesce(finite, F.lit(False)))
        .filter(F.exists(v, lambda x: x != 0))
    )


def search(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    tables: int = 24, width: int = 6, scale: float = 1.0, probes: int = 200, seed: int = 17, shard_rows: int = 32_000,
) -> DataFrame:
    """The ``k`` nearest found for each query: query_id, rank, vec_id, score; by cosine, ties to the smaller id.

    A query is never its own neighbour. Vectors that are null, zero, of another length than most, or
    hold null or non-finite numbers take no part; neither do null ids. Equal vectors are one entry
    of the index with their ``k`` + 1 smallest ids, which is all that a top ``k`` can use, so a
    group of copies costs as much as one vector. Repeated query ids with the same vector count
    once.

    Buckets of a table are dealt into shards of about ``shard_rows`` vectors; a query goes, with its
    vector, to the shards that hold its buckets, and each shard answers with its best candidates.
    ``width`` should grow with the logarithm of the number of vectors.
    """
    every = usable(vectors, id_col, vector_col)
    lengths = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return every.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim = lengths["n"]
    every = every.filter(F.size("v") == dim).withColumn("g", F.xxhash64("v"))
    ids = Window.partitionBy("g").orderBy("vec_id")
    few = every.select("g", "vec_id").distinct().withColumn("k", F.row_number().over(ids)).filter(F.col("k") <= k + 1).drop("k")
    few = materialise(few, "ann-ids")
    index = materialise(every.groupBy("g").agg(F.min_by("v", "vec_id").alias("v")), "ann-vectors")
    asked = usable(queries, id_col, vector_col).filter(F.size("v") == dim).withColumn("g", F.xxhash64("v"))
    asked = materialise(asked.select(F.col("vec_id").alias("query_id"), "g").distinct(), "ann-queries")
    # Equal queries share their search, too.
    points = materialise(index.join(small_enough(asked), "g", "left_semi"), "ann-points")
    kind = every.schema["v"].dataType.simpleString()
    args = (dim, tables, width, scale, seed, max(1, math.ceil(index.count() / shard_rows)))
    entries = index.select("g", "v").mapInArrow(entries_of(*args), f"table int, shard bigint, g bigint, bucket bigint, v {kind}")
    visits = points.select("g", "v").mapInArrow(visits_of(*args, probes), f"table int, shard bigint, q bigint, buckets array<bigint>, w {kind}")
    # A distinct vector stands for k + 1 ids at most, of which one may be the query's own.
    near = (
        entries.groupBy("table", "shard").cogroup(visits.groupBy("table", "shard"))
        .applyInArrow(_meet(k + 1), "q bigint, g bigint, score double").groupBy("q", "g").agg(F.max("score").alias("score"))
    )
    near = near.withColumn("m", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("m") <= k + 1).drop("m")
    found = asked.withColumnRenamed("g", "q").join(near, "q").join(few, "g").filter("vec_id <> query_id")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
