"""Hard negatives by coordinate pruning of inner products, after LEMP.

Rows lie in buckets of like vector length, each dealt into shards of bounded size. A shard holds, for every
coordinate, its unit vectors' values in sorted order. An anchor and a score that must be reached give, for each of
the anchor's largest coordinates (its focus), the range in which the value of a row's unit vector has to lie; the
rows inside all ranges are the candidates, and only these are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import materialise, small_enough

#: Lengths in one bucket differ by this factor at most.
LENGTH_RATIO = 1.1
#: Components are held to plus and minus this, so that scores stay within 64 bits.
COMPONENT_LIMIT = float(1 << 26)
#: Rows of the first two focus coordinates' list ends that give an anchor its first score to reach.
SEEDS = 64
#: Products of lengths below this have exact inner products in double precision.
_EXACT = float(1 << 53)


class Shard:
    """Rows of one length bucket with sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.lengths = np.sqrt((rows * rows).sum(axis=1))
        self.unit = rows / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def scores(self, at: np.ndarray | slice, anchor: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        if self.lengths.max(initial=0) * np.sqrt(anchor @ anchor) < _EXACT:
            return (self.rows[at] @ anchor).astype(np.int64)
        return self.rows[at].astype(np.int64) @ anchor.astype(np.int64)

    def seeds(self, anchor: np.ndarray, focus: np.ndarray) -> np.ndarray:
        """Rows at the ends of the first focus coordinates' lists where products with the anchor are large."""
        ends = [self.order[-SEEDS:, f] if anchor[f] > 0 else self.order[:SEEDS, f] for f in focus[:2]]
        return np.unique(np.concatenate(ends)) if ends else np.arange(min(SEEDS, len(self.ids)))

    def candidates(self, anchor: np.ndarray, focus: np.ndarray, least: float) -> np.ndarray | slice:
        """Rows that may reach the score ``least``: inside the feasible range of every focus coordinate."""
        length = np.sqrt(anchor @ anchor)
        long, short = self.lengths.max(), self.lengths.min()
        if not length or not short or least == -np.inf:
            return slice(None)
        # A row's cosine with the anchor is at least this; a negative score is reached most easily by short rows.
        cosine = least / (length * (long if least >= 0 else short)) - 1e-9
        if cosine > 1:
            return np.empty(0, np.int64)
        if cosine <= -1:
            return slice(None)
        turn = np.arccos(cosine)
        at = np.arccos(np.clip(anchor[focus] / length, -1, 1))
        low = np.cos(np.minimum(np.pi, at + turn)) - 1e-9
        high = np.cos(np.maximum(0, at - turn)) + 1e-9
        first = [int(np.searchsorted(self.sorted[:, f], x)) for f, x in zip(focus, low, strict=True)]
        last = [int(np.searchsorted(self.sorted[:, f], x, "right")) for f, x in zip(focus, high, strict=True)]
        narrow = min(range(len(focus)), key=lambda j: last[j] - first[j])
        found = self.order[first[narrow] : last[narrow], focus[narrow]]
        for j, f in enumerate(focus):
            if j != narrow and last[j] - first[j] < len(self.ids):
                value = self.unit[found, f]
                found = found[(value >= low[j]) & (value <= high[j])]
        return found if len(found) < len(self.ids) else slice(None)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` by falling score, then rising id."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return np.lexsort((ids, -scores))


def _reached(scores: np.ndarray, k: int) -> float:
    """The k-th largest score, below everything if there are fewer."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def positives_in(shard: Shard, anchor_id: int, label: int, anchor: np.ndarray, k: int, n_focus: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the shard's first ``k`` other rows with the anchor's label."""
    focus = np.argsort(-np.abs(anchor), kind="stable")[:n_focus]
    own = (shard.labels == label) & (shard.ids != anchor_id)
    seeds = shard.seeds(anchor, focus)
    at = shard.candidates(anchor, focus, _reached(shard.scores(seeds[own[seeds]], anchor), k))
    at = np.flatnonzero(own) if isinstance(at, slice) else at[own[at]]
    scores = shard.scores(at, anchor)
    best = _best(scores, shard.ids[at], k)
    return shard.ids[at][best], scores[best]


def negatives_in(shard: Shard, label: int, anchor: np.ndarray, positive_scores: list[int], k: int, n_focus: int, low: int, high: int):
    """For each positive score (ids, scores) of the shard's first ``k`` rows of other labels inside its band."""
    focus = np.argsort(-np.abs(anchor), kind="stable")[:n_focus]
    other = shard.labels != label
    seeds = shard.seeds(anchor, focus)
    seeds = seeds[other[seeds]]
    seeded = shard.scores(seeds, anchor)
    bands = [(-(-low * s // 100), high * s // 100) for s in positive_scores]
    least = min(max(float(a), _reached(seeded[(seeded >= a) & (seeded <= b)], k)) for a, b in bands)
    at = shard.candidates(anchor, focus, least)
    at = np.flatnonzero(other) if isinstance(at, slice) else at[other[at]]
    scores = shard.scores(at, anchor)
    for a, b in bands:
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        best = inside[_best(scores[inside], shard.ids[at][inside], k)]
        yield shard.ids[at][best], scores[best]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _shard(rows: pa.Table) -> Shard:
    return Shard(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows, "v"))


def _positives(k: int, n_focus: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            shard, vectors = _shard(rows), _matrix(anchors, "a")
            for i, (anchor_id, label) in enumerate(zip(anchors["anchor_id"].to_pylist(), anchors["label"].to_pylist(), strict=True)):
                ids, scores = positives_in(shard, anchor_id, label, vectors[i], k, n_focus)
                out.append((np.full(len(ids), anchor_id), ids, scores))
        return _table(out, ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, n_focus: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            shard, vectors = _shard(rows), _matrix(anchors, "a")
            wanted = zip(anchors["anchor_id"].to_pylist(), anchors["label"].to_pylist(), anchors["scores"].to_pylist(), strict=True)
            for i, (anchor_id, label, positive) in enumerate(wanted):
                for s, (ids, scores) in zip(positive, negatives_in(shard, label, vectors[i], positive, k, n_focus, low, high), strict=True):
                    out.append((np.full(len(ids), anchor_id), np.full(len(ids), s), ids, scores))
        return _table(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return run


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate([p[j] for p in parts]) if parts else [], pa.int64()) for j, n in enumerate(names)})


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): one row an id, components floor(scale * x) as doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-COMPONENT_LIMIT), F.least(F.lit(COMPONENT_LIMIT), F.floor(scale * F.greatest(F.lit(-COMPONENT_LIMIT), F.least(F.lit(COMPONENT_LIMIT), x))).cast("double"))))
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    ).filter("vec_id is not null and label is not null and v is not null").filter(F.coalesce(finite, F.lit(False)))
    one = rows.select("vec_id", F.struct("label", whole.alias("v")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return one.select("vec_id", "row.label", "row.v")


def mine(
    vectors: DataFrame, anchors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, focus: int = 6, shard_rows: int = 16_384, block_rows: int = 512,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(``scale`` * x), a score is the integer inner product. An anchor's positives are its
    first ``positives`` other rows of its label by falling score, ties to the smaller id. For each of them come, in the
    same order, the first ``negatives`` rows of other labels with low * positive <= 100 * score <= high * positive; where
    there are none, e.g. for a negative positive_score, nothing comes.

    ``anchors`` are rows of ``vectors``, told by their ids; ids without a usable row are ignored. Rows with a null id,
    label or vector, or a null or non-finite component take no part. Of rows with an equal id, repeated or not, the one
    least by label, then vector, takes part. Rows meet rows of equal vector length (dimensions) only; a vector without
    components, or all zero, has score 0 with all. Components beyond 2^26 count as that. An empty table gives an empty
    result; other columns, whatever their names, are not read.

    Length buckets are dealt into shards of about ``shard_rows`` rows by a hash of the id, so neither a frequent label
    nor a frequent length makes a large group; anchors meet shards in blocks of about ``block_rows``.
    """
    rows = usable(vectors, id_col, vector_col, label_col, scale)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bucket = F.when(length > 0, F.floor(F.log(length) / float(np.log(LENGTH_RATIO)))).otherwise(F.lit(-1))
    rows = materialise(rows.withColumn("dim", F.size("v")).withColumn("bucket", bucket.cast("int")), "negatives-rows")
    sizes = materialise(rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")), "negatives-buckets")
    dealt = rows.join(small_enough(sizes), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))

    asked = anchors.select(F.col(id_col).cast("bigint").alias("vec_id")).filter("vec_id is not null").distinct()
    asked = materialise(rows.join(small_enough(materialise(asked, "negatives-ids")), "vec_id").select(F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("a"), "dim"), "negatives-anchors")
    blocks = max(1, -(-asked.count() // block_rows))
    block = F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")
    by = ["dim", "bucket", "part", "block"]
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # Each shard once for each block of anchors, each block once for each shard of its dimensions.
    shards = dealt.select("dim", "bucket", "part", every.alias("block"), "vec_id", "label", "v").groupBy(*by)
    places = sizes.select("dim", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def met(found: DataFrame, run, schema: str) -> DataFrame:
        placed = found.withColumn("block", block).join(small_enough(materialise(places, "negatives-shards")), "dim")
        return shards.cogroup(placed.groupBy(*by)).applyInArrow(run, schema)

    near = met(asked, _positives(positives, focus), "anchor_id bigint, positive_id bigint, positive_score bigint")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = materialise(near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= positives).drop("k"), "negatives-positives")

    scores = materialise(near.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores")), "negatives-scores")
    far = met(
        asked.join(small_enough(scores), "anchor_id"), _negatives(negatives, focus, low, high),
        "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    best = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
