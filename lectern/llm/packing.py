"""Packing into optimal length buckets.

The histogram of all distinct lengths goes to the driver; dynamic programming over it, with
monotone choices (buckets x lengths x log lengths steps), chooses at most ``buckets`` upper bounds that give the least padding. Inside each bucket every
document is padded to the bucket's bound and batches hold as many as the token budget allows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import materialise
from lectern.llm.tokens import token_lengths

#: Rows of a bucket that one sort partition gets, about.
SHARD_ROWS = 50_000


def _least(costs_from: np.ndarray, top: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j > 0 the least ``costs_from[i] + top[j - 1] * (n[j] - n[i])`` over i < j, and its smallest i.

    The best i never falls as j grows, so the j in the middle of a range bounds i on both of its
    sides; all ranges of one depth are searched at once.
    """
    m = len(top)
    least, at = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    first, last, low, high = (np.array([x], np.int64) for x in (1, m, 0, m - 1))
    while len(first):
        mid = (first + last) // 2
        sizes = np.minimum(high, mid - 1) - low + 1
        starts = np.cumsum(sizes) - sizes
        i = np.arange(sizes.sum()) + np.repeat(low - starts, sizes)
        cost = costs_from[i] - np.repeat(top[mid - 1], sizes) * n[i]
        smallest = np.minimum.reduceat(cost, starts)
        equal = np.flatnonzero(cost == np.repeat(smallest, sizes))
        chosen = i[equal[np.searchsorted(equal, starts)]]
        least[mid], at[mid] = smallest + top[mid - 1] * n[mid], chosen
        first, last = np.concatenate((first, mid + 1)), np.concatenate((mid - 1, last))
        low, high = np.concatenate((low, chosen)), np.concatenate((chosen, high))
        more = first <= last
        first, last, low, high = first[more], last[more], low[more], high[more]
    return least, at


def optimal_bounds(lengths: list[int], counts: list[int], sums: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` runs of ``lengths`` (ascending) with the least padding.

    ``counts`` and ``sums``: documents in each bin and the sum of their lengths; a run costs its
    largest length times its documents less the sum of their lengths. Fewer buckets win ties.
    """
    m = len(lengths)
    if not m:
        return []
    top = np.asarray(lengths, np.int64)
    n, total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), np.concatenate(([0], np.cumsum(sums, dtype=np.int64)))
    best = np.concatenate(([0], top * n[1:] - total[1:]))
    choices = [np.concatenate(([-1], np.zeros(m, np.int64)))]
    for _ in range(min(buckets, m) - 1):
        cost, i = _least(best + total, top, n)
        cost -= total
        better = cost < best
        better[0] = False
        choices.append(np.where(better, i, -1))
        best = np.where(better, cost, best)
    bounds, j = [], m
    for choice in reversed(choices):
        if j and choice[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(choice[j])
    return sorted(bounds)


def length_histogram(lengths: DataFrame, column: str) -> tuple[list[int], list[int], list[int]]:
    """(length, documents, sum of lengths) of each distinct length, ascending."""
    found = lengths.groupBy(F.col(column).alias("n")).agg(F.count("*").alias("c")).toArrow().sort_by("n")
    n, c = (found.column(x).to_numpy().astype(np.int64) for x in ("n", "c"))
    return n.tolist(), c.tolist(), (n * c).tolist()


def pack(
    docs: DataFrame, length: Column, *, budget: int = 65_536, buckets: int = 16, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_units, bucket (from 0), bound, padding, batch_id (string), batch_rows.

    ``length`` is an expression over ``docs``; null counts as 0. A batch holds ``budget // bound``
    documents of one bucket (one document where a bound exceeds the budget), so bound times rows
    stays in the budget. Rows of a bucket are dealt by a hash of id and text into shards of about
    ``SHARD_ROWS`` and numbered inside them, so no task holds a bucket; each shard may end with
    one batch that is not full. Repeated rows are packed one by one. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("bigint").alias("n_units"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"))
    tops, counts, sums = length_histogram(rows, "n_units")
    bounds = optimal_bounds(tops, counts, sums, buckets) or [0]
    inside = np.searchsorted(bounds, tops) if tops else np.empty(0, int)
    size = np.bincount(inside, weights=np.asarray(counts), minlength=len(bounds)) if tops else np.zeros(1)
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), F.col("bucket") + 1)
    bucket = sum((F.col("n_units") > int(b)).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    rows = rows.withColumn("bucket", bucket).withColumns({
        "bound": pick(bounds), "_per": pick([max(1, budget // max(b, 1)) for b in bounds]),
        "_shards": pick([max(1, math.ceil(x / SHARD_ROWS)) for x in size]),
    }).withColumn("_shard", F.pmod("_h", "_shards"))
    order = Window.partitionBy("bucket", "_shard").orderBy("_h", "doc_id", "n_units")
    rows = rows.withColumn("_k", F.floor((F.row_number().over(order) - 1) / F.col("_per")))
    return rows.select(
        "doc_id", "n_units", "bucket", "bound", (F.col("bound") - F.col("n_units")).alias("padding"),
        F.concat_ws("-", "bucket", "_shard", "_k").alias("batch_id"),
        F.count("*").over(Window.partitionBy("bucket", "_shard", "_k")).alias("batch_rows"),
    )


def pack_tokens(docs: DataFrame, tokenizer: str, *, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` by the number of tokens of each text; rows are dealt by a hash of id and content, so no text is shuffled.

    A null text counts as empty, with 0 tokens, and is packed like any; null ids and repeated rows are rows of their own.
    An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    found = materialise(token_lengths(docs, tokenizer, cache=cache, id_col=id_col, text_col=text_col), "token-lengths")
    return pack(found, F.col("n_tokens"), text_col="content")
