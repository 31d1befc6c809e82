"""Retrieval quality over judged hits (query_id, rank, relevant 0/1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _within(k: int) -> Column:
    return F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0)


def recall_at_k(judged: DataFrame, k: int) -> DataFrame:
    """Share of queries with a relevant hit among the first ``k``."""
    return judged.groupBy("query_id").agg(F.max(_within(k)).alias("hit")).agg(F.round(F.avg("hit"), 6).alias("recall"))


def mrr(judged: DataFrame) -> DataFrame:
    first = judged.groupBy("query_id").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"))
    return first.agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def precision_at_k(judged: DataFrame, k: int) -> DataFrame:
    return judged.groupBy("query_id").agg((F.sum(_within(k)) / k).alias("p")).agg(F.round(F.avg("p"), 6).alias("precision"))


def _ideal(n: Column, k: int) -> Column:
    """Discounted gain of ``n`` relevant hits in the first places, ``k`` at most."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when(i <= n, 1 / F.log2(i + 1)).otherwise(0.0))


def ndcg_at_k(judged: DataFrame, k: int) -> DataFrame:
    """Binary gains; the ideal has all relevant hits first."""
    gain = F.sum(_within(k) / F.log2(F.col("rank") + 1)).alias("dcg")
    rows = judged.groupBy("query_id").agg(gain, F.least(F.sum("relevant"), F.lit(k)).alias("n"))
    return rows.agg(F.round(F.avg(F.coalesce(F.try_divide(F.col("dcg"), _ideal(F.col("n"), k)), F.lit(0.0))), 6).alias("ndcg"))


def compare(judged: DataFrame, k: int) -> DataFrame:
    """Recall, reciprocal rank, precision and discounted gain for each ``strategy``, in one pass over all of them."""
    first = F.min(F.when(F.col("relevant") == 1, F.col("rank")))
    per = judged.groupBy("strategy", "query_id").agg(
        F.max(_within(k)).alias("hit"), F.coalesce(1 / first, F.lit(0.0)).alias("rr"), (F.sum(_within(k)) / k).alias("p"),
        F.sum(_within(k) / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("relevant").alias("n"),
    )
    gain = F.coalesce(F.try_divide(F.col("dcg"), _ideal(F.col("n"), k)), F.lit(0.0))
    mean = lambda c: F.round(F.avg(c), 6)
    return per.groupBy("strategy").agg(mean("hit").alias("recall"), mean("rr").alias("mrr"), mean("p").alias("precision"), mean(gain).alias("ndcg"))


QUANTILES = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))


def latency_report(requests: DataFrame, seconds: int, exact: bool = False) -> DataFrame:
    """(start, n, per_second, error_rate, ...) of (ts, duration_ms, status) by windows of ``seconds``; status from 500 on is an error.

    ``exact`` adds p50, p95, p99 with all durations of a window held at once; otherwise ``errors`` and a ``sketch`` (KLL, a few
    kilobytes however many requests) come, of which ``merged_latency`` makes quantiles over any number of windows.
    """
    start = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("bigint").alias("start")
    bad = F.when(F.col("status") >= 500, 1.0).otherwise(0.0)
    rates = [F.count("*").alias("n"), F.round(F.count("*") / seconds, 6).alias("per_second"), F.round(F.avg(bad), 6).alias("error_rate")]
    if exact:
        rates += [F.round(F.percentile("duration_ms", q), 6).alias(name) for name, q in QUANTILES]
    else:
        rates += [F.sum(bad).cast("bigint").alias("errors"), F.kll_sketch_agg_double(F.col("duration_ms").cast("double")).alias("sketch")]
    return requests.groupBy(start).agg(*rates)


def merged_latency(windows: DataFrame) -> DataFrame:
    """(n, error_rate, p50, p95, p99) over all windows of ``latency_report``, the quantiles from their merged sketches."""
    one = windows.agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return one.select("n", F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"), *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in QUANTILES])
