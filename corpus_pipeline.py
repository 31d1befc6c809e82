"""From raw documents to packed batches: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Between stages the rows are written and read again as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, langid, lines, ngram_join, packing
from lectern.llm.common import materialise, small_batches, small_enough


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models learn from all labelled languages of the input.

    Null, empty and letterless texts go; without any labelled language nothing is recognised and all go. Repeated rows
    stay or go together.
    """
    small_batches(spark)
    return langid.drop_rejected(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, min_chars: int = 1) -> DataFrame:
    """Near-equal lines of ``min_chars`` characters or more kept once; n_chars follows the text.

    A line stays where the document id is smallest (ties: first place). Documents that lose their last line go; null, empty
    and blank texts stay; repeated rows keep the same lines.
    """
    small_batches(spark)
    kept = lines.dedup_lines(docs, min_chars=min_chars).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; rows without an id always stay.

    Rows that repeat an id and its text stay once.
    """
    small_batches(spark)
    groups = materialise(ngram_join.jaccard_components(docs), "groups")
    lost = materialise(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "lost")
    kept = docs.join(small_enough(lost), "doc_id", "left_anti").select(*docs.columns)
    again = materialise(groups.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    twice = kept.join(small_enough(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small_enough(again), "doc_id", "left_anti").unionByName(twice)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark windows.

    Null and word-less texts stay, repeated rows stay or go together; an empty benchmark drops nothing.
    """
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket and batch; lengths are tokens, counted as in op6_digest_cache.

    Null and empty texts have 0 tokens and are packed, too; repeated rows are packed each.
    """
    import public_tokenizers

    small_batches(spark)
    return packing.pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("length_packing", length_packing),
]

#: MinHash candidates, language models and the buckets' dynamic programming have no SQL form; the
#: stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
