"""The registered queries of the corpus operators: thin, over whole tables, with contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, bag_search, compression, decontaminate, hard_negatives, langid, lines, ngram_join, packing, pii, secrets, tokens, warc
from lectern.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.page_digests(warc.read_records(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents")).drop("random")


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str, min_chars: int = 1) -> DataFrame:
    """Every line that is not blank takes part; ``min_chars`` leaves shorter lines as they are."""
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"), min_chars=min_chars)
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are tokens, counted as in op6_digest_cache."""
    import public_tokenizers

    return packing.pack_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column ``found`` has each span with the score of the final classifier."""
    return pii.scan(_table(spark, sf_dir, "documents"))


def op8_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_bag_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = docs.filter(~compression.held_out(F.col("doc_id"))).select("doc_id", "text")
    model = compression.train(learn, _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))
    found = compression.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", compression.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_lemp_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_boundary_chain": op1_warc_boundary_chain,
    "op2_fuzzy_lines": op2_fuzzy_lines,
    "op3_length_buckets": op3_length_buckets,
    "op4_kneser_ney_language_id": op4_kneser_ney_language_id,
    "op5_randomness_battery": op5_randomness_battery,
    "op6_digest_cache": op6_digest_cache,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_multiprobe_lsh": op8_multiprobe_lsh,
    "op9_jaccard_metric_join": op9_jaccard_metric_join,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_bag_deduplication": op11_bag_deduplication,
    "op12_compression_distance": op12_compression_distance,
    "op13_lemp_hard_negatives": op13_lemp_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_warc_boundary_chain": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
        ), d AS (SELECT *, sha1(body) AS payload_digest FROM p),
        k AS (
            SELECT payload_digest, max(page_id) AS keeper, count(*) AS n FROM d
            WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
            CASE WHEN n > 1 AND d.page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n > 1 AND d.page_id <> keeper THEN keeper END AS refers_to
        FROM d LEFT JOIN k USING (payload_digest)
    """,
    "op10_benchmark_decontamination": r"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), iw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
        ), pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
        hit AS (
            SELECT doc_id, i, n, item_id FROM (
                SELECT doc_id, i, l.n, array_to_string(w[i:i + l.n - 1], ' ') AS s
                FROM pos, (SELECT DISTINCT n FROM win) l WHERE i + l.n - 1 <= len(w)
            ) JOIN win USING (n, s)
        ), per_word AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
        ), per_item AS (
            SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
    """,
    "op11_bag_deduplication": r"""
        WITH dw AS (
            SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
        ), d AS (SELECT doc_id, doc, w, CAST(len(w) AS BIGINT) AS n FROM dw WHERE len(w) > 0),
        tot AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
        it AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
            WHERE item_id IS NOT NULL
        ), tf AS (SELECT doc, t, count(*) AS tf FROM (SELECT doc, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY doc, t),
        wt AS (
            SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), tot
        ), sc AS (
            SELECT item_id, doc, CAST(sum(wt.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
            FROM it JOIN tf USING (t) JOIN wt USING (t) JOIN d USING (doc), tot GROUP BY item_id, doc
        ), r AS (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM sc JOIN d USING (doc) WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
    """,
    "op13_lemp_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
            FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
            SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        ) WHERE rank <= 10
    """,
}
