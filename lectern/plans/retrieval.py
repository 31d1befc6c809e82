"""Queries of the structuring, index and retrieval operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import index as I
from lectern.operators import retrieve as R
from lectern.operators import structure as S
from lectern.plans.registry import query
from lectern.sources.scratch import written

_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
#: Whole BM25 in SQL: hits(query_id, kb_id, chunk_id, score) as ``bm``.
_BM25 = rf"""tok AS (SELECT kb_id, chunk_id, unnest({_W.format("text")}) AS term FROM v_chunks),
    tf AS (SELECT kb_id, chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT kb_id, chunk_id, sum(tf) AS dl FROM tf GROUP BY ALL),
    corpus AS (SELECT c.kb_id, n, total / n AS avgdl FROM (SELECT kb_id, count(*) AS n FROM v_chunks GROUP BY ALL) c JOIN (SELECT kb_id, sum(dl) AS total FROM dl GROUP BY ALL) USING (kb_id)),
    idf AS (SELECT kb_id, term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, avgdl FROM (SELECT kb_id, term, count(*) AS df FROM tf GROUP BY ALL) JOIN corpus USING (kb_id)),
    qt AS (SELECT query_id, unnest({_W.format("query")}) AS term FROM v_queries),
    bm_all AS (SELECT query_id, kb_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
        FROM qt JOIN tf USING (term) JOIN dl USING (kb_id, chunk_id) JOIN idf USING (kb_id, term) GROUP BY ALL),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm_all QUALIFY rank <= 20)"""
_EMBED = lambda source, key, text: rf"""SELECT {key}, list_transform(range(256), lambda b: CAST(coalesce(m[b] / norm, 0) AS FLOAT)) AS embedding FROM (
    SELECT {key}, map(list(b), list(n)) AS m, sqrt(sum(n * n)) AS norm FROM (SELECT {key}, b, CAST(count(*) AS DOUBLE) AS n FROM (
    SELECT {key}, CAST(('0x' || right(md5(w), 2)) AS INT) AS b FROM (SELECT {key}, unnest({_W.format(text)}) AS w FROM {source})) GROUP BY ALL) GROUP BY {key})"""  # noqa: E731
_VEC = f"""cv AS ({_EMBED("v_chunks", "kb_id, chunk_id", "text").replace("GROUP BY kb_id, chunk_id", "GROUP BY kb_id, chunk_id")}), qv AS ({_EMBED("v_queries", "query_id", "query")}),
    ve AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
    SELECT query_id, kb_id, chunk_id, list_dot_product(CAST(qv.embedding AS DOUBLE[]), CAST(cv.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(qv.embedding AS DOUBLE[]), CAST(qv.embedding AS DOUBLE[])))
    * sqrt(list_dot_product(CAST(cv.embedding AS DOUBLE[]), CAST(cv.embedding AS DOUBLE[])))) AS score FROM qv, cv) QUALIFY rank <= 20)"""
_NORM = """CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 1.0
    ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END"""
_FUSED = f"""fu AS (SELECT query_id, kb_id, chunk_id, 0.7 * coalesce(v, 0) + 0.3 * coalesce(b, 0) AS score FROM
    (SELECT query_id, kb_id, chunk_id, {_NORM} AS b FROM bm) FULL JOIN (SELECT query_id, kb_id, chunk_id, {_NORM} AS v FROM ve) USING (query_id, kb_id, chunk_id))"""
_TOK = lambda c: rf"list_distinct(list_filter({_W.format(c)}, lambda x: length(x) > 1))"
_HYBRID = f"""cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS c FROM fu QUALIFY c <= 20),
    re AS (SELECT query_id, kb_id, chunk_id, len(list_intersect(q, d)) / len(list_distinct(list_concat(q, d))) AS score FROM (
    SELECT query_id, kb_id, chunk_id, {_TOK("query")} AS q, {_TOK("text")} AS d FROM cand JOIN v_chunks USING (kb_id, chunk_id) JOIN v_queries USING (query_id)) WHERE len(q) > 0),
    hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, kb_id, chunk_id, score FROM re QUALIFY rank <= 5)"""
_ALL = f"{_BM25}, {_VEC}, {_FUSED}, {_HYBRID}"


def _index(t):
    bag = written(I.bags(t.v_chunks), "bags")
    return bag, I.idf(I.term_stats(bag), I.corpus_stats(bag))


def _bm25(t):
    return R.bm25_search(t.v_queries, *_index(t))


def _vectors(t, bag):
    chunks = I.embed_bags(bag, ["kb_id", "chunk_id"])  # the tokens have been found and counted
    queries = I.hashing_embed(t.v_queries, "query_id", "query").withColumnRenamed("embedding", "qv")
    return chunks, queries


def hits(t, k=5):
    index = _index(t)
    chunks, queries = _vectors(t, index[0])
    return R.hybrid_retrieve(t.v_queries, queries, t.v_chunks, index, chunks, k)


def _six(df):
    return df.withColumn("score", F.round("score", 6))


@query("build_bm25_index", f"WITH {_BM25} SELECT kb_id, chunk_id, term, tf, CAST(dl AS BIGINT) AS dl, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM tf JOIN dl USING (kb_id, chunk_id) JOIN idf USING (kb_id, term)")
def build_bm25_index(t):
    return I.bm25_index(t.v_chunks).withColumns({"idf": F.round("idf", 6), "avgdl": F.round("avgdl", 6)})


@query("bm25_search", f"WITH {_BM25} SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, rank FROM bm")
def bm25_search(t):
    return _six(_bm25(t))


@query("hashing_embed", f"SELECT query_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS embedding FROM ({_EMBED('v_queries', 'query_id', 'query')})")
def hashing_embed(t):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return I.hashing_embed(t.v_queries, "query_id", "query").withColumn("embedding", rounded)


@query("vector_search", """SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
    SELECT a.chunk_id AS query_id, b.kb_id, b.chunk_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score
    FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM v_vectors WHERE chunk_id % 25 = 0) a, (SELECT kb_id, chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM v_vectors WHERE modality = 'text') b) QUALIFY rank <= 20""")
def vector_search(t):
    v = t.v_vectors
    queries = v.filter("chunk_id % 25 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qv"))
    return _six(R.vector_search(queries, v, where=F.col("modality") == "text"))


@query("image_search", """SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
    SELECT a.chunk_id AS query_id, b.kb_id, b.chunk_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score
    FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM v_vectors WHERE chunk_id % 25 = 0) a, (SELECT kb_id, chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM v_vectors WHERE modality = 'image') b) QUALIFY rank <= 5""")
def image_search(t):
    v = t.v_vectors
    queries = v.filter("chunk_id % 25 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qv"))
    same = (F.col("modality") == "image") & (F.size("embedding") == 64)
    return _six(R.top_k(R.vector_search(queries, v, 5, same).drop("rank"), 5, ["query_id"]))


@query("minmax_normalize", f"WITH {_BM25} SELECT query_id, kb_id, chunk_id, round({_NORM}, 6) AS norm FROM bm")
def minmax_normalize(t):
    return R.minmax_normalize(_bm25(t)).select("query_id", "kb_id", "chunk_id", F.round("norm", 6).alias("norm"))


@query("hybrid_fuse", f"WITH {_BM25}, {_VEC}, {_FUSED} SELECT query_id, kb_id, chunk_id, round(score, 6) AS score FROM fu")
def hybrid_fuse(t):
    index = _index(t)
    chunks, queries = _vectors(t, index[0])
    return _six(R.hybrid_fuse(R.bm25_search(t.v_queries, *index), R.vector_search(queries, chunks)))


@query("hybrid_retrieve", f"WITH {_ALL} SELECT query_id, rank, kb_id, chunk_id, round(score, 6) AS score FROM hits")
def hybrid_retrieve(t):
    return _six(hits(t))


@query("rerank_overlap", f"""WITH {_BM25} SELECT query_id, chunk_id, round(len(list_intersect(q, d)) / len(list_distinct(list_concat(q, d))), 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(q, d)) / len(list_distinct(list_concat(q, d))), 9) DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, {_TOK("query")} AS q, {_TOK("text")} AS d FROM bm JOIN v_queries USING (query_id) JOIN v_chunks USING (kb_id, chunk_id)) WHERE len(q) > 0 QUALIFY rank <= 5""")
def rerank_overlap(t):
    """The keyword candidates of all knowledge bases, reranked."""
    found = _bm25(t).select("query_id", "kb_id", "chunk_id")
    pairs = found.join(t.v_chunks.select("kb_id", "chunk_id", "text"), ["kb_id", "chunk_id"]).join(t.v_queries, "query_id")
    return R.rerank_overlap(pairs, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("multi_query_merge", f"""WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
    SELECT query_id // 2 AS query_id, chunk_id, max(score) AS score FROM bm GROUP BY ALL) QUALIFY rank <= 10""")
def multi_query_merge(t):
    """Queries 2n and 2n + 1 count as variants of one."""
    return _six(R.multi_query_merge(_bm25(t).withColumn("query_id", F.floor(F.col("query_id") / 2)), 10))


_IMAGES = """im AS (SELECT query_id, 'img_' || chunk_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
    SELECT a.chunk_id AS query_id, b.chunk_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score
    FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM v_vectors WHERE chunk_id IN (SELECT query_id FROM v_queries)) a, (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM v_vectors WHERE modality = 'image') b) QUALIFY rank <= 2)"""


@query("append_images", f"""WITH {_BM25}, {_IMAGES}, tx AS (SELECT query_id, chunk_id, place AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM bm) WHERE place <= 3)
    SELECT query_id, chunk_id, section, row_number() OVER (PARTITION BY query_id ORDER BY section, rank) AS position FROM (SELECT *, CAST(0 AS BIGINT) AS section FROM tx UNION ALL SELECT *, 1 FROM im)""")
def append_images(t):
    """Keyword hits, then hits of the image index; a query's image-space vector is the one with its number."""
    text = R.top_k(_bm25(t).drop("rank"), 3, ["query_id"]).select("query_id", "chunk_id", "rank")
    v = t.v_vectors
    asked = v.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qv")).join(t.v_queries.select("query_id"), "query_id", "left_semi")
    images = R.top_k(R.vector_search(asked, v, 2, where=F.col("modality") == "image").drop("rank"), 2, ["query_id"])
    images = images.select("query_id", F.concat(F.lit("img_"), "chunk_id").alias("chunk_id"), "rank")
    return R.append_sections(text, images).select("query_id", "chunk_id", "section", "position")


@query("retrieve_material", f"""WITH {_BM25}, five AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM bm QUALIFY place <= 5),
    f AS (SELECT query_id % 5 AS request, query_id, chunk_id FROM five QUALIFY row_number() OVER (PARTITION BY query_id % 5, chunk_id ORDER BY query_id, place) = 1)
    SELECT q.query_id % 5 AS request, q.query_id, coalesce(n, 0) AS count, f.chunk_id FROM v_queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM five GROUP BY ALL) c ON c.query_id = q.query_id LEFT JOIN f ON f.query_id = q.query_id""")
def retrieve_material(t):
    """Queries of one request in turn: how many chunks each found, and those that none before it has given."""
    rows = written(R.top_k(_bm25(t).drop("rank"), 5, ["query_id"]).withColumn("request", F.col("query_id") % 5), "material")
    first = R.first_occurrences(rows, "request", ["query_id", "rank"]).select("query_id", "chunk_id")
    log = t.v_queries.select("query_id").join(rows.groupBy("query_id").count(), "query_id", "left").select("query_id", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    return log.join(first, "query_id", "left").select((F.col("query_id") % 5).alias("request"), "query_id", "count", "chunk_id")


def _cited(t):
    found = R.top_k(_bm25(t).drop("rank"), 5, ["query_id"])
    return R.build_citations(found.join(t.v_chunks, ["kb_id", "chunk_id"]))


_CITED = f"""{_BM25}, ci AS (SELECT query_id, chunk_id, document_name || ' · 第' || page_number || '页 · 块' || (chunk_index + 1) AS label, text, index,
    CASE WHEN length(trim(text, ' ' || chr(10))) > 80 THEN substr(trim(text, ' ' || chr(10)), 1, 80) || '…' ELSE trim(text, ' ' || chr(10)) END AS excerpt FROM (
    SELECT query_id, kb_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS index FROM bm QUALIFY index <= 5) JOIN v_chunks USING (kb_id, chunk_id))"""


def _label():
    return X.citation_label(F.col("document_name"), F.col("doc_id"), F.col("page_number"), F.col("chunk_index"))



@query("build_citations", f"WITH {_CITED} SELECT query_id, index, chunk_id, label, excerpt FROM ci")
def build_citations(t):
    return _cited(t).select("query_id", "index", "chunk_id", _label().alias("label"), "excerpt")


@query("build_context", f"WITH {_CITED} SELECT query_id, string_agg('[' || index || '] (' || label || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY index) AS context FROM ci GROUP BY query_id")
def build_context(t):
    return R.build_context(_cited(t), _label())


@query("annotate_answer", f"""WITH {_CITED} SELECT query_id, query || coalesce(refs, '') AS answer FROM v_queries LEFT JOIN (SELECT query_id, chr(10) || chr(10) || '**参考来源：**' || chr(10) ||
    string_agg('[' || index || '] ' || label || CASE WHEN excerpt <> '' THEN ' — ' || excerpt ELSE '' END, chr(10) ORDER BY index) AS refs FROM ci GROUP BY query_id) USING (query_id)""")
def annotate_answer(t):
    return R.annotate_answer(t.v_queries.select("query_id", F.col("query").alias("answer")), _cited(t), _label())


def _answers(t):
    """Documents as answers: own text, another text or nothing as context, some of them refusals."""
    m = F.col("doc_id") % 6
    answer = F.when(m == 0, "Not found in the files").otherwise(F.col("text"))
    context = F.when(m.isin(1, 3), F.array("text")).when(m == 4, F.array(F.reverse("text"))).when(m == 5, F.array(F.lit(" "))).when(m == 0, F.when(F.col("doc_id") % 12 == 0, F.array("text")))
    return t.documents.select(F.col("doc_id").alias("query_id"), answer.alias("answer"), context.alias("contexts"))


_GROUND = rf"""an AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 6 = 0 THEN 'Not found in the files' ELSE text END AS answer,
    CASE WHEN doc_id % 6 IN (1, 3) OR doc_id % 12 = 0 THEN text WHEN doc_id % 6 = 4 THEN reverse(text) ELSE '' END AS ctx FROM documents),
    kw AS (SELECT query_id, ctx, term, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, pos) AS k FROM (SELECT query_id, ctx, term, count(*) AS n, min(pos) AS pos FROM (
    SELECT query_id, ctx, w[i] AS term, i AS pos FROM (SELECT query_id, ctx, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT query_id, ctx, list_filter(regexp_extract_all(answer, '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1) AS w FROM an))) GROUP BY ALL) QUALIFY k <= 15),
    gr AS (SELECT query_id, answer, ctx <> '' AS has_context, answer = 'Not found in the files' AS no_answer, CASE WHEN answer = 'Not found in the files' THEN 1.0 WHEN ctx = '' THEN 0.0 ELSE coalesce(share, 0) END AS confidence
    FROM an LEFT JOIN (SELECT query_id, avg(CASE WHEN contains(ctx, term) THEN 1.0 ELSE 0.0 END) AS share FROM kw GROUP BY query_id) USING (query_id)),
    gc AS (SELECT *, no_answer OR (has_context AND confidence >= 0.3) AS grounded FROM gr)"""


@query("groundedness", f"WITH {_GROUND} SELECT query_id, has_context, no_answer, round(CAST(confidence AS DOUBLE), 6) AS confidence, grounded FROM gc")
def groundedness(t):
    return R.groundedness(_answers(t)).select("query_id", "has_context", "no_answer", F.round("confidence", 6).alias("confidence"), "grounded")


@query("should_suppress", f"WITH {_GROUND} SELECT query_id, CASE WHEN no_answer THEN false WHEN NOT has_context THEN true ELSE NOT grounded END AS suppress FROM gc")
def should_suppress(t):
    g = R.groundedness(_answers(t))
    return g.select("query_id", R.should_suppress(F.col("has_context"), F.col("no_answer"), F.col("grounded")).alias("suppress"))


@query("answer_assembly", f"""WITH {_GROUND} SELECT query_id, CASE WHEN has_context THEN answer ELSE '{R.REFUSAL}' END AS answer, has_context AND grounded AS grounded, NOT has_context OR no_answer AS no_answer,
    CASE WHEN has_context THEN round(CAST(confidence AS DOUBLE), 6) ELSE 0.0 END AS confidence FROM gc""")
def answer_assembly(t):
    rows = _answers(t)
    out = R.answer_assembly(rows, rows.select("query_id", "answer"), rows.select("query_id", "contexts"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("dedup_query_batch", f"""WITH {_BM25}, pl AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM bm),
    rq AS (SELECT event_id, event_id % 20 AS query_id, 3 + user_id % 2 AS k FROM events)
    SELECT event_id, string_agg(chunk_id, '|' ORDER BY place) AS hits FROM rq LEFT JOIN pl ON pl.query_id = rq.query_id AND place <= k GROUP BY event_id""")
def dedup_query_batch(t):
    """A batch of requests with differently padded texts: each (text, number of hits) is retrieved once and handed to all that asked."""
    asked = t.events.select("event_id", (F.col("event_id") % 20).alias("query_id"), (3 + F.col("user_id") % 2).alias("k")).join(t.v_queries, "query_id")
    padded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "query", F.lit("\n"))).otherwise(F.col("query"))
    asked = asked.select("event_id", X.strip(padded).alias("text"), "k")

    def compute(wanted):
        texts = written(wanted.select("text").distinct().withColumn("query_id", F.xxhash64("text")), "batch-texts")
        found = R.top_k(R.bm25_search(texts.select("query_id", F.col("text").alias("query")), *_index(t)).drop("rank"), 4, ["query_id"])
        rows = wanted.join(texts, "text").join(found, "query_id").filter(F.col("rank") <= F.col("k")).groupBy("text", "k")
        return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), "|").alias("hits"))

    return R.fan_out(asked, ["text", "k"], compute).select("event_id", "hits")


@query("kb_search_projection", f"WITH {_BM25} SELECT query_id, chunk_id, kb_id, doc_id, document_name, page_number, round(score, 6) AS score, total FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM bm WHERE rank <= 3) JOIN v_chunks USING (kb_id, chunk_id)")
def kb_search_projection(t):
    from pyspark.sql.window import Window

    rows = _bm25(t).filter("rank <= 3").withColumn("total", F.count("*").over(Window.partitionBy("query_id")))
    return _six(rows.join(t.v_chunks, ["kb_id", "chunk_id"])).select("query_id", "chunk_id", "kb_id", "doc_id", "document_name", F.col("page_number").cast("bigint").alias("page_number"), "score", "total")


@query("short_term_memory", "SELECT conv_id, id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM v_messages WHERE trim(content) <> '') WHERE k <= 3")
def short_term_memory(t):
    return R.last_messages(t.v_messages.filter(X.strip(F.col("content")) != ""), 3).select("conv_id", "id", "role")


@query("chat_history", "SELECT conv_id, id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM v_messages) WHERE k <= 4 AND role IN ('user', 'assistant')")
def chat_history(t):
    return R.last_messages(t.v_messages, 4).filter(F.col("role").isin("user", "assistant")).select("conv_id", "id", "role")


@query("long_term_memory_trim", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 50")
def long_term_memory_trim(t):
    rows = t.events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("id"))
    return R.last_messages(rows, 50).select(F.col("conv_id").alias("user_id"), F.col("id").alias("event_id"))


_MEMORY = rf"""mq AS (SELECT query_id, query_id % 20 AS user_id, CASE WHEN query_id % 4 = 0 THEN ' ' ELSE query END AS query FROM v_queries),
    me AS (SELECT doc_id % 20 AS user_id, doc_id AS id, text FROM documents), mv AS ({_EMBED("me", "id", "text")}), mw AS ({_EMBED("mq", "query_id", "query")}),
    ho AS (SELECT *, CASE WHEN query_id % 4 = 0 THEN 'newest' WHEN query_id % 4 = 3 OR user_id = 5 THEN 'overlap' ELSE 'cosine' END AS how FROM mq),
    sc AS (SELECT query_id, id, how, CASE how WHEN 'newest' THEN CAST(id AS DOUBLE)
        WHEN 'cosine' THEN coalesce(list_dot_product(CAST(mw.embedding AS DOUBLE[]), CAST(mv.embedding AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(mw.embedding AS DOUBLE[]), CAST(mw.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(mv.embedding AS DOUBLE[]), CAST(mv.embedding AS DOUBLE[]))), 0), 0)
        ELSE len(list_intersect(list_distinct(list_filter(regexp_extract_all(query, '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1)), list_distinct(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1)))) END AS score
        FROM ho JOIN me USING (user_id) LEFT JOIN mv USING (id) LEFT JOIN mw USING (query_id))"""


@query("long_term_memory_rank", f"WITH {_MEMORY} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, how FROM sc QUALIFY rank <= 3")
def long_term_memory_rank(t):
    """Documents as their users' memories; a quarter of the queries is empty, a quarter has no vector, and one of user 5's memories has none."""
    memories = t.documents.select((F.col("doc_id") % 20).alias("user_id"), F.col("doc_id").alias("id"), "text")
    memories = I.hashing_embed(memories, ["user_id", "id", "text"], "text").withColumn("vector", F.when(F.col("id") != 5, F.col("embedding"))).drop("embedding")
    query = F.when(F.col("query_id") % 4 == 0, " ").otherwise(F.col("query"))
    queries = t.v_queries.select("query_id", (F.col("query_id") % 20).alias("user_id"), query.alias("query"))
    queries = I.hashing_embed(queries, ["query_id", "user_id", "query"], "query").withColumn("qv", F.when(F.col("query_id") % 4 != 3, F.col("embedding"))).drop("embedding")
    return R.rank_memories(written(memories, "memories"), queries)


@query("scan_kb", "SELECT kb_id, count(*) AS n FROM v_chunks WHERE kb_id IN (1, 3, 99) GROUP BY kb_id")
def scan_kb(t):
    wanted = t.spark.createDataFrame([(1,), (3,), (99,), (None,)], "kb_id bigint").dropna()
    return t.v_chunks.join(F.broadcast(wanted), "kb_id", "left_semi").groupBy("kb_id").agg(F.count("*").alias("n"))


@query("upsert_chunks", "SELECT doc_id, name FROM v_documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'new ' || name FROM v_documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 10000000, name FROM v_documents WHERE doc_id % 3 = 0")
def upsert_chunks(t):
    rows = t.v_documents.select("doc_id", "name")
    third = rows.filter("doc_id % 3 = 0")
    new = third.select("doc_id", F.concat(F.lit("new "), "name").alias("name")).unionByName(third.withColumn("doc_id", F.col("doc_id") + 10_000_000))
    return I.upsert(rows, new, ["doc_id"])


#: Documents as they are after three changes of the index: a third written again with another text, a seventh gone.
_CHANGED = """v2 AS (SELECT kb_id, doc_id, chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'changed ' || text ELSE text END AS text FROM v_chunks WHERE doc_id % 7 <> 0)"""


def _stored(t):
    """A stored index that was written, then changed twice."""
    from lectern.sources.scratch import shared_dir

    rows = t.v_chunks.select("kb_id", "doc_id", "chunk_id", "text")
    index = I.write_index(rows.filter("doc_id % 2 = 0"), f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}")
    none = rows.select("kb_id", "doc_id").limit(0)
    index.change(rows.filter("doc_id % 2 = 1"), none, 1)
    third = rows.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("changed "), "text"))
    index.change(third, rows.filter("doc_id % 7 = 0").select("kb_id", "doc_id"), 2)
    index.change(rows.limit(0), rows.filter("doc_id % 7 = 0").select("kb_id", "doc_id").distinct(), 3)
    return index


@query("stored_index", f"WITH {_CHANGED}, {_BM25.replace('v_chunks', 'v2')} SELECT kb_id, chunk_id, term, tf, CAST(dl AS BIGINT) AS dl, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM tf JOIN dl USING (kb_id, chunk_id) JOIN idf USING (kb_id, term) WHERE kb_id IN (1, 3)")
def stored_index(t):
    """Two knowledge bases of an index on disk that has been written, upserted and deleted from: as if built anew."""
    loaded = I.load_index(t.spark, _stored(t).path, [1, 3])
    return loaded.withColumns({"idf": F.round("idf", 6), "avgdl": F.round("avgdl", 6)})


@query("delete_document_chunks", "SELECT kb_id, chunk_id FROM v_chunks WHERE doc_id % 5 <> 0")
def delete_document_chunks(t):
    gone = t.v_documents.filter("doc_id % 5 = 0").select("kb_id", "doc_id")
    return I.delete_documents(t.v_chunks, gone).select("kb_id", "chunk_id")


@query("reindex_document", "SELECT kb_id, doc_id, chunk_id FROM v_chunks WHERE doc_id % 5 <> 0 UNION ALL SELECT kb_id, doc_id, chunk_id || 'b' FROM v_chunks WHERE doc_id % 5 = 0 AND chunk_index = 0")
def reindex_document(t):
    rows = t.v_chunks.select("kb_id", "doc_id", "chunk_id", "chunk_index")
    new = rows.filter("doc_id % 5 = 0 and chunk_index = 0").withColumn("chunk_id", F.concat("chunk_id", F.lit("b")))
    return I.reindex_documents(rows, new).select("kb_id", "doc_id", "chunk_id")


@query("index_counts", "SELECT kb_id, count(*) AS chunks FROM v_chunks GROUP BY kb_id")
def index_counts(t):
    return t.v_chunks.groupBy("kb_id").agg(F.count("*").alias("chunks"))


def _images(t):
    v = t.v_vectors.filter("modality = 'image'")
    vector = F.when(F.col("chunk_id") % 8 == 0, F.col("embedding"))
    return v.select("kb_id", F.col("chunk_id").alias("doc_id"), F.concat(F.lit("doc "), "chunk_id").alias("document_name"), (F.col("chunk_id") % 9).cast("int").alias("page_number"),
                    F.lit(0).alias("image_index"), vector.alias("embedding"))


@query("index_image_vectors", """SELECT kb_id, 'img_' || chunk_id || ':' || chunk_id % 9 || ':0' AS id, '[图片] doc ' || chunk_id || ' 第' || chunk_id % 9 || '页' AS note FROM v_vectors WHERE chunk_id % 8 = 0
    UNION ALL SELECT kb_id, NULL, 'image 0 on page ' || chunk_id % 9 || ' has no vector' FROM v_vectors WHERE chunk_id % 8 = 4""")
def index_image_vectors(t):
    good, bad = I.index_images(_images(t))
    return good.select("kb_id", F.col("chunk_id").alias("id"), F.col("content").alias("note")).unionByName(bad.select("kb_id", F.lit(None).cast("string").alias("id"), F.col("warning").alias("note")))


@query("clear_image_vectors", "SELECT kb_id, chunk_id AS doc_id FROM v_vectors WHERE chunk_id % 8 = 0 AND chunk_id % 3 <> 0")
def clear_image_vectors(t):
    good, _ = I.index_images(_images(t))
    return I.delete_documents(good, good.filter("doc_id % 3 = 0").select("kb_id", "doc_id")).select("kb_id", "doc_id")


@query("dedup_by_hash", "SELECT kb_id, doc_id, first_id, doc_id = first_id AS accepted FROM (SELECT kb_id, doc_id, min(doc_id) OVER (PARTITION BY kb_id, file_hash) AS first_id FROM v_documents WHERE NOT is_deleted)")
def dedup_by_hash(t):
    return I.dedup_by_hash(t.v_documents).select("kb_id", "doc_id", "first_id", (F.col("doc_id") == F.col("first_id")).alias("accepted"))


@query("latest_versions", "SELECT document_id, max(version) AS version FROM v_versions GROUP BY document_id")
def latest_versions(t):
    return I.latest(t.v_versions, ["document_id"], F.desc("version"))


@query("list_versions", "SELECT document_id, version, row_number() OVER (PARTITION BY document_id ORDER BY version DESC) AS place FROM v_versions")
def list_versions(t):
    from pyspark.sql.window import Window

    return t.v_versions.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version"))).cast("bigint"))


@query("get_version", "SELECT document_id, version FROM v_versions WHERE version = 2")
def get_version(t):
    return t.v_versions.filter("version = 2")


@query("processing_warning_summary", """SELECT doc_id, count(*) AS total, array_to_string(list(error ORDER BY event_id)[1:5], '; ') AS first FROM v_status_events WHERE error IS NOT NULL GROUP BY doc_id""")
def processing_warning_summary(t):
    """The first five errors of a document are cut out below the exchange; only those are put together."""
    errors = t.v_status_events.filter("error is not null").select("doc_id", "event_id", "error")
    five = R.first_rows(errors, ["doc_id"], ["event_id"], 5).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "error"))).alias("e"))
    total = errors.groupBy("doc_id").agg(F.count("*").alias("total"))
    return total.join(five, "doc_id").select("doc_id", "total", F.array_join(F.transform("e", lambda x: x["error"]), "; ").alias("first"))


@query("classify_files", """SELECT doc_id, CASE WHEN kind IS NULL THEN 'unsupported type' WHEN z > 104857600 THEN 'too large' WHEN z = 0 THEN 'empty' END AS reason, kind FROM (SELECT doc_id, char_count * 100000 AS z,
    CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'txt' WHEN 2 THEN 'pdf' END AS kind FROM v_documents)""")
def classify_files(t):
    from lectern.sources.files import classify

    return classify(t.v_documents.withColumn("size", F.col("char_count") * 100_000), F.col("name"), F.col("size")).select("doc_id", "reason", "kind")


@query("read_text_documents", """SELECT 'doc_' || doc_id AS title, CASE doc_id % 4 WHEN 1 THEN 'txt' ELSE 'markdown' END AS format, md5('课程 ' || doc_id || chr(10) || text) AS digest FROM documents WHERE doc_id % 4 <> 3""")
def read_text_documents(t):
    """Documents as files, the English ones in GBK, the others in UTF-8, and a quarter of a kind that is passed over; read back."""
    from lectern.sources.files import read_text_documents as read
    from lectern.sources.files import write_text_documents as write
    from lectern.sources.scratch import shared_dir

    path = f"{shared_dir(t.spark)}/files-{uuid.uuid4().hex}"
    ending = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".markdown", ".pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("课程 "), "doc_id", F.lit("\n"), "text")
    encoding = F.when((F.col("lang") == "en") & ~F.col("text").rlike(r"[^\x00-\x7F]"), "gbk").otherwise("utf-8")
    docs = t.documents.select(F.concat(F.lit("doc_"), "doc_id", ending).alias("name"), text.alias("text"), encoding.alias("encoding"))
    written(write(docs, path), "written-files")
    return read(t.spark, path).select("title", "format", F.md5("text").alias("digest"))


@query("file_fingerprint", "SELECT doc_id, sha256(text) AS hash FROM documents")
def file_fingerprint(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


def _noisy_pages(t):
    page = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 400).cast("int"))).alias("p")
    rows = t.documents.filter(F.length("text") > 0).select("doc_id", "text", page)
    body = F.expr("substring(text, p * 400 + 1, 400)")
    whole = F.concat(F.lit("***\n第 3 页\nCourse notes\nPage 3 of 9\n- 12 -\n"), F.regexp_replace(body, "\n", " "), F.lit("\nPage "), (F.col("p") + 1).cast("string"))
    return rows.select("doc_id", (F.col("p") + 1).cast("bigint").alias("page_number"), whole.alias("text"))


#: The two first lines are noise where they repeat, those after them only look like it.
_PAGES = """pg AS (SELECT doc_id, p + 1 AS page_number, max(p + 1) OVER (PARTITION BY doc_id) AS pages, '***' || chr(10) || '第 3 页' || chr(10) AS noise,
    'Course notes' || chr(10) || 'Page 3 of 9' || chr(10) || '- 12 -' || chr(10) || replace(substr(text, p * 400 + 1, 400), chr(10), ' ') || chr(10) || 'Page ' || (p + 1) AS body
    FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 400 + 1)) AS p FROM documents WHERE length(text) > 0))"""


#: The rule in full: furniture is a page number or at most three characters without Chinese, on 60 % of a document's pages and two at least.
_NOISE = r"""ln AS (SELECT doc_id, page_number, pages, i, l[i] AS line, regexp_replace(l[i], '^[\t\n\x0B\f\r\x{85}\p{Z}]+|[\t\n\x0B\f\r\x{85}\p{Z}]+$', '', 'g') AS bare FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, page_number, pages, string_split(noise || body, chr(10)) AS l FROM pg))),
    fu AS (SELECT doc_id, bare FROM ln WHERE bare <> '' AND (regexp_full_match(bare, '(?i)(\p{Nd}{1,4}|第[\t\n\x0B\f\r\x{85}\p{Z}]*\p{Nd}+[\t\n\x0B\f\r\x{85}\p{Z}]*页|page[\t\n\x0B\f\r\x{85}\p{Z}]*\p{Nd}+|\p{Nd}+[\t\n\x0B\f\r\x{85}\p{Z}]*/[\t\n\x0B\f\r\x{85}\p{Z}]*\p{Nd}+)')
    OR (length(bare) <= 3 AND NOT regexp_matches(bare, '[一-鿿]'))) GROUP BY doc_id, bare HAVING max(pages) > 2 AND count(DISTINCT page_number) >= greatest(2, floor(max(pages) * 0.6))),
    kp AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY i) AS kept FROM ln ANTI JOIN fu USING (doc_id, bare) GROUP BY doc_id, page_number)"""


@query("filter_page_noise", f"WITH {_PAGES}, {_NOISE} SELECT doc_id, page_number, coalesce(kept, '') AS text FROM pg LEFT JOIN kp USING (doc_id, page_number)")
def filter_page_noise(t):
    return S.filter_page_noise(_noisy_pages(t))


@query("document_stats", f"WITH {_PAGES} SELECT doc_id, count(*) AS page_count, md5(string_agg(noise || body, chr(10) || chr(10) ORDER BY page_number)) AS digest, CAST(sum(length(noise || body)) + 2 * (count(*) - 1) AS BIGINT) AS char_count FROM pg GROUP BY doc_id")
def document_stats(t):
    return S.document_stats(_noisy_pages(t)).select("doc_id", "page_count", F.md5("full_text").alias("digest"), "char_count")


_FIXED = "fx AS (SELECT doc_id, i AS chunk_index, substr(text, CAST(i * 462 + 1 AS INT), 512) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 462.0) AS INT), 1))) AS i FROM documents))"


@query("chunk_fixed", f"WITH {_FIXED} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, text FROM fx")
def chunk_fixed(t):
    return t.documents.select("doc_id", F.explode(S.chunk_fixed(F.col("text"))).alias("c")).select("doc_id", "c.chunk_index", "c.text")


@query("split_sentences", r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(s)) AS BIGINT) AS length FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^。！？!?；;\n]*[。！？!?；;\n]|[^。！？!?；;\n]+$')), ' ' || chr(10)) AS s FROM documents) WHERE s <> '' GROUP BY doc_id""")
def split_sentences(t):
    s = S.split_sentences(F.col("text"))
    rows = t.documents.select("doc_id", F.explode(s).alias("s")).groupBy("doc_id")
    return rows.agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("length"))


@query("chunk_metadata", """SELECT chunk_id, '{"knowledge_base_id":"' || kb_id || '","document_id":"' || doc_id || '","page_number":"' || page_number || '","document_name":"' || document_name || '","lang":"x"}' AS metadata FROM v_chunks""")
def chunk_metadata(t):
    extra = F.create_map(F.lit("lang"), F.lit("x"), F.lit("page_number"), F.lit("never"))
    return S.chunk_metadata(t.v_chunks, extra).select("chunk_id", F.to_json("metadata").alias("metadata"))


@query("chunk_strategy_stats", f"""WITH {_FIXED}, st AS (SELECT 'fixed' AS strategy, doc_id, text FROM fx UNION ALL SELECT 'lines', doc_id, unnest(string_split(text, chr(10))) FROM documents)
    SELECT strategy, count(DISTINCT doc_id) AS documents, count(*) AS chunks, round(count(*) / count(DISTINCT doc_id), 6) AS per_document, round(avg(length(text)), 6) AS mean_length FROM st GROUP BY strategy""")
def chunk_strategy_stats(t):
    fixed = t.documents.select(F.lit("fixed").alias("strategy"), "doc_id", F.explode(S.chunk_fixed(F.col("text"))).alias("c")).select("strategy", "doc_id", "c.text")
    lines = t.documents.select(F.lit("lines").alias("strategy"), "doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    return S.chunk_strategy_stats(fixed.unionByName(lines))


def _pages(t):
    return t.documents.select("doc_id", F.posexplode(S.split_pages(F.col("text"))).alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)


#: Pages by a fold over lines, written from the rule: a page ends when its lines, without their ends, have 1500 characters.
_PAGED = """fo AS (SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN NULL ELSE list_reduce(list_transform(string_split(text, chr(10)), lambda l: {'p': CAST([] AS VARCHAR[]), 'o': [l], 'n': length(l)}),
    lambda a, b: CASE WHEN a.n >= 1500 THEN {'p': list_append(a.p, array_to_string(a.o, chr(10))), 'o': b.o, 'n': b.n} ELSE {'p': a.p, 'o': list_concat(a.o, b.o), 'n': a.n + b.n} END) END AS f FROM documents),
    pp AS (SELECT doc_id, CASE WHEN f IS NULL THEN [''] ELSE list_append(f.p, array_to_string(f.o, chr(10))) END AS pages FROM fo)"""
#: Chunks by a fold over words, as every text ends up cut at blanks; the last 50 characters of a chunk open the next.
_RECURSIVE = f"""{_PAGED}, sg AS (SELECT doc_id, list_filter(flatten(list_transform(pages, lambda t, i: list_transform(string_split_regex(t, '\\n|。|！|？|；|\\. |，|,| '), lambda x: {{'t': trim(x, chr(9) || chr(13) || chr(11) || chr(12)), 'p': CAST(i AS INT)}}))), lambda s: s.t <> '') AS s FROM pp),
    fc AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: {{'c': CAST([] AS STRUCT(p INT, t VARCHAR)[]), 'b': x.t, 'n': length(x.t), 'p': x.p}}),
    lambda a, x: CASE WHEN a.n + x.n + 1 <= 512 THEN {{'c': a.c, 'b': a.b || chr(10) || x.b, 'n': a.n + x.n + 1, 'p': a.p}}
    ELSE {{'c': list_append(a.c, {{'p': a.p, 't': a.b}}), 'b': CASE WHEN length(a.b) <= 50 THEN a.b ELSE ltrim(right(a.b, 50), chr(10) || ' ') END || chr(10) || x.b,
    'n': length(CASE WHEN length(a.b) <= 50 THEN a.b ELSE ltrim(right(a.b, 50), chr(10) || ' ') END) + x.n + 1, 'p': x.p}} END) AS f FROM sg WHERE len(s) > 0)
    SELECT doc_id, CAST(k - 1 AS INT) AS chunk_index, c[k].p AS page_number, c[k].t AS text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS k FROM (SELECT doc_id, list_append(f.c, {{'p': f.p, 't': f.b}}) AS c FROM fc))"""


@query("split_pages", f"WITH {_PAGED} SELECT doc_id, CAST(k AS INT) AS page_number, pages[k] AS text FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS k FROM pp)")
def split_pages(t):
    return _pages(t)


@query("strip_markdown")
def strip_markdown(t):
    return t.documents.select("doc_id", X.strip_markdown(F.col("text")).alias("out"))


@query("chunk_recursive", f"WITH {_RECURSIVE}")
def chunk_recursive(t):
    return S.chunk_recursive(_pages(t))


@query("merge_small_chunks")
def merge_small_chunks(t):
    return S.merge_small_chunks(S.chunk_recursive(_pages(t), 120, 10), 50, 512)


def _sentences(t):
    return _pages(t).select("doc_id", "page_number", F.posexplode(S.split_sentences(F.col("text"))).alias("pos", "text"))


def _embedded_sentences(t):
    rows = _sentences(t)
    return I.hashing_embed(rows, ["doc_id", "page_number", "pos", "text"], "text").withColumnRenamed("embedding", "vector")


@query("embed_texts")
def embed_texts(t):
    return _embedded_sentences(t).select("doc_id", "page_number", "pos", "vector")


@query("chunk_semantic")
def chunk_semantic(t):
    return S.chunk_semantic(_sentences(t).withColumn("words", X.tokenize(F.col("text"))))
