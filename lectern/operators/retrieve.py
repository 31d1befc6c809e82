"""Hybrid retrieval over many queries at once, and what is made of its hits.

Scores are ranked on nine decimals and ties go to the smaller chunk id, so that the order in which a
sum was taken never decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import excerpt, no_answer_flag, strip, tokenize
from lectern.sources.scratch import small_enough, written

K1, B = 1.5, 0.75
REFUSAL = "知识库中未找到相关信息，无法回答该问题。"
#: Queries that meet the vectors in one pass (at 256 dimensions 8 MB of them).
QUERY_BLOCK = 4096
#: Chunks of a knowledge base that one group holds with their terms, about: few enough that small inputs have whole parts, too, so a worker's memory does not grow with the input.
PART_ROWS = 4096


def top_k(hits: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best of each group with their rank; the limit also applies below the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round(F.col(score), 9)), tie)
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def _parts(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, parts): how many parts of about ``size`` rows each group is dealt into."""
    return written(rows.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("parts")), "parts")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _bm25_scores(k: int):
    """A part of a knowledge base's chunks with its weights, and a block of query terms, to the part's best ``k`` chunks of each query."""

    def run(chunks: pa.Table, terms: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if chunks.num_rows and terms.num_rows:
            # A word of the block with the queries that ask for it, as often as they do.
            coded = terms["term"].combine_chunks().dictionary_encode()
            words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            queries, of = np.unique(terms["query_id"].to_numpy(), return_inverse=True)
            asked = np.zeros((len(words) + 1, len(queries)))
            asked[at, of] = terms["q"].to_numpy()
            idf = np.zeros(len(words) + 1)
            idf[at] = terms["idf"].to_numpy()
            # Only a slice of the chunks is copied at a time, in the order of their ids.
            order = pa.compute.sort_indices(chunks["chunk_id"])
            for start in range(0, chunks.num_rows, 1_024):
                part = chunks.take(order.slice(start, 1_024))
                lists = part["terms"].combine_chunks()
                sizes, tf = lists.value_lengths().to_numpy(), part["tfs"].combine_chunks().flatten().to_numpy().astype(float)
                seen = lists.flatten().dictionary_encode()
                known = pa.compute.index_in(seen.dictionary, words).fill_null(len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
                term = known[seen.indices.to_numpy()]
                dl = np.repeat(part["dl"].to_numpy().astype(float), sizes)
                share = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / terms["avgdl"][0].as_py()))
                ends = np.cumsum(sizes)
                used = np.flatnonzero(term < len(words))
                scores = np.zeros((part.num_rows, len(queries)))
                row = np.searchsorted(ends, used, "right")
                for i, (first, last) in enumerate(zip(np.searchsorted(row, np.arange(part.num_rows)), np.searchsorted(row, np.arange(part.num_rows), "right"), strict=True)):
                    if last > first:
                        scores[i] = share[used[first:last]] @ asked[term[used[first:last]]]
                names = part["chunk_id"].to_numpy(zero_copy_only=False)
                for j in range(len(queries)):
                    rounded = np.round(scores[:, j], 9)
                    best = np.flatnonzero(scores[:, j] > 0)
                    best = best[np.argsort(-rounded[best], kind="stable")][:k]  # ties stay in the order of chunk ids
                    out.append((np.full(len(best), queries[j]), names[best], scores[best, j]))
        kb = chunks["kb_id"][0].as_py() if chunks.num_rows else 0
        n = sum(len(q) for q, _, _ in out)
        whole = [np.concatenate([x[i] for x in out]) if n else [] for i in range(3)]
        return pa.table({
            "query_id": pa.array(whole[0], pa.int64()), "kb_id": pa.array([kb] * n, pa.int64()), "chunk_id": pa.array(whole[1], pa.string()), "score": pa.array(whole[2], pa.float64()),
        })

    return run


def bm25_search(queries: DataFrame, bag: DataFrame, weights: DataFrame, k: int = 20, part_rows: int = PART_ROWS, block: int = 1_024) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, rank): the best positive scores of each query in each knowledge base.

    ``bag`` (kb_id, chunk_id, dl, terms, tfs) and ``weights`` (kb_id, term, idf, avgdl) are an index. A knowledge base is dealt into
    parts of about ``part_rows`` chunks, and queries come in blocks of about ``block``; a block's terms meet each part once with their
    weights in that knowledge base. So no posting is shuffled by its term, however frequent that is, and only each
    part's best ``k`` chunks go on. Repeated query terms count each time.
    """
    terms = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("q"))
    blocks = F.lit(max(1, -(-queries.count() // block)))
    terms = written(terms.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")), "query-terms")
    wanted = written(terms.select("term").distinct(), "query-words")
    parts = _parts(bag, ["kb_id"], part_rows)
    by = ["kb_id", "part", "block"]
    asked = weights.join(small_enough(wanted), "term", "left_semi").join(small_enough(terms), "term").join(small_enough(parts), "kb_id")
    asked = written(asked.select("kb_id", _numbers(F.col("parts")).alias("part"), "block", "query_id", "term", "q", "idf", "avgdl"), "asked-terms")
    dealt = bag.join(small_enough(parts), "kb_id").withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int"))
    dealt = dealt.select("kb_id", "part", _numbers(blocks).alias("block"), "chunk_id", "dl", "terms", "tfs")
    found = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_bm25_scores(k), "query_id bigint, kb_id bigint, chunk_id string, score double")
    return top_k(found, k, ["query_id", "kb_id"])


def _cosine_scores(k: int):
    """A part of the vectors and a block of queries to the best ``k`` of each knowledge base for every query, by matrix products of 256 queries."""

    def unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
        v = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by([("kb_id", "ascending"), ("chunk_id", "ascending")])
            kbs, vectors, matrix = rows["kb_id"].to_numpy(), unit(rows["embedding"], rows.num_rows), unit(queries["qv"], queries.num_rows)
            edges = np.flatnonzero(np.append(True, kbs[1:] != kbs[:-1])).tolist() + [len(kbs)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                # A few queries at a time, so that scores, their rounding and their order stay small however many queries a block has.
                for begin in range(0, len(matrix), 256):
                    score = matrix[begin : begin + 256] @ vectors[first:last].T
                    best = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]  # ties stay in the order of chunk ids
                    at = pa.array((best + first).ravel())
                    out.append(pa.table({
                        "query_id": queries["query_id"].take(pa.array(begin + np.repeat(np.arange(len(score)), best.shape[1]))), "kb_id": rows["kb_id"].take(at),
                        "chunk_id": rows["chunk_id"].take(at), "score": pa.array(np.take_along_axis(score, best, 1).ravel()),
                    }))
        if out:
            return pa.concat_tables(out)
        return pa.table({"query_id": queries["query_id"].slice(0, 0), "kb_id": rows["kb_id"].slice(0, 0), "chunk_id": rows["chunk_id"].slice(0, 0), "score": pa.array([], pa.float64())})

    return run


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 20, where: Column | None = None, part_rows: int = 16_384, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine neighbours of (query_id, qv) among (kb_id, chunk_id, embedding), best of each knowledge base.

    Vectors are dealt into parts of about ``part_rows`` rows and queries into blocks of at most about ``block``; each block meets each
    part once, as a matrix product, and only the best of each part go on to the final ranking. Nothing passes through
    the driver. Vectors and queries of different lengths never meet, and null ones take no part.
    """
    rows = (vectors if where is None else vectors.filter(where)).select("kb_id", "chunk_id", "embedding", F.size("embedding").alias("dim"))
    queries = queries.select("query_id", "qv", F.size("qv").alias("dim"))
    rows, queries = written(rows.filter("dim > 0"), "vectors"), written(queries.filter("dim > 0"), "query-vectors")
    sizes = lambda df, n, name: df.groupBy("dim").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    both = written(sizes(rows, part_rows, "parts").join(sizes(queries, block, "blocks"), "dim"), "vector-parts")
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query_id"), (rows, "kb_id"), (rows, "chunk_id")))
    by = ["dim", "part", "block"]
    dealt = rows.join(small_enough(both), "dim").withColumns({"part": F.pmod(F.xxhash64("chunk_id"), "parts").cast("int"), "block": _numbers(F.col("blocks"))})
    asked = queries.join(small_enough(both), "dim").withColumns({"block": F.pmod(F.xxhash64("query_id"), "blocks").cast("int"), "part": _numbers(F.col("parts"))})
    dealt, asked = dealt.drop("parts", "blocks").groupBy(*by), asked.drop("parts", "blocks").groupBy(*by)
    return top_k(dealt.cogroup(asked).applyInArrow(_cosine_scores(k), f"{kind}, score double"), k, ["query_id", "kb_id"])


def minmax_normalize(hits: DataFrame, by: list[str] = ("query_id",)) -> DataFrame:
    """Adds norm in 0..1 over each group's hits; 1 where all scores are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def hybrid_fuse(bm25: DataFrame, vector: DataFrame, keyword_weight: float = 0.3, vector_weight: float = 0.7) -> DataFrame:
    """(query_id, kb_id, chunk_id, score): weighted sum of normalised scores, a hit of one channel keeps its share."""
    keys = ["query_id", "kb_id", "chunk_id"]
    b = minmax_normalize(bm25).select(*keys, F.col("norm").alias("b"))
    v = minmax_normalize(vector).select(*keys, F.col("norm").alias("v"))
    score = vector_weight * F.coalesce("v", F.lit(0.0)) + keyword_weight * F.coalesce("b", F.lit(0.0))
    return b.join(v, keys, "full_outer").select(*keys, score.alias("score"))


def rerank_overlap(candidates: DataFrame, k: int) -> DataFrame:
    """Rescores (query_id, query, chunk_id, text, ...) by Jaccard overlap of stop-worded token sets; a query without tokens has no rows."""
    q, d = F.array_distinct(tokenize(F.col("query"), stopwords=True)), F.array_distinct(tokenize(F.col("text"), stopwords=True))
    rows = candidates.withColumns({"_q": q, "_d": d}).filter(F.size("_q") > 0)
    score = F.size(F.array_intersect("_q", "_d")) / F.size(F.array_union("_q", "_d"))
    return top_k(rows.withColumn("score", score).drop("_q", "_d"), k, ["query_id"])


def hybrid_retrieve(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, index: tuple[DataFrame, DataFrame], vectors: DataFrame, k: int = 5,
                    channel_k: int = 20, candidates: int = 20) -> DataFrame:
    """Keyword and vector hits, fused, cut to candidates, reranked: (query_id, rank, kb_id, chunk_id, score)."""
    fused = hybrid_fuse(bm25_search(queries, *index, channel_k), vector_search(query_vectors, vectors, channel_k))
    best = top_k(fused, candidates, ["query_id"]).select("query_id", "kb_id", "chunk_id")
    # Texts are joined only to the candidates that are left.
    texts = best.join(chunks.select("kb_id", "chunk_id", "text"), ["kb_id", "chunk_id"]).join(queries.select("query_id", "query"), "query_id")
    return rerank_overlap(texts, k).select("query_id", "rank", "kb_id", "chunk_id", "score")


def multi_query_merge(hits: DataFrame, k: int) -> DataFrame:
    """Over the variants of a query: best score of each chunk, then the top ``k``."""
    return top_k(hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k, ["query_id"])


def append_sections(text: DataFrame, images: DataFrame) -> DataFrame:
    """Text hits, then image hits, each in its own order: adds section and position."""
    both = text.withColumn("section", F.lit(0).cast("bigint")).unionByName(images.withColumn("section", F.lit(1).cast("bigint")))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("section", "rank")).cast("bigint"))


def first_occurrences(hits: DataFrame, request: str, order: list[str]) -> DataFrame:
    """The first row of each (request, chunk) in ``order``."""
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy(request, "chunk_id").orderBy(*order))).filter("_k = 1").drop("_k")


def first_rows(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def fan_out(requests: DataFrame, key: list[str], compute) -> DataFrame:
    """Each distinct ``key`` of the requests computed once by ``compute`` (a table by key) and handed to all that asked."""
    wanted = written(requests.select(*key).distinct(), "distinct-requests")
    return requests.join(compute(wanted), key, "left")


def rank_memories(memories: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, id, rank, how) of the ``k`` memories of the query's user, by one of three rankings.

    An empty query takes the newest. Otherwise cosine of ``qv`` with the memories' ``vector`` decides, if the query and all the
    user's memories have one, else the number of shared tokens; there, equally good ones come oldest first, and
    memories that share nothing fill up. ``memories``: user_id, id (in the order of saving), text, vector; ``queries``: query_id,
    user_id, query, qv.
    """
    whole = memories.groupBy("user_id").agg(F.every(F.col("vector").isNotNull()).alias("whole"))
    blank = strip(F.coalesce("query", F.lit(""))) == ""
    asked = queries.join(whole, "user_id").withColumn("how", F.when(blank, "newest").when(F.col("whole") & F.col("qv").isNotNull(), "cosine").otherwise("overlap"))
    asked = written(asked, "memory-queries")
    of = lambda how: asked.filter(F.col("how") == how)

    ends = lambda order: first_rows(memories.select("user_id", "id"), ["user_id"], [order], k)
    newest = of("newest").select("query_id", "user_id").join(ends(F.desc("id")), "user_id").select("query_id", "id", F.col("id").cast("double").alias("score"), F.lit("newest").alias("how"))

    parts, by = _parts(memories, ["user_id"], 16_384), ["kb_id", "part"]
    part = F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")
    dealt = memories.join(small_enough(parts), "user_id").select(F.col("user_id").alias("kb_id"), part, F.col("id").alias("chunk_id"), F.col("vector").alias("embedding"))
    probes = of("cosine").join(small_enough(parts), "user_id").select(F.col("user_id").alias("kb_id"), _numbers(F.col("parts")).alias("part"), "query_id", "qv")
    probes = written(probes, "memory-probes")
    near = dealt.filter("embedding is not null").groupBy(*by).cogroup(probes.groupBy(*by)).applyInArrow(_cosine_scores(k), "query_id bigint, kb_id bigint, chunk_id bigint, score double")
    near = near.select("query_id", F.col("chunk_id").alias("id"), "score", F.lit("cosine").alias("how"))

    tokens = lambda rows, key, text: rows.select("user_id", key, F.explode(F.array_distinct(tokenize(F.col(text), stopwords=True, lower=False))).alias("term"))
    shared = tokens(memories, "id", "text").join(tokens(of("overlap"), "query_id", "query"), ["user_id", "term"]).groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))
    oldest = of("overlap").select("query_id", "user_id").join(ends(F.asc("id")), "user_id").select("query_id", "id", F.lit(0.0).alias("score"))
    alike = shared.unionByName(oldest).groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("how", F.lit("overlap"))

    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    found = newest.unionByName(near).unionByName(alike).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return found.filter(F.col("rank") <= k).select("query_id", "id", "rank", "how")


def build_citations(hits: DataFrame) -> DataFrame:
    """Distinct chunks of each query in rank order, numbered from 1, with an excerpt."""
    first = first_occurrences(hits, "query_id", ["rank"])
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint")
    return first.withColumns({"index": number, "excerpt": excerpt(F.col("text"))})


def build_context(cited: DataFrame, label: Column) -> DataFrame:
    """One numbered context text for each query."""
    block = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] ("), label, F.lit(")\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("index", block.alias("block"))))
    return cited.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def annotate_answer(answers: DataFrame, cited: DataFrame, label: Column) -> DataFrame:
    """Answers with their reference list; unchanged without citations."""
    dash = F.when(F.col("excerpt") != "", F.concat(F.lit(" — "), F.col("excerpt"))).otherwise("")
    line = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), label, dash)
    refs = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("refs"))
    listed = F.concat(F.lit("\n\n**参考来源：**\n"), F.array_join(F.transform("refs", lambda x: x["line"]), "\n"))
    return answers.join(refs, "query_id", "left").withColumn("answer", F.concat("answer", F.coalesce(listed, F.lit("")))).drop("refs")


def groundedness(answers: DataFrame, threshold: float = 0.3, top: int = 15) -> DataFrame:
    """Adds has_context, no_answer, confidence, grounded to (query_id, answer, contexts array).

    In this order: no context and no answer is grounded, no context and an answer is not, context
    and no answer is grounded; otherwise the share of the answer's top keywords, in their own case,
    that the joined contexts contain decides.
    """
    contexts = F.filter(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: c.isNotNull() & (strip(c) != ""))
    rows = answers.withColumns({"_ctx": F.array_join(contexts, " "), "has_context": F.size(contexts) > 0, "no_answer": no_answer_flag(F.coalesce("answer", F.lit("")))})
    words = rows.filter("has_context and not no_answer").select("query_id", F.posexplode(tokenize(F.col("answer"), stopwords=True, lower=False)).alias("pos", "term"))
    words = words.groupBy("query_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    words = words.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "pos"))).filter(F.col("k") <= top)
    # The few keywords go to the context, not the context to every word.
    rows = rows.join(words.groupBy("query_id").agg(F.collect_list("term").alias("_top")), "query_id", "left")
    share = F.size(F.filter("_top", lambda x: F.contains(F.col("_ctx"), x))) / F.size("_top")
    rows = rows.withColumn("share", F.when(F.col("_top").isNotNull(), share))
    confidence = F.when(F.col("no_answer"), 1.0).when(~F.col("has_context"), 0.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.withColumn("confidence", confidence).withColumn("grounded", F.col("no_answer") | (F.col("has_context") & (F.col("confidence") >= threshold))).drop("_ctx", "_top", "share")


def should_suppress(has_context: Column, no_answer: Column, grounded: Column) -> Column:
    return F.when(no_answer, False).when(~has_context, True).otherwise(~grounded)


def answer_assembly(queries: DataFrame, answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Final answers: the refusal where nothing was retrieved, else the model's answer with its check."""
    rows = queries.select("query_id").join(contexts, "query_id", "left").join(answers, "query_id", "left")
    checked = groundedness(rows.withColumn("answer", F.coalesce("answer", F.lit(""))))
    none = ~F.col("has_context")
    return checked.select(
        "query_id", F.when(none, REFUSAL).otherwise(F.col("answer")).alias("answer"), (~none & F.col("grounded")).alias("grounded"),
        (none | F.col("no_answer")).alias("no_answer"), F.when(none, 0.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation by id."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("id"))
    return messages.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")
