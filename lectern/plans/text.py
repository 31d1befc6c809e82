"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.plans.registry import query

_S = r"[\s\x{3000}\x{00A0}]"


def _scalar(name, make, sql, source="documents", key="doc_id"):
    """A query (key, out) over a whole table."""

    @query(name, f"SELECT {key}, {sql} AS out FROM {source}")
    def run(t):
        return getattr(t, source).select(key, make().alias("out"))


_scalar("clean_text", lambda: X.clean_text(F.col("text")),
        r"""trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
        '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))""")
_scalar("remove_extra_whitespace", lambda: X.remove_extra_whitespace(F.col("text")), rf"trim(regexp_replace(text, '{_S}+', ' ', 'g'))")
_scalar("normalize_cjk_punctuation", lambda: X.normalize_cjk_punctuation(F.concat("text", F.lit("，《完》。"))),
        r'''translate(text || '，《完》。', '，。！？：；“”‘’（）【】《》', ',.!?:;""' || chr(39) || chr(39) || '()[]<>')''')
_scalar("normalize_chunk_text", lambda: X.normalize_chunk_text(F.col("text")),
        r"""trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
        chr(10)), lambda x: trim(x)), chr(10)), ' ' || chr(10))""")
_scalar("strip_markdown_plain", lambda: X.strip_markdown(F.translate("text", "*#_`~[]>-!", "")), "translate(text, '*#_`~[]>-!', '')")
_scalar("truncate_text", lambda: X.truncate_text(F.col("text"), 400), "CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 397) || '...' END")
_scalar("truncate_by_tokens", lambda: X.truncate_by_tokens(F.col("text"), 600),
        "CASE WHEN floor(length(text) * 1.2) <= 600 THEN text WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 497) || '...' END")
_scalar("count_tokens_estimate", lambda: X.count_tokens_estimate(F.concat("text", F.lit("中文"))), "CAST(floor(3.0 + length(text) * 0.25) AS BIGINT)")
_T = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_scalar("tokenize_for_bm25", lambda: F.array_join(X.tokenize(F.col("text")), " "), f"array_to_string({_T}, ' ')")
_scalar("tokenize", lambda: F.array_join(X.tokenize(F.col("text"), stopwords=True), " "), f"array_to_string(list_filter({_T}, lambda x: length(x) > 1), ' ')")
_scalar("norm_answer", lambda: X.norm_answer(F.col("text")), rf"lower(regexp_replace(coalesce(text, ''), '{_S}+', '', 'g'))")
_scalar("excerpt", lambda: X.excerpt(F.col("text")), r"CASE WHEN length(trim(text, ' ' || chr(10))) > 80 THEN substr(trim(text, ' ' || chr(10)), 1, 80) || '…' ELSE trim(text, ' ' || chr(10)) END")


@query("no_answer_flag", "SELECT conv_id, turn, contains(lower(text), 'not found') OR contains(lower(text), 'no information') AS out FROM conversations")
def no_answer_flag(t):
    return t.conversations.select("conv_id", "turn", X.no_answer_flag(F.col("text")).alias("out"))


@query("format_file_size", """SELECT doc_id, CASE WHEN z < 1024 THEN CAST(z AS VARCHAR) || ' B' WHEN z < 1048576 THEN printf('%.1f KB', z / 1024.0)
    WHEN z < 1073741824 THEN printf('%.1f MB', z / 1048576.0) ELSE printf('%.2f GB', z / 1073741824.0) END AS out FROM (SELECT doc_id, n_chars * n_chars AS z FROM documents)""")
def format_file_size(t):
    return t.documents.select("doc_id", X.format_file_size(F.col("n_chars") * F.col("n_chars")).alias("out"))


@query("sanitize_filename", r"""SELECT doc_id, CASE WHEN n = '' THEN 'unnamed' WHEN length(n) > 200 THEN CASE WHEN doc_id % 3 = 0 THEN n[1:196] ELSE n[1:196] || '.md' END ELSE n END AS out
    FROM (SELECT doc_id, ltrim(regexp_replace(string_split('../a b/' || CASE doc_id % 5 WHEN 0 THEN '..' WHEN 1 THEN 'a\' ELSE '' END || replace(substr(replace(text, '.', ''), 1, 230), chr(10), ' ') || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.md' ELSE 'x.md' END || CASE WHEN doc_id % 7 = 0 THEN '/' ELSE '' END, '/')[-1], '[^\p{L}\p{N}_.\-]', '_', 'g'), '.') AS n, doc_id FROM documents)""")
def sanitize_filename(t):
    """Names with hidden files, back slashes, folders without a file and long ones, with and without an extension."""
    m = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    body = F.regexp_replace(F.substring(F.regexp_replace("text", r"\.", ""), 1, 230), "\n", " ")
    name = F.concat(F.lit("../a b/"), m(5, "..", "a\\", "", "", ""), body, m(3, "", ".md", "x.md"), F.when(F.col("doc_id") % 7 == 0, "/").otherwise(""))
    return t.documents.select("doc_id", X.sanitize_filename(name).alias("out"))


@query("extract_keywords", rf"""SELECT doc_id, term, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS BIGINT) AS rank FROM (
    SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM (SELECT doc_id, w[i] AS term, i AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i
    FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1) AS w FROM documents))) GROUP BY doc_id, term) QUALIFY rank <= 10""")
def extract_keywords(t):
    return keywords(t.documents.select("doc_id", "text"), ["doc_id"], "text", 10).select("doc_id", "term", "n", "rank")


def keywords(df, keys, column, k):
    """Most frequent stop-worded tokens in their own case; ties in order of first occurrence."""
    words = df.select(*keys, F.posexplode(X.tokenize(F.col(column), stopwords=True, lower=False)).alias("pos", "term"))
    counts = words.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "pos")).cast("bigint")
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


@query("char_ngrams", r"""SELECT item_id, gram, count(*) AS n FROM (SELECT item_id, substr(s, i, 2) AS gram FROM (SELECT item_id, s, unnest(range(1, greatest(length(s) - 1, 1) + 1)) AS i
    FROM (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS s FROM benchmark) WHERE s <> '')) GROUP BY item_id, gram""")
def char_ngrams(t):
    return t.benchmark.select("item_id", F.explode(X.char_ngrams(F.col("text"))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("cosine_similarity", """SELECT a.vec_id AS a, b.vec_id AS b, round(CAST(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS DOUBLE), 6) AS score
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(t):
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(X.cosine_similarity(F.col("x"), F.col("y")), 6).alias("score"))


@query("citation_label", """SELECT chunk_id, document_name || ' · 第' || page_number || '页 · 块' || (chunk_index + 1) AS out FROM v_chunks""")
def citation_label(t):
    return t.v_chunks.select("chunk_id", X.citation_label(F.col("document_name"), F.col("doc_id"), F.col("page_number"), F.col("chunk_index")).alias("out"))


@query("strip_code_fence", r"""SELECT paper_id, qid, CASE qid % 5 WHEN 1 THEN regexp_extract(output, '(?s)json\n(.*)\n`', 1) ELSE trim(output) END AS out FROM v_model_outputs""")
def strip_code_fence(t):
    return t.v_model_outputs.select("paper_id", "qid", X.strip_code_fence(F.col("output")).alias("out"))


@query("extract_json_object", r"""SELECT paper_id, qid, CASE WHEN qid % 5 < 3 THEN regexp_extract(output, '(\{.*\})', 1) END AS out FROM v_model_outputs""")
def extract_json_object(t):
    return t.v_model_outputs.select("paper_id", "qid", X.extract_json_object(F.col("output")).alias("out"))


@query("extract_json_array", r"""SELECT paper_id, qid, CASE WHEN qid % 5 < 3 THEN '[' || regexp_extract(output, '(\{.*\})', 1) || ']' END AS out FROM v_model_outputs""")
def extract_json_array(t):
    listed = F.regexp_replace(F.regexp_replace("output", r"\{.*\}", "[$0]"), "done", "finished")
    return t.v_model_outputs.select("paper_id", "qid", X.extract_json_array(listed).alias("out"))


@query("extract_questions", """SELECT paper_id, qid, stem, type FROM v_questions""")
def extract_questions(t):
    """Questions of each paper as model JSON, wrapped or bare, back to rows."""
    one = F.struct("qid", "stem", "type")
    papers = t.v_questions.groupBy("paper_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("list"))
    wrapped = F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit('{"questions": '), "list", F.lit("}"))).otherwise(F.col("list"))
    parsed = papers.select("paper_id", wrapped.alias("output"))
    kind = "array<struct<qid:bigint,stem:string,type:string>>"
    rows = F.coalesce(
        F.from_json(X.extract_json_object(F.col("output")), f"struct<questions:{kind}>")["questions"], F.from_json(X.extract_json_array(F.col("output")), kind)
    )
    return parsed.select("paper_id", F.explode(rows).alias("q")).select("paper_id", "q.qid", "q.stem", "q.type")


@query("parse_rewrites", """SELECT query_id, CASE WHEN query_id % 2 = 0 THEN q || '|' || q || ' one|' || q || ' two' ELSE q || '|what''s new, "' || q || '" or not|2. don''t panic' END AS out FROM (SELECT query_id, replace(trim(query), chr(10), ' ') AS q FROM v_queries)""")
def parse_rewrites(t):
    q = F.regexp_replace(F.trim("query"), "\n", " ")
    listed = F.to_json(F.array(F.concat(q, F.lit(" one")), F.lit(" "), q, F.concat(q, F.lit(" two")), F.lit("three")))
    lines = F.concat(F.lit('1. "what\'s new, "'), q, F.lit('" or not\n- "'), q, F.lit('"\n\n1) 2. don\'t panic\'\n3) three'))
    rows = t.v_queries.select("query_id", F.col("query"), q.alias("q"), F.when(F.col("query_id") % 2 == 0, listed).otherwise(lines).alias("o"))
    found = F.array_join(X.parse_rewrites(F.col("o"), F.col("q")), "|")
    return rows.select("query_id", found.alias("out"))


@query("normalize_text_list", r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''), '|') AS out FROM documents""")
def normalize_text_list(t):
    return t.documents.select("doc_id", F.array_join(X.normalize_text_list(F.split("text", r"\.")), "|").alias("out"))


@query("row_to_json", """SELECT kb_id, '{"kb_id":' || kb_id || ',"name":"' || name || '","owner_id":' || owner_id || '}' AS out FROM v_kb""")
def row_to_json(t):
    return t.v_kb.select("kb_id", F.to_json(F.struct("kb_id", "name", "owner_id")).alias("out"))


@query("auto_title", """SELECT o_orderkey, 'kb' || o_orderkey % 25 || '试卷-' || CASE o_orderkey % 3 WHEN 0 THEN '易' WHEN 1 THEN '中' ELSE '难' END || '等-' || strftime(o_orderdate, '%Y%m%d') AS out FROM orders""")
def auto_title(t):
    grade = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t.orders.select("o_orderkey", X.auto_title(F.concat(F.lit("kb"), F.col("o_orderkey") % 25), grade, F.col("o_orderdate")).alias("out"))


@query("retrieval_queries_for_config", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '课程重点 核心知识点 概述' WHEN o_orderkey % 4 = 1 THEN '核心概念 定义 术语 分类 特点'
    WHEN o_orderkey % 4 = 2 THEN '关键名词 公式 结论 要点 规则' ELSE '核心概念 定义 术语 分类 特点|关键名词 公式 结论 要点 规则' END AS out FROM orders""")
def retrieval_queries_for_config(t):
    m = F.col("o_orderkey") % 4
    return t.orders.select("o_orderkey", F.array_join(X.retrieval_queries(m.isin(1, 3).cast("int"), m.isin(2, 3).cast("int"), F.lit(0)), "|").alias("out"))
