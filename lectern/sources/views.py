"""Views that give every operator data from the base tables.

One portable text states each view; only hashing and JSON access are spelled per engine. Spark
reads the base tables of a folder, the SQL side prepends the same text as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.scratch import small_enough, written

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_kb": """SELECT CAST(n_nationkey AS BIGINT) AS kb_id, n_name AS name, CAST(n_nationkey AS BIGINT) AS owner_id,
        CAST(n_nationkey AS BIGINT) AS updated_at, CAST(n_nationkey % 7 AS BIGINT) AS doc_count, n_nationkey % 10 = 9 AS is_deleted FROM nation""",
    "v_users": """SELECT c_custkey AS user_id, c_name AS username, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS nickname,
        CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'normal' ELSE 'guest' END AS role,
        CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'disabled' END AS status, c_custkey % 50 = 49 AS is_deleted FROM customer""",
    "v_members": """SELECT kb_id, user_id, CASE substr(p, 1, 1) WHEN '1' THEN 'owner' WHEN '2' THEN 'admin' WHEN '3' THEN 'write' ELSE 'read' END AS role,
        substr(p, 1, 1) = '5' AS is_deleted FROM (SELECT o_orderkey % 25 AS kb_id, o_custkey AS user_id, min_by(o_orderpriority, o_orderkey) AS p
        FROM orders GROUP BY o_orderkey % 25, o_custkey) m""",
    "v_documents": """SELECT CAST(substr(source, 4) AS BIGINT) AS kb_id, doc_id, 'doc_' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 4 WHEN 0 THEN '.md'
        WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '.xlsx' END AS name, text, lang, n_chars AS char_count, {sha}(text) AS file_hash,
        CASE doc_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'parsing' ELSE 'uploaded' END AS status,
        doc_id AS updated_at, doc_id % 17 = 0 AS is_deleted FROM documents""",
    "v_versions": """SELECT doc_id AS document_id, version FROM documents JOIN (SELECT CAST(1 AS BIGINT) AS version UNION ALL SELECT 2
        UNION ALL SELECT 3) v ON version <= 1 + doc_id % 3""",
    "v_chunks": """SELECT kb_id, doc_id, 'doc_' || CAST(doc_id AS VARCHAR(20)) || ':' || CAST(i AS VARCHAR(20)) AS chunk_id, i AS chunk_index,
        1 + i % 3 AS page_number, name AS document_name, substr(text, CAST(1 + i * 462 AS INT), 512) AS text FROM (SELECT kb_id, doc_id, name, text,
        {series}(CAST(0 AS BIGINT), greatest(CAST(ceil((length(text) - 50) / 462.0) AS BIGINT) - 1, CAST(0 AS BIGINT)))) AS i FROM v_documents WHERE NOT is_deleted) d""",
    "v_queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "v_relevant": "SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "v_vectors": """SELECT vec_id AS chunk_id, vec_id % 5 AS kb_id, CASE WHEN vec_id % 4 = 0 THEN 'image' ELSE 'text' END AS modality,
        embedding, CAST(label AS BIGINT) AS label FROM embeddings""",
    "v_messages": "SELECT conv_id, turn AS id, role, text AS content FROM conversations",
    "v_audit": """SELECT event_id AS id, ts AS created_at, user_id, event_type AS action, CASE WHEN event_type = 'error' THEN 'failed'
        WHEN value > 110 THEN 'permission_denied' ELSE 'success' END AS result, CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'kb'
        WHEN 2 THEN 'doc' ELSE 'conv' END AS resource_type, CAST({json}(props, '$.k') AS BIGINT) AS resource_id FROM events""",
    "v_status_events": """SELECT CAST({json}(props, '$.k') AS BIGINT) AS doc_id, event_id, ts, event_type AS status,
        CASE WHEN event_type = 'error' THEN 'failed at ' || CAST(event_id AS VARCHAR(20)) END AS error FROM events""",
    "v_questions": """SELECT l_orderkey AS paper_id, qid, type, p_name AS stem, CASE WHEN p_size = 1 THEN NULL ELSE p_type END AS knowledge_point,
        CASE type WHEN 'choice' THEN substr('ABCD', CAST(l_quantity AS INT) % 4 + 1, 1) WHEN 'fill' THEN replace(p_name, ' ', ',') ELSE p_name END AS answer,
        CAST(CASE type WHEN 'short' THEN 20 ELSE 5 END AS BIGINT) AS score, l_suppkey, p_retailprice FROM (SELECT *, CASE qid % 3 WHEN 0 THEN 'choice'
        WHEN 1 THEN 'fill' ELSE 'short' END AS type FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
        l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS BIGINT) AS qid FROM lineitem) l JOIN part ON l_partkey = p_partkey) q""",
    "v_answers": """SELECT paper_id AS sheet_id, paper_id, o_custkey AS student_id, qid, CASE l_suppkey % 4 WHEN 0 THEN answer
        WHEN 1 THEN split_part(replace(answer, ',', ' '), ' ', 1) WHEN 2 THEN '  ' ELSE upper(answer) END AS answer
        FROM v_questions JOIN orders ON paper_id = o_orderkey WHERE l_suppkey % 11 <> 0""",
    "v_model_outputs": """SELECT paper_id, qid, l_suppkey, stem, score AS max_score, CASE qid % 5 WHEN 0 THEN j WHEN 1 THEN '```json
' || j || '
```' WHEN 2 THEN 'Here you are: ' || j || ' - done' WHEN 3 THEN '{{"verdict": ' ELSE '' END AS output FROM (SELECT *, '{{"verdict": "' ||
        CASE WHEN l_suppkey % 3 = 0 THEN 'Fail ' ELSE 'pass' END || '", "dimensions": [{{"key": " Knowledge ", "score": ' || CAST(l_suppkey % 9 - 1 AS VARCHAR(20)) || CASE WHEN l_suppkey % 2 = 0 THEN '.7' ELSE '' END ||
        ', "source_refs": [" ' || stem || '", "nowhere"]}}, {{"key": "步骤", "score": "' || CAST(l_suppkey % 5 AS VARCHAR(20)) || CASE WHEN l_suppkey % 4 = 0 THEN '.5' ELSE '' END ||
        '"}}, "odd", {{"key": "结论", "score": ' || CAST(l_suppkey % 7 AS VARCHAR(20)) || '}}, {{"key": "language", "score": 9}}, {{"key": "规范性", "score": 2, "comment": " fine "}}]}}' AS j FROM v_questions) m""",
    "v_agent_tasks": """SELECT o_orderkey AS task_id, o_custkey AS user_id, o_orderkey % 25 AS kb_id, CASE o_orderstatus WHEN 'F' THEN 'success'
        WHEN 'P' THEN 'failed' ELSE 'executing' END AS status, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, coalesce(n, 0) AS steps, coalesce(r, 0) AS retries
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey""",
    "v_request_log": "SELECT event_id, ts, user_id, value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events",
}

_SPARK = {"sha": "lectern_sha", "json": "get_json_object", "series": "explode(sequence"}
_DUCK = {"sha": "sha256", "json": "json_extract_string", "series": "unnest(generate_series"}


def _needed(sql: str) -> list[str]:
    """Views that a text uses, those they build on first."""
    out: list[str] = []
    for name in dict.fromkeys(re.findall(r"\bv_\w+\b", sql)):
        if name in VIEWS:
            out += [x for x in [*_needed(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    """SQL for DuckDB with the views it names as common table expressions."""
    ctes = [f"{n} AS ({VIEWS[n].format(**_DUCK)})" for n in _needed(sql)]
    if not ctes:
        return sql
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"


def passages_in(docs: DataFrame, items: DataFrame, words: int = 5) -> DataFrame:
    """(query_id, doc_id) where a document's text contains the whole text of a benchmark item.

    A text that contains an item also has the item's inner words, all but its first and last (between single blanks), in
    a row; up to ``words`` of them are its key, so candidates come from an equality join on word sequences of the
    lengths that keys have, and are then checked. Only items of one or two words, which have no inner word, meet every document.
    """
    parts = F.split("text", " ", -1)
    inner = F.least(F.size(parts) - 2, F.lit(words))
    keyed = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), inner.alias("n"), F.when(inner > 0, F.array_join(F.slice(parts, F.lit(2), F.greatest(inner, F.lit(1))), " ")).alias("key"))
    lengths = [r[0] for r in keyed.filter("n > 0").select("n").distinct().collect()]  # at most ``words``
    # The words are rows of a generator: a plain column would be put into the lambda, which then splits the text again for each word.
    rows = docs.filter("text is not null").select("doc_id", F.explode(F.array(parts)).alias("words"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, n), " "))
    rows = rows.select("doc_id", F.explode(F.array_distinct(F.concat(*map(grams, lengths or [words])))).alias("key"))
    wanted = written(keyed.filter("key is not null").select("query_id", "key"), "passage-keys")
    pairs = written(rows.join(small_enough(wanted), "key").select("query_id", "doc_id").distinct(), "passage-candidates")
    short = keyed.filter("key is null and item is not null").join(docs.select("doc_id", "text"), F.contains("text", "item"))
    return holding(docs, items, pairs).unionByName(short.select("query_id", "doc_id")).distinct()


def holding(docs: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (query_id, doc_id; written) whose document holds the item's whole text; few pairs go to the documents."""
    asked = written(pairs.join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("item")), "query_id"), "passage-pairs")
    found = docs.select("doc_id", "text").join(small_enough(asked), "doc_id").filter(F.contains("text", "item"))
    return found.select("query_id", "doc_id").distinct()


class Tables:
    """Base tables and views of one folder: ``t.documents``, ``t.v_kb``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        if name == "v_relevant":  # the same rows without comparing every pair
            return passages_in(self.documents, self.benchmark)
        if name in ("v_chunks", "v_questions"):  # used several times by most plans: computed once
            if f"_{name}" not in self.__dict__:
                self.__dict__[f"_{name}"] = written(self._view(name), name)
            return self.__dict__[f"_{name}"]
        return self._view(name)

    def unwritten(self, name: str) -> DataFrame:
        """A table or view none of whose parts is written: for plans that take few of its columns, as Spark then leaves out the rest."""
        return self._view(name, self.unwritten) if name in VIEWS else getattr(self, name)

    def _view(self, name: str, table: Callable[[str], DataFrame] | None = None) -> DataFrame:
        table = table or (lambda x: getattr(self, x))
        sql = VIEWS[name].format(**_SPARK).replace("lectern_sha(text)", "sha2(text, 256)")
        used = {x: table(x) for x in dict.fromkeys(re.findall(r"\b\w+\b", sql)) if (x in BASE or x in VIEWS) and re.search(rf"\b(FROM|JOIN)\s+{x}\b", sql)}
        for x in used:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{x}\b", rf"\1 @{x}@", sql)
        return _run(self.spark, sql, used)


def _run(spark: SparkSession, sql: str, used: dict[str, DataFrame]) -> DataFrame:
    """Runs a text whose ``@name@`` stand for DataFrames; leaves nothing registered in the session."""
    for name, df in used.items():
        view = f"lectern_{name}_{id(df)}"
        df.createOrReplaceTempView(view)
        sql = sql.replace(f"@{name}@", view)
    out = spark.sql(sql)
    for name, df in used.items():
        spark.catalog.dropTempView(f"lectern_{name}_{id(df)}")
    return out
