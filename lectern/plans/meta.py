"""Queries of the metadata operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import meta as M
from lectern.plans.registry import query
from lectern.sources.files import exam_markdown

_LEVEL = lambda c: f"CASE {c} WHEN 'owner' THEN 100 WHEN 'admin' THEN 80 WHEN 'write' THEN 50 WHEN 'read' THEN 20 ELSE 0 END"


@query("live_rows", "SELECT kb_id, name FROM v_kb WHERE NOT is_deleted")
def live_rows(t):
    return M.live(t.v_kb).select("kb_id", "name")


@query("paginate", "SELECT doc_id, total, (total + 19) // 20 AS total_pages FROM (SELECT doc_id, count(*) OVER () AS total, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k BETWEEN 41 AND 60")
def paginate(t):
    return M.paginate(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 3, 20).select("doc_id", "total", "total_pages")


@query("kbs_for_user", """SELECT user_id, kb_id, my_role, position, total, (total + 1) // 2 AS total_pages FROM (SELECT user_id, k.kb_id, m.role AS my_role, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, k.kb_id) AS position,
    count(*) OVER (PARTITION BY user_id) AS total FROM v_kb k JOIN v_members m ON k.kb_id = m.kb_id WHERE NOT k.is_deleted AND contains(name, '1')) WHERE position <= 2""")
def kbs_for_user(t):
    rows = M.kbs_for_user(t.v_kb, t.v_members, "1")
    return M.paginate(rows, [F.desc("updated_at"), F.col("kb_id")], 1, 2, ["user_id"]).select("user_id", "kb_id", "my_role", "position", "total", "total_pages")


@query("user_role", "SELECT kb_id, user_id, role FROM v_members WHERE NOT is_deleted")
def user_role(t):
    return M.live(t.v_members).select("kb_id", "user_id", "role")


@query("has_access", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM v_members m WHERE m.user_id = o_custkey AND m.kb_id = o_orderkey % 7 AND NOT is_deleted)")
def has_access(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 7).alias("kb_id"))
    return o.join(M.live(t.v_members), ["kb_id", "user_id"], "left_semi").select("o_orderkey")


@query("permission_check", f"""SELECT kb_id, user_id, required, {_LEVEL('role')} >= {_LEVEL('required')} AND {_LEVEL('required')} > 0 AS allow FROM v_members, (VALUES ('owner'), ('admin'), ('write'), ('read'), ('other')) r(required)""")
def permission_check(t):
    wanted = F.explode(F.array(*map(F.lit, (*M.LEVELS, "other")))).alias("required")
    rows = t.v_members.select("kb_id", "user_id", "role", wanted)
    return rows.select("kb_id", "user_id", "required", M.allowed(F.col("role"), F.col("required")).alias("allow"))


@query("permission_audit", f"""SELECT event_id, role, allow, CASE WHEN NOT allow THEN 'permission_denied ' || op || ' ' || coalesce(role, 'none') || ' ' || required END AS audit FROM (SELECT event_id, role, op, required,
    CASE coalesce(role, '') WHEN 'owner' THEN 100 WHEN 'admin' THEN 80 WHEN 'write' THEN 50 WHEN 'read' THEN 20 ELSE 0 END >= {_LEVEL('required')} AS allow FROM (
    SELECT event_id, user_id, event_id % 25 AS kb_id, event_type AS op, CASE event_id % 2 WHEN 0 THEN 'write' ELSE 'read' END AS required FROM events) e LEFT JOIN (SELECT * FROM v_members WHERE NOT is_deleted) m USING (kb_id, user_id))""")
def permission_audit(t):
    e = t.events.select("event_id", "user_id", (F.col("event_id") % 25).alias("kb_id"), F.col("event_type").alias("op"), F.when(F.col("event_id") % 2 == 0, "write").otherwise("read").alias("required"))
    return M.permission_audit(e, t.v_members).select("event_id", "role", "allow", "audit")


@query("members_of_kb", """SELECT kb_id, user_id, name, role, position FROM (SELECT kb_id, m.user_id, coalesce(nickname, username) AS name, m.role, row_number() OVER (PARTITION BY kb_id ORDER BY m.role DESC, m.user_id) AS position
    FROM v_members m LEFT JOIN v_users u ON m.user_id = u.user_id WHERE NOT m.is_deleted) WHERE position <= 20""")
def members_of_kb(t):
    users = t.v_users.select("user_id", F.coalesce("nickname", "username").alias("name"))
    rows = M.live(t.v_members).join(users, "user_id", "left")
    return M.paginate(rows, [F.desc("role"), F.col("user_id")], 1, 20, ["kb_id"], total=False).select("kb_id", "user_id", "name", "role", "position")


@query("apply_member_changes", """SELECT kb_id, user_id, role, is_deleted FROM (SELECT kb_id, user_id, CASE WHEN gives THEN new_role ELSE old END AS role, CASE WHEN gives THEN false WHEN change = 'remove' AND old <> 'owner' THEN true ELSE gone END AS is_deleted FROM (
    SELECT *, coalesce(new_role IN ('admin', 'write', 'read') AND coalesce(old, '') <> 'owner' AND (change = 'add' OR (change = 'update' AND old IS NOT NULL AND NOT gone)), false) AS gives FROM
    (SELECT kb_id, user_id, role AS old, is_deleted AS gone FROM v_members) FULL JOIN (SELECT o_custkey AS user_id, o_orderkey % 23 AS kb_id, min(CASE o_orderkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'remove' END) AS change,
    min(CASE o_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'write' WHEN 2 THEN 'read' ELSE 'owner' END) AS new_role FROM orders GROUP BY ALL) USING (kb_id, user_id))) WHERE role IS NOT NULL""")
def apply_member_changes(t):
    kind = F.element_at(F.array(*map(F.lit, ("add", "update", "remove"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    role = F.element_at(F.array(*map(F.lit, ("admin", "write", "read", "owner"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    changes = t.orders.groupBy(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 23).alias("kb_id")).agg(F.min(kind).alias("change"), F.min(role).alias("new_role"))
    return M.apply_member_changes(t.v_members, changes)


@query("partial_update", "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'n' || user_id ELSE nickname END AS nickname, CASE WHEN user_id % 10 = 0 THEN 'disabled' ELSE status END AS status FROM v_users")
def partial_update(t):
    u = t.v_users.select("user_id", "nickname", "status")
    changes = u.filter("user_id % 5 = 0").select("user_id", F.concat(F.lit("n"), "user_id").alias("nickname"), F.when(F.col("user_id") % 10 == 0, "disabled").alias("status"))
    return M.partial_update(u, changes, "user_id", ["nickname", "status"])


@query("soft_delete_kb", "SELECT kb_id, is_deleted OR kb_id % 4 = 0 AS is_deleted, CASE WHEN kb_id % 4 = 0 THEN 'archived' ELSE 'active' END AS status FROM v_kb")
def soft_delete_kb(t):
    gone = F.col("kb_id") % 4 == 0
    return t.v_kb.select("kb_id", (F.col("is_deleted") | gone).alias("is_deleted"), F.when(gone, "archived").otherwise("active").alias("status"))


def _deltas(t):
    return t.events.select((F.col("user_id") % 25).alias("kb_id"), "event_id", F.when(F.col("event_type") == "click", -2).otherwise(1).cast("bigint").alias("delta"))


@query("kb_counters", """WITH RECURSIVE d AS (SELECT user_id % 25 AS kb_id, CAST(CASE WHEN event_type = 'click' THEN -2 ELSE 1 END AS BIGINT) AS delta, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS k FROM events),
    r AS (SELECT kb_id, k, greatest(delta, 0) AS value FROM d WHERE k = 1 UNION ALL SELECT d.kb_id, d.k, greatest(r.value + d.delta, 0) FROM r JOIN d ON d.kb_id = r.kb_id AND d.k = r.k + 1)
    SELECT kb_id, value FROM r QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY k DESC) = 1""")
def kb_counters(t):
    return M.floored_counter(_deltas(t), "kb_id", ["event_id"])


@query("kb_recount", "SELECT kb_id, count(*) AS documents, CAST(sum(char_count) AS BIGINT) AS characters FROM v_documents WHERE NOT is_deleted GROUP BY kb_id")
def kb_recount(t):
    return M.live(t.v_documents).groupBy("kb_id").agg(F.count("*").alias("documents"), F.sum("char_count").alias("characters"))


@query("documents_of_kb", "SELECT kb_id, doc_id, name, position FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY updated_at DESC) AS position FROM v_documents WHERE NOT is_deleted AND contains(name, '1') AND status = 'ready') WHERE position <= 20")
def documents_of_kb(t):
    rows = M.live(t.v_documents).filter(F.col("name").contains("1") & (F.col("status") == "ready"))
    return M.paginate(rows, [F.desc("updated_at")], 1, 20, ["kb_id"], total=False).select("kb_id", "doc_id", "name", "position")


@query("ready_documents_count", "SELECT kb_id, count(*) AS n FROM v_documents WHERE NOT is_deleted AND status = 'ready' GROUP BY kb_id")
def ready_documents_count(t):
    return M.live(t.v_documents).filter("status = 'ready'").groupBy("kb_id").agg(F.count("*").alias("n"))


@query("document_status_latest", "SELECT doc_id, arg_max(status, (ts, event_id)) AS status, arg_max(error, (ts, event_id)) FILTER (WHERE error IS NOT NULL) AS error FROM v_status_events GROUP BY doc_id")
def document_status_latest(t):
    return M.latest_fields(t.v_status_events, "doc_id", ["ts", "event_id"], ["status", "error"])


@query("users_search", "SELECT user_id FROM v_users WHERE NOT is_deleted AND (contains(username, '12') OR contains(nickname, 'AUTO')) AND role = 'normal' AND status = 'active'")
def users_search(t):
    u = M.live(t.v_users).filter(F.col("username").contains("12") | F.col("nickname").contains("AUTO"))
    return u.filter("role = 'normal' and status = 'active'").select("user_id")


@query("unique_key_check", "SELECT wanted, EXISTS (SELECT 1 FROM v_users WHERE username = wanted) AS taken FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'new' || o_custkey END AS wanted FROM orders)")
def unique_key_check(t):
    wanted = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("new"), "o_custkey"))
    names = t.v_users.select(F.col("username").alias("wanted"), F.lit(True).alias("found")).dropDuplicates(["wanted"])
    return t.orders.select(wanted.alias("wanted")).join(names, "wanted", "left").select("wanted", F.col("found").isNotNull().alias("taken"))


@query("login_stats", "SELECT user_id, count(*) AS logins, epoch_us(max(ts)) AS last_at, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE event_type = 'view' GROUP BY user_id")
def login_stats(t):
    at = F.unix_micros(F.max("ts").cast("timestamp")).alias("last_at")
    rows = t.events.filter("event_type = 'view'").groupBy("user_id")
    return rows.agg(F.count("*").alias("logins"), at, F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("conversations_for_user", "SELECT owner, conv_id, position FROM (SELECT conv_id % 10 AS owner, conv_id, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY CASE WHEN conv_id % 4 = 0 THEN NULL ELSE last END DESC NULLS LAST, conv_id DESC) AS position FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)) WHERE position <= 20")
def conversations_for_user(t):
    rows = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last")).withColumns({"owner": F.col("conv_id") % 10, "last": F.when(F.col("conv_id") % 4 != 0, F.col("last"))})
    return M.paginate(rows, [F.desc_nulls_last("last"), F.desc("conv_id")], 1, 20, ["owner"], total=False).select("owner", "conv_id", "position")


@query("messages_page", "SELECT conv_id, id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM v_messages WHERE id < 4) WHERE k <= 2")
def messages_page(t):
    return M.messages_before(t.v_messages, 4, 2).select("conv_id", "id")


@query("conversation_stats", "SELECT conv_id, count(*) AS messages, max(id) AS last_id FROM v_messages GROUP BY conv_id")
def conversation_stats(t):
    return t.v_messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("id").alias("last_id"))


@query("agent_tasks_for_user", "SELECT user_id, task_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY task_id DESC) AS position FROM v_agent_tasks WHERE status = 'failed' AND kb_id < 20) WHERE position <= 20")
def agent_tasks_for_user(t):
    rows = t.v_agent_tasks.filter("status = 'failed' and kb_id < 20")
    return M.paginate(rows, [F.desc("task_id")], 1, 20, ["user_id"], total=False).select("user_id", "task_id", "position")


@query("agent_task_rollup", "SELECT l_orderkey AS task_id, count(*) AS total_steps, count(*) FILTER (WHERE l_returnflag = 'R') AS retry_count, round(sum(l_extendedprice), 2) AS duration FROM lineitem GROUP BY l_orderkey")
def agent_task_rollup(t):
    retry = F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("retry_count")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count("*").alias("total_steps"), retry, F.round(F.sum("l_extendedprice"), 2).alias("duration"))


@query("audit_query", "SELECT id FROM v_audit WHERE action = 'click' AND result = 'success' AND created_at >= TIMESTAMP '2024-01-02' AND created_at <= TIMESTAMP '2024-01-06'")
def audit_query(t):
    import datetime as dt

    return M.audit_query(t.v_audit, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 6), action="click", result="success", user_id=None).select("id")


@query("audit_action_counts", "SELECT action, count(*) AS n FROM v_audit WHERE created_at >= TIMESTAMP '2024-01-10' - INTERVAL 7 DAY GROUP BY action")
def audit_action_counts(t):
    import datetime as dt

    since = dt.datetime(2024, 1, 10) - dt.timedelta(days=7)
    return M.audit_query(t.v_audit, since).groupBy("action").agg(F.count("*").alias("n"))


@query("query_cache_hits")
def query_cache_hits(t):
    key = F.concat_ws("|", (F.col("user_id") % 20).cast("string"), "event_type")
    return M.query_cache(t.events.select(key.alias("key"), "event_id", "ts"), 3_600)


@query("answers_of_paper", """SELECT paper_id, sheet_id, answers, row_number() OVER (PARTITION BY paper_id ORDER BY sheet_id DESC) AS position FROM (
    SELECT paper_id, sheet_id, count(*) AS answers FROM v_answers GROUP BY ALL) QUALIFY position <= 20""")
def answers_of_paper(t):
    """First page of each paper's sheets, newest first."""
    sheets = t.v_answers.groupBy("paper_id", "sheet_id").agg(F.count("*").alias("answers"))
    return M.paginate(sheets, [F.desc("sheet_id")], 1, 20, ["paper_id"], total=False).select("paper_id", "sheet_id", "answers", "position")


@query("export_exam_markdown", """SELECT paper_id, md5('# paper ' || paper_id || chr(10) || chr(10) || '难度：medium　总分：' || CAST(total AS BIGINT) || chr(10) || '迭代次数：0' || chr(10) || chr(10) || asked ||
    CASE WHEN paper_id % 3 <> 0 THEN chr(10) || '---' || chr(10) || chr(10) || '# 参考答案' || chr(10) || chr(10) || told ELSE '' END) AS digest FROM (SELECT paper_id, sum(score) AS total,
    string_agg('## 第' || qid || '题（' || CASE type WHEN 'choice' THEN '单选题' WHEN 'fill' THEN '填空题' ELSE '简答题' END || '，' || score || ' 分）' || chr(10) || stem || chr(10), chr(10) ORDER BY qid) AS asked,
    string_agg('## 第' || qid || '题' || chr(10) || answer || CASE WHEN knowledge_point <> '' THEN chr(10) || '*知识点：' || knowledge_point || '*' ELSE '' END || chr(10), chr(10) ORDER BY qid) AS told FROM v_questions GROUP BY paper_id)""")
def export_exam_markdown(t):
    q = t.v_questions.withColumn("options", F.array().cast("array<string>"))
    papers = q.groupBy("paper_id").agg(F.sum("score").alias("total_score")).select(
        "paper_id", F.concat(F.lit("paper "), "paper_id").alias("title"), F.lit("medium").alias("difficulty"), "total_score", F.lit(0).alias("iterate_count"),
        F.when(F.col("paper_id") % 3 == 0, "read").otherwise("write").alias("role"),
    )
    return exam_markdown(papers, q).select("paper_id", F.md5("markdown").alias("digest"))
