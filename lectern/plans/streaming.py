"""Queries of the streaming operators: file streams drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.streaming import streams as S


def _stream(t, name):
    """A table as a stream, be it one file or a folder of files."""
    path = f"{t.sf_dir}/{name}.parquet"
    at = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = t.spark.readStream.schema(getattr(t, name).schema)
    if at.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return rows.parquet(path)
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


@query("stream_audit_counts", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type AS action, count(*) AS n FROM events GROUP BY ALL")
def stream_audit_counts(t):
    rows = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("action"))
    return S.audit_counts(rows).withColumn("start", F.unix_seconds("start"))


@query("stream_hash_dedup", "SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS kb_id, sha256(text) AS file_hash FROM documents")
def stream_hash_dedup(t):
    seen = F.timestamp_micros(F.col("doc_id") + 1_700_000_000_000_000)
    rows = _stream(t, "documents").select(F.substring("source", 4, 9).cast("bigint").alias("kb_id"), F.sha2("text", 256).alias("file_hash"), seen.alias("seen_at"))
    return S.hash_dedup(rows)


@query("stream_recent_messages", "SELECT conv_id, id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM v_messages) WHERE k <= 3")
def stream_recent_messages(t):
    return S.recent_messages(_stream(t, "conversations").select("conv_id", F.col("turn").alias("id"), "role"), 3)


@query("stream_document_status", "SELECT doc_id, arg_max(status, (ts, event_id)) AS status, arg_max(error, (ts, event_id)) FILTER (WHERE error IS NOT NULL) AS error FROM v_status_events GROUP BY doc_id")
def stream_document_status(t):
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), "event_id"))
    rows = _stream(t, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), error.alias("error"))
    return S.document_status(rows).select("doc_id", "status", "error")


@query("stream_query_cache")
def stream_query_cache(t):
    key = F.concat_ws("|", (F.col("user_id") % 20).cast("string"), "event_type")
    return S.query_cache(_stream(t, "events").select(key.alias("key"), "event_id", "ts"), 3_600)


@query("append_audit", "SELECT id, action FROM v_audit WHERE result = 'success' AND created_at >= TIMESTAMP '2024-01-02' AND created_at <= TIMESTAMP '2024-01-06'")
def append_audit(t):
    """The audit log appended from a stream by days, then asked for five of them."""
    import datetime as dt

    from lectern.operators.meta import audit_query

    rows = _stream(t, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("action"),
                                       F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 110, "permission_denied").otherwise("success").alias("result"))
    log = S.append_audit(rows, S.place(t.spark, "audit-log"))
    return audit_query(log, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 6), result="success").select("id", "action")
