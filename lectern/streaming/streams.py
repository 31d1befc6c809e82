"""Streaming forms of the stateful operators; each ends equal to its batch form over the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lectern.operators.meta import latest_fields
from lectern.operators.retrieve import last_messages
from lectern.sources.scratch import shared_dir, written


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's checkpoint or output, shared by all executors."""
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def drain(rows: DataFrame, name: str, folder: str | None = None, done: Callable | None = None, by: list[str] | None = None) -> DataFrame:
    """Runs an append stream over what there is, into Parquet; returns the written rows. In the same ``folder`` it goes on."""
    spark, folder = rows.sparkSession, folder or place(rows.sparkSession, name)
    query = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log")
    query = query.partitionBy(*by) if by else query
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    if done:
        done(query)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers N of the folders ``name``=N in ``path``, from a listing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(x.split("=")[1]) for x in found if x.startswith(f"{name}="))


class BucketTable:
    """A table of hash buckets that micro-batches are merged into.

    A bucket has a version for each batch that brought rows of it: ``bucket=K/batch=N``. A batch reads and writes the buckets of
    its own keys only; it overwrites its own versions where it runs again, so a replay leaves the same table, and a lost
    run leaves the versions before it. The last two versions of a bucket stay.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.keys, self.merge, self.buckets = spark, path, keys, merge, buckets

    def _read(self, wanted: list[int], before: int | None = None) -> DataFrame | None:
        places = []
        for b in wanted:
            versions = [n for n in _folders(self.spark, f"{self.path}/bucket={b}", "batch") if before is None or n < before]
            places += [f"{self.path}/bucket={b}/batch={versions[-1]}"] if versions else []
        return self.spark.read.parquet(*places) if places else None

    def rows(self) -> DataFrame | None:
        return self._read(_folders(self.spark, self.path, "bucket"))

    def step(self, batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        batch = written(batch, "micro-batch")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets``
        old = self._read(touched, number)
        both = batch if old is None else old.select(*batch.columns).unionByName(batch)
        merged = self.merge(both).select("*", bucket, F.lit(number).alias("batch")).repartition("bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)
        for b in touched:
            for n in _folders(self.spark, f"{self.path}/bucket={b}", "batch")[:-2]:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}/batch={n}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def upserted(rows: DataFrame, name: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], folder: str | None = None, mode: str = "append") -> DataFrame:
    """Folds micro-batches into a ``BucketTable`` by ``keys``; ``merge`` of a key's rows must not depend on other keys.

    The table lies next to the stream's checkpoint in ``folder``; a query started again there goes on.
    """
    spark, folder = rows.sparkSession, folder or place(rows.sparkSession, name)
    table = BucketTable(spark, f"{folder}/table", keys, merge)
    query = rows.writeStream.outputMode(mode).foreachBatch(table.step).option("checkpointLocation", f"{folder}/log")
    query.trigger(availableNow=True).start().awaitTermination()
    found = table.rows()
    return spark.createDataFrame([], rows.schema) if found is None else found


def append_audit(rows: DataFrame, folder: str) -> DataFrame:
    """Appends audit rows (with ``created_at``) from a stream, each once however often the query starts again on ``folder``; returns the whole log.

    The log has a folder for each day, so ``audit_query`` with a time range reads the days of the range only.
    """
    return drain(rows.withColumn("day", F.to_date("created_at")), "audit-log", folder, by=["day"])


def audit_counts(events: DataFrame, window: str = "1 day", late: str = "30 days", folder: str | None = None) -> DataFrame:
    """(start, action, n) of tumbling windows over ``created_at`` (timestamp).

    Spark keeps the open windows as state and drops what comes later than ``late`` behind the newest
    event; each batch brings the new totals of the windows that changed.
    """
    timed = events.withWatermark("created_at", late).groupBy(F.window("created_at", window), "action").agg(F.count("*").alias("n"))
    parts = timed.select(F.col("window.start").alias("start"), "action", "n")
    return upserted(parts, "audit", ["start", "action"], lambda b: b.groupBy("start", "action").agg(F.max("n").alias("n")), folder, "update")


def hash_dedup(docs: DataFrame, late: str = "7 days", folder: str | None = None) -> DataFrame:
    """(kb_id, file_hash) once each as long as the watermark on ``seen_at`` holds them: ``late`` behind the newest row they are forgotten."""
    unique = docs.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["kb_id", "file_hash"])
    return drain(unique.select("kb_id", "file_hash"), "hashes", folder)


def recent_messages(messages: DataFrame, n: int = 10, folder: str | None = None) -> DataFrame:
    """The last ``n`` messages of each conversation; of a conversation no more than those are kept or read again."""
    return upserted(messages, "messages", ["conv_id"], lambda b: last_messages(b.dropDuplicates(["conv_id", "id"]), n), folder)


def document_status(events: DataFrame, folder: str | None = None) -> DataFrame:
    """Latest non-NULL status and error by document; rows carry their order in ``at``."""

    def merge(both: DataFrame) -> DataFrame:
        fields = latest_fields(both, "doc_id", ["at"], ["status", "error"])
        # The error keeps the order it was told at, so that a later status without one does not outlive it.
        return fields.join(both.groupBy("doc_id").agg(F.max("at").alias("at")), "doc_id").select("doc_id", "at", "status", "error")

    return upserted(events.select("doc_id", "at", "status", "error"), "status", ["doc_id"], merge, folder)


class _LastMiss(StatefulProcessor):
    """The time of a key's last miss as value state, with an event-time timer for its end."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["at", "event_id"])
        written, hits = self.written.get()[0] if self.written.exists() else None, []
        for at in rows["at"]:
            hit = written is not None and at - written <= self.ttl * 1_000_000
            written = written if hit else int(at)
            hits.append(hit)
        self.written.update((written,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(written // 1000 + self.ttl * 1000 + 1)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.written.clear()
        return iter([])

    def close(self) -> None:
        pass


def query_cache(requests: DataFrame, ttl: int, late: str = "1 hour", folder: str | None = None, done: Callable | None = None) -> DataFrame:
    """(key, event_id, hit) with the time of each key's last miss as state; a batch's rows count in time order.

    A key's state ends ``ttl`` seconds after its last miss, when the watermark (``late`` behind the newest request) has passed
    that; requests older than the watermark are dropped. ``done`` gets the ended query, e.g. for its progress.
    """
    timed = requests.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = timed.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=_LastMiss(ttl), outputStructType="key string, event_id bigint, hit boolean", outputMode="Append", timeMode="EventTime"
    )
    name, old = "spark.sql.streaming.stateStore.providerClass", None
    old = requests.sparkSession.conf.get(name, None)
    requests.sparkSession.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return drain(out, "cache", folder, done)
    finally:
        requests.sparkSession.conf.set(name, old) if old else requests.sparkSession.conf.unset(name)
