"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its written table is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session where that is unset gets a folder of its own, others raise."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet, in folders ``by`` columns if any, and read again: computed once however often it is used."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a written table, from Spark's own statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (written) with a broadcast hint if its files are within ``limit``, else as it is."""
    return F.broadcast(df) if table_bytes(df) <= limit else df
