"""What the corpus operators share: scratch tables, size-checked joins, text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Buffers of whole slices come and go in long-lived Python workers; the system's allocator gives their memory back.
pa.set_memory_pool(pa.system_memory_pool())


def _give_back(large: int = 4 << 20) -> None:
    """Blocks from ``large`` bytes on are mapped one by one, so what a slice needed goes back when it is freed (glibc; elsewhere nothing)."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, large)  # M_MMAP_THRESHOLD, which else grows with the blocks that are freed
        libc.mallopt(-1, large)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


_give_back()


def trim() -> None:
    """Free pages between blocks that are still held go back to the system, too (glibc; elsewhere nothing)."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, held by a Python worker for its next tasks; one thing at a time, until a task needs another or none."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def _let_go(keep: object) -> None:
    if keep not in _kept:
        _kept.clear()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: object = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; a worker that ends its task and waits for another keeps no freed memory.

    Workers take tasks in turn, so one that begins this task also lets go of what an earlier one has ``kept``, unless it is ``keep``.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(keep)
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


#: Spark's limit of an Arrow batch's bytes, and what it is set to where a session leaves it open.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches hold ``BATCH_BYTES`` or one row; a value that is set already stays.

    Each batch is held by the executor and by its Python worker, and by rows alone one of whole texts is many times as large.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


#: A side is broadcast only if its written table is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset in a local session (tests) is a
    temporary folder made and set as the checkpoint folder. Other sessions must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a materialised table, from Spark's own statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (materialised) with a broadcast hint if its files are within ``limit``, else as it is.

    Past the limit the join that uses it is a shuffled one, which has no bound on either side.
    """
    return F.broadcast(df) if table_bytes(df) <= limit else df


#: A key is hot from so many rows on, or from this share of all rows: at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 256, 1e-4


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key (both written), without a task for a hot key.

    Within ``limit`` the table is broadcast. Beyond it the entries of hot keys, of which there are at most
    10,000, are broadcast (if they in turn are within the limit) and the other rows are shuffled.
    ``counted`` are the written rows to count keys in where ``rows`` are not written themselves.
    """
    if table_bytes(table) <= limit:
        return rows.join(F.broadcast(table), key, how)
    counted = rows if counted is None else counted
    least = max(HOT_ROWS, int(counted.count() * HOT_SHARE))
    often = materialise(counted.groupBy(key).count().filter((F.col("count") >= least) & F.col(key).isNotNull()).select(key), "hot-keys")
    if often.isEmpty():
        return rows.join(table, key, how)
    entries = materialise(table.join(F.broadcast(often), key, "left_semi"), "hot-entries")
    hot = rows.join(F.broadcast(often), key, "left_semi").join(small_enough(entries, max(limit, BROADCAST_BYTES)), key, how)
    rest = rows.join(F.broadcast(often), key, "left_anti").join(table, key, how)
    return hot.unionByName(rest)


def buckets_of(spark: SparkSession) -> int:
    """Buckets that packed exchanges are dealt into: 16 for each shuffle partition of the session."""
    return 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column whose rows are values[start:end]; the ranges follow each other, gaps are cut out."""
    if len(starts) and (int(starts[0]) or int(ends[-1]) != len(values) or (starts[1:] != ends[:-1]).any()):
        values = values[np.repeat(starts - np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts) + np.arange(int((ends - starts).sum()))]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, nulls kept."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def table_of(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def slices(batch: pa.RecordBatch, name: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (at least one row)."""
    start, held = 0, 0
    lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(name))).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
