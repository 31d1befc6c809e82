"""Exact Jaccard self-join of documents on word shingles, as components.

Documents with equal shingle sets are one item. An item's cells are its prefix: with the shingles of
all items in one order, two sets within the threshold share a shingle among their first
|x| - ceil(t|x|) + 1. The order is by the number of documents, rarest first, so most prefixes hold
nothing that two documents share and passages in many documents bring them together only where they
are most of a text. Inside cells the pivots, regions and windows of ``metric`` give the links.

Document counts of all shingles take one round trip: each slice of texts sends its distinct
shingles, packed by bucket; what comes back is one byte a shingle, the logarithm of its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import binary_column, buckets_of, lean, looked_up, materialise, packed, slices, small_enough, trim
from lectern.llm.components import components
from lectern.llm.metric import links, shared_cells
from lectern.llm.shingles import shingle_set
from lectern.llm.sketches import digest, odd_sketch

#: A text's place: partition (20 bits), slice in it (20 bits), row in that (23 bits).
_SLICE, _ROW = 20, 23
_LOW = np.uint64(0xFFFFFFFF)


def _keys(found: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower 32 bits of shingle hashes; two shingles with one key count as one, which only makes them later in the order."""
    return ((found >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (found & _LOW)


def _once(ids: list[bytes], sets: list[np.ndarray]) -> list[int]:
    """Positions of the first of each id whose set is not empty."""
    return [k for k in {i: k for k, i in reversed(list(enumerate(ids)))}.values() if len(sets[k])]


def _unpack(sizes: bytes, texts: bytes) -> list[memoryview]:
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    whole = memoryview(pa.decompress(texts, decompressed_size=ends[-1], codec="zstd", asbytes=True))
    return [whole[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def _sketch(words: int):
    """(doc_id, text) to a row for each document and a row for each slice, which holds its texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _SLICE
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in binary_column(part, "text")]
                sets = [shingle_set(t, words) for t in texts]
                ids, rows = [digest(s) for s in sets], len(sets)
                one = lambda x: pa.array([None] * rows + [x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows + 1, number)),
                        pa.array([*((number << _ROW) + np.arange(rows)).tolist(), None], pa.int64()),
                        pa.concat_arrays([part.column(0).cast(pa.int64()), pa.nulls(1, pa.int64())]),
                        pa.array([*(len(s) for s in sets), None], pa.int64()),
                        pa.array([*ids, b"".join(ids)], pa.binary()),
                        pa.array([*(odd_sketch(s) for s in sets), None], pa.binary()),
                        one(np.array([len(t) for t in texts], np.int64).tobytes()),
                        one(pa.compress(b"".join(texts), codec="zstd", asbytes=True)),
                    ],
                    ["slice", "at", "doc_id", "n", "id", "sketch", "sizes", "texts"],
                )
                number += 1

    return run


_SKETCH = "slice bigint, at bigint, doc_id bigint, n bigint, id binary, sketch binary, sizes binary, texts binary"


def _shingles(words: int, ids: bytes, sizes: bytes, texts: bytes) -> tuple[list[bytes], list[np.ndarray], list[int]]:
    """Ids and sets of a slice, and the positions of its different items."""
    sets = [shingle_set(bytes(t), words) for t in _unpack(sizes, texts)]
    ids = [ids[k : k + 16] for k in range(0, len(ids), 16)]
    return ids, sets, _once(ids, sets)


def _send(words: int, buckets: int):
    """(slice, id, sizes, texts) to (bucket, slice, keys, counts): the distinct shingles of a slice and how many items have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *packs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, sets, once = _shingles(words, *packs)
                if not once:
                    continue
                keys, counts = np.unique(np.concatenate([np.unique(_keys(sets[k], buckets)) for k in once]), return_counts=True)
                present, starts = np.unique(keys >> np.uint64(32), return_index=True)
                ends = np.append(starts[1:], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present.astype(np.int32)), pa.array(np.full(len(present), number)), packed((keys & _LOW).astype(np.uint32), starts, ends),
                     packed(np.minimum(counts, 65535).astype(np.uint16), starts, ends)],
                    ["bucket", "slice", "keys", "counts"],
                )

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, slice, keys, counts) sorted by bucket to (slice, bucket, classes): logarithms of the counts of all slices."""

    def whole(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["keys"].combine_chunks()]
        times = [np.frombuffer(x.as_buffer(), np.uint16) for x in table["counts"].combine_chunks()]
        _, of = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(of, np.concatenate(times))
        classes = np.log2(total).astype(np.uint8)[of]
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        some = np.add.reduceat(classes > 0, starts) > 0
        return pa.RecordBatch.from_arrays(
            [table["slice"].combine_chunks().filter(pa.array(some)), table["bucket"].combine_chunks().filter(pa.array(some)), packed(classes, starts[some], ends[some])],
            ["slice", "bucket", "classes"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and start < end and held[0].column(0)[0].as_py() != bucket[start]:
                yield whole(held)
                held = []
            if start < end:
                held.append(batch.slice(start, end - start))
    if held:
        yield whole(held)


def _prefixes(words: int, percent: int, buckets: int):
    """A slice of texts and the classes of its shingles to (cell, id) for the shared shingles in prefixes."""

    def run(texts: pa.Table, classes: pa.Table) -> pa.Table:
        trim()
        ids, cells, owners = [], [], []
        if classes.num_rows:
            ids, sets, once = _shingles(words, *(texts[c][0].as_py() for c in ("id", "sizes", "texts")))
            keys = np.unique(np.concatenate([_keys(sets[k], buckets) for k in once]))
            kind = np.zeros(len(keys), np.uint8)
            start = np.searchsorted(keys >> np.uint64(32), classes["bucket"].to_numpy().astype(np.uint64))
            for s, blob in zip(start.tolist(), classes["classes"].to_pylist(), strict=True):
                kind[s : s + len(blob)] = np.frombuffer(blob, np.uint8)
            for k in once:
                found = sets[k]
                late = kind[np.searchsorted(keys, _keys(found, buckets))]
                size = len(found) - -(-percent * len(found) // 100) + 1 - int((late == 0).sum())
                if size > 0:
                    shared = late > 0
                    found, late = found[shared], late[shared]
                    cells.append(found[np.lexsort((found, late))[:size]])
                    owners.append(k)
        lengths = [len(c) for c in cells]
        of = np.repeat(np.array(owners, np.int64), lengths)
        cell = np.concatenate(cells).view(np.int64) if cells else np.empty(0, np.int64)
        return pa.table({"cell": pa.array(cell), "id": pa.array(ids, pa.binary()).take(pa.array(of))})

    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sizes, texts, rows) to (id, body) of the rows of a slice."""
    for batch in batches:
        for ids, sizes, texts, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole = _unpack(sizes, texts)
            yield pa.RecordBatch.from_arrays([pa.array([ids[16 * r : 16 * r + 16] for r in rows], pa.binary()), pa.array([whole[r] for r in rows], pa.binary())], ["id", "body"])


def _set_of(body, words: int) -> np.ndarray:
    return shingle_set(bytes(body), words)


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included).

    Documents link when 100 * |A n B| >= ``percent`` * |A u B| over their distinct ``words``-word
    shingles (ASCII-lower-cased; words are runs of anything but ASCII white space); a shorter text
    is one shingle. Null and word-less texts are empty and link with nothing. Repeated rows and
    equal ids come out one row each; a null id's component is that of the documents it links with,
    null if there are none. An empty table gives an empty result; other columns of ``docs``, whatever
    their names, are not read. The two sets of a comparison are told apart by 64-bit hashes of their
    shingles, items by 128-bit digests.
    """
    spark = docs.sparkSession
    buckets = buckets_of(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    both = materialise(rows.mapInArrow(lean(_sketch(words)), _SKETCH), "ngram-sketch")
    sketch = both.filter("at is not null")
    texts = both.filter("at is null").select("slice", "id", "sizes", "texts")
    counted = texts.mapInArrow(lean(_send(words, buckets)), "bucket int, slice bigint, keys binary, counts binary")
    classes = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_count), "slice bigint, bucket int, classes binary")
    postings = texts.groupBy("slice").cogroup(classes.groupBy("slice")).applyInArrow(_prefixes(words, percent, buckets), "cell bigint, id binary")
    cells = materialise(shared_cells(postings, "ngram-shared"), "ngram-cells")

    items = sketch.filter("n > 0").groupBy("id").agg(F.min("at").alias("at"), F.min("doc_id").alias("first"))
    items = materialise(items, "ngram-items")
    wanted = items.join(small_enough(materialise(cells.select("id").distinct(), "ngram-wanted")), "id").select("at")
    wanted = materialise(wanted, "ngram-places")
    info = materialise(sketch.select("at", "id", "n", "sketch").join(small_enough(wanted), "at").select("id", "n", "sketch"), "ngram-info")
    chosen = wanted.groupBy(F.shiftright("at", _ROW).alias("slice")).agg(F.collect_list(F.col("at").bitwiseAND((1 << _ROW) - 1)).alias("rows"))
    chosen = texts.join(small_enough(materialise(chosen, "ngram-rows")), "slice").select("id", "sizes", "texts", "rows")
    whole = materialise(chosen.mapInArrow(lean(_pick), "id binary, body binary"), "ngram-bodies")
    bodies = lambda ids: whole.join(small_enough(ids), "id", "left_semi")
    roots = components(links(cells, info, bodies, partial(_set_of, words=words), percent))
    least = materialise(items.join(small_enough(roots), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "first"), "ngram-roots")
    linked = least.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = materialise(least.join(linked, "root").select("id", "component_id"), "ngram-groups")
    named = looked_up(sketch.filter("n > 0"), groups, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(sketch.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
