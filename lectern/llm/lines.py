"""Fuzzy line deduplication: MinHash candidates, exact Jaccard, distributed union-find.

Lines are compared on their sets of 8-character shingles after trimming and lower-casing A-Z. A
line's MinHash signature is cut into bands; lines with an equal band meet in a cell, where exact
Jaccard similarities link them (pivots, windows and sketches, so a crowd of near copies is never
compared pair by pair). Of each component the first line stays: smallest document id, then place.

Bands travel packed: each slice of texts sends its band hashes by bucket, with the ids of their lines,
and only bands of two different lines come out as rows. A band that many lines of one slice share goes
around the buckets; a mark tells its bucket to let the band's other lines through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.llm.common import binary_column, buckets_of, lean, looked_up, materialise, packed, slices, small_enough
from lectern.llm.components import components
from lectern.llm.metric import links, shared_cells
from lectern.llm.shingles import LOWER, mix
from lectern.llm.sketches import odd_sketch

SHINGLE = 8
#: Bands of four hashes: a pair of similarity 0.8 shares a band with probability 0.998.
BANDS, BAND_ROWS = 12, 4
#: Lines of one slice that make a band go around its bucket.
CROWD = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = b" \t\n\x0b\x0c\r"


def normal(line: bytes) -> bytes:
    return line.translate(LOWER).strip(_BLANK)


def character_hashes(text: str) -> np.ndarray:
    """Hash of the shingle that starts at each character (the last few are not whole)."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(0, len(points) - SHINGLE + 1)
    out = np.full(n, SHINGLE, np.uint64)
    for j in range(SHINGLE):
        out = (out ^ points[j : j + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def line_set(body) -> np.ndarray:
    """Sorted distinct shingle hashes of one normalised line; a shorter line is one shingle."""
    text = bytes(body).decode()
    found = character_hashes(text)
    if not len(found):
        found = character_hashes(text.ljust(SHINGLE, "\0"))
    return np.unique(found)


def line_id(line: bytes) -> bytes:
    """128-bit id of a normalised line."""
    return hashlib.blake2b(line, digest_size=16).digest()


def eligible(text: bytes | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(place, normalised line) of the lines of at least ``min_chars`` characters."""
    lines = [(i, x.strip(_BLANK)) for i, x in enumerate((text or b"").translate(LOWER).split(b"\n"))]
    return [(i, x) for i, x in lines if len(x) >= min_chars and (len(x) >= 4 * min_chars or len(x.decode()) >= min_chars)]


def signatures(lines: list[bytes]) -> np.ndarray:
    """Band hashes (lines x BANDS); a line under ``SHINGLE`` characters is one shingle, as in ``line_set``."""
    texts = [x.decode().ljust(SHINGLE, "\0") for x in lines]
    hashes = character_hashes("".join(texts))
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    # Positions whose shingle runs over the end of its line are left out.
    keep = np.ones(len(hashes), bool)
    for j in range(1, SHINGLE):
        at = ends - j
        keep[at[at < len(hashes)]] = False
    first = np.concatenate(([0], np.cumsum(keep)))[starts]
    hashes = (hashes[keep] >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(2024)
    odd = rng.integers(0, 1 << 31, BANDS * BAND_ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(lines), BANDS), np.uint64)
    scratch = np.empty_like(hashes)
    for b in range(BANDS):
        band = np.full(len(lines), b, np.uint64)
        for m in odd[b * BAND_ROWS : (b + 1) * BAND_ROWS]:
            np.multiply(hashes, m, out=scratch)
            band = mix(band ^ np.minimum.reduceat(scratch, first)) + _ODD
        out[:, b] = band
    return out.view(np.int64)


def _occurrences(min_chars: int):
    """(r1, r2, doc_id, text) to (r1, r2, doc_id, place, id), one for each eligible line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [eligible(t, min_chars) for t in binary_column(part, "text")]
                of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                place = pa.array([i for f in found for i, _ in f], pa.int32())
                ids = pa.array([line_id(x) for f in found for _, x in f], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(of) for k in range(3)), place, ids], ["r1", "r2", "doc_id", "place", "id"])

    return run


def _distinct(part: pa.RecordBatch, min_chars: int) -> dict[bytes, bytes]:
    return {line_id(x): x for t in binary_column(part, "text") for _, x in eligible(t, min_chars)}


def _bands(min_chars: int, buckets: int):
    """Texts to packed band hashes (bucket, keys, ids); rows without keys hold whole cells and ids, past their bucket.

    A line of one shingle equals what it links with, which is the same item, so it needs no band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = {i: x for i, x in _distinct(part, min_chars).items() if len(x) > SHINGLE}
                if not lines:
                    continue
                ids, bodies, bands, step = np.frombuffer(b"".join(lines), np.uint64).reshape(-1, 2), list(lines.values()), [], 1024
                for s in range(0, len(bodies), step):
                    bands.append(signatures(bodies[s : s + step]).view(np.uint64))
                flat = np.concatenate(bands).ravel()
                keys = ((flat >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (flat & np.uint64(0xFFFFFFFF))
                order = np.argsort(keys, kind="stable")
                keys, ids = keys[order], ids[order // BANDS]
                heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                size = np.diff(np.append(heads, len(keys)))
                crowded = np.repeat(size > CROWD, size)
                around = np.column_stack((keys[crowded], ids[crowded]))
                mark = keys[heads[size > CROWD]]
                keys, ids = np.concatenate((keys[~crowded], mark)), np.concatenate((ids[~crowded], np.zeros((len(mark), 2), np.uint64)))
                order = np.argsort(keys, kind="stable")
                keys, ids = keys[order], ids[order]
                present, starts = np.unique(keys >> np.uint64(32), return_index=True)
                ends = np.append(starts[1:], len(keys)).astype(np.int64)
                cuts = np.arange(0, len(around), 4096)
                turn = (around[cuts, 1] % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((present.astype(np.int32), turn))),
                     pa.concat_arrays([packed((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), starts, ends), pa.nulls(len(cuts), pa.binary())]),
                     pa.concat_arrays([packed(ids.view("V16").ravel(), starts, ends), pa.array([around[c : c + 4096].tobytes() for c in cuts], pa.binary())])],
                    ["bucket", "keys", "ids"],
                )

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, ids) sorted by bucket to (cell, id) of the bands that two lines share."""

    def rows(cells: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        starts = np.arange(len(cells))
        return pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), packed(np.ascontiguousarray(ids).view("V16").ravel(), starts, starts + 1)], ["cell", "id"])

    def whole(bucket: int, keys: list[bytes], ids: list[bytes]) -> pa.RecordBatch:
        key, line = np.frombuffer(b"".join(keys), np.uint32), np.frombuffer(b"".join(ids), np.uint64).reshape(-1, 2)
        order = np.lexsort((line[:, 0], key))
        key, line = key[order], line[order]
        new = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]).any(1))
        key, line = key[new], line[new]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(heads, len(key)))
        keep = np.repeat(size > 1, size) & line.any(1)
        return rows(np.uint64(bucket << 32) | key[keep].astype(np.uint64), line[keep])

    bucket, keys, ids = None, [], []
    for batch in batches:
        for b, k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k is None:
                around = np.frombuffer(i, np.uint64).reshape(-1, 3)
                yield rows(np.ascontiguousarray(around[:, 0]), around[:, 1:])
                continue
            if keys and b != bucket:
                yield whole(bucket, keys, ids)
                keys, ids = [], []
            bucket = b
            keys.append(k)
            ids.append(i)
    if keys:
        yield whole(bucket, keys, ids)


def _bodies(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = {i: x for i, x in _distinct(part, min_chars).items() if len(x) > SHINGLE}
                yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.binary()), pa.array(list(lines.values()), pa.binary())], ["id", "body"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, body) to (id, n, sketch, body)."""
    for batch in batches:
        sets = [line_set(x.as_buffer()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([odd_sketch(s) for s in sets], pa.binary()), batch.column(1)],
            ["id", "n", "sketch", "body"],
        )


def _row_key(id_col: str, text_col: str) -> tuple:
    """Two 64-bit hashes that stand for a row's id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col))


def repeated_lines(docs: DataFrame, *, id_col: str, text_col: str, min_chars: int, percent: int) -> DataFrame:
    """(r1, r2, places): for each document row (hashes of id and text) the lines that are not the first of their component.

    First is the smallest (id, row, place), null ids before others. Rows that lose nothing, null, empty and blank texts do
    not occur; repeated rows occur once. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    r1, r2 = _row_key(id_col, text_col)
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    places = rows.mapInArrow(lean(_occurrences(min_chars)), "r1 bigint, r2 bigint, doc_id bigint, place int, id binary")
    places = materialise(places, "line-places")
    text = rows.select("text")
    bands = text.mapInArrow(lean(_bands(min_chars, buckets_of(spark))), "bucket int, keys binary, ids binary")
    bands = bands.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_meet), "cell bigint, id binary")
    cells = materialise(shared_cells(bands, "line-shared"), "line-cells")
    wanted = materialise(cells.select("id").distinct(), "line-wanted")
    # The same line in many documents is one item, whatever its number of copies.
    bodies = text.mapInArrow(lean(_bodies(min_chars)), "id binary, body binary").join(small_enough(wanted), "id", "left_semi").dropDuplicates(["id"])
    info = materialise(bodies.mapInArrow(lean(_sketches), "id binary, n bigint, sketch binary, body binary"), "line-info")
    whole = lambda ids: info.select("id", "body").join(small_enough(ids), "id", "left_semi")
    roots = components(links(cells, info.select("id", "n", "sketch"), whole, line_set, percent))
    grouped = looked_up(places, roots, "id", "left").select(
        F.coalesce("root", "id").alias("root"), F.struct("doc_id", "r1", "r2", "place").alias("at")
    )
    grouped = materialise(grouped, "line-groups")
    several = grouped.groupBy("root").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialise(several.select("root", "first"), "line-first")
    lost = looked_up(grouped, first, "root").filter("at <> first")
    return lost.groupBy(F.col("at.r1").alias("r1"), F.col("at.r2").alias("r2")).agg(F.collect_set("at.place").alias("places"))


def _without_places(names: list[str], text_col: str, places_col: str):
    """Rows with the numbers of the lines to leave out, to rows without these lines, with n_lines and n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts, keep, counts, removed = binary_column(part, text_col), [], [], []
                for k, places in enumerate(part.column(part.schema.get_field_index(places_col)).to_pylist()):
                    text = texts[k]
                    counts.append(text.count(b"\n") + 1 if text is not None else 0)
                    removed.append(len(places or ()))
                    if places:
                        gone = set(places)
                        texts[k] = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in gone])
                    keep.append(not places or bool(texts[k].strip()))
                columns = {c: part.column(part.schema.get_field_index(c)) for c in names}
                columns[text_col] = pa.array(texts, pa.binary()).cast(pa.string())
                columns |= {"n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(keep, pa.bool_()))

    return run


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, percent: int = 80,
) -> DataFrame:
    """``docs`` with one line kept of each component of near-equal lines; adds n_lines and n_removed.

    Lines under ``min_chars`` characters (trimmed) always stay. Lines link if the Jaccard similarity
    of their 8-character shingles is at least ``percent`` per cent. A document that loses its last
    non-blank line goes; null, empty and blank texts stay as they are, with no line removed.
    Repeated rows (same id, same text) count as one document and all keep the same lines; a null id
    comes before all others. Columns of docs named n_lines, n_removed are replaced, others pass. Candidates come from MinHash bands; what they
    offer is decided exactly.
    """
    lost = materialise(repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, percent=percent), "lines-lost")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any column of docs
    r1, r2 = _row_key(id_col, text_col)
    keyed = docs.select(*names, r1.alias(own + "1"), r2.alias(own + "2"))
    gone = lost.select(F.col("r1").alias(own + "1"), F.col("r2").alias(own + "2"), F.col("places").alias(own + "places"))
    joined = keyed.join(small_enough(gone), [own + "1", own + "2"], "left").select(*names, own + "places")
    schema = StructType([*docs.select(*names).schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return joined.mapInArrow(lean(_without_places(names, text_col, own + "places")), schema)
