"""Benchmark decontamination with one Aho-Corasick automaton.

Test items (questions, answers) and texts are normalised alike: A-Z to lower case, words are runs
of ASCII digits, letters and non-ASCII characters. Every window of ``window`` consecutive item
words is a pattern of one automaton; each text runs through it once, and matches are mapped back
to word positions and to code-point offsets of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import binary_column, lean, materialise, slices, small_enough

#: Bytes of windows (each of an item's words is in up to ``window`` of them) that one automaton takes; items beyond that are
#: dealt to several automata of about this size, with one scan each.
AUTOMATON_BYTES = 64 << 20

#: Byte table: A-Z to a-z, other ASCII outside [0-9a-z] to a space, UTF-8 bytes of non-ASCII kept.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

SCAN_SCHEMA = (
    "n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, "
    "contaminated boolean, spans array<struct<start:int,end:int>>"
)

NAMES = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"]

_built: dict[str, ahocorasick.Automaton] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def patterns_of(items: list[tuple], window: int) -> dict[str, tuple[int, tuple[int, ...]]]:
    """Pattern text -> (its number of words, positions in ``items`` that have it)."""
    found: dict[str, tuple[int, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            owners = found.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), []))[1]
            if not owners or owners[-1] != k:
                owners.append(k)
    return {p: (n, tuple(ks)) for p, (n, ks) in found.items()}


def automaton_of(key: str, patterns: dict) -> ahocorasick.Automaton | None:
    """Built once per Python worker; one at a time is held."""
    if key not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for text, value in patterns.items():
            found.add_word(text, value)
        if patterns:
            found.make_automaton()
        _built[key] = found if patterns else None
    return _built[key]


def scan_text(found: ahocorasick.Automaton | None, text: bytes | None) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, indices of hit words, positions of items that occur."""
    words = words_of(text)
    if found is None or not words:
        return len(words), np.empty(0, np.int64), set()
    flat = b" ".join([b"", *words, b""])
    matches = list(found.iter(flat.decode("latin-1")))
    if not matches:
        return len(words), np.empty(0, np.int64), set()
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    after = np.searchsorted(gaps, np.fromiter((e for e, _ in matches), np.int64, len(matches)))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, after - np.fromiter((v[0] for _, v in matches), np.int64, len(matches)), 1)
    np.add.at(edge, after, -1)
    return len(words), np.flatnonzero(np.cumsum(edge[:-1]) > 0), {k for _, v in matches for k in v[1]}


def original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of adjacent hit words as code-point spans of the original text, end exclusive."""
    raw = np.frombuffer(text.translate(WORD_BYTES), np.uint8)
    inside = np.concatenate(([0], (raw != 32).astype(np.int8), [0]))
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))]
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in zip(first, last, strict=True)]


def _item_parts(benchmark: DataFrame, item_id: str, text_col: str, window: int) -> list[list[tuple]]:
    """The items (name, text) of each automaton."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size * window // AUTOMATON_BYTES))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    return [[(r["i"], r["t"].encode()) for r in (items if parts == 1 else items.filter(part == k)).collect()] for k in range(parts)]


def scan(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 13, min_share: float = 0.05, keep: list[str] | None = None,
) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, spans to mask.

    Returns the columns ``keep`` (default: ``doc_id``) and those of ``SCAN_SCHEMA``. A document is
    contaminated if some word is hit and the hit words are at least ``min_share`` of its words. A
    null or word-less text has no words and is clean. An item shorter than ``window`` is one
    pattern; an item without words or with null text is none; a null item_id is never reported by
    name but its windows count. Rows are kept as they come, repeated ones too.

    Items whose windows do not fit in ``AUTOMATON_BYTES`` are dealt to several automata with one scan each; what
    the scans hit in a text is united and judged as a whole, so the result does not depend on their number.
    ``keep`` must not name one of the result's columns.
    """
    keep = ["doc_id"] if keep is None else keep
    if set(NAMES) & set(keep):
        raise ValueError("keep names an output column")
    parts = _item_parts(benchmark, item_id, item_text, window)
    if len(parts) > 1:
        return _scan_in_parts(docs, parts, window, min_share, text_col, keep)
    run = _scanner(docs, parts[0], window, min_share, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = list(run(part))
                out = [part.column(part.schema.get_field_index(c)) for c in keep]
                for i, kind in enumerate(_kinds()):
                    out.append(pa.array([f[i] for f in found], kind))
                yield pa.RecordBatch.from_arrays(out, [*keep, *NAMES])

    source = docs.select(*dict.fromkeys([*keep, text_col]))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(lean(rows), f"{kept}, {SCAN_SCHEMA}")




def _scanner(docs: DataFrame, items: list[tuple], window: int, min_share: float, text_col: str):
    names = [i for i, _ in items]
    shared = docs.sparkSession.sparkContext.broadcast(patterns_of(items, window))
    key = f"{window}-{hashlib.sha1(repr(items).encode()).hexdigest()}"

    def run(part: pa.RecordBatch) -> Iterator[tuple]:
        found = automaton_of(key, shared.value)
        for text in binary_column(part, text_col):
            n, hit, owners = scan_text(found, text)
            yield _judged(text, n, hit, [(names[k], k) for k in owners], min_share)

    return run


def _judged(text: bytes | None, n: int, hit: np.ndarray, owners: list[tuple[str | None, int]], min_share: float) -> tuple:
    got = sorted({name for name, _ in owners if name is not None})
    bad = len(hit) > 0 and len(hit) >= min_share * n - 1e-9
    return n, len(hit), len(set(owners)), got, hashlib.sha256(",".join(got).encode()).hexdigest(), bad, original_spans(text, hit) if len(hit) else []


def _scan_in_parts(docs: DataFrame, parts: list[list[tuple]], window: int, min_share: float, text_col: str, keep: list[str]) -> DataFrame:
    """Each part's hits by hashes of the text, united and joined back to the rows."""
    spark = docs.sparkSession
    key = (F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col)))
    texts = docs.select(*(k.alias(f"_t{i}") for i, k in enumerate(key)), F.col(text_col).cast("string").alias("_text")).filter("_text is not null")
    found = None
    for number, items in enumerate(parts):
        shared, at = spark.sparkContext.broadcast(patterns_of(items, window)), f"{window}-{hashlib.sha1(repr(items).encode()).hexdigest()}"

        def hits(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "_text"):
                    rows = [scan_text(automaton_of(at, shared.value), t)[1:] for t in binary_column(part, "_text")]
                    some = pa.array([len(hit) > 0 for hit, _ in rows], pa.bool_())
                    columns = [part.column(0), part.column(1), pa.array([h.astype(np.int64).tobytes() for h, _ in rows], pa.binary()), pa.array([sorted(o) for _, o in rows], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["_t0", "_t1", "hit", "owners"]).filter(some)

        one = texts.mapInArrow(lean(hits), "_t0 bigint, _t1 bigint, hit binary, owners array<int>").dropDuplicates(["_t0", "_t1"]).withColumn("part", F.lit(number))
        one = materialise(one, "decontaminate-part")
        found = one if found is None else found.unionByName(one)
    # At most one entry for each part and distinct text.
    united = materialise(found.groupBy("_t0", "_t1").agg(F.collect_list(F.struct("part", "hit", "owners")).alias("_found")), "decontaminate-hits")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"), *(k.alias(f"_t{i}") for i, k in enumerate(key)))
    rows = rows.join(small_enough(united), ["_t0", "_t1"], "left").select(*keep, "_text", "_found")
    names = [[i for i, _ in items] for items in parts]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                out = []
                for text, entries in zip(binary_column(part, "_text"), part.column(part.schema.get_field_index("_found")).to_pylist(), strict=True):
                    hit = np.unique(np.concatenate([np.empty(0, np.int64), *(np.frombuffer(e["hit"], np.int64) for e in entries or [])]))
                    owners = [(names[e["part"]][k], e["part"] << 32 | k) for e in entries or [] for k in e["owners"]]
                    out.append(_judged(text, len(words_of(text)), hit, owners, min_share))
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in out], k) for i, k in enumerate(_kinds()))], [*keep, *NAMES])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(lean(judge), f"{kept}, {SCAN_SCHEMA}")


def _kinds() -> list[pa.DataType]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.list_(span)]


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 13, min_share: float = 0.05,
) -> DataFrame:
    """``docs`` without contaminated rows, columns as they were; one scan, no shuffle, where one automaton holds the items.

    A null or word-less text is clean and stays, as do repeated rows; an empty benchmark drops nothing.
    """
    parts = _item_parts(benchmark, item_id, item_text, window)
    if len(parts) > 1:
        own = "_" * (1 + max(map(len, docs.columns)))
        whole = docs.select(F.struct("*").alias(own), F.col(text_col).alias(own + "text"))
        judged = _scan_in_parts(whole, parts, window, min_share, own + "text", [own])
        return judged.filter("not contaminated").select(F.col(f"{own}.*"))
    run = _scanner(docs, parts[0], window, min_share, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([not f[5] for f in run(part)], pa.bool_()))

    return docs.mapInArrow(lean(rows), docs.schema)
