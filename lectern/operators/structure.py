"""Documents to pages and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_chunk_text, strip
from lectern.operators.index import hashed

# What parts a text, from coarse to fine; what looks like a page number or an ornament.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ". ", "，", ",", " ")
NOISE = r"(?iU)^(?:\d{1,4}|第\s*\d+\s*页|page\s*\d+|\d+\s*/\s*\d+)$"

#: White space as the native functions strip it.
BLANK = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def split_pages(text: Column, size: int = 1500) -> Column:
    """Array of page texts as they are: lines are gathered until they have ``size`` characters; blank text is one empty page."""
    state = lambda pages, open_, n: F.struct(pages.alias("pages"), open_.alias("open"), n.alias("n"))
    none = F.array().cast("array<string>")

    def step(s: Column, line: Column) -> Column:
        n = s["n"] + F.length(line)
        held = F.concat(s["open"], F.array(line))
        full = n >= size
        return state(
            F.when(full, F.concat(s["pages"], F.array(F.array_join(held, "\n")))).otherwise(s["pages"]),
            F.when(full, none).otherwise(held), F.when(full, F.lit(0)).otherwise(n),
        )

    done = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["pages"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["pages"])
    pages = F.aggregate(F.split(text, "\n", -1), state(none, none, F.lit(0)), step, done)
    return F.when(strip(F.coalesce(text, F.lit(""))) != "", pages).otherwise(F.array(F.lit("")))


def filter_page_noise(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, text) without lines that repeat on most pages and look like page furniture.

    Documents of at most two pages are unchanged. Counts are per document and line, so a document
    of any length is never gathered to find them; only a page's own lines are.
    """
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = strip(F.col("line"))
    noisy = bare.rlike(NOISE) | ((F.length(bare) <= 3) & ~bare.rlike("[一-鿿]"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    lines = lines.withColumn("bare", bare)
    often = lines.filter((F.col("bare") != "") & noisy).groupBy("doc_id", "bare").agg(F.count_distinct("page_number").alias("n"))
    often = often.join(total, "doc_id").filter("pages > 2 and n >= greatest(2, int(floor(pages * 0.6)))").select("doc_id", "bare")
    kept = lines.join(often, ["doc_id", "bare"], "left_anti")
    texts = kept.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    joined = texts.select("doc_id", "page_number", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("kept"))
    return pages.drop("text").join(joined, ["doc_id", "page_number"], "left").withColumn("text", F.coalesce("kept", F.lit(""))).drop("kept")


def document_stats(pages: DataFrame) -> DataFrame:
    """doc_id, page_count, full_text (non-blank pages in order, blank line between), char_count."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    full = F.array_join(F.transform(F.filter(ordered, lambda p: strip(p["text"]) != ""), lambda p: p["text"]), "\n\n")
    out = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), full.alias("full_text"))
    return out.withColumn("char_count", F.length("full_text").cast("bigint"))


def chunk_fixed(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Array of (chunk_index, text): fixed lengths with overlap; the last chunk ends the text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(i.alias("chunk_index"), text.substr(i * step + 1, F.lit(size)).alias("text")))


def split_sentences(text: Column) -> Column:
    """Cut after sentence marks and line ends, which stay; blank pieces go."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?；;\n])"), strip), lambda s: s != "")


#: Cutting ever finer until no separator is left is cutting at every separator.
BREAK = "|".join(re.escape(x) for x in SEPARATORS)


def segments(text: Column) -> Column:
    """The pieces of a page between separators, blank ones left out."""
    return F.filter(F.transform(F.split(text, "|".join(rf"\Q{x}\E" for x in SEPARATORS), -1), strip), lambda x: x != "")


def pack_segments(pages: list[tuple[int, str]], size: int, overlap: int) -> list[tuple[int, str]]:
    """As ``pack_pieces``, of (page, text) not yet cut."""
    return pack_pieces([(n, [x.strip() for x in re.split(BREAK, text) if x.strip()]) for n, text in pages], size, overlap)


def pack_pieces(pages: list[tuple[int, list[str]]], size: int, overlap: int) -> list[tuple[int, str]]:
    """(page, text) of chunks packed to ``size`` with ``overlap`` characters carried; one document's pages in order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    length, page, fresh = 0, None, False
    for number, pieces in pages:
        for piece in pieces:
            if fresh and length + len(piece) + 1 > size:
                whole = "\n".join(held)
                out.append((page, whole))
                tail = whole[-overlap:].lstrip("\n ") if overlap and len(whole) > overlap else whole if overlap else ""
                held = [tail] if tail else []
                length, fresh = len(tail), False
            if not fresh:
                page = number
            length += len(piece) + bool(held)
            held.append(piece)
            fresh = True
    if fresh:
        out.append((page, "\n".join(held)))
    return out


def chunk_recursive(pages: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, page_number, text) from pages; a size or overlap of 0 means the default.

    Cutting and packing are a sequential fold over one document, done in Python by Arrow batches of whole documents; documents are
    the unit of parallelism.
    """
    size, overlap = size or 512, overlap or 50
    pack = lambda rows: pack_pieces([(r["page_number"], pieces(r["text"] or "")) for r in rows], size, overlap)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page_number"), "text")))
    chunks = _folded(pages.groupBy("doc_id").agg(ordered.alias("rows")), pack)
    return chunks.withColumn("text", normalize_chunk_text(F.col("text")))


def pieces(text: str) -> list[str]:
    """As ``segments``, of one text. The longer separators are replaced before the shorter ones that they hold."""
    for x in SEPARATORS:
        text = text.replace(x, "\n")
    return [y for x in text.split("\n") if (y := x.strip(BLANK))]


def _folded(docs: DataFrame, fold: Callable[[list[dict]], list[tuple[int | None, str | None]]]) -> DataFrame:
    """(doc_id, chunk_index, page_number, text) of what ``fold`` makes of the ``rows`` (an array in order) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):  # a document at a time, as batches may be large
                doc = batch.column(0)[k].as_py()
                out += [(doc, i, *c) for i, c in enumerate(fold(batch.column(1)[k].as_py()))]
                if len(out) >= 4_096:
                    yield _chunk_rows(out)
                    out = []
            yield _chunk_rows(out)

    return docs.select(F.col("doc_id").cast("bigint"), "rows").mapInArrow(run, CHUNKS)


#: What becomes of documents, as rows.
CHUNKS = "doc_id bigint, chunk_index int, page_number int, text string"


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "chunk_index": pa.int32(), "page_number": pa.int32(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def merged_small(chunks: list[tuple[int | None, str | None]], least: int, size: int) -> list[tuple[int | None, str | None]]:
    """Of (page, text) in order: a text shorter than ``least`` joins the one before it if both fit in ``size``; null texts stay alone."""
    out: list[tuple[int | None, str | None]] = []
    held: list[str] = []  # parts of the last text, joined when it is complete
    length = 0
    for page, text in chunks:
        if held and text is not None and len(text) < least and length + len(text) + 1 <= size:
            held.append(text)
            length += len(text) + 1
            continue
        if held:
            out[-1] = (out[-1][0], "\n".join(held))
        out.append((page, text))
        held, length = ([], 0) if text is None else ([text], len(text))
    if held:
        out[-1] = (out[-1][0], "\n".join(held))
    return out


def merge_small_chunks(chunks: DataFrame, least: int = 50, size: int = 512) -> DataFrame:
    """A chunk shorter than ``least`` joins its predecessor if both fit in ``size``; (doc_id, chunk_index, page_number, text), renumbered."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", F.col("page_number").cast("int").alias("page_number"), "text")))
    fold = lambda rows: merged_small([(r["page_number"], r["text"]) for r in rows], least, size)
    return _folded(chunks.groupBy("doc_id").agg(ordered.alias("rows")), fold)


def semantic_spans(lengths: np.ndarray, vectors: np.ndarray, size: int, threshold: float) -> list[tuple[int, int]]:
    """First and last + 1 sentence of each chunk, of one document's sentences in order.

    A chunk that would pass ``size`` ends, and its last sentence opens the next one. A sentence whose
    cosine with the chunk's running mean (each sentence weighs as much as all before it) is below
    ``threshold`` opens a chunk of its own.
    """
    spans, first, used, mean = [], 0, 0, None
    for i, (n, v) in enumerate(zip(lengths.tolist(), vectors, strict=True)):
        if mean is not None and used + n + 1 > size:
            spans.append((first, i))
            first, used, mean = i - 1, lengths[i - 1], vectors[i - 1]
        scale = 0.0 if mean is None else np.sqrt((mean @ mean) * (v @ v))
        if mean is not None and (mean @ v / scale if scale else 0.0) >= threshold:
            used, mean = used + n + 1, (mean + v) / 2
        else:
            spans += [(first, i)] if mean is not None else []
            first, used, mean = i, n, v
    return [*spans, (first, len(lengths))] if len(lengths) else []


def chunk_semantic(sentences: DataFrame, size: int = 512, threshold: float = 0.75, least: int = 50) -> DataFrame:
    """(doc_id, chunk_index, page_number, text) from (doc_id, page_number, pos, text, vector), small chunks merged.

    In place of ``vector`` sentences may have ``words``; they are then embedded as by ``hashing_embed`` where a document is cut, so
    that no vectors move. Where to cut is a fold over one document, whose sentences are brought together once.
    """
    given = "words" not in sentences.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:  # documents of about 2,048 sentences at a time, as a vector is larger than most sentences
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 2_048, "right")))
                yield _chunk_rows(cut(batch.column(0).slice(first, last - first).to_pylist(), batch.column(1).slice(first, last - first)))
                first = last

    def cut(docs: list[int | None], held: pa.ListArray) -> list[tuple]:
        pages, _, texts, what = held.flatten().flatten()
        vectors = np.array(what.to_pylist(), float) if given else hashed(what)
        pages, texts, out, begin = pages.to_pylist(), texts.to_pylist(), [], 0
        for doc, n in zip(docs, held.value_lengths().to_pylist(), strict=True):
            own = texts[begin : begin + n]
            spans = semantic_spans(np.array([len(x) for x in own]), vectors[begin : begin + n], size, threshold)
            chunks = merged_small([(pages[begin + a], "\n".join(own[a:b])) for a, b in spans], least, size)
            out += [(doc, i, *c) for i, c in enumerate(chunks)]
            begin += n
        return out

    what = F.struct(F.col("page_number").cast("int").alias("page_number"), "pos", "text", "vector" if given else "words")
    docs = sentences.groupBy("doc_id").agg(F.array_sort(F.collect_list(what)).alias("rows"))
    return docs.select(F.col("doc_id").cast("bigint"), "rows").mapInArrow(run, CHUNKS)


def chunk_metadata(chunks: DataFrame, extra: Column | None = None) -> DataFrame:
    """Adds chunk_id and a metadata map; own entries win over ``extra`` ones of the same name."""
    own = F.create_map(
        F.lit("knowledge_base_id"), F.col("kb_id").cast("string"), F.lit("document_id"), F.col("doc_id").cast("string"),
        F.lit("page_number"), F.col("page_number").cast("string"), F.lit("document_name"), F.col("document_name"),
    )
    if extra is not None:
        own = F.map_concat(own, F.map_filter(extra, lambda k, _: ~k.isin("knowledge_base_id", "document_id", "page_number", "document_name")))
    return chunks.withColumns({"chunk_id": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(":"), F.col("chunk_index").cast("string")), "metadata": own})


def chunk_strategy_stats(chunks: DataFrame) -> DataFrame:
    """Per strategy: documents, chunks, chunks a document, mean chunk length."""
    return chunks.groupBy("strategy").agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"),
        F.round(F.count("*") / F.count_distinct("doc_id"), 6).alias("per_document"), F.round(F.avg(F.length("text")), 6).alias("mean_length"),
    )
