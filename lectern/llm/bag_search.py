"""Ranked lexical search over classes of documents with equal bags of item words.

Documents are restricted to the words of the items. Those with equal term frequencies and equal length part m have
equal scores for every item, so they form one class: found by a digest, verified by their whole vectors, scored
once. The best classes of an item are expanded into their members by ascending id.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import binary_column, materialise, slices, small_enough

#: Byte table of terms: A-Z to a-z, other ASCII outside [0-9a-z] to a space, bytes of non-ASCII characters kept.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of item terms in one block; more items are searched in more blocks, each with a scan of its own.
BLOCK_BYTES = 4 << 20
#: Terms of a long text are counted in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
#: Cells of the dense weights (terms x items) that one worker holds at a time.
WEIGHT_CELLS = 4 << 20
#: Parts that the members of one class are ranked in before its first are taken.
SALTS = 16

_BAGS = "doc_id bigint, n bigint, digest binary, terms array<int>, tfs array<bigint>"
#: Stands for the id of a class whose members have none.
_NO_ID = (1 << 63) - 1


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of a whole text."""
    flat, found, start = (text or b"").translate(TERM_BYTES), Counter(), 0
    while start < len(flat):
        end = flat.find(b" ", start + PIECE_BYTES)
        end = len(flat) if end < 0 else end
        found.update(flat[start:end].split())
        start = end
    return found


def _pairs(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, term): each item's distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, terms = [], []
                for item, text in zip(part.column(0).to_pylist(), binary_column(part, "text"), strict=True):
                    own = sorted(term_counts(text))
                    ids += [item] * len(own)
                    terms += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), pa.array(terms, pa.binary())], ["item", "term"])

    named = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    return named.mapInArrow(run, f"item {named.schema['item'].dataType.simpleString()}, term binary").distinct()


def _bags(shared):
    """Batches of (doc_id, text) to bags: number of all terms, and sorted term numbers with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ns, digests, terms, tfs = [], [], [], []
                for text in binary_column(part, "text"):
                    counts = term_counts(text)
                    own = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                    ns.append(sum(counts.values()))
                    terms.append([t for t, _ in own])
                    tfs.append([c for _, c in own])
                    digests.append(hashlib.blake2b(np.array(own, np.int64).tobytes(), digest_size=16).digest())
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                columns = [pa.array(c, k) for c, k in zip((ns, digests, terms, tfs), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n", "digest", "terms", "tfs"])

    return run


def weight_blocks(terms: np.ndarray, items: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the weights as (sorted terms, items, dense weights), each within ``WEIGHT_CELLS`` or one item."""
    order = np.argsort(items, kind="stable")
    terms, items, weights = terms[order], items[order], weights[order]
    named, starts = np.unique(items, return_index=True)
    ends, first = np.append(starts[1:], len(items)), 0
    while first < len(named):
        last = first + 1
        while last < len(named) and (last + 1 - first) * (ends[last] - starts[first]) <= WEIGHT_CELLS:
            last += 1
        part = slice(starts[first], ends[last - 1])
        own = np.unique(terms[part])
        dense = np.zeros((len(own), last - first), np.int64)
        dense[np.searchsorted(own, terms[part]), np.searchsorted(named[first:last], items[part])] = weights[part]
        yield own, named[first:last], dense
        first = last


def first_of(scores: np.ndarray, firsts: np.ndarray, k: int, floor: int) -> np.ndarray:
    """Indices of the ``k`` largest scores of at least ``floor`` (and above 0), ties to the smaller ``firsts``."""
    at = np.flatnonzero(scores >= max(1, floor))
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((firsts[at], -scores[at]))][:k]


def _score(shared, k: int):
    """Batches of classes to each item's best ``k`` classes of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, best = list(weight_blocks(*shared.value)), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                digests, m, firsts, term, tf = (part.column(part.schema.get_field_index(c)) for c in ("digest", "m", "first", "terms", "tfs"))
                m, firsts = m.to_numpy(), firsts.to_numpy()
                sizes = term.value_lengths().to_numpy()
                ends = np.cumsum(sizes)
                term, tf = term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()
                shares = (1_000_000_000 * tf) // (1_000 * tf + 20 * np.repeat(m, sizes))
                for own, named, dense in blocks:
                    at = np.minimum(np.searchsorted(own, term), len(own) - 1)
                    value = np.where(own[at] == term, shares, 0)
                    scores = np.stack([value[e - s : e] @ dense[at[e - s : e]] for s, e in zip(sizes, ends, strict=True)])
                    for j, item in enumerate(named):
                        held = best.setdefault(int(item), [])
                        for i in first_of(scores[:, j], firsts, k, held[-1][0] if len(held) == k else 0):
                            held.append((int(scores[i, j]), int(firsts[i]), int(m[i]), digests[i].as_py()))
                        held.sort(key=lambda x: (-x[0], x[1]))
                        del held[k:]
        rows = [(item, *x) for item, held in best.items() for x in held]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["at", "score", "first", "m", "digest"])

    return run


def _search_block(bags: DataFrame, pairs: list[tuple[int, int]], n_terms: int, k: int) -> DataFrame:
    """(at, doc_id, score): the best ``k`` documents of each item position in ``pairs`` (position, term number)."""
    spark = bags.sparkSession
    total = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    docs, length = total[0], total[1] or 1
    bags = bags.filter(F.size("terms") > 0).withColumn("m", F.expr(f"50 + (50 * n * {docs}L) div {length}L"))
    df = np.zeros(n_terms, np.int64)
    for r in bags.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row for each term of the block
        df[r["t"]] = r["count"]
    weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df]
    items, terms = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    shared = spark.sparkContext.broadcast((terms, items, np.array(weight, np.int64)[terms]))

    least = F.coalesce(F.min("doc_id"), F.lit(_NO_ID))
    classes = materialise(bags.groupBy("digest", "m", "terms", "tfs").agg(least.alias("first")), "bag-classes")
    top = classes.mapInArrow(_score(shared, k), "at int, score bigint, first bigint, m bigint, digest binary")
    by = Window.partitionBy("at").orderBy(F.desc("score"), "first")
    top = materialise(top.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).drop("r"), "bag-top")

    # Members of the best classes only, told by their whole vectors; the first k of a class are all that can be returned.
    key = ["digest", "m", "first"]
    won = materialise(top.select(*key).distinct(), "bag-won")
    won = materialise(classes.join(small_enough(won), key).select(*key, "terms", "tfs"), "bag-vectors")
    members = bags.join(small_enough(won), ["digest", "m", "terms", "tfs"]).select(*key, "doc_id")
    order = F.asc_nulls_last("doc_id")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    for parts in ([*key, salt], key):
        members = members.withColumn("r", F.row_number().over(Window.partitionBy(*parts).orderBy(order))).filter(F.col("r") <= k).drop("r")
    found = top.join(small_enough(materialise(members, "bag-members")), key)
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("at", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = 50, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score above 0, equal scores by ascending doc_id.

    Terms are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters of whole texts. With N documents
    that have a term, L their terms with repeats, n a document's and df the documents with a term, a term weighs
    w = floor(1000 * ln((2N+2) / (2df+1))) and a document's m is 50 + (50 * n * N) div L; its score sums
    w * ((10^9 * tf) div (1000 * tf + 20 * m)) over the item's distinct terms, in 64-bit integers.

    A null or term-less text is no document; every other row is one, repeated ones too, and rows without an id come last
    among equal scores. Rows of equal item_id are one item with all their terms; items with a null id, a null text or
    without terms return nothing, nor does anything of an empty table. Other columns are not read.

    Items are searched in blocks of about ``block_bytes`` of their terms (told by a hash of the item); each block is one
    scan of the documents, so what is broadcast never grows with the number of items.
    """
    spark = docs.sparkSession
    kind = items.select(F.col(item_id).alias("item_id")).schema
    pairs = materialise(_pairs(items, item_id, item_text), "bag-items")
    size = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for b in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        if not own:
            continue
        names, terms = sorted({r["item"] for r in own}), sorted({bytes(r["term"]) for r in own})
        at, number = {x: i for i, x in enumerate(names)}, {t: i for i, t in enumerate(terms)}
        bags = rows.mapInArrow(_bags(spark.sparkContext.broadcast(number)), _BAGS)
        found = _search_block(materialise(bags, "bag-bags"), [(at[r["item"]], number[bytes(r["term"])]) for r in own], len(terms), k)
        named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], T.StructType([T.StructField("at", T.IntegerType()), *kind.fields]))
        found = found.join(F.broadcast(named), "at").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        schema = T.StructType([*kind.fields, T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return out
