"""Keyword and vector indexes as tables: build, upsert, delete."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType
from pyspark.sql.window import Window

from lectern.functions.text import tokenize
from lectern.sources.scratch import small_enough, written


def hashing_embed(texts: DataFrame, keys: str | list[str], text: str, dim: int = 256) -> DataFrame:
    """(keys, embedding) by hashed token counts, L2-normalised; a text without tokens is all zeros. ``dim`` must be 256 or less by a power of two.

    Tokens are found natively. Each distinct one of an Arrow batch is hashed there, and counted inside its row.
    """
    keys = [keys] if isinstance(keys, str) else keys
    return _embedded(texts.select(*keys, tokenize(F.col(text)).alias("words")), keys, dim)


def embed_bags(bag: DataFrame, keys: list[str], dim: int = 256) -> DataFrame:
    """As ``hashing_embed``, from the counted tokens of ``bags``."""
    return _embedded(bag.select(*keys, F.col("terms").alias("words"), "tfs"), keys, dim)


def hashed(texts: pa.ListArray, dim: int = 256) -> np.ndarray:
    """As ``hashing_embed``, of the tokens of a few texts, in its single precision but as doubles."""
    row, word, names = _coded(texts)
    return _unit_counts(len(texts), row, word, names, None, dim).astype(float)


def _unit_counts(n_rows: int, row: np.ndarray, word: np.ndarray, names: list[str], tf: np.ndarray | None, dim: int) -> np.ndarray:
    bucket = np.array([md5(w.encode()).digest()[-1] % dim for w in names], np.int64)
    n = np.bincount(row * dim + bucket[word], tf, n_rows * dim).reshape(-1, dim).astype(np.float64)
    norm = np.sqrt((n * n).sum(1, keepdims=True))
    return np.divide(n, norm, out=np.zeros_like(n), where=norm > 0).astype(np.float32)


def _embedded(rows: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """(keys, embedding) of (keys, words, tfs); without tfs each word counts once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_048):  # of few rows at a time, as a vector is larger than most texts
                batch = whole.slice(start, 2_048)
                row, word, names = _coded(batch.column(len(keys)))
                tf = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).astype(float) if batch.num_columns > len(keys) + 1 else None
                vectors = _unit_counts(batch.num_rows, row, word, names, tf, dim)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * dim + 1, dim), pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], [*keys, "embedding"])

    return rows.mapInArrow(count, StructType([*rows.select(*keys).schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def _coded(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of a column of word lists: each word's row and number, and the words by number."""
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    seen = words.flatten().dictionary_encode()
    return row, seen.indices.to_numpy(zero_copy_only=False).astype(np.int64), seen.dictionary.to_pylist()


def bags(chunks: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(kb_id, chunk_id, extra, dl, terms, tfs): each chunk's tokens, counted inside its row; no rows move."""
    names = ["kb_id", "chunk_id", *(extra or [])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_048):
                batch = whole.slice(start, 2_048)
                row, word, known = _coded(batch.column(len(names)))
                # A pair of row and word is one number; the batch's words are numbered anew, so it stays small.
                pairs, tf = np.unique(row * max(1, len(known)) + word, return_counts=True)
                owner, term = np.divmod(pairs, max(1, len(known)))
                ends = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(ends, pa.array(known, pa.string()).take(pa.array(term)))
                dl = pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], dl, terms, pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], [*names, "dl", "terms", "tfs"])

    rows = chunks.select(*names, tokenize(F.col("text")).alias("words"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.mapInArrow(count, f"{kept}, dl bigint, terms array<string>, tfs array<bigint>")


def corpus_stats(bag: DataFrame) -> DataFrame:
    """(kb_id, n, total): chunks of each knowledge base and their tokens; sums, so parts of an index add up."""
    return bag.groupBy("kb_id").agg(F.count("*").alias("n"), F.sum("dl").alias("total"))


def term_stats(bag: DataFrame) -> DataFrame:
    """(kb_id, term, df), of which parts of an index add up, too."""
    return bag.select("kb_id", F.explode("terms").alias("term")).groupBy("kb_id", "term").agg(F.count("*").alias("df"))


def idf(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """(kb_id, term, idf, avgdl) from ``term_stats`` and ``corpus_stats``."""
    weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return terms.join(corpus, "kb_id").select("kb_id", "term", weight.alias("idf"), (F.col("total") / F.col("n")).alias("avgdl"))


def bm25_index(chunks: DataFrame) -> DataFrame:
    """Postings with what scoring needs: (kb_id, chunk_id, term, tf, dl, idf, avgdl), statistics per knowledge base."""
    bag = written(bags(chunks), "bags")
    return postings(bag, idf(term_stats(bag), corpus_stats(bag)))


def postings(bag: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The bags' terms one a row, with their weights (written in folders ``by`` columns), which come to the terms as long as they are a small table."""
    post = bag.select("kb_id", "chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("kb_id", "chunk_id", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    return post.join(small_enough(written(weights, "weights", by)), ["kb_id", "term"]).select("kb_id", "chunk_id", "term", "tf", "dl", "idf", "avgdl")


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows in place of those with their keys, others kept; of repeated new keys the caller decides."""
    return current.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def delete_documents(current: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of no (kb_id, doc_id) in ``gone``."""
    return current.join(gone.select("kb_id", "doc_id"), ["kb_id", "doc_id"], "left_anti").select(*current.columns)


def reindex_documents(current: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` replaced by its rows."""
    return delete_documents(current, new.select("kb_id", "doc_id").distinct()).select(*new.columns).unionByName(new)


class StoredIndex:
    """A keyword index on disk, one folder for each knowledge base, grown by segments.

    ``bags/kb_id=K/segment=S`` holds chunks, ``gone/kb_id=K/segment=S`` the documents whose chunks of earlier segments no
    longer count, ``terms`` and ``corpus`` what the segment adds to document frequencies, chunk counts and lengths (less than nothing
    for what it takes away). A change reads and writes the folders of its own knowledge bases only, and what a search needs
    of statistics is a sum of small tables. A segment that is written again replaces itself.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, schema: str, kbs: list[int] | None) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{schema}, kb_id bigint, segment int")
        rows = self.spark.read.schema(f"{schema}, kb_id bigint, segment int").parquet(f"{self.path}/{name}")
        return rows if kbs is None else rows.filter(F.col("kb_id").isin(kbs))

    def _write(self, name: str, rows: DataFrame, segment: int) -> None:
        out = rows.withColumn("segment", F.lit(segment)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("kb_id", "segment").parquet(f"{self.path}/{name}")

    def bags(self, kbs: list[int] | None = None, before: int = 1 << 30) -> DataFrame:
        """Chunks that count: (kb_id, chunk_id, doc_id, dl, terms, tfs) of all or the given knowledge bases, as of the segments ``before`` one."""
        rows = self._table("bags", "chunk_id string, doc_id bigint, dl bigint, terms array<string>, tfs array<bigint>", kbs)
        rows = rows.filter(F.col("segment") < before)
        gone = self._table("gone", "doc_id bigint", kbs).filter(F.col("segment") < before).groupBy("kb_id", "doc_id").agg(F.max("segment").alias("until"))
        live = rows.join(gone, ["kb_id", "doc_id"], "left").filter(F.col("until").isNull() | (F.col("segment") >= F.col("until")))
        return live.select("kb_id", "chunk_id", "doc_id", "dl", "terms", "tfs")

    def weights(self, kbs: list[int] | None = None) -> DataFrame:
        """(kb_id, term, idf, avgdl) as the sum of what the segments added."""
        terms = self._table("terms", "term string, df bigint", kbs).groupBy("kb_id", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        corpus = self._table("corpus", "n bigint, total bigint", kbs).groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return idf(terms, corpus)

    def change(self, chunks: DataFrame, deleted: DataFrame, segment: int) -> None:
        """All chunks of the documents in ``chunks`` (kb_id, doc_id, chunk_id, text) in place of theirs; those of ``deleted`` (kb_id, doc_id) gone."""
        new = written(bags(chunks, ["doc_id"]), "segment")
        gone = written(deleted.select("kb_id", "doc_id").unionByName(new.select("kb_id", "doc_id")).distinct(), "gone")
        kbs = [r[0] for r in gone.select("kb_id").distinct().collect()]  # knowledge bases that change
        if not kbs:
            return
        earlier = self.bags(kbs, segment) if segment else new.limit(0)
        old = written(earlier.join(gone, ["kb_id", "doc_id"], "left_semi"), "replaced")
        minus = lambda rows, *names: rows.withColumns({c: -F.col(c) for c in names})
        terms = term_stats(new).unionByName(minus(term_stats(old), "df")).groupBy("kb_id", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
        corpus = corpus_stats(new).unionByName(minus(corpus_stats(old), "n", "total")).groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for name, rows in (("terms", terms), ("corpus", corpus), ("gone", gone), ("bags", new)):
            self._write(name, rows, segment)


def write_index(chunks: DataFrame, path: str) -> StoredIndex:
    """A stored index of (kb_id, doc_id, chunk_id, text)."""
    index = StoredIndex(chunks.sparkSession, path)
    index.change(chunks, chunks.select("kb_id", "doc_id").limit(0), 0)
    return index


def load_index(spark, path: str, kbs: list[int] | None = None) -> DataFrame:
    """The postings of a stored index as ``bm25_index`` gives them; only the folders of ``kbs`` are read."""
    index = StoredIndex(spark, path)
    return postings(index.bags(kbs), index.weights(kbs), ("kb_id",))


def index_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with id, caption and dim; rejected rows with a warning) of (kb_id, doc_id, document_name, page_number, image_index, embedding)."""
    bad = F.col("embedding").isNull() | (F.size("embedding") == 0)
    good = images.filter(~bad).withColumns({
        "chunk_id": F.format_string("img_%d:%d:%d", "doc_id", "page_number", "image_index"),
        "content": F.format_string("[图片] %s 第%d页", "document_name", "page_number"), "dim": F.size("embedding"), "modality": F.lit("image"),
    })
    warning = F.format_string("image %d on page %d has no vector", "image_index", "page_number")
    return good, images.filter(bad).select("kb_id", "doc_id", warning.alias("warning"))


def dedup_by_hash(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds first_id: the live document with this content in the knowledge base; a document is accepted if that is itself."""
    live = docs.filter("not is_deleted")
    seen = live.select("kb_id", "file_hash", "doc_id")
    if existing is not None:
        seen = seen.unionByName(existing.filter("not is_deleted").select("kb_id", "file_hash", "doc_id"))
    first = seen.groupBy("kb_id", "file_hash").agg(F.min("doc_id").alias("first_id"))
    return live.join(first, ["kb_id", "file_hash"])


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_k = 1").drop("_k")
