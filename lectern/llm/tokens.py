"""Token counts with a digest cache.

A text's key is the SHA-256 of its normalised content with the digest of the tokenizer's file. Only
distinct contents that the cache does not hold are encoded; their counts are appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import kept, lean, materialise, scratch_path, slices, small_enough

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens bigint"
#: Words whose counts one Python worker keeps, and the most characters that such a word has.
MEMO_WORDS, MEMO_CHARS = 500_000, 32
#: Copies from which on a content counts as hot: its rows meet their count in a broadcast join.
HOT = 256

#: The byte-level alphabet: a character for each byte, those that print stand for themselves.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _PRINT} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINT)))}


class WordCounter:
    """Token counts of texts from memoised counts of their words.

    A byte-level tokenizer without normaliser never joins what comes before a single space or line feed
    with what follows, so the tokens of a text are those of its words, each with the space or line feed
    before it. Texts in which white space meets white space in another way, or that hold added tokens,
    are encoded whole, as are all texts of other tokenizers.
    """

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        self.by_word = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not any(a[f] for a in added for f in flags)
        )
        self.special = re.compile("|".join(re.escape(a["content"]) for a in added)) if added else None
        self.model, self.memo = self.tokenizer.model, {}
        self.feed, *marks = self.whole(["\n", ",", "."])
        self.marks = dict(zip(",.", marks, strict=True))

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> dict[str, int]:
        """Counts of words with the space before them; those that begin with a line feed have none.

        Left out are words that would have white space before their space or line feed or after it.
        """
        found, others, model, marks = {}, [], self.model.tokenize, self.marks
        for w in words:
            head = w[:1]
            n, body = (self.feed, w[1:]) if head == "\n" else (0, w)
            if body[-1:] in marks:
                n, body = n + marks[body[-1:]], body[:-1]
            if body.isascii() and body.isalpha():  # letters are one piece, which the model takes as it is
                found[w] = n + len(model(body if head == "\n" else "\u0120" + body))
            elif body.isalpha() and max(body) < "\u0250":
                body = body.encode().decode("latin-1").translate(ALPHABET)
                found[w] = n + len(model(body if head == "\n" else "\u0120" + body))
            elif head.strip() or head == "\n" and (w == "\n" or w[1].strip()):
                others.append(w)
        for i in range(0, len(others), 10_000):
            part = others[i : i + 10_000]
            found.update(zip(part, self.whole([w if w[0] == "\n" else " " + w for w in part]), strict=True))
        return found

    def known(self, words: set[str]) -> dict[str, int | None]:
        """Counts of a slice's different words, none for those that ``learn`` leaves out."""
        counts = dict(zip(words, map(self.memo.get, words), strict=True))
        found = self.learn([w for w, n in counts.items() if n is None])
        counts.update(found)
        if len(self.memo) + len(found) > MEMO_WORDS:
            self.memo.clear()
        self.memo.update(found)
        for w in found:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.whole(texts)
        spaced = [t.replace("\n", " \n") for t in texts]
        apart = [not ((self.special and self.special.search(t)) or " \n \n " in s or s.endswith(" \n \n")) for t, s in zip(texts, spaced, strict=True)]
        cut = [s.split(" ") if a else [""] for a, s in zip(apart, spaced, strict=True)]
        totals, of = self.whole([words.pop(0) for words in cut]), self.known(set(chain.from_iterable(cut))).__getitem__
        for k, words in enumerate(cut):
            try:
                totals[k] += sum(map(of, words))
            except TypeError:
                apart[k] = False
        rest = [k for k, a in enumerate(apart) if not a]
        for k, n in zip(rest, self.whole([texts[k] for k in rest]), strict=True):
            totals[k] = n
        return totals


class ModelCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def counter(path: str):
    """The counter for a tokenizer file, one per Python worker while its tasks count tokens."""

    def load():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return ModelCounter(path) if path.endswith(".model") else WordCounter(path)

    return kept(("tokenizer", path), load)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", 1 << 19):  # a text's words are Python objects, so of few texts at a time
                counts = counter(path).count(part.column(part.schema.get_field_index("body")).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("content")), pa.array(counts, pa.int64())],
                                                 ["content", "n_tokens"])

    return lean(run, ("tokenizer", path))


def cached_counts(docs: DataFrame, cache: str, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """Brings the cache at path ``cache`` up to date for ``docs``; returns (content, n_tokens) of this tokenizer.

    Normalised content is the UTF-8 text with null as empty: nothing more may change before a
    byte-level tokenizer without changing counts. ``tokenizer`` is a file path valid on every
    executor. Texts of distinct content are never shuffled unless the table of repeated contents is
    too large to broadcast: a content that occurs once is encoded where it is read, of a
    repeated one only one copy is.
    """
    return _updated(docs, cache, tokenizer, text_col)[0]


def _updated(docs: DataFrame, cache: str, tokenizer: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The cache's counts after its update, and (content, n) of contents that ``docs`` hold more than once."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    body = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    keyed = body.withColumn("content", F.unhex(F.sha2("body", 256)))
    repeated = materialise(keyed.groupBy("content").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-contents")
    have = materialise(known(spark, cache, version).select("content"), "cached-contents")
    missing = keyed.join(small_enough(have), "content", "left_anti")
    copies = small_enough(repeated.select("content"))
    once = missing.join(copies, "content", "left_anti")
    again = missing.join(copies, "content", "left_semi").groupBy("content").agg(F.first("body").alias("body"))
    new = once.unionByName(again).select("content", "body").mapInArrow(_encode(tokenizer), "content binary, n_tokens bigint")
    new.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    return known(spark, cache, version), repeated


def known(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts that the cache holds for one tokenizer version, one row for each content."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)  # makes the table if there is none
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_lengths(
    docs: DataFrame, tokenizer: str, *, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, content (digest), n_bytes, n_tokens; without ``cache`` a new one is made.

    Rows of a content with ``HOT`` copies or more get its count by a broadcast of those counts, so
    no task reads them all; the others are shuffled to their counts.
    """
    counts, repeated = _updated(docs, cache or scratch_path(docs.sparkSession, "token-cache"), tokenizer, text_col)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(body).cast("bigint").alias("n_bytes"),
                       F.unhex(F.sha2(body, 256)).alias("content"))
    hot = materialise(repeated.filter(F.col("n") >= HOT).join(counts, "content").select("content", "n_tokens"), "hot-contents")
    columns = ["doc_id", "content", "n_bytes", "n_tokens"]
    if hot.isEmpty():
        return rows.join(counts, "content").select(*columns)
    hot = small_enough(hot)
    return rows.join(hot, "content").select(*columns).unionByName(rows.join(hot, "content", "left_anti").join(counts, "content").select(*columns))


def count_tokens(
    docs: DataFrame, tokenizer: str, *, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null text is empty: 0 bytes, 0 tokens. Null and repeated ids and repeated rows come through
    one by one; columns of other names are not looked at. Without ``cache`` a new one is made in
    the shared folder. Two jobs that append at once may store a content twice; reading keeps one.
    """
    found = token_lengths(docs, tokenizer, cache=cache, id_col=id_col, text_col=text_col)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
