"""Token counts against the library itself; packing against exhaustive search."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import packing, tokens
from lectern.llm.common import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "a", "It's  we'll\n\n x  y\x1c\x1d z\t\t", "½ ² Ⅷ é é naïve 𝄞 日本語 한국 ́", "<|endoftext|>",
    "a<|endoftext|> b <|endoftext|><|endoftext|>c", "x" * 30_000, "  12_34-- ''' don'T", "\x85 ᠎﻿​ end ", "word " * 2_000,
]


def test_counts_match_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab 'sté1²_\n　.́") for _ in range(60)) for _ in range(200)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i // 2, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    cache = scratch_path(spark, "cache")
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in rows)
    for _ in range(2):  # the second time everything is in the cache
        got = tokens.count_tokens(docs, path, cache=cache).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("content").distinct().count() == len({t or "" for t in texts})


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    path = public_tokenizers.path(name)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()}
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    assert got == {i: count(t or "") for i, t in enumerate(TEXTS)}


def test_empty_counts(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_bounds_are_optimal():
    rng = random.Random(5)
    for _ in range(30):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 5):
            pad = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))  # noqa: B023, B905, E731
            best = min(pad([*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
            got = packing.optimal_bounds(lengths, counts, [n * c for n, c in zip(lengths, counts, strict=True)], k)
            assert len(got) <= k and pad(got) == best


def test_batches(spark):
    rng = random.Random(6)
    rows = [(i, "x" * int(rng.expovariate(0.01))) for i in range(500)] + [(None, None), (7, "same"), (7, "same"), (8, "y" * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(docs, F.octet_length("text"), budget=2_000, buckets=4).collect()
    assert len(got) == len(rows) and len({r.bucket for r in got}) <= 4
    batches = {}
    for r in got:
        assert 0 <= r.n_units <= r.bound and r.padding == r.bound - r.n_units
        batches.setdefault(r.batch_id, []).append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and len(b) == b[0].batch_rows and (len(b) == 1 or len(b) * b[0].bound <= 2_000)
    for k in {r.bucket for r in got}:
        own = [b for b in batches.values() if b[0].bucket == k]
        assert sum(len(b) < max(1, 2_000 // max(1, b[0].bound)) for b in own) <= 1
    assert packing.pack(docs.limit(0), F.octet_length("text")).count() == 0


def least_padding(lengths, counts, buckets):
    """Least padding by trying every cut, bucket by bucket."""
    top, n = np.asarray(lengths), np.concatenate(([0], np.cumsum(counts)))
    total = np.concatenate(([0], np.cumsum(np.asarray(counts) * top)))
    best = np.concatenate(([0], top * n[1:] - total[1:]))
    for _ in range(buckets - 1):
        best = np.array([0] + [(best[:j] + top[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])).min() for j in range(1, len(n))])
    return int(best[-1])


def test_bounds_are_optimal_beyond_4096_lengths(spark):
    rng = random.Random(8)
    lengths = sorted({int(rng.lognormvariate(9, 1)) + 5 for _ in range(9_000)})
    counts = [rng.randint(1, 3) for _ in lengths]
    assert len(lengths) > 5_000
    rows = [(i, n) for i, n in enumerate(n for n, c in zip(lengths, counts, strict=True) for _ in range(c))]
    docs = spark.createDataFrame(rows, "doc_id bigint, n bigint").withColumn("text", F.lit(""))
    assert packing.length_histogram(docs, "n") == (lengths, counts, [n * c for n, c in zip(lengths, counts, strict=True)])
    for k in (2, 5, 16):
        got = packing.pack(docs, F.col("n"), buckets=k).agg(F.sum("padding"), F.countDistinct("bound"), F.count("*")).first()
        assert got[0] == least_padding(lengths, counts, k) and got[1] <= k and got[2] == len(rows)


def test_lengths_are_tokens(spark, tmp_path):
    import corpus_pipeline
    from lectern.llm.queries import op3_length_buckets, op6_digest_cache

    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(TEXTS)] + [(7, "same words"), (7, "same words")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r.doc_id, r.n_tokens) for r in op6_digest_cache(spark, str(tmp_path)).collect())
    for found in (op3_length_buckets(spark, str(tmp_path)), corpus_pipeline.length_packing(spark, docs, str(tmp_path))):
        assert sorted((r.doc_id, r.n_units) for r in found.collect()) == want


def test_hot_contents(spark):
    from lectern.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i % 300, "hot words here") for i in range(tokens.HOT + 40)] + [(i, None) for i in range(tokens.HOT + 1)] + [(1, "once"), (2, "twice"), (2, "twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = tokens.token_lengths(docs, path).collect()
    want = {t: n for t, n in zip(("hot words here", "", "once", "twice"), tokens.counter(path).count(["hot words here", "", "once", "twice"]), strict=True)}
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted((i, len(t or ""), want[t or ""]) for i, t in rows)


def test_workers_let_go_of_the_tokenizer_when_other_work_begins(spark):
    import pyarrow as pa
    import public_tokenizers

    from lectern.llm import common

    def held(batches):
        from lectern.llm import common

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._kept)] * batch.num_rows, pa.int64())], ["n"])

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.count_tokens(spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id bigint, text string"), path).count() == 64
    rows = spark.range(0, 64, 1, 8)
    assert {r.n for r in rows.mapInArrow(common.lean(held), "n bigint").collect()} == {0}
    assert common.kept("one", lambda: 1) == common.kept("one", lambda: 2) == 1 and common.kept("two", lambda: 3) == 3 and list(common._kept) == ["two"]
    assert list(common.lean(iter, "two")([])) == [] and list(common._kept) == ["two"]
    assert list(common.lean(iter)([])) == [] and not common._kept


def test_words_give_the_library_counts_and_only_odd_words_are_encoded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 300)
    counter = tokens.WordCounter(public_tokenizers.path("byte_bpe_50k.json"))
    whole, encoded = counter.whole, []
    monkeypatch.setattr(counter, "whole", lambda texts: encoded.extend(texts) or whole(texts))
    plain = "The first line, of words.\nThe second line of them.\n\nThe last"
    assert counter.count([plain, plain]) == whole([plain, plain]) and set(encoded) <= {"The", "", "\n"}
    draw = random.Random(7)
    parts = [" ", " ", "\n", "\n", "\n\n", "\t", "\r", "a", "é", "ß", "日", "ʰ", "1", "²", ",", ".", "'s", "_", "\xa0", "\x1c", "　", "<|endoftext|>", "The", "word" * 20]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        assert counter.count(texts[at : at + 100]) == whole(texts[at : at + 100])
        assert len(counter.memo) <= 300 and all(len(w) <= tokens.MEMO_CHARS for w in counter.memo)
