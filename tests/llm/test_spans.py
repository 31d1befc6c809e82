"""Match offsets and overlaps against plain Python, for any block size, and with very many matches in one text."""

import random
import re
import time

from pyspark.sql import functions as F

from lectern.llm import pii, secrets, spans


def test_offsets_equal_those_of_a_regex(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["", "x", "12", "é𝄞1 22", *("".join(rng.choice("1 2a𝄞é\n") for _ in range(rng.randint(1, 60))) for _ in range(40))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {i: [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", t)] for i, t in enumerate(texts)}
    for block in (1, 3, 256):
        monkeypatch.setattr(spans, "BLOCK", block)
        got = spans.with_spans(frame, "n", "t", "[0-9]+").select("i", "n").collect()
        assert {r.i: [tuple(x) for x in r.n] for r in got} == want


def test_apart_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    some = lambda n: [(s, s + rng.randint(1, 6)) for s in (rng.randint(0, 80) for _ in range(n))]
    rows = [(i, some(rng.choice([0, 1, 9, 20])), some(rng.choice([0, 1, 5, 12]))) for i in range(40)]
    kind = "array<struct<start:int,end:int>>"
    frame = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")
    for size in (1, 4, 64):
        monkeypatch.setattr(spans, "APART", size)
        got = spans.apart(frame, "left", F.col("a"), F.col("b")).collect()
        assert {r.i: [tuple(x) for x in r.left] for r in got} == {i: [s for s in a if not any(s[0] < o[1] and o[0] < s[1] for o in b)] for i, a, b in rows}


def test_near_reads_pieces(spark):
    text = "".join(chr(97 + i % 26) for i in range(1_300)) + "𝄞é" * 300
    frame = spark.createDataFrame([(text, s, n) for s in (0, 1, 511, 512, 1_000, 1_899, 1_900, 2_500) for n in (0, 1, 30)], "t string, s int, n int")
    for r in frame.withColumn("p", spans.piecewise("t")).select("s", "n", spans.near(F.col("p"), F.col("s"), F.col("n")).alias("o")).collect():
        assert r.o == text[r.s : r.s + r.n]


def test_very_many_matches_in_one_text(spark):
    for scan, word in ((secrets.scan, "password=abcdef1 deadbeefdeadbeefdeadbeef0 "), (pii.scan, "a@b.co 10.2.3.4 ")):
        took = []
        for n in (16_000, 64_000):  # 32,000 and 128,000 base spans
            frame = spark.createDataFrame([(1, word * n)], "doc_id bigint, text string")
            began = time.time()
            row = scan(frame).select("doc_id", *(["n_assign", "n_hex"] if scan is secrets.scan else ["n_email", "n_ip"])).first()
            took.append(time.time() - began)
            assert tuple(row) == (1, n, n)
        assert took[1] < 60 and took[1] < 8 * max(took[0], 2), took  # four times the matches: not sixteen times the time
