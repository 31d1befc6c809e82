"""Ranked search against a plain statement of the score, with copies, ties, odd rows and several blocks of items."""

import math
import random
import re

from lectern.llm import bag_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    rows = [(i, terms(t)) for i, t in docs if terms(t)]
    big_n, big_l = len(rows), sum(len(t) for _, t in rows)
    df = {}
    for _, t in rows:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, t in items:
        if i is not None and terms(t):
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, t in rows:
            m = 50 + (50 * len(t) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in words if x in t)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def fixture():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "gamma9", "é", "中文", "x", "y", "z", "rare" + str(rng.randint(0, 9)), "the"])
    text = lambda n: rng.choice([" ", "-", "\n", "."]).join(word() for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(60)]
    docs += [(100 + i, "the same words in many ROWS rare1") for i in range(30)] + [(7, docs[7][1]), (None, docs[3][1]), (None, "rare1"), (200, None), (201, ""), (202, " .,"), (203, "the " * 5000 + "rare2")]
    items = [(i, text(rng.randint(1, 12))) for i in range(9)] + [(50, "rare1 rows"), (50, "many"), (51, None), (52, "?"), (None, "the"), (53, "nowhere")]
    return docs, items


def test_against_the_definition(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, item_id string, score int")
    wanted = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    for block in (1 << 20, 200):  # one block of items, several
        got = bag_search.search(frame, wanted, k=10, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 10)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "bb", "ccc", "é-ü"]) for _ in range(3_000)) + " " + "d" * 500
    whole = bag_search.term_counts(text.encode())
    monkeypatch.setattr(bag_search, "PIECE_BYTES", 100)
    assert bag_search.term_counts(text.encode()) == whole and sum(whole.values()) == len(terms(text))


def test_empty_tables(spark):
    docs, items = fixture()
    frame, wanted = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert bag_search.search(frame.limit(0), wanted).count() == 0
    assert bag_search.search(frame, wanted.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert bag_search.search(frame, wanted.limit(0)).count() == 0
