"""Benchmark scan against a window-by-window statement of the rule, offsets of its spans, and odd rows."""

import hashlib
import random
import re

import pytest

from lectern.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window=13):
    places = [m.span() for m in WORD.finditer(lowered(text))]
    words = [lowered(text)[s:e] for s, e in places]
    hit, owners = set(), set()
    for k, (_, item) in enumerate(items):
        w = WORD.findall(lowered(item))
        n = min(window, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                owners.add(k)
    runs = []
    for i in sorted(hit):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    names = sorted({items[k][0] for k in owners if items[k][0] is not None})
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return len(words), len(hit), len(owners), digest, bool(hit) and 20 * len(hit) >= len(words), [(places[a][0], places[b][1]) for a, b in runs]


def fixture():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé中") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(f"q{i}", text(rng.randint(14, 40))) for i in range(6)]
    items += [("short", "Only three WORDS"), ("twin", items[0][1]), ("blank", " .,-"), ("none", None), (None, text(20)), ("q10", text(13))]
    docs = [None, "", " \n.", "only three words", "ONLY, three--words", "only three word"]
    for _ in range(40):
        body = text(rng.randint(5, 80)).split(" ")
        name, item = rng.choice(items)
        words = (item or "").split(" ")
        cut = words[rng.randint(0, 3) :][: rng.choice([12, 13, 14, 40])]
        at = rng.randint(0, len(body))
        docs.append((rng.choice([" ", "\n", ", ", "😀 "])).join(body[:at] + [w.upper() if rng.random() < 0.3 else w for w in cut] + body[at:]))
    docs.append(text(30_000) + " " + items[1][1] + " " + text(30_000))  # very long
    return docs, items


@pytest.mark.parametrize("limit", [64 << 20, 1_500])  # one automaton, many
def test_against_windows(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
    docs, items = fixture()
    assert (len(decontaminate._item_parts(spark.createDataFrame(items, "i string, t string"), "i", "t", 13)) > 3) == (limit == 1_500)
    rows = [(i, t, "clash", i) for i, t in enumerate(docs)] + [(3, docs[3], "clash", 0), (None, docs[4], None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, items string, n_words int")
    found = decontaminate.scan(frame, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert len(found) == len(rows)
    want = sorted(((d, *brute(t, items)) for d, t, _, _ in rows), key=str)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, [(s.start, s.end) for s in r.spans]) for r in found]
    assert sorted(got, key=str) == want and sum(r.contaminated for r in found) > 4

    kept = decontaminate.drop_contaminated(frame, spark.createDataFrame(items, "item_id string, text string"))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, t, _, _ in rows if not brute(t, items)[4]), key=str)


def test_empty_tables(spark):
    docs, items = fixture()
    frame = spark.createDataFrame(list(enumerate(docs[:10])), "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert all(not r.contaminated and r.n_items == 0 for r in decontaminate.scan(frame, none).collect())
    assert decontaminate.scan(frame.limit(0), spark.createDataFrame(items, "item_id string, text string")).count() == 0
