"""The Jaccard join against all pairs: near copies in chains, crowded cells, nulls, repeated rows."""

import random
import re

import pytest

from lectern.llm import metric, ngram_join
from lectern.llm.components import components


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    pick = lambda ds: min((d for d in ds if d is not None), default=None)
    return sorted(((d, len(sets[i]), pick(least[root(i)])) for i, (d, _) in enumerate(rows)), key=str)


def fixture(seed, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = text(60)
    rows, k = [], 0
    base = text(120)
    for _ in range(copies):  # independent edits of one text: some pairs link, some do not
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k := k + 1, " ".join(w)))
    drift = text(150)
    for _ in range(25):  # a chain: neighbours link, the ends do not
        drift[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((k := k + 1, " \n".join(drift)))
    for _ in range(70):  # one passage in many texts
        rows.append((k := k + 1, " ".join(text(rng.randint(40, 90)) + shared + text(20))))
    for _ in range(30):  # texts of little but the passage
        rows.append((k := k + 1, " ".join(shared + text(rng.randint(0, 14)))))
    rows += [(k + 1, None), (k + 2, ""), (k + 3, " \t\n"), (k + 4, "One two"), (k + 5, "one TWO"), (k + 6, "É a b c d e"), (k + 7, "é a b c d e")]
    rows += [(3, rows[2][1]), (3, "quite another text of this id here"), (k + 8, "quite another text of this id here"), (None, rows[0][1]), (None, "alone and without any id at all")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,copies,block,rounds", [(1, 60, 256, 3), (2, 90, 1, 2), (3, 90, 8, 0)])
def test_against_all_pairs(spark, monkeypatch, seed, copies, block, rounds):
    # Small blocks: cells are divided by pivots (and dealt out in blocks in the end) instead of joined at once.
    monkeypatch.setattr(metric, "BLOCK", block)
    monkeypatch.setattr(metric, "ROUNDS", rounds)
    monkeypatch.setattr(metric, "PIVOTS", 3)
    rows = fixture(seed, copies)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, id string")
    got = ngram_join.jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (900, 200), (200, 900)]
    want = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if want[a] is not want[b]:
            both = want[a] | want[b]
            for x in both:
                want[x] = both
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: min(s) for x, s in want.items() if len(s) > 1}
