"""Line dedup against exhaustive comparison of all pairs that share a band, its recall, and odd rows."""

import random

from lectern.llm import lines


def brute(rows, min_chars, percent):
    found = []
    for d, t in rows:
        for i, x in lines.eligible(None if t is None else t.encode(), min_chars):
            bands = set(enumerate(lines.signatures([x])[0].tolist()))
            found.append((d, i, {x.decode()[k : k + 8] for k in range(len(x.decode()) - 7)}, bands))
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][2], found[j][2]
            if 100 * len(a & b) >= percent * len(a | b) and found[i][3] & found[j][3]:
                parent[root(i)] = root(j)
    groups = {}
    for i, f in enumerate(found):
        groups.setdefault(root(i), []).append(f[:2])
    lost = {p for g in groups.values() for p in g if p != min(g)}
    out = {}
    for d, t in rows:
        parts = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(parts) if (d, i) not in lost]
        if len(kept) == len(parts):
            out[d] = t
        elif "".join(kept).strip():
            out[d] = "\n".join(kept)
    return out


def test_against_all_pairs(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    known = [line(20) for _ in range(12)]

    def edited(x, most):
        w = x.split(" ")
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = []
    for d in range(120):
        parts = [rng.choice([line(15), edited(rng.choice(known), 1), "short line", "", "  " + rng.choice(known).upper() + "\t"]) for _ in range(rng.randint(1, 6))]
        rows.append((d, "\n".join(parts)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, known[0]), (504, known[0] + "\nown words stay here")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, row int")
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert {d: r.text for d, r in got.items()} == brute(rows, 40, 80)
    assert got[504].n_lines == 2 and got[504].n_removed == 1 and 503 not in got and got[500].n_removed == 0


def test_repeated_rows_and_empty(spark):
    text = "the very same long line that two rows with one id share"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in lines.dedup_lines(docs).collect()) == ["None"]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_recall_of_bands():
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(200)) for _ in range(300)]
    other = []
    for t in base:  # one block of new characters: similarity just over 0.8
        at = rng.randrange(150)
        other.append(t[:at] + "".join(rng.choice("klmnop") for _ in range(12)) + t[at + 12 :])
    sim = [len(a & b) / len(a | b) for a, b in ((set(lines.line_set(x.encode())), set(lines.line_set(y.encode()))) for x, y in zip(base, other, strict=True))]
    a, b = lines.signatures([x.encode() for x in base]), lines.signatures([x.encode() for x in other])
    near = [i for i, s in enumerate(sim) if s >= 0.8]
    assert len(near) > 100 and sum((a[i] == b[i]).any() for i in near) >= 0.98 * len(near)


def test_short_lines_take_part(spark, tmp_path):
    import corpus_pipeline
    from lectern.llm.queries import op2_fuzzy_lines

    near = ["an almost forty character long line xy", "an almost forty character long line xyz"]
    texts = ["one\nEnd.\nx", "two\n  end.\t\nx\n\n", near[0] + "\n}\né", near[1] + "\nfour\n}\nÉ", "end.\nx", "é", "\n \n", None, "abcdefg", "abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: texts[0], 1: "two\n\n", 2: texts[2], 3: "four\nÉ", 6: "\n \n", 7: None, 8: "abcdefg", 9: "abcdefgh"}
    assert {r.doc_id: r.text for r in op2_fuzzy_lines(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs, min_chars=40).collect()} == dict(enumerate(texts))


def test_signatures_of_short_lines():
    texts = ["a", "ab", "abcdefg", "abcdefgh", "an ordinary line", "é", "}"]
    together = lines.signatures([t.encode() for t in texts])
    assert all((together[i] == lines.signatures([t.encode()])[0]).all() for i, t in enumerate(texts))
    assert len({tuple(x) for x in together.tolist()}) == len(texts)
