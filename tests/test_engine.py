"""The stored index, memories, rates, the audit log and hooks against plain statements."""

import datetime as dt
import json
import random

import numpy as np
from pyspark.sql import functions as F


def test_loading_reads_only_the_folders_asked_for(spark, tmp_path):
    from lectern.operators import index as I

    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 5))
    rows = [(kb, kb * 100 + d, f"c{kb}-{d}-{i}", " ".join(word() for _ in range(12))) for kb in (1, 2, 3) for d in range(6) for i in range(2)]
    schema = "kb_id bigint, doc_id bigint, chunk_id string, text string"
    frame = spark.createDataFrame(rows, schema)
    index = I.write_index(frame, str(tmp_path / "index"))
    new = spark.createDataFrame([(1, 100, "c1-0-0", "omega alpha1"), (3, 999, "c3-9", "alpha1 alpha1")], schema)
    gone = spark.createDataFrame([(2, 201), (2, 777)], "kb_id bigint, doc_id bigint")
    for _ in range(2):  # a segment that is written again replaces itself
        index.change(new, gone, 1)
    left = [r for r in rows if r[1] not in (100, 201)] + [tuple(r) for r in new.collect()]
    rebuilt = I.bm25_index(spark.createDataFrame(left, schema))
    key = lambda df: sorted((r.kb_id, r.chunk_id, r.term, r.tf, r.dl, round(r.idf, 9), round(r.avgdl, 9)) for r in df.collect())
    assert key(I.load_index(spark, index.path)) == key(rebuilt)
    some = I.load_index(spark, index.path, [2])
    assert key(some) == [x for x in key(rebuilt) if x[0] == 2]
    plan = some._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [") and "PartitionFilters: []" not in plan and "kb_id" in plan.split("PartitionFilters: [")[1][:60]


def test_three_rankings_of_memories(spark):
    from lectern.operators.retrieve import rank_memories

    rows = [(1, i, f"Word{i % 3} other{i % 2} Alpha", [float(i % 4), 1.0]) for i in range(9)] + [(2, 20 + i, f"word{i}", [1.0, 0.0] if i else None) for i in range(5)] + [(3, 40, "only", [1.0, 1.0])]
    memories = spark.createDataFrame(rows, "user_id bigint, id bigint, text string, vector array<float>")
    queries = [(1, 1, "", [1.0, 0.0]), (2, 1, "Word1 Alpha", [3.0, 1.0]), (3, 1, "Word1 word2 other1", None), (4, 2, "word3 word9", [1.0, 0.0]), (5, 2, None, None), (6, 9, "nobody", None), (7, 3, "x", [0.0, 0.0])]
    got = {}
    for r in rank_memories(memories, spark.createDataFrame(queries, "query_id bigint, user_id bigint, query string, qv array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.how))
    cosine = lambda a, b: 0.0 if not np.linalg.norm(a) * np.linalg.norm(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {}
    for q, user, text, qv in queries:
        own = [(i, t, v) for u, i, t, v in rows if u == user]
        if not own:
            continue
        if not (text or "").strip():
            want[q] = [(i, "newest") for i, _, _ in own[::-1]][:3]
        elif qv is not None and all(v is not None for _, _, v in own):
            want[q] = [(i, "cosine") for i, _, v in sorted(own, key=lambda x: -round(cosine(qv, x[2]), 9))][:3]
        else:
            want[q] = [(i, "overlap") for i, t, _ in sorted(own, key=lambda x: -len(set(text.split()) & set(x[1].split())))][:3]
    assert got == want and {h for x in got.values() for _, h in x} == {"newest", "cosine", "overlap"}


def test_sketches_of_windows_merge_within_their_error(spark):
    from lectern.operators.metrics import latency_report, merged_latency

    rng = np.random.default_rng(2)
    values = np.exp(rng.normal(3, 1, 20_000))
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(v), 500 if i % 50 == 0 else 200) for i, v in enumerate(values)]
    requests = spark.createDataFrame(rows, "ts timestamp, duration_ms double, status int")
    windows = latency_report(requests, 86_400)
    assert windows.count() == 14 and windows.filter("start % 86400 <> 0").count() == 0
    one = merged_latency(windows).first()
    assert one.n == 20_000 and one.error_rate == 0.02
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs((values <= one[name]).mean() - q) < 0.02
    exact = latency_report(requests, 86_400, exact=True).orderBy("start").first()
    day = values[:1_440]
    assert abs(exact.p95 - np.quantile(day, 0.95)) < 1e-5 and exact.n == 1_440 and exact.per_second == round(1_440 / 86_400, 6)


def test_audit_log_is_appended_once_and_read_by_days(spark, tmp_path):
    from lectern.operators.meta import audit_query
    from lectern.streaming.streams import append_audit

    schema = "id bigint, created_at timestamp, action string"
    at = lambda d: dt.datetime(2024, 1, d, 12)
    for rows in ([(1, at(1), "a"), (2, at(2), "b")], [(3, at(2), "a"), (4, at(5), "a")], []):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        log = append_audit(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/log")
    assert sorted(r.id for r in log.collect()) == [1, 2, 3, 4]
    found = audit_query(log, at(2), at(4), action="a")
    assert [r.id for r in found.collect()] == [3]
    assert "PartitionFilters: []" not in found._jdf.queryExecution().toString()


def test_documents_of_two_encodings(spark, tmp_path):
    from lectern.sources.files import decoded, read_text_documents, write_text_documents

    rows = [("a.md", "课程 one", "gbk"), ("b.txt", "课程 é", "utf-8"), ("c.markdown", "", "utf-8"), ("d.pdf", "no", "utf-8"), ("e.txt", None, "gbk")]
    sizes = write_text_documents(spark.createDataFrame(rows, "name string, text string, encoding string"), str(tmp_path / "in")).collect()
    assert {r.name: r.bytes for r in sizes} == {n: len((t or "").encode(e)) for n, t, e in rows}
    got = {(r.title, r.format): r.text for r in read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {("a", "markdown"): "课程 one", ("b", "txt"): "课程 é"}
    assert decoded(b"\xff\xfe ok") == b"\xff\xfe ok".decode("gbk", errors="ignore")


def test_markdown_rules(spark):
    from lectern.functions.text import strip_markdown

    cases = {
        "# Head\n text": "Head\n text", "```py\ncode\n```": "code\n", "![pic](u.png) x": " x", "[name](http://x) y": "name y", "**bold** and __b__": "bold and b",
        "*it* _x_ ~~gone~~": "it x gone", "> quote": "quote", "- item\n* two\n+ three": "item\ntwo\nthree", "1. first\n22. second": "first\nsecond", "plain 3*4": "plain 3*4", "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", strip_markdown(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in got} == cases


def test_reranker_and_embedding(spark):
    import hashlib

    from lectern.functions import hooks
    from lectern.operators.index import hashing_embed

    pairs = spark.createDataFrame([("a b", "b c"), ("x", "")], "q string, t string")
    scores = pairs.select(hooks.reranker_column(lambda q, t: [float(len(set(a.split()) & set(b.split()))) for a, b in zip(q, t, strict=True)], F.col("q"), F.col("t"))).collect()
    assert [r[0] for r in scores] == [1.0, 0.0]
    rows = spark.createDataFrame([(1, "One two two"), (2, "..."), (3, None)], "id bigint, t string")
    got = {r.id: list(r.embedding) for r in hashing_embed(rows, "id", "t").collect()}
    want = np.zeros(256)
    for w in ("one", "two", "two"):
        want[int(hashlib.md5(w.encode()).hexdigest()[-2:], 16)] += 1
    assert np.allclose(got[1], want / np.linalg.norm(want), atol=1e-6) and not any(got[2]) and not any(got[3])


def test_regeneration_until_nothing_is_rejected(spark):
    from lectern.operators import exam as E

    q = spark.createDataFrame([(1, 1, "bad a"), (1, 2, "good b"), (1, 3, "bad c"), (2, 1, "good d")], "paper_id bigint, qid bigint, stem string")
    new = spark.createDataFrame([(1, 1, "bad e", 1), (1, 2, "good f", 1), (1, 1, "good g", 2), (1, 2, "good h", 2)], "paper_id bigint, qid bigint, stem string, round int")
    out, trace = E.regeneration_rounds(q, new, lambda rows: rows.filter("stem like 'bad%'").select("paper_id", "qid"))
    assert sorted((r.paper_id, r.qid, r.stem) for r in out.collect()) == [(1, 1, "good g"), (1, 2, "good b"), (1, 3, "good f"), (2, 1, "good d")]
    assert sorted((r["round"], r.paper_id, r.rejected) for r in trace.collect()) == [(1, 1, 2), (2, 1, 1)]


def test_papers_hide_answers_from_readers(spark):
    from lectern.operators.exam import paper_detail

    q = spark.createDataFrame([(p, i, f"s{i}", f"a{i}") for p in (1, 2) for i in (2, 1)], "paper_id bigint, qid bigint, stem string, answer string")
    got = {r.paper_id: r for r in paper_detail(spark.createDataFrame([(1, "read"), (2, "write")], "paper_id bigint, role string"), q).collect()}
    assert [sorted(x) for x in json.loads(got[1].questions)] == [["qid", "stem"]] * 2 and got[1].reference_answers is None
    assert json.loads(got[2].reference_answers) == [{"qid": 1, "answer": "a1"}, {"qid": 2, "answer": "a2"}] and json.loads(got[2].questions)[0] == {"qid": 1, "stem": "s1", "answer": "a1"}


def test_keyword_scores_take_no_memory_for_the_longest_word():
    import tracemalloc

    import pyarrow as pa

    from lectern.operators.retrieve import _bm25_scores

    words = ["w" * 40_000, *(f"a{i % 50}" for i in range(999))]
    terms = pa.table({"query_id": pa.array(range(1000), pa.int64()), "term": words, "q": pa.array([1] * 1000, pa.int64()), "idf": [1.0] * 1000, "avgdl": [2.0] * 1000})
    chunks = pa.table({"kb_id": pa.array([1] * 3000, pa.int64()), "chunk_id": [f"c{i:05}" for i in reversed(range(3000))], "dl": pa.array([2] * 3000, pa.int64()),
                       "terms": [[f"a{i % 50}", "other"] for i in range(3000)], "tfs": pa.array([[1, 1]] * 3000, pa.list_(pa.int64()))})
    tracemalloc.start()
    try:
        got = _bm25_scores(2)(chunks, terms)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    # Of equal scores the smaller ids, of each slice of the chunks; chunk i is at 2999 - i.
    best = {}
    for q, c in zip(got["query_id"].to_pylist(), got["chunk_id"].to_pylist(), strict=True):
        best.setdefault(q, []).append(c)
    assert 0 not in best and len(best) == 999 and all(sorted(c)[:2] == c[:2] for c in best.values())
    first = min(f"c{2999 - i:05}" for i in range(3000) if i % 50 == 7)
    assert best[8][0] == first


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    from lectern.sources.files import read_text_documents

    for i in range(200):
        (tmp_path / f"f{i}.txt").write_bytes(f"第{i}".encode("gbk" if i % 2 else "utf-8"))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        docs = read_text_documents(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() < 200
        assert {(r.title, r.text) for r in docs.collect()} == {(f"f{i}", f"第{i}") for i in range(200)}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
