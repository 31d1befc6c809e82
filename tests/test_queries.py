"""Registered queries against their SQL on the smallest tables, and rules that SQL cannot express."""

import glob
import os
import random

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
PICK = ["clean_text", "split_pages", "chunk_recursive", "grade_subjective_parse", "parse_rewrites", "sanitize_filename", "filter_page_noise", "extract_json_object", "kbs_for_user", "apply_member_changes", "kb_counters", "hybrid_retrieve", "groundedness",
        "merge_regenerated", "grade_objective", "knowledge_balance", "stream_document_status", "ndcg_at_k", "export_exam_markdown"]


def rows_of(frame):
    return sorted(map(str, frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", PICK)
def test_against_sql(spark, name):
    import __spark_entry__

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert len(want) and rows_of(got) == rows_of(want)


def test_every_plan_registers():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 130 and set(sql) <= set(queries)


def test_recursive_chunks():
    from lectern.operators.structure import pack_segments

    text = "\n\n".join("sentence number %d of the text. " % i * 3 for i in range(40))
    found = pack_segments([(1, text[:1500]), (2, text[1500:])], 200, 20)
    assert all(len(x) <= 220 or "\n" not in x for _, x in found) and {p for p, _ in found} == {1, 2}


def test_pieces_are_segments_and_null_texts_stay_alone(spark):
    from pyspark.sql import functions as F

    from lectern.operators.structure import merged_small, pieces, segments

    rng = random.Random(7)
    texts = ["", "a. . b", "x\x85. \xa0", *("".join(rng.choice(["a", ".", " ", "\n", "。", "，", ",", "\t", "\x1c", "\u3000", "é"]) for _ in range(40)) for _ in range(80))]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(segments(F.col("text"))).collect()
    assert [r[0] for r in got] == [pieces(t) for t in texts]
    assert merged_small([(1, "a"), (1, None), (2, "b"), (2, "c"), (3, "d" * 9)], 3, 9) == [(1, "a"), (1, None), (2, "b\nc"), (3, "d" * 9)]


def test_sentences_are_embedded_where_they_are_cut(spark):
    from pyspark.sql import functions as F

    from lectern.functions.text import tokenize
    from lectern.operators.index import bags, embed_bags, hashing_embed
    from lectern.operators.structure import chunk_semantic

    rng = random.Random(9)
    rows = [(d, 1, i, " ".join(rng.choice(["alpha", "beta", "gamma", "x", "中文"]) for _ in range(rng.randint(0, 6))) + "!") for d in range(40) for i in range(rng.randint(1, 300))]
    said = spark.createDataFrame(rows, "doc_id bigint, page_number int, pos int, text string")
    vectors = hashing_embed(said, ["doc_id", "page_number", "pos", "text"], "text")
    want = chunk_semantic(vectors.withColumnRenamed("embedding", "vector"), 60, 0.6, 9).collect()
    assert len(want) > 100 and sorted(chunk_semantic(said.withColumn("words", tokenize(F.col("text"))), 60, 0.6, 9).collect()) == sorted(want)
    # Counted tokens give the vectors that texts give.
    chunks = said.select(F.lit(1).cast("bigint").alias("kb_id"), F.concat_ws(":", "doc_id", "pos").alias("chunk_id"), "text")
    assert sorted(embed_bags(bags(chunks), ["chunk_id"]).collect()) == sorted(hashing_embed(chunks, "chunk_id", "text").collect())


def test_tokens_of_texts_with_control_characters(spark):
    from pyspark.sql import functions as F

    from lectern.functions.text import clean_text, normalize_chunk_text, tokenize

    rng = random.Random(4)
    texts = [None, *("".join(rng.choice(["a", "B", "中", "文", " ", "  ", "\n", "\r", "\t", "\x00", "\x1f", "\x7f", "\u3000", "\n\n\n", "é", "-"]) for _ in range(30)) for _ in range(200))]
    c = F.col("text")
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(tokenize(c).alias("a"), tokenize(clean_text(c)).alias("b"), normalize_chunk_text(c).alias("n"), normalize_chunk_text(F.concat(c, F.lit("\t"))).alias("m")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.n for r in got] == [r.m for r in got]


def merged(chunks, least=50, size=512):
    """Plain statement: a short chunk joins the one before it if both fit."""
    out = []
    for page, text in chunks:
        if out and len(text) < least and len(out[-1][1]) + 1 + len(text) <= size:
            out[-1] = (out[-1][0], out[-1][1] + "\n" + text)
        else:
            out.append((page, text))
    return out


def test_merge_small_native_equals_fold(spark):
    from lectern.operators.structure import merge_small_chunks

    rng = random.Random(2)
    rows = [(d, i, i, "x" * rng.choice([5, 30, 100, 300])) for d in range(8) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, page_number int, text string")
    got = {}
    for r in merge_small_chunks(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.page_number, r.text))
    assert got == {d: merged([(p, t) for dd, _, p, t in rows if dd == d]) for d in range(8)}


def test_segments_are_what_ever_finer_cuts_leave(spark):
    from pyspark.sql import functions as F

    from lectern.operators.structure import SEPARATORS, segments

    def finer(parts, marks):
        for m in marks:
            parts = [x for p in parts for x in p.split(m)]
        return [p.strip() for p in parts if p.strip()]

    rng = random.Random(5)
    texts = ["", " ", "a. b", "3.5, x", "。。", *("".join(rng.choice(["a", "b.", ". ", " ", "\n", "\n\n", "。", "，", ",", "；", "é", "."]) for _ in range(40)) for _ in range(60))]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(segments(F.col("text"))).collect()
    assert [r[0] for r in got] == [finer([t], SEPARATORS) for t in texts]


def test_semantic_chunks(spark):
    import numpy as np

    from lectern.operators.structure import chunk_semantic

    def plain(texts, vectors, size, threshold):
        out, held, mean = [], [texts[0]], vectors[0]
        for t, prev, v, pv in zip(texts[1:], texts, vectors[1:], vectors, strict=False):
            if len("\n".join(held)) + 1 + len(t) > size:
                out.append(held)
                held, mean = [prev], pv
            alike = float(mean @ v) / float(np.linalg.norm(mean) * np.linalg.norm(v))
            if alike < threshold:
                out.append(held)
                held, mean = [t], v
            else:
                held, mean = [*held, t], (mean + v) / 2
        return merged([(1, "\n".join(h)) for h in [*out, held]], 8, size)

    rng = np.random.default_rng(3)
    docs, rows = {}, []
    for d in range(12):
        n = int(rng.integers(1, 30))
        texts = ["s" * int(rng.integers(1, 40)) for _ in range(n)]
        vectors = rng.random((n, 6)) + np.repeat(rng.random((-(-n // 4), 6)) * 3, 4, 0)[:n]
        docs[d] = plain(texts, vectors, 100, 0.93)
        rows += [(d, 1, i, t, v.tolist()) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))]
    frame = spark.createDataFrame(rows, "doc_id bigint, page_number int, pos int, text string, vector array<double>")
    got = {}
    for r in chunk_semantic(frame, 100, 0.93, 8).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.page_number, r.text))
    assert got == docs


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    import datetime as dt

    from lectern.streaming.streams import audit_counts

    day = lambda d, n: [(dt.datetime(2026, 1, d), "login")] * n
    read = lambda: spark.readStream.schema("created_at timestamp, action string").parquet(f"{tmp_path}/in")
    for rows, want in ((day(1, 3) + day(2, 1), {1: 3, 2: 1}), (day(2, 4) + day(5, 2), {1: 3, 2: 5, 5: 2}), ([], {1: 3, 2: 5, 5: 2})):
        if rows:
            spark.createDataFrame(rows, "created_at timestamp, action string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = audit_counts(read(), folder=f"{tmp_path}/stream").collect()
        assert {r.start.day: r.n for r in got} == want


def test_passages_without_all_pairs(spark):
    from lectern.sources.views import passages_in

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 6, 7, 9, 20])))) for i in range(20)] + [(90, None), (91, "double  blank in the middle of it all")]
    docs = [(i, " ".join([word() for _ in range(30)] + [x + rng.choice(["", "x"]) for _, x in rng.sample(items[:20], 2)])) for i in range(40)] + [(80, None), (81, ""), (82, "a double  blank in the middle of it all")]
    got = passages_in(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, d) for i, x in items for d, t in docs if x is not None and t is not None and x in t)


def test_passages_in_long_texts_take_no_quadratic_time(spark):
    import time

    from lectern.sources.views import holding, passages_in

    words = [f"w{i % 977}x{i}" for i in range(40_000)]
    items = spark.createDataFrame([(1, " ".join(words[39_000:39_030])), (2, "not in it at all"), (3, " ".join(words[:3]))], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[:20_000])), (9, None)], "doc_id bigint, text string").coalesce(1)
    began = time.time()
    assert sorted(map(tuple, passages_in(docs, items).collect())) == [(1, 7), (3, 7), (3, 8)]
    assert time.time() - began < 60
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 9)], "query_id bigint, doc_id bigint")
    assert [tuple(r) for r in holding(docs, items, pairs).collect()] == [(1, 7)]


def test_near_duplicate_questions_move_texts_not_grams(spark):
    import re
    from collections import Counter

    from lectern.operators.exam import near_duplicate_questions

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé中") for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(12)) for _ in range(30)]
    stems = [*[rng.choice(base) + rng.choice(["", " ab", word()]) for _ in range(150)], "", None, "x", "x", " ", "zz"]
    rows = [(p, i, s, rng.choice([None, "kp"])) for p, n in ((1, 156), (2, 3), (3, 70), (4, 1)) for i, s in enumerate(rng.sample(stems, n))]
    frame = spark.createDataFrame(rows, "paper_id bigint, qid bigint, stem string, knowledge_point string")
    for block in (2_048, 40):
        got = near_duplicate_questions(frame, block=block)
        count = {}
        for p, i, s, k in rows:
            t = re.sub(r"\s+", "", f"{s or ''} {k or ''}")
            count[p, i] = Counter([t[x : x + 2] for x in range(max(len(t) - 1, 1))] if t else [])
        norm = {x: sum(c * c for c in v.values()) ** 0.5 for x, v in count.items()}
        close = lambda x, y: norm[x] and norm[y] and round(sum(c * count[y][g] for g, c in count[x].items()) / (norm[x] * norm[y]), 9) >= 0.9
        want = sorted(y for y in count if any(x[0] == y[0] and x[1] < y[1] and close(x, y) for x in count))
        assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_json_is_cut_out_once_a_row(spark):
    from pyspark.sql import functions as F

    from lectern.functions.text import extract_json_array, extract_json_object, once
    from lectern.operators.exam import parse_verdict

    assert [r[0] for r in spark.range(3).select(once(F.rand(), lambda x: x == x)).collect()] == [True] * 3
    verdict = parse_verdict(F.col("c"))
    assert str(spark.createDataFrame([("x",)], "c string").select(verdict)._jdf.queryExecution().optimizedPlan()).count("try_parse_json") <= 2
    rows = [("x {\"a\":1} y", "{\"a\":1}", None), ("}{", None, None), ("```json\n{\"a\":1}\n```", "{\"a\":1}", None), ("中😀[1,\"中\"]尾", None, "[1,\"中\"]"),
            ("[{\"a\":1}]", "{\"a\":1}", "[{\"a\":1}]"), (None, None, None)]
    got = spark.createDataFrame(rows, "c string, o string, a string").select(extract_json_object(F.col("c")), extract_json_array(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_rejections_judge_each_output_once(spark):
    from pyspark.sql import functions as F

    from lectern.functions.text import WHITE, strip
    from lectern.operators.exam import _close, collect_rejections, parse_verdict

    told = {
        None: "pass", "": "pass", "all good": "pass", "FAIL": "fail", "答案错误": "fail", '{"verdict": "pass", "why": "did not fail"}': "pass", '{"verdict": " PASS\u3000", "why": "错误"}': "pass",
        '{"verdict": "f\\u0061il"}': "fail", '{"verdict": "p\\u0061ss", "why": "fail"}': "pass", '{"verdict": "pass", "why": "fail"': "fail", '{"verdict": "odd", "why": "fail pass"}': "fail",
        '```json\n{"verdict": "pass", "why": "超纲"}\n```': "pass", '{"why": "a \\" quote"}': "pass", '{"verdict": "Fail "}': "fail",
    }
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(told)], "paper_id bigint, qid bigint, output string")
    assert [r[0] for r in rows.orderBy("qid").select(parse_verdict(F.col("output"))).collect()] == list(told.values())
    white = F.lit(WHITE)
    assert spark.range(1).select(strip(F.concat(white, F.lit("a b\ufeff"), white))).first()[0] == "a b\ufeff"

    seen = spark.sparkContext.accumulator(0)

    def judged(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    failed = rows.filter(parse_verdict(F.col("output")) == "fail").mapInArrow(judged, rows.schema)
    rules = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (2, 3)], "paper_id bigint, qid bigint")
    got = sorted(map(tuple, collect_rejections(failed, rules).collect()))
    fails = [i for i, x in enumerate(told.values()) if x == "fail"]
    assert got == sorted([(1, i, "model") for i in fails] + [(1, 1, "rule"), (2, 3, "rule")]) and seen.value == len(fails)
    import numpy as np

    # grams of the whole range of characters, of empty texts and of single characters
    texts, group = ["", "\U0010ffff\U0010ffff", "a", "\U0010ffff\U0010ffff", "a", "b", "a", "xyxy", "xyxyx"], np.array([0, 0, 0, 0, 0, 1, 2, 2, 2])
    assert [x.tolist() for x in _close(texts, group, np.array([0, 1, 2, 3, 4, 0, 0, 1, 2]), 0.9)] == [[1, 2, 7], [3, 4, 8]]


@pytest.mark.parametrize("name", ["stream_recent_messages", "stream_hash_dedup"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    import __spark_entry__

    for table in ("documents", "conversations"):
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    run = __spark_entry__.queries()[name]
    got = rows_of(run(spark, str(tmp_path)).toPandas())
    assert got and got == rows_of(run(spark, SF).toPandas())


def test_sheet_visibility_gives_every_pair(spark, monkeypatch):
    from lectern.operators import exam

    sheets = [(s, s * 7 % 11, s % 3) for s in range(60)]
    members = [(k, u, r) for k in range(3) for u, r in enumerate(["owner", "admin", "write", *["read"] * 8])]
    want = sorted((s, u) for s, student, kb in sheets for k, u, r in members if k == kb and (r != "read" or u == student))
    frames = spark.createDataFrame(sheets, "sheet_id bigint, student_id bigint, kb_id bigint"), spark.createDataFrame(members, "kb_id bigint, user_id bigint, role string")
    assert sorted(map(tuple, exam.visible_pairs(*frames).collect())) == want
    monkeypatch.setattr(exam, "small_enough", lambda df: df)
    assert sorted(map(tuple, exam.visible_pairs(*frames).collect())) == want


def test_pairs_of_sheets_and_users_are_written_small(spark, tmp_path):
    from pyspark.sql import functions as F

    from lectern.operators import exam
    from lectern.sources.views import Tables

    sheets = spark.range(100).select(F.col("id").alias("sheet_id"), (F.col("id") % 7).alias("student_id"), F.lit(1).cast("bigint").alias("kb_id"))
    members = spark.range(20_000).select(F.lit(1).cast("bigint").alias("kb_id"), F.col("id").alias("user_id"), F.lit("write").alias("role"))
    odd = sheets.unionByName(spark.createDataFrame([(5, 99, 1), (None, 3, 1), (7, 3, None)], "sheet_id bigint, student_id bigint, kb_id bigint")), members.unionByName(spark.createDataFrame([(1, None, "owner"), (1, 3, "admin"), (1, 3, "read")], "kb_id bigint, user_id bigint, role string"))
    exam.visible_pairs(sheets, members).write.parquet(f"{tmp_path}/pairs")
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 0.5 * 2_000_000
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 2_000_000
    got = exam.visible_pairs(*odd).groupBy("sheet_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("user_id").isNull(), 1)).alias("none"), F.count_if(F.col("user_id") == 3).alias("three")).collect()
    assert len(got) == 101 and all((r.n, r.none, r.three) == {5: (40_004, 2, 4)}.get(r.sheet_id, (20_002 + own, 1, 2 + own)) for r in got for own in [1 if r.sheet_id is None or r.sheet_id % 7 == 3 else 0])
    plan = str(Tables(spark, SF).unwritten("v_answers").select("sheet_id", "student_id").distinct()._jdf.queryExecution().executedPlan())
    assert "Window" not in plan and "p_name" not in plan


def test_page_noise_sql_states_the_rule(spark, tmp_path):
    import __spark_entry__

    texts = [("7" + " " * 399) * 5, ("ab" + " " * 398) * 4, ("12" + "\n" * 398) * 4, ("Page 1" + " " * 394) * 5, ("***\u2003" + " " * 396) * 4, ("第 ３ 页" + " " * 395) * 3, ("中文" + " " * 398) * 4,
             "x" * 801, " " * 1500, "\n" * 1500, "a\rb" * 600, "😀" * 1300, "abc", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["filter_page_noise"]).df()
    assert rows_of(__spark_entry__.queries()["filter_page_noise"](spark, str(tmp_path)).toPandas()) == rows_of(want)


def test_vector_scores_of_a_full_block_stay_small():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lectern.operators.retrieve import _cosine_scores

    rng = np.random.default_rng(4)
    vectors = lambda n: rng.integers(-4, 5, (n, 8)).astype(float)  # noqa: E731  many equal scores
    rows, asked = vectors(16_384), vectors(1_024)
    table = pa.table({"kb_id": np.arange(16_384) % 2, "chunk_id": np.arange(16_384), "embedding": pa.array(list(rows))})
    queries = pa.table({"query_id": np.arange(1_024), "qv": pa.array(list(asked))})
    tracemalloc.start()
    got = _cosine_scores(3)(table, queries).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(got) == 1_024 * 2 * 3
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for q in (0, 255, 256, 1_023):
        score = np.round(unit(rows) @ unit(asked)[q], 9)
        for kb in (0, 1):
            want = sorted(range(kb, 16_384, 2), key=lambda c: (-score[c], c))[:3]  # noqa: B023
            assert [x["chunk_id"] for x in got if x["query_id"] == q and x["kb_id"] == kb] == want


def pages_by_rule(text, size):
    """A page is closed by the line with which its lines, ends not counted, have ``size`` characters."""
    if not text.strip():
        return [""]
    closed = 0
    starts = [0]
    lines = text.split("\n")
    for i, line in enumerate(lines):
        closed += len(line)
        if closed >= size:
            starts.append(i + 1)
            closed = 0
    return ["\n".join(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True) if a < len(lines)]


def test_page_rule(spark):
    from pyspark.sql import functions as F

    from lectern.operators.structure import split_pages

    texts = ["", "  ", "short", " kept \n", "\n".join("line %d is here" % i for i in range(50)), "z" * 500 + "\nend", "a" * 100, "a" * 99 + "\n\nb" + "\n" * 5, "\n".join(["x" * 50] * 2 + [""] * 3)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(split_pages(F.col("text"), 100)).collect()
    assert [r[0] for r in got] == [pages_by_rule(t, 100) for t in texts]
    assert got[6][0] == ["a" * 100] and got[5][0] == ["z" * 500, "end"]


def test_recursive_chunks_by_hand():
    from lectern.operators.structure import pack_pieces

    # 6 + 1 + 5 = 12 fits, one more word does not; the overlap opens the next chunk and counts with the joining line end.
    assert pack_pieces([(1, ["aaaaaa", "bbbbb"])], 12, 3) == [(1, "aaaaaa\nbbbbb")]
    assert pack_pieces([(1, ["aaaaaa", "bbbbb", "c"])], 12, 3) == [(1, "aaaaaa\nbbbbb"), (1, "bbb\nc")]
    assert pack_pieces([(1, ["aaaaaaaaaaaaaaa"]), (2, ["b", "cc"])], 12, 3) == [(1, "a" * 15), (2, "aaa\nb\ncc")]
    assert pack_pieces([(1, ["aaaa", "b"]), (2, ["cccccccccc"])], 12, 1) == [(1, "aaaa\nb"), (2, "b\ncccccccccc")]
    assert pack_pieces([], 12, 3) == []


def test_groundedness_of_a_text_against_itself(spark):
    from pyspark.sql import functions as F

    from lectern.operators.retrieve import groundedness

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("text rlike '[A-Za-z]{2}'")
    rows = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"), F.array("text").alias("contexts"))
    assert groundedness(rows).filter("confidence < 1").count() == 0
    cases = [(1, "Alpha Beta Gamma", ["alpha beta gamma"]), (2, "Alpha Beta Gamma", ["Alpha and others"]), (3, "Alpha Beta Gamma Delta", ["x Alpha y"]), (4, "未找到", ["x"]), (5, "Alpha", []), (6, "not found", None)]
    frame = spark.createDataFrame(cases, "query_id int, answer string, contexts array<string>")
    got = {r.query_id: (round(r.confidence, 4), r.grounded) for r in groundedness(frame).collect()}
    assert got == {1: (0.0, False), 2: (0.3333, True), 3: (0.25, False), 4: (1.0, True), 5: (0.0, False), 6: (1.0, True)}


def test_subjective_grading_by_hand(spark):
    import json

    from pyspark.sql import functions as F

    from lectern.operators import exam as E

    one = {"dimensions": [{"key": " 知识点匹配度 ", "score": 3.7, "comment": " good ", "source_refs": [" in text ", "elsewhere", ""]}, {"key": "STEPS", "score": "4"}, {"key": "结论", "score": "2.5"}, {"key": "language", "score": -3}]}
    two = {"dimensions": [{"key": "steps", "score": 99}, "noise", {"key": "steps", "score": True}, {"key": "语言", "score": None}, {"score": 2}], "missing": ["x"]}
    outputs = [json.dumps(one, ensure_ascii=False), "```json\n" + json.dumps(two, ensure_ascii=False) + "\n```", "no json", None, '{"dimensions": "x"}', '{"knowledge": 5}']
    frame = spark.createDataFrame(list(enumerate(outputs)), "i int, o string")
    got = E.grade_subjective(frame, F.col("o"), [F.lit(6), F.lit(6), F.lit(4), F.lit(4)], F.lit("what is in text here")).orderBy("i").collect()
    scores = [[d["score"] for d in r.scores] for r in got]
    assert scores == [[3, 4, 0, 0], [0, 1, 0, 0], [0] * 4, [0] * 4, [0] * 4, [0] * 4]
    assert got[0].scores[0]["source_refs"] == ["in text"] and got[0].scores[0]["comment"] == "good" and [d["max_score"] for d in got[0].scores] == [6, 6, 4, 4]


def test_text_rules_by_hand(spark):
    from pyspark.sql import functions as F

    from lectern.functions import text as X
    from lectern.operators.structure import filter_page_noise

    names = {"a\\b.md": "a_b.md", "dir/": "unnamed", "": "unnamed", "../.hidden.txt": "hidden.txt", "x" * 250 + ".md": "x" * 196 + ".md", "é 课-1.txt": "é_课-1.txt", "y" * 250: "y" * 196}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", X.sanitize_filename(F.col("n")).alias("o")).collect()
    assert {r.n: r.o for r in got} == names
    outputs = {"1. what's new\n2) don't panic": ["q", "what's new", "don't panic"], '["a", " ", "q", "b", "c"]': ["q", "a", "b"], '- "say \'x\'"\n- 1. y': ["q", "say \'x", "1. y"], "": ["q"], None: ["q"], "· q\n· q": ["q"], "{}": ["q", "{}"], '"a"\na\nb': ["q", "a", "b"]}
    got = spark.createDataFrame([(k,) for k in outputs], "o string").select("o", X.parse_rewrites(F.col("o"), F.lit("q")).alias("r")).collect()
    assert {r.o: list(r.r) for r in got} == outputs
    page = lambda n: f"12\n第 3 页\nPage 3 of 9\n- 12 -\npage 7\n3 / 9\n--\n汉字\nbody {n}"
    rows = spark.createDataFrame([(1, n, page(n)) for n in (1, 2, 3)] + [(2, n, page(n)) for n in (1, 2)], "doc_id bigint, page_number int, text string")
    left = {(r.doc_id, r.page_number): r.text for r in filter_page_noise(rows).collect()}
    assert left[1, 2] == "Page 3 of 9\n- 12 -\n汉字\nbody 2" and left[2, 1] == page(1)


def test_cache_fold_equals_stream(spark):
    import __spark_entry__

    q = __spark_entry__.queries()
    batch, stream = (rows_of(q[n](spark, SF).toPandas()) for n in ("query_cache_hits", "stream_query_cache"))
    assert batch == stream


def test_hooks(spark):
    from pyspark.sql import functions as F

    from lectern.functions import hooks

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " ")], "id bigint, t string")
    assert [r[0] for r in df.select(hooks.tokenizer_column(str.split, F.col("t"))).collect()] == [["a", "b"], None, []]
    vectors = hooks.embed(df, "id", "t", lambda: lambda texts: [[float(len(x)), 1.0] for x in texts]).collect()
    assert {r.id: list(r.embedding) for r in vectors} == {1: [3.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}

    def client(x):
        if x is None:
            raise ValueError("no prompt")
        return x.upper()

    out = {r.id: (r.output, r.error) for r in hooks.model_outputs(df, "id", "t", client).collect()}
    assert out[1] == ("A B", None) and out[2][0] is None and "no prompt" in out[2][1]


def fed(spark, folder, batches, schema, run):
    """Results of ``run`` (a stream on ``folder``/in) after each batch, each in a query of its own on the same checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        yield run(spark.readStream.schema(schema).parquet(f"{folder}/in"))


def test_state_of_the_query_cache_ends(spark, tmp_path):
    import datetime as dt

    from lectern.operators import meta
    from lectern.streaming.streams import query_cache

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[("a", 1, at(0)), ("a", 2, at(50)), ("b", 3, at(10))], [("a", 4, at(61)), ("b", 5, at(65)), ("a", 6, at(100))], [("z", 7, at(9_000))], [("a", 8, at(9_001)), ("z", 9, at(9_030))]]
    left = []

    def note(query):
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    schema = "key string, event_id bigint, ts timestamp"
    run = lambda rows: query_cache(rows, 60, "0 seconds", f"{tmp_path}/stream", note)
    got = {r.event_id: r.hit for r in list(fed(spark, tmp_path, batches, schema, run))[-1].collect()}
    rows = spark.createDataFrame([r for b in batches for r in b], schema)
    assert got == {r.event_id: r.hit for r in meta.query_cache(rows, 60).collect()} and got[6] and not got[8]
    assert left == [2, 1, 1, 2]  # rows of state: b has ended at 100, a at 9,000, where only z is left


def test_recent_messages_after_restarts(spark, tmp_path):
    from lectern.streaming.streams import recent_messages

    batches = [[(c, i, f"{c}-{i}") for c in range(40) for i in range(5)], [(3, 9, "x"), (3, 7, "y"), (3, 9, "x")], [(99, 1, "new")]]
    schema, files = "conv_id bigint, id bigint, text string", lambda: {p for p in glob.glob(f"{tmp_path}/stream/table/*/*/*.parquet")}
    want, seen = {}, []
    for rows, got in zip(batches, fed(spark, tmp_path, batches, schema, lambda r: recent_messages(r, 3, f"{tmp_path}/stream")), strict=True):
        for c, i, t in rows:
            want.setdefault(c, {})[i] = t
        assert sorted(map(tuple, got.select("conv_id", "id", "text").collect())) == sorted((c, i, m[i]) for c, m in want.items() for i in sorted(m)[-3:])
        seen.append(files())
    assert len(seen[0]) > 10 and len(seen[1] - seen[0]) == 1 and len(seen[2] - seen[1]) == 1  # the buckets of the batch's keys only


def test_replayed_batch_leaves_the_same_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from lectern.streaming.streams import BucketTable

    merge = lambda b: b.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at")).select("k", "v", "at")
    table = BucketTable(spark, f"{tmp_path}/table", ["k"], merge, 8)
    batch = lambda rows: spark.createDataFrame(rows, "k bigint, v string, at bigint")
    first, second = [(i, "old", 1) for i in range(20)], [(3, "new", 2), (4, "late", 0)]
    table.step(batch(first), 0)
    table.step(batch(second), 1)
    once = sorted(map(tuple, table.rows().collect()))
    table.step(batch(second), 1)
    assert sorted(map(tuple, table.rows().collect())) == once and (3, "new", 2) in once and (4, "old", 1) in once and len(once) == 20
    for n in range(2, 6):
        table.step(batch([(3, f"v{n}", n + 1)]), n)
    assert max(len(glob.glob(f"{b}/*")) for b in glob.glob(f"{tmp_path}/table/bucket=*")) == 2
    assert {r.k: r.v for r in table.rows().collect()}[3] == "v5"


def test_query_cache_by_doubling(spark):
    import datetime

    from lectern.operators import meta

    rng, zero = random.Random(9), datetime.datetime(2024, 1, 1)
    rows = [(rng.choice("aab"), i, zero + datetime.timedelta(seconds=rng.choice([rng.randint(0, 4_000), 60 * rng.randint(0, 60)]))) for i in range(300)] + [("c", 900, zero), ("c", 901, None)]
    requests = spark.createDataFrame(rows, "key string, event_id bigint, ts timestamp")
    want, last = {901: False}, {}
    for key, i, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1])):
        want[i] = key in last and (at - last[key]).total_seconds() <= 60
        if not want[i]:
            last[key] = at
    for size in (1, 7, 10_000):
        assert {r.event_id: r.hit for r in meta.query_cache(requests, 60, size).collect()} == want
    assert meta.query_cache(requests.limit(0), 60).count() == 0


def test_counter_by_composed_maps(spark):
    from lectern.operators import meta

    rng = random.Random(3)
    rows = [(rng.choice("aaab"), i * rng.choice([1, 1, 3]), rng.choice([-3, -1, 1, 2])) for i in range(1, 500)] + [("c", 5, -4), ("d", -70, 2), ("d", 70, -1)]
    want = {}
    for key, _, d in sorted(rows, key=lambda r: r[1]):
        want[key] = max(want.get(key, 0) + d, 0)
    rows = [(k, i, n, d) for n, (k, i, d) in enumerate(rows)]
    deltas = spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[2])), "key string, event_id bigint, n int, delta bigint")
    for block, fan in ((4_096, 256), (7, 3), (1, 2)):
        assert {r.key: r.value for r in meta.floored_counter(deltas, "key", ["event_id", "n"], block, fan).collect()} == want
    assert meta.floored_counter(deltas.limit(0), "key", ["event_id"]).count() == 0
