"""Exam analytics: question rules, cross-question checks, grading, roll-ups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import extract_json_object, norm_answer, normalize_text_list, once, strip
from lectern.operators.meta import allowed
from lectern.sources.scratch import small_enough, written

TYPES = ("choice", "fill", "short")
SCORES = {"choice": 5, "fill": 5, "short": 20}
LIMITS = {"choice": 50, "fill": 50, "short": 20}
DIMENSIONS = ("knowledge", "steps", "conclusion", "language")
#: Fixed values.
DEFAULT_WEIGHTS = (0.3, 0.3, 0.2, 0.2)
UNLABELLED = "未标注"
OTHERS = "其他"
#: Words that make a verdict negative, what parts the terms of a reference answer.
NEGATIVE = ("fail", "不合格", "不存在", "超纲", "歧义", "错误")
TERM_MARKS = r"[，,、;；/｜|]+"
#: Other names of the dimensions in model output.
ALIASES = {
    "knowledge": ("knowledge", "知识点", "知识点匹配度"), "steps": ("steps", "步骤", "步骤完整性", "答题步骤完整性"),
    "conclusion": ("conclusion", "结论", "结论正确性", "结论答案正确性", "结论答案正确"),
    "language": ("language", "语言", "表述", "语言表述规范性", "语言表述", "规范性"),
}


def _per_type(c: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def normalize_questions(q: DataFrame) -> DataFrame:
    """Valid type and non-blank stem only; texts trimmed, options kept for choices, default score by type."""
    rows = q.filter(F.col("type").isin(*TYPES) & (strip(F.coalesce("stem", F.lit(""))) != ""))
    return rows.withColumns({
        "stem": strip(F.col("stem")), "answer": strip(F.coalesce("answer", F.lit(""))), "score": _per_type(F.col("type"), SCORES).cast("bigint"),
        "options": F.when(F.col("type") == "choice", F.filter(F.transform("options", strip), lambda x: x != "")).otherwise(F.array().cast("array<string>")),
    })


def config_reject_reason(choice: Column, fill: Column, short: Column, difficulty: Column) -> Column:
    """Why an exam configuration is refused; NULL if it is not."""
    counts = dict(zip(TYPES, (choice, fill, short), strict=True))
    reason = F.when(F.least(*counts.values()) < 0, "negative count")
    for k, c in counts.items():
        reason = reason.when(c > LIMITS[k], f"too many {k}")
    return reason.when(choice + fill + short <= 0, "no questions").when(~F.coalesce(difficulty, F.lit("")).isin("easy", "medium", "hard"), "unknown difficulty")


def renumber(q: DataFrame) -> DataFrame:
    return q.withColumn("qid", F.row_number().over(Window.partitionBy("paper_id").orderBy("qid")).cast("bigint"))


def sanitize_questions(q: DataFrame) -> DataFrame:
    """Edited questions: as normalised, but own scores (whole, not negative) and choices with two options at least; renumbered."""
    rows = normalize_questions(q.withColumn("_s", F.greatest(F.coalesce(F.col("score").cast("bigint"), F.lit(0)), F.lit(0))))
    rows = rows.withColumn("score", F.col("_s").cast("bigint")).drop("_s")
    return renumber(rows.filter((F.col("type") != "choice") | (F.size("options") >= 2)))


def merge_regenerated(q: DataFrame, rejected: DataFrame, new: DataFrame) -> DataFrame:
    """The i-th new question of a paper in place of its i-th rejected one; surplus new ones dropped; renumbered."""
    rank = lambda c: F.row_number().over(Window.partitionBy("paper_id").orderBy(c))
    places = rejected.select("paper_id", "qid").withColumn("_i", rank("qid"))
    names = [c for c in q.columns if c not in ("paper_id", "qid")]
    supply = new.withColumn("_i", rank("qid")).select("paper_id", "_i", F.struct(*names).alias("_new"))
    chosen = places.join(supply, ["paper_id", "_i"]).drop("_i")
    out = q.join(chosen, ["paper_id", "qid"], "left")
    picked = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in names}
    return renumber(out.withColumns(picked).drop("_new"))


def _grams(texts: list[str], width: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """2-grams of texts without white space: (start of each text's grams, grams, counts, norms, counts in ``width`` buckets)."""
    length = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row, last = np.repeat(np.arange(len(texts)), length), np.cumsum(length)[length > 0] - 1
    grams = codes << 21
    grams[:-1] |= codes[1:]
    keep = np.ones(len(codes), bool)
    keep[last] = False
    alone = last[length[length > 0] == 1]
    grams[alone], keep[alone] = codes[alone] << 21, True  # one character is one gram
    order = np.lexsort((grams[keep], row[keep]))
    grams, row = grams[keep][order], row[keep][order]
    first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1]))) if len(grams) else np.zeros(0, np.int64)
    grams, row, n = grams[first], row[first], np.diff(np.append(first, len(grams))).astype(np.float64)
    norms = np.sqrt(np.bincount(row, n * n, len(texts)))
    bucket = ((grams * 0x9E3779B1) >> 13) % width
    dense = np.bincount(row * width + bucket, n, len(texts) * width).reshape(-1, width).astype(np.float32)
    return np.searchsorted(row, np.arange(len(texts) + 1)), grams, n, norms, dense


def _close(texts: list[str], group: np.ndarray, place: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of the same group, the one in front first, whose 2-gram cosine reaches the threshold.

    Texts without white space are given group by group, ``place`` (below 64) is that in the group. A gram is one number with its group
    and its text, so all are found and counted by one sort, and all pairs' products by a sum over texts that share a gram.
    """
    length = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    code = np.cumsum(there)[codes]  # from 1
    base = int(code.max()) + 1
    second = np.append(code[1:], 0)
    last = np.cumsum(length)[length > 0] - 1
    second[last] = 0
    keep = np.ones(len(codes), bool)
    keep[last[length[length > 0] > 1]] = False  # one character is one gram
    row = np.repeat(np.arange(len(texts)), length)
    key = (((group[row] * base + code) * base + second) * 64 + place[row])[keep]
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, n = key[first], np.diff(np.append(first, len(key))).astype(np.float64)
    gram, place = key >> 6, key & 63
    row = np.searchsorted(group, np.arange(int(group[-1]) + 1))[gram // (base * base)] + place
    norms = np.sqrt(np.bincount(row, n * n, len(texts)))
    pairs, products = [], []
    for d in range(1, 64):
        i = np.flatnonzero(gram[:-d] == gram[d:])
        if not len(i):
            break
        pairs.append(row[i] * 64 + place[i + d] - place[i])
        products.append(n[i] * n[i + d])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    dot = np.bincount(np.concatenate(pairs), np.concatenate(products))
    at = np.flatnonzero(dot)
    i, j = at // 64, at // 64 + at % 64
    near = np.round(dot[at] / (norms[i] * norms[j]), 9) >= threshold
    return i[near], j[near]


def _alike(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    """Questions of whole groups (rows sorted by group and qid) that are close to an earlier one.

    In groups of more than 64 two texts have at most the dot product of their bucket counts; only pairs that reach the threshold by it are
    looked at exactly.
    """
    paper, a, b, part, qid = (rows[c].to_numpy() for c in ("paper_id", "a", "b", "part", "qid"))
    starts = np.flatnonzero(np.append(True, (paper[1:] != paper[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    size, found, texts = np.diff(np.append(starts, len(paper))), np.zeros(len(paper), bool), rows["text"].to_pylist()
    meet = lambda i, j: (qid[i] < qid[j]) & ((a[i] == b[i]) | (part[i] != part[j]))

    small = np.flatnonzero((size > 1) & (size <= 64))
    for some in np.split(small, range(4_096, len(small), 4_096)):
        place = np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        at = np.repeat(starts[some], size[some]) + place
        i, j = (at[x] for x in _close([texts[x] for x in at.tolist()], np.repeat(np.arange(len(some)), size[some]), place, threshold))
        found[j[meet(i, j)]] = True

    least = (threshold - 1e-9) * (1 - 1e-5)
    for first, count in zip(starts[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        at, grams, n, norms, dense = _grams(texts[first : first + count])
        for begin in range(0, count, 512):
            score = dense[begin : begin + 512] @ dense.T
            j, i = np.nonzero(score >= least * np.outer(norms[begin : begin + 512], norms))
            j += begin
            met = meet(i + first, j + first)
            for x, y in zip(i[met].tolist(), j[met].tolist(), strict=True):
                if not found[first + y] and norms[x] and norms[y]:
                    _, p, q = np.intersect1d(grams[at[x] : at[x + 1]], grams[at[y] : at[y + 1]], True, True)
                    found[first + y] = np.round((n[at[x] : at[x + 1]][p] @ n[at[y] : at[y + 1]][q]) / (norms[x] * norms[y]), 9) >= threshold
    return pa.RecordBatch.from_arrays([pa.array(paper[found]), pa.array(qid[found])], ["paper_id", "qid"])


def near_duplicate_questions(q: DataFrame, threshold: float = 0.9, block: int = 2_048) -> DataFrame:
    """(paper_id, qid) of questions whose 2-gram cosine with any earlier one of the paper reaches the threshold.

    A text moves once, to the questions of its paper; grams never become rows. Papers of more than ``block`` questions are dealt into
    parts, and each two parts meet in a group of their own, so no task holds more than two parts at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            paper, a, b = (held[c].to_numpy() for c in ("paper_id", "a", "b"))
            open_ = int(np.argmax((paper == paper[-1]) & (a == a[-1]) & (b == b[-1]))) if len(paper) else 0  # the last group may go on
            if open_:
                yield _alike(held.slice(0, open_), threshold)
                held = held.slice(open_)
        if held is not None and held.num_rows:
            yield _alike(held, threshold)

    text = F.regexp_replace(F.concat_ws(" ", "stem", F.coalesce("knowledge_point", F.lit(""))), r"(?U)\s+", "")
    long = q.groupBy("paper_id").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).filter("parts > 1")
    rows = q.select("paper_id", F.col("qid").cast("bigint").alias("qid"), text.alias("text")).join(small_enough(written(long, "long-papers")), "paper_id", "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("qid"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = {"a": F.least("part", "other"), "b": F.greatest("part", "other")}
    rows = rows.select(F.col("paper_id").cast("bigint").alias("paper_id"), *[c.alias(k) for k, c in keys.items()], "part", "qid", "text")
    rows = rows.repartition("paper_id", "a", "b").sortWithinPartitions("paper_id", "a", "b", "qid")
    return rows.mapInArrow(run, "paper_id bigint, qid bigint").distinct()


def _point() -> Column:
    return F.when(strip(F.coalesce("knowledge_point", F.lit(""))) == "", UNLABELLED).otherwise(F.col("knowledge_point"))


def knowledge_balance(q: DataFrame, duplicates: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(paper_id, qid) of the first non-duplicates of points that have more than their share of the paper."""
    paper, point = Window.partitionBy("paper_id"), Window.partitionBy("paper_id", "kp")
    rows = q.select("paper_id", "qid", _point().alias("kp")).withColumn("n", F.count("*").over(paper)).filter("n > 1")
    rows = rows.withColumn("excess", F.count("*").over(point) - F.greatest(F.lit(1), F.ceil(F.col("n") * ratio))).filter("excess > 0")
    own = rows.join(duplicates, ["paper_id", "qid"], "left_anti").withColumn("k", F.row_number().over(point.orderBy("qid")))
    return own.filter(F.col("k") <= F.col("excess")).select("paper_id", "qid")


def parse_verdict(output: Column) -> Column:
    """pass or fail: the model's JSON verdict, else by negative words in its text.

    ``fail`` is a negative word, so without escapes JSON can only turn what the words say from fail to pass, and only if the text
    has ``pass`` in it; the JSON of other outputs is not parsed.
    """
    text = F.coalesce(output, F.lit(""))
    told = F.lower(strip(F.get_json_object(extract_json_object(output), "$.verdict")))
    by_words = lambda bad: F.when(bad, "fail").otherwise("pass")
    by_json = lambda bad: once(told, lambda x: F.when(x.isin("pass", "fail"), x).otherwise(by_words(bad)))

    def judged(low: Column) -> Column:
        open_ = lambda bad: F.contains(text, F.lit("\\")) | (bad & F.contains(low, F.lit("pass")))
        words = reduce(Column.__or__, [F.contains(low, F.lit(word)) for word in NEGATIVE])
        return once(words, lambda bad: F.when(open_(bad), by_json(bad)).otherwise(by_words(bad)))

    return once(F.lower(text), judged)


def collect_rejections(model: DataFrame, rules: DataFrame) -> DataFrame:
    """(paper_id, qid, source): model failures, and rule failures that are not among them."""
    m = written(model.select("paper_id", "qid").distinct(), "model-failures")  # used twice
    return m.withColumn("source", F.lit("model")).unionByName(rules.select("paper_id", "qid").distinct().join(m, ["paper_id", "qid"], "left_anti").withColumn("source", F.lit("rule")))


def grade_objective(kind: Column, reference: Column, answer: Column, most: Column) -> Column:
    """Points for a choice or fill answer by rule; 0 for other types.

    An empty fill reference gives full marks to any non-empty answer, as every text contains it.
    """
    ref, got = strip(F.coalesce(reference, F.lit(""))), strip(F.coalesce(answer, F.lit("")))
    first = lambda c: F.upper(F.substring(c, 1, 1))
    choice = F.when((ref != "") & (got != "") & (first(ref) == first(got)), most).otherwise(0)
    r, s = norm_answer(ref), norm_answer(got)
    parts = F.filter(F.split(r, TERM_MARKS), lambda x: x != "")
    terms = F.when(F.size(parts) > 0, parts).otherwise(F.array(r))
    matched = F.size(F.filter(terms, lambda x: F.contains(s, x)))
    fill = F.when(s == "", 0).when(r == s, most).when(matched == 0, 0).otherwise(F.greatest(F.bround(most * matched / F.size(terms)), F.lit(0)))
    return F.when(kind == "choice", choice).when(kind == "fill", fill).otherwise(0).cast("bigint")


def grade_sheets(sheets: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(sheet_id, paper_id, qid, type, points, score, correct): every question of the sheet's paper; a missing answer is empty."""
    rows = sheets.select("sheet_id", "paper_id").join(questions, "paper_id").join(answers.select("sheet_id", "qid", F.col("answer").alias("given")), ["sheet_id", "qid"], "left")
    rows = rows.withColumn("points", grade_objective(F.col("type"), F.col("answer"), F.col("given"), F.col("score")))
    return rows.select("sheet_id", "paper_id", "qid", "type", "points", "score", (F.col("points") == F.col("score")).alias("correct"))


def dimension_weights(weights: list[Column]) -> list[Column]:
    """Weights as shares of their sum; equal shares where that is not positive."""
    total = sum(weights[1:], weights[0])
    return [F.when(total > 0, w / total).otherwise(1.0 / len(weights)) for w in weights]


def dimension_max_scores(most: Column, weights: list[Column]) -> list[Column]:
    """The maximum split by weight in whole points: floors, then one each by largest remainder, ties in order."""
    exact = [most * w for w in weights]
    floors = [F.floor(F.round(x, 9)) for x in exact]
    rest = [F.round(x - f, 9) for x, f in zip(exact, floors, strict=True)]
    left = most - sum(floors[1:], floors[0])
    rank = [sum(((other > own) if j > i else (other >= own)).cast("int") for j, other in enumerate(rest) if j != i) for i, own in enumerate(rest)]
    return [(f + (r < left).cast("int")).cast("bigint") for f, r in zip(floors, rank, strict=True)]


def grade_subjective(rows: DataFrame, output: Column, maxima: list[Column], context: Column) -> DataFrame:
    """Adds scores: for each dimension (key, score, max_score, comment, source_refs) from model JSON ``{"dimensions": [{"key", "score", ...}]}``.

    Keys count in lower case and by their other names; of several entries the last holds, what is not an
    object is passed over. A number is cut to a whole one, a text counts only if it is one; scores stay within
    0 and the dimension's maximum. References are those that the context holds verbatim.
    """
    text = lambda v, at: strip(F.coalesce(F.try_variant_get(v, at, "string"), F.lit("")))

    def entry(v: Column) -> Column:
        told = F.try_variant_get(v, "$.score", "variant")
        number, plain = F.try_variant_get(told, "$", "double"), F.try_variant_get(told, "$", "string")
        whole = F.when(F.schema_of_variant(told) != "STRING", F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
        whole = F.coalesce(whole, F.when(plain.rlike(r"(?U)^\s*[+-]?\d+\s*$"), strip(plain).try_cast("bigint")), F.lit(0))
        return F.struct(F.lower(text(v, "$.key")).alias("key"), whole.alias("score"), text(v, "$.comment").alias("comment"), F.try_variant_get(v, "$.source_refs", "array<string>").alias("refs"))

    # Each step is a column of its own, so that the JSON is read once a row.
    rows = rows.withColumn("_json", F.from_json(extract_json_object(output), "struct<dimensions:array<variant>>")["dimensions"])
    rows = rows.withColumn("_told", F.transform("_json", entry))
    last = lambda dim: F.try_element_at(F.filter("_told", lambda x: x["key"].isin(*ALIASES[dim])), F.lit(-1)).alias(dim)
    rows = rows.withColumn("_last", F.struct(*map(last, DIMENSIONS)))
    one = lambda dim, top: F.struct(
        F.lit(dim).alias("key"), F.greatest(F.least(F.coalesce(F.col(f"_last.{dim}.score"), F.lit(0)), top), F.lit(0)).cast("bigint").alias("score"), top.cast("bigint").alias("max_score"),
        F.coalesce(F.col(f"_last.{dim}.comment"), F.lit("")).alias("comment"), anchored(F.col(f"_last.{dim}.refs"), context).alias("source_refs"),
    )
    return rows.withColumn("scores", F.array(*[one(d, m) for d, m in zip(DIMENSIONS, maxima, strict=True)])).drop("_json", "_told", "_last")


def anchored(refs: Column, context: Column) -> Column:
    """The trimmed references that are verbatim in the context."""
    return F.filter(normalize_text_list(refs), lambda r: F.contains(context, r))


def anchor_references(refs: Column, context: Column, best: Column) -> Column:
    """Trimmed references that are verbatim in the context; none: the first 120 characters of the two best chunks; six at most."""
    kept = anchored(refs, context)
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(F.transform(F.slice(best, 1, 2), lambda c: F.substring(c, 1, 120))), 1, 6)


def without_model(answer: Column, found: Column) -> list[Column]:
    """missing, error and points of a short answer that no model is asked about: a blank one, or one without material; else NULL."""
    blank = strip(F.coalesce(answer, F.lit(""))) == ""
    return [
        F.when(blank, "未作答").when(~found, "未检索到课件素材，无法溯源批改").alias("missing"),
        F.when(~blank & ~found, "RAG 检索为空").alias("error"), F.when(blank | ~found, 0).alias("points"),
    ]


def error_material(own: Column, retrieved: Column, already: Column) -> Column:
    """Material for a wrong answer: own references, else the three best retrieved; merged in order without repeats."""
    return F.array_distinct(F.concat(already, F.when(F.size(own) > 0, own).otherwise(F.slice(retrieved, 1, 3))))


def paper_rollup(q: DataFrame) -> DataFrame:
    """Per paper: total score, counts by type, reference answers in order."""
    count = lambda k: F.count(F.when(F.col("type") == k, 1)).alias(f"n_{k}")
    answers = F.array_sort(F.collect_list(F.struct("qid", "answer")))
    return q.groupBy("paper_id").agg(F.sum("score").alias("total_score"), *map(count, TYPES), F.array_join(F.transform(answers, lambda a: F.concat_ws(":", a["qid"], a["answer"])), ";").alias("answers"))


def paper_detail(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """(paper_id, questions, reference_answers): lists of a paper as JSON for its reader; the role read sees neither answers nor the list of them.

    ``papers``: paper_id, role; ``questions``: paper_id, qid, stem, answer.
    """
    hidden = F.col("role") == "read"
    rows = questions.join(papers.select("paper_id", "role"), "paper_id")
    one = F.struct("qid", "stem", F.when(~hidden, F.col("answer")).alias("answer"))
    told = F.when(~hidden, F.struct("qid", "answer"))
    listed = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("q"), F.array_sort(F.collect_list(told)).alias("a"))
    return listed.select("paper_id", F.to_json("q").alias("questions"), F.when(F.size("a") > 0, F.to_json("a")).alias("reference_answers"))


def knowledge_stats(q: DataFrame) -> DataFrame:
    """Questions by knowledge point of each paper with a tag size; blank points under one name."""
    rows = q.groupBy("paper_id", _point().alias("kp")).agg(F.count("*").alias("n"))
    return rows.withColumn("size", F.round(0.95 + 1.15 * F.col("n") / F.max("n").over(Window.partitionBy("paper_id")), 6))


def knowledge_radar(stats: DataFrame, axes: int = 6) -> DataFrame:
    """The top points and the sum of the rest as shares of the largest; only papers with three axes at least."""
    ranked = stats.withColumn("k", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("n"), "kp")))
    rows = ranked.groupBy("paper_id", F.when(F.col("k") <= axes, F.col("kp")).otherwise(OTHERS).alias("axis")).agg(F.sum("n").alias("n"))
    paper = Window.partitionBy("paper_id")
    rows = rows.withColumns({"value": F.round(F.col("n") / F.max("n").over(paper), 6), "_a": F.count("*").over(paper)})
    return rows.filter("_a >= 3").drop("_a")


def visibility(sheets: DataFrame, members: DataFrame) -> DataFrame:
    """(kb_id, user_id, scope, sheet_id): ``all`` once for each member from write on, ``own`` for each sheet of a member below that.

    ``sheets``: sheet_id, student_id, kb_id; ``members``: live rows of kb_id, user_id, role.
    """
    may = allowed(F.col("role"), F.lit("write"))
    every = members.filter(may).select("kb_id", "user_id", F.lit("all").alias("scope"), F.lit(None).cast("bigint").alias("sheet_id"))
    own = members.filter(~may & allowed(F.col("role"), F.lit("read"))).select("kb_id", "user_id").join(sheets.withColumnRenamed("student_id", "user_id"), ["kb_id", "user_id"])
    return every.unionByName(own.select("kb_id", "user_id", F.lit("own").alias("scope"), "sheet_id"))


def _lists(rows: DataFrame, column: str, most: int) -> DataFrame:
    """(kb_id, column, column_list): the column's values of each knowledge base in lists of ``most`` or less, NULLs among them, each list with a number."""
    parts = rows.groupBy("kb_id").agg(F.ceil(F.count("*") / (16 * most)).alias("parts"))
    dealt = rows.join(small_enough(written(parts, "parts")), "kb_id").groupBy("kb_id", F.pmod(F.xxhash64(column), "parts").alias("part"))
    none = F.array_repeat(F.lit(None).cast(rows.schema[column].dataType), (F.count("*") - F.count(column)).cast("int"))
    dealt = dealt.agg(F.concat(F.array_sort(F.collect_list(column)), none).alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / most)), lambda i: F.slice("all", i * most + 1, most))
    return written(dealt.select("kb_id", F.explode(cut).alias(column)).withColumn(f"{column}_list", F.monotonically_increasing_id()), f"{column}-lists")


def visible_pairs(sheets: DataFrame, members: DataFrame, wide: int = 512, high: int = 16_384) -> DataFrame:
    """(sheet_id, user_id) for every sheet that a user may see; both sides written.

    There are as many pairs as sheets times members in a knowledge base. Each list of ``wide`` members meets each list of ``high``
    sheets in a tile, and only there rows become pairs, which are not moved. A merge join gives all members of a tile to one sheet after
    the other: sheets come in runs and members in a short cycle, which a columnar file holds in far less than a byte a pair.
    """
    rules = visibility(sheets, members)
    users = _lists(rules.filter("scope = 'all'").select("kb_id", "user_id"), "user_id", wide)
    dealt = _lists(sheets.select("kb_id", "sheet_id"), "sheet_id", high)
    count = lambda lists, name: lists.groupBy("kb_id").agg(F.count("*").alias(name))
    tiles = count(users, "u").join(count(dealt, "s"), "kb_id").agg(F.sum(F.col("u") * F.col("s"))).first()[0]
    at = ["user_id_list", "sheet_id_list"]

    def rows(own: DataFrame, other: DataFrame, column: str) -> DataFrame:
        moved = own.join(other.select("kb_id", *(c for c in at if c in other.columns)), "kb_id").repartition(max(1, tiles or 0), *at)
        return moved.select(*at, F.explode(column).alias(column))

    pairs = rows(dealt, users, "sheet_id").hint("merge").join(rows(users, dealt, "user_id"), at)
    return pairs.select("sheet_id", "user_id").unionByName(rules.filter("scope = 'own'").select("sheet_id", "user_id"))


def iteration_summary(q: DataFrame, trace: DataFrame) -> DataFrame:
    """(paper_id, questions, by_model, by_rule, stop) of one iteration from its rejections (paper_id, qid, source)."""
    by = lambda source: F.count(F.when(F.col("source") == source, 1)).alias(f"by_{source}")
    rejected = trace.groupBy("paper_id").agg(by("model"), by("rule"))
    rows = q.groupBy("paper_id").agg(F.count("*").alias("questions")).join(rejected, "paper_id", "left").fillna(0, ["by_model", "by_rule"])
    return rows.withColumn("stop", (F.col("by_model") == 0) & (F.col("by_rule") == 0))


def regeneration_rounds(q: DataFrame, candidates: DataFrame, check, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Validate, replace rejected questions by the round's candidates, validate again; at most ``rounds`` times.

    ``check(q)`` gives (paper_id, qid) to reject, ``candidates`` are questions with a ``round``. The
    state of each round is checkpointed, so that plans stay short and lost executors do not matter.
    Returns the questions and the append-only trace (round, paper_id, rejected).
    """
    trace = None
    for i in range(1, rounds + 1):
        rejected = check(q).checkpoint()
        step = rejected.groupBy("paper_id").agg(F.count("*").alias("rejected")).select(F.lit(i).cast("bigint").alias("round"), "paper_id", "rejected")
        trace = step if trace is None else trace.unionByName(step)
        if rejected.isEmpty():
            break
        q = merge_regenerated(q, rejected, candidates.filter(F.col("round") == i).drop("round")).checkpoint()
    return q, trace
