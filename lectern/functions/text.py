"""Text rules as native column expressions. White space and length follow Unicode code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = (
    "的", "了", "和", "是", "就", "都", "而", "及", "与", "着", "或", "一个", "没有", "我们", "你们", "他们",
    "她们", "它们", "这", "那", "这个", "那个", "这些", "那些", "这样", "那样", "也", "还", "又", "再", "就", "才",
    "只", "很", "更", "最", "在", "有", "不", "人", "上", "中", "下", "为", "以", "于", "对", "从",
    "到", "被", "把", "让", "给", "向", "由", "等", "啊", "呢", "吧", "吗", "哦", "嗯", "哈", "呀",
    "啦",
)
NO_ANSWER = (
    "不知道", "无法回答", "没有找到", "未找到", "未提供", "未提及", "没有相关信息", "无法提供", "无可奉告", "不清楚", "没有相关",
    "未检索到", "知识库中不存在", "暂无", "no information", "not found",
)
CJK_PUNCTUATION = ("，。！？：；“”‘’（）【】《》", ",.!?:;\"\"''()[]<>")
EXTENSIONS = {".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".txt": "txt", ".png": "image", ".jpg": "image", ".jpeg": "image"}
TYPE_QUERIES = {
    "choice": "核心概念 定义 术语 分类 特点", "fill": "关键名词 公式 结论 要点 规则", "short": "原理 应用 论述 总结 对比 关系",
}
DEFAULT_TYPE_QUERY = "课程重点 核心知识点 概述"
#: Control characters but line feeds and tabs.
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"
#: Every character of Unicode's white space, as ``(?U)\s`` has them; trimming them by name needs no pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A word of letters and digits outside the Chinese block, or one Chinese character.
TOKEN = r"[\p{L}\p{N}&&[^一-鿿]]+|[一-鿿]+"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def remove_extra_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """No control characters but line feeds and tabs; trimmed lines; runs of empty lines made one."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), CONTROL, "")
    lines = F.transform(F.split(c, "\n", -1), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def normalize_cjk_punctuation(c: Column) -> Column:
    return F.translate(c, *CJK_PUNCTUATION)


def normalize_chunk_text(c: Column) -> Column:
    """Blanks made one, lines trimmed, runs of empty lines made one; a text whose white space is in order already is only looked through."""
    odd = c.rlike(r"(?U)[\s&&[^ \n]]| [ \n]|\n |\n{3}|^\s|\s$")
    one = F.regexp_replace(F.regexp_replace(c, "[ \t　]+", " "), "\n{3,}", "\n\n")
    return F.when(odd, strip(F.array_join(F.transform(F.split(one, "\n", -1), strip), "\n"))).otherwise(c)


def strip_markdown(c: Column) -> Column:
    """Markup removed by twelve ordered rules, text kept. Only a line feed ends a line."""
    # What counts as markup, in this order.
    rules = (
        (r"```[a-zA-Z0-9]*\n?", ""), (r"```", ""), (r"(?mdU)^\s{0,3}#{1,6}\s*", ""), (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?d)(\*\*|__)(.*?)\1", "$2"), (r"(?d)(\*|_)(.*?)\1", "$2"), (r"(?d)~~(.*?)~~", "$1"),
        (r"(?mdU)^\s{0,3}(>\s?)", ""), (r"(?mdU)^\s{0,3}[-*+]\s+", ""), (r"(?mdU)^\s{0,3}\d+\.\s+", ""),
        (r"(?mdU)^\s{0,3}([-*_])\s*(?:\1\s*){2,}$", ""),
    )
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def truncate_text(c: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - len(suffix)), F.lit(suffix)))


def truncate_by_tokens(c: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.floor(F.length(c) * 1.2) <= n, c).otherwise(truncate_text(c, int(n / 1.2), suffix))


def count_tokens_estimate(c: Column) -> Column:
    others = F.length(F.regexp_replace(c, r"[一-鿿]", ""))
    return F.floor((F.length(c) - others) * 1.5 + others * 0.25).cast("bigint")


def tokenize(c: Column, *, stopwords: bool = False, lower: bool = True) -> Column:
    """Words outside Chinese; Chinese runs give their characters and bigrams. With stop-words these and 1-character tokens go.

    Of ``clean_text`` only what may join or part words is done here: trimming and runs of empty lines touch no token.
    """
    c = F.regexp_replace(F.regexp_replace(c, "\r", "\n"), CONTROL, "")
    runs = F.regexp_extract_all(F.lower(c) if lower else c, F.lit(TOKEN), F.lit(0))
    cjk = lambda r: r.rlike(r"^[一-鿿]")
    parts = F.transform(runs, lambda r: F.when(cjk(r), F.concat(
        F.regexp_extract_all(r, F.lit("."), F.lit(0)),
        F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>")),
    )).otherwise(F.array(r)))
    # Texts without Chinese, whose runs are their tokens, are not taken apart run by run.
    out = F.when(c.rlike(r"[一-鿿]"), F.flatten(parts)).otherwise(runs)
    return F.filter(out, lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1)) if stopwords else out


def char_ngrams(c: Column, n: int = 2) -> Column:
    """n-grams of the text without white space, repeats kept; a shorter text is one gram, an empty one none."""
    t = F.regexp_replace(c, r"(?U)\s+", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: t.substr(i, F.lit(n)))
    return F.when(F.length(t) > 0, grams).otherwise(F.array().cast("array<string>"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is 0; vectors of different length are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length")).cast("double"))
    return F.coalesce(same, F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def no_answer_flag(c: Column) -> Column:
    return F.lower(c).rlike("|".join(NO_ANSWER))


def norm_answer(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def excerpt(c: Column, n: int = 80) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def citation_label(name: Column, doc: Column, page: Column, index: Column) -> Column:
    """Name, page if there is one, block number from 1; NULL name gives a default."""
    return F.concat_ws(
        " · ", F.coalesce(F.when(name != "", name), F.concat(F.lit("文档"), doc.cast("string"))),
        F.when(page > 0, F.concat(F.lit("第"), page.cast("string"), F.lit("页"))), F.concat(F.lit("块"), (index + 1).cast("string")),
    )


def sanitize_filename(c: Column) -> Column:
    """The last part of a path with safe characters only, at most 196 characters and the extension; "unnamed" if nothing is left."""
    base = F.regexp_extract(c, r"(?s)([^/]*)$", 1)
    name = F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_.\-]", "_"), r"^\.+", "")
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.least(F.length(name) - F.length(extension), F.lit(196)))
    short = F.when(F.length(name) > 200, F.concat(stem, extension)).otherwise(name)
    return F.when(short == "", "unnamed").otherwise(short)


def format_file_size(size: Column) -> Column:
    fixed = lambda x, d: F.regexp_replace(F.format_number(x, d), ",", "")
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(fixed(size / 1024, 1), F.lit(" KB")))
        .when(size < 1024**3, F.concat(fixed(size / 1024**2, 1), F.lit(" MB")))
        .otherwise(F.concat(fixed(size / 1024**3, 2), F.lit(" GB")))
    )


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))


def document_type(name: Column) -> Column:
    """Type by extension, NULL if it is not a supported one."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(known, file_extension(name))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def strip_code_fence(c: Column) -> Column:
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    return once(c, lambda x: strip(F.when(F.contains(x, F.lit("```")) & x.rlike(fence), F.regexp_extract(x, fence, 1)).otherwise(x)))


def _json_between(c: Column, first: str, last: str) -> Column:
    """Text of the JSON value in ``c``: the whole, else from the first opening to the last closing mark; NULL if neither parses.

    What cannot be such a value by its ends is not parsed.
    """
    valid = lambda x: F.when(x.rlike(rf"^\s*\{first}") & F.try_parse_json(x).isNotNull(), x)

    def between(s: Column) -> Column:
        begin = F.instr(s, first)
        length = F.length(s) - F.instr(F.reverse(s), last) + 2 - begin  # no closing mark: one too many, so there must be one
        cut = F.when((begin > 0) & F.contains(s, F.lit(last)) & (length > 1), F.substring(s, begin, length))
        return F.coalesce(valid(s), F.when(begin > 0, once(cut, lambda x: F.when(x != s, valid(x)))))

    return once(strip_code_fence(c), between)


def extract_json_object(c: Column) -> Column:
    return _json_between(c, "{", "}")


def extract_json_array(c: Column) -> Column:
    return _json_between(c, "[", "]")


def normalize_text_list(c: Column) -> Column:
    """Array of trimmed non-blank texts; NULL gives an empty one."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))


def parse_rewrites(output: Column, original: Column, count: int = 2) -> Column:
    """Queries to run: the original, then up to ``count`` (1 or 2) rewrites from a JSON list or from lines.

    A line loses one number or bullet in front, then double and single quotes at its ends.
    """
    raw = strip(F.coalesce(output, F.lit("")))
    listed = F.when(raw.rlike(r"^\[") & F.try_parse_json(raw).isNotNull(), F.from_json(raw, "array<string>"))
    bare = lambda x: F.regexp_replace(strip(F.regexp_replace(strip(x), r"^(?:\d+[.、)\-]|[-*·])(?U)\s*", "")), r'^"+|"+$', "")
    lines = F.array_distinct(F.filter(F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(bare(x), "^'+|'+$", "")), lambda x: x != ""))
    found = F.filter(F.coalesce(F.filter(F.transform(listed, strip), lambda x: x != ""), lines), lambda x: x != original)
    return F.concat(F.array(original), F.slice(found, 1, max(1, min(2, count))))


def auto_title(kb: Column, difficulty: Column, day: Column) -> Column:
    grade = F.when(difficulty == "easy", "易").when(difficulty == "hard", "难").otherwise("中")
    return F.concat(kb, F.lit("试卷-"), grade, F.lit("等-"), F.date_format(day, "yyyyMMdd"))


def retrieval_queries(choice: Column, fill: Column, short: Column) -> Column:
    """One fixed query for each question type that is asked for, the default one if none is."""
    asked = {"choice": choice, "fill": fill, "short": short}
    some = F.filter(F.array(*[F.when(n > 0, TYPE_QUERIES[k]) for k, n in asked.items()]), lambda q: q.isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(DEFAULT_TYPE_QUERY)))
