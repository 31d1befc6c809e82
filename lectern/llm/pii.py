"""Personal data by weak supervision, in native expressions.

Candidates are the base spans (email, ip, card, phone) and spans of further patterns (id, iban,
local phone numbers, spelled-out emails). Five labelers vote on each: form, structure, gazetteer,
context, boundary. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is for each kind; its posteriors are the soft labels from which a naive Bayes span
classifier over votes and surface features is trained. Base spans always stay; further candidates
are reported if the classifier gives them at least ``threshold``.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise
from lectern.llm.spans import apart, listed, near, piecewise, with_spans

#: Kinds in the order of listing; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "id", "iban", "local", "spelled")
LABELERS = ("form", "structure", "gazetteer", "context", "boundary")

# Gazetteers and cue words.
TOP_DOMAINS = "com org net edu gov io co info de fr es uk it nl eu ch at be us ca au jp cn br in".split()
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|62)"
COUNTRY_CODES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|37[0-9]|38[0-9]|42[0-3])"
IBAN_COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel", "ip": r"\bip\b|address|host|server|login",
    "card": "card|visa|master|credit|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax|anruf|appel|llam",
    "id": "ssn|social|security|passport|ausweis", "iban": "iban|bank|account|konto|compte|cuenta",
    "local": "phone|tel|call|mobile|fax|anruf|appel|llam", "spelled": "mail|contact|write",
}
AGAINST = r"isbn|version|order no|invoice|sku|doi|page|section"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the check; true for the empty string."""
    total = F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0),
        lambda a, i: a + F.when(
            i % 2 == 1,
            F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), _digit(digits, i) + 1),
        ).otherwise(_digit(digits, i)),
    )
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(True)


def _digit(digits: Column, from_right: Column) -> Column:
    return F.substring(digits, F.length(digits) - from_right, F.lit(1)).cast("int")


def _small(part: Column) -> Column:
    """A digit string of a number at most 255."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)


def candidates(rows: DataFrame, text: str) -> DataFrame:
    """Adds one span array for each kind.

    Single separators between digits (or dots between name parts) are first replaced by one control
    character, so that repeated groups become plain character classes: same matches, no recursion
    however long the text.
    """
    c = F.col(text)
    clean = F.translate(c, "\x01", "\x02")
    at = F.contains(c, F.lit("@"))
    rows = rows.withColumn("_dots", F.when(at, F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x01")).otherwise(""))
    rows = rows.withColumn("_runs", F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", "\x01"))
    rows = with_spans(rows, "email", "_dots", r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++", at)
    rows = with_spans(rows, "ip", text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", F.contains(c, F.lit(".")))
    rows = with_spans(rows, "card", "_runs", r"[0-9][0-9\x01]++")
    rows = with_spans(rows, "phone", text, r"\+[0-9][\x20().0-9-]+[0-9]", F.contains(c, F.lit("+")))
    rows = with_spans(rows, "id", text, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", F.contains(c, F.lit("-")))
    rows = with_spans(rows, "iban", text, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
    rows = with_spans(rows, "local", text, r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
    rows = with_spans(rows, "spelled", text, r"(?<![A-Za-z0-9])[a-z0-9_]{2,30} (?:at|\(at\)|\[at\]) [a-z0-9]{2,30} (?:dot|\(dot\)|\[dot\]) [a-z]{2,6}(?![A-Za-z0-9])", F.contains(c, F.lit("at")))
    digits = lambda s: F.length(_digits(s["match"]))
    return rows.withColumns({
        "ip": F.filter("ip", lambda s: F.forall(F.split(s["match"], r"\."), _small)),
        "card": F.filter(F.filter("card", lambda s: digits(s).between(16, 19)), lambda s: luhn(_digits(s["match"]))),
        "phone": F.filter("phone", lambda s: digits(s).between(8, 15)),
    }).drop("_dots", "_runs")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def voted(spans: Column, kind: str, pieces: Column) -> Column:
    """Spans with the five votes (1 for, 0 abstains, -1 against) and surface features; ``pieces`` are the text's."""

    def one(s: Column) -> Column:
        m = F.replace(s["match"], F.lit("\x01"), F.lit("."))
        before = F.lower(near(pieces, F.greatest(s["start"] - 30, F.lit(0)), F.least(s["start"], F.lit(30))))
        last = F.when(s["start"] > 0, near(pieces, F.greatest(s["start"] - 1, F.lit(0)), F.lit(1))).otherwise("")
        after = near(pieces, s["end"], F.lit(1))
        d = _digits(m)
        spread = F.size(F.array_distinct(F.regexp_extract_all(d, F.lit("."), F.lit(0))))
        form, structure, gazetteer = {
            "email": (m.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@") | m.rlike("^[A-Za-z0-9]@"), F.length(m) <= 254, m.rlike(rf"\.({'|'.join(TOP_DOMAINS)})$")),
            "ip": (m.rlike(r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$"), ~m.rlike(r"^(0|255)\."), ~m.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$")),
            "card": (F.length(d).isin(16, 19), spread >= 4, d.rlike(CARD_PREFIX)),
            "phone": (F.length(d).between(10, 13), spread >= 4, m.rlike(COUNTRY_CODES)),
            "id": (~m.rlike("^(000|666|9)"), ~m.rlike("-00-|-0000$"), spread >= 4),
            "iban": (F.length(F.replace(m, F.lit(" "))).between(15, 34), F.length(d) >= 10, F.substring(m, 1, 2).isin(*IBAN_COUNTRIES)),
            "local": (m.rlike(r"^\([0-9]{3}\)|^[0-9]{3}[-.]"), spread >= 4, ~m.rlike(r"^\(?[01]")),
            "spelled": (m.rlike(r"\(|\["), F.length(m) <= 80, m.rlike(rf" ({'|'.join(TOP_DOMAINS)})$")),
        }[kind]
        votes = {
            "form": _vote(form, ~form), "structure": _vote(structure, ~structure), "gazetteer": _vote(gazetteer, F.lit(False)),
            "context": _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)),
            "boundary": _vote(~last.rlike("[A-Za-z0-9_]") & ~after.rlike("[A-Za-z0-9_]"), last.rlike("[A-Za-z0-9_]") | after.rlike("[A-Za-z0-9_]")),
        }
        surface = {
            "size": F.least(F.floor(F.length(m) / 4), F.lit(9)).cast("int"),
            "left": F.when(last == "", 0).when(last.rlike(r"\s"), 1).when(last.rlike("[:=<(\"']"), 2).otherwise(3),
            "right": F.when(after == "", 0).when(after.rlike(r"\s"), 1).when(after.rlike("[.,;:!?>)\"']"), 2).otherwise(3),
        }
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
                        *[v.cast("int").alias(k) for k, v in (votes | surface).items()])

    return F.transform(spans, one)


FEATURES = (*LABELERS, "size", "left", "right")


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict:
    """EM over (kind, votes, count): posterior that a candidate with these votes is personal data.

    Two classes for each kind; a labeler's vote has its own distribution in each class. Starts from
    labelers right nine times of ten; add-one smoothing keeps that direction where data are few.
    At most 8 kinds x 3^5 patterns come in, whatever the corpus.
    """
    post = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        share = 0.5
        cond = [[{1: 0.6, 0: 0.35, -1: 0.05}, {1: 0.2, 0: 0.35, -1: 0.45}] for _ in LABELERS]
        for _ in range(rounds):
            for votes, _ in own:
                logs = [math.log(p) + sum(math.log(cond[j][c][v]) for j, v in enumerate(votes)) for c, p in ((0, share), (1, 1 - share))]
                post[kind, votes] = 1 / (1 + math.exp(min(700, logs[1] - logs[0])))
            total = sum(n for _, n in own)
            share = (sum(n * post[kind, v] for v, n in own) + 1) / (total + 2)
            for j in range(len(LABELERS)):
                for c in (0, 1):
                    weight = {x: 1.0 + 2 * {1: 0.6, 0: 0.35, -1: 0.05}[x if c == 0 else -x if x else 0] for x in (1, 0, -1)}
                    for votes, n in own:
                        weight[votes[j]] += n * (post[kind, votes] if c == 0 else 1 - post[kind, votes])
                    whole = sum(weight.values())
                    cond[j][c] = {x: w / whole for x, w in weight.items()}
    return post


def train(scanned: DataFrame) -> tuple[dict, dict]:
    """Naive Bayes weights: log prior odds by kind, log odds by (kind, feature, value).

    The driver gets counts by vote pattern and by feature value only, both bounded by the numbers
    of kinds and values; the posteriors go back as literals.
    """
    spans = scanned.select(F.explode("spans").alias("s")).select("s.*")
    votes = F.concat_ws(",", "kind", *LABELERS)
    counts = spans.groupBy(votes.alias("p")).count().collect()
    read = [tuple(map(int, r["p"].split(","))) for r in counts]
    post = reliabilities([(p[0], p[1:], r["count"]) for p, r in zip(read, counts, strict=True)])
    if not post:
        return {}, {}
    table = F.create_map(*chain.from_iterable((F.lit(",".join(map(str, (k, *v)))), F.lit(float(p))) for (k, v), p in post.items()))
    soft = spans.withColumn("p", F.element_at(table, votes))
    feature = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x")
    sums = soft.select("kind", "p", feature).groupBy("kind", "x.f", "x.v").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    prior, odds = {}, {}
    for kind in {r["kind"] for r in sums}:
        own = [r for r in sums if r["kind"] == kind]
        yes, no = (sum(r[c] for r in own if r["f"] == "form") for c in ("yes", "no"))
        prior[kind] = math.log((yes + 1) / (no + 1))
        for r in own:
            odds[kind, r["f"], r["v"]] = math.log((r["yes"] + 1) / (yes + 3)) - math.log((r["no"] + 1) / (no + 3))
    return prior, odds


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, counts of base kinds, base_sha256, spans, found (all spans with scores).

    A null text counts as empty. Rows come through one by one: null and repeated ids, repeated rows
    and columns of other names need no care; an empty table gives an empty result. The text is read
    once; EM, training and the final selection read the written span table. Added spans overlap no
    base span; among themselves they may.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = candidates(rows, "_text").withColumn("_pieces", piecewise("_text"))
    spans = F.concat(*[voted(F.col(k), k, F.col("_pieces")) for k in KINDS])
    scanned = materialise(found.select("doc_id", spans.alias("spans")), "pii")
    prior, odds = train(scanned)
    score = None
    if prior:
        kinds = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in prior.items()))
        weights = F.create_map(*chain.from_iterable((F.lit(f"{k},{f},{v}"), F.lit(w)) for (k, f, v), w in odds.items()))

        def score(s: Column) -> Column:
            logit = F.element_at(kinds, s["kind"])
            for f in FEATURES:
                logit = logit + F.coalesce(F.element_at(weights, F.concat_ws(",", s["kind"], F.lit(f), s[f])), F.lit(0.0))
            return 1 / (1 + F.exp(-logit))

    names = F.array(*map(F.lit, KINDS))
    named = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(
        s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"),
        F.element_at(names, s["order"] + 1).alias("kind"), s["score"].alias("score"))))
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("order"), s["start"].alias("start"), s["end"].alias("end"),
                                                     (score(s) if prior else F.lit(1.0)).alias("score")))
    out = scanned.withColumn("scored", scored)
    out = out.withColumn("base", named(F.filter("scored", lambda s: s["order"] < 4)))
    by_place = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["order"].alias("order"), s["score"].alias("score"))))
    added = F.filter("scored", lambda s: (s["order"] >= 4) & (s["score"] >= threshold))
    out = apart(out, "_added", by_place(added), by_place(F.filter("scored", lambda s: s["order"] < 4)))
    out = out.withColumn("found", F.concat("base", named(F.col("_added"))))
    n = {f"n_{k}": F.size(F.filter("base", _is(i))).cast("bigint") for i, k in enumerate(KINDS[:4])}
    return out.withColumns(n).select("doc_id", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                                     listed(F.col("found")).alias("spans"), "found")


def _is(order: int):
    return lambda s: s["order"] == order
