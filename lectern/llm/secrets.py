"""Secret scans in native expressions: fixed patterns and a battery of randomness tests.

Three fixed kinds (assign, access, hex) are always reported. Besides, every run of at least 20
encoding characters gets an inferred encoding (hex, base32, base64) and three tests over its symbol
values: chi-squared uniformity over eighths of the alphabet, Wald-Wolfowitz runs about the middle,
and lag-1 serial correlation. The sum of their squared z-scores is small for random tokens. What
ordinary words give is learned from the corpus for each length stratum (all letter-only runs), a
candidate's p-value is the chance of so small a sum among words, and Benjamini-Hochberg within the
stratum bounds the false-discovery rate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise
from lectern.llm.spans import apart, by_start, listed, with_spans

# The three base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets in symbol order; url-safe characters stand for their base64 values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: First lengths of the strata.
STRATA = (20, 28, 40, 64)
#: Mean and deviation of the log statistic of words, and how many words this start weighs.
PRIOR = (math.log(60.0), 0.7, 20)


def _locate(alphabet: Column, symbol: Column) -> Column:
    return F.call_function("locate", symbol, alphabet)


def with_battery(tokens: Column) -> Column:
    """Token spans with encoding, test z-scores and their squared sum; native throughout."""

    # A lambda's expressions are evaluated anew for each element, so each quantity that an inner
    # lambda uses is a field made by the step before: all steps are linear in the token's length.
    def carried(s: Column, *names: str) -> list[Column]:
        return [s[c].alias(c) for c in ("start", "end", "encoding", "word", *names)]

    def inferred(s: Column) -> Column:
        plain = F.regexp_replace(F.translate(s["match"], "-_", "+/"), "=+$", "")
        kind = (
            F.when(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(plain.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
        )
        word = s["match"].rlike("^([A-Z]?[a-z]+|[A-Z]+)$")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("encoding"), word.alias("word"), plain.alias("plain"))

    def spelled(s: Column) -> Column:
        kind = s["encoding"]
        alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        text = F.when(kind == "hex", F.lower(s["plain"])).otherwise(s["plain"])
        symbols = F.regexp_extract_all(text, F.lit("."), F.lit(0))
        return F.struct(*carried(s), alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("size"), symbols.alias("symbols"))

    def valued(s: Column) -> Column:
        # Shares of the alphabet below each symbol, from 0 up to 1.
        shares = F.transform(s["symbols"], lambda c: (_locate(s["alphabet"], c) - 1).cast("double") / s["size"])
        return F.struct(*carried(s), shares.alias("v"))

    def centred(s: Column) -> Column:
        n = F.size(s["v"]).cast("double")
        mean = F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + x) / n
        return F.struct(*carried(s, "v"), n.alias("n"), mean.alias("mean"))

    def counted(s: Column) -> Column:
        v, n, mean = s["v"], s["n"], s["mean"]
        cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.size(F.filter(v, lambda x: F.floor(x * 8) == c)).cast("double"))
        chi = F.aggregate(cells, F.lit(0.0), lambda a, c: a + (c - n / 8) * (c - n / 8) / (n / 8))
        high = F.size(F.filter(v, lambda x: x >= 0.5)).cast("double")
        steps = F.sequence(F.lit(2), F.size(v))
        runs = 1 + F.aggregate(
            steps, F.lit(0.0), lambda a, i: a + ((F.element_at(v, i) >= 0.5) != (F.element_at(v, i - 1) >= 0.5)).cast("double")
        )
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lagged = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.element_at(v, i) - mean) * (F.element_at(v, i - 1) - mean))
        return F.struct(*carried(s, "n"), chi.alias("chi"), high.alias("high"), runs.alias("runs"),
                        F.try_divide(lagged, square).alias("serial"))

    def scored(s: Column) -> Column:
        n, high = s["n"], s["high"]
        df = 7.0
        z_chi = F.greatest((F.pow(s["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)), F.lit(0.0))
        expected = 2 * high * (n - high) / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.0)))
        # All symbols in one half, or all equal: as far from random as the length allows.
        z_runs = F.coalesce(F.try_divide(s["runs"] - expected, spread), F.sqrt(n))
        z_serial = F.coalesce((s["serial"] + 1 / n) * F.sqrt(n), F.sqrt(n))
        total = z_chi * z_chi + z_runs * z_runs + z_serial * z_serial
        stratum = sum((n >= F.lit(float(x))).cast("int") for x in STRATA[1:])
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "encoding", "word")], stratum.alias("stratum"),
                        z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"),
                        F.log(F.greatest(total, F.lit(0.01))).alias("stat"))

    long_enough = lambda s: F.length(F.regexp_replace(s["match"], "=+$", "")) >= STRATA[0]
    out = F.filter(tokens, long_enough)
    for step in (inferred, spelled, valued, centred, counted, scored):
        out = F.transform(out, step)
    return out


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``assign``, ``access``, ``hex`` and ``tokens`` span arrays."""
    c = F.col(text)
    docs = with_spans(docs, "assign", text, ASSIGN, F.contains(c, F.lit(":")) | F.contains(c, F.lit("=")))
    docs = with_spans(docs, "access", text, ACCESS, F.contains(c, F.lit("AKIA")))
    docs = with_spans(docs, "hex", text, HEX)
    docs = with_spans(docs, "tokens", text, TOKEN)
    return docs.withColumns({
        "assign": F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6),
        "access": F.filter("access", lambda s: F.length(s["match"]) >= 20),
    })


def false_discovery(scanned: DataFrame, rate: float) -> tuple[list[tuple[float, float]], list[float]]:
    """Per stratum: (mean, deviation) of words' log statistic, and the largest p-value to report.

    What comes to the driver is two moments and a histogram of 0.01-wide bins of -log10 p for each
    of the four strata: bounded, whatever the corpus.
    """
    tokens = scanned.select(F.explode("tokens").alias("t")).select("t.*")
    sums = {r["stratum"]: r for r in tokens.filter("word").groupBy("stratum").agg(
        F.count("*").alias("n"), F.sum("stat").alias("s"), F.sum(F.col("stat") * F.col("stat")).alias("q")).collect()}
    model = []
    for k in range(len(STRATA)):
        mean, dev, weight = PRIOR
        n, s, q = (sums[k]["n"], sums[k]["s"], sums[k]["q"]) if k in sums else (0, 0.0, 0.0)
        total = n + weight
        m = (s + weight * mean) / total
        v = (q + weight * (dev * dev + mean * mean)) / total - m * m
        model.append((m, math.sqrt(max(v, 1e-4))))
    binned = tokens.filter("not word").select("stratum", F.floor(-100 * F.log10(p_value(F.struct("stratum", "stat"), model))).alias("b"))
    counts = binned.groupBy("stratum", "b").count().collect()
    cuts = []
    for k in range(len(STRATA)):
        own = sorted(((r["b"], r["count"]) for r in counts if r["stratum"] == k), reverse=True)
        m, seen, cut = sum(n for _, n in own), 0, -1.0
        for b, n in own:  # smallest p-values first; a bin counts with its largest p-value
            seen += n
            if 10 ** (-b / 100) <= rate * seen / m:
                cut = 10 ** (-b / 100)
        cuts.append(cut)
    return model, cuts


def p_value(s: Column, model: list[tuple[float, float]]) -> Column:
    """Chance that a word of the stratum has so small a statistic (normal in the log, logistic form)."""
    pick = lambda i: F.element_at(F.array(*[F.lit(float(m[i])) for m in model]), s["stratum"] + 1)
    z = (s["stat"] - pick(0)) / pick(1)
    return F.greatest(1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z))), F.lit(1e-16))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, random (scored spans).

    A null text counts as empty and has no span. Rows come through one by one, so null or repeated
    ids need no care, and columns of other names are not looked at. The scan's result, spans only,
    is written once; the statistics and the final selection read that table and never the text.
    Tokens that overlap a base span are not added again. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = base_spans(rows, "_text").drop("_text").withColumn("tokens", with_battery(F.col("tokens")))
    base = F.array_sort(F.concat(*[by_start(F.col(c), k, c) for k, c in enumerate(("assign", "access", "hex"))]))
    scanned = found.select("doc_id", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("assign", "access", "hex")],
                           base.alias("base"), "tokens")
    scanned = materialise(scanned, "secrets")
    model, cuts = false_discovery(scanned, rate)
    cut = lambda s: F.element_at(F.array(*[F.lit(c) for c in cuts]), s["stratum"] + 1)
    out = apart(scanned, "random", F.filter("tokens", lambda s: ~s["word"] & (p_value(s, model) <= cut(s))), F.col("base"))
    added = by_start(F.col("random"), 3, "random")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                      listed(F.array_sort(F.concat("base", added))).alias("spans"), "random")
