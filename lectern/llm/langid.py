"""Language identification with interpolated Kneser-Ney character models.

One model of order ``ORDER`` for each language, estimated by Spark aggregations over n-gram counts of
a bounded, documented sample of labelled rows. The models are stored as sorted hash arrays, one for
each order, with a column of log probabilities for each language. A text gets the language with the
lowest cross-entropy per character; held-back sample rows calibrate when to reject.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import lean, materialise, slices

ORDER = 4
#: Labelled rows that a language's model learns from at most: those with the smallest hashes.
SAMPLE_ROWS = 1_500
#: Of these, one in so many is kept back for calibration.
CALIBRATE = 5
#: Parts that a language's text hashes are ranked in before its smallest are chosen.
PARTS = 256
#: Size of the character set that the lowest order spreads unseen mass over.
CHARACTERS = 5_000
#: Share of rows in a learned language that rejection may lose; rows from which on a length bin has a tail of its own; and
#: the least distance, in nats a character, of a limit from its language's mean.
FALSE_REJECTION, TAIL_ROWS, MARGIN = 1e-4, 100, 1.25
#: Characters that are scored at once: the arrays of a piece take about 150 bytes a character and should stay in the processor's cache.
PIECE_CHARS = 1 << 15
PAD = "\n" * (ORDER - 1)
#: First text lengths of the bins that rejection is calibrated in.
LENGTH_BINS = (0, 64, 256, 1024)
#: Length that stands for the first bin where its limit is widened.
SHORTEST = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by order from 1: sorted hashes
    logs: list[np.ndarray]  # rows of the same, one column for each language
    contexts: list[np.ndarray]  # by order from 2: sorted hashes of contexts
    backoffs: list[np.ndarray]
    unseen: np.ndarray  # log probability of a character that no model has
    limits: np.ndarray | None = None  # cross-entropy limit by language and length bin


def _hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that end at each position from k - 1 on."""
    n, h = len(points) - k + 1, np.full(max(0, len(points) - k + 1), k, np.uint64)
    for j in range(k):
        h = (h ^ points[j : j + n]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def gram_logs(model: Model, by_order: list[np.ndarray], contexts: list[np.ndarray], k: int, rows: np.ndarray) -> np.ndarray:
    """Log probabilities (rows x languages) of n-grams of order ``k``; missing ones back off."""
    at, there = _find(model.grams[k - 1], by_order[k - 1][rows])
    out = model.logs[k - 1][at] if len(model.logs[k - 1]) else np.zeros((len(rows), len(model.languages)), np.float32)
    if not there.all():
        lost = np.flatnonzero(~there)
        if k == 1:
            out[lost] = model.unseen
        else:
            less = gram_logs(model, by_order, contexts, k - 1, rows[lost])
            c, known = _find(model.contexts[k - 2], contexts[k - 2][rows[lost]])
            out[lost] = less + (np.where(known[:, None], model.backoffs[k - 2][c], 0) if len(model.backoffs[k - 2]) else 0)
    return out


def _log_sums(model: Model, pieces: list[str]) -> np.ndarray:
    """Log probabilities (pieces x languages) of the characters behind each piece's first ORDER - 1."""
    points = _points("".join(pieces))
    lengths = np.array([len(t) - ORDER + 1 for t in pieces])
    ends = np.cumsum(lengths + ORDER - 1)
    if len(points) < ORDER:
        return np.zeros((len(pieces), len(model.languages)))
    n = len(points) - ORDER + 1  # position p ends at p + ORDER - 1
    by_order = [_hashes(points, k)[ORDER - k :] for k in range(1, ORDER + 1)]
    contexts = [_hashes(points, k - 1)[ORDER - k : ORDER - k + n] for k in range(2, ORDER + 1)]
    logs = gram_logs(model, by_order, contexts, ORDER, np.arange(n))
    # Running sums in double precision; a piece's own positions are those after its padding.
    sums = np.concatenate((np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0, dtype=np.float64)))
    last = ends - ORDER + 1
    return sums[last] - sums[last - lengths]


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character (texts x languages) and lengths; an empty text has 0.

    A text longer than ``PIECE_CHARS`` is scored in pieces, each behind the ORDER - 1 characters before it, so memory
    does not grow with its length.
    """
    lower = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lower])
    total = np.zeros((len(texts), len(model.languages)))
    held, of, size = [], [], 0
    for i, t in enumerate(lower):
        for start in range(0, max(1, len(t)), PIECE_CHARS):
            held.append((t[start - ORDER + 1 : start] if start else PAD) + t[start : start + PIECE_CHARS])
            of.append(i)
            size += len(held[-1])
            if size > 2 * PIECE_CHARS:
                np.add.at(total, of, _log_sums(model, held))
                held, of, size = [], [], 0
    if held:
        np.add.at(total, of, _log_sums(model, held))
    return -total / np.maximum(lengths, 1)[:, None], lengths


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, own in batch.groupby("lang"):
            found: Counter[str] = Counter()
            for text in own["text"]:
                t = PAD + text.lower()
                found.update(t[i : i + ORDER] for i in range(len(t) - ORDER + 1))
            yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})


def sample(docs: DataFrame, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows of each language with text: (lang, text, h), the smallest hashes of text."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text <> ''")
    labelled = labelled.withColumn("h", F.xxhash64("text"))
    hashes = labelled.select("lang", "h").distinct().withColumn("part", F.pmod(F.xxhash64("h"), F.lit(PARTS)))
    # The smallest of each part of a language first, so that no task ranks all of a language's hashes.
    near = hashes.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).filter(F.col("k") <= rows)
    cuts = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= rows)
    cut = {r["lang"]: r["h"] for r in cuts.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not cut:
        return labelled.filter("false")
    limit = F.element_at(F.create_map(*[x for k, v in cut.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]), F.col("lang"))
    return labelled.filter(F.col("h") <= limit).dropDuplicates(["lang", "h"])


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Model from labelled rows of ``docs``. What comes to the driver is bounded by the sample."""
    rows_of = materialise(sample(docs, text_col, lang_col, rows), "langid-sample")
    held = F.pmod(F.xxhash64("h"), F.lit(CALIBRATE)) == 0
    grams = rows_of.filter(~held).select("lang", "text").mapInPandas(_counted, "lang string, gram string, n bigint")
    top = materialise(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    model = _estimate(top)
    model.limits = np.full((len(model.languages), len(LENGTH_BINS)), np.inf)
    if model.languages:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        own = rows_of.filter(held).select("lang", "text").mapInPandas(_own_entropies(shared), "lang string, length bigint, entropy double")
        _calibrate(model, own.toPandas())
    return model


def _estimate(top: DataFrame) -> Model:
    """Kneser-Ney by aggregation: counts at the top order, distinct left neighbours below."""
    counts = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, k)
        counts[k] = counts[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n"))
    languages, tables, backs = [], {}, {}
    for k in range(1, ORDER + 1):
        of = counts[k].groupBy("lang").agg(F.sum((F.col("n") == 1).cast("double")).alias("one"), F.sum((F.col("n") == 2).cast("double")).alias("two"))
        discount = F.greatest(F.least(F.coalesce(F.try_divide(F.col("one"), F.col("one") + 2 * F.col("two")), F.lit(0.75)), F.lit(0.95)), F.lit(0.1))
        of = of.select("lang", discount.alias("d"))
        ctx = Window.partitionBy("lang", "ctx")
        rows = counts[k].withColumn("ctx", F.substring("gram", 1, k - 1)).join(F.broadcast(of), "lang").withColumns({
            "total": F.sum("n").over(ctx), "kinds": F.count("*").over(ctx),
        })
        frame = rows.select("lang", "gram", "ctx", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"),
                            (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma")).toPandas()
        tables[k] = frame
        languages = sorted(set(languages) | set(frame["lang"]))
        backs[k] = frame.drop_duplicates(["lang", "ctx"])
    grams, logs, contexts, backoffs = [], [], [], []
    size, column = len(languages), {x: i for i, x in enumerate(languages)}
    hashed = lambda texts, k: np.array([_hashes(_points(t), k)[0] for t in texts], np.uint64)
    unseen = np.zeros(size)
    for k in range(1, ORDER + 1):
        frame, back = tables[k], backs[k]
        if k == 1:
            for lang, gamma in zip(back["lang"], back["gamma"], strict=True):
                unseen[column[lang]] = np.log(max(gamma, 1e-9) / CHARACTERS)
        names = sorted(set(frame["gram"]))
        keys = hashed(names, k)
        order = np.argsort(keys)
        place = {names[i]: j for j, i in enumerate(order)}
        gamma_of = {(a, b): g for a, b, g in zip(back["lang"], back["ctx"], back["gamma"], strict=True)}
        table = np.empty((len(names), size))
        for lang in languages:  # what the language has not seen backs off, else the interpolated form
            c = column[lang]
            for name in names:
                less = np.exp(logs[k - 2][shorter_place[name[1:]], c]) if k > 1 else 1 / CHARACTERS
                table[place[name], c] = gamma_of.get((lang, name[:-1]), 1.0) * less
        for lang, name, own in zip(frame["lang"], frame["gram"], frame["own"], strict=True):
            table[place[name], column[lang]] += own
        grams.append(keys[order])
        logs.append(np.log(np.maximum(table, 1e-30)))
        shorter_place = place
        if k > 1:
            ctx = sorted(set(back["ctx"]))
            keys = hashed(ctx, k - 1)
            order = np.argsort(keys)
            at = {ctx[i]: j for j, i in enumerate(order)}
            weight = np.zeros((len(ctx), size), np.float32)
            for (lang, name), gamma in gamma_of.items():
                weight[at[name], column[lang]] = np.log(max(gamma, 1e-9))
            contexts.append(keys[order])
            backoffs.append(weight)
    return Model(languages, grams, [x.astype(np.float32) for x in logs], contexts, backoffs, unseen)


def _own_entropies(shared):
    """Batches of (lang, text) to each text's length and cross-entropy under its own language's model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column = {x: i for i, x in enumerate(shared.value.languages)}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang in column:
                    entropies, lengths = cross_entropies(shared.value, [text])
                    yield pd.DataFrame({"lang": [lang], "length": lengths, "entropy": entropies[:, column[lang]]})

    return run


def tail_limit(values: np.ndarray, rate: float) -> float:
    """What a share ``rate`` of such values exceeds: the 0.9 quantile plus an exponential tail of the mean excess over it."""
    start = np.quantile(values, 0.9)
    over = values[values > start] - start
    return float(start + (over.mean() * np.log(0.1 / rate) if len(over) else 0.0))


def _calibrate(model: Model, held: pd.DataFrame) -> None:
    """Limits by language and length bin from held-back rows, so that ``FALSE_REJECTION`` of such rows are rejected at most.

    A limit is the language's mean entropy and the tail limit of what rows of that length, of all
    languages, exceed their mean by. A bin with fewer than ``TAIL_ROWS`` rows takes the tail of the whole
    sample, widened for shorter texts by the root of how much shorter they are than the sample's
    median, as means over characters spread. A limit is never nearer than ``MARGIN`` to the mean. A language without held-back rows rejects nothing.
    """
    means = held.groupby("lang")["entropy"].mean()
    excess = (held["entropy"] - held["lang"].map(means)).to_numpy()
    bins = np.searchsorted(LENGTH_BINS, held["length"].to_numpy(), "right") - 1
    for b in range(len(LENGTH_BINS)):
        enough = (bins == b).sum() >= TAIL_ROWS
        wider = 1.0 if enough or not len(held) else max(1.0, np.sqrt(held["length"].median() / max(LENGTH_BINS[b], SHORTEST)))
        values = excess[bins == b] if enough else excess
        for i, lang in enumerate(model.languages):
            if lang in means:
                model.limits[i, b] = means[lang] + max(MARGIN, wider * tail_limit(values, FALSE_REJECTION))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language, confidence (0 to 1) and whether it is rejected, for whole texts.

    Null texts and texts without a letter are ``und``, confidence 0, rejected; so is all if there is
    no model. Ties go to the language that sorts first.
    """
    langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    usable = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)] if model.languages else []
    if usable:
        entropies, lengths = cross_entropies(model, [texts[i] for i in usable])
        best = np.argmin(entropies, axis=1)
        spread = np.exp(-(entropies - entropies.min(axis=1, keepdims=True)) * np.minimum(lengths, 64)[:, None])
        sure = 1 / spread.sum(axis=1)
        bins = np.searchsorted(LENGTH_BINS, lengths, "right") - 1
        over = entropies[np.arange(len(best)), best] > model.limits[best, bins]
        for i, b, s, o in zip(usable, best, sure, over, strict=True):
            langs[i], scores[i], rejected[i] = model.languages[b], float(s), bool(o)
    return langs, scores, rejected


def _parts(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    for part in slices(batch, text_col, 1 << 20):
        yield part, part.column(part.schema.get_field_index(text_col)).to_pylist()


def identify(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (none of them a result's name) with lang_pred, score and rejected.

    Rows come through one by one, repeated ones too; what ``predict`` says of null, empty and letterless texts and of
    ties holds. An empty table gives an empty result, other columns are not read.
    """
    if {"lang_pred", "score", "rejected"} & set(keep):
        raise ValueError("keep names an output column")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, text_col):
                found = predict(shared.value, texts)
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                arrays += [pa.array(v, t) for v, t in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score", "rejected"])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(lean(rows), f"{kept}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without rows that identification rejects; one scan, columns as they were.

    Null, empty and letterless texts go, as no language is recognised in them, and all rows if there is no model; repeated
    rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, text_col):
                yield part.filter(pa.array([not r for r in predict(shared.value, texts)[2]], pa.bool_()))

    return docs.mapInArrow(lean(rows), docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that a model must not learn from: crc32 of the id as text, modulo 4, is 2; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
