"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Each window of a text (about
``WINDOW`` bytes, cut between words) is compressed with either; where the toxic dictionary makes it shorter, every word
of the window is compressed alone inside fixed carriers, so that what remains is the word's own distance. The largest
distances of a text are turned into a probability by a calibration on labelled texts that neither dictionary has seen.

Most words of toxic text are ordinary, so the toxic dictionary is trained in rounds on two halves of the toxic sample.
A dictionary of one half's windows (at first of all, then of those texts that nothing explains yet) scores the other
half's windows and held-back ordinary ones; the words that carry a saving much more often in toxic texts than in
ordinary ones are the next round's dictionary.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import binary_column, materialise, slices

#: Bytes from which on a window ends at the next word's end; a run without white space is cut at LONG_RUN bytes.
WINDOW, LONG_RUN = 48, 256
#: Labelled rows that are learned from at most (those with the smallest text hashes), and bytes of windows of each.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 1_200, 2_000, 16_384
#: Bytes of the ordinary dictionary, of the toxic one's own part, and of a round's trial dictionary.
ORDINARY_BYTES, TOXIC_BYTES, TRIAL_BYTES = 1 << 17, 8_192, 16_384
ROUNDS = 4
#: Bytes that a window must save before its words are looked at; log-likelihood ratio that makes a word a toxic one.
SCREEN, EXCESS = 2, 12
#: Own distances from which on a word may become one of the dictionary's, and a text counts as explained in training.
WORD_SAVES, EXPLAINED = 3, 6
#: Bytes of what follows that are compressed with a window: the coder starts no match in the last eight bytes.
AHEAD = 12
PIECE_BYTES = 4 << 20
MEMO = 200_000
#: A-Z to lower case, white space to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_PARAMETERS = {
    "write_content_size": False, "write_checksum": False, "write_dict_id": False, "format": zstd.FORMAT_ZSTD1_MAGICLESS,
    "window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 5, "min_match": 3, "strategy": zstd.STRATEGY_BTOPT,
}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def cuts(flat: bytes) -> np.ndarray:
    """Ascending offsets of the windows of a folded text, from 0 to its length."""
    n = len(flat)
    spaces = np.append(np.flatnonzero(np.frombuffer(flat, np.uint8) == 32), n)
    ends = spaces[np.minimum(np.searchsorted(spaces, np.arange(WINDOW, n + WINDOW, WINDOW)), len(spaces) - 1)]
    at = np.unique(np.concatenate(([0], ends, [n])))
    wide = np.flatnonzero(np.diff(at) > LONG_RUN)
    return np.unique(np.concatenate([at, *(np.arange(at[i], at[i + 1], LONG_RUN) for i in wide)])) if len(wide) else at


def pieces(text: bytes | None) -> Iterator[bytes]:
    """A text folded, in parts of about ``PIECE_BYTES`` that end between words."""
    text, start = text or b"", 0
    while start < len(text):
        part = text[start : start + PIECE_BYTES].translate(FOLD)
        end = part.rfind(b" ") if start + PIECE_BYTES < len(text) else -1
        part = part[:end] if end > 0 else part
        yield part
        start += len(part)


class Distance:
    """Compression lengths with the ordinary dictionary less those with the toxic one.

    The toxic dictionary has the ordinary one in front, so that only what toxic text adds makes a difference.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.toxic, self.ordinary = self._compressor(ordinary + toxic), self._compressor(ordinary)
        middle = ordinary[len(ordinary) // 2 :]
        self.carriers = [(middle[i : i + 24] + b" ", b" " + middle[i + 100 : i + 124]) for i in (0, 200)]
        self.memo: dict[bytes, int] = {}
        self.idle = self._in_carriers(b"")

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        parameters = zstd.ZstdCompressionParameters(**_PARAMETERS)
        trained = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(compression_params=parameters)
        return zstd.ZstdCompressor(dict_data=trained, compression_params=parameters)

    def windows(self, flat: bytes, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.empty(0, np.int64)
        spans = np.stack([at[:-1], np.diff(at) + AHEAD], 1).astype(np.uint64)
        cut = zstd.BufferWithSegments(flat + b" " * AHEAD, spans.tobytes())
        sizes = [np.fromiter(map(len, c.multi_compress_to_buffer(cut, threads=1)), np.int64, len(at) - 1) for c in (self.ordinary, self.toxic)]
        return sizes[0] - sizes[1]

    def _in_carriers(self, word: bytes) -> int:
        return sum(len(self.ordinary.compress(a + word + b)) - len(self.toxic.compress(a + word + b)) for a, b in self.carriers)

    def own(self, word: bytes) -> int:
        """What the word saves by itself, over both carriers."""
        if word not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = self._in_carriers(word) - self.idle
        return self.memo[word]

    def screened(self, flat: bytes) -> tuple[int, int, list[list[bytes]]]:
        """Of a folded piece: windows, largest saving of one, and the words of each window that passes the screen."""
        at = cuts(flat)
        saved = self.windows(flat, at)
        return len(saved), int(saved.max(initial=0)), [flat[at[i] : at[i + 1]].split() for i in np.flatnonzero(saved >= SCREEN)]

    def features(self, text: bytes | None) -> list[float]:
        """Largest and second largest own distance, largest saving of a window, logarithm of the number of windows."""
        n, most, own = 0, 0, [0, 0]
        for flat in pieces(text):
            windows, saved, found = self.screened(flat)
            n, most = n + windows, max(most, saved)
            own = sorted([*own, *(self.own(w) for words in found for w in words)])[-2:]
        return [min(own[1], 20), min(own[0], 20), min(most, 20), float(np.log1p(n))]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary's content; the samples' own end where there are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except (zstd.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[-size:]


def _windows_of(texts: list[bytes]) -> list[bytes]:
    return [t[a:b] for t in texts for c in [cuts(t)] for a, b in zip(c[:-1], c[1:], strict=True)]


def _words_of(texts: list[bytes], distance: Distance) -> tuple[Counter, list[int]]:
    """Of each word that saves by itself the different words that it follows; each text's largest own distance.

    Copies of a passage count once that way, however many texts have it.
    """
    pairs, best = set(), []
    for t in texts:
        most = 0
        for words in distance.screened(t)[2]:
            for before, word in zip([b"", *words], words, strict=False):
                d = distance.own(word)
                most = max(most, d)
                if d >= WORD_SAVES:
                    pairs.add((before, word))
        best.append(most)
    return Counter(w for _, w in pairs), best


def _excess(n: int, m: int, share: float) -> float:
    """Log-likelihood ratio of ``n`` against ``m`` where ``share`` times as much text was read; 0 if ``n`` is not the larger."""
    p = 1 / (1 + share)
    if n <= (n + m) * p:
        return 0.0
    return 2 * (n * np.log(n / ((n + m) * p)) + (m * np.log(m / ((n + m) * (1 - p))) if m else 0))


def _dictionary(words: Counter) -> bytes:
    """The words with the most frequent last, where offsets are shortest."""
    out = b" "
    for word, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        if len(out) + len(word) < TOXIC_BYTES:
            out = b" " + word + out
    return out


def toxic_dictionary(toxic: list[bytes], ordinary_dictionary: bytes, held_back: list[bytes], rounds: int = ROUNDS) -> bytes:
    """The toxic dictionary's own part, from folded toxic texts and ordinary ones that the ordinary dictionary has not seen."""
    halves = (toxic[::2], toxic[1::2])
    known, open_texts = (Counter(), Counter()), list(halves)
    for _ in range(rounds):
        found = []
        for h in (0, 1):
            trial = _trained(_windows_of(open_texts[1 - h]), TRIAL_BYTES) if open_texts[1 - h] else b""
            distance = Distance(ordinary_dictionary, trial + _dictionary(known[1 - h]))
            ours, theirs = _words_of(halves[h], distance)[0], _words_of(held_back, distance)[0]
            share = max(1, len(held_back)) / max(1, len(halves[h]))
            found.append({w: n for w, n in ours.items() if _excess(n, theirs[w], share) >= EXCESS})
        for h in (0, 1):
            for w, n in found[h].items():
                known[h][w] = max(known[h][w], n)
        # What either half knows explains texts of both; the next trial looks at the rest.
        distance = Distance(ordinary_dictionary, _dictionary(known[0] + known[1]))
        open_texts = [[t for t, d in zip(texts, _words_of(texts, distance)[1], strict=True) if d < EXPLAINED] for texts in halves]
    return _dictionary(known[0] + known[1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients, intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    held = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (weight * (y - p)) - held * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    coefficients: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, 0.0, -10.0]))

    def distance(self) -> Distance:
        return Distance(self.ordinary or b" ", self.toxic)

    def probability(self, features: list[list[float]]) -> np.ndarray:
        x = np.column_stack([np.array(features, np.float64).reshape(-1, 4), np.ones(len(features))])
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """A model from folded sample texts; ``share`` is that of toxic rows among the labelled ones.

    One in three texts of either kind calibrates; of the other ordinary ones half train the dictionary and half are
    held back to judge toxic words by.
    """
    if not toxic or not ordinary:
        return Model(coefficients=np.array([0.0, 0.0, 0.0, 0.0, 10.0 if toxic else -10.0]))
    learn, calibrate = ([t for i, t in enumerate(toxic) if i % 3 != 2], [t for i, t in enumerate(ordinary) if i % 3 != 2]), (toxic[2::3], ordinary[2::3])
    model = Model(ordinary=_trained(_windows_of(learn[1][::2]), ORDINARY_BYTES))
    model.toxic = toxic_dictionary(learn[0], model.ordinary, learn[1][1::2])
    calibrate = calibrate if all(calibrate) else learn
    distance = model.distance()
    x = np.array([distance.features(t) for kind in calibrate for t in kind])
    y = np.repeat([1.0, 0.0], [len(calibrate[0]), len(calibrate[1])])
    weight = np.where(y == 1, share / len(calibrate[0]), (1 - share) / len(calibrate[1])) * len(y)
    model.coefficients = _logistic(x, y, weight)
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, h, text) to the same with folded windows of at most ``SAMPLE_BYTES``: of long texts those with the smallest hashes."""
    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for text in binary_column(part, "text"):
                windows = _windows_of(list(pieces(text)))
                if sum(map(len, windows)) > SAMPLE_BYTES:
                    order, size, keep = sorted(range(len(windows)), key=lambda i: (zlib.crc32(windows[i]), i)), 0, []
                    for i in order:
                        size += len(windows[i])
                        if size > SAMPLE_BYTES:
                            break
                        keep.append(i)
                    windows = [windows[i] for i in sorted(keep)]
                out.append(b"".join(windows))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["label", "h", "text"])


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "label",
    toxic_rows: int = SAMPLE_TOXIC, ordinary_rows: int = SAMPLE_ORDINARY,
) -> Model:
    """Dictionaries and calibration from ``docs`` with a label of 0 or 1.

    Of distinct texts of either label those with the smallest hashes are learned from, at most ``toxic_rows`` and
    ``ordinary_rows``, of each at most ``SAMPLE_BYTES`` of windows; that bounded sample is all that comes to the driver.
    Null texts, labels and ids and labels other than 0 and 1 are not used; a repeated id counts with each label. Without
    any text of one kind every score is that of the other.
    """
    marked = labels.select(F.col(label_id).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").distinct()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Ids and hashes meet the labels; texts only meet the few hashes that were chosen.
    hashes = materialise(rows.select("doc_id", "h").join(marked, "doc_id").select("label", "h").distinct(), "toxic-hashes")
    counts = {r["label"]: r["count"] for r in hashes.groupBy("label").count().collect()}
    chosen = None
    for label, limit in ((1, toxic_rows), (0, ordinary_rows)):
        least = hashes.filter(F.col("label") == label).orderBy("h").limit(limit)
        chosen = least if chosen is None else chosen.unionByName(least)
    sample = rows.join(F.broadcast(chosen), "h").select("label", "h", "text")
    sample = sample.mapInArrow(_sampled, "label int, h bigint, text binary").groupBy("label", "h").agg(F.min("text").alias("text"))
    texts: dict[int, list[tuple]] = {0: [], 1: []}
    for r in sample.collect():  # at most the two sample sizes
        texts[r["label"]].append((r["h"], bytes(r["text"])))
    kinds = [[t for _, t in sorted(texts[label]) if t] for label in (1, 0)]
    return fit(*kinds, share=counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``) with score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts are read, very long ones in pieces. A null or empty text has no window and gets the score of a text
    without any distance. Every row gives one row, repeated ones too. ``keep`` must not name score or predicted.
    """
    keep = ["doc_id"] if keep is None else keep
    if {"score", "predicted"} & set(keep):
        raise ValueError("keep names an output column")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = model.distance()
        for batch in batches:
            for part in slices(batch, text_col):
                p = model.probability([distance.features(t) for t in binary_column(part, text_col)])
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(rows, f"{kept}, score double, predicted int")
