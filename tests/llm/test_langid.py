"""Kneser-Ney models: probabilities sum to one, held-out accuracy, rejection, odd rows."""

import numpy as np

from pyspark.sql import functions as F

from lectern.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def test_probabilities_and_accuracy(spark):
    docs = spark.read.parquet(SF)
    held = langid.held_out(docs["doc_id"])
    model = langid.train(docs.filter(~held))
    assert model.languages == ["de", "en", "es", "fr"]
    # Over all characters after a context, seen or not, each language's probabilities sum to 1.
    seen = sorted({c for r in docs.select("text").collect() for c in r.text.lower()} | {"\n"})
    for context in ("the", "xq#", "\n\n\n", " de"):
        total = np.zeros(4)
        for c in seen:
            points = langid._points(context + c)
            by_order = [langid._hashes(points, k)[4 - k :] for k in range(1, 5)]
            contexts = [langid._hashes(points, k - 1)[4 - k : 5 - k] for k in range(2, 5)]
            total += np.exp(langid.gram_logs(model, by_order, contexts, 4, np.arange(1))[0])
        assert (total < 1.0001).all() and (total > 0.9).all(), (context, total)
    got = langid.identify(docs, model, keep=["doc_id", "lang"]).filter(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert sum(r.rejected for r in got) <= 0.005 * len(got)
    odd = spark.createDataFrame(
        [(None, None, 1), (1, "", 2), (1, "123 !?", 3), (2, "ЖЪѢ" * 200, 4), (3, "the and of", 5), (3, "the and of", 5)],
        "doc_id bigint, text string, score int",
    )
    found = langid.identify(odd, model, keep=["doc_id"]).collect()
    assert [r.lang_pred for r in found[:3]] == ["und"] * 3 and found[3].rejected
    assert found[4] == found[5] and found[4].lang_pred == "en" and not found[4].rejected
    assert langid.drop_rejected(odd, model).count() == 2
    assert all(0 <= r.score <= 1 for r in found)


def plain_probability(texts, text, at):
    """Interpolated Kneser-Ney of one language by its definition: character ``at`` of the padded text, from plain counts."""
    counts = {langid.ORDER: {}}
    for t in texts:
        t = langid.PAD + t.lower()
        for i in range(len(t) - langid.ORDER + 1):
            gram = t[i : i + langid.ORDER]
            counts[langid.ORDER][gram] = counts[langid.ORDER].get(gram, 0) + 1
    for k in range(langid.ORDER - 1, 0, -1):
        counts[k] = {}
        for gram in counts[k + 1]:  # distinct characters to the left
            counts[k][gram[1:]] = counts[k].get(gram[1:], 0) + 1

    def p(k):
        if k == 0:
            return 1 / langid.CHARACTERS
        once, twice = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        d = min(max(once / (once + 2 * twice) if once + twice else 0.75, 0.1), 0.95)
        gram = text[at - k + 1 : at + 1]
        same = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        if not same:
            return p(k - 1)
        return max(counts[k].get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(k - 1)

    return p(langid.ORDER)


def test_probabilities_equal_the_definition(spark):
    texts = {"a": ["the cat sat on the mat", "a cat and a hat", "that hat sat"], "b": ["der hund und die katze", "die katze sass da", "ein hut"]}
    rows = spark.createDataFrame([(k, t) for k, own in texts.items() for t in own], "lang string, text string")
    model = langid._estimate(rows.mapInPandas(langid._counted, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    assert model.languages == ["a", "b"]
    for text in ("the katze sat", "xyz und", "a"):
        entropies, lengths = langid.cross_entropies(model, [text])
        padded = langid.PAD + text
        for i, lang in enumerate(model.languages):
            want = -np.mean([np.log(plain_probability(texts[lang], padded, p)) for p in range(len(langid.PAD), len(padded))])
            assert lengths[0] == len(text) and abs(entropies[0, i] - want) < 1e-5, (text, lang)


def test_tail_limit_keeps_its_rate():
    values = np.random.default_rng(4).exponential(0.1, 400_000)
    for rate in (1e-2, 1e-3):
        assert 0.7 * rate < (values > langid.tail_limit(values[:2_000], rate)).mean() < 1.5 * rate


def test_other_languages_are_rejected(spark):
    model = langid.train(spark.read.parquet(SF))
    other = ["Kissa nukkuu sohvalla ja ulkona sataa vettä koko pitkän päivän ajan eikä kukaan liiku kadulla. " * 4,
             "Katten sover i soffan medan regnet faller över staden och ingen rör sig på gatan. " * 5]
    assert langid.predict(model, other)[2] == [True, True] and np.isfinite(model.limits).all()


def test_sample_is_bounded_and_whole(spark):
    docs = spark.range(3_000).selectExpr("cast(id % 2 as string) as lang", "concat('text ', id % 1000) as text")
    got = langid.sample(docs, "text", "lang", 40).groupBy("lang").count().collect()
    assert sorted((r["lang"], r["count"]) for r in got) == [("0", 40), ("1", 40)]
    assert langid.sample(docs, "text", "lang", 5_000).count() == 1_000


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    model = langid.train(empty)
    some = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in langid.identify(some, model, keep=["doc_id"]).collect()] == ["und"]
    assert langid.identify(empty, model, keep=["doc_id"]).count() == 0


def test_pieces_add_up_to_the_whole_text(spark, monkeypatch):
    docs = spark.createDataFrame([("the cat sat on the mat " * 20, "en"), ("der hund lief in den wald " * 20, "de")] * 3, "text string, lang string")
    model = langid.train(docs)
    texts = ["the dog ran in the wald " * 40, "", "x", "Der é " * 7]
    whole, lengths = langid.cross_entropies(model, texts)
    for size in (langid.ORDER, 7, 100):
        monkeypatch.setattr(langid, "PIECE_CHARS", size)
        parts, same = langid.cross_entropies(model, texts)
        assert abs(parts - whole).max() < 1e-9 and (same == lengths).all()


def test_scoring_takes_the_memory_of_one_piece():
    import tracemalloc

    points = langid._points("abcdefgh " * 50)
    grams = [np.unique(langid._hashes(points, k)) for k in range(1, langid.ORDER + 1)]
    backs = [np.unique(langid._hashes(points, k)) for k in range(1, langid.ORDER)]
    zeros = lambda tables: [np.zeros((len(t), 2), np.float32) for t in tables]
    model = langid.Model(["a", "b"], grams, zeros(grams), backs, zeros(backs), np.full(2, -9.0))
    texts = ["abcdefgh xy " * 40_000] * 2 + ["abc "] * 100_000
    tracemalloc.start()
    try:
        langid.cross_entropies(model, texts)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
