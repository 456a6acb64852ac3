"""Character models against plain dictionaries of strings, and held-out accuracy."""

import zlib
from collections import Counter, defaultdict
from math import inf, isclose, log

import pytest
from pyspark.sql import functions as F

from aisleflow.llm import langid

N = langid.ORDER


def plain(words):
    """p(char | context) of an interpolated Kneser-Ney model of these words (with repeats), by strings."""
    padded = [" " * (N - 1) + w + " " for w in words]
    levels = {N: Counter(p[i - N + 1 : i + 1] for p in padded for i in range(N - 1, len(p)))}
    for k in range(N - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    alphabet = None

    def p(gram, size):
        k, context = len(gram), gram[:-1]
        below = p(gram[1:], size) if k > 1 else 1 / size
        c = levels[k]
        followers = {g: n for g, n in c.items() if g[:-1] == context}
        if not followers:
            return below
        counts = Counter(c.values())
        d = counts[1] / (counts[1] + 2 * counts[2]) if counts[1] and counts[2] else 0.5
        total = sum(followers.values())
        return (max(c[gram] - d, 0) if gram in c else 0) / total + d * len(followers) / total * below

    return p, {g for g in levels[1]}, alphabet


TEXTS = {"en": "the cat sat on the mat and the dog that ran", "de": "der Hund und die Katze, der ging; über straße", "x": "ñandú 日本語 дом दिन"}


def test_model_equals_plain_one(spark):
    docs = spark.createDataFrame([(lang, False, t) for lang, t in TEXTS.items() for _ in range(2)], "lang string, spare boolean, text string")
    model = langid.fit(langid.count(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    assert model.langs == sorted(TEXTS)
    plains = {lang: plain([w for token in t.split() for w in langid.words(token)] * 2) for lang, t in TEXTS.items()}
    size = len(set().union(*(p[1] for p in plains.values()))) + 1
    assert model.alphabet == size
    asked = ["the", "katze", "zebra", "дом", "q", "straßen"]
    lengths, sums = model.entropies(asked)
    assert lengths.tolist() == [len(w) + 1 for w in asked]
    for w, row in zip(asked, sums.tolist(), strict=True):
        text = " " * (N - 1) + w + " "
        for lang, got in zip(model.langs, row, strict=True):
            want = -sum(log(plains[lang][0](text[i - N + 1 : i + 1], size)) for i in range(N - 1, len(text)))
            assert isclose(got, want, rel_tol=1e-9), (w, lang)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("en", False, TEXTS["en"])], "lang string, spare boolean, text string")
    model = langid.fit(langid.count(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    p, letters, _ = plain([w for t in TEXTS["en"].split() for w in langid.words(t)])
    for context in ("    ", "  th", "zzzz"):
        assert sum(p(context + c, model.alphabet) for c in letters) + 1 / model.alphabet * _left(p, context, model.alphabet) == pytest.approx(1, abs=1e-9)


def _left(p, context, size):
    """The weight of the uniform share, by asking for a character nobody has seen."""
    return p(context + "☃", size) * size


def test_scorer_adds_tokens_and_forgets(spark, monkeypatch):
    docs = spark.createDataFrame([(lang, False, t) for lang, t in TEXTS.items()], "lang string, spare boolean, text string")
    model = langid.fit(langid.count(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    texts = [*TEXTS.values(), "", "42 !?", "The-cat's Über"]
    wide = langid.Scorer(model)
    lengths, sums = wide.totals(texts)
    for i, t in enumerate(texts):
        a, b = model.entropies([w for token in t.split() for w in langid.words(token)])
        assert lengths[i] == a.sum() and sums[i] == pytest.approx(b.sum(axis=0))
    monkeypatch.setattr(langid, "MEMO", 3)
    narrow = langid.Scorer(model)
    for i, t in enumerate(texts):
        assert narrow.totals([t])[1][0] == pytest.approx(sums[i])


def test_rare_grams_go_first(spark, monkeypatch):
    docs = spark.createDataFrame([("en", False, TEXTS["en"])], "lang string, spare boolean, text string")
    counts = langid.count(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    monkeypatch.setattr(langid, "GRAMS", 5 * 20)
    small = langid.fit(counts)
    assert 0 < len(small.grams[0][0]) <= 100
    _, sums = small.entropies(["the", "cat"])
    assert (sums > 0).all() and (sums < 100).all()


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def test_registered_query(spark):
    from aisleflow.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op12_char_models"](spark, path).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    asked = [r for r in got if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in asked) / len(asked)
    assert right >= 0.99
    assert abs(sum(r.score for r in asked) / len(asked) - right) < 0.05  # calibrated
    assert sum(r.rejected for r in got) < 0.05 * len(got)


def test_language_is_no_input(spark):
    """Other lang values of held-out documents, and other sources, change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    taught = spark.createDataFrame([(r.lang, r.text, False) for r in rows if not held_out(r.doc_id)], "lang string, text string, spare boolean")
    asked = [(r.doc_id, r.text, lang) for r in rows for lang in (r.lang, "zz", None)]
    got = langid.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), taught).groupBy("doc_id").agg(F.count_distinct("lang_pred", "score", "entropy").alias("n"))
    assert {r.n for r in got.collect()} == {1}


def test_other_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    taught = docs.where(part != 2).select("lang", "text", (part == 3).alias("spare"))
    asked = spark.createDataFrame([(1, "xqzj kwvp " * 60), (2, "Это совсем другой язык. " * 20)], "doc_id long, text string")
    assert [r.rejected for r in langid.identify(asked, taught).collect()] == [True, True]


def test_odd_rows(spark, odd):
    taught = odd.select("lang", "text", F.lit(None).cast("boolean").alias("spare"))
    clash = odd.withColumns({"score": F.lit("x"), "lang_pred": F.lit(3)})
    got = langid.identify(clash, taught)
    assert got.columns.count("score") == 1 and got.count() == odd.count()
    for r in got.collect():
        letters = any(langid.words(t) for t in (r.text or "").split())
        assert (r.lang_pred == "und") == (not letters) and (r.score == 0 and r.entropy is None and r.rejected or letters)
    nothing = langid.identify(odd, taught.where("false")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(odd.where("false"), taught).count() == 0


def test_calibration_is_monotone(spark):
    rows = [("en", (100, 0, 2.0 + i / 100, i / 50)) for i in range(50)] + [("de", (100, 0, 2.0, 0.001))] * 5 + [("en", (100, 0, 9.0, 0.5))]
    own = spark.createDataFrame(rows, "lang string, _s struct<chars:bigint,best:bigint,entropy:double,margin:double>")
    known = langid.calibrate(own, ["en"])
    assert known.sure == sorted(known.sure) and 0 <= known.sure[0] < 0.5 < known.sure[-1] <= 1
    assert known.most[7] == inf and known.most[6] == known.most[2] == pytest.approx(9.01)


def test_no_gram_is_dropped(spark, odd, monkeypatch):
    """More grams than a model holds: the rest is joined, and every text has the same figures."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    taught = docs.where(part != 2).select("lang", "text", (part == 3).alias("spare"))
    asked = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))  # nulls, copies, unknown characters

    def figures():
        got = langid.identify(asked.withColumn("_scores", F.lit(1)), taught)
        return sorted(((r.doc_id or 0, r.text or "", r.lang_pred, r.rejected, r.score, r.entropy or 0) for r in got.collect()), key=lambda r: r[:4])

    whole = figures()
    for most in (20_000, 5):  # some grams in memory; none
        monkeypatch.setattr(langid, "GRAMS", most)
        got = figures()
        assert [r[:5] for r in got] == [r[:5] for r in whole]
        assert [r[5] for r in got] == pytest.approx([r[5] for r in whole], abs=1e-7)
