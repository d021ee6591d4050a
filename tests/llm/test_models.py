"""Language identification and toxicity: held-out accuracy on the driver's data, and odd cases."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from hirelake.llm import language, toxicity
from hirelake.llm._common import sample_by_id

from .helpers import corpus, crc, frame

DATA, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@needs_data
def test_language_held_out(spark):
    out = language.op2_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert out.agg(F.avg(F.col("rejected").cast("double"))).first()[0] < 0.02


def test_language_odd_cases(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = language.predict(df.select("doc_id", "text"), language.train_on(df)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    kept = language.keep_known(df)
    assert kept.columns == df.columns
    assert not any(r["text"] is None for r in kept.collect())


def test_language_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.keep_known(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language.predict(unlabelled, language.train_on(unlabelled)).collect()] == [("und", 0.0)]


def test_subwords_stay_in_words_and_do_not_depend_on_chunks(monkeypatch):
    text = "Ab, cdé 12 x. " * 30
    whole = sorted(language.subwords(text).tolist())
    # Words of 2, 4 and 1 bytes with marks: 2, 4, 1 unigrams, 3, 5, 2 bigrams, 2, 4, 1 trigrams, 1, 3 quadrigrams.
    assert len(whole) == 30 * (7 + 10 + 7 + 4) and language.subwords("12 .").size == 0
    assert sorted(language.subwords("ab").tolist() * 2) == sorted(language.subwords("ab ab").tolist())
    monkeypatch.setattr(language, "CHUNK", 10)
    assert sorted(language.subwords(text).tolist()) == whole


def test_languages_are_learned():
    rng = random.Random(1)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(2, 8)))
    texts, labels = [], []
    for _ in range(300):
        for name, letters in (("x", "abcde"), ("y", "cdefg"), ("z", "äöüß")):
            texts.append(" ".join(word(letters) for _ in range(20)))
            labels.append(name)
    model = language.train(texts, labels)
    score = lambda t: model.scores(language.subwords(t))
    assert model.languages == ["x", "y", "z"]
    assert [int(score(t).argmax()) for t in ("abab bad dab acab", "feg gefe efge", "äü öß")] == [0, 1, 2]


def test_toxic_sentences_are_found(spark):
    rng = random.Random(3)
    clean = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(1200):
        sentences = [" ".join(rng.choice(clean) for _ in range(6)) for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(["vile", "nasty", "awful"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic)))
    documents, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_on(documents, labelled)
    out = toxicity.score(documents, model).join(labelled, "doc_id").join(documents, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.97
    for r in out:
        for span in r["offending"]:
            if r["toxic"]:
                assert any(w in r["text"][span["start"] : span["end"]] for w in ("vile", "nasty", "awful"))


@needs_data
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    out = toxicity.op6_toxicity(spark, LARGER)
    assert out.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    found = out.join(labels, "doc_id").where("held_out").select("toxic", "score").collect()
    bad, good = [r["score"] for r in found if r["toxic"]], [r["score"] for r in found if not r["toxic"]]
    assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.8


def test_toxicity_odd_cases(spark):
    rows = corpus()
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, 0), (1, 0, 0)], "doc_id long, toxic int, score int")
    df = frame(spark, rows)
    out = toxicity.score(df, toxicity.train_on(df, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df.limit(0), toxicity.train_on(df, none)).collect() == []


# --- plain versions, word by word and row by row -------------------------------------------------------------------------


def plain_words(data):
    """Words of lower-cased bytes: ASCII letters and all bytes beyond ASCII."""
    return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in data).split()


def hashed(gram, add, times, bits):
    value = 0
    for byte in gram:
        value = (value * 0x01000193 + byte) % 2**32
    return ((value + add) * times % 2**32) >> (32 - bits)


def plain_language(model, text):
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    total, n = [0.0] * len(model.languages), 0
    for word in plain_words(text.lower().encode()):
        marked = b" " + word + b" "
        grams = [word[k : k + 1] for k in range(len(word))]
        grams += [marked[k : k + size] for size in (2, 3, 4) for k in range(len(marked) - size + 1)]
        for gram in grams:
            n += 1
            row = model.table[hashed(gram, len(gram), 0x9E3779B1, 15)]
            total = [t + float(x) for t, x in zip(total, row, strict=True)]
    z = [(t / n + float(b)) / model.temperature for t, b in zip(total, model.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(e)), key=e.__getitem__)
    return model.languages[best], e[best] / sum(e)


def test_languages_equal_a_plain_forward_pass(spark):
    rows = [r for r in corpus() if len(r[1] or "") < 20_000]
    df = frame(spark, rows)
    model = language.train_on(df)
    found = sorted(((r["doc_id"], r["lang_pred"], r["score"], r["text"]) for r in language.predict(df, model).collect()), key=str)
    expected = sorted(((r[0], *plain_language(model, r[1] or ""), r[1]) for r in rows), key=str)
    for a, b in zip(sorted(found, key=lambda r: str((r[0], r[3]))), sorted(expected, key=lambda r: str((r[0], r[3]))), strict=True):
        assert a[0] == b[0] and abs(a[2] - b[2]) < 1e-4 and (a[1] == b[1] or abs(b[2] - 0.5) < 1e-3)


def plain_toxicity(model, text):
    """1 - product over sentences of 1 - p."""
    none = 1.0
    for sentence in re.split(rb"[.!?\n]", text.lower().encode()):
        ids = []
        for word in plain_words(sentence):
            value = sum(b * pow(0x01000193, min(k + 1, 64), 2**32) for k, b in enumerate(word)) + len(word)
            ids.append((value % 2**32 * 0x9E3779B1 % 2**32) >> 14)
            marked = b" " + word + b" "
            ids += [hashed(marked[k : k + 5], 7, 0x85EBCA6B, 18) for k in range(len(marked) - 4)]
        if ids:
            none *= 1 - 1 / (1 + math.exp(-(sum(float(model.weights[i]) for i in ids) + model.bias)))
    return 1 - none


def test_toxicity_equals_a_plain_forward_pass(spark):
    rows = [r for r in corpus() if len(r[1] or "") < 20_000]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train_on(df, labels)
    found = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(df, model).collect())
    expected = sorted((str(r[0]), plain_toxicity(model, r[1] or "")) for r in rows)
    assert [a[0] for a in found] == [b[0] for b in expected]
    assert max(abs(a[1] - b[1]) for a, b in zip(found, expected, strict=True)) < 1e-5


def test_gradient_of_the_noisy_or():
    """Training follows the likelihood: more steps make it greater on what is trained on."""
    rng = random.Random(5)
    texts = [". ".join(" ".join(rng.choice("abcdefgh") * 4 for _ in range(4)) for _ in range(3)) + (" vilest" if k % 4 == 0 else "") for k in range(200)]
    labels = [int(k % 4 == 0) for k in range(200)]
    model = toxicity.train(texts, labels)
    loss = lambda m: -sum(math.log(max(1e-12, p if y else 1 - p)) for p, y in ((plain_toxicity(m, t), y) for t, y in zip(texts, labels, strict=True)))
    # Moving a weight that is used either way does not gain more than the penalty on weights explains.
    base = loss(model)
    untrained = toxicity.Model(model.weights * 0, -6.0)
    assert base < 0.05 * loss(untrained)


def test_pieces_of_long_texts(monkeypatch):
    text = "One sentence. Another one! " * 30 + "x" * 100 + " end"
    found = list(toxicity.pieces(text, 40))
    assert "".join(p for _, p in found) == text and all(len(p) <= 40 for _, p in found)
    assert all(text[at : at + len(p)] == p for at, p in found)
    assert all(p.rstrip()[-1] in ".!" for _, p in found[:15])


def test_long_texts_score_like_their_pieces(spark, monkeypatch):
    rows = corpus()
    df = frame(spark, [r for r in rows if r[1] and r[0] is not None and r[0] < 60])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train_on(df, labels)
    whole = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    monkeypatch.setattr(toxicity.pieces, "__defaults__", (60,))
    for r in df.collect():
        cut = 1.0
        for _, piece in toxicity.pieces(r["text"]):
            cut *= 1 - plain_toxicity(model, piece)
        assert cut <= 1 and (len(r["text"]) > 60 or abs(1 - cut - whole[r["doc_id"]]) < 1e-5)


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text number ', id) AS text", "'en' AS lang")
    held = {r["doc_id"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert held == {k for k in range(400) if crc(k) % 4 == 2}
    held = {r["doc_id"] for r in docs.where(language.held_out(F.col("doc_id"))).collect()}
    assert held == {k for k in range(400) if crc(k) % 5 == 0}


def test_rows_without_an_id_are_sampled_by_what_else_they_have(spark):
    known = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = known.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    chosen = [sorted(sample_by_id(df, 600, 2).select("text").toPandas()["text"]) for df in (rows, rows.repartition(5, "text"))]
    assert chosen[0] == chosen[1] and 450 < len(chosen[0]) < 750
    without = sum(int(t.removeprefix("text ")) % 3 == 0 for t in chosen[0])
    assert 120 < without < 280
    # Those that have one are chosen by it alone.
    wanted = {r["text"] for r in sample_by_id(known, 600, 2).collect()}
    assert {t for t in chosen[0] if int(t.removeprefix("text ")) % 3} == {t for t in wanted if int(t.removeprefix("text ")) % 3}
