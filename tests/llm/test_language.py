import math
import zlib
from collections import Counter

import numpy as np

from gridloom.llm import language as L
from pyspark.sql import functions as F


def predict(df, model):
    return df.select("doc_id", "text", L.held_out("doc_id").alias("held_out"),
                     L.predict_language("text", model).alias("said")).select("*", "said.*").collect()


def test_held_out_accuracy(docs):
    model = L.fit_language(docs)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = predict(docs, model)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out]
    assert tested and np.mean([lang[r.doc_id] == r.lang_pred for r in tested]) > 0.95
    assert (model.weights == 0).mean() > 0.5  # the lasso keeps it sparse


def test_held_out_rows_are_not_learned_from(docs):
    wrong = docs.withColumn("lang", F.when(L.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = L.fit_language(docs), L.fit_language(wrong)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_awkward_rows(awkward, docs):
    rows = predict(awkward, L.fit_language(docs))
    assert len(rows) == awkward.count()
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters)
    predict(awkward, L.fit_language(awkward))


def test_empty(empty):
    model = L.fit_language(empty)
    assert model.languages == [] and predict(empty, model) == []


def test_temperature():
    logits = np.array([[4.0, 0.0], [4.0, 0.0], [0.0, 4.0], [4.0, 0.0]])
    assert L.calibrate(logits, np.array([0, 0, 1, 1])) > 1


def bucket(gram):
    """The bucket of one n-gram, a character at a time."""
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return (code * 0x9E3779B97F4A7C15 % 2**64) >> (65 - L.BUCKETS.bit_length())


def slow_counts(text):
    kept = " "
    for c in text.lower() + " ":
        c = c if "a" <= c <= "z" or ord(c) > 127 else " "
        if c != " " or kept[-1] != " ":
            kept += c
    if kept == " ":
        return Counter()
    return Counter(bucket(kept[k : k + n]) for n in L.ORDERS for k in range(len(kept) - n + 1))


def slow_predict(text, model):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    weights = {b: (1 + math.log(n)) * model.idf[b] for b, n in slow_counts(text).items()}
    norm = math.sqrt(sum(v * v for v in weights.values()))
    z = [
        (sum(v / norm * model.weights[b, k] for b, v in weights.items()) + model.bias[k]) / model.temperature
        for k in range(len(model.languages))
    ]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(e)), key=lambda k: (e[k], -k))
    return model.languages[best], e[best] / sum(e)


def test_scores_equal_a_reference_scorer(awkward, docs):
    model = L.fit_language(docs)
    for rows in (predict(awkward, model), predict(docs.limit(60), model)):
        for r in rows:
            lang, score = slow_predict(r.text, model)
            assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_grams_are_of_characters():
    for text in ("日本語 テキスト", "naïve 𝒳 ΟΔΟΣ", "A-b  c", "é", ""):
        want = slow_counts(text)
        got = L.gram_counts(text)
        assert {int(b): int(got[b]) for b in np.flatnonzero(got)} == dict(want)


def test_chunks_do_not_change_a_long_text(monkeypatch):
    text = "Ein langer Text, 日本語 and more. " * 300
    whole = L.gram_counts(text)
    for chunk in (1, 7, 1000):
        monkeypatch.setattr(L, "CHUNK", chunk)
        assert np.array_equal(L.gram_counts(text), whole)


def test_a_text_of_some_megabytes(spark, docs):
    model = L.fit_language(docs)
    text = docs.where("lang is not null and text is not null").first().text
    long = (text + " ") * (4_000_000 // len(text))
    rows = predict(spark.createDataFrame([(1, long), (2, text)], "doc_id long, text string"), model)
    assert len({r.lang_pred for r in rows}) == 1
