import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.llm import quality as Q


def brute(text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= set(range(k, k + 5))
    lines = (text or "").split("\n")
    dup = sum(1 for k, l in enumerate(lines) if brute_words(l) and l in lines[:k])
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


def brute_words(line):
    return [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", line)]


def test_counts(awkward, docs):
    for df in (awkward, docs.where("n_chars < 4000")):
        rows = df.select("text", Q.text_counts("text").alias("c")).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert tuple(r.c)[:5] == brute(r.text), r.text


def test_many_distinct_words():
    words = [str(k).encode() for k in range(9000)]
    assert Q.repeated_words(words + words[10:16]) == 12
    assert Q.repeated_words(words) == 0


def test_rules_catch_bad_and_keep_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = Q.learn_rules(docs, labels)
    assert rules
    judged = Q.quality_rules(docs, rules).join(labels, "doc_id").where("not base_failed").toPandas()
    bad = judged[judged.quality == 0]
    good = judged[judged.quality == 1]
    assert (~bad.kept).mean() > 0.8 and good.kept.mean() > 0.97


def test_expression_equals_the_list(docs):
    x = pd.DataFrame({f: np.linspace(0, 1, 60) for f in Q.FEATURES})
    rules = Q.fit_rules(x, x["n_words"].to_numpy() > 0.7)
    assert rules
    df = docs.sparkSession.createDataFrame(x)
    said = df.select(Q.decision(rules, {f: F.col(f) for f in Q.FEATURES}).alias("k")).toPandas()["k"]
    hit = np.zeros(60, dtype=bool)
    for r in rules:
        hit |= Q._covered(r, x)
    assert (said.to_numpy() == ~hit).all()


def test_awkward_and_empty(awkward, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.learn_rules(awkward, none) == []
    rows = Q.quality_rules(awkward, []).collect()
    assert len(rows) == awkward.count() and all(not r.kept for r in rows if r.n_words < 10)
    assert Q.quality_rules(empty, []).count() == 0
    some = spark.createDataFrame([(1, 1), (None, 0), (5, None), (5, 0)], "doc_id long, quality int")
    Q.learn_rules(awkward, some)
