import re

import pytest

import corpus_pipeline as P
from gridloom.llm import decontamination as D, language
from tests.llm.test_neardup import brute as classes
from tests.llm.test_secrets import brute as spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, docs):
    out = [docs.cache()]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, docs, steps):
    start, lang, near, clean, masked, packed = steps
    texts = {r.doc_id: r.text for r in start.collect()}
    # language: all texts with a letter stay
    assert ids(lang) == sorted(i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t))
    # near duplicates: the least id of each brute-force class stays
    assert ids(near) == sorted(set(classes([(i, texts[i]) for i in ids(lang)]).values()))
    # benchmark: exactly the documents with an aligned item go
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    wholes = [" " + " ".join(w.decode() for w in D.words_of(r.text)) + " " for r in items]
    line = {i: " " + " ".join(w.decode() for w in D.words_of(texts[i])) + " " for i in ids(near)}
    assert ids(clean) == [i for i in ids(near) if not any(w in line[i] for w in wholes)]
    # secrets: rows stay, base spans are gone
    assert ids(masked) == ids(clean)
    for r in masked.collect():
        assert r.n_chars == len(r.text)
        # a mask behind "token = " is too short or has no value characters
        assert not spans(r.text.replace("[secret]", " "))
        if not spans(texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
    for df in (lang, near, clean, masked):
        assert df.columns == start.columns and df.dtypes == start.dtypes
    assert set(ids(packed)) == set(ids(masked))


def test_run(spark, steps):
    total = lambda df: df.selectExpr("count(distinct doc_id)", "sum(length)").first()
    assert total(P.run(spark, SF)) == total(steps[-1])


def test_awkward_and_empty(spark, awkward, empty):
    for df in (awkward.withColumn("n_chars", awkward["doc_id"]), empty.selectExpr("*", "0L as n_chars")):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            df = spark.createDataFrame(out.collect(), out.schema)
        P.pack(spark, df, SF).count()


def test_language_stage_without_labels(spark, docs):
    bare = docs.selectExpr("* except (lang)", "CAST(NULL AS STRING) AS lang")
    more = bare.limit(1).selectExpr("* except (text)", "'12 34' AS text").unionByName(bare)
    want = [r.doc_id for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)]
    assert ids(P.keep_languages(spark, more, SF)) == sorted(want)


def test_language_stage_rejects_what_it_cannot_tell(spark, docs, monkeypatch):
    """The stage keeps exactly the texts that the model, asked one by one, can tell."""
    model = language.fit_language(docs)
    said = {r.doc_id: model.predict(r.text) for r in docs.collect()}
    monkeypatch.setattr(P, "TIMES_CHANCE", 1.95)
    least = 1.95 / len(model.languages)
    kept = ids(P.keep_languages(spark, docs, SF))
    assert kept == sorted(i for i, (lang, score) in said.items() if lang != "und" and score >= least)
