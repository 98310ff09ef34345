import collections
import hashlib
import zlib

import pytest

from gridloom.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests):
    """Levels from the leaves to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return levels


def proof(levels, at):
    out = []
    for row in levels[:-1]:
        out.append((at % 2, row[at ^ 1] if at ^ 1 < len(row) else ""))
        at //= 2
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    langs = collections.defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0], H(*map(field, r)), r))
    order = sorted(langs, key=lambda g: b"" if g is None else b"+" + g.encode())
    trees = {}
    for g in order:
        langs[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([x[1] for x in langs[g]])
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (doc_id, leaf, r) in enumerate(langs[g]):
            path = proof(trees[g], at) + proof(top, k)
            acc = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r[3] is not None:
                acc = H(*map(field, (*r[:3], r[3] + 1, r[4])))
            for left, beside in path:
                acc = H(beside, acc) if left else H(acc, beside)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], root, H(*[b for _, b in path]), acc, acc == root))
    return collections.Counter(out)


def told(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return collections.Counter(tuple(r[n] for n in names) for r in merkle.manifest(df).collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_any_bucket_height(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = []
    for g, n in [(None, 13), ("a", 1), ("b", 2), ("c", 64), ("d", 65), ("", 3), ("é", 7)]:
        rows += [(len(rows) + 1, "s", g, len(rows), f"text {g} {k}") for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert told(df) == brute(rows)


def test_blocks_of_production_size(spark):
    """A hot language of more than one block of 1024 leaves, beside small ones."""
    rows = [(k, f"s{k % 3}", "en" if k % 9 else "de", k % 50, f"text {k}") for k in range(3300)]
    assert told(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


def test_whole_table(docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = told(docs)
    assert got == brute(rows)
    assert {True, False} == {k[-1] for k in got}


def test_nulls_repeats_and_missing_columns(awkward, spark):
    rows = [(r.doc_id, None, r.lang, None, r.text) for r in awkward.collect()]
    assert told(awkward) == brute(rows)  # no source, no n_chars
    rows = [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "t")] * 4 + [(2**60 + 3, "s", "en", None, "é" * 9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS g", "'x' AS lo", "2 AS path", "3 AS n", "4 AS digest")
    assert told(df) == brute(rows)


def test_very_long_text(spark):
    rows = [(k, "s", "en", 9, c * 5_000_000) for k, c in enumerate("aé")]
    assert told(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_id_holds_all_rows(spark):
    rows = [(7, "s", "en", 3, "same")] * 2500
    assert told(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_empty(empty):
    assert merkle.manifest(empty).count() == 0
