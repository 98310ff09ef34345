import collections
import hashlib

from gridloom.llm import radix


def brute(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, keep, len(ids), first and i == keep, sha))
            first = first and i != keep
    return collections.Counter(out)


def told(df):
    return collections.Counter(
        (r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in radix.exact_duplicates(df).collect())


def test_awkward_rows(awkward):
    assert told(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])


def test_whole_table(docs):
    assert told(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(empty):
    assert radix.exact_duplicates(empty).count() == 0
    assert radix.drop_copies(empty).columns == empty.columns


def test_texts_that_part_late(spark, monkeypatch):
    """Equal lengths and long common beginnings: every round has to split something."""
    monkeypatch.setattr(radix, "WIDTH", 4)
    monkeypatch.setattr(radix, "GROWTH", 2)
    monkeypatch.setattr(radix, "WIDEST", 64)
    rows = [(k, "p" * 24 + "q" * at + c + "r" * (300 - at)) for k, (at, c) in enumerate(
        (at, c) for at in range(0, 300, 11) for c in "xyx")]
    rows += [(1000 + k, "p" * n) for k, n in enumerate([23, 24, 25, 24, 28, 28, 0, 0, 4, 4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert told(df) == brute(rows)


def test_very_long_texts(spark):
    """Texts of 9 MB that differ in their last byte only, and a copy of one of them."""
    body = "lorem ipsum é " * 600_000
    rows = [(1, body + "a"), (2, body + "b"), (3, body + "a"), (2**60 + 3, "short"), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(df) == brute(rows)


def test_one_text_holds_most_rows(spark):
    rows = [(k, "the same words again and again" if k % 3 else f"text {k}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert told(df) == brute(rows)


def test_drop_copies(awkward):
    kept = radix.drop_copies(awkward)
    assert kept.columns == awkward.columns
    left = kept.collect()
    texts = [r.text or "" for r in left]
    assert len(set(texts)) == len(texts)
    assert set(texts) == {r.text or "" for r in awkward.collect()}
    assert (None, "no id") in {(r.doc_id, r.text) for r in left}


def test_clashing_names(spark):
    rows = [(k % 4, "same" if k % 2 else f"{k}", k, "d", 1, 2, 3, 4) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, digit string, part int, size int, n int, kept int")
    assert told(df) == brute([(r[0], r[1]) for r in rows])
    assert radix.drop_copies(df).columns == df.columns
