import collections
import random

import numpy as np

from gridloom.llm import neardup as N


def bag(text):
    w = text.split()
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def brute(rows):
    """Class (least id) of every id, from all pairs."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, t, bag(t)) for i, t in rows if t is not None]
    for n, (i, t, x) in enumerate(bags):
        for j, u, y in bags[:n]:
            both = sum((x & y).values())
            union = sum(x.values()) + sum(y.values()) - both
            if t == u or union and 5 * both >= 4 * union:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def test_whole_table(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_groups_of_edited_copies(spark):
    rng, rows = random.Random(5), []
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    x = N.mix(np.arange(1, 400, dtype=np.uint64))
    a, b = rng.integers(0, 9, len(x)), rng.integers(0, 9, len(x))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    size = 4096
    sa = N.bag_minhash(x[a > 0], a[a > 0], size)
    sb = N.bag_minhash(x[b > 0], b[b > 0], size)
    assert abs((sa == sb).mean() - want) < 4 * np.sqrt(want * (1 - want) / size)


def test_awkward_rows(awkward):
    rows = N.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    source = awkward.collect()
    for r in rows:
        texts = {s.text for s in source if s.doc_id == r.doc_id}
        if texts == {None}:
            assert r.class_id == r.doc_id and r.class_size == 1
    by_text = {s.text: s.doc_id for s in source if s.doc_id is not None}
    assert len({r.class_id for r in rows if r.doc_id in (16, 17)}) == 1 and by_text


def test_keep_one(awkward, docs):
    for df in (awkward, docs):
        kept = N.keep_one(df)
        assert kept.columns == df.columns
        left = kept.collect()
        classes = {r.class_id for r in N.near_duplicates(df).collect()}
        texts = [r.text for r in left if r.text is not None]
        assert len(texts) == len(set(texts))
        if df is docs:
            assert {r.doc_id for r in left} == classes
        nulls = df.where("text is null").count()
        assert sum(r.text is None for r in left) == nulls


def test_empty(empty):
    assert N.near_duplicates(empty).count() == 0
    assert N.keep_one(empty).count() == 0


def test_crowd_around_a_common_passage(spark):
    """Texts that share a passage meet in buckets; only those really similar are linked."""
    rng, rows = random.Random(9), []
    passage = [f"p{k}" for k in range(60)]
    for _ in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 24))]
        rows.append((len(rows), " ".join(own + passage)))
        if rng.random() < 0.2:
            rows.append((len(rows), " ".join(own + passage[:-1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_marks_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(4)
    for size in (1, 5, 40, 900, 20_000):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for share in (0.0, 0.1, 0.2, 0.5):
            y = x.copy()
            new = rng.random(len(x)) < share
            y[new] = rng.integers(0, 2**63, int(new.sum())).astype(np.uint64)
            y = np.unique(y)
            apart = int(np.bitwise_count((N.parity_marks(x) ^ N.parity_marks(y)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(x, y))


def test_clashing_names(spark):
    rows = [(k, "one two three four five six seven" if k < 3 else f"own words {k} and some more", 9, 9, 9) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id_ int, node_ int, root int")
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]


def test_very_long_text(spark):
    """Texts of some MB: copies with a few edits are one class, another text is not."""
    words = [f"w{k % 7919}x{k % 31}" for k in range(300_000)]
    edited = list(words)
    edited[1000::9000] = ["edit"] * len(edited[1000::9000])
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1])), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
