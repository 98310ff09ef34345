import random

import numpy as np
import pytest

from gridloom.llm import decontamination as D


def table_sw(a, b):
    """Textbook alignment score."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_score():
    rng = random.Random(3)
    for _ in range(200):
        a = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 14))])
        b = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 14))])
        score, a0, a1, b0, b1 = D.smith_waterman(a, b)
        assert score == table_sw(a, b)
        assert table_sw(a[a0:a1], b[b0:b1]) == score


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_planted(spark, docs, benchmark):
    items = {r.item_id: r.text.split() for r in benchmark.collect() if len(r.text.split()) >= 20}
    host = [r.text for r in docs.where("lang = 'en' and n_chars > 1500").orderBy("doc_id").collect()]
    rng, rows, want = random.Random(1), [], {}
    for n, (item, words) in enumerate(sorted(items.items())[:12]):
        for kind in ("copy", "edited", "case"):
            w = list(words)
            if kind == "edited":
                for k in range(3, len(w), 7):
                    w[k] = rng.choice(["zzq", "zzr"])
                w.insert(len(w) // 2, "zzinserted")
            text = " ".join(w).upper() if kind == "case" else " ".join(w)
            cut = host[n % len(host)].split()
            rows.append((len(rows), " ".join(cut[:80]) + " " + text + " " + " ".join(cut[80:])))
            want[len(rows) - 1] = item
    clean = docs.where("doc_id < 0").select("doc_id", "text")
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(clean)
    got = D.contaminated(df, benchmark).collect()
    assert {(d, i) for d, i in want.items()} <= {(r.doc_id, r.item_id) for r in got}


def test_equals_alignment_of_every_pair(docs, benchmark):
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs, benchmark).collect()}
    items = [r for r in benchmark.collect() if len(D.words_of(r.text)) >= D.LEAST_ITEM]
    some = [r for r in docs.collect() if len(r.text or "") < 6000]
    numbers = {}
    num = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in D.words_of(t)], dtype=np.int64)
    coded = [(r.item_id, num(r.text)) for r in items]
    for r in some:
        words = num(r.text or "")
        for item, x in coded:
            if not len(words):
                continue
            score = D.smith_waterman(x, words)[0] / (2 * len(x))
            assert ((r.doc_id, item) in got) == (score >= D.SHARE), (r.doc_id, item, score)


def test_awkward_rows(awkward, empty, benchmark, spark):
    assert D.contaminated(awkward, benchmark).count() == 0
    assert D.contaminated(empty, benchmark).count() == 0
    none = spark.createDataFrame([(None, "a b c d e f g h i"), (1, None)], "item_id long, text string")
    assert D.contaminated(awkward, none).count() == 0


def test_blocks_give_the_same(docs, benchmark, monkeypatch):
    one = {tuple(r) for r in D.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(D, "BLOCK_WORDS", 200)
    indexes = D.build_indexes(docs, benchmark)
    assert len(indexes) > 1
    many = docs.select("doc_id", D.leaks("text", indexes).alias("l")).selectExpr("doc_id", "explode(l) l").select("doc_id", "l.*")
    assert {(r[0], r[1]) for r in many.collect()} == {(r[0], r[1]) for r in one}


def leaks_of(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.score for r in D.contaminated(docs, tests).collect()}


def every_pair(texts, items):
    numbers = {}
    num = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in D.words_of(t)], dtype=np.int64)
    out = {}
    for (d, t), (i, x) in ((a, b) for a in enumerate(texts) for b in enumerate(items)):
        score, m = D.smith_waterman(num(x), num(t))[0], len(num(x))
        if score >= min(2 * D.SHARE * m, 2 * D.LONG):
            out[d, i] = score / (2 * m)
    return out


@pytest.mark.parametrize("gap", [5, 6])
def test_edited_copies_alone_in_the_corpus(spark, gap):
    # broken seeds stand nowhere and must not push out the intact ones
    rng, items, texts = random.Random(gap), [], []
    for n in range(8, 61, 4):
        for phase in range(gap):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            items.append(" ".join(words))
            words[phase::gap] = ["zz"] * len(words[phase::gap])
            texts.append("before it " + " ".join(words) + " after it")
    want = every_pair(texts, items)
    assert len(want) >= len(texts) - 2
    assert leaks_of(spark, texts, items) == want


def test_accepted_alignments_without_long_seeds(spark):
    # every third or fourth word replaced, a word put in after each, words left out: half the score remains
    rng, items, texts = random.Random(9), [], []
    for n in (8, 9, 15, 24, 60, 90, 130):
        for kind in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            items.append(" ".join(words))
            if kind < 3:
                words[3 - kind % 2 :: 3 + kind % 2] = ["zz"] * len(words[3 - kind % 2 :: 3 + kind % 2])
            elif kind == 3:
                words = [x for w in words for x in (w, "zz")]
            elif kind == 4:
                del words[2::3]
            else:
                words = [x for k, w in enumerate(words) for x in ([w, "zz"] if k % 5 else ["zz"])]
            texts.append(" ".join(["yy"] * 30 + words + ["yy"] * 30))
    want = every_pair(texts, items)
    assert len(want) >= len(texts) // 2
    assert leaks_of(spark, texts, items) == want


def test_random_alignments_equal_brute_force(spark):
    # few words: chance alignments of every kind at the threshold
    rng = random.Random(4)
    draw = lambda n, k: " ".join(f"w{int(rng.paretovariate(0.7)) % k}" for _ in range(n))
    items = [draw(rng.randrange(8, 50), 40) for _ in range(12)] + [draw(100, 200)]
    texts = [draw(rng.randrange(1, 250), k) for k in (25, 40, 90) for _ in range(25)]
    want = every_pair(texts, items)
    assert 20 < len(want) < len(texts) * len(items) - 20
    assert leaks_of(spark, texts, items) == want


def test_short_items_and_items_without_id(spark):
    docs = spark.createDataFrame(
        [(0, "Say: open the red door, now"), (1, "open the blue red door"), (2, "yes"), (3, "x a b c d e f g h i"), (4, None)],
        "doc_id long, text string",
    )
    tests = spark.createDataFrame(
        [(1, "open the red door"), (2, "Yes!"), (None, "a b c d e f g h i"), (None, "red door"), (3, None), (4, " .")],
        "item_id long, text string",
    )
    got = sorted((r.doc_id, r.item_id or -1, r.score, r.start, r.end) for r in D.contaminated(docs, tests).collect())
    assert got == [(0, -1, 1.0, 3, 5), (0, 1, 1.0, 1, 5), (1, -1, 1.0, 3, 5), (2, 2, 1.0, 0, 1), (3, -1, 1.0, 1, 10)]


def test_one_block_is_shipped_at_a_time(spark, docs, benchmark, monkeypatch):
    few = spark.createDataFrame(benchmark.orderBy("item_id").limit(12).collect())
    planted = few.selectExpr("item_id + 1000000 AS doc_id", "concat('so ', text) AS text")
    docs = docs.where("doc_id < 20").select("doc_id", "text").unionByName(planted)
    one = sorted(tuple(r) for r in D.contaminated(docs, few).collect())
    shipped, leaks = [], D.leaks
    monkeypatch.setattr(D, "BLOCK_WORDS", 200)
    monkeypatch.setattr(D, "leaks", lambda text, indexes: shipped.append(len(indexes)) or leaks(text, indexes))
    assert sorted(tuple(r) for r in D.contaminated(docs, few).collect()) == one and one
    assert len(shipped) > 1 and set(shipped) == {1}
    kept = {r.doc_id for r in D.clean_of(docs, few).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {r[0] for r in one}
