import collections
import hashlib
import random
import re
import zlib

from gridloom.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns, key=lambda x: x[0])] for c, turns in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words(p)
    return collections.Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def told(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return collections.Counter(tuple(r[n] for n in FIELDS) for r in T.conversation_trie(df).collect())


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = collections.Counter(tuple(r[n] for n in FIELDS) for r in T.conversation_trie(df).collect())
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "x y", ""])) for c in range(120) for t in range(rng.randrange(7))]
    assert told(spark, rows) == brute(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [
        (0, None, None, None), (0, 1, "u", None), (0, 1, "a", "b c"), (0, 1, "a", "b c"), (0, 3, "", "z"),
        (None, 1, "u", "no conversation"), (1, 2, "u", "one"), (2, 2, None, "one"), (19, 1, "u", "x"), (21, 5, "u", "x"),
        (40, 1, "ua", "b"), (41, 1, "u", "ab"), (42, None, "u", " \n"), (2**60, 1, "u", "big"), (2**60 + 1, 1, "u", "big"),
    ]
    assert told(spark, rows) == brute(rows)


def test_one_first_turn_holds_most_conversations(spark, monkeypatch):
    """Thousands of ids end at one node; its list is hashed in pieces."""
    monkeypatch.setattr(T, "CHUNK", 16)
    rows = [(c, 0, "u", "hello there" if c % 3 else f"own {c}") for c in range(3000)]
    rows += [(c, 1, "a", "hi") for c in range(0, 3000, 7)]
    assert told(spark, rows) == brute(rows)


def test_very_long_text(spark):
    rows = [(k, 0, "u", "word " * 900_000 + ("end" if k % 2 else "")) for k in range(4)]
    assert told(spark, rows) == brute(rows)


def test_deep_conversations(spark, monkeypatch):
    """Hundreds of turns, shared to different depths; portions smaller than one conversation."""
    monkeypatch.setattr(T, "PORTION", 300)
    rows = [(k, t, "u", f"t{t}" if t < 60 * k else f"own {k}") for k in range(7) for t in range(400 - k)]
    assert told(spark, rows) == brute(rows)


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(0, 1, "u", "x")], SCHEMA)
    wide = df.selectExpr("*", "1 AS path", "2 AS key", "3 AS turns", "4 AS depth", "'p' AS first")
    assert T.conversation_trie(wide).collect() == T.conversation_trie(df).collect()
    assert T.conversation_trie(df.limit(0)).count() == 0
