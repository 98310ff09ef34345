import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gridloom.llm import attribution as A

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute(text):
    """Tokens by line from the offsets of another implementation of the same vocabulary."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    n = len(tok.encode(text, add_special_tokens=False).ids)
    return n


def test_rows_add_up(awkward, docs):
    for df in (awkward, docs):
        rows = df.select("text", A.line_tokens("text", PATH, PATTERN).alias("s")).collect()
        assert len(rows) == df.count()
        for r in rows:
            if r.text is None:
                assert r.s == []
                continue
            assert sum(x.n_tokens for x in r.s) == brute(r.text)
            lines = [r.text[x.start : x.end] for x in r.s]
            assert "".join(lines) == r.text and len(lines) == r.text.count("\n") + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12), st.lists(st.integers(0, 6), min_size=1, max_size=6))
def test_allocation(tokens, sections):
    total = sum(sections)
    ends = [e for e in np.cumsum(tokens) if e < total] + ([total] if total else [])
    ends, bounds = np.array(ends, dtype=np.int64), np.cumsum(sections)
    owner = [k for k, n in enumerate(sections) for _ in range(n)]
    for rule in A.RULES:
        want, start = np.zeros(len(sections)), 0
        for e in ends:
            held = [owner[start:e].count(k) for k in range(len(sections))]
            if rule == "first":
                want[owner[start]] += 1
            elif rule == "most":
                want[int(np.argmax(held))] += 1
            else:
                want += np.array(held) / (e - start)
            start = e
        got, _ = A.allocate(ends, bounds, rule)
        assert np.allclose(got, want)


def test_fields(spark):
    df = spark.createDataFrame([("a b", None, "ccc"), (None, None, None)], "x string, y string, z string")
    a, b = [r.s for r in df.select(A.field_tokens(["x", "y", "z"], PATH, PATTERN).alias("s")).collect()]
    assert [(s.start, s.end) for s in a] == [(0, 4), (4, 5), (5, 8)]
    assert sum(s.n_tokens for s in a) == brute("a b\n\nccc")
    assert [(s.start, s.end) for s in b] == [(0, 1), (1, 2), (2, 2)]


def test_empty(empty):
    assert A.section_counts(empty, PATH, PATTERN).count() == 0
