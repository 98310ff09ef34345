import hashlib
import random
import tempfile

import numpy as np
import pytest

from gridloom.llm import repeats as R, suffix as S


def brute(texts, length):
    """``(n_bytes, n_removed, n_spans, sha)`` of every text by a table of all passages."""
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def verify(df, length):
    source = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = sorted(zip([-1 if i is None else i for i, _ in source], brute([t for _, t in source], length)))
    rows = R.remove_repeats(df, length=length).collect()
    got = sorted(
        (-1 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows
    )
    assert got == want
    return rows


@pytest.mark.parametrize("memory", [200, 1 << 20])
@pytest.mark.parametrize("block", [5, 1 << 17])
def test_suffix_order(memory, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block + memory)
    for _ in range(60):
        cap = rng.choice([3, 5, 8, 12, 20])
        base = bytes(rng.randrange(rng.choice([2, 3, 20])) for _ in range(rng.randrange(1, 60)))
        text = b""
        for _ in range(rng.randrange(1, 6)):
            s = bytearray(base if rng.random() < 0.7 else bytes(rng.randrange(3) for _ in range(rng.randrange(40))))
            for _ in range(rng.randrange(3)):
                if s:
                    s[rng.randrange(len(s))] = rng.randrange(5)
            text += bytes(b + S.SHIFT for b in s) + bytes([S.BREAK])
        text = np.frombuffer(text + bytes(cap + 9), dtype=np.uint8)
        with tempfile.TemporaryDirectory() as folder:
            got = S.repeated_starts(text, cap, folder, memory)
        seen = {}
        for k in range(len(got)):
            w = text[k : k + cap].tobytes()
            if S.BREAK not in w and S.END not in w:
                seen.setdefault(w, []).append(k)
        for at in seen.values():
            assert (got[at] == (len(at) > 1)).all()


def test_runs_agree_on_equal_passages():
    rng = random.Random(2)
    texts = [bytes(rng.randrange(97, 100) for _ in range(rng.randrange(0, 200))) for _ in range(12)] + [b"a" * 90]
    value = {}
    for t, (v, first, last, _) in zip(texts, R.window_runs(texts, 40)):
        starts = [k for a, b in zip(first, last) for k in range(a, b + 1)]
        assert starts == list(range(max(0, len(t) - 39)))
        for x, a, b in zip(v, first, last):
            for k in range(a, b + 1):
                assert value.setdefault(t[k : k + 40], x) == x


def test_edited_texts(spark):
    rng = random.Random(4)
    words = ["ab", "cde", "éü", "f", "\n", "ghij"]
    base = [rng.choice(words) for _ in range(160)]
    texts = [None, "", "x" * 120, "ab" * 70, "".join(base)]
    for _ in range(14):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append("".join(w[rng.randrange(20) :]))
    texts += [texts[4], texts[6] + texts[7], "".join(rng.choice(words) for _ in range(90))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verify(df, 40)


def test_whole_table(docs):
    rows = verify(docs.where("n_chars < 5000"), 400)
    assert any(0 < r.n_removed < r.n_bytes for r in rows)


def test_awkward_rows(awkward, empty):
    verify(awkward, 400)
    verify(awkward, 20)
    assert R.remove_repeats(empty).count() == 0


def test_crowded_hash_is_split(spark, monkeypatch):
    # one passage in most texts, all surroundings different: its pieces do not merge
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, other, most = draw(40), draw(60), 1500
    texts = [draw(60) + (passage if k % 3 else other[:50] if k % 2 else "") + draw(60) for k in range(120)]
    texts += [draw(30) + passage + other + draw(9), "y" * 3000, draw(50) + "y" * 2500, texts[5], None, ""]
    monkeypatch.setattr(R, "SHARD_BYTES", most)
    made = R._sorted_shard

    def watched(length, memory):
        run = made(length, memory)

        def checked(batches):
            frames = list(batches)
            sizes = {}
            for f in frames:
                for v, p in zip(f["value"], f["piece"]):
                    sizes[v] = sizes.get(v, 0) + len(p)
            assert max(sizes.values(), default=0) <= most
            yield from run(iter(frames))

        return checked

    monkeypatch.setattr(R, "_sorted_shard", watched)
    rows = verify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40)
    assert sum(r.n_removed for r in rows) > 80 * 40
