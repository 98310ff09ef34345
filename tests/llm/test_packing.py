import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing
from gridloom.llm.packing import TIERS, WordEncoder, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def verify(df, partitions):
    rows = pack_documents(df, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, np.array(ids, dtype="<u4").tobytes()))
    # pieces of equal documents are interchangeable: compare as multisets of (id, start, crc)
    spans = {}
    for r in rows:
        spans.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    pool = {}
    for doc_id, ids in want:
        pool.setdefault((doc_id, len(ids) // 4), []).append(ids)
    assert spans.keys() == pool.keys()
    for key, pieces in spans.items():
        assert sum(p.length for p in pieces) == key[1] * len(pool[key])
        for p in pieces:
            cut = {zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for ids in pool[key]}
            assert p.ids_crc32 in cut
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    partial = 0
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= pieces[0].context and pieces[0].context in TIERS
        partial += at not in TIERS
    assert partial <= partitions
    groups = {}
    for r in rows:
        groups.setdefault(r.step_group, []).append(r.length)
    assert max(map(sum, groups.values())) <= 32768
    return rows


def test_awkward_rows(awkward):
    verify(awkward, 3)


def test_whole_table(docs):
    verify(docs, 1)


def test_empty(empty):
    assert pack_documents(empty, PATH).count() == 0


def test_large_ids_beside_null(spark):
    ids = [2**53 + 1, None, 2**60 + 3, -(2**62) - 1, 7]
    df = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string").coalesce(1)
    got = [r.doc_id for r in pack_documents(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 700_000), (2, "b")], "doc_id long, text string").coalesce(1)
    rows = sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in pack_documents(df, PATH).collect())
    assert {r[3] for r in rows if r[0] == 1} == {700_001}
    at = 0
    for _, start, length, _ in [r for r in rows if r[0] == 1]:
        assert start == at
        at += length
    assert at == 700_001


def test_new_words_are_spelled_together_with_the_same_ids():
    encode = WordEncoder(PATH)
    spell, calls = encode.as_bytes, []

    class Counted:
        def pre_tokenize_str(self, text):
            calls.append(text)
            return spell.pre_tokenize_str(text)

    encode.as_bytes = Counted()
    texts = ["Ünïcödé ŁÓDŹ straße \u010a \u010a\u010b, 你好 ñandú! word, word.", "ไทย العربية 한국어 ʰ plain x² (ß) ñandú?", ""]
    assert encode(texts) == WordEncoder(PATH)._direct(texts)
    assert len(calls) == 1


def test_common_words_outlast_a_bounded_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 400)
    encode, learned = WordEncoder(PATH), []
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda words: (learned.extend(words), learn(words)))
    plain = WordEncoder(PATH)
    for k in range(40):
        texts = ["the common words, again!", " ".join(f"x{k}y{j}" for j in range(50))]
        assert encode(texts) == plain._direct(texts)
        assert len(encode.known) + len(encode.older) <= 400 + 2 * 60  # and the words of one call each
    assert learned.count("common") == learned.count("again!") == 1


def test_words_that_come_again_in_a_call_are_looked_up_once():
    asked = []

    class Asked(dict):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

        def get(self, word, default=None):
            asked.append(word)
            return super().get(word, default)

        def __contains__(self, word):
            asked.append(word)
            return super().__contains__(word)

    encode = WordEncoder(PATH)
    texts = ["The same words, again! " * 500, "the SAME words, again!", "", "again!"]
    want = encode._direct(texts)
    encode.known, encode.older = Asked(), Asked()
    assert encode(texts) == want
    assert len(asked) < 50


def test_words_are_cut_into_groups_like_the_tokenizer():
    texts = [
        "it's 'state they'll o'clock 'n' 1984 3,5 a1b2 ..!? x_y __ naïve× 6÷2 ß½ €5 ʼn n’t l'été",
        "tab\tnew\nline\r\nwide\u3000space\xa0here\x85there \x00nul\x01 del\x7f. \u0300lone ﬁ ǅ ɏ ɐ",
        "ĊĊ Ċ. <|endoftext|> < | σΣ", "", " ", "\n", "Жизнь, 你好。 สวัสดี! 😀😀 #$%&&& ², x²",
    ]
    encode = WordEncoder(PATH)
    for some in (texts, texts[::-1], *([t] for t in texts)):
        assert encode(some) == encode._direct(some)
    letters = [f"ab{chr(c)}cd{chr(c)} {chr(c)}" for c in range(0xD800)]
    assert encode(letters) == encode._direct(letters)


def test_a_letter_whose_lower_case_is_two_characters():
    texts = ["İ\u093c İstanbul", "plain"]  # in lower case the dots change places
    encode = WordEncoder(PATH)
    assert encode(texts) == encode._direct(texts)


def test_batches_of_texts_stay_in_arrow(docs):
    plan = pack_documents(docs, PATH)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
