import re

from gridloom.llm import licenses as L


def labels(text):
    return set(L.scan(text, {k: L.Automaton(t) for k, t in L.TEMPLATES.items()})[5].split(",")) - {""}


def test_templates():
    assert labels("Released under the MIT License.") == {"mit-notice"}
    assert labels("x Released under the terms of the MIT License, y") == {"mit-notice"}
    assert labels("Released under an MIT License") == set()
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl", "gnu-gpl-notice"}
    assert labels("GNU General Public License") == {"gpl"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by", "cc-by-nc-notice"}
    assert labels("Copyright (c) 2020 A. Body. All rights reserved") == {"reserved", "rights-reserved"}
    assert labels("licensed under the Apache License, Version 2.0") == {"apache-2.0-notice"}
    assert labels("licensed under the Apache License, version 2") == set()


def test_words():
    assert L.words_of("ÀB-c_9é İ") == ["Àb", "c", "9é", "İ"].__class__(w.encode() for w in ["Àb", "c", "9é", "İ"])


def test_automaton_equals_regex():
    words = ["copyright", "c", "all", "rights", "reserved", "x"]
    a = L.Automaton(L.TEMPLATES["rights-reserved"])
    r = re.compile(L._regex(L.parse(L.TEMPLATES["rights-reserved"])) + " ")
    import itertools
    for combo in itertools.product(words, repeat=5):
        line = " " + " ".join(combo) + " "
        assert a.accepts([w.encode() for w in combo]) == bool(r.search(line)), combo


def test_awkward_rows(awkward):
    rows = awkward.select("text", L.license_scan("text").alias("s")).select("text", "s.*").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r.n_words == len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").translate({k: k + 32 for k in range(65, 91)})))
        assert (r.first_word is None) == (r.n_base == 0)


def test_places(spark):
    text = "cc by, CC-BY all rights reserved"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    s = df.select(L.license_scan("text").alias("s")).first().s
    assert (s.n_words, s.n_base, s.first_word, s.last_word, s.base_labels) == (7, 3, 0, 4, "cc-by,reserved")


def test_empty(empty):
    assert empty.select(L.license_scan("text")).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_wording_is_mandatory():
    assert labels(MIT) == {"mit", "mit-grant"}
    assert labels(MIT.replace("notice shall be", "notice (including the next paragraph) shall be")) == {"mit", "mit-grant"}
    assert labels(MIT.replace("shall be included", "need not be included")) == {"mit-grant"}
    assert labels(MIT.replace("without limitation", "with limitation")) == {"mit-grant"}
    assert labels(MIT[: len(MIT) // 2]) == {"mit-grant"}
    two = L.TEMPLATES["bsd-2-clause"].replace("<<opt>>", "").replace("<<end>>", "").replace("<<var 1-9>>", "A Body")
    three = L.TEMPLATES["bsd-3-clause"].replace("<<opt>>", "").replace("<<end>>", "").replace("<<var 1-9>>", "A Body")
    assert labels(two) == {"bsd-grant", "bsd-2-clause"}
    assert labels(three) == {"bsd-grant", "bsd-3-clause"}
    assert labels(three.replace("endorse", "praise")) == {"bsd-grant"}


def test_automaton_equals_regex_on_whole_wording():
    for label, template in L.TEMPLATES.items():
        words = [w.decode() for p in L.parse(template) for w in (
            [p] if isinstance(p, bytes) else [p[1][0]] if p[0] == "one" else [b"x"] if p[0] == "var" else [])]
        pattern, automaton = re.compile(L._regex(L.parse(template)) + " "), L.Automaton(template)
        for k in range(-1, len(words)):
            some = words[:k] + words[k + 1 :] if k >= 0 else words
            assert automaton.accepts([w.encode() for w in some]) == bool(pattern.search(" " + " ".join(some) + " ")), (label, k)


def test_very_long_text(spark):
    text = "all rights " * 400_000 + "reserved " + MIT
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    s = df.select(L.license_scan("text").alias("s")).first().s
    assert (s.n_base, s.first_word, s.labels) == (1, 799_998, "mit,mit-grant,reserved,rights-reserved")
