"""License scan: templates with optional and replaceable regions as token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from gridloom.llm.common import clean, once

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wording of public licenses.  ``<<opt>> .. <<end>>`` may be left out,
# ``<<var 0-3>>`` stands for any words of that number, ``<<one a|b>>`` for one of the words.
# A ``-grant`` is the opening clause alone; the plain names are the whole wording with its conditions.
TEMPLATES = {
    "mit-notice": """<<opt>>this <<var 1-3>> is<<end>> <<one licensed|released|distributed|available>>
        under the <<opt>>terms of the<<end>> MIT License""",
    "apache-2.0-notice": """licensed under the Apache License <<opt>>the License<<end>> Version 2.0""",
    "gnu-gpl-notice": """<<opt>>this <<var 1-3>> is<<end>> <<one licensed|released|distributed>> under the
        <<opt>>terms of the<<end>> GNU General Public License <<opt>>version <<var 1-2>><<end>>""",
    "cc-by-nc-notice": """<<one licensed|released|available>> under <<opt>>a <<end>> <<opt>>creative commons<<end>>
        CC BY-NC <<var 1-2>>""",
    "rights-reserved": """<<opt>>copyright <<opt>>c<<end>> <<var 1-6>><<end>> all rights reserved""",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        <<one software|work>> and associated documentation files <<opt>>(the "Software")<<end>>, to deal in
        the <<one software|work>> without restriction""",
    "isc-grant": """Permission to use, copy, modify, <<opt>>and<<end>> <<opt>>/or<<end>> distribute this
        <<one software|work>> for any purpose with or without fee is hereby granted""",
    "bsd-grant": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        <<one software|work>> and associated documentation files <<opt>>(the "Software")<<end>>, to deal in
        the <<one software|work>> without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        <<one software|work>>, and to permit persons to whom the <<one software|work>> is furnished to do
        so, subject to the following conditions:
        The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>>
        shall be included in all copies or substantial portions of the <<one software|work>>.
        THE <<one software|work>> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND <<one noninfringement|non>> <<opt>>infringement<<end>>. IN NO EVENT SHALL <<var 1-9>> BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE <<one software|work>> OR THE USE OR OTHER DEALINGS
        IN THE <<one software|work>>""",
    "isc": """Permission to use, copy, modify, <<opt>>and<<end>> <<opt>>/or<<end>> distribute this
        <<one software|work>> for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.
        THE <<one software|work>> IS PROVIDED "AS IS" AND <<var 1-9>> DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS <<one software|work>> INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL <<var 1-9>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS <<one software|work>>""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<opt>>1<<end>> Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<opt>>2<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. THIS SOFTWARE IS PROVIDED BY <<var 1-9>> AS IS AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
        FOR A PARTICULAR PURPOSE ARE DISCLAIMED""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<opt>>1<<end>> Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<opt>>2<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. <<opt>>3<<end>> Neither the name of <<var 1-9>> nor the names of <<opt>>its<<end>>
        <<opt>>the<<end>> contributors may be used to endorse or promote products derived from this software
        without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var 1-9>> AS IS AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED""",
}

_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters a-z after lowering A-Z, and any non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def parse(template: str) -> list:
    """A template as a list of words, ``("one", words)``, ``("var", low, high)``, ``("opt", parts)``."""
    stack: list[list] = [[]]
    for mark, text in re.findall(r"<<(.*?)>>|([^<]+)", template):
        kind, _, rest = mark.partition(" ")
        if text:
            stack[-1].extend(words_of(text))
        elif kind == "opt":
            stack.append([])
        elif kind == "end":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif kind == "var":
            low, high = rest.split("-")
            stack[-1].append(("var", int(low), int(high)))
        else:
            stack[-1].append(("one", [w.encode() for w in rest.split("|")]))
    return stack[0]


class Automaton:
    """States with word, any-word and empty moves; state 0 starts, the last state accepts."""

    def __init__(self, template: str):
        self.on: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        parts = parse(template)
        self.required = sorted((p for p in parts if isinstance(p, bytes)), key=len, reverse=True)
        self.mandatory = sum(not isinstance(p, tuple) or p[0] == "one" for p in parts)
        self.final = self._add(parts, 0)
        self.closure = [self._reach(s) for s in range(len(self.on))]

    def _state(self) -> int:
        self.on.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.on) - 1

    def _add(self, parts: list, state: int) -> int:
        for part in parts:
            target = self._state() if not (isinstance(part, tuple) and part[0] == "opt") else None
            if isinstance(part, bytes):
                self.on[state][part] = target
            elif part[0] == "one":
                self.on[state].update(dict.fromkeys(part[1], target))
            elif part[0] == "var":
                for k in range(part[2]):
                    if k >= part[1]:
                        self.free[state].append(target)
                    nxt = self._state() if k + 1 < part[2] else target
                    self.any[state] = nxt
                    state = nxt
            else:
                start = self._state()
                self.free[state].append(start)
                target = self._add(part[1], start)
                self.free[state].append(target)
            state = target
        return state

    def _reach(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepts(self, words: list[bytes]) -> bool:
        """Whether the template's wording stands anywhere in the words."""
        start = self.closure[0]
        active: set[int] = set()
        for w in words:
            nxt: set[int] = set()
            for s in active | start:
                if w in self.on[s]:
                    nxt |= self.closure[self.on[s][w]]
                if self.any[s] is not None:
                    nxt |= self.closure[self.any[s]]
            if self.final in nxt:
                return True
            active = nxt
        return False


def weight(mandatory: int) -> float:
    """Trust in a template by its mandatory words: 3 words give one half."""
    return mandatory / (mandatory + 3.0)


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double"
)


def scan(text: str, automata: dict[str, Automaton]) -> tuple:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at = line.find(needle)
        while at >= 0:
            places.append((at, line.count(b" ", 0, at)))
            base.add(label)
            at = line.find(needle, at + 1)
    found, score = set(), 0.0
    for label, automaton in automata.items():
        if all(b" " + w + b" " in line for w in automaton.required) and automaton.accepts(words):
            found.add(label)
            score = max(score, weight(automaton.mandatory))
    starts = [w for _, w in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | found)), score,
    )


def license_scan(text: str | Column, templates: dict[str, str] | None = None) -> Column:
    """Struct of ``FIELDS`` for every whole text.

    A template is accepted where its mandatory words stand in order, with optional
    regions left out or in and replaceable ones filled by any words of the allowed number.  The score
    is the weight of the longest accepted template, 0 without one.  NULL and empty text
    has no words, no places, NULL first and last word and empty labels; rows are judged one by one, so
    ties, repeated rows and other columns play no part.  A text of any length is read whole, word by word.
    """
    chosen = TEMPLATES if templates is None else templates

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = {label: Automaton(t) for label, t in chosen.items()}
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for texts in batches:
            out = pd.DataFrame([scan(t, automata) for t in clean(texts)], columns=names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return once(run)(F.col(text) if isinstance(text, str) else text)


def _regex(parts: list) -> str:
    out = ""
    for p in parts:
        if isinstance(p, bytes):
            out += " " + p.decode()
        elif p[0] == "one":
            out += " (?:" + "|".join(w.decode() for w in p[1]) + ")"
        elif p[0] == "var":
            out += "(?: [^ ]+){%d,%d}" % (p[1], p[2])
        else:
            out += "(?:" + _regex(p[1]) + ")?"
    return out


def sql() -> str:
    """The same rows in DuckDB, templates as regular expressions over the joined words."""
    places, labels, scores = [], [], ["0e0"]
    for phrase, label in PHRASES.items():
        ws = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws))
        places.append(f"list_filter(range(0, len(w)), lambda i: {same})")
        labels.append(f"CASE WHEN contains(line, ' {phrase} ') THEN '{label}' END")
    base = "[" + ", ".join(labels) + "]"
    for label, template in TEMPLATES.items():
        hit = f"regexp_matches(line, '{_regex(parse(template))} ')"
        labels.append(f"CASE WHEN {hit} THEN '{label}' END")
        scores.append(f"CASE WHEN {hit} THEN {weight(Automaton(template).mandatory)!r} ELSE 0e0 END")
    joined = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
lines AS (
  SELECT doc_id, w, concat(' ', array_to_string(w, ' '), ' ') AS line,
         list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS places
  FROM split)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
       {joined.format(base)} AS base_labels,
       {joined.format("[" + ", ".join(labels) + "]")} AS labels,
       CAST(greatest({", ".join(scores)}) AS DOUBLE) AS score
FROM lines
"""
