"""Token counts of fields and sections from one encoding of the whole document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import clean, once

RULES = ("first", "most", "split")


class ByteTokens:
    """Byte lengths of the tokens of a text, for a byte-level vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """End of every token in bytes; the tokens cover the text without a gap."""
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        return np.cumsum(self.lengths[ids])


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of every section, and how many of them reach into another section.

    ``ends`` are the tokens' ends, ``bounds`` the sections' ends, both in bytes, rising, up to the same
    last value.  A token that crosses a boundary goes to the section of its first byte (``first``), to
    the one that holds most of its bytes, the first of equals (``most``), or to each by its share of
    bytes (``split``).  Empty sections get nothing.
    """
    n = len(bounds)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    crossing = first != last
    out = np.bincount(first[~crossing], minlength=n).astype(float)
    crossed = np.zeros(n)
    lows = np.r_[0, bounds[:-1]] if n else bounds
    for k in np.flatnonzero(crossing):
        s = np.arange(first[k], last[k] + 1)
        held = np.minimum(bounds[s], ends[k]) - np.maximum(lows[s], starts[k])
        crossed[s[held > 0]] += 1
        if rule == "split":
            out[s] += held / held.sum()
        else:
            out[s[0] if rule == "first" else s[int(held.argmax())]] += 1
    return out, crossed


FIELDS = ["start", "end", "n_tokens", "n_crossing"]


def _counted(parts: list[list[str]], tokens: ByteTokens, rule: str) -> pd.DataFrame:
    rows = []
    for texts in parts:
        ends = tokens.ends("".join(texts))
        bounds = np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
        stops = np.cumsum([len(t) for t in texts], dtype=np.int64)
        n, crossing = allocate(ends, bounds, rule)
        rows.append((stops - [len(t) for t in texts], stops, n, crossing.astype(np.int64)))
    return pd.DataFrame({f: [r[k] for r in rows] for k, f in enumerate(FIELDS)})


def _zip(made: Column) -> Column:
    return F.arrays_zip(*[made[f].alias(f) for f in FIELDS])


_TYPE = "start array<long>, `end` array<long>, n_tokens array<double>, n_crossing array<long>"


def line_tokens(text: str | Column, path: str, pattern: str, rule: str = "first") -> Column:
    """Array of ``(start, end, n_tokens, n_crossing)`` for the lines of every whole text.

    A line keeps its line break; offsets are code points.  The text is encoded once, so the counts
    of a text's lines add up to its number of tokens.  NULL has no line, empty text one empty line.
    """

    @F.pandas_udf(_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = ByteTokens(path, pattern)
        for texts in batches:
            parts = []
            for t in texts:
                lines = t.split("\n") if isinstance(t, str) else []
                parts.append([x + "\n" for x in lines[:-1]] + lines[-1:])
            yield _counted(parts, tokens, rule)

    return _zip(once(run)(F.col(text) if isinstance(text, str) else text))


def field_tokens(fields: list[str | Column], path: str, pattern: str, rule: str = "first") -> Column:
    """The same for several columns of a row, joined by line breaks into one document.

    The break belongs to the field before it; a NULL field counts as empty.
    """
    columns = [F.col(f) if isinstance(f, str) else f for f in fields]

    @F.pandas_udf(_TYPE)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        tokens = ByteTokens(path, pattern)
        for series in batches:
            rows = zip(*[clean(s) for s in series])
            yield _counted([[*(f + "\n" for f in r[:-1]), r[-1]] for r in rows], tokens, rule)

    return _zip(once(run)(*columns))


def section_counts(
    df: DataFrame, path: str, pattern: str, rule: str = "first", id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per line of every document: ``doc_id, section, start, end, n_tokens, n_crossing``.

    NULL text has no section.  Repeated rows are counted each; other columns are ignored.
    """
    made = df.select(
        F.col(id_col).alias("doc_id"), line_tokens(text_col, path, pattern, rule).alias("s")
    )
    return made.select("doc_id", F.posexplode("s").alias("section", "s")).select(
        "doc_id", F.col("section").cast("long"), "s.start", "s.end", "s.n_tokens", "s.n_crossing"
    )
