"""Benchmark decontamination: rare word-pair seeds by a lossless count, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import clean, free_name, once
from gridloom.session import cut

SPARE = 4  # most frequent places of an item not looked up: one for so many of the points it needs
LEAST_ITEM = 8  # words; shorter items are searched word for word
BLOCK_WORDS = 2_000_000  # words of test items that one lookup table holds, about
SHARE = 0.5  # of the score of a perfect copy of the whole item
LONG = 40  # words; a perfect copy of as many is a leak of any item
_PLAIN = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment of two word sequences: score, then start and end in ``a`` and in ``b``.

    A match gives 2, a mismatch or a gap costs 1 per word.  Among equal scores the first end in ``a``
    and then in ``b`` wins.
    """
    def ends(x, y):
        best, at, row = 0, (0, 0), np.zeros(len(y) + 1, dtype=np.int64)
        ramp = np.arange(len(y) + 1)
        for i, w in enumerate(x):
            step = np.where(y == w, 2, -1)
            new = np.zeros_like(row)
            new[1:] = np.maximum(np.maximum(row[:-1] + step, row[1:] - 1), 0)
            # a gap along the row: the best earlier cell less its distance
            new = np.maximum.accumulate(new + ramp) - ramp
            k = int(new.argmax())
            if new[k] > best:
                best, at = int(new[k]), (i + 1, k)
            row = new
        return best, at

    score, (ea, eb) = ends(a, b)
    _, (ra, rb) = ends(a[:ea][::-1], b[:eb][::-1])
    return score, ea - ra, ea, eb - rb, eb


def _sequences(words: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hash of every 1, 2, .. ``most`` words in a row."""
    code = words
    for n in range(1, min(most, len(words)) + 1):
        if n > 1:
            code = code[:-1] * np.int64(0x100000001B3) + words[n - 1 :]
        yield code


@dataclass
class SeedIndex:
    """Words of the items of one block as numbers, and where each word pair stands.

    An alignment of score ``S`` with ``M`` matches has ``2 M - S`` edits at most.  They fall between
    neighbouring matches, so with two points for each pair of neighbours without an edit between and one
    for each with one edit it has ``2 (M - 1) - (2 M - S) = S - 2`` points or more, each place of the
    item counted once.  It spans ``3 M - S`` words of the text at most.  Stretches of a text with fewer
    points cannot hold a leak; all others are aligned, so no leak is lost.
    """

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    numbers: dict[bytes, int] = field(default_factory=dict)
    codes: np.ndarray | None = None  # sorted codes of the pairs
    first: np.ndarray | None = None  # place of each code's first entry below
    item: np.ndarray | None = None
    at: np.ndarray | None = None
    near: np.ndarray | None = None  # whether the pair's words are neighbours
    score: np.ndarray | None = None  # of each item: the least score of a leak,
    points: np.ndarray | None = None  # the points that a stretch of text must reach
    reach: np.ndarray | None = None  # and the most words of text under an alignment
    short: dict[int, dict[int, list]] = field(default_factory=dict)  # length: code: (id, words) of short items

    def add(self, item_id, text: str) -> None:
        words = np.array(
            [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], dtype=np.int64
        )
        if len(words) >= LEAST_ITEM:
            self.ids.append(item_id)
            self.words.append(words)
        elif len(words):
            *_, code = _sequences(words, len(words))
            self.short.setdefault(len(words), {}).setdefault(int(code[0]), []).append((item_id, words))

    def code(self, words: np.ndarray, step: int) -> np.ndarray:
        """Code of every pair of words ``step`` places apart, 0 if one is unknown."""
        a, b = words[:-step], words[step:]
        return np.where((a > 0) & (b > 0), a * np.int64(len(self.numbers) + 1) + b, 0)

    def build(self, frequency: np.ndarray | None) -> "SeedIndex":
        """Set the lookup table: all pairs, or those without the most frequent places of each item.

        ``frequency`` belongs to ``codes``.  A place is worth two points at most, so a stretch must reach
        what an alignment needs less two points for each place left out, wherever the places are.
        """
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.score = np.minimum(np.ceil(2 * SHARE * size), 2 * LONG).astype(np.int64)
        spared = (self.score - 2) // SPARE * (frequency is not None)
        self.points, self.reach = self.score - 2 - 2 * spared, 3 * size - self.score
        codes, items, places, near = [], [], [], []
        for k, words in enumerate(self.words):
            pairs = [self.code(words, step) for step in (1, 2)]
            kept = np.ones(len(words), dtype=bool)
            if frequency is not None:
                often = np.zeros(len(words), dtype=np.int64)
                for code in pairs:
                    often[: len(code)] += frequency[np.searchsorted(self.codes, code)]
                kept[np.argsort(-often[:-1], kind="stable")[: spared[k]]] = False
            for code, step in zip(pairs, (1, 2)):
                at = np.flatnonzero(kept[: len(code)])
                codes.append(code[at])
                items.append(np.full(len(at), k))
                places.append(at)
                near.append(np.full(len(at), step == 1))
        if not codes:
            codes = items = places = near = [np.empty(0, dtype=np.int64)]
        order = np.argsort(np.concatenate(codes), kind="stable")
        code = np.concatenate(codes)[order]
        self.item, self.at = np.concatenate(items)[order], np.concatenate(places)[order]
        self.near = np.concatenate(near)[order].astype(bool)
        self.codes, self.first = np.unique(code, return_index=True)
        return self

    def hits(self, words: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs in the text and the numbers of the codes that stand there."""
        code = self.code(words, step)
        if not len(code) or not len(self.codes):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.flatnonzero(code)
        k = np.searchsorted(self.codes, code[at])
        k[k == len(self.codes)] = 0
        same = self.codes[k] == code[at]
        return at[same], k[same]

    def number(self, text: str) -> np.ndarray:
        look = self.numbers.get
        return np.array([look(w, 0) for w in words_of(text)], dtype=np.int64)

    def regions(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(item, start, end)`` of the stretches of text with enough points, widened to whole alignments."""
        (a, ka), (b, kb) = self.hits(words, 1), self.hits(words, 2)
        k = np.r_[ka, kb]
        if not len(k):
            return
        counts = np.append(self.first[1:], len(self.item))[k] - self.first[k]
        entry = np.repeat(self.first[k] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        at, beside = np.repeat(np.r_[a, b], counts), np.repeat(np.arange(len(k)) < len(ka), counts)
        item, worth = self.item[entry], 1 + (beside & self.near[entry])
        # most items have too few points in the whole text
        some, group = np.unique(item, return_inverse=True)
        live = (np.bincount(group, worth) >= self.points[some])[group]
        if not live.any():
            return
        item, at, place, worth = item[live], at[live], self.at[entry[live]], worth[live]
        key = item * (len(words) + int(self.reach.max()) + 1) + at
        order = np.argsort(key, kind="stable")
        key, item, at, place, worth = key[order], item[order], at[order], place[order], worth[order]
        total, reach = np.r_[0, np.cumsum(worth)], self.reach[item]
        upto = np.searchsorted(key, key + reach, side="right")
        full = np.flatnonzero(total[upto] - total[:-1] >= self.points[item])
        if not len(full):
            return
        apart = (item[full[1:]] != item[full[:-1]]) | (at[full[1:]] - at[full[:-1]] > 2 * reach[full[1:]])
        starts = np.flatnonzero(np.r_[True, apart])
        for lo, hi in zip(full[starts], full[np.r_[starts[1:] - 1, len(full) - 1]]):
            it, r = int(item[lo]), int(reach[lo])
            most = np.zeros(len(self.words[it]), dtype=np.int64)
            np.maximum.at(most, place[lo : upto[hi]], worth[lo : upto[hi]])
            if most.sum() >= self.points[it]:
                yield it, max(0, int(at[lo]) - r), min(len(words), int(at[hi]) + r + 1)

    def leaks(self, text: str) -> list[tuple]:
        """``(item, share, start, end, item_start, item_end)`` of the best alignment per leaked item."""
        words = self.number(text)
        best: dict[int, tuple] = {}
        for it, start, end in self.regions(words):
            score, a0, a1, b0, b1 = smith_waterman(self.words[it], words[start:end])
            if score >= self.score[it] and score > best.get(it, (0,))[0]:
                best[it] = (score, start + b0, start + b1, a0, a1)
        out = [(self.ids[it], s / (2 * len(self.words[it])), *rest) for it, (s, *rest) in sorted(best.items())]
        return out + self.copies(words)

    def copies(self, words: np.ndarray) -> list[tuple]:
        """The same of the first copy of each short item."""
        out = []
        for n, code in enumerate(_sequences(words, max(self.short, default=0)), 1):
            known = self.short.get(n, {})
            found = np.flatnonzero(np.isin(code, np.fromiter(known, dtype=np.int64, count=len(known))))
            there: dict[int, list[int]] = {}
            for at in found.tolist():
                there.setdefault(int(code[at]), []).append(at)
            for c, places in there.items():
                for item_id, item in known[c]:
                    at = next((p for p in places if (words[p : p + n] == item).all()), None)
                    if at is not None:
                        out.append((item_id, 1.0, at, at + n, 0, n))
        return out


def _frequencies(docs: DataFrame, text_col: str, index: SeedIndex) -> np.ndarray:
    """How often each word pair of the block's items stands in all texts; bounded by the block."""

    def run(batches):
        total = np.zeros(len(index.codes), dtype=np.int64)
        for frame in batches:
            found = []
            for t in clean(frame["text"]):
                words = index.number(t)
                found += [index.hits(words, step)[1] for step in (1, 2)]
            if found:
                total += np.bincount(np.concatenate(found), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"code": index.codes[seen], "n": total[seen]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "code long, n long")
    out = np.zeros(len(index.codes), dtype=np.int64)
    for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[np.searchsorted(index.codes, r.code)] = r.n
    return out


def each_index(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text",
) -> Iterator[tuple[SeedIndex, bool]]:
    """Lookup tables of the test items, one for each block of about ``BLOCK_WORDS`` words, one at a time.

    With each comes whether it is the only one.

    The test set is a stated query set held against all documents block by block, so what is shipped
    to the tasks is bounded by the block.  Seeds are rare with regard to all documents.
    """
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("t")).dropna(subset=["t"])
    size = items.agg(F.sum(F.length("t") / 4)).first()[0] or 0.0
    blocks = int(size // BLOCK_WORDS) + 1
    for b in range(blocks):
        index = SeedIndex()
        block = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b)
        for r in sorted(block.distinct().collect(), key=lambda r: (r.id is None, r.id or 0, r.t)):
            index.add(r.id, r.t)
        index.build(None)
        if index.words:
            index.build(_frequencies(docs, text_col, index))
        if index.words or index.short:
            yield index, blocks == 1
        del index


def build_indexes(docs: DataFrame, benchmark: DataFrame, *args, **kwargs) -> list[SeedIndex]:
    """All lookup tables at once, for test sets known to be small."""
    return [index for index, _ in each_index(docs, benchmark, *args, **kwargs)]


def leaks(text: str | Column, indexes: list[SeedIndex]) -> Column:
    """Array of ``(item_id, score, start, end, item_start, item_end)``, word offsets, for each text.

    An item is leaked if its best local alignment reaches half the score of a perfect copy of the
    item, or that of a perfect copy of 40 words.  The score is the share of the perfect score.  Items
    under 8 words are leaked by an exact copy of their words only; items without text are not searched, those
    without an id are.  NULL and empty text leaks nothing.  Rows are judged
    one by one; other columns play no part.
    """
    names = ["item_id", "score", "start", "end", "item_start", "item_end"]
    kinds = ["long", "double", "long", "long", "long", "long"]

    @F.pandas_udf(", ".join(f"`{n}` array<{k}>" for n, k in zip(names, kinds)))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [[x for index in indexes for x in index.leaks(t)] for t in clean(texts)]
            yield pd.DataFrame({n: [[x[k] for x in r] for r in rows] for k, n in enumerate(names)})

    made = once(run)(F.col(text) if isinstance(text, str) else text)
    return F.arrays_zip(*[made[n].alias(n) for n in names])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document and test item that it leaks.

    The test set goes block by block; with several blocks the rows of each are stored, and its lookup
    table is dropped before the next is collected.
    """
    def rows(indexes):
        made = docs.select(F.col(id_col).alias("doc_id"), leaks(text_col, indexes).alias("l"))
        return made.select("doc_id", F.explode("l").alias("l")).select("doc_id", "l.*")

    out = None
    for index, only in each_index(docs, benchmark, text_col):
        found = rows([index]) if only else cut(rows([index]))
        out = found if out is None else out.unionByName(found)
        del index
    return rows([]) if out is None else out


def clean_of(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that leak no test item, block by block like ``contaminated``."""
    name, out = free_name(docs, "leaks_"), docs
    for index, only in each_index(docs, benchmark, text_col):
        out = out.withColumn(name, leaks(text_col, [index])).where(F.size(name) == 0).drop(name)
        out = out if only else cut(out)
        del index
    return out
