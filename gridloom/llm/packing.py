"""Hierarchical packing of token streams into windows of several context sizes."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import clean

TIERS = (512, 1024, 2048, 4096)  # context sizes, each a power of two and half the next
STEP_TOKENS = 32768  # tokens of one training step group
END_ID = 2  # closes every document
BLOCK_TOKENS = 2_000_000  # tokens that wait for partners at a time
CACHE_WORDS = 250_000  # words at hand, up to half of them from before the last turnover
TEXTS = 512  # texts encoded at a time
MERGED = 4096  # words that go to the merges at a time
LINE_BREAK = "\u010a"  # the letter that spells its byte

# white space that only Python splits on, a letter whose lower case hangs on its neighbours,
# and the beginning of special tokens
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")
_ID = attrgetter("id")
_TAIL = re.compile(r"(\w+)([^\w\s']+)")
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

# kinds of UTF-8 bytes; a word with an odd one is not cut into groups by its bytes: an apostrophe may
# begin a contraction, control characters are spelled otherwise, and only the characters up to U+024F
# are letters by their first byte (but for two)
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
_KINDS = np.full(256, ODD, dtype=np.uint8)
_KINDS[:128] = [LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK for b in range(128)]
_KINDS[:32] = _KINDS[127] = ODD
_KINDS[list(b"\t\n\v\f\r ")] = SPACE
_KINDS[ord("'")] = ODD
_KINDS[0x80:0xC0] = _KINDS[0xC3:0xCA] = LETTER  # U+00C0 to U+024F, and what follows any first byte


def _strings(data: np.ndarray, starts: np.ndarray) -> tuple[list[str], pa.Array]:
    """The different strings that stand in ``data`` one behind the other, and which of them stand there."""
    if not len(starts):
        return [], pa.array([], type=pa.int32())
    ends = np.append(starts, len(data)).astype(np.int64)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(data)]
    found = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
    names = pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary)
    return pc.binary_join(names, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n"), found.indices


def _joined(ids: list[bytes], which: pa.Array, firsts: np.ndarray) -> list[bytes]:
    """The ids named by ``which`` in a row, cut before each place of ``firsts``."""
    laid = pa.array(ids, type=pa.large_binary()).take(which)
    _, ends, raw = laid.buffers()
    cuts = np.frombuffer(ends, dtype=np.int64)[np.append(firsts, len(laid))].tolist()
    raw = raw.to_pybytes() if raw else b""
    return [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])]


class WordEncoder:
    """Ids of a lower-casing, white-space-splitting tokenizer, looked up word by word.

    Such a tokenizer treats every white-space-separated word alone, so the ids of a text are
    the ids of its words in a row; within a word it treats letters, digits and marks alone.  Texts and
    words for which that might not hold go through the tokenizer as they are.

    The words of many texts are cut and told apart by Arrow, so only their different words are looked up.
    Words met since the last turnover are at hand, and those of the turnover before: words that
    come again stay, the many that stand in one text only go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 4096):
            some = texts[lo : lo + 4096]
            for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                out.append(np.array(e.ids, dtype="<u4").tobytes())
        return out

    def _groups(self, words: list[str]) -> None:
        """Learn words that are one group each, printed ASCII or letters: they go straight to the merges."""
        printed = [w for w in words if w.isascii()]
        others = [w for w in words if not w.isascii()]
        spelled = printed
        if others:  # spelled together: a line break is none of their bytes
            spelled = printed + self.as_bytes.pre_tokenize_str("\n".join(others))[0][0].split(LINE_BREAK)
        words = printed + others
        for lo in range(0, len(words), MERGED):
            tokens = list(map(self.tokenizer.model.tokenize, spelled[lo : lo + MERGED]))
            ids = np.fromiter(map(_ID, chain.from_iterable(tokens)), dtype="<u4").tobytes()
            ends = [0, *accumulate(map(len, tokens))]
            self.known.update(
                (w, ids[4 * a : 4 * b]) for w, a, b in zip(words[lo : lo + MERGED], ends, ends[1:])
            )

    def _learn(self, words: list[str]) -> None:
        data = np.frombuffer("\n".join(words).encode(), dtype=np.uint8)
        kind = _KINDS[data]
        sign = np.flatnonzero(data[:-1] == 0xC3)  # of U+00D7 and U+00F7, the two that are no letters
        kind[sign[np.isin(data[sign + 1], (0x97, 0xB7))]] = ODD
        breaks = np.flatnonzero(kind == SPACE)
        odd = np.zeros(len(words), dtype=bool)
        odd[np.searchsorted(breaks, np.flatnonzero(kind == ODD))] = True
        inside = ~np.repeat(odd, np.diff(breaks, prepend=-1, append=len(data)))[: len(data)]
        begins = np.append(0, breaks + 1)[~odd]
        new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        starts = np.flatnonzero(new & inside & (kind != SPACE))
        firsts = np.searchsorted(starts, begins)
        inside &= kind != SPACE
        places = np.cumsum(inside)[starts] - 1
        names, which = _strings(data[inside], places)
        single = set(names).difference(self.known)
        # of other words, trailing marks are a group of their own behind letters
        split, direct = [], []
        for k in np.flatnonzero(odd).tolist():
            w = words[k]
            m = None if w.isalpha() else _TAIL.fullmatch(w)
            if m and m[1].isalpha() and m[2].isascii() and m[2].isprintable():
                split.append((w, *m.groups()))
                single.update(x for x in m.groups() if x not in self.known)
            elif w.isalpha():
                single.add(w)
            else:
                direct.append(w)
        self._groups(list(single))
        self.known.update(zip(direct, self._direct(direct)))
        for w, body, tail in split:
            self.known[w] = self.known[body] + self.known[tail]
        plain = [w for w, o in zip(words, odd.tolist()) if not o]
        self.known.update(zip(plain, _joined([self.known[g] for g in names], which, firsts)))

    def _lookup(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-case texts."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        begins = np.cumsum([0] + [len(t) + 1 for t in raw])[:-1]
        inside = _KINDS[data] != SPACE
        starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
        names, which = _strings(data[inside], np.cumsum(inside)[starts] - 1)
        ids = list(map(self.known.get, names))
        absent = [k for k, x in enumerate(ids) if x is None]
        learn = []
        for k in absent:
            w = names[k]
            if x := self.older.get(w):
                self.known[w] = ids[k] = x
            else:
                learn.append(k)
        if learn:
            self._learn([names[k] for k in learn])
            for k in learn:
                ids[k] = self.known[names[k]]
        return _joined(ids, which, np.searchsorted(starts, begins))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        if 2 * len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        out: list = [None] * len(texts)
        whole, split, lower = [], [], []
        for k, t in enumerate(texts):
            odd = any(c in t for c in _WHOLE)
            if odd or not (t.isascii() or unicodedata.is_normalized("NFC", t)):
                whole.append(k)
                continue
            capital = "İ" in t  # its lower case is two characters
            t = t.lower()
            if capital and not unicodedata.is_normalized("NFC", t):
                whole.append(k)
                continue
            if not t.isascii() and any(c in t for c in _WIDE):
                t = " ".join(t.split())
            split.append(k)
            lower.append(t)
        for k, ids in zip(split, self._lookup(lower)):
            out[k] = ids
        for k, ids in zip(whole, self._direct([texts[k] for k in whole])):
            out[k] = ids
        return out


class Packer:
    """Fills windows from pieces ``(length, document, start)``; all windows but the last are full.

    Every document gives as many of the longest windows as it fills; the rest is routed to
    the smallest context that holds it.  Contexts are packed from the longest down: a window takes
    its own piece, then the longest pieces of shorter contexts that still fit, and a last gap is
    closed by cutting one.
    """

    def __init__(self):
        self.pools: dict[int, list[tuple]] = {t: [] for t in TIERS}

    def route(self, piece: tuple) -> None:
        insort(self.pools[next(t for t in TIERS if piece[0] <= t)], piece)

    def _fit(self, gap: int) -> tuple | None:
        for tier in reversed(TIERS):
            if tier < 2 * gap or tier == TIERS[0] or tier // 2 < gap:
                pool = self.pools[tier]
                k = bisect_right(pool, (gap, float("inf")))
                if k:
                    return pool.pop(k - 1)
        return None

    def _cut(self, gap: int) -> tuple | None:
        for tier in TIERS:
            if self.pools[tier]:
                length, doc, start = self.pools[tier].pop(0)
                self.route((length - gap, doc, start + gap))
                return (gap, doc, start)
        return None

    def pack(self, pieces: list[tuple], last: bool) -> Iterator[tuple[int, list[tuple]]]:
        """Windows ``(context, pieces)``; what cannot fill one waits unless this is the last call."""
        top = TIERS[-1]
        short: list[tuple] = []
        for length, doc, start in pieces:
            while length >= top:
                yield top, [(top, doc, start)]
                length, start = length - top, start + top
            if length:
                short.append((length, doc, start))
        for piece in short:
            self.pools[next(t for t in TIERS if piece[0] <= t)].append(piece)
        for pool in self.pools.values():
            pool.sort()
        open_: list[tuple] = []
        for tier in reversed(TIERS):
            pool = self.pools[tier]
            while pool:
                window = [pool.pop()]
                gap = tier - window[0][0]
                while gap:
                    piece = self._fit(gap) or self._cut(gap)
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    open_ = window
                else:
                    yield tier, window
        if open_ and last:
            yield next(t for t in TIERS if sum(p[0] for p in open_) <= t), open_
        elif open_:
            for piece in open_:
                self.route(piece)


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "`offset` long, context int, step_group long"
)


def pack_documents(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack whole documents into windows of 512 to 4096 tokens, one row per piece.

    Each input partition is encoded and packed as it streams by, a bounded block of tokens at
    a time; nothing is shuffled, and a rerun task packs its partition the same way.  Only the last
    window of a partition can be short.  Windows of one context fill step groups of 32768
    tokens in order, so that every step group but the last of its context and partition
    holds the same number of tokens and of windows.  A sequence id is the partition number
    times 2**40 plus the window's number; a step group likewise, with the context's place (0 to
    3) in bits 36 and up.

    NULL and empty text is the closing id alone.  NULL ids stay NULL, beside ids of any size.  A text of
    any length is encoded whole and cut into as many windows as it fills.  Repeated rows are packed
    each on its own.  Empty input gives no rows; other columns are ignored.
    """

    def run(batches):
        kinds = {}
        for c in SCHEMA.split(", "):
            name, kind = c.split()
            kinds[name.strip("`")] = pa.int64() if kind == "long" else pa.int32()
        encode, packer = WordEncoder(tokenizer), Packer()
        part = TaskContext.get().partitionId()
        held: dict[int, tuple] = {}  # documents with pieces that wait
        fresh: list[tuple] = []
        numbers = {"seen": 0, "window": 0, **dict.fromkeys(TIERS, 0)}

        def flush(last):
            rows, waiting = [], {}
            for context, pieces in packer.pack(fresh, last):
                step = numbers[context] * context // STEP_TOKENS
                group = (part << 40) + (TIERS.index(context) << 36) + step
                at = 0
                for length, doc, start in pieces:
                    doc_id, ids = held[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append((
                        doc_id, start, length, crc, len(ids) // 4,
                        (part << 40) + numbers["window"], at, context, group,
                    ))
                    at += length
                numbers[context] += 1
                numbers["window"] += 1
            fresh.clear()
            for pool in packer.pools.values():
                for _, doc, _ in pool:
                    waiting[doc] = held[doc]
            held.clear()
            held.update(waiting)
            cols = zip(*rows) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(cols, kinds.values())], names=list(kinds)
            )

        tokens = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                for at in range(0, some.num_rows, TEXTS):  # few at a time leave the batch
                    few = some.slice(at, TEXTS)
                    ids_of = encode(clean(few.column("text").to_pylist()))
                    for doc_id, ids in zip(few.column("doc_id").to_pylist(), ids_of):
                        ids += END_ID.to_bytes(4, "little")
                        number = numbers["seen"]
                        numbers["seen"] += 1
                        held[number] = (doc_id, ids)
                        fresh.append((len(ids) // 4, number, 0))
                        tokens += len(ids) // 4
                if tokens >= BLOCK_TOKENS:
                    yield flush(False)
                    tokens = 0
        yield flush(True)

    # by Arrow: whole batches of texts need no second copy as Python strings
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, SCHEMA)
