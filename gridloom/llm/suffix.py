"""Suffix order of one shard by external induced sorting, with common-prefix values.

The shard's bytes lie in a file; pending suffixes wait in priority queues that move to disk when
they outgrow their memory.  A queue orders suffix tuples by their first symbol and, within a
symbol, by arrival, which for induced suffixes is their rank.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 17  # suffixes taken from a queue at a time
MEMORY = 192 << 20  # bytes of waiting suffixes before a queue moves to disk
END, BREAK, SHIFT = 0, 1, 2  # symbols: end of the shard, end of a string, first byte value
_LOG = np.frexp(np.arange(1, BLOCK + 2))[1] - 1  # floor of the binary logarithm of 1, 2, ..


class SymbolQueue:
    """Monotone priority queue of ``(position, common prefix)`` tuples by symbol, backed by files."""

    def __init__(self, folder: str, name: str, memory: int = MEMORY):
        self.base, self.memory, self.held = os.path.join(folder, name), memory, 0
        self.parts: list[list] = [[] for _ in range(256)]
        self.stored: list[list[int]] = [[] for _ in range(256)]  # lengths of parts on disk
        self.read = [0] * 256

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[symbol].append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for symbol, parts in enumerate(self.parts):
            if parts:
                at, lcp = (np.concatenate(x) for x in zip(*parts))
                with open(f"{self.base}-{symbol}.at", "ab") as f:
                    at.tofile(f)
                with open(f"{self.base}-{symbol}.lcp", "ab") as f:
                    lcp.tofile(f)
                self.stored[symbol].append(len(at))
                self.parts[symbol] = []
        self.held = 0

    def _load(self, symbol: int, lo: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        return (
            np.fromfile(f"{self.base}-{symbol}.at", np.int64, n, offset=8 * lo),
            np.fromfile(f"{self.base}-{symbol}.lcp", np.uint16, n, offset=2 * lo),
        )

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks in order of arrival, also of tuples pushed meanwhile."""
        while True:
            total = sum(self.stored[symbol])
            if self.read[symbol] < total:
                n = min(BLOCK, total - self.read[symbol])
                block = self._load(symbol, self.read[symbol], n)
                self.read[symbol] += n
                yield block
            elif self.parts[symbol]:
                at, lcp = (np.concatenate(x) for x in zip(*self.parts[symbol]))
                self.parts[symbol] = []
                self.held -= at.nbytes + lcp.nbytes
                for lo in range(0, len(at), BLOCK):
                    yield at[lo : lo + BLOCK], lcp[lo : lo + BLOCK]
            else:
                return

    def take_back(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the last tuple to the first, each block reversed."""
        for at, lcp in reversed(self.parts[symbol]):
            for hi in range(len(at), 0, -BLOCK):
                lo = max(0, hi - BLOCK)
                yield at[lo:hi][::-1], lcp[lo:hi][::-1]
        hi = sum(self.stored[symbol])
        while hi:
            n = min(BLOCK, hi)
            hi -= n
            at, lcp = self._load(symbol, hi, n)
            yield at[::-1], lcp[::-1]


class Inducer:
    """Passes the order of the left-most S-suffixes on to all suffixes of ``text``.

    ``text`` holds symbols, ends with ``END`` and is followed by ``cap + 8`` spare zeros.  Common
    prefixes are capped at ``cap``: suffixes that agree so far may come in any order.
    """

    def __init__(self, text: np.ndarray, cap: int, folder: str, memory: int = MEMORY):
        self.text, self.cap, self.folder, self.memory = text, cap, folder, memory
        self.size, self.runs = len(text) - cap - 8, 0
        t = text[: self.size]
        # S: the next different symbol is larger; the end is S
        change = np.flatnonzero(t[1:] != t[:-1])
        rises = t[change + 1] > t[change]
        s = np.repeat(rises, np.diff(np.r_[-1, change]))
        s = np.r_[s, np.zeros(self.size - 1 - len(s), dtype=bool), True]
        self.lms = np.zeros(self.size, dtype=bool)
        self.lms[1:] = s[1:] & ~s[:-1]

    def _run(self, at: int) -> int:
        c, n = self.text[at], 1
        while n < self.cap and at + n < self.size and self.text[at + n] == c:
            n += 1
        return n

    def _push(self, queue: SymbolQueue, carry: np.ndarray, at: np.ndarray, lcp: np.ndarray,
              before: np.ndarray, take: np.ndarray) -> None:
        """Queue the predecessors of the suffixes in ``take`` under their symbol ``before``.

        The common prefix of two predecessors is one more than the least one on the way between the
        suffixes; ``carry`` holds that least value since the last push of each symbol.
        """
        index = np.flatnonzero(take)
        order = np.argsort(before[index], kind="stable")
        e = index[order]
        g = before[e]
        low = np.minimum.accumulate(lcp)
        rest = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], np.uint16(self.cap)]
        if len(e):
            first = np.r_[True, g[1:] != g[:-1]]
            least = np.empty(len(e), dtype=np.uint16)
            least[first] = np.minimum(carry[g[first]], low[e[first]])
            later = np.flatnonzero(~first)
            if len(later):
                lo, hi = e[later - 1] + 1, e[later]
                level = _LOG[hi - lo]
                table, width = lcp, 1
                for k in range(int(level.max()) + 1):
                    if k:
                        table = np.minimum(table[:-width], table[width:])
                        width *= 2
                    now = level == k
                    least[later[now]] = np.minimum(table[lo[now]], table[hi[now] - width + 1])
            value = np.minimum(least + 1, self.cap).astype(np.uint16)
            starts = np.flatnonzero(first)
            ends = np.r_[starts[1:], len(e)]
            np.minimum(carry, low[-1], out=carry)
            carry[g[starts]] = rest[e[ends - 1] + 1]
            source = at[e] - 1
            for lo, hi in zip(starts, ends):
                queue.push(int(g[lo]), source[lo:hi], value[lo:hi])
        else:
            np.minimum(carry, low[-1], out=carry)

    def run(self, lms: np.ndarray, lms_lcp: np.ndarray, emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Induce from left-most S-suffixes in order, with their common prefixes.

        ``emit`` gets all suffixes but the end's, from the largest down, with the common prefix to the
        one before.
        """
        text, kinds = self.text, text_symbols(self.text[lms])
        self.runs += 1
        larger, done, smaller = (
            SymbolQueue(self.folder, f"{name}{self.runs}", self.memory) for name in "lds"
        )
        carry = np.zeros(256, dtype=np.uint16)
        for c in range(256):
            last = None
            for at, lcp in larger.take(c):
                if last is None:
                    lcp = lcp.copy()
                    lcp[0] = 0
                last = at[-1]
                done.push(c, at, lcp)
                before = text[at - 1]
                self._push(larger, carry, at, lcp, before, (at > 0) & (before >= c))
            lo, hi = kinds[c], kinds[c + 1]
            for k in range(lo, hi, BLOCK):
                at, lcp = lms[k : min(hi, k + BLOCK)], lms_lcp[k : min(hi, k + BLOCK)]
                if k == lo:
                    lcp = lcp.copy()
                    lcp[0] = 0 if last is None else min(self._run(last), self._run(at[0]))
                before = text[at - 1]
                self._push(larger, carry, at, lcp, before, at > 0)
        carry[:] = 0
        for c in range(255, -1, -1):
            last = None
            for at, lcp in smaller.take(c):
                if last is None:
                    lcp = lcp.copy()
                    lcp[0] = 0
                last = at[-1]
                emit(at, lcp)
                before = text[at - 1]
                self._push(smaller, carry, at, lcp, before, (at > 0) & (before <= c))
            follow = None  # a tuple's common prefix belongs to the step after it when going down
            for at, up in done.take_back(c):
                if follow is None:
                    follow = 0 if last is None else min(self._run(last), self._run(at[0]))
                lcp = np.r_[np.uint16(follow), up[:-1]].astype(np.uint16)
                follow = up[-1]
                emit(at, lcp)
                before = text[at - 1]
                self._push(smaller, carry, at, lcp, before, (at > 0) & (before < c))


def text_symbols(sorted_symbols: np.ndarray) -> np.ndarray:
    """Where each symbol's stretch begins in a sorted array of symbols."""
    return np.searchsorted(sorted_symbols, np.arange(257))


def rank_names(names: np.ndarray, steps: int) -> np.ndarray:
    """Order of the suffixes of a string of names, which agree on ``steps`` names at most.

    The reduced string is sorted by doubling: each round compares twice as many names, and only
    suffixes that still share a rank take part.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    head = np.r_[True, names[order][1:] != names[order][:-1]]
    h = 1
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = start
    while h < steps:
        tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(tied):
            break
        p = order[tied]
        own, after = rank[p], rank[np.minimum(p + h, n)]
        by = np.lexsort((after, own))
        p, own, after = p[by], own[by], after[by]
        order[tied] = p
        fresh = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        head[tied] = fresh
        rank[p] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Capped common prefix of suffix pairs, eight symbols at a step."""
    words = np.lib.stride_tricks.as_strided(text[:8].view(np.uint64), (len(text) - 7,), (1,))
    out = np.full(len(a), cap, dtype=np.uint16)
    live, depth = np.arange(len(a)), 0
    last = len(text) - 8
    while len(live) and depth < cap:
        x = words[np.minimum(a[live] + depth, last)] ^ words[np.minimum(b[live] + depth, last)]
        differ = x != 0
        low = x[differ]
        same = (np.log2((low & (~low + np.uint64(1))).astype(float)) // 8).astype(np.int64)
        out[live[differ]] = np.minimum(depth + same, cap)
        live = live[~differ]
        depth += 8
    return out


def repeated_starts(text: np.ndarray, cap: int, folder: str, memory: int = MEMORY) -> np.ndarray:
    """Whether the ``cap`` symbols from each position stand at another position as well."""
    inducer = Inducer(text, cap, folder, memory)
    size = inducer.size
    lms = np.flatnonzero(inducer.lms)
    # first induction: left-most S-suffixes by their first symbol only sorts their substrings
    by = lms[np.argsort(text[lms], kind="stable")]
    chain: dict = {"at": [], "lcp": [], "low": cap}

    def names_of(at, lcp):
        hit = np.flatnonzero(inducer.lms[at])
        if len(hit):
            least = np.minimum.reduceat(lcp[: hit[-1] + 1], np.r_[0, hit[:-1] + 1])
            least[0] = min(int(least[0]), chain["low"])
            chain["at"].append(at[hit])
            chain["lcp"].append(least)
            tail = lcp[hit[-1] + 1 :]
            chain["low"] = int(tail.min()) if len(tail) else cap
        else:
            chain["low"] = min(chain["low"], int(lcp.min()))

    inducer.run(by, np.ones(len(by), dtype=np.uint16), names_of)
    at = np.concatenate([*chain["at"], [size - 1]])
    lcp = np.concatenate([*chain["lcp"], [0]]).astype(np.int64)
    at, lcp = at[::-1], np.r_[0, lcp[::-1][:-1]]
    length = np.diff(np.r_[lms, size])
    slot = np.searchsorted(lms, at)
    whole = np.minimum(length[slot] + 1, cap)  # the substring and the first symbol of the next one
    equal = (lcp >= whole) & (lcp >= np.r_[cap, whole[:-1]])
    names = np.empty(len(lms), dtype=np.int64)
    names[slot] = np.cumsum(~equal)
    order = lms[rank_names(names, cap // 2 + 1)]
    prefix = np.zeros(len(order), dtype=np.uint16)
    prefix[1:] = common_prefixes(text, order[:-1], order[1:], cap)
    out = np.zeros(size, dtype=bool)
    edge = {"at": 0}

    def flag(at, lcp):
        full = lcp >= cap
        out[at[full]] = True
        out[np.r_[edge["at"], at[:-1]][full]] = True
        edge["at"] = at[-1]

    inducer.run(order, prefix, flag)
    return out
