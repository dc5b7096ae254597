"""Suffix sorting of a byte shard by external, recursive induced sorting, with common-prefix values.

Suffixes are L or S by the next different symbol.  The left-most S suffixes (LMS)
are sorted first: a first induction sorts their substrings, equal ones share a
name, and the string of names is sorted by the same method, recursively, until
all names differ.  A second induction then sorts all suffixes from the LMS ones.

Induction pops one symbol's suffixes at a time and pushes their predecessors to
the queues of the symbols that those start with.  Entries are pushed in the order
of the suffixes they come from, so that a queue of one symbol is always sorted
and the queues together are a priority queue.  Entries are tuples of a suffix and
the common prefix with the entry before it in its queue: one more than the least
common prefix of the suffixes between the two that pushed them.  Queues hold
blocks of entries and move them to a file when they take more than their share of
memory.
"""

from __future__ import annotations

import tempfile

import numpy as np

_BIG = np.int32(1 << 30)
#: Entries a symbol from which blocks of them are worth array operations.
_FEW = 64


class Queues:
    """First-in-first-out queues of (suffix, common prefix) blocks by symbol, on disk beyond ``memory`` bytes."""

    def __init__(self, memory: int):
        self.memory, self.held, self.spilled = memory, 0, 0
        self.blocks: dict[int, list] = {}
        self.file = None

    def push(self, symbol: int, entries: np.ndarray) -> None:
        self.blocks.setdefault(symbol, []).append(entries)
        self.held += entries.nbytes
        if self.held > self.memory:
            self._spill()

    def pop(self, symbol: int) -> np.ndarray:
        """The entries of a symbol, one row each: suffix and common prefix."""
        blocks = self.blocks.pop(symbol, ())
        if not blocks:
            return np.zeros((0, 2), dtype=np.int32)
        return np.concatenate([self._load(b) for b in blocks]) if len(blocks) > 1 else self._load(blocks[0])

    def _load(self, block) -> np.ndarray:
        if isinstance(block, np.ndarray):
            self.held -= block.nbytes
            return block
        at, n = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), dtype=np.int32).reshape(-1, 2)

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for blocks in self.blocks.values():
            for k, b in enumerate(blocks):
                if isinstance(b, np.ndarray):
                    at = self.file.tell()
                    self.file.write(b.tobytes())
                    blocks[k] = (at, len(b))
                    self.spilled += b.nbytes
        self.held = 0

    def close(self) -> None:
        if self.file:
            self.file.close()


def _is_s(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; the end counts as smaller than any symbol, so the last one is L."""
    ends = np.concatenate((np.flatnonzero(text[1:] != text[:-1]), [len(text) - 1]))  # last places of runs
    lens = np.diff(np.concatenate(([-1], ends)))
    up = np.zeros(len(ends), dtype=bool)
    up[:-1] = text[ends[:-1] + 1] > text[ends[:-1]]
    return np.repeat(up, lens)


class _Stream:
    """Suffixes in the order they are met, and the pushes of their predecessors with common prefixes."""

    def __init__(self, text: np.ndarray, memory: int, cap: int, symbols: int):
        self.text, self.cap = text, cap
        self.queues = Queues(memory)
        # the least common prefix met since each symbol's last push; without a cap none is kept
        self.least = np.full(symbols, _BIG, dtype=np.int32) if cap else None

    def take(self, suffixes: np.ndarray, common: np.ndarray, pushed: np.ndarray) -> None:
        """Meets ``suffixes``; the predecessors of those that ``pushed`` marks go to their queues."""
        at = np.flatnonzero(pushed)
        before = suffixes[at] - 1
        symbol = self.text[before]
        if len(at) > 1:
            order = np.argsort(symbol, kind="stable")
            at, before, symbol = at[order], before[order], symbol[order]
            cuts = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(at)]))
        else:
            cuts = np.array([0, len(at)] if len(at) else [0])
        entries = np.empty((len(at), 2), dtype=np.int32)
        entries[:, 0] = before
        if self.cap:
            tails = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = at[a:b]
                least = np.minimum.reduceat(common[: here[-1] + 1], np.concatenate(([0], here[:-1] + 1)))
                c = int(symbol[a])
                least[0] = min(least[0], self.least[c])
                entries[a:b, 1] = np.minimum(least + 1, self.cap)
                tails.append((c, common[here[-1] + 1 :].min(initial=_BIG)))
            np.minimum(self.least, common.min(initial=_BIG), out=self.least)
            for c, tail in tails:
                self.least[c] = tail
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.queues.push(int(symbol[a]), entries[a:b])


def _pair(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """Common prefix of two suffixes, ``cap`` at most."""
    n = min(cap, len(text) - max(a, b))
    apart = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(apart[0]) if len(apart) else n


def induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, common: np.ndarray | None, cap: int, memory: int) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order and, with a ``cap``, the common prefix of each with the one before it, from the LMS ones and theirs."""
    n = len(text)
    every = np.unique(text)
    if not cap and n < _FEW * len(every):
        return _induce_names(text, is_s, lms), None
    cut = np.searchsorted(text[lms], np.append(every, every[-1] + 1)) if len(lms) else np.zeros(len(every) + 1, dtype=np.int64)
    none = np.zeros(n, dtype=np.int32) if not cap else None
    smaller, larger = (_Stream(text, memory // 2, cap, int(every[-1]) + 1) for _ in range(2))
    ls: list[np.ndarray] = []
    smaller.queues.push(int(text[n - 1]), np.array([[n - 1, 0]], dtype=np.int32))  # the last suffix follows the empty one
    for k, c in enumerate(every.tolist()):
        found: list[np.ndarray] = []
        while len(now := smaller.queues.pop(c)):
            if cap and not found:
                now = now.copy()
                now[0, 1] = 0  # before it are other symbols
            found.append(now)
            i = now[:, 0]
            smaller.take(i, now[:, 1], (i > 0) & (text[i - 1] >= c))
        left = np.concatenate(found) if len(found) > 1 else found[0] if found else np.zeros((0, 2), dtype=np.int32)
        ls.append(left)
        seeds = lms[cut[k] : cut[k + 1]]
        if len(seeds):
            theirs = common[cut[k] : cut[k + 1]].copy() if cap else none[: len(seeds)]
            if cap:
                theirs[0] = _pair(text, int(left[-1, 0]), int(seeds[0]), cap) if len(left) else 0
            smaller.take(seeds, theirs, np.ones(len(seeds), dtype=bool))  # before an LMS suffix stands an L one
    smaller.queues.close()
    out, lcp = np.empty(n, dtype=np.int32), np.zeros(n + 1, dtype=np.int32) if cap else None
    at = n
    for k in range(len(every) - 1, -1, -1):
        c, first, last = int(every[k]), True, None
        while len(now := larger.queues.pop(c)):  # from the right
            i, shared = now[:, 0], now[:, 1]
            if cap and first:
                shared = shared.copy()
                shared[0] = 0
            out[at - len(i) : at] = i[::-1]
            if cap:
                lcp[at - len(i) + 1 : at + 1] = shared[::-1]
            at, first, last = at - len(i), False, int(i[-1])
            larger.take(i, shared, (i > 0) & (text[i - 1] <= c))
        left = ls[k]
        if not len(left):
            continue
        i = left[::-1, 0]
        shared = none[: len(i)] if not cap else np.concatenate(([_pair(text, int(i[0]), last, cap) if last is not None else 0], left[:0:-1, 1])).astype(np.int32)
        out[at - len(i) : at] = left[:, 0]
        if cap:
            lcp[at - len(i) + 1 : at + 1] = shared[::-1]
        at -= len(i)
        larger.take(i, shared, (i > 0) & is_s[i - 1])
    larger.queues.close()
    return out, lcp[:n] if cap else None


def _induce_names(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same without common prefixes for strings of many symbols: the queues are stretches of one array, entries are pushed one by one."""
    n = len(text)
    ends = np.cumsum(np.bincount(text))
    symbols, rising, order = text.tolist(), is_s.tolist(), [-1] * n
    tail = (ends - 1).tolist()
    for i in lms[::-1].tolist():
        c = symbols[i]
        order[tail[c]] = i
        tail[c] -= 1
    head = np.concatenate(([0], ends[:-1])).tolist()
    c = symbols[n - 1]
    order[head[c]] = n - 1
    head[c] += 1
    for i in order:  # pushes are always ahead of the place that is read
        if i > 0 and not rising[i - 1]:
            c = symbols[i - 1]
            order[head[c]] = i - 1
            head[c] += 1
    found = np.array(order)
    found[is_s[found] & (found >= 0)] = -1
    order = found.tolist()
    tail = (ends - 1).tolist()
    for k in range(n - 1, -1, -1):
        i = order[k]
        if i > 0 and rising[i - 1]:
            c = symbols[i - 1]
            order[tail[c]] = i - 1
            tail[c] -= 1
    return np.array(order, dtype=np.int32)


def _named(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A name for each LMS suffix, in text order: equal for equal LMS substrings, and in their order."""
    n = len(text)
    nth = np.full(n, -1, dtype=np.int32)
    nth[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, n)  # a substring ends with the next one's first symbol
    k = nth[ordered]
    length = ends[k] - lms[k]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = (length[1:] == length[:-1]) & (ends[k[1:]] < n) & (ends[k[:-1]] < n)
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        a, b = ordered[open_] + step, ordered[open_ - 1] + step
        equal = text[a] == text[b]
        same[open_[~equal]] = False
        step += 1
        open_ = open_[equal & (length[open_] > step)]
    names = np.empty(len(k), dtype=np.int32)
    names[k] = np.cumsum(~same) - 1
    return names


def _prefixes(text: np.ndarray, ordered: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each of some sorted suffixes with the one before it, ``cap`` at most."""
    out = np.zeros(len(ordered), dtype=np.int32)
    open_ = np.arange(1, len(ordered))
    step = 0
    while len(open_) and step < cap:
        a, b = ordered[open_] + step, ordered[open_ - 1] + step
        inside = np.maximum(a, b) < len(text)
        open_, a, b = open_[inside], a[inside], b[inside]
        open_ = open_[text[a] == text[b]]
        step += 1
        out[open_] = step
    return out


def sorted_suffixes(text: np.ndarray, cap: int = 0, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray | None]:
    """Starts of the suffixes of ``text`` in order and, with a ``cap``, the common prefix of each with the one before it up to it.

    ``memory`` bounds the bytes that the queues keep; what is beyond goes to a file.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.int32) if cap else None
    is_s = _is_s(text)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        rough, _ = induce(text, is_s, lms[np.argsort(text[lms], kind="stable")], None, 0, memory)
        flag = np.zeros(n, dtype=bool)
        flag[lms] = True
        names = _named(text, lms, rough[flag[rough]])
        # names that all differ are in order already
        order = np.argsort(names) if int(names.max()) + 1 == len(names) else sorted_suffixes(names, 0, memory)[0]
        lms = lms[order]
    return induce(text, is_s, lms, _prefixes(text, lms, cap) if cap else None, cap, memory)


def suffix_order(text: np.ndarray, memory: int = 64 << 20) -> np.ndarray:
    return sorted_suffixes(text, 0, memory)[0]
