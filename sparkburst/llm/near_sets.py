"""Comparison of shingle sets within one task, in numpy.

Sets are sorted arrays of 64-bit hashes.  A parity sketch says of every bit
whether an odd number of shingles falls on it: two sketches differ in at most as
many bits as the sets differ in shingles.  A wide sketch folds to a narrow one by
exclusive or, so sets of different sizes compare at the narrower width.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the narrowest sketch, and the size of a set up to which each width serves (twice as wide each): at 0.6 bits a
#: shingle unrelated sets differ in 0.3 of them, where the thresholds of 0.8 and 0.85 allow 0.22 and 0.16.
SKETCH_BYTES = 64
_SERVES = 850
_WIDEST = SKETCH_BYTES << 6
#: Blocks of up to so many rows are compared by shifting the whole table against itself.
_SMALL = 16


def sketch(s: np.ndarray) -> bytes:
    width, serves = SKETCH_BYTES, _SERVES
    while len(s) > serves and width < _WIDEST:
        width, serves = width * 2, serves * 2
    bits = (s >> np.uint64(40)).astype(np.int64) & (8 * width - 1)
    return np.packbits((np.bincount(bits, minlength=8 * width) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, width: int = SKETCH_BYTES) -> np.ndarray:
    """The sketch at a narrower width, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=np.uint64).reshape(-1, width // 8), axis=0)


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


class Union:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def union(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class Postings:
    """Rows of the inverted index: ids, set sizes, places in the prefix, parts of split shingles, sketches (None passes)."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray, part: np.ndarray, sketches: list, percent: int):
        self.ids, self.n, self.at, self.part, self.sketches, self.percent = ids, n, at, part, sketches, percent
        self.blind = np.array([s is None for s in sketches], dtype=bool)
        narrow = b"\0" * SKETCH_BYTES
        if all(s is None or len(s) == SKETCH_BYTES for s in sketches):
            self.few = np.frombuffer(b"".join(s or narrow for s in sketches), dtype=np.uint64).reshape(-1, SKETCH_BYTES // 8)
        else:
            self.few = np.stack([folded(s or narrow) for s in sketches])
        self.wide = np.array([s is not None and len(s) > SKETCH_BYTES for s in sketches], dtype=bool)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j (numbers of rows of one shingle) can belong to sets at the threshold.

        A pair at the threshold passes at the first shingle that both prefixes
        hold: only what follows there, in either set, can still be common.
        """
        t = self.percent
        ni, nj = self.n[i], self.n[j]
        both = ni + nj
        ok = (100 * np.minimum(ni, nj) >= t * np.maximum(ni, nj)) & ((100 + t) * np.minimum(ni - self.at[i], nj - self.at[j]) >= t * both) & (self.ids[i] != self.ids[j])
        left = np.flatnonzero(ok)
        if len(left):
            a, b = np.broadcast_to(i, ok.shape)[left], np.broadcast_to(j, ok.shape)[left]
            limit = (100 - t) * both[left]
            seen = ~(self.blind[a] | self.blind[b])
            far = seen & ((100 + t) * bits_apart(self.few[a], self.few[b]) > limit)
            for k in np.flatnonzero(~far & self.wide[a] & self.wide[b]):
                x, y = self.sketches[a[k]], self.sketches[b[k]]
                width = min(len(x), len(y))
                far[k] = (100 + t) * bits_apart(folded(x, width), folded(y, width)) > limit[k]
            ok[left[far]] = False
        return ok


def forest(block: np.ndarray, rows: Postings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that connect all ids which some near pair connects: fewer pairs than ids.

    ``block`` numbers the rows' shingles, in order.  Rows of different parts
    pair only if ``part`` differs within the block, unless it is the same throughout.
    """
    ids, of = np.unique(rows.ids, return_inverse=True)
    joined, out = Union(len(ids)), []
    first = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
    size = np.repeat(np.diff(first), np.diff(first))

    def join(a: int, b: int) -> None:
        if joined.union(int(of[a]), int(of[b])):
            out.append((ids[of[a]], ids[of[b]]))

    for d in range(1, min(_SMALL, int(np.diff(first).max(initial=0)))):
        i = np.flatnonzero((block[d:] == block[:-d]) & (size[d:] <= _SMALL))
        for k in i[rows.near(i, i + d)]:
            join(int(k), int(k) + d)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a <= _SMALL:
            continue
        label = np.array([joined.find(int(x)) for x in of[a:b]])
        split = len(np.unique(rows.part[a:b])) > 1
        for x in range(1, b - a):
            j = np.flatnonzero(label[:x] != label[x])
            if split:
                j = j[rows.part[a + j] != rows.part[a + x]]
            j = j[rows.near(np.full(len(j), a + x), a + j)] if len(j) else j
            for y in j[np.unique(label[j], return_index=True)[1]]:
                join(int(a + x), int(a + y))
            if len(j):
                label[np.isin(label, label[j])] = label[x]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def linked(sets: list[np.ndarray], known: np.ndarray, percent: int) -> np.ndarray:
    """Labels of ``sets``: equal where links at the threshold, or equal ``known`` labels, connect them."""
    ns = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(ns, kind="stable")
    n, label = ns[order], known[order].copy()
    items = np.concatenate([sets[k] for k in order]) if len(sets) else np.zeros(0, dtype=np.uint64)
    first = np.concatenate(([0], np.cumsum(n)))
    few = np.stack([folded(sketch(sets[k])) for k in order]) if len(sets) else np.zeros((0, 8), dtype=np.uint64)

    def common(x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set x with others."""
        mine, sizes = items[first[x] : first[x + 1]], n[others]
        ends = np.cumsum(sizes)
        theirs = items[np.arange(ends[-1]) + np.repeat(first[others] - (ends - sizes), sizes)]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        return np.add.reduceat(hit.astype(np.int64), ends - sizes)

    for x in range(1, len(n)):
        lo = int(np.searchsorted(n, -(-percent * int(n[x]) // 100)))
        j = lo + np.flatnonzero(label[lo:x] != label[x])
        if not len(j):
            continue
        apart = bits_apart(few[j], few[x])
        possible = (100 + percent) * apart <= (100 - percent) * (n[j] + n[x])
        j = j[possible][np.argsort(apart[possible], kind="stable")]
        many = 1
        while len(j):  # of each label the likeliest ones first; a linked label needs no more of them
            rank = _rank(label[j])
            now = j[rank < many]
            hit = now[(100 + percent) * common(x, now) >= percent * (n[now] + n[x])]
            met = np.unique(label[hit])
            j = j[(rank >= many) & ~np.isin(label[j], met)]
            if len(met):
                label[np.isin(label, met)] = label[x]
            many *= 2
    out = np.empty(len(n), dtype=known.dtype)
    out[order] = label
    return out


def _rank(labels: np.ndarray) -> np.ndarray:
    """How many equal labels stand before each."""
    order = np.argsort(labels, kind="stable")
    held = labels[order]
    start = np.concatenate(([0], np.flatnonzero(held[1:] != held[:-1]) + 1))
    out = np.empty(len(labels), dtype=np.int64)
    out[order] = np.arange(len(labels)) - np.repeat(start, np.diff(np.append(start, len(labels))))
    return out

