"""Canonical Huffman codes of limited length, written and read by whole arrays.

A code is its lengths, one byte an id; codes of one length are numbered by id.
Bits are filled from the highest of each byte.  Each block starts on a byte, and
within one a checkpoint stands at every ``STEP`` ids, so that a reader decodes all
stretches between checkpoints side by side, one table look-up a step for each.
"""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints.
STEP = 256
#: Stretches that are decoded side by side, which bounds the arrays of a step.
LANES = 1 << 13


def code_lengths(counts: np.ndarray, longest: int = 16) -> np.ndarray:
    """Bits of each id (0: it does not occur) of the best code without a longer word than ``longest``, by package-merge."""
    present = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(present)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need more than {longest} bits")
    if n < 2:
        lengths[present] = 1
        return lengths
    order = present[np.argsort(counts[present], kind="stable")]
    leaves = counts[order].astype(np.float64) if counts.sum() < 1 << 52 else np.array([int(x) for x in counts[order]], dtype=object)
    merged, leaf_first = leaves, [np.ones(n, dtype=bool)]
    for _ in range(longest - 1):
        even = len(merged) // 2 * 2
        both = np.concatenate((leaves, merged[:even:2] + merged[1:even:2]))
        at = np.argsort(both, kind="stable")
        merged = both[at]
        leaf_first.append(at < n)
    taken = 2 * n - 2
    for is_leaf in reversed(leaf_first):
        k = int(is_leaf[:taken].sum())
        lengths[order[:k]] += 1
        taken = 2 * (taken - k)
    return lengths


def codewords(lengths: np.ndarray) -> np.ndarray:
    """The canonical word of each id, as a number of its length's bits."""
    words = np.zeros(len(lengths), dtype=np.uint32)
    word = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        words[ids] = word + np.arange(len(ids), dtype=np.uint32)
        word = (word + len(ids)) << 1
    return words


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(id << 8 | bits) for every number of the longest word's bits, and those bits."""
    longest = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    entries = np.repeat(order.astype(np.uint32) << np.uint32(8) | lengths[order], 1 << (longest - lengths[order].astype(np.int64)))
    table = np.zeros(1 << longest, dtype=np.uint32)
    table[: len(entries)] = entries
    return table, longest


def encode(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, and the bit offset of every ``STEP``-th of them."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    total = int(ends[-1]) if len(ends) else 0
    # 16 bits at most from any place in a word of 32: two words hold them, and sums of disjoint bits are exact
    word, shift = starts >> 5, (64 - (starts & 31) - bits).astype(np.uint64)
    shifted = words[ids].astype(np.uint64) << shift
    n = (total + 31) // 32 + 1
    out = np.bincount(word, weights=shifted >> np.uint64(32), minlength=n)
    out += np.bincount(word + 1, weights=shifted & np.uint64(0xFFFFFFFF), minlength=n)[:n]
    return out.astype(">u4").tobytes()[: (total + 7) // 8], starts[::STEP]


def decode(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, longest: int) -> np.ndarray:
    """The ids of all stretches (bit offset, number of ids, at most ``STEP``), one after the other."""
    data = np.concatenate((data, np.zeros(4, dtype=np.uint8)))
    out = []
    for lo in range(0, len(starts), LANES):
        n = counts[lo : lo + LANES]
        order = np.argsort(-n, kind="stable")
        left = n[order]
        at = starts[lo : lo + LANES][order].astype(np.int64)
        got = np.zeros((len(n), STEP), dtype=np.uint32)
        for step in range(int(left[0]) if len(left) else 0):
            open_ = int(np.searchsorted(-left, -step, side="left"))
            p = at[:open_]
            byte = p >> 3
            window = data[byte].astype(np.uint32) << np.uint32(16) | data[byte + 1].astype(np.uint32) << np.uint32(8) | data[byte + 2]
            entry = table[(window >> (24 - longest - (p & 7)).astype(np.uint32)) & np.uint32((1 << longest) - 1)]
            got[:open_, step] = entry >> np.uint32(8)
            at[:open_] += entry & np.uint32(255)
        back = np.empty_like(got)
        back[order] = got
        out.append(back[np.arange(STEP) < n[:, None]])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
