"""Token counts under a unigram model, by dynamic programming over a trie.

Texts are cut into pre-tokens: a word with the one space before it; every other
white-space byte is a token of its own.  A batch's distinct pre-tokens are
inserted in a trie, level by level, so that the forward score of a prefix (the
best segmentation of it) is computed once for all pre-tokens that share it.
Terminal nodes give the counts, which a task remembers for its later batches.
Where few pre-tokens are still open, each is carried on to its end by itself, in
Python's whole numbers, so that pre-tokens of any length are counted exactly.

The public vocabularies hold no unigram model, so a piece's rank stands for its
frequency: p is in proportion to 1 / (rank + 2).  Scores are whole numbers, and
of segmentations with the same score the one with fewer tokens counts; results
do not depend on the order of additions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import IS_SPACE, chunks, mix, powers, word_bounds
from .arrow_text import _INVERSE as INVERSE
from .tables import small_batches

#: Open pre-tokens from which a level of the trie is worth its array operations.
FEW = 64
#: Nats are counted in thousandths.
SCALE = 1000
#: A value is score * TOKENS - tokens; a prefix in the trie has fewer tokens than this.
TOKENS = 1 << 20
#: Pre-tokens that a task remembers.
REMEMBERED = 1 << 20
_CHUNK = 1 << 19


def vocabulary(name: str = "piece_bpe_32k.model") -> list[tuple[bytes, int]]:
    """(piece, score) of a public vocabulary; the space mark is a space.  Single bytes come last, at the cost of an unknown one."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = np.log((1 / np.arange(2, len(plain) + 2)).sum())
    pieces = {}
    for rank, i in enumerate(plain):
        pieces.setdefault(model.id_to_piece(i).replace("▁", " ").encode(), round(SCALE * float(-np.log(rank + 2) - total)))
    unknown = min(pieces.values()) - 10 * SCALE
    for b in range(256):
        pieces.setdefault(bytes([b]), unknown)
    return list(pieces.items())


class Counter:
    """Counts tokens of batches of texts; remembers the counts of pre-tokens between batches."""

    def __init__(self, pieces: list[tuple[bytes, int]]):
        raw = np.frombuffer(b"".join(p for p, _ in pieces), dtype=np.uint8)
        lens = np.array([len(p) for p, _ in pieces])
        ends = np.cumsum(lens)
        hashes = _spans(_sums(raw), ends - lens, ends)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.array([s for _, s in pieces], dtype=np.int64)[order] * TOKENS - 1
        self.lengths = np.unique(lens).tolist()
        self.pieces = dict(pieces)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.known, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        pre, tokens = np.zeros(len(column), dtype=np.int64), np.zeros(len(column), dtype=np.int64)
        for lo, hi, data, offsets in chunks(column, _CHUNK):
            starts, ends, _ = word_bounds(data, offsets)
            blank = np.cumsum(np.concatenate(([0], IS_SPACE[data])))
            spaces = blank[offsets[1:]] - blank[offsets[:-1]]
            opens = np.zeros(len(data) + 1, dtype=bool)
            opens[offsets[:-1]] = True
            lead = (starts > 0) & ~opens[starts] & (data[np.maximum(starts - 1, 0)] == 0x20) if len(starts) else starts.astype(bool)
            starts = starts - lead
            bounds = np.searchsorted(starts, offsets)
            spaces = spaces - np.diff(np.concatenate(([0], np.cumsum(lead)))[bounds])
            each = self._spans(data, starts, ends)
            total = np.concatenate(([0], np.cumsum(each)))[bounds]
            pre[lo:hi] = np.diff(bounds) + spaces
            tokens[lo:hi] = np.diff(total) + spaces
        return pre, tokens

    def _spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        sums = _sums(data)
        distinct, first, back = np.unique(_spans(sums, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        old = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), dtype=bool)
        counts = np.zeros(len(distinct), dtype=np.int64)
        counts[old] = self.counts[at[old]]
        new = np.flatnonzero(~old)
        counts[new] = self._trie(data, sums, starts[first[new]], (ends - starts)[first[new]])
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.counts = distinct, counts
        else:
            known = np.concatenate((self.known, distinct[new]))
            order = np.argsort(known, kind="stable")
            self.known, self.counts = known[order], np.concatenate((self.counts, counts[new]))[order]
        return counts[back]

    def _trie(self, data: np.ndarray, sums: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tokens of each distinct span."""
        out = np.zeros(len(starts), dtype=np.int64)
        if not len(starts):
            return out
        word = np.argsort(-lens, kind="stable")  # the longest first, so that the open ones are a prefix
        starts, lens = starts[word], lens[word]
        node = np.zeros(len(starts), dtype=np.int64)
        value = np.zeros(1, dtype=np.int64)  # of the current level's nodes
        # of the last levels: each word's node, and the nodes' values
        levels: deque[tuple[np.ndarray, np.ndarray]] = deque([(node, value)], maxlen=max(self.lengths))
        for d in range(1, int(lens[0]) + 1):
            n = int(np.searchsorted(-lens, -d, side="right"))
            if (n <= FEW and d > levels.maxlen) or d >= TOKENS:
                for k in range(n):
                    last = [int(values[nodes[k]]) for nodes, values in levels]
                    out[word[k]] = self._rest(data[starts[k] : starts[k] + lens[k]].tobytes(), d - 1, last)
                break
            keys, rep, back = np.unique((node[:n] << 8) | data[starts[:n] + d - 1], return_index=True, return_inverse=True)
            best = np.full(len(keys), np.iinfo(np.int64).min)
            end = starts[rep] + d
            for size in self.lengths:
                if size > len(levels):
                    break
                h = _spans(sums, end - size, end)
                hit = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
                same = self.hashes[at] == h[hit]
                hit, at = hit[same], at[same]
                nodes, values = levels[-size]
                best[hit] = np.maximum(best[hit], values[nodes[rep[hit]]] + self.values[at])
            node = back
            levels.append((node, best))
            done = int(np.searchsorted(-lens, -d, side="left"))
            out[word[done:n]] = -best[back[done:n]] % TOKENS
        return out


    def _rest(self, text: bytes, at: int, last: list[int]) -> int:
        """Tokens of ``text``, of whose prefixes up to ``at`` bytes the last ones' values are known."""
        base = 1 << 64
        # -v is -score * TOKENS + tokens
        best = deque((-((-v) // TOKENS) * base - (-v) % TOKENS for v in last), maxlen=max(self.lengths))
        for end in range(at + 1, len(text) + 1):
            best.append(max(best[-size] + self.pieces[text[end - size : end]] * base - 1 for size in self.lengths if size <= len(best) and text[end - size : end] in self.pieces))
        return -best[-1] % base


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=sums[1:])
    return sums


def _spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums), INVERSE)[starts])


@cache
def _counter(name: str) -> Counter:
    return Counter(vocabulary(name))


def count(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row of ``docs`` (doc_id, text).

    A null or empty text has none.  Rows are counted one by one: null and
    repeated ids stay.  An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pre, tokens = _counter(name).texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pre), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
