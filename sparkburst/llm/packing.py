"""Hierarchical multi-length packing of token sequences.

A document's tokens are cut into whole windows of the longest tier; its tail is
routed to the shortest tier that holds it.  Windows are packed from the longest
tail down; the gap that a tail leaves in its window is filled with the largest
tails that fit, of shorter tiers, and closed exactly by cutting one more tail.
Sequences are dealt to step groups of equal token totals, tier by tier: counts of
each task's sequences tell where its own begin in the whole order, so that only
the last group of a tier can be short.

Every task packs the documents of its own partition in buffers of bounded size:
no token is shuffled, no task sees more than one buffer, and a lost task is
simply run again on the same rows.  Only the last window of a task can be
padded.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .tables import small_batches, written

END_ID = 1
#: Bits of a sequence's number within its task.
_TASK_BITS = 32
TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 8 * 2048
#: Tails that a task holds before it packs them.
BUFFER = 2048
#: Texts with a longer run without white space, or of white space, go to the reference tokenizer.
_LONG_RUN = 5000

#: What a task writes; ``nth`` is the sequence's number among those of its task and tier.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)
_ARROW = pa.schema(
    [(n, pa.int32() if n == "tier" else pa.int64()) for n in SCHEMA.fieldNames()]
)


@cache
def _plain(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def _ranked(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def _has_long_run(raw: np.ndarray) -> bool:
    if len(raw) <= _LONG_RUN:
        return False
    change = np.flatnonzero(np.diff((raw == 32) | ((raw >= 9) & (raw <= 13))))
    edges = np.concatenate(([-1], change, [len(raw) - 1]))
    return bool(np.diff(edges).max() > _LONG_RUN)


def token_ids(text: str, vocabulary: str, special: str = "<|endoftext|>") -> np.ndarray:
    """Ids of ``text`` as the ``tokenizers`` library gives them, without added special tokens.

    The ranked encoder holds the same vocabulary and splits alike, only faster;
    texts in which the two could part (a special token's own string, extreme
    runs) take the plain path.
    """
    if special in text or _has_long_run(np.frombuffer(text.encode(), dtype=np.uint8)):
        ids = _plain(public_tokenizers.path(f"{vocabulary}.json")).encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4")
    return _ranked(public_tokenizers.path(f"{vocabulary}.tiktoken")).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


class Packer:
    """Packs the documents given to ``add`` one by one; ``out`` has a row for each piece."""

    def __init__(self, first_sequence: int = 0, tiers: tuple[int, ...] = TIERS, buffer: int = BUFFER):
        self.tiers, self.buffer = tuple(sorted(tiers)), buffer
        self.first, self.sequences, self.count = first_sequence, 0, 0
        self.in_tier: dict[int, int] = {}
        self.tails: list[tuple] = []  # (length, order, doc_id, start, doc_tokens, ids), sorted
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, top, start = len(ids), self.tiers[-1], 0
        while n - start >= top:
            self._emit([(top, 0, doc_id, start, n, ids[start : start + top])], top)
            start += top
        if start < n:
            self._hold(doc_id, start, n, ids[start:].copy())
        if len(self.tails) >= self.buffer:
            self._pack(last=False)

    def close(self) -> None:
        self._pack(last=True)

    def _hold(self, doc_id, start, n, ids) -> None:
        self.count += 1
        insort(self.tails, (len(ids), self.count, doc_id, start, n, ids), key=lambda x: x[:2])

    def _tier(self, length: int) -> int:
        return next(t for t in self.tiers if t >= length)

    def _pack(self, last: bool) -> None:
        while self.tails:
            window = [self.tails.pop()]
            tier = self._tier(window[0][0])
            gap = tier - window[0][0]
            while gap and self.tails:
                k = bisect_right(self.tails, gap, key=lambda x: x[0])
                if k:
                    window.append(self.tails.pop(k - 1))
                else:
                    window.append(self._cut(self.tails.pop(0), gap))
                gap -= window[-1][0]
            if not gap:
                self._emit(window, tier)
            elif last:
                self._rest(window)
            else:
                for _, _, doc_id, start, n, ids in window:
                    self._hold(doc_id, start, n, ids)
                return

    def _cut(self, tail: tuple, at: int) -> tuple:
        """The first ``at`` tokens of a tail; the others are held again."""
        _, order, doc_id, start, n, ids = tail
        self._hold(doc_id, start + at, n, ids[at:])
        return at, order, doc_id, start, n, ids[:at]

    def _rest(self, window: list[tuple]) -> None:
        """The last tokens: whole windows of ever shorter tiers, then one that is padded."""
        left = sum(x[0] for x in window)
        for tier in reversed(self.tiers):
            if left < tier:
                continue
            taken, need = [], tier
            while need:
                x = window.pop(0)
                if x[0] > need:
                    _, order, doc_id, start, n, ids = x
                    window.insert(0, (x[0] - need, order, doc_id, start + need, n, ids[need:]))
                    x = (need, order, doc_id, start, n, ids[:need])
                taken.append(x)
                need -= x[0]
            self._emit(taken, tier)
            left -= tier
        if window:
            self._emit(window, self.tiers[-1])

    def _emit(self, window: list[tuple], tier: int) -> None:
        sequence = self.first + self.sequences
        self.sequences += 1
        nth = self.in_tier.get(tier, 0)
        self.in_tier[tier] = nth + 1
        offset = 0
        for length, _, doc_id, start, n, ids in window:
            self.out.append((doc_id, start, length, zlib.crc32(ids.tobytes()), n, sequence, offset, tier, nth))
            offset += length


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece of each document: ``SCHEMA``'s columns with ``step_group`` in place of ``nth``.

    A step group has ``step_tokens`` tokens in sequences of one tier, the last of a tier fewer.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.  A null
    or empty text is the end id alone.  Rows are packed one by one, so repeated
    rows and null ids give pieces of their own; rows that share a doc_id are told
    apart by their sequences only.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << _TASK_BITS, tiers)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py() or "", vocabulary)
                packer.add(doc_id, np.append(ids, np.array([END_ID], dtype="<u4")))
            if packer.out:
                yield _batch(packer.out)
                packer.out.clear()
        packer.close()
        if packer.out:
            yield _batch(packer.out)

    texts = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    pieces = written(texts.mapInArrow(run, SCHEMA), "pieces")
    task = F.shiftright("sequence_id", _TASK_BITS)
    counts = pieces.groupBy(task.alias("task"), "tier").agg((F.max("nth") + 1).alias("n"))
    earlier = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "tier", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # a row for each task and tier
    size = F.create_map(*[F.lit(x) for t in tiers for x in (t, max(1, step_tokens // t))])
    place = F.create_map(*[F.lit(x) for k, t in enumerate(sorted(tiers)) for x in (t, k)])
    group = F.floor((F.col("before") + F.col("nth")) / F.element_at(size, F.col("tier"))) * len(tiers) + F.element_at(place, F.col("tier"))
    joined = pieces.withColumn("task", task).join(starts, ["task", "tier"])
    return joined.select(*[c for c in SCHEMA.fieldNames() if c != "nth"], group.cast("long").alias("step_group"))
