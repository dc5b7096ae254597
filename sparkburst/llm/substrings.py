"""Exact substring dedup: bytes of long strings that start anywhere else are removed.

Every window of ``LENGTH`` bytes has an anchor, the least hashed k-mer in it;
equal windows have equal anchors, so windows need comparing only where their
anchors are equal.  Consecutive windows of one anchor form a segment.  Equal
segments collapse into one with its number; where different segments share an
anchor, their bytes go to that anchor's shard, which is suffix-sorted by external
induced sorting (see ``suffix_sort``): a window whose common prefix with a
neighbour in the suffix order is ``LENGTH`` bytes starts elsewhere too.  An anchor with very many
different segments is not gathered in one shard: its windows are counted one by
one, by digest.

Anchors have 64-bit hashes; segments and digests are only compared within an
anchor, so that 128 bits tell them apart.  So do a row's id and the hash of its
text, by which what is found is brought back to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import _INVERSE as INVERSE
from .arrow_text import buffers, chunks, mix, powers
from .suffix_sort import sorted_suffixes
from .tables import discard, small_batches, written

LENGTH = 200
#: Bytes of an anchor; a window has LENGTH - KMER + 1 of them.
KMER = 64
#: Bytes of a shard that is sorted at once, and memory of its queues, which hold 8 bytes for each of its bytes.
SHARD_BYTES = 2 << 20
QUEUE_MEMORY = 2 << 20
#: Different segments of an anchor that are sorted in one shard.
MOST_SEGMENTS = 10_000
#: What identifies a row.
KEY = ["doc", "key"]
#: Entries of all lists up to which a table of keyed lists is broadcast (some tens of bytes each).
BROADCAST_ENTRIES = 1_000_000


def _prefix(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums), INVERSE)[starts])


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys, by prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, anchor, digest of the bytes) of every segment."""
    if len(data) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = _prefix(data)
    n = len(data) - kmer + 1
    h = (sums[kmer:] - sums[:n]) * powers(len(data), INVERSE)[:n]
    h = mix(h)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    at = (_window_least(keys, length - kmer + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lens = np.diff(offsets)
    doc = np.repeat(np.arange(len(lens)), np.maximum(lens - length + 1, 0))
    skipped = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(np.maximum(lens - length + 1, 0))[:-1])), np.maximum(lens - length + 1, 0))
    window = np.arange(len(doc)) + skipped  # starts of all windows within documents
    at = at[window]
    if not len(window):
        return segments(data[:0], offsets)
    first = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1]) | (doc[1:] != doc[:-1])) + 1))
    count = np.diff(np.append(first, len(window)))
    start = window[first]
    return doc[first], start - offsets[doc[first]], count, h[at[first]], _hashes(sums, start, start + count + length - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _all_segments(texts: DataFrame, length: int, kmer: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy() for k in (0, 1))
            for lo, hi, data, offsets in chunks(batch.column(2)):
                doc, start, count, anchor, digest = segments(data, offsets, length, kmer)
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor), _signed(digest), pa.array(ids[lo:hi][doc]), pa.array(keys[lo:hi][doc]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["anchor", "digest", "doc", "key", "start", "windows"],
                )

    return texts.mapInArrow(run, "anchor long, digest long, doc long, key long, start int, windows int")


def _with_lists(texts: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """``texts`` with the lists of their keys; a small table is broadcast, a large one joined by a shuffle."""
    entries = lists.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0)).alias("n")).first()["n"]
    return texts.join(F.broadcast(lists) if entries <= BROADCAST_ENTRIES else lists, KEY, how)


def _merged(ranges: DataFrame) -> DataFrame:
    """(doc, key, runs): the maximal runs, as flat pairs of start and end, of each row's (start, end) ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for listed in batch.column(2):
                flat = listed.values.flatten()
                start, end = (x.to_numpy() for x in flat)
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                fresh = np.concatenate(([True], start[1:] > reach[:-1]))
                last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
                runs.append(np.stack((start[fresh], reach[last]), axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int32()))], names=["doc", "key", "runs"])

    listed = ranges.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("listed"))
    return listed.mapInArrow(run, "doc long, key long, runs array<int>")


def _cut(held: DataFrame, length: int) -> DataFrame:
    """(anchor, doc, key, start, bytes) of listed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                rows += [(s["anchor"], doc, key, s["start"], raw[s["start"] : s["start"] + s["windows"] + length - 1]) for s in listed]
            a, d, k, s, b = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.int32()), pa.array(b, pa.binary())], names=["anchor", "doc", "key", "start", "bytes"])

    return held.select(*KEY, "text", "listed").mapInArrow(run, "anchor long, doc long, key long, start int, bytes binary")


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, whether the window at each start is found at another start of any part: a suffix sort of them all."""
    text = np.frombuffer(b"\xff".join(parts), dtype=np.uint8)  # a byte that no UTF-8 text has
    order, common = sorted_suffixes(text, length, QUEUE_MEMORY)
    near = np.flatnonzero(common >= length)
    twice = np.zeros(len(text), dtype=bool)
    twice[order[near]] = twice[order[near - 1]] = True
    ends = np.cumsum([len(p) + 1 for p in parts])
    return [twice[e - len(p) - 1 : e - length] for e, p in zip(ends, parts, strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _sorted_shards(cut: DataFrame, length: int) -> DataFrame:
    """(doc, key, start, end) of repeated stretches, from the shards' suffix orders."""

    def judged(held: list[tuple]) -> list[tuple]:
        out = []
        for (doc, key, start, _), twice in zip(held, repeated_windows([h[3] for h in held], length), strict=True):
            lo, hi = _runs(twice)
            out += [(doc, key, start + int(a), start + int(b) + length - 1) for a, b in zip(lo, hi, strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            out = []
            for anchor, doc, key, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and size >= SHARD_BYTES:
                    out += judged(held)
                    held, size = [], 0
                held.append((doc, key, start, raw))
                size += len(raw) + 1
                last = anchor
            if out:
                yield _ranges(out)
        if held:
            yield _ranges(judged(held))

    return cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc long, key long, start int, end int")


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    d, k, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc", "key", "start", "end"])


def _counted_windows(cut: DataFrame, length: int) -> DataFrame:
    """(doc, key, start, end) of repeated windows of segments that share a very frequent anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, doc, key, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(raw, dtype=np.uint8)
                n = len(data) - length + 1
                at = np.arange(n)
                h = _hashes(_prefix(data), at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), _signed(h), pa.array(np.full(n, doc)), pa.array(np.full(n, key)), pa.array((at + start).astype(np.int32))], names=["anchor", "digest", "doc", "key", "start"])

    windows = written(cut.mapInArrow(run, "anchor long, digest long, doc long, key long, start int"), "windows")
    twice = windows.groupBy("anchor", "digest").agg(F.count("*").alias("m")).where("m > 1")
    return windows.join(twice, ["anchor", "digest"], "left_semi").select(*KEY, "start", (F.col("start") + length).alias("end"))


def repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> tuple[DataFrame, DataFrame]:
    """The keyed texts of ``docs``, and (doc, key, runs) of those with bytes to remove."""
    texts = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("key"))  # rows with equal keys are equal rows
    found = written(_all_segments(texts.select(*KEY, "text"), length, kmer), "segments")
    place = F.struct(*KEY, "start", "windows")
    distinct = found.groupBy("anchor", "digest").agg(F.count("*").alias("m"), F.min(place).alias("place"))
    of_anchor = distinct.groupBy("anchor").agg(F.sum("m").alias("total"), F.count("*").alias("kinds"))
    shared = written(distinct.join(of_anchor.where("total > 1"), "anchor"), "shared")
    span = lambda df: df.select(*KEY, "start", (F.col("start") + F.col("windows") + (length - 1)).cast("int").alias("end"))
    whole = span(found.join(shared.where("m > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi"))

    mixed = shared.where("kinds > 1").select("anchor", "kinds", "place.*")
    listed = mixed.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "start", "windows", (F.col("kinds") > MOST_SEGMENTS).alias("many"))).alias("listed"))
    held = _with_lists(texts.select(*KEY, "text"), written(listed, "listed"), "listed", "inner")
    part = lambda many: held.withColumn("listed", F.filter("listed", lambda s: s["many"] == many)).where(F.size("listed") > 0)
    partly = _sorted_shards(_cut(part(False), length), length)
    out = whole.unionByName(partly)
    if not shared.where(F.col("kinds") > MOST_SEGMENTS).isEmpty():
        out = out.unionByName(_counted_windows(_cut(part(True), length), length))
    runs = written(_merged(out), "runs")
    discard(found)
    return texts, runs


def remove(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of ``docs``.

    A byte goes if a ``length``-byte string that covers it also starts at another
    place of any document, the same one included; strings are judged on the input.
    A null text is empty.  A repeated row is another place, so equal long rows all
    lose their bytes; null ids are kept.  An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    texts, runs = repeats(docs, length, kmer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            out = []
            for d, (doc_id, listed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = data[offsets[d] : offsets[d + 1]]
                ends = (listed or [])[1::2]
                starts = (listed or [])[::2]
                kept = [raw[a:b].tobytes() for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)]
                removed = sum(ends) - sum(starts)
                left = b"".join(kept)
                out.append((doc_id, len(raw), removed, len(starts), hashlib.sha256(left).hexdigest(), left))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            cols = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    held = _with_lists(texts, runs, "runs", "left").select("doc_id", "text", "runs")
    return held.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
