"""Benchmark decontamination by BM25 retrieval with block-max WAND.

Test items form an inverted index: posting lists of BM25 weights by term, cut at
blocks of consecutive items, with the greatest weight of each list in each block.
Every document is a query of its distinct terms.  An item's weights are divided by
its threshold, so that one threshold, 1, holds for all.

Blocks whose greatest weights do not add up to the threshold are skipped, for a
whole batch of documents at once.  In the others WAND walks the posting lists: the
pivot is the first item at which the greatest weights of the lists up to it reach
the threshold; lists before it skip to it, and only where all of them meet is an
item scored.  A block of a few dozen items is scored in one array operation, which
costs less than the first step of a walk.  What scores at least the threshold is verified by the overlap of
word shingles with the whole document's, so that words put between an item's parts
do not hide it, wherever they stand.  The overlaps of its question and its answer
are reported beside it.

The threshold of an item is the least score that a document with enough of its
shingles can have, so retrieval loses no leak: with u shingles missing at most u
words of the item are uncovered, and the u heaviest are left out of the sum.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import chunks, shingle_hashes, span_hashes, word_bounds
from .tables import small_batches, written

SHINGLE = 5
SIMILARITY = 0.8
#: The last part of an item is its answer, what comes before its question.
ANSWER_SHARE = 0.25
K1, B = 1.2, 0.75
#: Bytes of test items in one index; a larger benchmark is indexed and queried slice by slice.
SLICE_BYTES = 16 << 20
_ITEMS_IN_BLOCK = 8
_MOST_BLOCKS = 64
#: Items of a block up to which it is scored whole.
_WHOLE = 64
_LONGEST_FIRST_CLASS = 64
#: What a sum of weights, and of weights in single precision, may fall short by.
_SLACK, _ROUNDED = 1e-9, 1e-4

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
_APART = np.ones(256, dtype=bool)
_APART[0x80:] = _APART[0x30:0x3A] = _APART[0x41:0x5B] = _APART[0x61:0x7B] = False


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = word_bounds(data, offsets, _APART)
    return span_hashes(data, starts, ends), bounds


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    return shingle_hashes(words, np.array([0, len(words)]), size)[0]


@dataclass
class Item:
    item_id: int
    size: int  # words of a shingle: fewer than SHINGLE only if the item has fewer
    shingles: np.ndarray
    answer_from: int
    terms: np.ndarray
    weights: np.ndarray  # over the item's threshold

    def overlap(self, words: np.ndarray, held: dict[int, np.ndarray]) -> tuple[float, float, float]:
        """Shares of the shingles found in a document's words: of the item, its question and its answer.

        ``held`` keeps the document's sorted shingles by their size.
        """
        if len(words) < self.size:
            return 0.0, 0.0, 0.0
        if self.size not in held:
            held[self.size] = np.unique(_shingles(words, self.size))
        have = held[self.size]
        found = have[np.minimum(np.searchsorted(have, self.shingles), len(have) - 1)] == self.shingles
        parts = found[: self.answer_from], found[self.answer_from :]
        return float(found.mean()), *(float(x.mean()) if len(x) else 1.0 for x in parts)


class Index:
    """The inverted index of items of similar length."""

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: dict[int, float], mean: float, similarity: float):
        self.vocabulary = np.unique(np.concatenate([w for _, w in items]))
        self.items: list[Item] = []
        for item_id, words in items:
            size = min(SHINGLE, len(words))
            shingles = _shingles(words, size)
            terms, tf = np.unique(words, return_counts=True)
            weights = np.array([idf[t] for t in terms.tolist()]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            missing = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9))
            least = np.sort(weights)[: max(1, len(weights) - missing)].sum()
            at = np.searchsorted(self.vocabulary, terms)
            answer = max(1, round(ANSWER_SHARE * len(shingles)))
            self.items.append(Item(item_id, size, shingles, len(shingles) - answer, at, weights / least))
        # posting lists one after the other, each in the order of its items; blocks are runs of so many items
        self.block = max(_ITEMS_IN_BLOCK, -(-len(items) // _MOST_BLOCKS))
        term = np.concatenate([i.terms for i in self.items])
        of = np.repeat(np.arange(len(self.items)), [len(i.terms) for i in self.items])
        order = np.lexsort((of, term))
        term, self.of, self.weights = term[order], of[order], np.concatenate([i.weights for i in self.items])[order]
        self.lists = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.maxima = np.zeros((len(self.vocabulary), -(-len(items) // self.block)), dtype=np.float32)
        np.maximum.at(self.maxima, (term, self.of // self.block), self.weights.astype(np.float32))
        # the same postings block by block, where blocks are scored whole
        order = np.argsort(self.of // self.block, kind="stable") if self.block <= _WHOLE else []
        cuts = np.searchsorted(self.of[order] // self.block, np.arange(self.maxima.shape[1] + 1)) if len(order) else [0]
        self.postings = [(term[order[a:b]], self.of[order[a:b]] - k * self.block, self.weights[order[a:b]]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        self.held = np.zeros(len(self.vocabulary), dtype=bool)
        bits = max(12, int(len(self.vocabulary) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.vocabulary >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.deepest = int(np.diff(self.first).max())

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, -1 if it has none: a table of the leading bits, then a few steps."""
        out = np.full(len(words), -1, dtype=np.int64)
        at, end = self.first[(words >> self.shift)], self.first[(words >> self.shift) + np.uint64(1)]
        open_ = np.flatnonzero(at < end)
        for step in range(self.deepest):
            k = at[open_] + step
            hit = self.vocabulary[np.minimum(k, len(self.vocabulary) - 1)] == words[open_]
            out[open_[hit]] = k[hit]
            open_ = open_[~hit & (k + 1 < end[open_])]
            if not len(open_):
                break
        return out

    def retrieve(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, float, Item]]:
        """(document, score over threshold, item) of all that reach an item's threshold, document by document."""
        term = self.lookup(words)
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return
        doc = np.searchsorted(bounds, known, side="right") - 1
        keys = np.unique(doc * len(self.vocabulary) + term[known])
        at, terms = keys // len(self.vocabulary), keys % len(self.vocabulary)
        used, starts = np.unique(at, return_index=True)
        ends = np.append(starts[1:], len(terms))
        bound = np.add.reduceat(self.maxima[terms], starts, axis=0) >= 1 - _ROUNDED
        for k in np.flatnonzero(bound.any(axis=1)):
            mine = terms[starts[k] : ends[k]]
            for b in np.flatnonzero(bound[k]):
                for item, score in self.whole(mine, int(b)) if self.block <= _WHOLE else self.walk(mine, int(b)):
                    yield int(used[k]), score, self.items[item]

    def whole(self, terms: np.ndarray, block: int) -> Iterator[tuple[int, float]]:
        """What ``walk`` gives, by scoring every item of the block."""
        at_terms, items, weights = self.postings[block]
        self.held[terms] = True
        scores = np.bincount(items, weights * self.held[at_terms], minlength=self.block)
        self.held[terms] = False
        for i in np.flatnonzero(scores >= 1 - _SLACK):
            yield block * self.block + int(i), float(scores[i])

    def walk(self, terms: np.ndarray, block: int) -> Iterator[tuple[int, float]]:
        """(item, score) of every item of a block that the terms score at least 1 for."""
        cursors = []
        for t in terms[self.maxima[terms, block] > 0].tolist():
            a, b = self.lists[t], self.lists[t + 1]
            lo, hi = np.searchsorted(self.of[a:b], (block * self.block, (block + 1) * self.block)) + a
            cursors.append(_Cursor(self.of[lo:hi].tolist(), self.weights[lo:hi].tolist()))
        while cursors:
            cursors.sort(key=_Cursor.item)
            bound, pivot = 0.0, None
            for x in cursors:
                bound += x.greatest
                if bound >= 1 - _SLACK:
                    pivot = x.now
                    break
            if pivot is None:
                return
            if cursors[0].now == pivot:
                here = [x for x in cursors if x.now == pivot]
                score = sum(x.weight() for x in here)
                if score >= 1 - _SLACK:
                    yield pivot, score
                for x in here:
                    x.seek(pivot + 1)
            else:
                for x in cursors:
                    if x.now < pivot:
                        x.seek(pivot)
            cursors = [x for x in cursors if x.now is not None]


class _Cursor:
    """A place in a posting list of one block."""

    __slots__ = ("at", "greatest", "items", "now", "weights")

    def __init__(self, items: list[int], weights: list[float]):
        self.items, self.weights, self.greatest = items, weights, max(weights)
        self.at, self.now = 0, items[0]

    def item(self) -> int:
        return self.now

    def weight(self) -> float:
        return self.weights[self.at]

    def seek(self, item: int) -> None:
        """To the first posting of ``item`` or a later one; ``now`` is None behind the last."""
        self.at = bisect_left(self.items, item, self.at)
        self.now = self.items[self.at] if self.at < len(self.items) else None


class Benchmark:
    """The indexes of some test items, one for each class of lengths."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY, statistics: tuple[int, float, dict[int, int]] | None = None):
        """``statistics`` of the whole benchmark, if the rows are a slice of it: items, their mean length, items by term."""
        self.similarity = similarity
        items = []
        for _, _, data, offsets in chunks(_lowered(pa.array([t for _, t in rows], pa.large_string()))):
            words, bounds = _words(data, offsets)
            items += [words[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
        items = [(i, w) for (i, _), w in zip(rows, items, strict=True) if len(w)]
        if statistics is None:
            df: dict[int, int] = {}
            for _, w in items:
                for t in np.unique(w).tolist():
                    df[t] = df.get(t, 0) + 1
            statistics = len(items), float(np.mean([len(w) for _, w in items])) if items else 1.0, df
        total, mean, df = statistics
        idf = {t: float(np.log(1 + (total - n + 0.5) / (n + 0.5))) for t, n in df.items()}
        classes: dict[int, list] = {}
        for item in items:
            classes.setdefault(max(_LONGEST_FIRST_CLASS, 1 << (len(item[1]) - 1).bit_length()), []).append(item)
        self.indexes = [Index(sorted(x, key=lambda i: len(i[1])), idf, mean, similarity) for _, x in sorted(classes.items())]

    def search(self, column: pa.Array) -> list[dict[int, tuple]]:
        """For each text its leaks: item_id to (score, overlap, question's, answer's), of items with one id the best one's."""
        out: list[dict[int, tuple]] = [{} for _ in range(len(column))]
        for lo, _, data, offsets in chunks(_lowered(column)):
            words, bounds = _words(data, offsets)
            for index in self.indexes:
                last, held = -1, {}
                for d, score, item in index.retrieve(words, bounds):
                    if d != last:
                        last, held = d, {}
                    got = item.overlap(words[bounds[d] : bounds[d + 1]], held)
                    if got[0] >= self.similarity - 1e-9:
                        best = out[lo + d].get(item.item_id)
                        if best is None or (got, score) > (best[1:], best[0]):
                            out[lo + d][item.item_id] = (score, *got)
        return out


def _terms_of(items: DataFrame) -> DataFrame:
    """(part, term, size): each item's distinct terms, and once an item, with a null term, its length in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(_lowered(batch.column(1))):
                words, bounds = _words(data, offsets)
                parts = batch.column(0).to_pylist()[lo:hi]
                rows = []
                for part, a, b in zip(parts, bounds[:-1], bounds[1:], strict=True):
                    if a < b:
                        rows += [(part, None, int(b - a)), *((part, t, None) for t in np.unique(words[a:b]).view(np.int64).tolist())]
                p, t, n = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int64())], names=["part", "term", "size"])

    return small_batches(items).mapInArrow(run, "part long, term long, size long")


def _slices(benchmark: DataFrame, similarity: float) -> list[Broadcast]:
    """Indexes of the benchmark's slices, each of a bounded size, as broadcast variables.

    Weights and thresholds are those of the whole benchmark, whatever the slices:
    its statistics are counted by tasks, and of a slice's terms alone they come
    along with it.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // SLICE_BYTES))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n)))
    send = benchmark.sparkSession.sparkContext.broadcast
    rows = lambda k: [(r[0], r[1]) for r in items.where(F.col("part") == k).orderBy("item_id", "text").select("item_id", "text").collect()]
    if n == 1:
        return [send(Benchmark(rows(0), similarity))]
    terms = written(_terms_of(items.select("part", "text")), "terms")
    total = terms.where("term is null").agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    counted = written(terms.where("term is not null").groupBy("term").agg(F.count("*").alias("n")), "counted")
    out = []
    for k in range(n):
        mine = terms.where((F.col("part") == k) & F.col("term").isNotNull()).select("term").distinct().join(counted, "term")
        df = {r["term"] & ((1 << 64) - 1): r["n"] for r in mine.collect()}  # as many as a slice has terms
        out.append(send(Benchmark(rows(k), similarity, (total["n"], total["mean"] or 1.0, df))))
    return out


LEAKS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("score", "overlap", "question_overlap", "answer_overlap")]
)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document and test item whose text leaks into it (see ``LEAKS``).

    ``score`` is the document's BM25 score over the item's threshold.  Null and
    empty texts leak nothing; items with a null id or text, or without a word,
    are not searched for.  Rows are judged one by one, so repeated rows and null
    doc_ids report their own leaks.  Either table may be empty: then no row is
    returned.  Columns other than doc_id, item_id and text are not read.
    """

    def finder(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.search(batch.column(1))
                ids = batch.column(0).to_pylist()
                rows = [(i, item, *got) for i, hits in zip(ids, found, strict=True) for item, got in sorted(hits.items())]
                yield pa.RecordBatch.from_pylist([dict(zip(LEAKS.fieldNames(), r, strict=True)) for r in rows], schema=_arrow(LEAKS))

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in _slices(benchmark, similarity):
        found = small_batches(texts).mapInArrow(finder(shared), LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64()) for f in schema])


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, into which no test item leaks."""

    def keeper(shared: Broadcast):
        @F.arrow_udf("boolean")
        def untouched(text: pa.Array) -> pa.Array:
            return pa.array([not hits for hits in shared.value.search(text)], pa.bool_())

        return untouched

    for shared in _slices(benchmark, similarity):
        docs = small_batches(docs).where(keeper(shared)(F.col("text").cast("string")))
    return docs
