"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed 3- and 4-byte subwords; a
linear softmax gives the language.  Embeddings and weights are trained in numpy
by stochastic gradient descent on a bounded sample of labelled rows; a
temperature is fitted on a held-back part of the sample.  Prediction reads every
whole text.

Rejection is calibrated by leaving out each language in turn: a model of the
others scores the left-out language's texts, which it must refuse, and the
held-back texts of its own languages, which it must not.  The threshold lies
midway between what nearly all of the former reach and nearly all of the latter
exceed; where these overlap, the latter decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import chunks
from .tables import small_batches, unused

UNKNOWN = "und"
#: Rows the model is fitted on, for each language, on average.
SAMPLE_PER_LANGUAGE = 400
#: Languages of a model at most; more labels than this are refused, not sampled.
MOST_LANGUAGES = 500
BUCKETS = 1 << 15
_CHUNK = 1 << 18

#: Bytes of letters stay; ASCII bytes that are none become a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _padded(column: pa.Array) -> pa.Array:
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    space = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(space, column, space, pa.scalar("", pa.large_string()))


def subwords(data: np.ndarray, buckets: int = BUCKETS) -> list[np.ndarray]:
    """For sizes 3 and 4, the bucket of the subword that starts at each byte, ``buckets`` where none does."""
    b = _FOLD[data].astype(np.uint32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out = []
    for size, salt in ((3, 2654435761), (4, 2246822519)):
        n = max(0, len(b) - size + 1)
        code = np.zeros(n, dtype=np.uint32)
        whole = np.ones(n, dtype=bool)
        for k in range(size):
            part = b[k : n + k]
            code = (code << np.uint32(8)) | part
            if 0 < k < size - 1:
                whole &= part != 0x20
        h = (code ^ (code >> np.uint32(15))) * np.uint32(salt)
        h = ((h ^ (h >> np.uint32(13))) * np.uint32(3266489917)) >> shift
        out.append(np.where(whole, h, np.uint32(buckets)))
    return out


def _bags(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(lang, draw, mark, ids, counts) of the sampled rows' subwords: at most ``buckets`` each."""
    for batch in batches:
        ids, counts = [], []
        for lo, hi, data, offsets in chunks(_padded(batch.column(3)), _CHUNK):
            found = subwords(data, buckets)
            for d in range(hi - lo):
                got = np.concatenate([h[offsets[d] : min(offsets[d + 1], len(h))] for h in found])
                u, c = np.unique(got[got < buckets], return_counts=True)
                ids.append(u.astype(np.int32))
                counts.append(c.astype(np.int32))
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, counts)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["lang", "draw", "mark", "ids", "counts"])


@dataclass
class Model:
    """``table`` has a row of logits for each bucket, and a last one of zeros."""

    languages: list[str]
    table: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        """One row of mean logits for each text; zeros for a text without subwords."""
        out = np.zeros((len(column), len(self.languages)), dtype=np.float64)
        buckets = len(self.table) - 1
        for lo, hi, data, offsets in chunks(_padded(column), _CHUNK):
            at, n = offsets[:-1], np.zeros(hi - lo)
            for h in subwords(data, buckets):
                h = np.concatenate((h, np.full(len(data) - len(h), buckets, dtype=np.uint32)))
                n += np.add.reduceat((h < buckets).astype(np.int64), at)
                for k in range(len(self.languages)):
                    out[lo:hi, k] += np.add.reduceat(self.table[:, k].take(h), at, dtype=np.float64)
            out[lo:hi] /= np.maximum(n, 1)[:, None]
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its calibrated probability."""
        p = softmax(self.logits(column) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Bag = tuple[int, np.ndarray, np.ndarray]


def _descend(train: list[Bag], n: int, buckets: int, width: int, epochs: int, rate: float, draw: np.random.Generator) -> np.ndarray:
    """The logits of each bucket, and a last row of zeros, from (language, bucket ids, shares)."""
    vectors = draw.normal(0, 0.1, (buckets, width)).astype(np.float32)
    weights = draw.normal(0, 0.1, (width, max(1, n))).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in draw.permutation(len(train)):
            y, ids, share = train[i]
            hidden = share @ vectors[ids]
            error = softmax(hidden @ weights)
            error[y] -= 1
            back = weights @ error
            weights -= step * np.outer(hidden, error)
            vectors[ids] -= (step * len(ids) ** 0.5) * np.outer(share, back)
    return np.vstack((vectors @ weights, np.zeros((1, weights.shape[1]), dtype=np.float32)))


def _logits(bags: list[Bag], table: np.ndarray) -> np.ndarray:
    return np.array([share @ table[ids] for _, ids, share in bags]).reshape(len(bags), table.shape[1])


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Where languages part cleanly every sharpness fits; the mildest of those is kept."""
    grid = np.geomspace(0.1, 10, 60)
    loss = np.array([-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid])
    return float(grid[np.flatnonzero(loss <= loss.min() + 0.002)[-1]])


def _sureness(logits: np.ndarray, temperature: float) -> np.ndarray:
    return softmax(logits / temperature).max(axis=1) if len(logits) else np.zeros(0)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, width: int = 16, epochs: int = 6, rate: float = 0.2, false_reject: float = 0.002, refused: float = 0.95, seed: int = 7) -> Model:
    """A model from (language, bucket ids, counts) of labelled texts; every fifth row only calibrates.

    The threshold refuses ``refused`` of the texts of a language left out, but no
    more than ``false_reject`` of the others' texts that are rightly told apart.
    """
    languages = sorted({lang for lang, ids, _ in rows if len(ids)})
    draw = np.random.default_rng(seed)
    known = [(languages.index(lang), ids, (c / c.sum()).astype(np.float32)) for lang, ids, c in rows if len(ids)]
    train = [x for i, x in enumerate(known) if i % 5 != 4]
    held = [x for i, x in enumerate(known) if i % 5 == 4] or train
    model = Model(languages, _descend(train, len(languages), buckets, width, epochs, rate, draw))
    if not held:
        return model
    truth = np.array([y for y, _, _ in held])
    logits = _logits(held, model.table)
    model.temperature = _temperature(logits, truth)
    right = _sureness(logits, model.temperature)[logits.argmax(axis=1) == truth]
    outside = []
    for out in range(len(languages)) if len(languages) > 2 else ():
        others = [(y - (y > out), ids, share) for y, ids, share in train if y != out]
        table = _descend(others, len(languages) - 1, buckets, width, epochs, rate, draw)
        own = [(y - (y > out), ids, share) for y, ids, share in held if y != out]
        if own:
            cold = _temperature(_logits(own, table), np.array([y for y, _, _ in own]))
            outside.append(_sureness(_logits([x for x in held if x[0] == out], table), cold))
    if len(right):
        most = float(np.quantile(right, false_reject))
        least = float(np.quantile(np.concatenate(outside), refused)) if sum(map(len, outside)) else most
        model.threshold = (least + most) / 2 if least < most else most
    return model


def in_fold(doc_id: Column, of: int = 5) -> Column:
    """Whether the id's checksum leaves no remainder; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of == 0


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """A model of the languages of ``docs`` (doc_id, text, lang), learnt outside the held-out fold.

    About ``per_language`` labelled rows of each language are drawn by a digest
    of their ids, all rows of a language that has fewer.  Only their subword
    counts, ``buckets`` a row at most, reach the driver, as arrays.  A table
    with more than ``MOST_LANGUAGES`` labels is an error.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("doc_id")))
    lang = F.col("lang").cast("string")
    draw = F.xxhash64(F.col("doc_id"), F.lit(11)).bitwiseAND(F.lit((1 << 40) - 1)).cast("long")
    rows = labelled.select(lang.alias("lang"), draw.alias("draw"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    shares = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")).limit(MOST_LANGUAGES + 1).collect()
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels in lang")
    if not shares:
        return fit([], buckets)
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    sample = rows.join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("share") * (1 << 40)).select("lang", "draw", "mark", "text")
    bags = small_batches(sample).mapInArrow(lambda it: _bags(it, buckets), "lang string, draw long, mark long, ids array<int>, counts array<int>").toArrow().combine_chunks()
    names = bags.column("lang").to_pylist()
    order = np.lexsort((bags.column("mark").to_numpy(), names, bags.column("draw").to_numpy())) if names else ()
    lists = [bags.column(c).combine_chunks() for c in ("ids", "counts")]
    flat, ends = [x.flatten().to_numpy() for x in lists], lists[0].offsets.to_numpy()
    at = lambda i: slice(ends[i] - ends[0], ends[i + 1] - ends[0])
    return fit([(names[i], flat[0][at(i)].astype(np.int64), flat[1][at(i)].astype(np.float64)) for i in order], buckets)


def _judge(docs: DataFrame, model: Model) -> Column:
    """lang_pred, score and rejected of ``docs``' texts, in a struct."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judge(text: pa.Array) -> pa.Array:
        m = shared.value
        lettered = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
        if m.languages and len(text):
            best, score = m.predict(text)
            names = np.where(lettered, np.array(m.languages, dtype=object)[best], UNKNOWN)
            score = np.where(lettered, np.clip(score, 0.0, 1.0), 0.0)
        else:
            names, score = np.full(len(text), UNKNOWN, dtype=object), np.zeros(len(text))
        refused = ((names == UNKNOWN) | (score < m.threshold)).astype(bool)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(refused)], names=["lang_pred", "score", "rejected"])

    return judge(F.col("text").cast("string"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected.

    A null text, or one without a letter, is ``und`` with score 0 and rejected;
    so is every text if the model knows no language.  Otherwise lang_pred is the
    likeliest language, score its calibrated probability, and rejected whether
    that is under the model's threshold.  Columns of ``docs`` that have these
    three names are replaced, all others stay.  Null and repeated ids change
    nothing; an empty table gives an empty table.
    """
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in new]
    name = unused(docs, "judged")
    return docs.withColumn(name, _judge(docs, model)).select(*kept, *[F.col(name)[n].alias(n) for n in new])


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``identify`` does not reject."""
    return docs.where(~_judge(docs, model)["rejected"])
