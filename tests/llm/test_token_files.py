"""Token files against the tokenizer itself, and the codec against optimal lengths."""

import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkburst.llm import huffman, token_files

from .test_llm import corpus, frame

NAME = "word_bpe_49k.json"
ODD = ["<|endoftext|> a<|startoftext|>b", "é ́x", "a\xa0b　c", "I'm DON'T 's", "İSTANBUL ΣΑΣ ẞ", "\x1c a \x85 b", "x" * 5000, "a,b c. d! ,", "12 345", "word. " * 3000, "no\x00ul", "J\u030cA\u030a I\u0307 H\u0331.J\u030c", "<|ENDOFTEXT|>x", "é,a.b…,c;D", "İ.I ", "a.'s it's.x"]


def plain(text, name=NAME):
    return token_files.tokenizer(name).encode(text or "", add_special_tokens=False).ids + [1]


def ids_of(encoder, texts):
    return [np.frombuffer(x.as_py(), encoder.kind).tolist() for part in encoder.arrays(pa.array(texts)) for x in part]


def optimal_bits(counts):
    heap = [int(c) for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 40, 3000])
def test_code(n):
    counts = np.bincount(np.random.default_rng(n).zipf(1.6, 20_000) % n, minlength=n + 3)
    lengths = huffman.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all()
    assert (0.5 ** lengths[lengths > 0].astype(float)).sum() <= 1
    if huffman.code_lengths(counts, 32).max() <= 16:
        assert (counts * lengths).sum() == optimal_bits(counts)
    words = huffman.codewords(lengths)
    spelled = [format(words[i], f"0{lengths[i]}b") for i in np.flatnonzero(lengths)]
    assert not any(a != b and b.startswith(a) for a, b in zip(sorted(spelled), sorted(spelled)[1:], strict=False))


def test_code_is_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233])
    assert huffman.code_lengths(counts).max() == 12
    short = huffman.code_lengths(counts, 5)
    assert short.max() == 5 and (0.5 ** short.astype(float)).sum() <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_codec():
    r = np.random.default_rng(3)
    for size in (0, 1, 255, 256, 257, 100_000):
        ids = r.zipf(1.2, size) % 5000
        lengths = huffman.code_lengths(np.bincount(ids, minlength=5000))
        data, starts = huffman.encode(ids, lengths, huffman.codewords(lengths))
        counts = np.full(len(starts), huffman.STEP)
        if size:
            counts[-1] = size - huffman.STEP * (len(starts) - 1)
        table, longest = huffman.decoding_table(lengths)
        assert (huffman.decode(np.frombuffer(data, np.uint8), starts, counts, table, longest) == ids).all()


def test_encoder(monkeypatch):
    texts = [t for _, t in corpus(7)] + ODD
    for chunk, run, remembered in ((1 << 24, 256, 1 << 20), (500, 3, 20)):
        monkeypatch.setattr(token_files, "REMEMBERED", remembered)
        monkeypatch.setattr(token_files, "_CHUNK", chunk)
        monkeypatch.setattr(token_files, "_RUN", run)
        encoder = token_files.Encoder(NAME)
        for _ in range(2):
            got = ids_of(encoder, texts)
            assert got == [plain(t) for t in texts]
    assert encoder.by_word
    whole = token_files.Encoder("byte_bpe_50k.json")
    assert not whole.by_word
    assert ids_of(whole, texts) == [plain(t, "byte_bpe_50k.json") for t in texts]


@pytest.mark.parametrize("block, limit", [(1 << 16, 1 << 23), (100, 500)])
def test_round_trip(spark, block, limit):
    docs = corpus(5) + [(1000 + k, t) for k, t in enumerate(ODD)] + [(-7, "least of all")] + [(3, "a copy")] * 5
    token_files_path = f"{spark.conf.get('spark.checkpoint.dir')}/tokens-test-{block}"
    token_files.write(frame(spark, docs), token_files_path, block=block, file_ids=limit)
    got = token_files.read(spark, token_files_path).collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    want = sorted(((i is not None, i or 0), zlib.crc32(np.array(plain(t), "<u4").tobytes())) for i, t in docs)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), zlib.crc32(r.ids)) for r in got) == want


def test_files(spark):
    """Every file is listed once; bits are close to the entropy; an empty table is an empty folder."""
    path = f"{spark.conf.get('spark.checkpoint.dir')}/tokens-listed"
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.hash(i, "id") % 50 + 100)).alias("text"))
    token_files.write(docs, path)
    names = set(os.listdir(path[len("file://") :]))
    listed = {line.split('"')[1] for line in open(f"{path[len('file://') :]}/_manifest")}
    assert {n for n in names if n.startswith("part")} == listed
    ids = token_files.read(spark, path).agg(F.sum("n_tokens")).first()[0]
    assert sum(os.path.getsize(f"{path[len('file://') :]}/{n}") for n in listed) < ids  # far less than two bytes an id
    assert token_files.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_tokenizer(spark):
    from sparkburst.llm import queries

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op11_token_files(spark, sf).collect()))
    want, start = [], 0
    for i, t in sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())):
        ids = plain(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
