"""Token ids in Huffman-coded files.

``encode`` gives each text's ids, ``write`` stores them in ascending order of
doc_id, ``read`` gives them back; ``TokenFiles`` is the data source of the format,
which Spark writes and reads by tasks with a commit at the end.

A folder holds:

* ``codes``: one byte an id of the vocabulary, the bits of its word in the one
  canonical code of the folder, made from the counts of all ids;
* ``part-TTTTTT-AAAA-NNNN``: blocks of whole documents, each of about ``BLOCK`` ids
  and each starting on a byte; then little-endian arrays: documents (id, whether it
  is null, ids), blocks (byte offset, documents, ids), checkpoints (bit offset in the
  block of every 256th id); then the three numbers of their entries and a mark;
* ``_manifest``: JSON lines, one a file, in order: name, documents, ids.

A file has at most about ``FILE_IDS`` ids unless one document has more, so tasks of a reader hold no more than that.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from . import huffman
from .arrow_text import chunks
from .tables import discard, shared_dir, small_batches, written

END_ID = 1
BLOCK = 1 << 16
FILE_IDS = 1 << 23
#: Fixed value: ends every file.
MARK = b"HUFFIDS1"
_TAIL = struct.Struct("<qqq8s")
#: Distinct words whose ids a worker remembers (about 200 bytes each).
REMEMBERED = 1 << 20
#: Bytes of text whose distinct words are encoded together.
_CHUNK = 1 << 24
#: The splitter's parts of ASCII words without apostrophes, and single marks that are a part of their own.
_PARTS = re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
_STOPS = ".,;:!?"
_A, _SMALL_A, _TAB = np.uint8(0x41), np.uint8(0x61), np.uint8(0x09)
#: Plain words that are encoded at once.
_RUN = 256
# tasks are parallel already
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@cache
def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


class Encoder:
    """Ids of texts through a tokenizer that never joins what white space parts, so that each distinct word is encoded once.

    That holds for a tokenizer whose normalizer and splitter drop white space (``by_word``); others get whole texts.
    """

    def __init__(self, name: str, end_id: int | None = END_ID):
        self.tokenizer = tokenizer(name)
        self.kind = _kind(self.tokenizer.get_vocab_size())
        self.end = np.array([] if end_id is None else [end_id], dtype=self.kind).tobytes()
        probe = ["a b", "a  b", "\ta\n\r\x0b\x0cb "]
        alone = [i for w in "ab" for i in self._ids([w])[0]]
        self.by_word = all(x == alone for x in self._ids(probe)) and not self._ids([" \n"])[0]
        # what else holds for words: case is dropped, and letters and stops are parts of their own
        self.lowers = self._ids(["aBCDEFGHIJKLMNOPQRSTUVWXYZ"]) == self._ids(["abcdefghijklmnopqrstuvwxyz"])
        self.parts = all(self._ids([f"a{x}b"])[0] == sum(self._ids(["a", x, "b"]), []) for x in _STOPS)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        # words of late, and those of before that
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def arrays(self, column: pa.Array) -> Iterator[pa.Array]:
        """The texts' ids as bytes, with the end's, in arrays of some texts each; a null text is empty."""
        if not self.by_word:
            for text in column:
                yield pa.array([np.array(self._ids([text.as_py() or ""])[0], dtype=self.kind).tobytes() + self.end], pa.binary())
            return
        for _, _, data, offsets in chunks(column, _CHUNK):
            yield self._chunk(data, offsets)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        if self.lowers and b"<|" not in data.tobytes():
            capital = data - _A < 26
            capital[:-1] &= data[1:] < 128  # a mark that follows might join it
            capital[-1:] = False
            data = data + (capital.view(np.uint8) << np.uint8(5))
        filled = (data != 0x20) & (data - _TAB > 4)  # comparisons of bytes are far cheaper than look-ups
        begins = filled.copy()
        begins[1:] = ~filled[:-1]
        if self.parts:
            stop, letter = np.logical_or.reduce([data == x for x in _STOPS.encode()]), (data | 0x20) - _SMALL_A < 26
            begins[1:] |= (stop[:-1] & letter[1:]) | (letter[:-1] & stop[1:])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins &= filled
        ends = np.searchsorted(np.flatnonzero(begins), offsets[1:])
        edges = np.append(np.flatnonzero(begins[filled]), np.count_nonzero(filled)).astype(np.int32)
        spans = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data[filled])])
        coded = spans.dictionary_encode()
        values = pa.array([*self._values(coded.dictionary.to_pylist()), self.end], pa.binary())
        # behind the words of each text, its end
        taken = values.take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(values) - 1)))
        _, bounds, ids = taken.buffers()
        bounds = np.frombuffer(bounds, dtype=np.int32)[: len(taken) + 1]
        last = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds[last]), ids])

    def _values(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        if older:
            before = [older.get(words[k]) for k in new]
            for k, ids in zip(new, before, strict=True):
                out[k] = ids
            known.update((words[k], ids) for k, ids in zip(new, before, strict=True) if ids is not None)
            new = [k for k, ids in zip(new, before, strict=True) if ids is None]
        texts = [words[k].decode() for k in new]
        least = list(map(self._least, texts))
        plain = [i for i, n in enumerate(least) if n] if self.ends.any() else []
        other = [i for i, n in enumerate(least) if not n] if plain else range(len(texts))
        for some, coded in ((plain, self._plain([texts[i] for i in plain], [least[i] for i in plain])), (other, self._each([texts[i] for i in other]))):
            for i, ids in zip(some, coded, strict=True):
                out[new[i]] = ids
        known.update((words[k], out[k]) for k in new)
        return out

    def _least(self, word: str) -> int:
        """The least number of parts that the splitter makes of a plain word, 0 if it is none."""
        if word.isalpha():
            return 1
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return 2
        return len(_PARTS.findall(word)) if word.isascii() and "'" not in word and "<|" not in word else 0

    def _plain(self, words: list[str], least: list[int]) -> list[bytes]:
        """The ids of each of these plain words.

        Every part of a text ends with an id that ends a word.  So where a run of
        plain words has as many of those as its words have at least, they tell the
        words apart; any other run is encoded word by word.
        """
        out: list[bytes] = []
        for lo in range(0, len(words), _RUN):
            run = words[lo : lo + _RUN]
            got = np.array(self._ids([" ".join(run)])[0], dtype=self.kind)
            at = np.flatnonzero(self.ends[got]) + 1
            parts = np.cumsum(least[lo : lo + _RUN])
            if len(at) == parts[-1]:
                raw, cuts = got.tobytes(), [0, *(at[parts - 1] * got.itemsize).tolist()]
                out.extend(raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            else:
                out.extend(self._each(run))
        return out

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, dtype=self.kind).tobytes() for ids in self._ids(words)]


@cache
def _encoder(name: str, end_id: int | None) -> Encoder:
    """A worker's own, which it keeps from task to task."""
    return Encoder(name, end_id)


def encode(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int | None = END_ID) -> DataFrame:
    """doc_id and ids (little-endian, two bytes each for a vocabulary of up to 65,536 ids, else four) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, end_id)
        for doc_ids, texts in _gathered(batches):
            at = 0
            for ids in encoder.arrays(texts):
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(ids)), ids], names=["doc_id", "ids"])
                at += len(ids)

    texts = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids binary")


def _gathered(batches: Iterator[pa.RecordBatch], limit: int = _CHUNK) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The two columns of as many batches at once as have about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield tuple(x.combine_chunks() for x in pa.Table.from_batches(held).columns)
            held, size = [], 0
    if held:
        yield tuple(x.combine_chunks() for x in pa.Table.from_batches(held).columns)


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def counted(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: as many numbers as the vocabulary has ids, summed by Spark."""
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            _, bounds, data = column.buffers()
            bounds = np.frombuffer(bounds, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
            if len(column) and bounds[-1] > bounds[0]:
                total += np.bincount(np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].view(kind), minlength=vocabulary)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(met, pa.int64()), "n": pa.array(total[met], pa.int64())})

    out = np.zeros(vocabulary, dtype=np.int64)
    for id_, n in encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():  # the vocabulary's ids
        out[id_] = n
    return out


class _Folder:
    """Files of a folder, by a path with or without a scheme, as driver and executors see it."""

    def __init__(self, path: str):
        self.fs, self.path = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)

    def put(self, name: str, data: bytes) -> None:
        with self.fs.open_output_stream(f"{self.path}/{name}") as out:
            out.write(data)

    def get(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as file:
            return file.read()

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.path}/{name}").type != pa.fs.FileType.NotFound:
            self.fs.delete_file(f"{self.path}/{name}")

    def make(self) -> None:
        self.fs.create_dir(self.path, recursive=True)


class _Written(WriterCommitMessage):
    def __init__(self, task: int, files: list[tuple[str, int, int]]):
        self.task, self.files = task, files


class _File:
    """One file while it is filled."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, block: int):
        self.lengths, self.words, self.block = lengths, words, block
        self.out, self.docs, self.blocks, self.checkpoints = io.BytesIO(), [], [], []
        self.held: list[np.ndarray] = []
        self.pending, self.ids = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.pending += len(ids)
        self.ids += len(ids)
        if self.pending >= self.block:
            self._block()

    def _block(self) -> None:
        if self.held:
            data, marks = huffman.encode(np.concatenate(self.held), self.lengths, self.words)
            self.blocks.append((self.out.tell(), len(self.held), self.pending))
            self.checkpoints.append(marks)
            self.out.write(data)
            self.held, self.pending = [], 0

    def close(self) -> bytes:
        self._block()
        docs, blocks = np.array(self.docs, dtype="<i8").reshape(-1, 3), np.array(self.blocks, dtype="<i8").reshape(-1, 3)
        marks = np.concatenate(self.checkpoints).astype("<i8") if self.checkpoints else np.zeros(0, dtype="<i8")
        for x in (docs, blocks, marks):
            self.out.write(x.tobytes())
        self.out.write(_TAIL.pack(len(docs), len(blocks), len(marks), MARK))
        return self.out.getvalue()


def read_file(raw: bytes, table: np.ndarray, longest: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, block by block."""
    n_docs, n_blocks, n_marks, mark = _TAIL.unpack_from(raw, len(raw) - _TAIL.size)
    if mark != MARK:
        raise ValueError("not a file of token ids")
    data = np.frombuffer(raw, dtype=np.uint8)
    at = len(raw) - _TAIL.size - 8 * (3 * n_docs + 3 * n_blocks + n_marks)
    docs = np.frombuffer(raw, "<i8", 3 * n_docs, at).reshape(-1, 3)
    blocks = np.frombuffer(raw, "<i8", 3 * n_blocks, at + 24 * n_docs).reshape(-1, 3)
    marks = np.frombuffer(raw, "<i8", n_marks, at + 24 * (n_docs + n_blocks))
    per_block = -(-blocks[:, 2] // huffman.STEP)
    first_mark, first_doc = (np.concatenate(([0], np.cumsum(x))) for x in (per_block, blocks[:, 1]))
    # as many blocks at once as fill the side-by-side look-ups
    lo = 0
    while lo < n_blocks:
        hi = max(lo + 1, int(np.searchsorted(first_mark, first_mark[lo] + huffman.LANES, side="right")) - 1)
        each = per_block[lo:hi]
        starts = marks[first_mark[lo] : first_mark[hi]] + np.repeat(8 * blocks[lo:hi, 0], each)
        counts = np.full(len(starts), huffman.STEP, dtype=np.int64)
        last = np.cumsum(each)[each > 0] - 1
        counts[last] = (blocks[lo:hi, 2] - (each - 1) * huffman.STEP)[each > 0]
        end = blocks[hi, 0] if hi < n_blocks else at
        base = blocks[lo, 0]
        ids = huffman.decode(data[base:end], starts - 8 * base, counts, table, longest)
        begin = 0
        for doc_id, null, n in docs[first_doc[lo] : first_doc[hi]].tolist():
            yield (None if null else doc_id), ids[begin : begin + n]
            begin += n
        lo = hi


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, block: int, file_ids: int):
        self.path, self.kind, self.block, self.file_ids = path, kind, block, file_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        folder, task = _Folder(self.path), TaskContext.get().partitionId()
        lengths = np.frombuffer(folder.get("codes"), dtype=np.uint8)
        words, attempt, files = huffman.codewords(lengths), uuid.uuid4().hex, []

        def close(file: _File) -> None:
            if file.docs:
                name = f"part-{task:06d}-{attempt}-{len(files):06d}"
                folder.put(name, file.close())
                files.append((name, len(file.docs), file.ids))

        file = _File(lengths, words, self.block)
        for batch in iterator:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file.ids >= self.file_ids:
                    close(file)
                    file = _File(lengths, words, self.block)
                file.add(doc_id, np.frombuffer(ids.as_buffer(), dtype=self.kind))
        close(file)
        return _Written(task, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) for f in m.files]
        _Folder(self.path).put("_manifest", "".join(json.dumps(f) + "\n" for f in files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        folder = _Folder(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else ():
                folder.drop(name)


class _Part(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        out, start = [], 0
        for line in _Folder(self.path).get("_manifest").decode().splitlines():
            name, _, ids = json.loads(line)
            out.append(_Part(name, start))
            start += ids
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Part):  # a folder without a file
            return
        folder = _Folder(self.path)
        table, longest = huffman.decoding_table(np.frombuffer(folder.get("codes"), dtype=np.uint8))
        start, held, size = partition.start, [], 0
        for doc_id, ids in read_file(folder.get(partition.name), table, longest):
            held.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
            start += len(ids)
            size += len(ids)
            if size >= 1 << 20:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class TokenFiles(DataSource):
    """Format ``token_ids``: writes (doc_id long, ids binary) in the order of its tasks and rows, reads (doc_id, start, n_tokens, ids).

    The folder's ``codes`` must stand there before it is written to.
    """

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["kind"], int(self.options.get("block", BLOCK)), int(self.options.get("file_ids", FILE_IDS)))


def write(docs: DataFrame, path: str, name: str = "word_bpe_49k.json", end_id: int | None = END_ID, block: int = BLOCK, file_ids: int = FILE_IDS) -> None:
    """Writes every row of ``docs`` (doc_id, text) to the new folder ``path``, in ascending order of doc_id, nulls first.

    A null or empty text is the end id alone.  Rows that share a doc_id stand side
    by side in the order of a digest of their ids; repeated rows are all written, and
    a doc_id that many rows share is spread over tasks by it and by rows' numbers.
    Other columns are not read.  ``path`` must be a folder that driver and executors reach.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer(name).get_vocab_size()
    encoded = written(encode(docs, name, end_id), "encoded")
    folder = _Folder(path)
    folder.make()
    folder.put("codes", huffman.code_lengths(counted(encoded, vocabulary)).tobytes())
    spark.dataSource.register(TokenFiles)
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.monotonically_increasing_id()]
    keyed = encoded.select("doc_id", "ids", keys[1].alias("digest"), keys[2].alias("row"))
    ranged = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "digest", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest", "row")
    ranged.select("doc_id", "ids").write.format("token_ids").options(kind=_kind(vocabulary), block=block, file_ids=file_ids).mode("append").save(path)
    discard(encoded)


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, four bytes each) of every document of a folder."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_ids").load(path)


def round_trip(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """The documents as read back from files that are written to the shared folder."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, name)
    return read(docs.sparkSession, path)
