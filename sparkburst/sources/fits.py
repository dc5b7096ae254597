"""Tables in FITS files: event lists, source lists, catalogues.

``FitsTable`` is a data source: a file's header is read by its first bytes, its rows
in ranges, so that many tasks share a large file, and only the columns of the
schema that is asked for are decoded.  It writes too, a file or more a task.
``files``, ``headers`` and ``events`` read whole files through Spark's binary files
where a store is only known to Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

BLOCK = 2880
#: FITS letters of column formats and what they are in memory.
FORMATS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def _cards(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header cards from ``at``, and where the data start."""
    cards: dict[str, str] = {}
    while True:
        block = raw[at : at + BLOCK].decode("ascii", "replace")
        if not block:
            raise ValueError("the header has no END card")
        at += BLOCK
        for k in range(0, len(block), 80):
            card = block[k : k + 80]
            name = card[:8].strip()
            if name == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:].strip()
                cards[name] = value[1 : value.index("'", 1)].rstrip() if value.startswith("'") else value.split("/")[0].strip()


def _size(cards: dict[str, str]) -> int:
    n = int(cards.get("NAXIS", 0))
    if not n:
        return 0
    cells = int(np.prod([int(cards[f"NAXIS{k + 1}"]) for k in range(n)]))
    return -(-(cells * abs(int(cards["BITPIX"])) // 8 + int(cards.get("PCOUNT", 0))) // BLOCK) * BLOCK


def parse(raw: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header and rows of the first table extension."""
    cards, at = _cards(raw, 0)
    at += _size(cards)
    while at < len(raw):
        cards, at = _cards(raw, at)
        if cards.get("XTENSION") == "BINTABLE":
            rows = np.frombuffer(raw, dtype=_columns(cards), count=int(cards["NAXIS2"]), offset=at)
            return cards, rows
        at += _size(cards)
    raise ValueError("no table extension")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, instrument and stage of every event file; the name tells the camera."""
    name = F.element_at(F.split("path", "/"), -1)
    camera = F.when(F.contains(name, F.lit("PI")), "EPN").when(F.contains(name, F.lit("M1")), "EMOS1").when(F.contains(name, F.lit("M2")), "EMOS2")
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    return found.select("path", "length", name.alias("name"), camera.alias("instrument"), F.when(F.contains(name, F.lit("FILT")), "processed").otherwise("raw").alias("stage"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path and header of every file; no rows are decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "header": [parse(bytes(c))[0] for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, header map<string,string>")


def events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The files' rows with ``schema``'s columns (any case in the file), its scalars from the header where no column has the name."""
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                cards, rows = parse(bytes(content))
                lower = {n.lower(): n for n in rows.dtype.names}
                out = {}
                for f in schema:
                    if f.name.lower() in lower:
                        v = rows[lower[f.name.lower()]]
                        out[f.name] = np.char.decode(v).astype(object) if v.dtype.kind == "S" else v.astype(v.dtype.newbyteorder("="))
                    else:
                        out[f.name] = [cards.get(f.name.upper()[:8])] * len(rows)
                frame = pd.DataFrame(out, columns=names)
                for f in schema:
                    if f.dataType.typeName() in ("long", "integer", "double"):
                        frame[f.name] = pd.to_numeric(frame[f.name])
                yield frame

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


#: The columns of a source list that masks need, and of a catalogue.
SOURCE_LIST = "source LONG, obsid STRING, det_ml DOUBLE, extent DOUBLE, total_rate DOUBLE, ra_deg DOUBLE, dec_deg DOUBLE"
CATALOGUE = "cat_id LONG, ra_deg DOUBLE, dec_deg DOUBLE"
#: Rows of a task's range, and of a written file.
RANGE_ROWS = 1 << 20
#: Spark's types as column formats and back; text has its width before the letter.
_WRITTEN = {"int64": "K", "int32": "J", "int16": "I", "double": "D", "float": "E", "bool": "L"}
_READ = {"K": "bigint", "J": "int", "I": "smallint", "B": "smallint", "D": "double", "E": "float", "L": "boolean", "A": "string"}


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    fs, at = _store(path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [at]
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == pa.fs.FileType.File and f.base_name.lower().endswith((".fits", ".fit", ".ftz")))


def table_header(fs: pa.fs.FileSystem, path: str) -> tuple[dict[str, str], int]:
    """Cards of the first table extension and where its rows start, by reading headers only."""
    with fs.open_input_file(path) as file:
        size, at = file.size(), 0
        while at < size:
            raw = b""
            while True:
                block = file.read_at(BLOCK, at + len(raw))
                if not block:
                    raise ValueError(f"{path}: the header has no END card")
                raw += block
                if any(block[k : k + 8].rstrip() == b"END" for k in range(0, len(block), 80)):
                    break
            cards, end = _cards(raw, 0)
            if cards.get("XTENSION") == "BINTABLE":
                return cards, at + end
            at += end + _size(cards)
    raise ValueError(f"{path}: no table extension")


def _columns(cards: dict[str, str]) -> np.dtype:
    fields = []
    for k in range(1, int(cards["TFIELDS"]) + 1):
        form = cards[f"TFORM{k}"]
        count, kind = int(form[:-1] or 1), FORMATS[form[-1]]
        fields.append((cards[f"TTYPE{k}"], f"S{count}" if kind == "S" else kind, *(((count,),) if count > 1 and kind != "S" else ())))
    return np.dtype(fields)


class _Rows(InputPartition):
    def __init__(self, path: str, cards: dict[str, str], offset: int, first: int, n: int):
        self.path, self.cards, self.offset, self.first, self.n = path, cards, offset, first, n


class _TableReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int):
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self) -> Sequence[InputPartition]:
        fs, _ = _store(self.path)
        paths = _listed(self.path)
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(lambda p: table_header(fs, p), paths))
        return [_Rows(p, cards, at, k, min(self.rows, int(cards["NAXIS2"]) - k)) for p, (cards, at) in zip(paths, heads, strict=True) for k in range(0, int(cards["NAXIS2"]), self.rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Rows):  # a folder without rows
            return
        fs, _ = _store(self.path)
        cards, kind = partition.cards, _columns(partition.cards)
        width = int(cards["NAXIS1"])
        lower = {n.lower(): k for k, n in enumerate(kind.names)}
        with fs.open_input_file(partition.path) as file:
            step = max(1, (8 << 20) // max(width, 1))  # some megabytes at a time
            for first in range(partition.first, partition.first + partition.n, step):
                n = min(step, partition.first + partition.n - first)
                rows = np.frombuffer(file.read_at(n * width, partition.offset + first * width), dtype=kind)
                arrays = []
                for f in self.schema.fields:
                    to = _arrow(f.dataType.typeName())
                    k = lower.get(f.name.lower())
                    if k is None:  # a scalar of the header
                        arrays.append(pa.array([cards.get(f.name.upper()[:8])] * n, pa.string()).cast(to))
                        continue
                    v = rows[kind.names[k]]
                    if v.dtype.kind == "S":
                        text = np.char.decode(v, "utf-8").tolist()
                        arrays.append(pa.array([x == "T" for x in text]) if to == pa.bool_() else pa.array(text, pa.string()).cast(to))
                        continue
                    null = cards.get(f"TNULL{k + 1}")
                    v = v.astype(v.dtype.newbyteorder("="))
                    arrays.append(pa.array(v, mask=(v == int(null)) if null is not None else None).cast(to))
                yield pa.RecordBatch.from_arrays(arrays, names=self.schema.fieldNames())


def _arrow(name: str) -> pa.DataType:
    return {"long": pa.int64(), "bigint": pa.int64(), "integer": pa.int32(), "short": pa.int16(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_()}[name]


class _Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def _card(name: str, value: object) -> str:
    return f"{name:<8}= {value!s:>20}".ljust(80)


def encoded(table: pa.Table) -> bytes:
    """A table as a FITS file: an empty primary header and one binary table."""
    fields, columns, nulls = [], [], {}
    for k, f in enumerate(table.schema, 1):
        column = table.column(f.name)
        if pa.types.is_string(f.type):
            raw = np.array([(x or "").encode() for x in column.to_pylist()], dtype=object)
            width = max([1, *map(len, raw)])
            fields.append((f.name, f"S{width}", f"{width}A"))
            columns.append(raw.astype(f"S{width}"))
            continue
        letter = _WRITTEN[str(f.type)]
        if letter == "L":
            columns.append(np.where(np.array(column.to_pylist(), dtype=object) == True, b"T", b"F").astype("S1"))  # noqa: E712
        elif letter in "DE":
            columns.append(column.fill_null(float("nan")).to_numpy())
        else:
            if column.null_count:
                nulls[k] = np.iinfo(FORMATS[letter]).min
                column = column.fill_null(int(nulls[k]))
            columns.append(column.to_numpy())
        fields.append((f.name, FORMATS[letter], letter))
    rows = np.zeros(table.num_rows, dtype=np.dtype([(n, d) for n, d, _ in fields]))
    for (name, _, _), values in zip(fields, columns, strict=True):
        rows[name] = values
    cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields))]
    cards += [c for k, (n, _, form) in enumerate(fields, 1) for c in ((f"TTYPE{k}", f"'{n}'"), (f"TFORM{k}", f"'{form}'"))] + [(f"TNULL{k}", v) for k, v in nulls.items()]
    head = lambda xs: ("".join(_card(*x) for x in xs) + "END".ljust(80)).encode()
    padded = lambda x, fill: x + fill * (-len(x) % BLOCK)
    return padded(head([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]), b" ") + padded(head(cards), b" ") + padded(rows.tobytes(), b"\0")


class _TableWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)
        attempt, names, held, n = uuid.uuid4().hex, [], [], 0

        def put() -> None:
            # hidden until all tasks are done
            name = f"table-{TaskContext.get().partitionId():05d}-{attempt}-{len(names):04d}.fits"
            with fs.open_output_stream(f"{at}/_{name}.part") as out:
                out.write(encoded(pa.Table.from_batches(held)))
            names.append(name)

        for batch in iterator:
            for k in range(0, batch.num_rows, self.rows):
                piece = batch.slice(k, self.rows)
                if held and n + piece.num_rows > self.rows:
                    put()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            put()
        return _Files(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)
        for name in (n for m in messages if m is not None for n in m.names):
            fs.move(f"{at}/_{name}.part", f"{at}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _store(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            fs.delete_file(f"{at}/_{name}.part")


class FitsTable(DataSource):
    """Format ``fits_table``: the first binary table of every file under ``path``.

    A schema names the columns to decode, in any case; what no column has comes
    from the header.  Without one it is that of the first file.  Options: ``path``,
    ``rows`` (of a range of a file, and of a written file).
    """

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> str:
        fs, _ = _store(self.options["path"])
        cards, _ = table_header(fs, _listed(self.options["path"])[0])
        return ", ".join(f"`{cards[f'TTYPE{k}']}` {_READ[cards[f'TFORM{k}'][-1]]}" for k in range(1, int(cards["TFIELDS"]) + 1))

    def _rows(self) -> int:
        return int(self.options.get("rows", RANGE_ROWS))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TableReader(self.options["path"], schema, self._rows())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TableWriter(self.options["path"], self._rows())


class _Heads(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _HeaderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        paths = _listed(self.path)
        return [_Heads(paths[k : k + 64]) for k in range(0, len(paths), 64)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = _store(self.path)
        for p in getattr(partition, "paths", ()):
            yield p, table_header(fs, p)[0]


class FitsHeaders(DataSource):
    """Format ``fits_header``: path and header cards of every file under ``path``; no rows are read."""

    @classmethod
    def name(cls) -> str:
        return "fits_header"

    def schema(self) -> str:
        return "path string, header map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HeaderReader(self.options["path"])


def write_table(df: DataFrame, path: str, rows: int = RANGE_ROWS) -> None:
    df.sparkSession.dataSource.register(FitsTable)
    df.write.format("fits_table").option("rows", rows).mode("append").save(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    spark.dataSource.register(FitsTable)
    reader = spark.read.format("fits_table").option("rows", rows)
    return (reader.schema(schema) if schema else reader).load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FitsHeaders)
    return spark.read.format("fits_header").load(path)
