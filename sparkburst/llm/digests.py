"""Digests of values that stand in many rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: SHA-256 of nothing.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def joined_sha256(parts: DataFrame, key: str, order: str, part: str, separator: str) -> DataFrame:
    """(key, sha256): of each key, a string, the lowercase SHA-256 of its parts, by order, with the separator between them.

    Parts are hashed as they pass, sorted by Spark, so a key with very many of
    them needs no more memory than one with few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between, current, digest = separator.encode(), None, None
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for k, x in zip(keys, batch.column(1), strict=True):
                if k != current:
                    if digest is not None:
                        out.append((current, digest.hexdigest()))
                    current, digest = k, hashlib.sha256()
                else:
                    digest.update(between)
                digest.update(x.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["key", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], names=["key", "sha256"])

    dealt = parts.select(parts[key].alias("key"), parts[part].alias("part"), parts[order].alias("order")).repartition("key").sortWithinPartitions("key", "order")
    return dealt.select("key", "part").mapInArrow(run, "key string, sha256 string")
