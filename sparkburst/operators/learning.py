"""Clustering of feature vectors and of light curves, from a fixed start.

Lloyd's rounds: every vector goes to its nearest centre, for all numbers of
clusters in one scan, in arrays of a batch at a time; a batch's sums are added
by Spark, and what comes back is a row for each component of a centre.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: k -> its centres, one a row
Centres = dict[int, np.ndarray]


def standardised(df: DataFrame, ids: Sequence[str], column: str) -> DataFrame:
    """(id, x): each component less its mean, over its sample deviation where it has one."""
    vectors = df.select(F.struct(*ids).alias("id"), F.col(column).cast("array<double>").alias("x"))
    stats = vectors.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).orderBy("d").collect()  # a row a component
    mean, spread = F.lit([r["m"] for r in stats]), F.lit([r["s"] if r["s"] else 1.0 for r in stats])
    return vectors.select("id", F.transform("x", lambda v, i: (v - F.get(mean, i)) / F.get(spread, i)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _sums(vectors: DataFrame, centres: Centres) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """k -> vectors, mean square and means of each cluster's vectors; ties go to the first centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, out = _matrix(batch.column(0)), []
            # two more columns: what sums to the number and to the squares
            wide = np.column_stack((x, np.ones(len(x)), (x * x).sum(axis=1)))
            for k, own in centres.items():
                c = _distances(x, own).argmin(axis=1)
                for j in np.unique(c):
                    total = wide[c == j].sum(axis=0)
                    out.append((np.full(len(total), k), np.full(len(total), j), np.arange(len(total)), total))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], names=["k", "c", "d", "s"])

    parts = vectors.select("x").mapInArrow(run, "k long, c long, d long, s double").groupBy("k", "c", "d").agg(F.sum("s").alias("s"))
    size = next(iter(centres.values())).shape[1]
    totals = {k: np.zeros((k, size + 2)) for k in centres}
    for r in parts.collect():  # a row for each component of a centre
        totals[r["k"]][r["c"], r["d"]] = r["s"]
    out = {}
    for k, t in totals.items():
        n = t[:, size]
        safe = np.maximum(n, 1)[:, None]
        out[k] = n, t[:, size + 1] / safe[:, 0], t[:, :size] / safe
    return out


def lloyd(vectors: DataFrame, ks: Sequence[int], rounds: int = 6) -> Centres:
    """Centres after so many rounds from the first vectors by id; one that loses all its vectors stays where it is."""
    first = np.array([r["x"] for r in vectors.orderBy("id").limit(max(ks)).collect()])
    if len(first) < max(ks):
        raise ValueError(f"{max(ks)} clusters of {len(first)} vectors")
    centres = {k: first[:k] for k in ks}
    for _ in range(rounds):
        moved = {k: np.where((n > 0)[:, None], means, centres[k]) for k, (n, _, means) in _sums(vectors, centres).items()}
        same = all((moved[k] == centres[k]).all() for k in ks)
        centres = moved
        if same:
            break
    return centres


def kmeans_sweep(df: DataFrame, ks: Sequence[int], ids: Sequence[str] = ("vec_id",), column: str = "embedding", rounds: int = 6) -> DataFrame:
    """(k, inertia, silhouette) for each number of clusters.

    The silhouette takes mean squared distances: of a vector to a cluster that is
    |x|^2 - 2 x.m + the cluster's mean square, so sums of each cluster are all it
    needs; a vector alone in its cluster has 0.
    """
    vectors = standardised(df, ids, column)
    centres = lloyd(vectors, ks, rounds)
    stats = _sums(vectors, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, out = _matrix(batch.column(0)), []
            square, row = (x * x).sum(axis=1), np.arange(len(x))
            for k, own in centres.items():
                d2 = _distances(x, own)
                c = d2.argmin(axis=1)
                n, q, means = stats[k]
                away = square[:, None] + q - 2 * x @ means.T
                away[:, n == 0] = np.inf
                a = away[row, c] * n[c] / np.maximum(n[c] - 1, 1)
                away[row, c] = np.inf
                b = away.min(axis=1)
                score = np.where((n[c] == 1) | ~np.isfinite(b), 0.0, (b - a) / np.where(np.isfinite(b), np.maximum(a, b), 1.0))
                out.append((k, float(d2[row, c].sum()), float(score.sum()), len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=["k", "inertia", "s", "n"])

    parts = vectors.select("x").mapInArrow(run, "k long, inertia double, s double, n long")
    return parts.groupBy(F.col("k").cast("int").alias("k")).agg(F.sum("inertia").alias("inertia"), (F.sum("s") / F.sum("n")).alias("silhouette"))


def series_clusters(curves: DataFrame, k: int, length: int = 32, rounds: int = 6) -> DataFrame:
    """(runid, label, cluster) of light curves summed to ``length`` equal parts."""
    spans = curves.groupBy("runid", "label").agg(F.min("it").alias("lo"), (F.max("it") - F.min("it") + 1).alias("w"))
    parts = curves.join(spans, ["runid", "label"]).withColumn("part", F.least(F.floor((F.col("it") - F.col("lo")) * length / F.col("w")), F.lit(length - 1)).cast("int"))
    sums = parts.groupBy("runid", "label", "part").agg(F.sum("n").cast("double").alias("v"))
    maps = sums.groupBy("runid", "label").agg(F.map_from_entries(F.collect_list(F.struct("part", "v"))).alias("m"))
    series = maps.select("runid", "label", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("series"))
    vectors = standardised(series, ["runid", "label"], "series")
    centres = lloyd(vectors, [k], rounds)[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = _distances(_matrix(batch.column(2)), centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c.astype(np.int32))], names=["runid", "label", "cluster"])

    kinds = dict(curves.dtypes)
    return vectors.select("id.runid", "id.label", "x").mapInArrow(run, f"runid {kinds['runid']}, label {kinds['label']}, cluster int")
