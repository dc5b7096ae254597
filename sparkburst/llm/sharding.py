"""Proportional stratified interleaving.

Rows are shuffled by a seeded digest of their id and text and ranked within their
source; sorting all rows by the fractional rank (rank - u) / n(source) spreads
every source evenly over the order, so that any cut of it has the mixture of the
whole.  u is the digest's own fraction, so that the rows of many small sources do
not all stand at one place.
Ranks come from counts of small buckets of the digest and windows inside a
bucket: a source that holds most of the rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

SHARDS = 24
SEED = "shard-1"
#: Rows of a bucket that one window partition orders, on average.
BUCKET_ROWS = 2_000
#: Buckets whose counts one window orders; beyond, buckets hold more rows.
MOST_BUCKETS = 5_000_000


def _placed(rows: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds the 0-based position of each row in its ``keys``, in the order of ``bucket`` and then ``order``."""
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return rows.withColumn(name, inside - 1).join(starts, [*keys, bucket]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def _spread_copies(rows: DataFrame) -> DataFrame:
    """``rows`` in which a digest that more rows share than a bucket holds is made one for each of them, by their numbers as written.

    Those are rows of one id and text, so any order of them will do.
    """
    many = written(rows.groupBy("digest").agg(F.count("*").alias("_c")).where(F.col("_c") > BUCKET_ROWS).select("digest"), "copies")
    if many.isEmpty():
        return rows
    own = F.md5(F.concat_ws(":", "digest", F.col("_row").cast("string")).cast("binary"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).join(many.withColumn("_many", F.lit(True)), "digest", "left")
    return written(numbered.withColumn("digest", F.when(F.col("_many"), own).otherwise(F.col("digest"))).select(*rows.columns), "sizes")


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, source, shard and slot of every row of ``docs``.

    Counts of shards differ by one at most.  A null source is the stratum ''.
    A null text counts as empty; null and repeated ids are rows like any other,
    ordered after their digest by id, checksum and size.  Very many rows of one id
    and text are spread over the order one by one.  Of an empty table no
    row is returned.  Columns other than doc_id, text and source are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(text).cast("string")).cast("binary")).alias("digest"),
        ),
        "sizes",
    )
    total = rows.count()
    rows = _spread_copies(rows)
    buckets = max(1, min(MOST_BUCKETS, -(-total // BUCKET_ROWS)))
    order = ["digest", "doc_id", "text_crc32", "size"]
    first = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    ranked = _placed(rows.withColumn("_b", F.floor(first * buckets / F.lit(1 << 32)).cast("long")), ["source"], "_b", order, "_rank").drop("_b")
    of_source = rows.groupBy("source").agg(F.count("*").alias("_of"))
    spread = ranked.join(of_source, "source").withColumn("_f", (F.col("_rank") + (first + 0.5) / F.lit(float(1 << 32))) / F.col("_of"))
    spread = spread.withColumn("_all", F.lit(0)).withColumn("_b", F.floor(F.col("_f") * buckets).cast("long"))
    dealt = _placed(spread, ["_all"], "_b", ["_f", "source", *order], "_at").withColumn("shard", F.floor(F.expr(f"(_at * {shards}) div {max(1, total)}")).cast("int"))
    slot = F.col("_at") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return dealt.select("doc_id", "size", "text_crc32", "source", "shard", slot.cast("long").alias("slot"))
