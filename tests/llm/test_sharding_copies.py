"""A third of all rows are one row: shards stay even, and no window holds them all."""

from collections import Counter

from pyspark.sql import functions as F

from sparkburst.llm import sharding


def test_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(i, f"text {i}", f"s{i % 3}") for i in range(600)] + [(7, "copy", "s1")] * 300 + [(None, None, None)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    placed = sharding._placed
    largest = []

    def seen(table, keys, bucket, order, name):
        largest.append(table.groupBy(*keys, bucket).count().agg(F.max("count")).first()[0])
        return placed(table, keys, bucket, order, name)

    monkeypatch.setattr(sharding, "_placed", seen)
    out = sharding.shard(df, shards=7).collect()
    assert len(out) == 1000 and Counter(r["doc_id"] for r in out)[7] == 301 and Counter(r["doc_id"] for r in out)[None] == 100
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
        for source in ("s0", "s1", "s2", ""):
            of = [r for r in out if r["source"] == source]
            assert abs(sum(r["shard"] == s for r in of) - len(of) / 7) <= 4
    assert max(largest) < 120  # some fifty a bucket, where one digest would be three hundred
