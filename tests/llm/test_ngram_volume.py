"""The n-gram join beyond its broadcasts: what it shuffles and what it leaves on disk."""

import random
from pathlib import Path

import numpy as np

from sparkburst.llm import ngram_join, tables

from . import brute
from .test_llm import frame, key


def texts(n, seed=3):
    """Texts of their own, and a near copy of every tenth."""
    r = random.Random(seed)
    docs = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(120))) for i in range(n)]
    return docs + [(n + i, docs[i][1] + " more") for i in range(0, n, 10)]


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_shuffle_beyond_broadcasts(spark, monkeypatch):
    """Postings of shingles that one group holds are not shuffled, however many shingles are shared."""
    docs = texts(400)
    df, moved = frame(spark, docs).cache(), []
    for rows, size in ((ngram_join.BROADCAST_ROWS, "10m"), (0, "-1")):
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", rows)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        before = shuffled(spark)
        try:
            got = ngram_join.join(df, 4, 85).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        moved.append(shuffled(spark) - before)
        assert sorted(map(key, got)) == sorted(key((i, 117 + (i >= 400), i - 400 * (i >= 400))) for i, _ in docs)
    # counters apart, which are megabytes for any table
    assert moved[1] - moved[0] < 200_000, moved


def test_tables_that_stay(spark, tmp_path, monkeypatch):
    """Of the tables written on the way none with prefixes, sketches or sets stays."""
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    assert ngram_join.join(frame(spark, texts(50)), 4, 85).count() == 55
    assert not {p.name.split("-")[0] for p in Path(tmp_path).iterdir()} & {"prefixes", "groups", "shingles", "sets"}


def test_filter_loses_no_shingle(spark):
    """Each shared shingle passes, at any width; of others some few."""
    rng = np.random.default_rng(1)
    shared, other = (rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64) for n in (5000, 20000))
    passing = ngram_join._filter(spark.createDataFrame([(int(x),) for x in shared], "shingle long"), len(shared))
    groups = spark.createDataFrame([(1, 7, shared.tolist(), b"x"), (2, 8, other.tolist(), None), (3, 9, [], b"")], "g1 long, n long, prefix array<long>, sketch binary")
    got = ngram_join._postings(groups, passing).collect()
    assert [(r["shingle"], r["at"], r["n"], bytes(r["sketch"])) for r in got if r["gid"] == 1] == [(int(x), k, 7, b"x") for k, x in enumerate(shared)]
    assert sum(r["gid"] == 2 for r in got) < 600 and all(r["shingle"] == other[r["at"]] for r in got if r["gid"] == 2)


def test_passes_over_shingles(spark, monkeypatch):
    """Where postings are many beside the prefixes, they are shuffled in several goes; the result is the same."""
    docs, went, real = texts(60) + [(900 + k, f"one and the same line again and again {k % 3}") for k in range(30)], [], ngram_join._postings
    monkeypatch.setattr(ngram_join, "BYTES_AT_ONCE", 1)
    monkeypatch.setattr(ngram_join, "_postings", lambda *a: went.append(1) or real(*a))
    got = ngram_join.join(frame(spark, docs), 4, 85).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.components(docs, 4, 85))) and len(went) > 1
