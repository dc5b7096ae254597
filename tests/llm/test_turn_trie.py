"""The prefix trie against nested dictionaries, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from sparkburst.llm import queries, turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, name string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def wanted(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, role, hashlib.sha256(f"{role}\0{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return {
        (m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    }


def got(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def table(seed, ids, longest=12):
    r = random.Random(seed)
    said = [("user", "a"), ("assistant", "bb"), ("user", "ccc"), (None, "Ünï🙂"), ("user", None), ("", "")]
    rows = []
    for c in ids:
        for k in range(r.randrange(1, longest)):
            turn = r.choice([k, k, k, None, 3])
            rows.append((c, turn, *(said[k % 3] if r.random() < 0.7 else r.choice(said))))
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("block", [1024, 3])
def test_against_dictionaries(spark, rebuild, block, monkeypatch):
    monkeypatch.setattr(turn_trie, "BLOCK", block)
    rows = table(block, [*range(60), *range(100, 130), *range(200, 210), 350, -3, -150, -100, None])
    assert got(turn_trie.trie(frame(spark, rows), rebuild)) == wanted(rows, rebuild)


def test_long_and_copied(spark):
    """A conversation of hundreds of turns, near copies of it, and many exact copies of one of three."""
    r = random.Random(2)
    long = [(k, "user", r.choice("xyz")) for k in range(300)]
    rows = [(1000, *t) for t in long] + [(1001, *t) for t in long[:257]] + [(1003, *t) for t in long] + [(c, k, "user", "copy") for c in range(60) for k in range(3)]
    turns = frame(spark, rows)
    assert got(turn_trie.trie(turns, rebuild=False)) == wanted(rows, False)


def test_turnless_and_empty(spark):
    # 1 lends nothing of 0, which is absent, and keeps only what follows its first h turns
    rows = [(1, 0, "user", "a"), (7, 0, "user", "b"), (9, 0, "user", "b")]
    assert got(turn_trie.trie(frame(spark, rows))) == wanted(rows)
    assert turn_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    ours = queries.op13_turn_trie(spark, sf)
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(ours) == wanted(rows)
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    result = duck.execute(queries.ORACLE_SQL["op13_turn_trie"])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(COLUMNS)
    theirs = [dict(zip(names, x, strict=True)) for x in result.fetchall()]
    assert {(x["conv_id"], x["depth"]): tuple(x[c] for c in COLUMNS[2:]) for x in theirs} == got(ours)
