"""Conversation repair against a search from the other end, and against its SQL."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import pytest
import xxhash

from sparkburst.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, edit string"
LEGAL = {"su", "ua", "au"}


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for _ in range((kind != 0) + (kind == 3)):
            yield conv, turn, role, text


def signed(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


sys.setrecursionlimit(20_000)


def repaired(rows, c=repair.Costs()):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation, after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), signed(r[3])))
    faults, seen = [], set()
    for _, _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))

    @lru_cache(None)
    def best(k, state, inserted):
        """Cheapest edits of the rows from k on; ``inserted`` turns in a row lead here."""
        out = [(0, "", ())] if k == len(rows) and state in "0a" else []
        put = lambda cost, letter, line, rest: out.append((cost + rest[0], letter + rest[1], line + rest[2])) if rest else None
        follows = {"0": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if inserted < 2:
            put(c.insert, "I", (f"{follows}:",), best(k, follows[0], inserted + 1))
        if k < len(rows):
            _, _, role, text = rows[k]
            put(c.delete, "D", (), best(k + 1, state, 0))
            if faults[k] not in ("blank", "duplicate"):
                more = c.truncated * (faults[k] == "truncated")
                if role[:1] == follows[0] or (role[:1] == "s" and state == "0"):
                    put(more, "K", (f"{role}:{text}",), best(k + 1, role[:1], 0))
                put(c.rerole + more, "R", (f"{follows}:{text}",), best(k + 1, follows[0], 0))
        return min(out, default=None)

    cost, audit, lines = best(0, "0", 0)
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines)


def table(seed, n=40, longest=14):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", "Say. more", "Ünï?", "end.\x0b", None, "x" * 2000 + "."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "", None, "sage", "User"]
    rows = []
    for conv in [*range(n), None, -5]:
        for k in range(r.randrange(1, longest)):
            role = ("user", "assistant")[k % 2] if r.random() < 0.6 else r.choice(roles)
            text = r.choice(texts) if r.random() < 0.3 else f"Turn {r.randrange(99)}."
            rows.append((conv, r.choice([k, k, k, k + 2, None]) if r.random() < 0.3 else k, role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA).repartition(3)


def wanted(rows, costs=repair.Costs()):
    by_conv = defaultdict(list)
    for x in damaged(rows):
        by_conv[x[0]].append(x)
    out = {}
    for conv in {x[0] for x in rows}:
        *figures, lines = repaired(by_conv[conv], costs) if by_conv[conv] else (0, 0, 0, 0, 0, 0, "", "")
        out[conv] = (*figures, hashlib.sha256(lines.encode()).hexdigest())
    return out


def got(df):
    return {x[0]: tuple(x)[1:] for x in df.collect()}


@pytest.mark.parametrize("segment, costs", [(256, repair.Costs()), (4, repair.Costs()), (2, repair.Costs(rerole=3, delete=4, insert=1, truncated=2)), (256, repair.Costs(rerole=2, delete=3, insert=2, truncated=1))])
def test_against_search(spark, segment, costs, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = table(segment + costs.insert)
    turns = frame(spark, rows)
    assert got(repair.summary(repair.damage(turns), turns, costs)) == wanted(rows, costs)


def test_long_conversation(spark, monkeypatch):
    """One conversation with most rows, repeats among them, in many segments."""
    monkeypatch.setattr(repair, "SEGMENT", 8)
    r = random.Random(4)
    rows = [(7, k, r.choice(["user", "assistant"]), r.choice(["Same.", f"Turn {k}.", "cut"])) for k in range(400)] + [(8, 0, "user", "A.")] * 30
    turns = frame(spark, rows)
    assert got(repair.summary(repair.damage(turns), turns)) == wanted(rows)
    roles = repair.repair(turns)[1].where("conv = '7'").orderBy("position").collect()
    assert [x.position for x in roles] == list(range(len(roles)))
    assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in roles))


def test_empty(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert repair.summary(repair.damage(turns), turns).count() == 0


def test_agrees_with_sql_and_search(spark):
    sf = "/root/testdata/sf0.001"
    ours = queries.op12_repair(spark, sf)
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(ours) == wanted(rows)
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    result = duck.execute(queries.ORACLE_SQL["op12_repair"])
    assert [d[0] for d in result.description] == ours.columns
    assert {x[0]: x[1:] for x in result.fetchall()} == got(ours)
