"""Many rows of one doc_id, and calls and results in any order."""

import json
import random
from collections import defaultdict

import pytest

from sparkburst.llm import chat, ngram_join

from . import brute
from .test_llm import call, frame, key


def copies(n, ids=1):
    r = random.Random(n)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(n):
        words = list(base)
        words[r.randrange(200)] = f"own{k}"
        docs.append((k % ids, " ".join(words)))
    return docs


@pytest.mark.parametrize("n", [50, 100, 200])
def test_sets_grow_with_the_rows(spark, n, monkeypatch):
    made, real = [], ngram_join._sets

    def counted(*a):
        out = real(*a)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_sets", counted)
    docs = copies(n) + [(1, "another text of some words that nobody else has")] + copies(20, 20)[:1] * 30
    got = ngram_join.join(frame(spark, docs), size=4, percent=85).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.components(docs, 4, 85)))
    assert made[0] <= n + 2  # one for each different text, however many rows share the id


def plain_calls(turns):
    """(conv, turn, position) -> (id, status, result_turn, level, depends_on) of conversations without nulls."""
    out = {}
    by_conv = defaultdict(list)
    for x in dict.fromkeys(turns):
        by_conv[x[0]].append(x)
    for conv, rows in by_conv.items():
        calls, answers = [], defaultdict(list)
        for _, turn, role, text in rows:
            if role == "tool":
                answers[json.loads(text)["tool_call_id"]].append(turn)
            for k, body in enumerate(text.split("<tool_call>")[1:]):
                try:
                    c = json.loads(body.split("</tool_call>")[0])
                except ValueError:
                    c = {}
                needs = c.get("depends_on", [])
                calls.append((turn, k, c.get("id"), needs if isinstance(needs, list) else [needs if isinstance(needs, str) else json.dumps(needs)]))
        calls.sort(key=lambda x: x[:2])
        needs = defaultdict(set)
        ids = {c[2] for c in calls if c[2] is not None}
        for c in calls:
            needs[c[2]] |= set(c[3]) & ids
        level = {}
        for _ in ids:
            level |= {i: 1 + max((level[x] for x in needs[i]), default=-1) for i in ids - set(level) if needs[i] <= set(level)}
        seen = set()
        for turn, k, i, depends in calls:
            later = [t for t in answers[i] if t >= turn]
            status = "malformed" if i is None else "duplicate" if i in seen else "cycle" if i not in level else "linked" if later else "unanswered"
            seen.add(i)
            out[conv, turn, k] = (i, status, min(later) if status == "linked" else None, level.get(i) if i else None, depends)
    return out


def test_links_against_plain_version(spark):
    r = random.Random(9)
    turns = []
    for conv in range(40):
        names = [f"c{k}" for k in range(r.randrange(1, 6))]
        for turn in range(r.randrange(2, 9)):
            if r.random() < 0.5:
                blocks = []
                for _ in range(r.randrange(1, 3)):
                    i = r.choice(names)
                    needs = r.choice([[], [r.choice(names)], r.choice(names), r.sample(names, min(2, len(names))), 7, ["absent"]])
                    blocks.append("<tool_call>{broken</tool_call>" if r.random() < 0.1 else "<tool_call>" + json.dumps({"name": "fetch", "id": i, "arguments": {"url": "u"}, "depends_on": needs}) + "</tool_call>")
                turns.append((conv, turn, "assistant", "said " + "".join(blocks)))
            else:
                turns.append((conv, turn, "tool", json.dumps({"tool_call_id": r.choice(names), "content": "c"})))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn, x.position): (x.call_id, x.status, x.result_turn, x.level, x.depends_on) for x in chat.link(df).collect()}
    want = plain_calls(turns)
    assert got == want
    assert {x[1] for x in want.values()} == {"linked", "unanswered", "duplicate", "cycle", "malformed"}
    rendered = chat.render(df, segment=None).collect()
    said = {(x["conv_id"], m["turn"], c["id"]): c["status"] for x in rendered for m in json.loads(x["chat"])["messages"] for c in m.get("tool_calls", []) if c["status"] == "linked"}
    assert said == {(conv, turn, v[0]): "linked" for (conv, turn, _), v in want.items() if v[1] == "linked"}
    assert sum(x["n_calls"] for x in rendered) == len(want)


def test_result_before_its_call(spark):
    turns = [(1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "stale"})), (1, 3, "assistant", call("a", "fetch", url="u")), (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "right"}))]
    got = chat.link(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [(x.status, x.result_turn) for x in got] == [("linked", 4)]
