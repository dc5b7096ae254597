"""Each operator against its plain version, on words with copies, nulls, empty, long and odd texts."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkburst.llm import arrow_text, chat, decontamination, graph, language, near_sets, ngram_join, packing, privacy, quality, sharding, substrings, suffix_sort, token_counts
from sparkburst.llm.columns import running_sum
from sparkburst.llm.packing import token_ids

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text): random words, exact and near copies, shared passages, and odd cases."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8))) for _ in range(150)] + ["Été", "straße", "ñandú", "日本", "🙂"]
    word = lambda: r.choice(vocabulary)
    passage = " ".join(word() for _ in range(60))
    docs: list[tuple] = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and docs:
            text = r.choice(docs)[1]
        elif kind < 0.4 and docs:
            w = (r.choice(docs)[1] or "").split(" ")
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            text = r.choice([" ", "\n", "\t "]).join(word() for _ in range(r.randrange(1, 120)))
            if kind < 0.55:
                text += " " + passage
        docs.append((i, text))
    odd = [None, "", "   ", "one", "two words", "A a A", "x" * 3000, " ".join(["again"] * 400), "\n".join(["same line here"] * 30)]
    docs += [(n + k, t) for k, t in enumerate(odd)]
    docs += [(None, docs[3][1]), (None, None), docs[5], docs[5]]
    return docs


def frame(spark, docs, **more):
    rows = [(i, t, "en", "s", 0, "clash", "clash") for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def key(row):
    return tuple((x is None, x) for x in row)


def test_substrings(spark, docs):
    got = substrings.remove(frame(spark, docs)).drop("kept").collect()
    want = [(i, *x) for (i, _), x in zip(docs, brute.removed([t for _, t in docs]), strict=True)]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert substrings.remove(frame(spark, [])).count() == 0


@pytest.mark.parametrize("many", [0, 2])
def test_substrings_short_and_frequent_anchors(spark, docs, many, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_SEGMENTS", many)
    got = substrings.remove(frame(spark, docs), length=40, kmer=12).drop("kept").collect()
    want = [(i, *x) for (i, _), x in zip(docs, brute.removed([t for _, t in docs], 40), strict=True)]
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("few", [0, 64])
@pytest.mark.parametrize("memory", [16, 1 << 20])
def test_suffix_order(memory, few, monkeypatch):
    """Order and common prefixes; strings of names by queues (few = 0) and entry by entry."""
    monkeypatch.setattr(suffix_sort, "_FEW", few)
    rng = np.random.default_rng(3)
    for _ in range(150):
        t = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 60)).astype(np.uint8)
        b, cap = t.tobytes(), int(rng.integers(1, 12))
        order, common = suffix_sort.sorted_suffixes(t, cap, memory)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert order.tolist() == want
        for k in range(1, len(b)):
            x, y = b[want[k - 1] :], b[want[k] :]
            assert common[k] == next((m for m in range(min(len(x), len(y), cap)) if x[m] != y[m]), min(len(x), len(y), cap))


def test_queues_go_to_disk_and_back():
    text = np.frombuffer(" ".join(t or "" for _, t in corpus(3, 400)).encode(), dtype=np.uint8)
    spilled = []
    close = suffix_sort.Queues.close

    def closing(self):
        spilled.append(self.spilled)
        close(self)

    suffix_sort.Queues.close = closing
    try:
        order, common = suffix_sort.sorted_suffixes(text, 50, len(text) // 2)
    finally:
        suffix_sort.Queues.close = close
    assert sum(spilled) > 4 * len(text) and np.array_equal(order, suffix_sort.suffix_order(text)) and common.max() == 50


def test_substrings_in_one_shard_beyond_the_queues(spark):
    """A shard of over half a megabyte: eight bytes an entry are over four times what its queues may hold."""
    r = random.Random(2)
    shared = "".join(r.choice("abcdefghij ") for _ in range(70))
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    around = [(noise(150), noise(150)) for _ in range(300)]
    docs = [(i, a + shared + b[: r.randrange(120, 150)]) for i, (a, b) in enumerate(r.choice(around) if i % 3 == 0 else (noise(150), noise(150)) for i in range(2000))]
    got = substrings.remove(frame(spark, docs)).drop("kept").collect()
    want = [(i, *x) for (i, _), x in zip(docs, brute.removed([t for _, t in docs]), strict=True)]
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(x[2] > 0 for x in want) > 300


def test_hashes_do_not_depend_on_place():
    column = pa.array(["a b c d e", "xx a b c d e", None, "a b c d e"])
    out = []
    for limit in (1, 1 << 20):
        for _, _, data, offsets in arrow_text.chunks(column, limit):
            s, e, b = arrow_text.word_bounds(data, offsets)
            h, at = arrow_text.shingle_hashes(arrow_text.span_hashes(data, s, e), b, 4)
            out += [set(h[at[i] : at[i + 1]].tolist()) for i in range(len(at) - 1)]
    assert out[0] == out[3] == out[4] == out[7] and out[0] < out[1] and out[2] == set()


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, docs, size, percent):
    got = ngram_join.join(frame(spark, docs), size, percent).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.components(docs, size, percent)))


def test_ngram_join_beyond_broadcasts(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    got = ngram_join.join(frame(spark, docs), 5, 80).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.components(docs, 5, 80)))


def test_ngram_join_in_parts(spark, docs, monkeypatch):
    """Frequent shingles and large families are shared by several tasks."""
    for name, value in (("POSTINGS_IN_BLOCK", 3), ("SETS_IN_BLOCK", 4), ("HUBS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.join(frame(spark, docs), 2, 50).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute.components(docs, 2, 50)))


def near_family(n: int, seed: int = 9) -> list[np.ndarray]:
    """Sets of 100 of which a pair shares some 87 to 93: about the threshold of 0.8."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    out = []
    for _ in range(n):
        s = base.copy()
        k = rng.integers(2, 9)
        s[rng.choice(100, k, replace=False)] = rng.integers(0, 1 << 63, k).astype(np.uint64)
        out.append(np.unique(s))
    return out


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_linked_sets(percent):
    sets = near_family(120) + near_family(60, 10)
    labels = near_sets.linked(sets, np.arange(len(sets)), percent)
    joined = near_sets.Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                joined.union(i, j)
    want = [joined.find(i) for i in range(len(sets))]
    assert all((labels[i] == labels[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


@pytest.mark.parametrize("n", [5, 200, 400])
def test_pairs_of_a_family_stay_fewer_than_its_members(n):
    sets = near_family(n)
    rows = near_sets.Postings(np.arange(n), np.array([len(s) for s in sets]), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [near_sets.sketch(s) for s in sets], 80)
    a, b = near_sets.forest(np.zeros(n, dtype=np.int64), rows)
    assert 0 < len(a) == len(b) < n


def test_ngram_join_edges(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    kept = ngram_join.representatives(frame(spark, [(1, "a b c"), (2, "a b c"), (1, "a b c"), (None, "a b c"), (3, None)]))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(key((r["doc_id"],)) for r in kept.collect()) == sorted(map(key, [(1,), (3,), (None,)]))


def test_representatives_of_clashing_ids(spark):
    copied, other, lone = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    docs = [(1, copied), (5, copied), (5, other), (7, lone), (7, other + " x y z"), (7, lone), (8, ""), (8, None), (8, "")]
    want = {(1, copied), (5, other), (7, lone), (7, other + " x y z"), (8, ""), (8, None)}
    got = [(r["doc_id"], r["text"]) for r in ngram_join.representatives(frame(spark, docs)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    # the least doc_id of a component has two texts in it: one of them stays
    near = " ".join(f"w{k}" for k in range(40))
    got = ngram_join.representatives(frame(spark, [(1, near), (1, near + " more"), (2, near)])).collect()
    assert len(got) == 1 and got[0]["doc_id"] == 1


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100 + i, 130) for i in range(9)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[i] == 100 for i in [*range(100, 109), 130])
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_quality(spark, docs):
    out = quality.judge(frame(spark, docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(key, out.collect())) == sorted(key((i, *brute.quality(t))) for i, t in docs)
    assert quality.judge(frame(spark, [])).count() == 0


def test_quality_verdicts(spark, docs):
    votes = list(quality.rules())
    rows = quality.features(frame(spark, docs)).withColumns(quality.rules()).collect()
    odds = brute.log_odds([[r[k] for k in votes] for r in rows])
    want = []
    for r, x in zip(rows, odds, strict=True):
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        want.append((r["doc_id"], r["n_words"], r["n_symbols"], not failed and x >= 0, f"{1 / (1 + np.exp(-x)):.9f}"))
    got = [(r["doc_id"], r["n_words"], r["n_symbols"], r["kept"], f"{r['posterior']:.9f}") for r in quality.judge(frame(spark, docs)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want)) and len({x[3] for x in want}) == 2


def test_quality_learns_accuracies():
    r = random.Random(2)
    rows = []
    for _ in range(4000):
        good = r.random() < 0.8
        rows.append((good, [(1 if good else -1) * (1 if r.random() < acc else -1) if r.random() < 0.8 else 0 for acc in (0.95, 0.9, 0.85, 0.6)]))
    a = quality.estimate([(v, 1) for _, v in rows], 4)
    right = sum((a.posterior(v) >= 0.5) == good for good, v in rows) / len(rows)
    assert right > 0.93 and a.good[0] > a.good[3] and 0.7 < a.prior < 0.9
    assert quality.estimate([], 4).prior == 0.7


PII_TEXTS = [
    "mail a.b+c@x-y.co.uk, and d@e.f_g@h.i end", "a@b@c.d", "10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 12345", "+1 (743) 555-3824 +49 30 1234 +1234567890123456",
    "é🙂 x@y.zz \x01 1.1.1.1 \x02 +1 212 555 0000", "0" * 500, "9" * 16 + " " + "1 " * 200, "@" * 50 + "a" * 5000 + "@", "+1" + " (" * 300, "0.0.0.0000000255 1.1.1.256", None, "", "nothing at all",
]


def spans_of(spark, docs):
    return [(r["doc_id"], r["s"]) for r in privacy.find(frame(spark, docs)).select("doc_id", privacy.listed(F.col("spans")).alias("s")).collect()]


def test_privacy(spark):
    docs = list(enumerate(PII_TEXTS)) + [(None, PII_TEXTS[0]), (0, PII_TEXTS[0])]
    out = privacy.find(frame(spark, docs)).select("doc_id", privacy.listed(privacy.base_spans(F.col("spans"))).alias("s"))
    assert sorted(map(key, out.collect())) == sorted(map(key, [(i, brute.personal(t)) for i, t in docs]))
    assert privacy.find(frame(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, "x@y.zz", "a", "b", "c", "d", "e")], "doc_id long, text string, row string, spans string, plain string, doc string, email string")
    clean = privacy.sanitise(clash)
    assert clean.columns == clash.columns and tuple(clean.first()) == (1, "<EMAIL>", "a", "b", "c", "d", "e")
    assert privacy.find(clash).first()["row"] == "a" and len(privacy.find(clash).first()["spans"]) == 1


def people(seed: int = 4, n: int = 300) -> list[tuple]:
    """Texts of common words; some hold an address beside a name that stands in few others."""
    r = random.Random(seed)
    common = [f"{a}{b}" for a in "ba ko mi tu se la".split() for b in "ran tol mek sif".split()]
    docs = []
    for i in range(n):
        w = [r.choice(common) for _ in range(r.randrange(5, 60))]
        if i % 9 == 0:
            name = f"Zor{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'aeiou'[i % 5]}l"
            w[3:3] = r.choice([[name, f"<{name.lower()}@corp{i % 4}.example>"], ["Li", f"{name}({name}@x{i}.org)"], [name, "call", f"+49 30 555 {1000 + i}"], [name, f"10.{i % 250}.2.3"]])
            w.append(r.choice([name, name.upper(), ""]))
        docs.append((i, " ".join(w)))
    return docs + [(1000, None), (1001, ""), (None, docs[0][1]), (0, docs[0][1])]


def test_privacy_terms_against_plain_counts(spark):
    docs = people()
    want = brute.disclosed([t for _, t in docs])
    assert sorted(map(key, spans_of(spark, docs))) == sorted(map(key, [(i, s) for (i, _), s in zip(docs, want, strict=True)]))
    assert sum("term:" in s for s in want) > 20


def test_privacy_finds_planted_names_and_leaves_common_words(spark):
    docs = people()
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(frame(spark, docs)).collect()}
    held = [(i, t) for i, t in docs if t and ("Zor" in t or "zor" in t)]
    caught = sum("zor" not in clean[i].lower() for i, _ in held)
    assert caught / len(held) > 0.95
    words_gone = sum(len(t.split()) - len(clean[i].split()) for i, t in docs if t)
    assert words_gone >= 0 and all(clean[i] == t for i, t in docs if t is None or not ("Zor" in t or "zor" in t))
    kept = sum(w in clean[i].split() for i, t in held for w in t.split() if w.isalpha() and w.islower() and not w.startswith("zor"))
    assert kept / sum(1 for _, t in held for w in t.split() if w.isalpha() and w.islower() and not w.startswith("zor")) > 0.97


def test_privacy_generalises(spark):
    common = "the report of this week was read by all of them with great care and much interest today zoo"
    docs = [(i, f"{common} {i} nothing of note") for i in range(200)]
    docs += [(500 + i, f"{w} zebrafish reach him at boss@corp.example or {w} leave a note {i}") for i, w in enumerate(["monday", "tuesday", "friday", "sunday"])]
    docs += [(600, "the xylophone stands at one@only.example")]
    out = dict(spans_of(spark, docs))
    assert all("email" in out[500 + i] and "term:" in out[500 + i] for i in range(4)) and all(out[i] == "" for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(frame(spark, docs)).collect()}
    assert clean[0] == docs[0][1] and "boss" not in clean[500] and "zebrafish" not in clean[500]
    assert "z." in clean[500].split() and "<EMAIL>" in clean[500]  # many terms begin with z
    assert "<TERM>" in clean[600] and "xylophone" not in clean[600]  # x itself would tell
    assert privacy.sanitise(frame(spark, docs)).columns == frame(spark, docs).columns


def test_running_sum(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(running_sum(F.lit([1] * n) if n else F.array().cast("array<long>")).alias("s") if not n else running_sum(F.sequence(F.lit(1), F.lit(n)).cast("array<long>")).alias("s")).first()["s"]
        assert got == np.cumsum(np.arange(1, n + 1)).tolist()


def test_token_counts(spark, docs):
    pieces = dict(token_counts.vocabulary())
    texts = [*docs, (900, "é" * 400 + " tail"), (901, "a  b\n\n c\t")]
    got = token_counts.count(frame(spark, texts)).collect()
    assert sorted(map(key, got)) == sorted(key((i, *brute.tokens(t, pieces))) for i, t in texts)
    assert token_counts.count(frame(spark, [])).count() == 0


def test_token_counts_of_long_pretokens(spark):
    pieces = dict(token_counts.vocabulary())
    r = random.Random(8)
    chinese = "".join(chr(r.randrange(0x4E00, 0x4F00)) for _ in range(700))
    url = "https://example.org/" + "/".join("path" + str(r.randrange(1000)) for _ in range(120))
    texts = [(1, chinese), (2, url + " tail"), (3, "x" * 3000), (4, "é" * 400 + " tail"), *[(10 + k, chinese[k:] + url[: 5 * k]) for k in range(100)]]
    got = token_counts.count(frame(spark, texts)).collect()
    longest = max(len(t.encode()) for _, t in texts)
    assert sorted(map(key, got)) == sorted(key((i, *brute.tokens(t, pieces, longest))) for i, t in texts)


def test_token_counts_forget():
    texts = pa.array([t for _, t in corpus(4)])
    a, b = (token_counts.Counter(token_counts.vocabulary()) for _ in range(2))
    b_limit, token_counts.REMEMBERED = token_counts.REMEMBERED, 50
    try:
        few = [b.texts(texts.slice(k, 5))[1].tolist() for k in range(0, len(texts), 5)]
    finally:
        token_counts.REMEMBERED = b_limit
    assert sum(few, []) == a.texts(texts)[1].tolist()


def test_packing_round_trip(spark, docs):
    texts = [*docs, (990, "word " * 6000), (991, "<|endoftext|> inside"), (992, "y" * 20000)]
    rows = packing.pack(frame(spark, texts)).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, versions in ids.items():
        assert sum(r["length"] for r in by_doc[i]) == sum(map(len, versions))
        if len(versions) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(versions[0])
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(versions[0][r["start"] : at].tobytes())
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 2048 * 3
    groups = {}
    for r in rows:
        groups.setdefault((r["tier"], r["step_group"]), set()).add(r["sequence_id"])
    for tier in packing.TIERS:
        sizes = [len(v) for (t, _), v in sorted(groups.items()) if t == tier]
        assert all(n == packing.STEP_TOKENS // tier for n in sizes[:-1])
    assert len({g for _, g in groups}) == len(groups)
    assert packing.pack(frame(spark, [])).count() == 0


def test_encoders_agree():
    r = random.Random(3)
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(500):
        t = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(9, 14), 32, 39, r.randrange(0xA0, 0x3000), r.randrange(0x1F600, 0x1F640), 0x85, 0xA0, 0x2028])) for _ in range(r.randrange(40)))
        assert token_ids(t, "byte_bpe_50k").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bucket", [3, 2000])
def test_sharding(spark, docs, bucket, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    rows = [(i, t, None, "big" if k % 3 else f"s{k % 5}", 0, None, None) for k, (i, t) in enumerate(docs)] + [(5000, None, None, None, 0, None, None)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=7).collect()
    assert len(out) == len(rows)
    sizes = [sum(r["shard"] == s for r in out) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
        big = sum(r["shard"] == s and r["source"] == "big" for r in out)
        assert abs(big - sum(r["source"] == "big" for r in out) / 7) <= 3
    # many sources of one row each spread over all shards
    small = spark.createDataFrame([(i, "t", None, f"own{i}", 0, None, None) for i in range(350)], SCHEMA)
    counts = [r["count"] for r in sharding.shard(small, shards=7).groupBy("shard").count().collect()]
    assert counts == [50] * 7
    text = {i: t for i, t in docs if i is not None}
    for r in out:
        if r["doc_id"] in text:
            raw = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language(spark):
    r = random.Random(5)
    words = {"aa": "ba ka ma na".split(), "bb": "ost ulk erg inz".split(), "cc": "éta çon ñip òru".split()}
    rows = []
    for i in range(300):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join(r.choice(words[lang]) + r.choice(["", "x", "o"]) for _ in range(r.randrange(5, 60))), lang, "s", 0, None, None))
    df = spark.createDataFrame(rows + [(400, None, None, None, 0, None, None), (401, "123 !!", None, None, 0, None, None), (None, "ba ka ma", "aa", None, 0, None, None)], SCHEMA)
    model = language.train(df)
    out = language.identify(df, model).withColumn("held", language.in_fold(F.col("doc_id"))).collect()
    held = [x for x in out if x["held"] and x["lang"]]
    assert len(held) > 30 and sum(x["lang"] == x["lang_pred"] for x in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 for x in out)
    odd = {x["doc_id"]: x for x in out if x["doc_id"] in (400, 401)}
    assert all(x["lang_pred"] == "und" and x["score"] == 0 and x["rejected"] for x in odd.values())
    none = language.train(df.where("lang is null"))
    assert {x["lang_pred"] for x in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.where("false"), model).count() == 0
    assert len(language.accepted(df, model).columns) == len(df.columns) and language.accepted(df, model).where("doc_id in (400, 401)").count() == 0
    clash = language.identify(df.withColumn("judged", F.lit("mine")).withColumn("SCORE_", F.lit(1)), model)
    assert clash.columns[-5:] == ["judged", "SCORE_", "lang_pred", "score", "rejected"] and clash.first()["judged"] == "mine"
    held_text = df.withColumn("text", F.when(language.in_fold(F.col("doc_id")), "zzz").otherwise(F.col("text")))
    assert np.array_equal(language.train(held_text).table, model.table)


def made_languages(seed: int, n: int, letters: dict[str, str]) -> list[tuple[str, str]]:
    """(language, text): words of each language's own syllables."""
    r = random.Random(seed)
    syllables = {lang: [a + b + c for a in x for b in "aeiou" for c in ("", x[0], x[-1])] for lang, x in letters.items()}
    text = lambda lang: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(8, 60)))
    return [(lang, text(lang)) for lang in letters for _ in range(n)]


def test_language_rejects_what_it_never_saw():
    known = made_languages(1, 150, {"aa": "bdkm", "bb": "glnr", "cc": "pstv", "dd": "fhjw"})
    strange = made_languages(2, 80, {"zz": "xqcz"})
    bags = next(iter(language._bags([pa.RecordBatch.from_arrays([pa.array([x for x, _ in known]), pa.array(range(len(known))), pa.array(range(len(known))), pa.array([t for _, t in known])], names=list("abcd"))], language.BUCKETS)))
    rows = list(zip(bags.column(0).to_pylist(), map(np.array, bags.column(3).to_pylist()), map(np.array, bags.column(4).to_pylist()), strict=True))
    model = language.fit(rows)
    fresh = made_languages(3, 60, {"aa": "bdkm", "bb": "glnr", "cc": "pstv", "dd": "fhjw"})
    best, score = model.predict(pa.array([t for _, t in fresh]))
    assert np.mean([model.languages[b] == x for b, (x, _) in zip(best, fresh, strict=True)]) > 0.98 and np.mean(score < model.threshold) < 0.02
    assert np.mean(model.predict(pa.array([t for _, t in strange]))[1] < model.threshold) > 0.9
    # the probability means what it says, in ten bins
    right = np.array([model.languages[b] == x for b, (x, _) in zip(best, fresh, strict=True)])
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(score[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))
    assert error < 0.1


def test_decontamination(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 6))) for _ in range(300)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(r.randrange(1, 80)))) for i in range(30)] + [(98, None), (99, "")]
    docs = []
    for i in range(80):
        w = words(r.randrange(0, 400))
        if i % 4 == 0:
            item = items[i // 4][1].split()
            if i % 8 == 0 and len(item) > 30:
                item[r.randrange(len(item))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((i, " ".join(w).upper() if i % 3 == 0 else "  ".join(w)))
    docs += [(None, items[1][1]), (200, None), (201, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def leaks():
        for i, t in docs:
            have = (t or "").lower().split()
            for j, text in items:
                want = (text or "").split()
                if want:
                    k = min(5, len(want))
                    part = [tuple(want[x : x + k]) for x in range(len(want) - k + 1)]
                    found = {tuple(have[x : x + k]) for x in range(len(have) - k + 1)}
                    if sum(p in found for p in part) >= 0.8 * len(part):
                        yield i, j

    got = [(x["doc_id"], x["item_id"]) for x in decontamination.leaks(frame(spark, docs), bench).collect()]
    assert sorted(map(key, got)) == sorted(map(key, leaks()))
    bad = {i for i, _ in leaks()}
    clean = decontamination.clean(frame(spark, docs), bench)
    assert sorted(key((x["doc_id"],)) for x in clean.collect()) == sorted(key((i,)) for i, _ in docs if i not in bad)
    assert clean.columns == frame(spark, docs).columns
    assert decontamination.leaks(frame(spark, docs), bench.where("false")).count() == 0
    assert decontamination.leaks(frame(spark, []), bench).count() == 0


def test_decontamination_with_asides(spark):
    item = [f"w{k}" for k in range(64)]
    aside = [f"aside{k}" for k in range(24)]
    docs = [(at, " ".join([f"before{k}" for k in range(at)] + item[:32] + aside + item[32:] + ["after"] * 90)) for at in range(0, 128, 4)]
    docs += [(500 + n, " ".join(f"s{n}x{k}" for k in range(n - 1)) + " altered") for n in (9, 14)]
    docs += [(900, " ".join(item[:32]))]
    items = [(1, " ".join(item))] + [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in (9, 14)]
    got = decontamination.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == sorted([(i, 1) for i, _ in docs if i < 128] + [(509, 9), (514, 14)])
    assert all(x["overlap"] == pytest.approx(56 / 60) for x in got if x["item_id"] == 1)


def test_decontamination_in_slices(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} has words of its own {i * 7} and {i * 11} end") for i in range(20)], "item_id long, text string")
    docs = frame(spark, [(i, f"before item number {i} has words of its own {i * 7} and {i * 11} end after") for i in range(20)])
    rounded = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontamination.leaks(docs, items).collect())
    whole = rounded()
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 200)
    assert rounded() == whole  # scores too: they are those of the whole benchmark
    assert [r[:2] for r in whole if r[0] == r[1]] == [(i, i) for i in range(20)]


def test_block_max_walk_loses_nothing_and_skips(monkeypatch):
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(r.choice(vocabulary[: 40 + i]) for _ in range(r.randrange(5, 60)))) for i in range(300)]
    index = decontamination.Benchmark(rows).indexes[0]
    scored = []
    weight = decontamination._Cursor.weight
    monkeypatch.setattr(decontamination._Cursor, "weight", lambda self: scored.append(self.now) or weight(self))
    looked_at = 0
    for _ in range(40):
        terms = np.array(sorted(r.sample(range(len(index.vocabulary)), r.randrange(1, 120))))
        have = set(terms.tolist())
        sums = [sum(w for t, w in zip(i.terms.tolist(), i.weights.tolist(), strict=True) if t in have) for i in index.items]
        scored.clear()
        got = {k: x for b in range(index.maxima.shape[1]) for k, x in index.walk(terms, b)}
        assert set(got) == {k for k, x in enumerate(sums) if x >= 1 - 1e-9} and all(abs(got[k] - sums[k]) < 1e-9 for k in got)
        looked_at += len(set(scored))
        assert {k: x for b in range(index.maxima.shape[1]) for k, x in index.whole(terms, b)} == pytest.approx(got)
    assert looked_at < 0.5 * 40 * len(index.items)
    texts = pa.array([t for _, t in rows[:50]] + ["before " + rows[7][1] + " after"])
    found = decontamination.Benchmark(rows).search(texts)
    monkeypatch.setattr(decontamination, "_WHOLE", 0)
    walked = decontamination.Benchmark(rows).search(texts)
    assert [{k: pytest.approx(v) for k, v in x.items()} for x in walked] == found


def call(i, name, depends=(), **arguments):
    return "<tool_call>" + json.dumps({"name": name, "id": i, "arguments": arguments, "depends_on": list(depends)}) + "</tool_call>"


def test_chat(spark):
    turns = [
        (1, 0, "user", "find \"it\" é"),
        (1, 1, "assistant", "ok " + call("b", "fetch", ["a"], url="u") + call("a", "search", query="q", limit=3)),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "found"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "page"})),
        (1, 4, "assistant", call("a", "search", query=5, more=1) + "<tool_call>{broken</tool_call>" + call("x", "run", ["y"], code="c", timeout=1.5) + call("y", "unknown", ["x"])),
        (1, 70, "user", None), (1, 70, "user", None), (None, 0, "user", "lost"), (2, None, None, "no turn"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    calls = {(r["turn"], r["position"]): r for r in chat.link(df).collect()}
    assert calls[1, 1]["status"] == calls[1, 0]["status"] == "linked" and (calls[1, 1]["level"], calls[1, 0]["level"]) == (0, 1)
    assert calls[1, 1]["arguments"] == '{"limit":3,"query":"q"}' and calls[1, 1]["faults"] == [] and calls[1, 1]["result_turn"] == 2
    assert calls[4, 0]["status"] == "duplicate" and calls[4, 0]["faults"] == ["type:query", "unknown:more"]
    assert calls[4, 1]["status"] == "malformed" and calls[4, 2]["status"] == calls[4, 3]["status"] == "cycle"
    assert calls[4, 2]["faults"] == [] and calls[4, 3]["faults"] == ["unknown_tool"]
    out = chat.render(df).collect()
    first = next(r for r in out if r["conv_id"] == 1 and r["segment"] == 0)
    body = json.loads(first["chat"])["messages"]
    assert [m["role"] for m in body] == ["user", "assistant", "tool", "tool", "assistant"] and first["n_calls"] == 6 and first["n_valid"] == 2
    assert [c["id"] for c in body[1]["tool_calls"]] == ["a", "b"] and body[1]["content"] == "ok" and body[2]["content"] == "found"
    assert next(r for r in out if r["segment"] == 1)["chat"] == '{"messages":[{"content":"","role":"user","turn":70}]}'
    assert sum(r["n_messages"] for r in out) == 8
    assert '"arguments":{"limit":3,"query":"q"}' in first["chat"]
    whole = [r for r in chat.render(df, segment=None).collect() if r["conv_id"] == 1]
    assert len(whole) == 1 and whole[0]["n_messages"] == 6 and whole[0]["n_calls"] == 6
    assert chat.render(df.where("false")).count() == 0


def test_chat_loses_no_call(spark):
    turns = [
        (None, 0, "assistant", "a " + call("a", "search", query="q")), (None, 0, "assistant", "b " + call("a", "search", query="r")),
        (3, None, "assistant", "c " + call("c", "search", query="s")), (4, 1, "assistant", "x <tool_call>{broken</tool_call>"),
        (5, 1, "assistant", "one " + call("p", "fetch", url="u")), (5, 1, "assistant", "two " + call("q", "fetch", url="v")), (5, 2, "tool", json.dumps({"tool_call_id": "p", "content": "found"})),
    ]
    out = chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"] or 0, r["n_messages"], r["n_calls"], r["n_valid"]) for r in out) == [(0, 1, 1, 0), (0, 1, 1, 0), (3, 1, 1, 0), (4, 1, 1, 0), (5, 3, 2, 1)]
    messages = {m["content"]: m for r in out for m in json.loads(r["chat"])["messages"]}
    assert [messages["a"]["tool_calls"][0]["arguments"], messages["b"]["tool_calls"][0]["arguments"]] == [{"query": "q"}, {"query": "r"}]
    assert [messages[k]["tool_calls"][0]["status"] for k in "abc"] == ["unanswered"] * 3
    assert messages["x"]["tool_calls"][0]["status"] == "malformed" and messages["x"]["tool_calls"][0]["body"] == "{broken"
    assert [[c["id"] for c in messages[k]["tool_calls"]] for k in ("one", "two")] == [["p"], ["q"]]


def test_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    docs = [(i, f"{t} and some more plain words so that it is long enough {i}") for i, t in corpus(7, 25) if t and i is not None and i < 25]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "one item of the benchmark that nobody has seen")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, str(tmp_path))
        assert out.columns == current.columns, name
        current = spark.createDataFrame(out.collect(), out.schema)
    kept = {r["doc_id"] for r in current.collect()}
    brute_kept = {i for i, _, c in brute.components(docs, 5, 80) if i == c}
    assert kept == brute_kept
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(kept)
