"""Plain versions that the operators are held against."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(texts: list[str | None], length: int = 200) -> list[tuple]:
    """(bytes, removed, spans, digest of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    found = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if found[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def shingles(text: str | None, size: int) -> set:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(docs: list[tuple], size: int, percent: int) -> list[tuple]:
    """(doc_id, set size, component) of each (doc_id, text)."""
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and docs[a][0] is not None and docs[b][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(s), None if i is None else least[root(k)]) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    seen: set = set()
    again = 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    where = defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k : k + 8])].append(k)
    covered = {x for v in where.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text: str | None) -> str:
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                good = 12 <= len(digits) <= 19 and luhn(digits)
            else:
                good = kind == "email" or 9 <= len(digits) <= 15
            if good:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(PII)[k]}:{a}:{b}" for a, k, b in sorted(out))


def tokens(text: str | None, pieces: dict[bytes, int], longest: int = 1 << 30) -> tuple[int, int]:
    """(pre-tokens, tokens) by a plain search for the best segmentation of every pre-token."""
    b = (text or "").encode()
    reach = max(map(len, pieces))

    def best(w: bytes) -> int:
        score = [(0, 0)] + [None] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - reach), e):
                p = pieces.get(w[s:e])
                if p is not None and (score[e] is None or (score[s][0] + p, score[s][1] - 1) > score[e]):
                    score[e] = (score[s][0] + p, score[s][1] - 1)
        return -score[-1][1]

    pre = total = at = 0
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", b):
        start = m.start() - (m.start() > 0 and b[m.start() - 1] == 32)
        pre, total = pre + start - at, total + start - at
        w, at = b[start : m.end()], m.end()
        for k in range(0, len(w), longest):
            total, pre = total + best(w[k : k + longest]), pre + 1
    return pre + len(b) - at, total + len(b) - at


def disclosed(texts: list[str | None], share: float = 0.85, context: int = 8) -> list[str]:
    """All spans of each text with the terms that disclose an entity, by plain counts over the rows."""
    plain = [(t or "").replace("\x01", "\x03").replace("\x02", "\x03") for t in texts]
    term = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}_'-]+")

    def terms(ws: list[str]) -> set[str]:
        bare = (regex.sub(r"^[^\p{L}]+|[^\p{L}\p{M}\p{N}]+$", "", w).lower() for w in ws)
        return {w for w in bare if term.fullmatch(w)}

    def items(kind: str, m: str) -> tuple[str, str]:
        digits = re.sub("[^0-9]", "", m)
        value = {"email": m.lower(), "ip": m}.get(kind, digits)
        return f"{kind}:{value}", f"{kind}*" + {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": value[:6], "phone": value[:4]}[kind]

    holds: list[dict[str, set]] = []
    for t in plain:
        good = set(personal(t).split(","))
        mine: dict[str, set] = defaultdict(set)
        for kind, pattern in PII.items():
            found = list(re.finditer(pattern, t))
            for i, m in enumerate(found):
                if f"{kind}:{m.start()}:{m.end()}" in good:
                    before = re.split(r"[\x20\x09-\x0D]+", t[found[i - 1].end() if i else 0 : m.start()].rstrip(" "))[-context:]
                    after = re.split(r"[\x20\x09-\x0D]+", t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)].lstrip(" "))[:context]
                    for item in items(kind, m[0]):
                        mine[item] |= terms(before) | terms(after)
        holds.append(mine)
    n = len(texts)
    n_entity = Counter(e for mine in holds for e in mine)
    n_both = Counter((e, t) for mine in holds for e, ts in mine.items() for t in ts)
    n_near = Counter(t for mine in holds for t in set().union(*mine.values()))
    said = [terms(WORD.findall(t)) for t in plain]
    n_term = Counter(t for ts in said for t in ts)
    n_initial = Counter(c for ts in said for c in {t[0] for t in ts})
    log = lambda both, of, e: math.log2(both * n / (n_entity[e] * (of + 1))) / math.log2(n / n_entity[e])
    over = {}
    for (e, t), both in n_both.items():
        if n > n_entity[e] and log(both, max(n_near[t], n_term[t]), e) >= share:
            over[e, t] = log(n_entity[e], n_initial[t[0]], e) < share
    out = []
    for t, mine in zip(plain, holds, strict=True):
        base = [x for x in personal(t).split(",") if x]
        gone = {w for e, w in over if e in mine}
        taken = [tuple(map(int, x.split(":")[1:])) for x in base]
        if gone:
            pattern = r"(?i)(?<![\p{L}\p{M}\p{N}_'-])(?:" + "|".join(map(regex.escape, sorted(gone))) + r")(?![\p{L}\p{M}\p{N}_'-])"
            for m in regex.finditer(pattern, t):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    base.append(f"term:{m.start()}:{m.end()}")
        kinds = [*PII, "term"]
        out.append(",".join(sorted(base, key=lambda x: (int(x.split(":")[1]), kinds.index(x.split(":")[0])))))
    return out


def log_odds(votes: list[list[int]], rounds: int = 50) -> np.ndarray:
    """Log-odds of quality of each row of votes by expectation-maximisation over the rows themselves."""
    v = np.array(votes)
    prior, right = 0.7, np.full((2, v.shape[1]), 0.8)  # of good rows, of bad ones
    for step in range(rounds + 1):
        up, down = np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1])
        odds = np.log(prior / (1 - prior)) + (v > 0) @ up + (v < 0) @ down
        if step == rounds:
            return odds
        q = 1 / (1 + np.exp(-odds))
        cast = np.stack((q @ (v != 0), (1 - q) @ (v != 0))) + 1.25
        right = np.clip((np.stack((q @ (v > 0), (1 - q) @ (v < 0))) + 1) / cast, 0.5, 0.99)
        prior = np.clip(q.mean(), 0.05, 0.95)
    return odds
