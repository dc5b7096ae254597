"""Weak supervision of document quality.

Rules vote good, bad or abstain on every document.  Expectation-maximisation
over the histogram of vote patterns (three to the power of the rules at most,
however many documents) estimates how often each rule is right about good and
about bad documents; the posterior probability of quality then decides, where
an all-must-pass filter would need every rule to agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SPACE_CLASS, SPACES, let, words
from .tables import written

WINDOW = 8
#: Frequent function words of the supported languages.
FUNCTION_WORDS = "the of and to in is that for de la le les et que en un une el los y con der die und das ist mit von".split()


def _repeated(ws: Column) -> Column:
    """Words in ``WINDOW``-word windows that are found twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            marked = F.transform(s, lambda x, k: F.when(F.coalesce(same(x, k), F.lit(False)), x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + F.least(F.lit(WINDOW), i + WINDOW - s["end"]).cast("long")).alias("n"))
            return F.aggregate(at, start, step, lambda s: s["n"])

        several = let(let(pairs, positions), total)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(several)

    def windows(wh: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(wh) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)]))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < 2, F.lit(0).cast("long")).when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), covered))


def features(docs: DataFrame) -> DataFrame:
    """``docs``' ids with the counts that the base checks and the rules look at; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    length = F.char_length("_t").cast("long")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
        .withColumn("_w", words(F.col("_t")))
        .withColumn("_l", lines)
        .select(
            "doc_id",
            F.size("_w").cast("long").alias("n_words"),
            F.char_length(F.regexp_replace("_t", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
            (length - F.char_length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            _repeated(F.col("_w")).alias("n_repeat_words"),
            (length - F.char_length(F.regexp_replace("_t", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
            (length - F.char_length(F.regexp_replace("_t", r"[!-/:-@\[-`{-~]+", ""))).cast("long").alias("n_punctuation"),
            F.regexp_count("_t", F.lit(r"[!-/:-@\[-`{-~]{2}")).cast("long").alias("n_doubled"),
            F.size(F.array_intersect("_w", F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function_words"),
        )
    )


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains.  Ratios are compared as products, so 0 words do no harm."""
    c = F.col
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": vote(c("n_words") < 20, c("n_words") >= 60),
        "symbols": vote(c("n_symbols") * 10 > c("n_words"), c("n_symbols") * 50 <= c("n_words")),
        "lines": vote(c("n_dup_lines") * 10 > c("n_lines") * 3, c("n_dup_lines") == 0),
        "repeats": vote(c("n_repeat_words") * 5 > c("n_words"), c("n_repeat_words") * 50 <= c("n_words")),
        "word_size": vote((c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")), c("word_chars").between(4 * c("n_words"), 9 * c("n_words"))),
        "capitals": vote(c("n_capitals") * 2 > c("word_chars"), c("n_capitals") * 10 <= c("word_chars")),
        "punctuation": vote(c("n_punctuation") * 5 > c("word_chars"), c("n_punctuation") * 12 <= c("word_chars")),
        "doubled": vote(c("n_doubled") * 10 > c("n_words"), c("n_doubled") * 50 <= c("n_words")),
        "function_words": vote((c("n_function_words") == 0) & (c("n_words") >= 20), c("n_function_words") >= 2),
    }


@dataclass
class Accuracies:
    """prior: share of good documents.  good, bad: each rule's chance to vote right on a document of that class, if it votes."""

    prior: float
    good: list[float]
    bad: list[float]

    def weights(self) -> list[tuple[float, float]]:
        """Each rule's log-odds for a good and for a bad vote."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.good, self.bad, strict=True)]

    def posterior(self, votes: list[int]) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        odds += sum(w[0] if v > 0 else w[1] if v < 0 else 0.0 for v, w in zip(votes, self.weights(), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def estimate(patterns: list[tuple[list[int], int]], n_rules: int, rounds: int = 50) -> Accuracies:
    """Expectation-maximisation from (votes, documents) pairs; a rule is never taken to be worse than chance."""
    a = Accuracies(0.7, [0.8] * n_rules, [0.8] * n_rules)
    total = sum(n for _, n in patterns)
    if not total:
        return a
    held = lambda x, least=0.5: min(0.99, max(least, x))
    for _ in range(rounds):
        p = [a.posterior(v) for v, _ in patterns]
        right, cast = [[1.0, 1.0] for _ in range(n_rules)], [[1.25, 1.25] for _ in range(n_rules)]
        for (votes, n), q in zip(patterns, p, strict=True):
            for j, v in enumerate(votes):
                if v:
                    cast[j][0] += n * q
                    cast[j][1] += n * (1 - q)
                    right[j][v < 0] += n * (q if v > 0 else 1 - q)
        prior = held(sum(n * q for (_, n), q in zip(patterns, p, strict=True)) / total, 0.05)
        a = Accuracies(min(prior, 0.95), [held(r[0] / c[0]) for r, c in zip(right, cast, strict=True)], [held(r[1] / c[1]) for r, c in zip(right, cast, strict=True)])
    return a


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, posterior and kept of every row of ``docs`` (doc_id, text).

    base_failed: under 20 words, or over 30 % of the words in repeated windows.
    kept: not base_failed, and the posterior is at least a half.  Rows are judged
    one by one: null and repeated ids stay, a null or empty text has no words
    and fails.  An empty table gives no rows; other columns are not read.
    """
    votes = rules()
    judged = written(features(docs).withColumns({f"vote_{k}": v for k, v in votes.items()}), "votes")
    named = [f"vote_{k}" for k in votes]
    patterns = judged.groupBy(*named).agg(F.count("*").alias("n")).orderBy(*named).collect()  # 3 ** len(votes) rows at most
    a = estimate([([r[k] for k in named], r["n"]) for r in patterns], len(named))
    odds = F.lit(math.log(a.prior / (1 - a.prior)))
    for k, (good, bad) in zip(named, a.weights(), strict=True):
        odds = odds + F.when(F.col(k) > 0, good).when(F.col(k) < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = judged.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
