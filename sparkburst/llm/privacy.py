"""Information-theoretic sanitisation of personal data.

Base patterns find e-mail and IP addresses, card and phone numbers.  Protected
entities are each value and its class (an address's domain, the first half of an
IP, the first digits of a card or phone number), so that a value met once is
covered too.  Over the whole corpus, co-occurrence of an entity with the terms
around it estimates how strongly a term reveals it: the pointwise mutual
information PMI(entity; term), against the entity's information IC(entity) =
-log2 p(entity).  Counts of a term are raised by one document, so that a few
chance meetings weigh less.  A term whose PMI exceeds the disclosure threshold's
share of IC goes from the documents that hold the entity, just as the entity
itself: it is generalised to its initial where that reveals little enough, and
removed where even its initial does not.

Everything here is built of Spark's own column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SPACE_CLASS, let, running_sum, words
from .tables import written

#: Kinds in their order; ``term`` is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns, possessive where no step back can help, so that long runs stay linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}
#: Words on each side of an entity that count as its context.
CONTEXT = 8
#: Share of the entity's information that a term may reveal.
DISCLOSURE = 0.85
#: Candidates up to which they are broadcast, to be counted without a shuffle of all terms.
BROADCAST_TERMS = 1_000_000
TERM = r"\p{L}[\p{L}\p{M}\p{N}_'-]+"
#: What marks the initial of terms among terms.
_INITIAL = "\x03"

_OPEN, _CLOSE = "\x01", "\x02"
_SPAN = "array<struct<start:int,rank:int,end:int,entity:string,context:array<string>>>"
_TERM_SPAN = "array<struct<start:int,rank:int,end:int,label:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda acc, i: acc + part(i))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.char_length(_digits(match))
    if kind == "ip":
        # at most three digits beside leading zeros; of equal length, strings of digits compare as numbers do
        small = lambda x: F.lpad(F.ltrim(x, F.lit("0")), 3, "0") <= "255"
        return F.forall(F.split(match, r"\."), lambda x: (F.char_length(F.ltrim(x, F.lit("0"))) <= 3) & small(x))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    value = {"email": F.lower(match), "ip": match}.get(kind, _digits(match))
    return F.concat(F.lit(f"{kind}:"), value)


def _found(text: Column, kind: str) -> Column:
    """All valid spans of a kind in ``text``, which has neither marker character."""
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{_OPEN}$0{_CLOSE}"), _OPEN)
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.rlike(text, F.lit("[0-9]")))

    def spans(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p, i: (F.char_length(p) - F.when(i > 0, 1).otherwise(0)).cast("long"))

        def build(ends: Column) -> Column:
            def span(i: Column) -> Column:
                match = F.substring_index(F.get(ps, i), _CLOSE, 1)
                start = F.get(ends, i - 1).cast("int")
                before = F.split(F.rtrim(F.substring_index(F.get(ps, i - 1), _CLOSE, -1)), SPACE_CLASS + "+")
                after = F.split(F.ltrim(F.substring_index(F.get(ps, i), _CLOSE, -1)), SPACE_CLASS + "+")
                near = F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - CONTEXT + 1), F.lit(CONTEXT)), F.slice(after, 1, CONTEXT))
                return F.struct(
                    start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.char_length(match)).cast("int").alias("end"), match.alias("entity"), near.alias("context")
                )

            every = F.transform(F.sequence(F.lit(1), F.size(ps) - 1), span)
            return F.filter(every, lambda s: _valid(kind, s["entity"]))

        checked = let(running_sum(lengths), build)
        keyed = F.transform(checked, lambda s: s.withField("entity", _entity(kind, s["entity"])))
        return F.when(F.size(ps) > 1, keyed).otherwise(F.array().cast(_SPAN))

    return F.when(hint, let(parts, spans)).otherwise(F.array().cast(_SPAN))


def _terms(ws: Column) -> Column:
    """The distinct terms among some words, in lower case and without outer punctuation."""
    bare = F.transform(ws, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}\p{M}\p{N}]+$", "")))
    return F.array_distinct(F.filter(bare, lambda w: F.rlike(w, F.lit(f"^{TERM}$"))))


def _classes(entity: Column) -> Column:
    """An entity and its class, the latter marked by a star; both protected."""
    value = F.substring(entity, F.instr(entity, ":") + 1, F.char_length(entity))
    group = (
        F.when(F.startswith(entity, F.lit("email:")), F.substring_index(value, "@", -1))
        .when(F.startswith(entity, F.lit("ip:")), F.substring_index(value, ".", 2))
        .when(F.startswith(entity, F.lit("card:")), F.substring(value, 1, 6))
        .otherwise(F.substring(value, 1, 4))
    )
    return F.array(entity, F.concat(F.substring_index(entity, ":", 1), F.lit("*"), group))


def _plain(text: Column) -> Column:
    """A text without the two marker characters; null is empty."""
    return F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(_OPEN), F.lit(_INITIAL)), F.lit(_CLOSE), F.lit(_INITIAL))


def locate(docs: DataFrame) -> DataFrame:
    """``doc``, the row of ``docs`` as a struct, its number ``row``, and ``spans``, what the base patterns find.

    Names of ``docs`` cannot clash with these.  Later steps join on ``row``, so ids may be null or repeated.
    """
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("plain", _plain(F.col("doc")["text"]))
    for kind in KINDS[:-1]:
        nested = nested.withColumn(kind, _found(F.col("plain"), kind))
    return nested.select("doc", F.monotonically_increasing_id().alias("row"), F.array_sort(F.concat(*KINDS[:-1])).alias("spans"))


def _initial(term: Column) -> Column:
    return F.concat(F.lit(_INITIAL), F.substring(term, 1, 1))


def disclosing(located: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(entity, term, mild) of the terms over the threshold, ``mild`` if their initial is under it; None if there is no such term.

    p(entity), p(term) and p(entity, term) are shares of the documents, those of
    terms from all ``texts`` (one column, text).
    """
    seen = located.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    seen = seen.select("row", F.explode(_classes(F.col("s.entity"))).alias("entity"), _terms(F.col("s.context")).alias("terms"))
    of_entity = seen.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    met = seen.select("row", "entity", F.explode("terms").alias("term")).distinct()
    together = met.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    near = met.select("term", "row").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    n = F.lit(float(max(1, located.count())))

    def share(n_both: Column, n_term: Column) -> Column:
        """Of the entity's information, what the term reveals."""
        return F.log2(n_both * n / (F.col("n_entity") * (n_term + 1))) / F.log2(n / F.col("n_entity"))

    # a term stands in as many documents as it does near entities at least: what is too common there is out
    likely = together.join(of_entity, "entity").join(near, "term").where((n > F.col("n_entity")) & (share(F.col("n_both"), F.col("n_near")) >= DISCLOSURE))
    likely = written(likely.select("entity", "term", "n_entity", "n_both", "n_near"), "likely")
    if likely.isEmpty():
        return None
    terms = _terms(words(_plain(F.col("text"))))
    said = texts.select(F.explode(F.concat(terms, F.array_distinct(F.transform(terms, _initial)))).alias("term"))
    wanted = written(likely.select(F.explode(F.array("term", _initial(F.col("term")))).alias("term")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_TERMS:
        counted = said.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    else:  # counted before they meet the candidates: frequent terms cost one row a task
        counted = said.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term", "left_semi")
    counted = written(counted, "terms")
    judged = likely.join(counted, "term", "left").withColumn("n_term", F.greatest("n_near", "n_term"))
    judged = judged.where(share(F.col("n_both"), F.col("n_term")) >= DISCLOSURE).withColumn("initial", _initial(F.col("term")))
    initials = counted.where(F.startswith("term", F.lit(_INITIAL))).select(F.col("term").alias("initial"), F.col("n_term").alias("n_initial"))
    mild = share(F.col("n_entity"), F.coalesce("n_initial", F.lit(0))) < DISCLOSURE
    return judged.join(initials, "initial", "left").select("entity", "term", mild.alias("mild"))


def _term_spans(text: Column, terms: Column, mild: Column) -> Column:
    """Where the given terms stand in ``text`` as whole words, in any case; ``mild`` are those that keep their initial."""
    alternatives = F.array_join(F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}_'-])(?:"), alternatives, F.lit(r")(?![\p{L}\p{M}\p{N}_'-])"))
    parts = F.split(F.regexp_replace(text, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)

    def spans(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p, i: (F.char_length(p) - F.when(i > 0, 1).otherwise(0)).cast("long"))

        def span(ends: Column, i: Column) -> Column:
            start = F.get(ends, i - 1).cast("int")
            term = F.substring_index(F.get(ps, i), _CLOSE, 1)
            label = F.when(F.array_contains(mild, F.lower(term)), F.concat(F.substring(term, 1, 1), F.lit("."))).otherwise(F.lit(LABELS["term"]))
            return F.struct(start.alias("start"), F.lit(len(KINDS) - 1).alias("rank"), (start + F.char_length(term)).cast("int").alias("end"), label.alias("label"))

        every = let(running_sum(lengths), lambda e: F.transform(F.sequence(F.lit(1), F.size(ps) - 1), lambda i: span(e, i)))
        return F.when(F.size(ps) > 1, every).otherwise(F.array().cast(_TERM_SPAN))

    return let(parts, spans)


def _judged(docs: DataFrame, keep_text: bool) -> DataFrame:
    """``doc``, the row as a struct, and ``spans`` (start, rank, end, label): base ones and, outside them, disclosing terms."""
    located = locate(docs)
    if not keep_text:
        located = located.withColumn("doc", F.when(F.size("spans") > 0, F.col("doc")).otherwise(F.col("doc").withField("text", F.lit(None).cast("string"))))
    located = written(located, "located")
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS])
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.get(labels, s["rank"]).alias("label")))
    pairs = disclosing(located, docs.select(F.col("text").cast("string").alias("text")))
    if pairs is None:
        return located.select("doc", base.alias("spans"))
    entities = F.array_distinct(F.flatten(F.transform("spans", lambda s: _classes(s["entity"]))))
    holders = located.where(F.size("spans") > 0).select("row", F.explode(entities).alias("entity"))
    # a term that keeps its initial for one entity and not for another loses it
    of_row = holders.join(pairs, "entity").groupBy("row", "term").agg(F.min("mild").alias("mild"))
    of_row = of_row.groupBy("row").agg(F.sort_array(F.collect_list("term")).alias("terms"), F.collect_list(F.when(F.col("mild"), F.col("term"))).alias("mild"))
    joined = located.withColumn("spans", base).join(of_row, "row", "left")
    apart = lambda t: ~F.exists("spans", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    more = F.when(F.col("terms").isNull(), F.array().cast(_TERM_SPAN)).otherwise(F.filter(_term_spans(_plain(F.col("doc")["text"]), F.col("terms"), F.col("mild")), apart))
    return joined.select("doc", F.array_sort(F.concat("spans", more)).alias("spans"))


def find(docs: DataFrame, into: str = "spans", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``into``: an array of (start, rank, end, label), every base span and every disclosing term, by start and kind.

    A null or empty text has no spans.  Rows with null or repeated ids are rows
    like any other, and each counts as a document.  Spans of one start stand in
    the order of kinds.  An empty table gives an empty table.  A column of
    ``docs`` that is named ``into`` is replaced; all others stay, whatever their
    names.  Without ``keep_text`` the texts of rows without spans become null.
    """
    kept = [c for c in docs.columns if c != into]
    return _judged(docs, keep_text).select(*[F.col("doc")[c].alias(c) for c in kept], F.col("spans").alias(into))


def listed(spans: Column) -> Column:
    """kind:start:end of some spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < len(KINDS) - 1)


def _redacted(text: Column, spans: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        more = F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), x["label"]))
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), more.alias("out"))).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

    end = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.aggregate(spans, start, step, end)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its label; texts without one stay as they are.

    Of spans that overlap the first is replaced and the rest of the others goes with it.
    """
    text = F.when(F.size("spans") == 0, F.col("doc")["text"]).otherwise(_redacted(F.col("doc")["text"], F.col("spans")))
    return _judged(docs, True).select(*[(text if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])
