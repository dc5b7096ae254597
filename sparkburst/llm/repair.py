"""Repair of conversation structure by cheapest edits.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  Each turn
is kept, given another role or deleted, turns may be inserted, and of the cheapest
edits those with the least string of initials count.

Turns are sorted once, over all conversations, and numbered; runs of ``SEGMENT``
numbers are segments.  Windows give a segment's flags, and its sorted turns fold,
by ``aggregate``, into four (cost, audit) structs, one for each state in which the
roles so far can end: nothing yet, after the system turn, after a user's, after
the assistant's.  The segment that begins a conversation starts from nothing; any
other is folded from each of the four, and a second fold joins a conversation's
segments in their order.  So a conversation of any length is worked on by many
tasks, and what one row gathers of it is its audits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import SPACES, let
from .digests import EMPTY_SHA256, joined_sha256
from .tables import written

#: Turns of a segment: a power of two.
SEGMENT = 256
#: Above any cost.
_NEVER = 1 << 40
#: The system turn's Keep within a fold; letters keep their order.
_SYSTEM = "L"


@dataclass(frozen=True)
class Costs:
    """Of each edit; ``truncated`` comes on top for a truncated turn that stays.  ``insert`` must be positive."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes
    the user say it.  A null is one space, but for the order of turns.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """The turns, written in the order of all conversations, with a number ``row`` in it and a key ``conv`` that is never null."""
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    ).withColumns({"digest": F.xxhash64("text"), "any": F.monotonically_increasing_id()})  # equal rows may stand on either side of a range's end
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("any")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ranged.select("conv_id", "conv", "turn", "role", "text", F.monotonically_increasing_id().alias("row")), "ordered")


def _flagged(rows: DataFrame) -> DataFrame:
    """conv, row, seg, turn, initial and fault of every row: its first of blank, duplicate and truncated."""
    same = F.md5(F.concat_ws("\0", "conv", "role", "text").cast("binary"))
    kept = F.btrim("text", F.lit(SPACES))
    slim = rows.select("conv", "row", "turn", F.left("role", F.lit(1)).alias("initial"), (kept == "").alias("blank"), (~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("cut"), same.alias("same"))
    # summed before the shuffle, so a text that very many rows share costs each task one row
    repeats = slim.groupBy("same").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1").select("same", "first")
    fault = F.when(F.col("blank"), "blank").when(F.col("row") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    seg = F.shiftright("row", SEGMENT.bit_length() - 1)
    return slim.join(repeats, "same", "left").select("conv", "row", seg.alias("seg"), "turn", "initial", fault.alias("fault"))


def _segments(flagged: DataFrame) -> DataFrame:
    """Counts, ends and sorted turns of every segment, and whether it begins its conversation."""
    before = Window.partitionBy("conv", "seg").orderBy("row")
    last = F.lag("initial").over(before)
    legal = F.concat(last, F.col("initial")).isin("su", "ua", "au")
    new = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(before) == F.col("turn"), F.lit(False))
    seen = flagged.withColumns({"illegal": last.isNotNull() & ~legal, "new": new})
    count = lambda c: F.count_if(c)
    segments = seen.groupBy("conv", "seg").agg(
        *[count(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"), count(F.col("new")).alias("turns_met"),
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.min_by(F.struct("initial", "turn"), "row").alias("head"), F.max_by(F.struct("initial", "turn"), "row").alias("tail"),
        F.array_sort(F.collect_list(F.struct("row", "initial", "fault"))).alias("turns"),
    )
    first = flagged.groupBy("conv").agg(F.min("seg").alias("seg")).withColumn("begins", F.lit(True))
    return segments.join(first, ["conv", "seg"], "left").withColumn("begins", F.coalesce("begins", F.lit(False)))


def _path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _on(path: Column, cost: int | Column, letters: str | Column) -> Column:
    return _path(path["cost"] + cost, F.concat(path["audit"], F.lit(letters) if isinstance(letters, str) else letters))


def _start(state: Column) -> Column:
    return F.struct(*[_path(F.when(state == k, 0).otherwise(_NEVER), F.lit("")).alias(f"s{k}") for k in range(4)])


def _inserted(s: Column, costs: Costs) -> tuple[Column, Column]:
    """The paths after a user's and after the assistant's turn, with turns inserted where that is cheaper."""
    one, two = (lambda p: _on(p, costs.insert, "I")), (lambda p: _on(p, 2 * costs.insert, "II"))
    user = F.least(s["s2"], one(s["s0"]), one(s["s1"]), one(s["s3"]))
    return user, F.least(s["s3"], one(s["s2"]), two(s["s0"]), two(s["s1"]))


def _step(s: Column, turn: Column, costs: Costs) -> Column:
    user, assistant = _inserted(s, costs)
    stays = ~F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    extra = F.when(turn["fault"] == "truncated", costs.truncated).when(stays, 0).otherwise(_NEVER)
    deleted = lambda p: _on(p, costs.delete, "D")

    def said(by: str, p: Column) -> Column:
        is_kept = turn["initial"] == by
        return _on(p, extra + F.when(is_kept, 0).otherwise(costs.rerole), F.when(is_kept, "K").otherwise("R"))

    system = _on(s["s0"], extra + F.when(turn["initial"] == "s", 0).otherwise(_NEVER), _SYSTEM)
    return F.struct(
        deleted(s["s0"]).alias("s0"), F.least(deleted(s["s1"]), system).alias("s1"),
        F.least(deleted(user), said("u", F.least(s["s0"], s["s1"], assistant))).alias("s2"), F.least(deleted(assistant), said("a", user)).alias("s3"),
    )


def _folded(segments: DataFrame, costs: Costs) -> DataFrame:
    """``segments`` with ``paths``: for each state it may start from, the four paths through it, whose audits end with a comma."""
    starts = F.when(F.col("begins"), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(4))))
    closed = lambda s: F.array(*[_on(s[f"s{k}"], 0, ",") for k in range(4)])
    fold = lambda start: F.aggregate("turns", _start(start), lambda s, t: _step(s, t, costs), closed)
    return segments.withColumn("paths", F.transform(starts, fold)).drop("turns")


def _joined(segments: DataFrame, costs: Costs) -> DataFrame:
    """conv, counts, cost and audit, with a comma at each segment's end, of every conversation."""
    ends = F.array_sort(F.collect_list(F.struct("seg", "head", "tail", "paths")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns_met")]
    by_conv = segments.groupBy("conv").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"), ends.alias("ends"))

    def pairs(bad) -> Column:
        """How many neighbouring segments meet in turns of which ``bad`` holds."""
        return let(F.col("ends"), lambda e: F.size(F.filter(F.sequence(F.lit(1), F.size(e)), lambda k: (k > 1) & bad(F.get(e, k - 2)["tail"], F.get(e, k - 1)["head"]))))

    illegal = pairs(lambda a, b: ~F.concat(a["initial"], b["initial"]).isin("su", "ua", "au"))
    split = pairs(lambda a, b: F.coalesce(a["turn"] == b["turn"], F.lit(False)))

    def step(s: Column, x: Column) -> Column:
        through = lambda k: F.least(*[_on(s[f"s{i}"], F.get(x["paths"], F.lit(i))[k]["cost"], F.get(x["paths"], F.lit(i))[k]["audit"]) for i in range(4)])
        return F.struct(*[through(k).alias(f"s{k}") for k in range(4)])

    first = F.get(F.col("ends"), F.lit(0))["paths"][0]
    start = F.struct(*[first[k].alias(f"s{k}") for k in range(4)])
    best = F.aggregate(F.slice("ends", F.lit(2), F.greatest(F.size("ends") - 1, F.lit(0))), start, step, lambda s: F.least(s["s0"], _inserted(s, costs)[1]))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - (F.col("turns_met") - split), F.lit(0))
    out = by_conv.select("conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + illegal).cast("long").alias("illegal"), best.alias("best"))
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", F.col("best.audit").alias("pieces"))


def _edited(rows: DataFrame, segments: DataFrame, judged: DataFrame) -> DataFrame:
    """conv, position, role and text of every turn of the repaired conversations."""
    number = F.row_number().over(Window.partitionBy("conv").orderBy("seg")) - 1
    pieces = judged.select("conv", F.posexplode(F.split("pieces", ",")).alias("nth", "piece"))
    placed = segments.select("conv", "seg", number.alias("nth")).join(pieces, ["conv", "nth"], "right")
    earlier = Window.partitionBy("conv").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    added = lambda letters, w: F.coalesce(F.sum(letters).over(w), F.lit(0))
    spoken = lambda c: F.length(F.regexp_replace(c, f"[D{_SYSTEM}]", ""))
    said = lambda c: F.length(F.regexp_replace(c, "D", ""))
    placed = placed.withColumns({"spoken": added(spoken("piece"), earlier), "said": added(said("piece"), earlier)})
    role = lambda k: F.when(k % 2 == 0, "user").otherwise("assistant")
    inside = placed.where("seg is not null")
    numbered = rows.select("conv", F.shiftright("row", SEGMENT.bit_length() - 1).alias("seg"), "row", "role", "text").join(inside, ["conv", "seg"])
    mine = Window.partitionBy("conv", "seg").orderBy("row")
    numbered = numbered.withColumn("edit", F.get(F.regexp_extract_all("piece", F.lit(f"I*[DKR{_SYSTEM}]"), F.lit(0)), F.row_number().over(mine) - 1))
    before = mine.rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumns({"spoken": F.col("spoken") + added(spoken("edit"), before), "said": F.col("said") + added(said("edit"), before)})
    own = F.when(F.right("edit", F.lit(1)) == "R", role(F.col("spoken") + F.length("edit") - 1)).otherwise(F.col("role"))
    kept = F.when(F.right("edit", F.lit(1)) != "D", F.array(F.struct((F.col("said") + F.length("edit") - 1).alias("position"), own.alias("role"), F.col("text").alias("text"))))
    item = "array<struct<position:bigint,role:string,text:string>>"
    none = F.array().cast(item)

    def inserted(n: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((F.col("said") + k).alias("position"), role(F.col("spoken") + k).alias("role"), F.lit("").alias("text")))
        return F.when(n > 0, each.cast(item)).otherwise(none)

    turns = numbered.select("conv", F.explode(F.concat(inserted(F.length("edit") - 1), F.coalesce(kept.cast(item), none))).alias("t"))
    # what is inserted behind the last turn
    tail = placed.where("seg is null and piece <> ''").select("conv", F.explode(inserted(F.length("piece"))).alias("t"))
    return turns.unionByName(tail).select("conv", "t.position", "t.role", "t.text")


def repair(turns: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) and their repaired turns (conv, position, role, text).

    ``conv`` is conv_id as text, empty for a null one, whose rows are one
    conversation.  Turns stand by turn, nulls first; those of one turn by role, then
    by a digest of the text, so equal rows stand side by side.  A null role or text
    is empty, a row without letters of any kind blank.  Repeated rows are
    duplicates.  Other columns are not read; an empty table gives no rows.
    """
    rows = _ordered(turns)
    segments = written(_folded(_segments(_flagged(rows)), costs), "segments")
    judged = written(_joined(segments, costs), "judged")
    audit = F.translate("pieces", f"{_SYSTEM},", "K")
    return judged.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit")), _edited(rows, segments, judged)


def summary(turns: DataFrame, conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The figures of each of ``conversations`` (conv_id), with the digest of its repaired ``role:text`` lines; zeros where no turn is left."""
    figures, repaired = repair(turns, costs)
    lines = repaired.select("conv", "position", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    digests = joined_sha256(lines, "conv", "position", "line", "\n").withColumnRenamed("key", "conv")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = ids.join(figures, "conv", "left").join(digests, "conv", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
