"""The trie of conversations' prefixes, by prefix doubling.

Distinct turns get dense numbers, their names.  Blocks of 2, 4, 8 .. turns that
start at a multiple of their length are named in turn, each round joining pairs of
the round before: so equal blocks have equal names, whatever the conversation.  A
prefix is the blocks of its length's binary digits, the longest first; its name
grows from theirs, digit by digit, again a round each.  So the number of rounds
grows with the logarithm of the longest conversation, and no round holds a text.
Rows of equal names are then a node of the trie.

Whatever sums over a subtree is summed over members instead: a node's smallest
member stands for it once, so what the nodes below a node are worth is what its
members stand for from its depth on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .digests import EMPTY_SHA256, joined_sha256
from .tables import discard, written

#: Original turns of the first conversation of each hundred that ``rebuilt`` may put before another's own.
SHARED = 6
#: Depths that are summed in one window.
BLOCK = 1024
_LOW = (1 << 33) - 1


def _dense(rows: DataFrame, into: str) -> DataFrame:
    """``rows``, written, with dense numbers from 0: the tasks' rows are counted, then numbered on."""
    held = written(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = held.groupBy(F.shiftright("_at", 33).alias("_task")).agg((F.max("_at").bitwiseAND(F.lit(_LOW)) + 1).alias("_n"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = counts.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = held.withColumn("_task", F.shiftright("_at", 33)).join(F.broadcast(starts), "_task")
    return numbered.withColumn(into, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_task", "_at", "_before")


def _named(pairs: DataFrame, into: str) -> DataFrame:
    """``pairs`` with the name of (a, b) as ``into`` in their place."""
    names = _dense(pairs.select("a", "b").distinct(), into)
    return pairs.join(names, ["a", "b"]).drop("a", "b")


def _turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, text) of every turn, pos counting from 1 and ``text`` naming role and text, and (text, length)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said")
    ).where("conv_id is not null")
    key = F.sha2(F.concat("role", F.lit("\0"), "said").cast("binary"), 256)
    keyed = written(rows.select("conv_id", "turn", "role", key.alias("key"), F.length("said").cast("long").alias("length")), "keyed")
    names = written(_dense(keyed.groupBy("key").agg(F.min("length").alias("length")), "text"), "texts")
    # one order of all turns, dealt in ranges, so that no conversation is sorted in one task
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("any")]
    ranged = keyed.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = written(_dense(ranged.select("conv_id", "key"), "row"), "rows")
    first = numbered.groupBy("conv_id").agg(F.min("row").alias("first"))
    placed = numbered.join(first, "conv_id").join(names.select("key", "text"), "key")
    return placed.select("conv_id", (F.col("row") - F.col("first") + 1).alias("pos"), "text"), names.select("text", "length")


def rebuilt(placed: DataFrame, conversations: DataFrame, group: int = 100, shared: int = SHARED) -> DataFrame:
    """(conv_id, pos, text) with each conversation's first h turns taken from the first of its group, where h is crc32 of its id modulo ``shared``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    ids = conversations.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    heads = placed.where(F.col("pos") < shared).select(F.col("conv_id").alias("base"), "pos", "text")
    lent = ids.where("h > 0").join(heads.hint("shuffle_hash"), "base").where("pos <= h").select("conv_id", "pos", "text")
    sizes = heads.groupBy("base").agg(F.max("pos").alias("size"))
    bases = written(ids.join(sizes, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("lent")), "bases")
    own = placed.join(bases, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "text")
    return lent.unionByName(own)


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, text, name): the name of every prefix of at least one turn, unique among all prefixes of its depth, and its last turn."""
    blocks = [written(rows.select("conv_id", (F.col("pos") - 1).alias("at"), F.col("text").alias("name")), "blocks")]
    longest = rows.agg(F.max("pos")).first()[0] or 0
    while 2 << (len(blocks) - 1) <= longest:
        half, pair = F.shiftright("at", 1), F.col("at").bitwiseAND(F.lit(1))
        sides = blocks[-1].groupBy("conv_id", half.alias("at")).agg(F.max(F.when(pair == 0, F.col("name"))).alias("a"), F.max(F.when(pair == 1, F.col("name"))).alias("b"))
        blocks.append(written(_named(sides.where("a is not null and b is not null"), "name"), "blocks"))
    # prefixes whose length has no digit above the k-th are untouched until the k-th round
    prefixes = rows.select("conv_id", F.col("pos").alias("depth"), "text", F.lit(None).cast("long").alias("name"))
    before = None
    for k in reversed(range(len(blocks))):
        has = F.shiftright("depth", k).bitwiseAND(F.lit(1)) == 1
        block = blocks[k].select("conv_id", F.col("at").alias("_at"), F.col("name").alias("b"))
        # the block of digit k stands before the lower digits
        grown = prefixes.where(has).withColumn("_at", F.shiftright("depth", k) - 1).join(block, ["conv_id", "_at"]).drop("_at").withColumn("a", F.coalesce("name", F.lit(-1)))
        grown = _named(grown.drop("name"), "name")
        after = written(prefixes.where(~has).unionByName(grown.select(*prefixes.columns)), "prefixes")
        if before is not None:
            discard(before)
        before = prefixes = after
    for b in blocks:
        discard(b)
    return prefixes


def _sum_from(rows: DataFrame, value: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over their conversation from their depth on, in windows of at most ``BLOCK`` depths."""
    rows = rows.withColumn("_block", F.floor(F.col("depth") / BLOCK))
    totals = rows.groupBy("conv_id", "_block").agg(F.sum(value).alias("_total"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "_block", F.coalesce(F.sum("_total").over(later), F.lit(0)).alias("_later"))
    inside = Window.partitionBy("conv_id", "_block").orderBy(F.desc("depth"))
    return rows.withColumn("_inside", F.sum(value).over(inside)).join(totals, ["conv_id", "_block"]).withColumn(into, F.col("_inside") + F.col("_later")).drop("_block", "_inside", "_later")


def nodes(rows: DataFrame, conversations: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie.

    ``rows`` are turns (conv_id, pos from 1 without gaps, text: a name), ``conversations``
    all ids (conv_id), those without turns too, ``lengths`` the code points of the named texts.
    An empty table gives no rows.
    """
    prefixes = _prefixes(rows)
    root = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("text"), F.lit(-1).cast("long").alias("name"))
    members = written(root.unionByName(prefixes.select("conv_id", F.col("depth").cast("long").alias("depth"), "text", "name")), "members")
    of_node = ["depth", "name"]
    top = members.groupBy(*of_node).agg(F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.min("text").alias("text"))
    words = F.coalesce("length", F.lit(0)) * (F.col("n_convs") - 1)
    top = written(top.join(lengths, "text", "left").select(*of_node, "least", "n_convs", words.alias("saved")), "tops")
    # where a conversation ends, and whether it stands for the node there
    ends = members.groupBy("conv_id").agg(F.max("depth").alias("last"))
    held = members.select("conv_id", *of_node).join(top, of_node).join(ends, "conv_id")
    stands = F.col("conv_id") == F.col("least")
    held = written(held.select("conv_id", *of_node, "least", (F.col("depth") == F.col("last")).alias("ends"), F.when(stands, F.col("saved")).otherwise(0).alias("saved"), stands.alias("stands")), "held")
    # parents by what stands for the node: its row one depth higher
    above = held.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
    parents = held.where("stands and depth > 0").select("conv_id", "depth").join(above, ["conv_id", "depth"])
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"))
    parents, children = written(parents, "parents"), written(children, "children")
    # a leaf is a node without children; it ends what stands for it
    mine = held.where("stands").select("conv_id", "depth").join(children, ["conv_id", "depth"], "left_anti").withColumn("leaf", F.lit(1))
    summed = _sum_from(held.join(mine, ["conv_id", "depth"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))), "saved", "saved_below")
    leaves = _sum_from(summed.withColumn("leaf", F.col("leaf").cast("long")), "leaf", "leaves_below")
    sums = leaves.groupBy("depth", F.col("least").alias("conv_id")).agg(F.count("*").alias("n_convs"), F.sum("leaves_below").alias("n_leaves"), F.sum("saved_below").alias("saved_tokens"))
    listed = held.where("ends").select(_key(F.col("depth"), F.col("least")).alias("key"), "conv_id", F.col("conv_id").cast("string").cast("binary").alias("id"))
    digests = joined_sha256(listed, "key", "conv_id", "id", ",")
    at = ["conv_id", "depth"]
    out = sums.join(parents, at, "left").join(children, at, "left").withColumn("key", _key(F.col("depth"), F.col("conv_id"))).join(digests, "key", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", count("n_children"), count("n_leaves"), count("saved_tokens"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def _key(depth: Column, least: Column) -> Column:
    return F.concat_ws(":", depth.cast("string"), least.cast("string"))


def trie(turns: DataFrame, rebuild: bool = True) -> DataFrame:
    """The nodes (see ``nodes``) of the conversations of ``turns`` (conv_id, turn, role, text), rebuilt first unless asked not to.

    Turns stand by turn, nulls first, those of one turn by role and then a digest of
    role and text; repeated rows are turns of their own.  A null role or text is
    empty.  Rows with a null conv_id belong to no conversation.  Other columns are
    not read.
    """
    placed, lengths = _turns(turns)
    placed = written(placed, "placed")
    conversations = written(placed.select("conv_id").distinct(), "conversations")
    rows = written(rebuilt(placed, conversations), "rebuilt") if rebuild else placed
    return nodes(rows, conversations, lengths)
