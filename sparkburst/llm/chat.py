"""Chat formatting with linked tool calls.

An assistant's turn may hold ``<tool_call>{"id", "name", "arguments", "depends_on"}</tool_call>``
blocks, and a ``tool`` turn is ``{"tool_call_id", "content"}``.  Calls and results
are joined by conversation and identifier, calls are put in topological order of
what they depend on, their arguments are validated against schemas, and messages
are serialised as canonical JSON: keys in order, no spaces, arguments nested in it
alike.

A conversation is written in segments of so many turn numbers, so that no task
holds more of a very long one, unless it is asked for whole.  All of it is built of Spark's own column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Turn numbers of a segment.
SEGMENT = 64
#: For each tool its arguments' types, and whether they are required.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "digits": ("integer", False)},
    "run": {"code": ("string", True), "timeout": ("number", False), "env": ("object", False)},
}
_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"


def _type(value: Column) -> Column:
    """JSON's name for a variant's type."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("STRING"), "string").when(name.startswith("BIGINT"), "integer").when(name.startswith("BOOLEAN"), "boolean")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name.startswith("VOID"), "null").otherwise("number")
    )


def _faults(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments (JSON text), as a sorted array."""
    fitting = F.lit(None).cast("array<string>")
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            got = F.try_variant_get(F.try_parse_json(arguments), f"$['{field}']", "variant")
            fits = (_type(got) == kind) | (F.lit(kind == "number") & (_type(got) == "integer"))
            checks.append(F.when(got.isNull(), F.lit(f"missing:{field}") if required else F.lit(None)).when(~fits, f"type:{field}"))
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, fields)).cast("array<string>")), lambda k: F.concat(F.lit("unknown:"), k))
        faults = F.array_sort(F.concat(F.filter(F.array(*checks).cast("array<string>"), lambda x: x.isNotNull()), extra))
        fitting = F.when(name == tool, faults).otherwise(fitting)
    return F.coalesce(fitting, F.array(F.lit("unknown_tool")))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level): 0 without dependencies, else one more than the deepest; none for cycles."""
    needs = calls.select("conv", "call_id", F.explode("depends_on").alias("needed")).distinct()
    nodes = calls.select("conv", "call_id").distinct()
    known = needs.join(nodes.withColumnRenamed("call_id", "needed"), ["conv", "needed"], "left_semi")
    if known.isEmpty():
        return nodes.withColumn("level", F.lit(0))
    open_edges = written(known, "needs")
    done = written(nodes.join(open_edges, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    while True:
        level = done.select("conv", F.col("call_id").alias("needed"), "level")
        met = open_edges.join(level, ["conv", "needed"], "left").groupBy("conv", "call_id").agg(F.max("level").alias("deepest"), F.count("*").alias("n"), F.count("level").alias("met"))
        ready = met.where("n = met").select("conv", "call_id", (F.col("deepest") + 1).alias("level")).join(done, ["conv", "call_id"], "left_anti")
        ready = written(ready, "ready")
        if ready.isEmpty():
            return done
        done = written(done.unionByName(ready), "levels")


def link(turns: DataFrame, schemas: dict | None = None) -> DataFrame:
    """Every tool call of ``turns``: where it stands, its canonical arguments, level, faults, status, result and, if malformed, body.

    status: ``linked`` (to the first result that does not stand before the call), ``unanswered``, ``duplicate`` (an identifier used before in
    the conversation), ``cycle`` or ``malformed`` (no JSON, or no identifier).
    A row with a null conv_id is a conversation of its own.
    """
    return _linked(_rows(turns), schemas).drop("row")


def _rows(turns: DataFrame) -> DataFrame:
    """The distinct messages, written, each with a number ``row`` and ``own``, a digest if it has no conv_id or turn and 0 else."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    own = F.when(alone, F.xxhash64("conv_id", F.coalesce("turn", F.lit(-1)), "role", "text")).otherwise(F.lit(0))
    return written(rows.withColumn("own", own).withColumn("row", F.monotonically_increasing_id()), "turns")


def _linked(rows: DataFrame, schemas: dict | None) -> DataFrame:
    """The calls of the messages made by ``_rows``, each with its message's number."""
    # a conversation's key is never null
    conv = F.struct(F.coalesce("conv_id", F.lit(0)).alias("id"), F.when(F.col("conv_id").isNull(), F.col("own")).otherwise(F.lit(0)).alias("own"))
    turns = rows.withColumn("conv", conv)
    said = turns.where((F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>")))
    # of several messages in one turn, the place by their text
    said = said.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "turn", "own").orderBy("text")))
    blocks = said.select("row", "conv_id", "conv", "turn", "own", "nth", F.posexplode(F.regexp_extract_all("text", F.lit(_BLOCK), 1)).alias("position", "body"))
    parsed = blocks.withColumn("v", F.try_parse_json("body"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    # a single dependency need not be a list; whatever else stands there is kept as its JSON text
    depends = F.coalesce(get("$.depends_on", "array<string>"), F.array_compact(F.array(get("$.depends_on", "string"))))
    place = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "own", "nth", "position")
    calls = parsed.select(
        "row", "conv_id", "conv", "turn", "position", place.alias("place"), get("$.id", "string").alias("call_id"), get("$.name", "string").alias("name"),
        F.coalesce(F.to_json(get("$.arguments", "variant")), F.lit("{}")).alias("arguments"), depends.alias("depends_on"),
        F.when(get("$.id", "string").isNull(), F.col("body")).alias("body"),
    )
    calls = written(calls.withColumn("faults", _faults(F.col("name"), F.col("arguments"), SCHEMAS if schemas is None else schemas)), "calls")
    named = calls.where("call_id is not null")
    first = named.groupBy("conv", "call_id").agg(F.min("place").alias("first"))
    answers = turns.where("role = 'tool'").withColumn("v", F.try_parse_json("text")).select("conv", "turn", get("$.tool_call_id", "string").alias("call_id"))
    # a result that stands before the call answers something else
    later = answers.join(first, ["conv", "call_id"]).where(F.col("turn") >= F.col("first")["turn"])
    answered = later.groupBy("conv", "call_id").agg(F.min("turn").alias("result_turn"))
    linked = calls.join(first, ["conv", "call_id"], "left").join(answered.hint("shuffle_hash"), ["conv", "call_id"], "left").join(_levels(named), ["conv", "call_id"], "left")
    status = (
        F.when(F.col("call_id").isNull(), "malformed").when(F.col("place") != F.col("first"), "duplicate").when(F.col("level").isNull(), "cycle")
        .when(F.col("result_turn").isNotNull(), "linked").otherwise("unanswered")
    )
    return linked.select("row", "conv_id", "turn", "position", "call_id", "name", "arguments", "depends_on", "faults", "level", status.alias("status"), F.when(status == "linked", F.col("result_turn")).alias("result_turn"), "body")


def render(turns: DataFrame, schemas: dict | None = None, segment: int | None = SEGMENT) -> DataFrame:
    """conv_id, segment, n_messages, n_calls, n_valid and chat (canonical JSON) of every segment of every conversation.

    Without ``segment`` every conversation is one row, numbered 0.  Messages stand by turn, then role and text; calls within one by level and
    position, each in the message that holds it.  A malformed call keeps its body
    as it stands.  Repeated rows are one message.  A null text is empty and a null
    role ``unknown``; rows with a null conv_id or turn are segments of their own.
    An empty table gives no rows.  Other columns are not read.
    """
    rows = _rows(turns)
    item = F.struct("level", "position", F.struct("arguments", "body", "depends_on", "faults", F.col("call_id").alias("id"), "name", "result_turn", "status").alias("call"))
    by_row = _linked(rows, schemas).groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("calls"))
    joined = rows.join(by_row, "row", "left")
    mine = (F.col("role") == "assistant") & F.contains("text", F.lit("<tool_call>"))
    nested = lambda c: c["call"].withField("arguments", F.parse_json(c["call"]["arguments"]))
    called = F.when(mine, F.transform("calls", nested))
    content = F.when(mine, F.trim(F.regexp_replace("text", _BLOCK, ""))).when(F.col("role") == "tool", F.coalesce(F.try_variant_get(F.try_parse_json("text"), "$.content", "string"), F.col("text"))).otherwise(F.col("text"))
    answer_to = F.when(F.col("role") == "tool", F.try_variant_get(F.try_parse_json("text"), "$.tool_call_id", "string"))
    message = F.to_json(F.struct(content.alias("content"), "role", answer_to.alias("tool_call_id"), called.alias("tool_calls"), "turn"))
    messages = joined.select(
        "conv_id", (F.floor(F.col("turn") / segment) if segment else F.when(F.col("turn").isNotNull(), 0).cast("long")).alias("segment"), "own", "turn", "role", "text", message.alias("message"),
        F.coalesce(F.size(called), F.lit(0)).alias("n"), F.coalesce(F.size(F.filter(called, lambda c: (F.size(c["faults"]) == 0) & (c["status"] == "linked"))), F.lit(0)).alias("ok"),
    )
    n_calls, n_valid = (F.greatest(F.sum(c), F.lit(0)).cast("long") for c in ("n", "ok"))
    out = messages.groupBy("conv_id", "segment", "own").agg(
        F.count("*").alias("n_messages"), n_calls.alias("n_calls"), n_valid.alias("n_valid"), F.array_sort(F.collect_list(F.struct("turn", "role", "text", "message"))).alias("m")
    )
    body = F.array_join(F.transform("m", lambda x: x["message"]), ",")
    return out.select("conv_id", "segment", "n_messages", "n_calls", "n_valid", F.concat(F.lit('{"messages":['), body, F.lit("]}")).alias("chat"))
