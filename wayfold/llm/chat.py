"""Chat formatting with linked tool calls (DataFrame operations only).

Calls and results meet in a hash join on their conversation and identifier; equal identifiers of two conversations are two calls.
Calls name the calls of their conversation that they depend on; a call's level is one more
than the highest level of these, found for all calls at once, round by round, with a table per round in the shared
folder. A round also replaces a dependency that waits for one other call by that one, so a chain of n calls takes about
log2(n) rounds, and rounds end only when nothing settles any more: what is left is in a cycle or behind one. Arguments are
validated as variants against the schema of the tool: required fields, types, greatest lengths, and no fields beyond. Each message
is one row with canonical JSON: keys in alphabetical order, no white space; arguments are re-serialised the same way.

A row per message, not per conversation: `(anchor, level, turn)` orders a conversation topologically, each result after
its call, and a conversation of any length spreads over all tasks.

Defined cases: null texts are empty; a null conversation is one of its own; a call id used twice in a conversation counts as one
call, the one with the smallest row, and both rows are marked `duplicate`; a result without its call is an `orphan`; a call
without a result is `unanswered`; arguments that aren't a JSON object, or don't fit, are `invalid`; a dependency that doesn't exist
is ignored; repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize

#: The greatest length of a prompt that the tools of the conversations table take.
MAX_PROMPT = 350
#: Tools of the conversations table: field name, type, whether it is required, greatest length of a string or None.
SCHEMAS = {
    "reply": (("prompt", "STRING", True, MAX_PROMPT), ("turn", "BIGINT", True, None)),
    "configure": (("prompt", "STRING", True, MAX_PROMPT), ("turn", "BIGINT", True, None)),
}


def validate(tool: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """'ok', or the first fault of the arguments: unknown_tool, not_object, missing:x, type:x, length:x, extra."""
    v = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.lit("unknown_tool")
    for name, fields in schemas.items():
        fault = F.when(keys.isNull() | v.isNull(), "not_object")
        for field, kind, required, longest in fields:
            has = F.array_contains(keys, field)
            value = F.try_variant_get(v, f"$.{field}", "variant")
            if required:
                fault = fault.when(~has, f"missing:{field}")
            fault = fault.when(has & (F.schema_of_variant(value) != kind), f"type:{field}")
            if longest is not None:
                fault = fault.when(has & (F.length(F.try_variant_get(v, f"$.{field}", "string")) > longest), f"length:{field}")
        fault = fault.when(F.size(F.array_except(keys, F.array(*(F.lit(f[0]) for f in fields)))) > 0, "extra").otherwise("ok")
        out = F.when(tool == name, fault).otherwise(out)
    return F.when(tool.isNull(), None).otherwise(out)


def canonical(arguments: Column) -> Column:
    """The JSON text with keys in alphabetical order at every level and no white space; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(arguments))


def call_levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of unique calls (call_id, depends_on array<string>); level null in or behind a cycle."""
    needs = calls.select("call_id", F.explode("depends_on").alias("need")).distinct()
    needs = needs.join(calls.select(F.col("call_id").alias("need")), "need", "left_semi")
    if needs.isEmpty():
        return calls.select("call_id", F.lit(0).cast("long").alias("level"))
    # edges: a call's level is the greatest w plus the level of its need, or plus nothing where need is null
    edges = materialize(needs.select("call_id", "need", F.lit(1).cast("long").alias("w")), "chat-needs")
    waiting = edges.select("call_id").distinct()
    done = materialize(calls.join(waiting, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")), "chat-levels")
    most = calls.count()  # no level is higher; only cycles reach it
    while True:
        single = edges.groupBy("call_id").agg(F.count("need").alias("n")).where("n = 1").select("call_id")
        hops = edges.join(single, "call_id", "left_semi").union(done.select("call_id", F.lit(None).cast("string"), "level"))
        hops = hops.toDF("_at", "_to", "_plus")
        met = F.col("_at").isNotNull()
        stepped = edges.join(hops, (F.col("need") == F.col("_at")) & (F.col("need") != F.col("call_id")), "left").select(
            "call_id", F.when(met, F.col("_to")).otherwise(F.col("need")).alias("need"), F.least(F.col("w") + F.coalesce("_plus", F.lit(0)), F.lit(most)).alias("w")
        )
        stepped = materialize(stepped.groupBy("call_id", "need").agg(F.max("w").alias("w")), "chat-needs", instead=edges)
        state = stepped.groupBy("call_id").agg(F.count("need").alias("open"), F.max("w").alias("level"))
        new = materialize(state.where("open = 0").select("call_id", "level"), "chat-new")
        if new.isEmpty():
            break
        done = materialize(done.union(new), "chat-levels", instead=done)
        edges = stepped.join(new, "call_id", "left_anti")
    return calls.select("call_id").join(done, "call_id", "left")


def link(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Messages in canonical form.

    messages: conv_id, turn, role, text, call_id (set on calls and results), tool (set on calls), arguments (JSON text of
    calls), depends_on (array of call ids, on calls).
    """
    conversation = F.coalesce(F.concat(F.col("conv_id").cast("string"), F.lit(":")), F.lit(":"))
    key = lambda call: F.concat(conversation, call)
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "call_id", "tool", "arguments", F.transform("depends_on", key).alias("needs"), key(F.col("call_id")).alias("key"))
    is_call = F.col("tool").isNotNull() & F.col("call_id").isNotNull()
    calls = m.where(is_call).groupBy("key").agg(
        F.min(F.struct("turn", "tool", "arguments", "needs")).alias("c"), F.count(F.lit(1)).alias("uses")
    )
    answered = m.where(~is_call & F.col("call_id").isNotNull()).select("key").distinct().withColumn("answered", F.lit(True))
    levels = call_levels(calls.select(F.col("key").alias("call_id"), F.col("c.needs").alias("depends_on"))).withColumnRenamed("call_id", "key")
    info = calls.join(answered, "key", "left").join(levels, "key", "left").select(
        F.col("key").alias("_id"), F.col("c.turn").alias("call_turn"), F.col("c.tool").alias("call_tool"), "uses", "answered", "level"
    )
    both = m.join(info, m["key"] == info["_id"], "left")
    fault = validate(F.col("tool"), F.col("arguments"), schemas)
    status = (
        F.when(F.col("call_id").isNull(), "message")
        .when(is_call & (F.col("uses") > 1), "duplicate")
        .when(is_call & F.col("level").isNull(), "cycle")
        .when(is_call & (fault != "ok"), F.concat(F.lit("invalid:"), fault))
        .when(is_call & F.col("answered").isNull(), "unanswered")
        .when(is_call, "linked")
        .when(F.col("_id").isNull(), "orphan")
        .otherwise("linked")
    )
    args = canonical(F.col("arguments"))
    body = F.to_json(F.struct(F.when(~is_call, F.col("text")).alias("content"), F.col("role"), F.when(~is_call, F.col("call_id")).alias("tool_call_id"), F.col("turn")))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    shown = F.concat(
        F.lit('{"arguments":'), F.coalesce(args, F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("tool")),
        F.lit(',"role":'), quoted(F.coalesce("role", F.lit(""))), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    return both.select(
        "conv_id", "turn", "role", "call_id", status.alias("status"), F.coalesce("call_turn", "turn").cast("long").alias("anchor"),
        F.when(is_call, F.coalesce(F.col("level"), F.lit(0))).when(F.col("_id").isNotNull(), F.coalesce(F.col("level"), F.lit(0)) + 1).otherwise(0).cast("long").alias("level"),
        F.when(is_call, shown).otherwise(body).alias("json"),
    )


def calls_from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of a table without tool calls: each user or system turn calls a tool, the next turn answers it.

    A user turn is a call of `reply`, a system turn one of `configure`, with the text as argument; an assistant turn is
    the result of the turn before it. A call depends on the call before it in its conversation. Null turns or conversations have
    no identifier and stay plain messages. Prompts beyond the schemas' length don't validate; calls that no turn answers stay so.
    """
    name = lambda turn: F.when(F.col("conv_id").isNotNull(), F.concat(F.lit("call_"), turn))
    asks = F.col("role").isin("user", "system")
    tool = F.when(asks & F.col("turn").isNotNull() & F.col("conv_id").isNotNull(), F.when(F.col("role") == "user", "reply").otherwise("configure"))
    call = F.when(tool.isNotNull(), name(F.col("turn"))).when(F.col("role") == "assistant", name(F.col("turn") - 1))
    arguments = F.when(tool.isNotNull(), F.to_json(F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("prompt"))))
    # only numbers pass the window, so a long conversation is a light sort
    turns = conversations.where(tool.isNotNull()).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).distinct()
    turns = turns.withColumn("_p", F.lag("_t").over(Window.partitionBy("_c").orderBy("_t"))).where("_p is not null")
    asked = conversations.select("conv_id", "turn", "role", "text")
    asked = asked.join(turns, tool.isNotNull() & (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    needs = F.when(F.col("_p").isNotNull(), F.array(name(F.col("_p")))).otherwise(F.array().cast("array<string>"))
    return asked.select("conv_id", "turn", "role", "text", call.alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), needs.alias("depends_on"))
