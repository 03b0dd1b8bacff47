"""Ordered conversations from message rows, and those to drop (problem 7).

Rows that lack their conversation's identifier are first given one: they are connected components over links
of reply (the call that both name) and of quotation (a line of the one stands, marked with ``>``, in the other), found by alternating
large-star and small-star joins. Then messages are put in order and each conversation is validated.

Defined results
* A message is a ``user_message`` or ``assistant_message`` of a main stream (no agent_id) whose text isn't blank;
  kinds are compared without letter case and surrounding blanks; repeated deliveries (same seq) count once.
* Messages without a turn count for ``empty`` and ``no_opening``, not for the turns.
* Rows without seq can't be ordered and are left out.
* Only lines of ``QUOTED`` characters or more link by quotation, as shorter ones stand in many conversations; rows of one transcript
  file are not linked by that alone. A row that nothing links is a conversation of its own.
* Long conversations are validated in blocks of ``BLOCK`` seqs with carried edges; no task gets a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.runtime import clean_kind, cut, table

BLOCK, QUOTED = 4096, 20
BLANK = r"^[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*$"


def large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its neighbours below it to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected ``edges`` (u, v); the component is its least node.

    Hot nodes are aggregated before the shuffle, never gathered in a list. Self-links and null ends are left out.
    """
    state = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    for _ in range(rounds):
        state = cut(small_star(large_star(state)))
        now = state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def identify(events: DataFrame) -> DataFrame:
    """Give rows without session_id one: ``unnamed:`` and the least event_id of their component."""
    named = F.trim(F.coalesce("session_id", F.lit(""))) != ""
    lost = events.where(~named)
    if lost.isEmpty():
        return events
    calls = lost.select("event_id", F.explode(F.array_compact(F.array("parent_call_id", "tool.call_id"))).alias("call")).select("event_id", F.concat(F.lit("call "), "call").alias("key"))
    # a quoted line, without its marks, and the line itself have one digest
    lines = lost.select("event_id", F.explode(F.split("text", r"\r?\n")).alias("line")).select("event_id", F.col("line").rlike(r"^\s*>").alias("quotes"), F.trim(F.regexp_replace("line", r"^\s*(?:>\s*)+", "")).alias("line"))
    said = lines.where(F.length("line") >= QUOTED).select("event_id", "quotes", F.concat(F.lit("line "), F.xxhash64("line").cast("string")).alias("key")).distinct()
    quoted = said.groupBy("key").agg(F.bool_or("quotes").alias("q")).where("q").select("key")
    keys = calls.unionByName(said.join(quoted, "key").select("event_id", "key"))
    hubs = keys.groupBy("key").agg(F.min("event_id").alias("hub"))
    edges = keys.join(hubs, "key").select(F.col("event_id").alias("u"), F.col("hub").alias("v"))
    found = lost.select("event_id").join(connected_components(edges), F.col("event_id") == F.col("node"), "left").select("event_id", F.concat(F.lit("unnamed:"), F.coalesce("component", "event_id")).alias("_id"))
    return events.join(found, "event_id", "left").withColumn("session_id", F.when(named, F.col("session_id")).otherwise(F.col("_id"))).drop("_id")


def main_rows(events: DataFrame) -> DataFrame:
    """(session_id, seq, role, turn_index, text) of the main streams, each delivery once; role is null for other rows."""
    kind = clean_kind()
    role = F.when(kind == "user_message", "user").when(kind == "assistant_message", "assistant")
    talks = role.isNotNull() & F.col("text").isNotNull() & ~F.col("text").rlike(BLANK)
    rows = identify(events).where("agent_id is null or agent_id = ''").select("event_id", "session_id", "seq", F.when(talks, role).alias("role"), "turn_index", F.when(talks, F.col("text")).alias("text"))
    return rows


def _messages(rows: DataFrame, *more: str) -> DataFrame:
    take = ["role", "turn_index", *more]
    return rows.where("role is not null and seq is not null").groupBy("session_id", "seq").agg(F.min_by(F.struct(*take), "event_id").alias("m")).select("session_id", "seq", "m.*")


def validate(events: DataFrame) -> DataFrame:
    """(session_id, reason) of the conversations to drop, one row per reason."""
    rows = main_rows(events)
    messages = _messages(rows.drop("text")).withColumn("blk", F.floor(F.col("seq") / BLOCK))
    inside = W.partitionBy("session_id", "blk").orderBy("seq")
    steps = messages.withColumn("before", F.last("turn_index", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    blocks = steps.groupBy("session_id", "blk").agg(
        F.min_by("role", "seq").alias("opens"), F.coalesce(F.bool_or(F.col("turn_index") < F.col("before")), F.lit(False)).alias("falls"),
        F.min_by("turn_index", F.when(F.col("turn_index").isNotNull(), F.col("seq"))).alias("first"), F.max_by("turn_index", F.when(F.col("turn_index").isNotNull(), F.col("seq"))).alias("last"),
    )
    edges = blocks.withColumn("before", F.last("last", ignorenulls=True).over(W.partitionBy("session_id").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)))
    order = edges.groupBy("session_id").agg(
        (F.min_by("opens", "blk") != "user").alias("no_opening"), F.bool_or(F.col("falls") | F.coalesce(F.col("first") < F.col("before"), F.lit(False))).alias("turn_regress")
    )
    turns = (
        messages.where("turn_index is not null").groupBy("session_id", "turn_index").agg(F.bool_or(F.col("role") == "user").alias("asked"), F.bool_or(F.col("role") == "assistant").alias("answered"))
        .groupBy("session_id").agg((~((F.min("turn_index") == 1) & (F.max("turn_index") == F.count("*")))).alias("turn_gap"), F.bool_or(F.col("asked") & ~F.col("answered")).alias("missing_reply"))
    )
    empty = rows.groupBy("session_id").agg((F.count("role") == 0).alias("empty")).where("session_id is not null")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    each = lambda c: F.when(flag(c), F.lit(c))
    reasons = F.array_compact(F.array(*map(each, ("empty", "no_opening", "turn_regress", "turn_gap", "missing_reply"))))
    return empty.join(order, "session_id", "left").join(turns, "session_id", "left").select("session_id", F.explode(reasons).alias("reason"))


def conversations(events: DataFrame) -> DataFrame:
    """(session_id, position, seq, turn_index, speaker, text) of the messages of the conversations that are kept.

    ``position`` counts from 1 within a conversation, by block counts, so that long ones are ordered in parallel.
    """
    messages = _messages(main_rows(events), "text").withColumn("blk", F.floor(F.col("seq") / BLOCK))
    sizes = messages.groupBy("session_id", "blk").agg(F.count("*").alias("n"))
    offsets = sizes.select("session_id", "blk", F.coalesce(F.sum("n").over(W.partitionBy("session_id").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    position: Column = F.row_number().over(W.partitionBy("session_id", "blk").orderBy("seq"))
    ordered = messages.withColumn("rank", position).join(offsets, ["session_id", "blk"])
    dropped = validate(events).select("session_id").distinct()
    return ordered.join(dropped, "session_id", "left_anti").select("session_id", (F.col("offset") + F.col("rank")).alias("position"), "seq", "turn_index", F.col("role").alias("speaker"), "text")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return validate(table(spark, base, "session_events"))


def p7_conversations(spark: SparkSession, base: str) -> DataFrame:
    return conversations(table(spark, base, "session_events"))
