"""Links between events, streams, sessions and documents: subagent parents, pairing, matching and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAR = "9999"


def unpaired(events: DataFrame, *scope: str) -> DataFrame:
    """Call ids of tool_uses without any tool_result, compared by call id alone, or within ``scope``, the columns in which ids are unique."""
    key = [*scope, "call_id"]
    ids = lambda kind: events.where((F.col("kind") == kind) & (F.col("tool.call_id") != "")).select(*scope, F.col("tool.call_id").alias("call_id"))
    return ids("tool_use").groupBy(*key).agg(F.count("*").alias("n_uses")).join(ids("tool_result").distinct(), key, "left_anti")


def split_pairs(rows: DataFrame, *chunk: str) -> DataFrame:
    """Results whose call isn't in the same chunk. ``chunk``: the columns that name a chunk."""
    ids = lambda kind: rows.where((F.col("kind") == kind) & (F.col("tool.call_id") != "")).select(*chunk, F.col("tool.call_id").alias("call_id")).distinct()
    return ids("tool_result").join(ids("tool_use"), [*chunk, "call_id"], "left_anti")


def explicit_links(events: DataFrame) -> DataFrame:
    """(session_id, agent_id, call_id, parent_agent): streams whose rows name the call they answer."""
    streams = events.where("agent_id is not null and parent_call_id is not null").groupBy("session_id", "agent_id").agg(F.max_by("parent_call_id", "seq").alias("call_id"))
    calls = events.where("kind = 'tool_use' and tool.call_id <> ''").groupBy("session_id", F.col("tool.call_id").alias("call_id")).agg(F.min_by(F.coalesce("agent_id", F.lit("")), "seq").alias("parent_agent"))
    return streams.join(calls, ["session_id", "call_id"])


def single_links(open_streams: DataFrame, open_calls: DataFrame) -> DataFrame:
    """Where a session has one stream without parent and one call without stream, they belong together."""
    one = lambda rows: rows.withColumn("n", F.count("*").over(W.partitionBy("session_id"))).where("n = 1").drop("n")
    return one(open_streams).join(one(open_calls), "session_id")


def timed_links(open_streams: DataFrame, open_calls: DataFrame) -> DataFrame:
    """Where a session has as many open streams as calls, pair them in order of time, all or none: each stream must not
    begin before its call. Both sides have (session_id, ts) and agent_id or call_id."""
    order = lambda tie: W.partitionBy("session_id").orderBy(F.coalesce(F.nullif(F.col("ts"), F.lit("")), F.lit(FAR)), tie)
    whole = W.partitionBy("session_id")
    a = open_streams.withColumn("rank", F.row_number().over(order("agent_id"))).withColumn("n", F.count("*").over(whole)).withColumnRenamed("ts", "stream_ts")
    b = open_calls.withColumn("rank", F.row_number().over(order("call_id"))).withColumn("n", F.count("*").over(whole)).withColumnRenamed("ts", "call_ts")
    pairs = a.join(b, ["session_id", "rank", "n"])
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    fits = F.coalesce(filled("stream_ts") >= filled("call_ts"), F.lit(True))
    return pairs.withColumn("all_fit", F.bool_and(fits).over(whole)).where("all_fit").select("session_id", "agent_id", "call_id")


def coverage(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks with their summary by id and hash prefix; ``covered`` tells whether there is one."""
    left = chunks.withColumn("prefix", F.substring("sha256", 1, 8))
    return left.join(summaries.withColumn("covered", F.lit(True)), ["session_id", "chunk_id", "prefix"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def pending_attach(diffs: DataFrame, answers: DataFrame) -> DataFrame:
    """Diffs held back until the first answer to their message; diffs without one come at the end.

    ``diffs``: session_id, turn_index, seq of a diff; ``answers``: the same of an answer. Adds after_seq, null for leftovers.
    """
    first = answers.groupBy("session_id", "turn_index").agg(F.min("seq").alias("after_seq"))
    return diffs.join(first, ["session_id", "turn_index"], "left")


def best_match(queries: DataFrame, steps: DataFrame, score: Column, limit: int = 10_000) -> DataFrame:
    """Each query's best step by ``score``, ties to the lowest step.

    There is no key to join by, and every query has a best step whatever it scores. So the queries, a report's routes, go to
    the steps in blocks of ``limit``: each block is small enough to send, and what it finds is one row a query.
    """
    blocks = max(1, -(-queries.count() // limit))
    some = lambda b: queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
    scored = reduce(DataFrame.unionByName, (steps.join(F.broadcast(some(b))).withColumn("score", score).groupBy("query").agg(F.max_by("step_no", F.struct("score", -F.col("step_no"))).alias("step_no"), F.max("score").alias("score")) for b in range(blocks)))
    return scored.groupBy("query").agg(F.max_by("step_no", F.struct("score", -F.col("step_no"))).alias("step_no"), F.max("score").alias("score"))


def first_last_roles(shots: DataFrame, key: str, order: str) -> DataFrame:
    """Of two or more shots of a key the first is before and the last after, all others stand alone."""
    whole = W.partitionBy(key)
    shots = shots.withColumn("rank", F.row_number().over(whole.orderBy(order))).withColumn("n", F.count("*").over(whole))
    return shots.withColumn("role", F.when((F.col("n") > 1) & (F.col("rank") == 1), "before").when((F.col("n") > 1) & (F.col("rank") == F.col("n")), "after").otherwise("standalone"))


def round_robin(items: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Item 1 of each key, then item 2 of each, and so on; the first ``cap``. ``round_robin_left`` counts how many are left over.

    The ranks of the items of a key are dealt out before the cut, and no task sorts more than ``cap`` of each rank.
    """
    dealt = items.withColumn("round", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("round") <= cap)
    return dealt.orderBy("round", key).limit(cap)


def round_robin_left(items: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """(key, n_left): how many items of each key ``round_robin`` leaves over, keys of none with 0."""
    counts = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name)).withColumnRenamed(key, "_key")
    both = counts(items, "n").join(counts(round_robin(items, key, order, cap), "dealt").withColumnRenamed("_key", "_dealt"), F.col("_key").eqNullSafe(F.col("_dealt")), "left")
    return both.select(F.col("_key").alias(key), (F.col("n") - F.coalesce("dealt", F.lit(0))).alias("n_left"))


def word_matches(texts: DataFrame, terms: DataFrame, limit: int = 100_000) -> DataFrame:
    """(term, n_texts): in how many texts a term of one word occurs, without letter case; terms of none have 0.

    An equi-join on the distinct words of the texts, not a search of every term in every text.
    """
    words = texts.select("text_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n_texts"))
    return terms.withColumn("word", F.lower("term")).join(counts, "word", "left").select("term", F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
