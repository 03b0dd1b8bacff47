"""The normalized event stream: one row per event, turns, order and identity of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.runtime import clean_kind, table

VISIBLE = "kind = 'user_message' and text is not null and trim(text) <> ''"
FAR = "9999-12-31T23:59:59Z"


#: Seqs of a block. Streams are scanned block by block with what earlier blocks carry on, so that one long session is many tasks.
BLOCK = 4096


def once(events: DataFrame) -> DataFrame:
    """Each event once, of repeated deliveries the one with the lowest event_id; kinds without case and blanks."""
    rank = F.row_number().over(W.partitionBy("session_id", "seq").orderBy("event_id"))
    return events.withColumn("kind", clean_kind()).withColumn("_n", rank).where("_n = 1").drop("_n")


def load(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """The event table, each event once; only the columns asked for, and the keys, are read."""
    keys = ["event_id", "session_id", "seq", "kind"]
    events = table(spark, base, "session_events")
    return once(events.select(*dict.fromkeys([*keys, *columns]))) if columns else once(events)


def stream_window():
    """A session's main stream or one of its subagents, in order."""
    return W.partitionBy("session_id", F.coalesce(F.col("agent_id"), F.lit(""))).orderBy("seq")


def _blocked(events: DataFrame, *key: Column) -> tuple[DataFrame, list[str]]:
    """The events with the columns that name their key (_k0, ...) and block (_blk), and those columns."""
    names = [f"_k{i}" for i in range(len(key))]
    rows = events.withColumns({n: c for n, c in zip(names, key)} | {"_blk": F.floor(F.col("seq") / BLOCK)})
    return rows, [*names, "_blk"]


def _stream_key() -> tuple[Column, Column]:
    return F.col("session_id"), F.coalesce(F.col("agent_id"), F.lit(""))


def running_sum(events: DataFrame, value: Column, name: str, *key: Column) -> DataFrame:
    """The sum of ``value`` up to each event of its key in order of seq: within blocks, plus the sums of earlier blocks."""
    rows, by = _blocked(events.withColumn("_v", value.cast("long")), *key)
    sums = rows.groupBy(*by).agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*by[:-1]).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(*by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_c"))
    return rows.withColumn("_w", F.sum("_v").over(W.partitionBy(*by).orderBy("seq"))).join(carried, by).withColumn(name, F.col("_w") + F.col("_c")).drop(*by, "_v", "_w", "_c")


def turn_index(events: DataFrame) -> DataFrame:
    """Number the turns of each stream: one more at each visible user message."""
    return running_sum(events, F.coalesce(F.expr(VISIBLE), F.lit(False)).cast("int"), "turn", *_stream_key())


def turn_regressions(events: DataFrame) -> DataFrame:
    """How often the turn falls from an event to the next of its stream."""
    fell = F.col("turn_index") < F.lag("turn_index").over(stream_window())
    return events.withColumn("fell", fell).where("fell").groupBy("session_id").agg(F.count("*").alias("n_regressions"))


def resequence(events: DataFrame) -> DataFrame:
    """Concatenate all sessions, ordered by first timestamp, then path, and number the events from 1.

    Only sessions are ordered globally, in the ranges that the first characters of their timestamps make, and the ranges by
    their sums; events get their session's offset. No task sorts all events or all sessions.
    """
    stamp = F.nullif(F.col("ts"), F.lit(""))
    per = events.groupBy("session_id").agg(F.coalesce(F.min(stamp), F.lit(FAR)).alias("first_ts"), F.min("source_path").alias("path"), F.count("*").alias("n"))
    per = per.withColumns({"_a": F.substring("first_ts", 1, 4), "_b": F.substring("first_ts", 1, 10)})
    upto = lambda n, order: F.sum(n).over(order) - F.col(n)
    days = per.groupBy("_a", "_b").agg(F.sum("n").alias("_n"))
    years = days.groupBy("_a").agg(F.sum("_n").alias("_y"))
    years = years.select("_a", upto("_y", W.orderBy("_a")).alias("_before_a"))
    days = days.select("_a", "_b", upto("_n", W.partitionBy("_a").orderBy("_b")).alias("_before_b")).join(years, "_a")
    inside = per.select("session_id", "_a", "_b", upto("n", W.partitionBy("_a", "_b").orderBy("first_ts", "path", "session_id")).alias("_before"))
    offsets = inside.join(days, ["_a", "_b"]).select("session_id", (F.col("_before") + F.col("_before_b") + F.col("_before_a")).alias("offset"))
    ranked = running_sum(events, F.lit(1), "rank", F.col("session_id"))
    return ranked.join(offsets, "session_id").withColumn("global_seq", F.col("offset") + F.col("rank")).drop("rank", "offset")


def carry_ts(events: DataFrame) -> DataFrame:
    """Blank timestamps get the stream's last one, leading blanks its first."""
    rows, by = _blocked(events.withColumn("_t", F.nullif(F.col("ts"), F.lit(""))), *_stream_key())
    ends = rows.groupBy(*by).agg(F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("seq"))).alias("_l"), F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("seq"))).alias("_f"))
    order = W.partitionBy(*by[:-1]).orderBy("_blk")
    carried = ends.select(
        *by, F.last("_l", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_c"), F.first("_f", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_first")
    )
    within = F.last("_t", ignorenulls=True).over(W.partitionBy(*by).orderBy("seq"))
    return rows.withColumn("_w", within).join(carried, by).withColumn("carried_ts", F.coalesce("_w", "_c", "_first", F.lit(""))).drop(*by, "_t", "_w", "_c", "_first")


def from_expected(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Of each file only the expected session's events, from its first on. ``expected``: source_path, expected_id."""
    order = W.partitionBy("source_path").orderBy("source_line", "seq")
    marked = events.join(expected, "source_path").withColumn("started", F.max((F.col("session_id") == F.col("expected_id")).cast("int")).over(order))
    return marked.where("started = 1 and session_id = expected_id").drop("started")


def contiguity(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Sessions whose events are not one run of positions (gaps and islands without a self-join)."""
    runs = events.groupBy("session_id").agg(F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.count("*").alias("n"))
    return runs.where("last_pos - first_pos + 1 <> n")


def union_providers(events: DataFrame) -> DataFrame:
    """The three providers' plans united by name, columns that one lacks being null."""
    own = {"claude": ["agent_id"], "codex": ["repo_root"], "opencode": []}
    parts = [events.where(F.col("provider") == p).select("event_id", "provider", "session_id", *extra) for p, extra in own.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
