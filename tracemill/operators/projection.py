"""Noise projection: dropping kinds, compressing successful tool results, and what that saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import first_meaningful_line, output_lines

DROPPED = ("file_snapshot", "turn_context", "compaction")


def dropped(keep_snapshots: bool = False, keep_turn_context: bool = False) -> Column:
    """Whether an event is noise: compactions always, snapshots and turn contexts unless they are kept."""
    kinds = [k for k in DROPPED if not (k == "file_snapshot" and keep_snapshots or k == "turn_context" and keep_turn_context)]
    return F.col("kind").isin(*kinds)


def drop_noise(events: DataFrame, keep_snapshots: bool = False, keep_turn_context: bool = False) -> DataFrame:
    return events.where(~F.coalesce(dropped(keep_snapshots, keep_turn_context), F.lit(False)))


def compressible() -> Column:
    return (F.col("kind") == "tool_result") & ~F.coalesce("tool.is_error", F.lit(False))


def call_index(events: DataFrame) -> DataFrame:
    """(call_id, tool_name): by call id alone, the last tool_use with both wins."""
    used = events.where("kind = 'tool_use' and tool.call_id <> '' and tool.name <> ''")
    return used.groupBy(F.col("tool.call_id").alias("call_id")).agg(F.max_by("tool.name", F.struct("session_id", "seq")).alias("tool_name"))


def name_results(events: DataFrame) -> DataFrame:
    """Every tool_result with the name of the call it answers, '' if unknown.

    The index grows with the events, so it is joined by a shuffle on the call id, which Spark turns into a broadcast
    only if it turns out small.
    """
    results = events.where("kind = 'tool_result'").withColumn("call_id", F.coalesce("tool.call_id", F.lit("")))
    return results.join(call_index(events), "call_id", "left").withColumn("tool_name", F.coalesce("tool_name", F.lit("")))


def compress(results: DataFrame) -> DataFrame:
    """What is kept of a successful result: size, lines and the first line that says something."""
    out = F.coalesce("tool.output", F.lit(""))
    return results.where(compressible()).select(
        "session_id", "seq", "turn_index", "call_id", "tool_name", F.octet_length(out).cast("long").alias("output_bytes"), output_lines(out).cast("long").alias("output_lines"),
        F.substring(first_meaningful_line(out), 1, 200).alias("output_head"),
    )


def stats(events: DataFrame) -> DataFrame:
    """Events kept, dropped and compressed, bytes before and after, and the reduction in percent (half to even)."""
    size = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in ("text", "tool.input", "tool.output")), F.lit(60))
    head = F.least(F.octet_length(F.coalesce("tool.output", F.lit(""))), F.lit(200))
    gone, small = F.coalesce(dropped(), F.lit(False)), compressible()
    after = F.when(gone, 0).when(small, F.lit(60) + head).otherwise(size)
    sums = events.agg(
        F.count_if(gone).alias("n_dropped"), F.count_if(small & ~gone).alias("n_compressed"), F.count_if(~gone & ~small).alias("n_kept"),
        F.sum(size).cast("long").alias("bytes_in"), F.sum(after).cast("long").alias("bytes_out"),
    )
    return sums.withColumn("reduction_percent", F.bround((1 - F.col("bytes_out") / F.col("bytes_in")) * 100, 0).cast("long"))
