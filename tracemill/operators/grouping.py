"""Atomic groups of events, their packing into chunks of bounded size, and the manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

TRAILING = ("file_change", "command")


def line() -> Column:
    """An event as the line whose size and hash chunks are made of."""
    return F.concat(F.concat_ws("|", F.col("seq").cast("string"), F.col("kind"), F.coalesce("text", F.lit("")), F.coalesce("tool.input", F.lit("")), F.coalesce("tool.output", F.lit(""))), F.lit("\n"))


def atomic_groups(events: DataFrame) -> DataFrame:
    """Add ``leader``, the seq of the event that leads each event's group.

    A tool_use with a call id leads all of its stream up to the next tool_use, or to its result, and the file changes and
    commands right behind that; everything else leads itself. Exact where a session's streams are not interleaved;
    see ``with_leaders`` for those that are.
    """
    stream = W.partitionBy("session_id", F.coalesce(F.col("agent_id"), F.lit("")))
    order, call = stream.orderBy("seq"), F.nullif(F.col("tool.call_id"), F.lit(""))
    led = events.withColumn("lead_seq", F.last(F.when(F.col("kind") == "tool_use", F.col("seq")), ignorenulls=True).over(order))
    led = led.withColumn("lead_call", F.last(F.when(F.col("kind") == "tool_use", F.coalesce(call, F.lit(""))), ignorenulls=True).over(order))
    segment = W.partitionBy("session_id", F.coalesce(F.col("agent_id"), F.lit("")), "lead_seq")
    led = led.withColumn("closed", F.min(F.when((F.col("kind") == "tool_result") & (call == F.col("lead_call")), F.col("seq"))).over(segment))
    other = F.when((F.col("seq") > F.col("closed")) & ~F.col("kind").isin(*TRAILING), F.col("seq"))
    led = led.withColumn("stop", F.min(other).over(segment))
    member = (F.col("lead_call") != "") & (F.col("closed").isNull() | (F.col("seq") <= F.col("closed")) | (F.col("kind").isin(*TRAILING) & F.coalesce(F.col("seq") < F.col("stop"), F.lit(True))))
    leader = F.when(F.coalesce(member, F.lit(False)) | (F.col("seq") == F.col("lead_seq")), F.col("lead_seq")).otherwise(F.col("seq"))
    return led.withColumn("leader", leader).drop("lead_seq", "lead_call", "closed", "stop")


def fold_groups(rows: list[tuple]) -> list[int]:
    """The same for interleaved streams, as one fold: rows of (kind, stream, call) in order, to the index of each one's leader."""
    leader: list[int | None] = [None] * len(rows)
    for i, (kind, stream, call) in enumerate(rows):
        if leader[i] is not None:
            continue
        leader[i] = i
        if kind != "tool_use" or not call:
            continue
        closed = False
        for j in range(i + 1, len(rows)):
            if leader[j] is not None:
                continue
            other, near, its_call = rows[j]
            if closed:
                if near != stream or other not in TRAILING:
                    break
            elif near != stream:
                continue
            elif other == "tool_use":
                break
            leader[j] = i
            closed = closed or other == "tool_result" and its_call == call
    return leader


class Groups:
    """The same one event after the other; what is kept is one open group per stream."""

    def __init__(self):
        self.open: dict[str, list] = {}

    def leader(self, at: int, kind: str, stream: str, call: str) -> int:
        group, taken = self.open.get(stream), None
        if group and kind != "tool_use":
            if not group[2]:
                taken = group[0]
                group[2] = kind == "tool_result" and call == group[1]
            elif kind in TRAILING:
                taken = group[0]
            else:
                del self.open[stream]
        # an event that no earlier group took ends the trailing runs of the other streams
        for other in [s for s, g in self.open.items() if g[2] and s != stream and (taken is None or taken > g[0])]:
            del self.open[other]
        if kind == "tool_use":
            self.open.pop(stream, None)
            if call:
                self.open[stream] = [at, call, False]
        return at if taken is None else taken


def with_leaders(events: DataFrame) -> DataFrame:
    """The events with ``leader``, for streams that are interleaved: sorted sessions run through the tasks batch by batch."""
    keys = [F.coalesce("agent_id", F.lit("")).alias("_stream"), F.coalesce("tool.call_id", F.lit("")).alias("_call")]
    ordered = events.select("*", *keys).repartition("session_id").sortWithinPartitions("session_id", "seq")
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, groups = None, Groups()
        for batch in batches:
            leaders = []
            for s, q, kind, stream, call in zip(*(batch.column(c).to_pylist() for c in ("session_id", "seq", "kind", "_stream", "_call"))):
                if s != session:
                    session, groups = s, Groups()
                leaders.append(groups.leader(q, kind, stream, call))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(leaders, pa.int64())], names=[*names, "leader"])

    return ordered.mapInArrow(run, StructType([*events.schema.fields, StructField("leader", LongType())]))


def interleaved_groups(events: DataFrame) -> DataFrame:
    """(session_id, seq, leader) alone."""
    return with_leaders(events.select("session_id", "seq", "kind", "agent_id", F.struct("tool.call_id").alias("tool"))).select("session_id", "seq", "leader")


def next_fit(sizes: Column, target: int) -> Column:
    """The chunk number of each size, in order: a size of the target or more is a chunk, else chunks are closed when full."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("chunk"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s, x):
        alone = x >= target
        fresh = alone | (s["used"] == 0) | (s["used"] + x > target)
        chunk = F.when(fresh, s["chunk"] + 1).otherwise(s["chunk"])
        used = F.when(alone, F.lit(0).cast("long")).when(fresh, x).otherwise(s["used"] + x)
        return F.struct(used.alias("used"), chunk.alias("chunk"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def pack_chunks(grouped: DataFrame, target: int) -> DataFrame:
    """(session_id, leader, size, chunk): next-fit packing of each session's groups in order of their leaders.

    Where a chunk ends depends on all groups before. The sorted groups run through the tasks batch by batch with
    the state of the last one, so that memory stays bounded however long a session is.
    """
    sizes = grouped.groupBy("session_id", "leader").agg(F.sum(F.length(line())).cast("long").alias("size"))
    ordered = sizes.repartition("session_id").sortWithinPartitions("session_id", "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, used, chunk = None, 0, -1
        for batch in batches:
            chunks = []
            for s, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if s != session:
                    session, used, chunk = s, 0, -1
                fresh = size >= target or used == 0 or used + size > target
                chunk += fresh
                used = 0 if size >= target else size if fresh else used + size
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int32())], names=["session_id", "leader", "size", "chunk"])

    return ordered.mapInArrow(run, "session_id string, leader long, size long, chunk int")


def chunk_rows(grouped: DataFrame, target: int) -> DataFrame:
    """The events with their chunk and place in it."""
    packed = pack_chunks(grouped, target).select("session_id", "leader", "chunk")
    rows = grouped.join(packed, ["session_id", "leader"])
    return rows.withColumn("place", F.row_number().over(W.partitionBy("session_id", "chunk").orderBy("leader", "seq")))


def refine(rows: DataFrame, target: int) -> DataFrame:
    """Split chunks beyond the target once, behind the last user message that leaves the first part within it; adds ``half``."""
    chunk = W.partitionBy("session_id", "chunk")
    size = F.length(line())
    rows = rows.withColumn("running", F.sum(size).over(chunk.orderBy("place"))).withColumn("whole", F.sum(size).over(chunk)).withColumn("n", F.count("*").over(chunk))
    good = (F.col("kind") == "user_message") & (F.col("place") > 1) & (F.col("place") < F.col("n")) & (F.col("running") <= target) & (F.col("whole") > target)
    rows = rows.withColumn("split_at", F.max(F.when(good, F.col("place"))).over(chunk))
    return rows.withColumn("half", F.coalesce((F.col("place") > F.col("split_at")).cast("int"), F.lit(0))).drop("running", "whole", "n", "split_at")


def manifest(rows: DataFrame) -> DataFrame:
    """One row per chunk: lines, bytes, events, time range and the hash of its lines in order."""
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line().alias("line")))), lambda x: x["line"]), "")
    stamp = F.nullif(F.col("ts"), F.lit(""))
    number = F.row_number().over(W.partitionBy("session_id").orderBy("chunk", "half"))
    return rows.groupBy("session_id", "chunk", "half").agg(
        F.min("source_line").alias("line_start"), F.max("source_line").alias("line_end"), F.sum(F.octet_length(line())).alias("byte_size"), F.count("*").alias("event_count"),
        F.min(stamp).alias("range_start"), F.max(stamp).alias("range_end"), F.sha2(content, 256).alias("sha256"),
    ).withColumn("chunk_id", F.format_string("chunk-%03d", number)).drop("chunk", "half")
