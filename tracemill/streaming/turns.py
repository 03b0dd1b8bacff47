"""Turns and counts over a running stream of events.

The batch operators number turns by a window; over a stream the count of each session's stream is the state. Events that come
later than ``delay`` behind the newest are left out by the watermark, as everywhere in structured streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, agent_id string, seq long, kind string, turn long"


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (turn,) = state.get if state.exists else (0,)
    frame = pd.concat(list(frames)).sort_values("seq")
    frame["turn"] = turn + frame["visible"].astype("int64").cumsum()
    if len(frame):
        state.update((int(frame["turn"].iloc[-1]),))
    yield frame[["session_id", "agent_id", "seq", "kind", "turn"]]


def running_turns(events: DataFrame) -> DataFrame:
    """(session_id, agent_id, seq, kind, turn) of a stream of events that come in order of seq within each session's stream."""
    kind = F.lower(F.trim("kind"))
    visible = (kind == "user_message") & F.coalesce(F.trim("text") != "", F.lit(False))
    rows = events.select("session_id", F.coalesce("agent_id", F.lit("")).alias("agent_id"), "seq", kind.alias("kind"), visible.alias("visible"))
    return rows.groupBy("session_id", "agent_id").applyInPandasWithState(_count, OUT, "turn long", "append", GroupStateTimeout.NoTimeout)


def kind_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events of each kind per window of arrival, final once the watermark has passed the window."""
    seen = events.withColumn("at", F.col("ingested_at").cast("timestamp")).withWatermark("at", delay)
    return seen.groupBy(F.window("at", width), F.lower(F.trim("kind")).alias("kind")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "kind", "n")


def deduplicated(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of events without repeated deliveries that arrive within ``delay``."""
    return events.withColumn("at", F.col("ingested_at").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["session_id", "seq"])
