"""Splitting oversized texts at natural boundaries (problem 3).

Recursive separator hierarchy: a text is split by section, what is still too large by paragraph, then by line and
sentence, word, and at last character; the parts are packed greedily, in order, into pieces of at most ``limit``
bytes of UTF-8, and each piece but the first begins with about ``overlap`` bytes of the one before, from a word
boundary if there is one. Without the overlaps the pieces are exactly the text.

Defined results
* Null and empty texts, and those within the limit, are not split. No code point is cut.
* Repeated deliveries (same session, stream and seq) count once: the lowest event_id, rows without one last.
* Turns are the texts of their events in order of seq, joined by a blank line, which is also the first place to cut. Above
  sections stands one more boundary, at every turn alike: where the bytes of the events before pass a multiple of
  ``RUN_BYTES``, a piece ends. So the runs between are packed apart, no task holds an unbounded turn, and overlap,
  joint and numbers go on from run to run. An event is never spread over runs.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.runtime import cut, map_batches, table

EVENT_LIMIT, TURN_LIMIT, OVERLAP = 4000, 12_000, 200
RUN_BYTES, BLOCK_SEQS = 1 << 20, 4096
JOINT = "\n\n"

#: The hierarchy: a cut is made at the end of each match.
SEPARATORS = (
    re.compile(r"\n(?=#{1,6} )|\n[ \t]*(?:-{3,}|={3,}|\*{3,}|`{3,})[ \t]*\n"),
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"(?:[.!?]+[\"')\]]*\s+|[。！？；]+)"),
    re.compile(r"\s+"),
)


def _size(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))


def _atoms(text: str, a: int, b: int, most: int, level: int) -> list[tuple[int, int]]:
    """Cut text[a:b] at the highest boundaries that leave parts of at most ``most`` bytes."""
    if _size(text[a:b]) <= most:
        return [(a, b)] if a < b else []
    if level == len(SEPARATORS):
        out, start, used = [], a, 0
        for i in range(a, b):
            n = _size(text[i])
            if used + n > most:
                out.append((start, i))
                start, used = i, 0
            used += n
        return [*out, (start, b)]
    out, start = [], a
    for m in SEPARATORS[level].finditer(text, a, b):
        if start < m.end() < b:
            out += _atoms(text, start, m.end(), most, level + 1)
            start = m.end()
    return out + _atoms(text, start, b, most, level + 1)


def _tail(text: str, a: int, b: int, most: int) -> int:
    """Where the overlap before ``b`` begins: at most ``most`` bytes back, not before ``a``, at a word if possible."""
    at, used = b, 0
    while at > a and used + (n := _size(text[at - 1])) <= most:
        at, used = at - 1, used + n
    if at > a and not text[at - 1].isspace():
        m = re.compile(r"\s+").search(text, at, b)
        if m and m.end() < b:
            at = m.end()
    return at


def split(text: str | None, limit: int, overlap: int = OVERLAP, reserve: int = 0) -> list[tuple[int, int, int]]:
    """(start of overlap, start, end) of each piece; the first leaves ``reserve`` bytes for an overlap from elsewhere."""
    if not text:
        return []
    overlap = min(overlap, limit // 2)
    room = limit - min(reserve, overlap)
    if _size(text) <= room:
        return [(0, 0, len(text))]
    pieces: list[tuple[int, int, int]] = []
    start = lead = end = used = 0
    for a, b in _atoms(text, 0, len(text), limit - overlap, 0):
        n = _size(text[a:b])
        if used + n > room and end > start:
            pieces.append((lead, start, end))
            lead = _tail(text, start, end, overlap)
            start, used, room = end, 0, limit - _size(text[lead:end])
        used += n
        end = b
    pieces.append((lead, start, end))
    return pieces


def _events(events: DataFrame) -> DataFrame:
    return events.select("event_id", "session_id", F.coalesce("agent_id", F.lit("")).alias("agent_id"), "turn_index", "seq", "text", F.octet_length("text").alias("bytes")).where("text is not null and session_id is not null and seq is not null")


def _delivery():
    """What puts repeated deliveries in order."""
    return F.struct(F.col("event_id").isNull().alias("unnamed"), "event_id")


_OUT = "session_id string, agent_id string, turn_index int, seq long, piece int, n_pieces int, overlap_bytes int, piece_bytes int, piece_text string"


def split_events(events: DataFrame, limit: int = EVENT_LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every event text of more than ``limit`` bytes."""
    large = (
        _events(events).where(F.col("bytes") > limit).groupBy("session_id", "agent_id", "seq")
        .agg(F.min_by(F.struct(F.coalesce("turn_index", F.lit(-1)).alias("turn_index"), "text"), _delivery()).alias("e"))
        .select("session_id", "agent_id", "e.turn_index", "seq", "e.text")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for s, g, t, q, text in zip(*(c.to_pylist() for c in batch.columns)):
            pieces = split(text, limit, overlap)
            rows += [(s, g, t, q, i, len(pieces), _size(text[o:a]), _size(text[o:b]), text[o:b]) for i, (o, a, b) in enumerate(pieces)]
        return _batch(rows)

    return map_batches(large, run, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=names)


TURN = ["session_id", "agent_id", "turn_index"]


def runs_of(events: DataFrame, limit: int = TURN_LIMIT) -> DataFrame:
    """(session_id, agent_id, turn_index, seq, run) of the events of every turn of more than ``limit`` bytes.

    Bytes are summed up within blocks of seqs and then from block to block, so a long turn is many tasks.
    """
    sizes = _events(events).where("turn_index is not null").drop("text").groupBy(*TURN, "seq").agg(F.min_by("bytes", _delivery()).alias("bytes")).withColumn("blk", F.floor(F.col("seq") / BLOCK_SEQS))
    blocks = sizes.groupBy(*TURN, "blk").agg(F.sum("bytes").alias("n"))
    order = W.partitionBy(*TURN).orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    long = blocks.select(*TURN, "blk", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy(*TURN)).alias("total")).where(F.col("total") > limit)
    inside = F.sum("bytes").over(W.partitionBy(*TURN, "blk").orderBy("seq")) - F.col("bytes")
    return sizes.join(long, [*TURN, "blk"]).select(*TURN, "seq", F.floor((F.col("before") + inside) / RUN_BYTES).alias("run"))


def _packed_turns(events: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of each run, numbered within it; ``tail`` is what the next run's first piece begins with."""
    placed = _events(events).where("turn_index is not null").join(runs_of(events, limit), [*TURN, "seq"])
    kept = placed.groupBy(*TURN, "seq").agg(F.min_by(F.struct("text", "run"), _delivery()).alias("e")).select(*TURN, "seq", "e.text", "e.run")

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        texts, seqs, later = frame["text"].tolist(), frame["seq"].tolist(), key[3] > 0
        whole, starts = (JOINT if later else "") + JOINT.join(texts), [len(JOINT) if later else 0]
        for t in texts[:-1]:
            starts.append(starts[-1] + len(t) + len(JOINT))
        pieces = split(whole, limit, overlap, overlap if later else 0)
        tail = whole[_tail(whole, pieces[-1][1], pieces[-1][2], overlap) :] if pieces else ""
        out = []
        for i, (o, a, b) in enumerate(pieces):
            first = seqs[max(0, bisect.bisect_right(starts, a) - 1)]
            out.append((*key[:3], first, i, len(pieces), _size(whole[o:a]), _size(whole[o:b]), whole[o:b], key[3], tail))
        return pd.DataFrame(out, columns=[*(x.split()[0] for x in _OUT.split(", ")), "run", "tail"])

    return kept.groupBy(*TURN, "run").applyInPandas(pack, f"{_OUT}, run long, tail string")


def split_turns(events: DataFrame, limit: int = TURN_LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every turn of more than ``limit`` bytes; ``seq`` is the first event whose text the piece holds."""
    packed = cut(_packed_turns(events, limit, overlap))
    turn = W.partitionBy(*TURN)
    runs = packed.where("piece = 0").select(
        *TURN, "run", F.coalesce(F.sum("n_pieces").over(turn.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("skip"), F.sum("n_pieces").over(turn).alias("all"), F.lag("tail", 1, "").over(turn.orderBy("run")).alias("lead")
    )
    rows = packed.drop("tail").join(runs, [*TURN, "run"])
    lead = F.when(F.col("piece") == 0, F.col("lead")).otherwise("")
    more = F.octet_length(lead)
    return rows.select(
        *TURN, "seq", (F.col("skip") + F.col("piece")).cast("int").alias("piece"), F.col("all").cast("int").alias("n_pieces"), (F.col("overlap_bytes") + more).alias("overlap_bytes"),
        (F.col("piece_bytes") + more).alias("piece_bytes"), F.concat(lead, "piece_text").alias("piece_text"),
    )


def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    """All pieces: of events, and of turns (``unit`` tells which)."""
    events = table(spark, base, "session_events")
    return split_events(events).withColumn("unit", F.lit("event")).unionByName(split_turns(events).withColumn("unit", F.lit("turn")))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The items that were split."""
    events = table(spark, base, "session_events")
    one = split_events(events).where("piece = 0").select("session_id", "agent_id", "turn_index", "seq")
    turns = _packed_turns(events, TURN_LIMIT, OVERLAP).where("run = 0 and piece = 0").select(*TURN, F.lit(-1).cast("long").alias("seq"))
    return one.unionByName(turns)
