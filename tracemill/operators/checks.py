"""Contract checks of the stages: each is a row (check, n_bad, passed), all in one table, none stops the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators.events import contiguity, stream_window
from tracemill.operators.links import split_pairs, unpaired

PROVIDERS = ("codex", "claude", "opencode")
REQUIRED = ("seq", "kind", "turn_index", "ts", "provider", "session_id", "source_path")


def _row(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(F.lit(name).alias("check"), F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"))


def _together(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("n_bad") == 0)


def counts(events: DataFrame, **conditions: Column) -> DataFrame:
    """One row per condition, all counted in a single pass."""
    sums = events.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in conditions))
    return sums.select(F.inline(pairs))


def normalized(events: DataFrame) -> DataFrame:
    plain = counts(
        events, **{f"missing_{c}": F.col(c).isNull() for c in REQUIRED}, invalid_provider=~F.col("provider").isin(*PROVIDERS), empty_session=F.coalesce(F.col("session_id") == "", F.lit(True)),
        meta_turn=(F.col("kind") == "meta") & (F.col("turn_index") != 0),
    )
    order = stream_window()
    users = events.where("kind = 'user_message'").withColumn("rank", F.row_number().over(order)).where("rank = 1 and turn_index <> 1").agg(F.count("*").alias("n_bad"))
    rises = repeated_or_falling(events)
    falls = events.select("session_id", "agent_id", "turn_index", "seq").withColumn("fell", F.col("turn_index") < F.lag("turn_index").over(order)).agg(F.count_if("fell").alias("n_bad"))
    return _together([plain, _row(users, "first_user_turn"), _row(falls, "turn_regression"), _row(unpaired(events).agg(F.count("*").alias("n_bad")), "orphan_tool_use"), _row(contiguity(events, "event_id").agg(F.count("*").alias("n_bad")), "not_contiguous"), _row(rises, "seq_not_rising"), empty(events)])


def empty(rows: DataFrame) -> DataFrame:
    """No rows at all are a fault of any stage."""
    return rows.limit(1).agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("n_bad")).select(F.lit("empty_input").alias("check"), F.col("n_bad").cast("long").alias("n_bad"))


def repeated_or_falling(events: DataFrame, line: str = "source_line") -> DataFrame:
    """How often seq does not rise from a line to the next of its file, as a count of lines: files are compared in blocks of lines
    with the last seq of the block before, so no task gets a whole file."""
    rows = events.select("source_path", line, "seq").withColumn("_blk", F.floor(F.col(line) / 4096))
    key = ["source_path", "_blk"]
    last = rows.groupBy(*key).agg(F.max_by("seq", F.struct(line, "seq")).alias("_last"))
    before = last.select(*key, F.lag("_last").over(W.partitionBy("source_path").orderBy("_blk")).alias("_before"))
    previous = F.coalesce(F.lag("seq").over(W.partitionBy(*key).orderBy(line, "seq")), F.col("_before"))
    return rows.join(before, key).withColumn("_bad", F.col("seq") <= previous).agg(F.count_if(F.coalesce("_bad", F.lit(False))).alias("n_bad"))


def projected(events: DataFrame, compressed: DataFrame) -> DataFrame:
    """After projection: no dropped kinds, no data of pictures (if there is a column ``data_b64``), every good result compressed, no error result compressed."""
    data = F.coalesce(F.col("data_b64") != "", F.lit(False)) if "data_b64" in events.columns else F.lit(False)
    plain = counts(events, **{f"kept_{k}": F.col("kind") == k for k in ("file_snapshot", "turn_context", "compaction")}, kept_data=data)
    results = events.where("kind = 'tool_result'").join(compressed.select("session_id", "seq", F.lit(True).alias("small")), ["session_id", "seq"], "left")
    failed, small = F.coalesce("tool.is_error", F.lit(False)), F.coalesce("small", F.lit(False))
    return _together([plain, counts(results, uncompressed_result=~failed & ~small, compressed_error=failed & small), empty(events)])


def chunked(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """A manifest against the chunks' rows: hash there, lines in order, count of events, no call apart from its result.

    If the rows have ``place`` and ``line``, what was written, hash and size are computed anew from them.
    """
    key = ["session_id", "chunk_id"]
    written = {"place", "line"} <= set(rows.columns)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "") if written else F.lit(None).cast("string")
    size = F.sum(F.octet_length("line")) if written else F.lit(None).cast("long")
    actual = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sha2(content, 256).alias("hash"), size.alias("bytes"))
    both = chunks.join(actual, key, "left")
    plain = counts(
        both, missing_hash=F.col("sha256").isNull(), bad_range=F.col("line_start") > F.col("line_end"), no_rows=F.col("n").isNull(), wrong_count=F.col("n") != F.col("event_count"),
        **({"wrong_hash": F.col("hash") != F.col("sha256"), "wrong_size": F.col("bytes") != F.col("byte_size")} if written else {}),
    )
    apart = split_pairs(rows, *key).agg(F.count("*").alias("n_bad"))
    return _together([plain, _row(apart, "split_pair"), empty(chunks)])
