"""Session cards: what happened in a session, in one row, and the parts it is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import first_meaningful_line, first_sentence

CAPS = {"files": 50, "commands": 30, "errors": 20, "intents": 20}


def filled(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(""))


def scalars(events: DataFrame) -> DataFrame:
    """Provider and model seen first, time range, turns, events and subagents of each session."""
    first = lambda c, where=F.lit(True): F.min_by(c, F.when(c.isNotNull() & where, F.col("seq")))
    turns = F.coalesce(F.max(F.col("turn_index")), F.lit(0))
    asked = F.coalesce(F.bool_or(F.col("kind") == "user_message"), F.lit(False))
    return events.groupBy("session_id").agg(
        first(filled("provider")).alias("provider"), F.coalesce(first(filled("meta.model"), F.col("kind") == "meta"), F.lit("")).alias("model"),
        F.min(filled("ts")).alias("ts_start"), F.max(filled("ts")).alias("ts_end"),
        F.when(turns > 0, turns).when(asked, 1).otherwise(0).cast("long").alias("turns"), F.count("*").alias("events"),
        F.array_join(F.array_sort(F.collect_set(filled("agent_id"))), ",").alias("subagents"),
    )


def files(events: DataFrame, cap: int = CAPS["files"]) -> DataFrame:
    """The first ``cap`` paths of each session by name, with the kinds and turns of their changes."""
    touched = events.where("kind = 'file_change' and file_change.path <> ''").select("session_id", F.col("file_change.path").alias("path"), F.coalesce("file_change.kind", F.lit("modify")).alias("change"), "turn_index")
    per = touched.groupBy("session_id", "path").agg(F.array_join(F.array_sort(F.collect_set("change")), ",").alias("kinds"), F.array_join(F.transform(F.array_sort(F.collect_set("turn_index")), lambda x: x.cast("string")), ",").alias("turns"))
    rank = F.row_number().over(W.partitionBy("session_id").orderBy("path"))
    return per.withColumn("rank", rank).where(F.col("rank") <= cap)


def commands(events: DataFrame, cap: int = CAPS["commands"]) -> DataFrame:
    run = events.where("kind = 'command' and command.cmd <> ''")
    rank = F.row_number().over(W.partitionBy("session_id").orderBy("seq"))
    return run.withColumn("rank", rank).where(F.col("rank") <= cap).select("session_id", "rank", F.substring("command.cmd", 1, 200).alias("cmd"), "command.exit_code", F.col("turn_index").alias("turn"))


def error_lines(events: DataFrame) -> DataFrame:
    """(session_id, seq, error) of failed commands and of error results."""
    failed = F.when(
        (F.col("kind") == "command") & (F.col("command.cmd") != "") & F.coalesce(F.col("command.exit_code") != 0, F.lit(False)),
        F.concat(F.lit("Command failed (exit "), F.col("command.exit_code").cast("string"), F.lit("): "), F.substring("command.cmd", 1, 120)),
    )
    broken = F.when((F.col("kind") == "tool_result") & F.coalesce("tool.is_error", F.lit(False)), F.nullif(F.substring(first_meaningful_line("tool.output"), 1, 200), F.lit("")))
    return events.select("session_id", "seq", F.coalesce(failed, broken).alias("error")).where("error is not null")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` distinct values of each key in order of first sight, with their rank."""
    seen = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    return seen.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("_first", value))).where(F.col("rank") <= cap).drop("_first")


def errors(events: DataFrame, cap: int = CAPS["errors"]) -> DataFrame:
    return ordered_distinct(error_lines(events), "session_id", "error", "seq", cap)


def intents(events: DataFrame, cap: int = CAPS["intents"]) -> DataFrame:
    said = events.where("kind = 'user_message' and text <> ''").select("session_id", "seq", first_sentence("text").alias("intent")).where("intent <> ''")
    return ordered_distinct(said, "session_id", "intent", "seq", cap)


def cards(events: DataFrame) -> DataFrame:
    """One nested row per session."""
    nest = lambda rows, name, *cols: rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias(name))
    out = scalars(events)
    for part in (
        nest(files(events), "files_touched", "path", "kinds", "turns"), nest(commands(events), "commands_run", "cmd", "exit_code", "turn"),
        nest(errors(events), "errors", "error"), nest(intents(events), "user_intents", "intent"),
    ):
        out = out.join(part, "session_id", "left")
    return out


def kind_top(events: DataFrame, key: str = "session_id", n: int = 5) -> DataFrame:
    """The ``n`` most frequent kinds of each key, ties by first sight."""
    counts = events.groupBy(key, "kind").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= n).drop("first")


def narrative(events: DataFrame) -> DataFrame:
    """The deterministic summary of each session as one sentence after another."""
    pos = lambda rows, name: rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", name))).alias("l")).select("session_id", F.transform("l", lambda x: x[name]).alias(name))
    kinds = kind_top(events).withColumn("said", F.concat_ws(": ", "kind", F.col("n").cast("string")))
    counts = events.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce((F.col("kind") == "command") & (F.col("command.cmd") != ""), F.lit(False))).alias("n_commands"))
    said = events.where("kind = 'user_message' and text <> ''").select("session_id", "seq", first_sentence("text", 80, stripped=False).alias("intent")).where("intent <> ''")
    changed = events.where("kind = 'file_change' and file_change.path <> ''").select("session_id", "seq", F.col("file_change.path").alias("path"))
    names = ordered_distinct(changed, "session_id", "path", "seq", 8).withColumn("name", F.substring_index("path", "/", -1))
    failed = error_lines(events).groupBy("session_id").agg(F.count("*").alias("n_errors"))
    out = counts.join(pos(kinds, "said"), "session_id", "left").join(pos(ordered_distinct(said, "session_id", "intent", "seq", 5), "intent"), "session_id", "left").join(pos(names, "name"), "session_id", "left").join(failed, "session_id", "left")
    parts = F.concat_ws(
        " ", F.format_string("%s: %d events (%s).", "session_id", "n", F.array_join("said", ", ")),
        F.when(F.size("intent") > 0, F.concat(F.lit("User intents: "), F.array_join("intent", "; "), F.lit("."))), F.when(F.size("name") > 0, F.concat(F.lit("Files: "), F.array_join("name", ", "), F.lit("."))),
        F.when(F.col("n_commands") > 0, F.format_string("%d commands run.", "n_commands")), F.when(F.col("n_errors") > 0, F.format_string("%d error(s).", "n_errors")),
    )
    return out.select("session_id", parts.alias("narrative"))


def consensus(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A column's value where all its filled values agree, else null."""
    agree = lambda c: F.when(F.min(filled(c)) == F.max(filled(c)), F.max(filled(c)))
    return rows.groupBy(key).agg(*(agree(c).alias(c.replace("meta.", "")) for c in columns))


def sources(events: DataFrame) -> DataFrame:
    """(provider, source_path, first_ts, rank): the transcripts in order of their first timestamp, missing ones last."""
    per = events.where("provider <> '' and source_path <> ''").groupBy("provider", "source_path").agg(F.min(filled("ts")).alias("first_ts"))
    return per
