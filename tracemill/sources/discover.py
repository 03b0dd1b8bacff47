"""Session descriptors from the places where the tools leave their transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.text import epoch_ms_iso
from tracemill.sources.jsonl import count_lines, file_sizes, records

COLUMNS = ("provider", "path", "timestamp", "size_bytes", "line_count", "cwd", "model")


def _get(path: str, kind: str = "string"):
    return F.expr(f"try_variant_get(rec, '$.{path}', '{kind}')")


def codex(spark: SparkSession, root: str) -> DataFrame:
    """Rollout files at any depth, of 1024 bytes or more, that begin with a session_meta."""
    files = file_sizes(spark, "rollout-*.jsonl", root)
    lines = _below(spark, root, "rollout-*.jsonl")
    first = records(lines.where("source_line = 1")).where(_get("type") == "session_meta")
    meta = first.select("source_path", F.coalesce(_get("payload.timestamp"), _get("timestamp")).alias("timestamp"), _get("payload.cwd").alias("cwd"), _get("payload.model_provider").alias("model"))
    return _described(files.join(meta, "source_path").join(count_lines(lines), "source_path"), "codex")


def _below(spark: SparkSession, root: str, glob: str) -> DataFrame:
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    lines = whole.select(F.regexp_replace("_metadata.file_path", r"^file:/+", "/").alias("source_path"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return lines.select("source_path", (F.col("at") + 1).alias("source_line"), "line")


def claude(spark: SparkSession, root: str) -> DataFrame:
    """Project files of 1024 bytes or more that aren't subagents'; the first user record with a folder and the first model
    describe a session, the file's time stands in for a missing one."""
    main = ~F.col("source_path").contains("/subagents/")
    files, lines = file_sizes(spark, "*.jsonl", root).where(main), _below(spark, root, "*.jsonl")
    recs = records(lines.where(main))
    at = lambda value, where: F.min_by(value, F.when(where, F.col("source_line")))
    user = (_get("type") == "user") & _get("cwd").isNotNull()
    model = _get("message.model")
    told = recs.groupBy("source_path").agg(
        at(_get("cwd"), user).alias("cwd"), at(_get("sessionId"), user).alias("session_id"), at(_get("version"), user).alias("cli_version"), at(_get("timestamp"), user).alias("timestamp"),
        at(model, (_get("type") == "assistant") & model.isNotNull()).alias("model"),
    )
    subs = lines.where(~main).select("source_path").distinct().select(F.regexp_extract("source_path", r"([^/]+)/subagents/[^/]+$", 1).alias("session_id"), "source_path")
    subs = subs.groupBy("session_id").agg(F.array_sort(F.collect_list("source_path")).alias("subagent_paths"))
    rows = files.join(told, "source_path").join(count_lines(lines), "source_path").join(subs, "session_id", "left")
    rows = rows.withColumn("timestamp", F.coalesce("timestamp", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ssXXX")))
    return _described(rows, "claude", "session_id", "cli_version", "subagent_paths")


def opencode(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """From the three tables of the store, read through any source: sizes are aggregated before the joins."""
    size = lambda rows, n, b: rows.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias(n), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias(b))
    rows = session.join(size(message, "n_messages", "message_bytes"), "id", "left").join(size(part, "n_parts", "part_bytes"), "id", "left").fillna(0, ["n_messages", "message_bytes", "n_parts", "part_bytes"])
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    rows = rows.select(
        F.concat(F.lit("opencode://session/"), "id").alias("source_path"), F.col("id").alias("session_id"), epoch_ms_iso(F.coalesce(F.nullif("time_created", F.lit(0)), "time_updated")).alias("timestamp"),
        (length("title") + length("directory") + F.col("message_bytes") + F.col("part_bytes")).alias("size_bytes"), (1 + F.col("n_messages") + F.col("n_parts")).alias("line_count"),
        F.col("directory").alias("cwd"), F.lit(None).cast("string").alias("model"), F.nullif("parent_id", F.lit("")).alias("parent_session_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("version", F.lit("")).alias("cli_version"),
    )
    return _described(rows, "opencode", "session_id", "parent_session_id", "title", "cli_version")


def _described(rows: DataFrame, provider: str, *more: str) -> DataFrame:
    return rows.withColumn("provider", F.lit(provider)).withColumnRenamed("source_path", "path").select(*COLUMNS, *more)


def matching(sessions: DataFrame, since: str | None = None, until: str | None = None, project: str | None = None, cwd: str | None = None) -> DataFrame:
    """Sessions in a time range, ends included (those without a readable time pass), of a project and below a folder."""
    at = F.expr("try_to_timestamp(timestamp)")
    keep = F.lit(True)
    if since:
        keep = keep & F.coalesce(at >= F.to_timestamp(F.lit(since)), F.lit(True))
    if until:
        keep = keep & F.coalesce(at <= F.to_timestamp(F.lit(until)), F.lit(True))
    folder = F.coalesce("cwd", F.lit(""))
    return sessions.where(keep & folder.contains(project or "") & folder.startswith(cwd or "")).orderBy(F.coalesce("timestamp", F.lit("")).desc(), "path")
