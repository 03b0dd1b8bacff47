"""Scans of JSON-lines transcripts and JSON documents, and the sinks of events, chunks and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.text import strip


def scan_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(source_path, source_line, line): every line of the files with its number, blank ones included.

    A transcript is one session's and read whole by one task, which alone keeps true line numbers.
    """
    whole = spark.read.text(list(paths), wholetext=True).select(F.regexp_replace("_metadata.file_path", r"^file:/+", "/").alias("source_path"), "value")
    lines = whole.select("source_path", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return lines.select("source_path", (F.col("at") + 1).alias("source_line"), "line")


def records(lines: DataFrame) -> DataFrame:
    """Add ``rec``, the object a line holds; blank and malformed lines and other values are left out silently."""
    clean = lines.withColumn("line", strip("line")).where("line <> ''").withColumn("rec", F.try_parse_json("line"))
    return clean.where("rec is not null and schema_of_variant(rec) like 'OBJECT%'")


def scan_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    return records(scan_lines(spark, *paths))


def load_export(spark: SparkSession, *paths: str) -> DataFrame:
    """The same for exports, where a malformed line is an error."""
    clean = scan_lines(spark, *paths).withColumn("line", strip("line")).where("line <> ''")
    return clean.withColumn("rec", F.parse_json("line"))


def read_document(spark: SparkSession, *paths: str) -> DataFrame:
    """(source_path, doc): whole files of one JSON value each."""
    return spark.read.text(list(paths), wholetext=True).select(F.regexp_replace("_metadata.file_path", r"^file:/+", "/").alias("source_path"), F.parse_json("value").alias("doc"))


def file_sizes(spark: SparkSession, glob: str, root: str, least: int = 1024) -> DataFrame:
    """(source_path, size_bytes, modified) of the files below ``root`` that match ``glob`` and have a size; nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.where(F.col("length") >= least).select(F.regexp_replace("path", r"^file:/+", "/").alias("source_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def count_lines(lines: DataFrame) -> DataFrame:
    """Lines per file; text behind the last line end is a line, nothing behind it isn't."""
    last = F.max_by("line", "source_line")
    return lines.groupBy("source_path").agg((F.max("source_line") - F.when(last == "", 1).otherwise(0)).cast("long").alias("line_count"))


def flatten_export(docs: DataFrame) -> DataFrame:
    """Lines of a nested export: one for the session, one for each message that has an info object."""
    info = F.expr("to_json(try_variant_get(doc, '$.info', 'variant'))")
    head = docs.select("source_path", F.lit(0).alias("at"), F.concat(F.lit('{"type":"session","info":'), info, F.lit("}")).alias("line"))
    each = docs.select("source_path", F.posexplode(F.expr("try_variant_get(doc, '$.messages', 'array<variant>')")).alias("p", "m"))
    good = each.where("schema_of_variant(try_variant_get(m, '$.info', 'variant')) like 'OBJECT%'")
    parts = F.coalesce(F.expr("to_json(try_variant_get(m, '$.parts', 'array<variant>'))"), F.lit("[]"))
    body = F.concat(F.lit('{"type":"message","info":'), F.expr("to_json(try_variant_get(m, '$.info', 'variant'))"), F.lit(',"parts":'), parts, F.lit("}"))
    return head.unionByName(good.select("source_path", (F.col("p") + 1).alias("at"), body.alias("line")))


def write_jsonl(events: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON object a line, nulls left out; with ``order`` the files, by name, hold the lines in that order: ranges of it, sorted, so no task gets all."""
    rows = events.select(F.to_json(F.struct("*")).alias("value"), *(order or []))
    (rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).select("value").write.mode("overwrite").text(path)


def write_chunks(rows: DataFrame, path: str) -> None:
    """A folder per session, therein one per chunk with its lines in order. ``rows``: session_id, chunk_id (unique within a session), place, line."""
    ordered = rows.repartition("session_id", "chunk_id").sortWithinPartitions("session_id", "chunk_id", "place")
    ordered.select("session_id", "chunk_id", F.regexp_replace("line", "\n$", "").alias("value")).write.mode("overwrite").partitionBy("session_id", "chunk_id").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, chunk_id, value) of the lines that ``write_chunks`` wrote."""
    return spark.read.text(path).select("session_id", "chunk_id", "value")


def write_manifest(chunks: DataFrame, path: str, source: str = "", target_bytes: int = 0) -> None:
    """The manifest as JSON lines: a head with the source and the target size, then the chunks' entries in order."""
    rows = chunks.select("session_id", "chunk_id", F.lit(1).alias("_part"), F.to_json(F.struct(*chunks.columns)).alias("value"))
    head = chunks.sparkSession.createDataFrame([(source, target_bytes)], "source string, target_bytes long").select(F.lit("").alias("session_id"), F.lit("").alias("chunk_id"), F.lit(0).alias("_part"), F.to_json(F.struct("source", "target_bytes")).alias("value"))
    order = ("_part", "session_id", "chunk_id")
    head.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def captures(shots: DataFrame) -> DataFrame:
    """A manifest of captures, one row: the shots of each commit, those that were skipped, and the commits in order. ``shots``: place, commit, route, path, skip."""
    kept = shots.where("skip is null").groupBy("commit").agg(F.min("place").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("place", "route", "path"))), lambda x: F.struct(x["route"].alias("route"), x["path"].alias("path"))).alias("shots"))
    commits = kept.agg(F.map_from_entries(F.collect_list(F.struct("commit", "shots"))).alias("commits"), F.transform(F.array_sort(F.collect_list(F.struct("first", "commit"))), lambda x: x["commit"]).alias("order"))
    skipped = shots.where("skip is not null").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "route", "skip"))), lambda x: F.struct(x["route"].alias("route"), x["skip"].alias("reason"))).alias("skipped"))
    return commits.join(skipped)
