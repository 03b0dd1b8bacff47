"""Queries of the event operators over the test tables; each name has its SQL in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.operators import cards, checks, clean, documents as D, events as E, gate, grouping, links, projection, report, summaries
from tracemill.runtime import clean_kind, scratch, table
from tracemill.sources import jsonl

TARGET = 6000
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- the stream -------------------------------------------------------------


@query
def turn_index(spark: SparkSession, base: str) -> DataFrame:
    return E.turn_index(E.load(spark, base, "agent_id", "text")).select("event_id", F.col("turn").cast("long").alias("turn"))


@query
def turn_regressions(spark: SparkSession, base: str) -> DataFrame:
    return E.turn_regressions(E.load(spark, base, "agent_id", "turn_index"))


@query
def seq_reseq(spark: SparkSession, base: str) -> DataFrame:
    return E.resequence(E.load(spark, base, "ts", "source_path")).select("event_id", F.col("global_seq").cast("long").alias("global_seq"))


@query
def ts_carry_forward(spark: SparkSession, base: str) -> DataFrame:
    return E.carry_ts(E.load(spark, base, "agent_id", "ts")).select("event_id", "carried_ts")


@query
def expected_session_filter(spark: SparkSession, base: str) -> DataFrame:
    rows = E.load(spark, base, "source_path", "source_line")
    expected = rows.groupBy("source_path").agg(F.max("session_id").alias("expected_id"))
    return E.from_expected(rows, expected).select("event_id", "source_path")


@query
def session_contiguity(spark: SparkSession, base: str) -> DataFrame:
    rows = E.load(spark, base)
    return E.contiguity(rows, "event_id").select("session_id", "first_pos", "last_pos", F.col("n").alias("n_events"))


@query
def union_providers(spark: SparkSession, base: str) -> DataFrame:
    return E.union_providers(E.load(spark, base, "provider", "agent_id", "repo_root")).select("event_id", "provider", "agent_id", "repo_root")


@query
def kind_histogram(spark: SparkSession, base: str) -> DataFrame:
    return E.load(spark, base, "provider").groupBy("provider", "kind").agg(F.count("*").alias("n"))


# --- projection -------------------------------------------------------------


@query
def project_drop(spark: SparkSession, base: str) -> DataFrame:
    return projection.drop_noise(E.load(spark, base)).select("event_id", "kind")


@query
def project_drop_keeping(spark: SparkSession, base: str) -> DataFrame:
    return projection.drop_noise(E.load(spark, base), keep_snapshots=True, keep_turn_context=True).groupBy("kind").agg(F.count("*").alias("n"))


@query
def call_index_join(spark: SparkSession, base: str) -> DataFrame:
    return projection.name_results(E.load(spark, base, "tool")).select("event_id", "call_id", "tool_name")


@query
def project_compress(spark: SparkSession, base: str) -> DataFrame:
    return projection.compress(projection.name_results(E.load(spark, base, "tool", "turn_index")))


@query
def projection_stats(spark: SparkSession, base: str) -> DataFrame:
    return projection.stats(E.load(spark, base, "text", "tool"))


# --- groups and chunks ------------------------------------------------------


def _grouped(spark: SparkSession, base: str) -> DataFrame:
    """All streams of a session in one order, main and subagents interleaved."""
    return grouping.with_leaders(E.load(spark, base, "agent_id", "text", "tool", "ts", "source_line"))


@query
def atomic_groups(spark: SparkSession, base: str) -> DataFrame:
    return grouping.with_leaders(E.load(spark, base, "agent_id", "tool")).select("event_id", "leader")


@query
def interleaved_groups(spark: SparkSession, base: str) -> DataFrame:
    return grouping.interleaved_groups(E.load(spark, base, "agent_id", "tool"))


@query
def chunk_pack(spark: SparkSession, base: str) -> DataFrame:
    return grouping.pack_chunks(_grouped(spark, base), TARGET)


@query
def chunk_refine(spark: SparkSession, base: str) -> DataFrame:
    return grouping.refine(grouping.chunk_rows(_grouped(spark, base), TARGET), TARGET).groupBy("session_id", "chunk", "half").agg(F.count("*").alias("n"))


@query
def chunk_manifest(spark: SparkSession, base: str) -> DataFrame:
    return grouping.manifest(grouping.refine(grouping.chunk_rows(_grouped(spark, base), TARGET), TARGET))


def _chunk_lines(spark: SparkSession, base: str) -> DataFrame:
    """Events of all streams with the listed chunk whose lines hold them."""
    rows = E.load(spark, base, "tool", "source_line")
    return rows.join(table(spark, base, "chunks"), "session_id").where("source_line between line_start and line_end")


@query
def split_pairs(spark: SparkSession, base: str) -> DataFrame:
    return links.split_pairs(_chunk_lines(spark, base), "session_id", "chunk_id")


# --- cards and summaries ----------------------------------------------------


@query
def session_card_scalars(spark: SparkSession, base: str) -> DataFrame:
    return cards.scalars(E.load(spark, base, "provider", "ts", "turn_index", "agent_id", "meta"))


@query
def card_files(spark: SparkSession, base: str) -> DataFrame:
    return cards.files(E.load(spark, base, "file_change", "turn_index")).select("session_id", "path", "kinds", "turns", F.col("rank").cast("long").alias("rank"))


@query
def card_commands(spark: SparkSession, base: str) -> DataFrame:
    return cards.commands(E.load(spark, base, "command", "turn_index")).select("session_id", F.col("rank").cast("long").alias("rank"), "cmd", "exit_code", "turn")


@query
def card_errors(spark: SparkSession, base: str) -> DataFrame:
    return cards.errors(E.load(spark, base, "command", "tool")).select("session_id", "error", F.col("rank").cast("long").alias("rank"))


@query
def card_intents(spark: SparkSession, base: str) -> DataFrame:
    return cards.intents(E.load(spark, base, "text")).select("session_id", "intent", F.col("rank").cast("long").alias("rank"))


@query
def kind_top5(spark: SparkSession, base: str) -> DataFrame:
    return cards.kind_top(E.load(spark, base)).select("session_id", "kind", "n", F.col("rank").cast("long").alias("rank"))


@query
def fallback_narrative(spark: SparkSession, base: str) -> DataFrame:
    return cards.narrative(E.load(spark, base, "text", "tool", "command", "file_change"))


@query
def source_sessions(spark: SparkSession, base: str) -> DataFrame:
    return cards.sources(E.load(spark, base, "provider", "source_path", "ts"))


@query
def consensus_meta(spark: SparkSession, base: str) -> DataFrame:
    return cards.consensus(E.load(spark, base, "repo_root", "meta").where("repo_root is not null and kind = 'meta'"), "repo_root", "meta.cwd", "meta.model", "meta.cli_version")


@query
def session_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Descriptors with per-session counts and sizes of messages and tool parts, aggregated before the joins."""
    rows = E.load(spark, base, "text", "tool")
    size = lambda c: F.sum(F.length(F.coalesce(c, F.lit("")))).cast("long")
    messages = rows.where("kind in ('user_message', 'assistant_message')").groupBy("session_id").agg(F.count("*").alias("n_messages"), size("text").alias("message_chars"))
    parts = rows.where("kind in ('tool_use', 'tool_result')").groupBy("session_id").agg(F.count("*").alias("n_parts"), size("tool.output").alias("part_chars"))
    out = latest_sessions(spark, base).select("session_id", "provider").join(messages, "session_id", "left").join(parts, "session_id", "left")
    return out.fillna(0, ["n_messages", "message_chars", "n_parts", "part_chars"])


def latest_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Of sessions listed twice the row discovered last."""
    rows = table(spark, base, "sessions")
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("discovered_at"), F.desc("session_row")))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


@query
def discover_filter(spark: SparkSession, base: str) -> DataFrame:
    """Sessions of a size, below a folder, since a time; those without a readable time pass."""
    rows = latest_sessions(spark, base)
    at = F.expr("try_to_timestamp(timestamp_raw, \"yyyy-MM-dd'T'HH:mm:ss.SSSX\")")
    since = F.when(F.col("timestamp_raw").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"), F.coalesce(at >= F.expr("timestamp '2026-03-01 00:00:00'"), F.lit(True))).otherwise(True)
    return rows.where((F.col("size_bytes") >= 1024) & F.col("cwd").startswith("/home/dev/src/") & since).select("session_id", "provider", "size_bytes")


@query
def provider_counts(spark: SparkSession, base: str) -> DataFrame:
    return latest_sessions(spark, base).groupBy("provider").agg(F.count("*").alias("n_sessions"), F.sum("size_bytes").cast("long").alias("bytes"), F.sum("line_count").cast("long").alias("lines"))


@query
def summary_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Chunks against stand-in summaries: those with an even number of events have one, of the right hash."""
    chunks = table(spark, base, "chunks").select("session_id", "chunk_id", "sha256", "event_count")
    summaries = chunks.where("event_count % 2 = 0 and sha256 is not null").select("session_id", "chunk_id", F.substring("sha256", 1, 8).alias("prefix"))
    return links.coverage(chunks, summaries).select("session_id", "chunk_id", "covered")


@query
def merged_steps(spark: SparkSession, base: str) -> DataFrame:
    """The chunks as report steps: stand-in summaries where there is one, else a fallback for every third, else a stub."""
    chunks = table(spark, base, "chunks").select("session_id", "chunk_id", "sha256", "event_count")
    told = chunks.where("event_count % 2 = 0 and sha256 is not null").select("session_id", "chunk_id", F.substring("sha256", 1, 8).alias("prefix"), F.concat(F.lit("told "), "chunk_id").alias("narrative"))
    spare = chunks.where("event_count % 3 = 0").select("session_id", "chunk_id", F.concat(F.lit("counted "), "event_count").alias("narrative"))
    return summaries.merge(chunks, told, spare)


# --- links ------------------------------------------------------------------


@query
def subagent_link_explicit(spark: SparkSession, base: str) -> DataFrame:
    return links.explicit_links(E.load(spark, base, "agent_id", "parent_call_id", "tool"))


def _open(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Streams whose rows name no call, and calls of main streams that no stream names."""
    rows = E.load(spark, base, "agent_id", "parent_call_id", "tool", "ts")
    streams = rows.where("agent_id is not null").groupBy("session_id", "agent_id").agg(F.max("parent_call_id").alias("named"), F.min(F.nullif("ts", F.lit(""))).alias("ts"))
    named = rows.where("parent_call_id is not null").select("session_id", F.col("parent_call_id").alias("call_id")).distinct()
    calls = rows.where("kind = 'tool_use' and agent_id is null and tool.call_id <> '' and tool.name in ('Agent', 'Task', 'task', 'agent')").groupBy("session_id", F.col("tool.call_id").alias("call_id")).agg(F.min(F.nullif("ts", F.lit(""))).alias("ts"))
    return streams.where("named is null").drop("named"), calls.join(named, ["session_id", "call_id"], "left_anti")


@query
def subagent_link_single(spark: SparkSession, base: str) -> DataFrame:
    streams, calls = _open(spark, base)
    return links.single_links(streams.drop("ts"), calls.drop("ts"))


@query
def subagent_link_time(spark: SparkSession, base: str) -> DataFrame:
    """Over streams and the calls they name, as if their names were not known."""
    rows = E.load(spark, base, "agent_id", "parent_call_id", "tool", "ts")
    streams = rows.where("agent_id is not null and parent_call_id is not null").groupBy("session_id", "agent_id").agg(F.min(F.nullif("ts", F.lit(""))).alias("ts"))
    calls = rows.where("agent_id is not null and parent_call_id is not null").select("session_id", F.col("parent_call_id").alias("call_id")).distinct()
    timed = rows.where("kind = 'tool_use' and tool.call_id <> ''").select("session_id", F.col("tool.call_id").alias("call_id"), "ts").join(calls, ["session_id", "call_id"], "left_semi")
    return links.timed_links(streams, timed.groupBy("session_id", "call_id").agg(F.min(F.nullif("ts", F.lit(""))).alias("ts")))


@query
def pending_diff_attach(spark: SparkSession, base: str) -> DataFrame:
    rows = E.load(spark, base, "agent_id", "turn_index").where("agent_id is null and turn_index is not null")
    diffs = rows.where("kind = 'file_change'").select("event_id", "session_id", "turn_index", "seq")
    return links.pending_attach(diffs, rows.where("kind = 'assistant_message'")).select("event_id", "after_seq")


# --- checks -----------------------------------------------------------------


@query
def normalized_checks(spark: SparkSession, base: str) -> DataFrame:
    return checks.normalized(E.load(spark, base, "turn_index", "ts", "provider", "source_path", "source_line", "agent_id", "tool"))


@query
def chunk_checks(spark: SparkSession, base: str) -> DataFrame:
    return checks.chunked(table(spark, base, "chunks"), _chunk_lines(spark, base))


# --- text functions ---------------------------------------------------------


def _texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text is not null").select("doc_id", "text")


@query
def strip_text(spark: SparkSession, base: str) -> DataFrame:
    """Base64 and overlong texts give way to markers, character counts in them as the reference has it."""
    rows = table(spark, base, "session_events").select("event_id", "text", F.col("source_path").alias("path"), F.col("source_line").alias("line"))
    return rows.where("text is not null").select("event_id", clean.strip_text(F.col("text"), F.col("path"), F.col("line"), 4000).alias("text"))


@query
def first_sentence_card(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).select("doc_id", T.first_sentence("text").alias("sentence"))


@query
def first_sentence_merge(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).select("doc_id", T.first_sentence("text", 80, stripped=False).alias("sentence"))


@query
def first_meaningful_line(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).select("doc_id", T.first_meaningful_line("text").alias("line"), T.output_lines("text").cast("long").alias("n_lines"))


@query
def synthetic_diff(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "session_events").where("tool.input is not null and tool.input like '%old_string%'")
    get = lambda k: F.get_json_object("tool.input", f"$.{k}")
    return rows.where(get("old_string").isNotNull() & get("new_string").isNotNull()).select("event_id", F.md5(T.synthetic_diff(get("old_string"), get("new_string"), get("file_path"))).alias("diff_md5"))


@query
def coerce_int(spark: SparkSession, base: str) -> DataFrame:
    """Over the words of command output previews."""
    words = table(spark, base, "session_events").where("command.output_preview is not null").select("event_id", F.posexplode(F.split("command.output_preview", " ")).alias("place", "word"))
    return words.select("event_id", "place", T.coerce_int("word").alias("number")).where("number is not null")


@query
def command_status_parse(spark: SparkSession, base: str) -> DataFrame:
    """Over commands as summaries write them."""
    rows = table(spark, base, "session_events").where("command.cmd <> ''").select("event_id", F.concat("command.cmd", F.when(F.col("command.exit_code").isNull(), "").when(F.col("command.exit_code") == 0, " [pass]").otherwise(" [FAIL]")).alias("said"))
    return rows.select("event_id", T.command_status("said").alias("c")).select("event_id", "c.cmd", "c.status")


@query
def screenshot_paths(spark: SparkSession, base: str) -> DataFrame:
    """File names with a slash before and an extension, one row per match."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"(/\S+\.(?:py|go|rs|java))"), 1)
    return _texts(spark, base).select("doc_id", F.posexplode(found).alias("place", "path"))


@query
def sha_tokens(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "session_events").where("text is not null")
    return rows.select("event_id", F.array_join(T.sha_tokens("text"), ",").alias("shas")).where("shas <> ''")


@query
def route_tokens(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "session_events").where("file_change.path is not null")
    return rows.select("event_id", F.array_join(T.route_tokens("file_change.path"), ",").alias("tokens"))


@query
def slug(spark: SparkSession, base: str) -> DataFrame:
    return latest_sessions(spark, base).where("title is not null").select("session_id", T.slug("title").alias("slug"))


@query
def html_escape(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).select("doc_id", F.md5(T.html_escape("text")).alias("escaped_md5"))


@query
def epoch_ms_iso(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sessions").where(F.col("timestamp_raw").rlike(r"^\d{13}$")).select("session_row", T.epoch_ms_iso("timestamp_raw").alias("iso"))


# --- report -----------------------------------------------------------------


def steps(spark: SparkSession, base: str) -> DataFrame:
    """Report steps: documents of that kind, numbered within their repository."""
    rows = table(spark, base, "documents").where("doc_kind = 'report_step' and text is not null and source is not null")
    number = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    head = F.regexp_replace(T.first_meaningful_line("text"), "^#+ *", "")
    return rows.select("doc_id", F.col("source").alias("report"), number.cast("long").alias("step_no"), head.alias("title"), F.col("text").alias("body"))


@query
def teaser(spark: SparkSession, base: str) -> DataFrame:
    return steps(spark, base).select("doc_id", report.teaser("body", "title").alias("teaser"))


@query
def route_step_match(spark: SparkSession, base: str) -> DataFrame:
    """Top folders of changed files against report steps: 3 for a title that holds one, 2 for a body that holds it as a folder."""
    routes = E.load(spark, base, "file_change").where("file_change.path is not null").select(F.substring_index("file_change.path", "/", 1).alias("query")).where("length(query) between 3 and 12").distinct()
    numbered = steps(spark, base).withColumn("step_no", F.col("doc_id"))
    score = F.when(F.contains(F.lower("title"), F.col("query")), 3).otherwise(0) + F.when(F.contains("body", F.concat(F.col("query"), F.lit("/"))), 2).otherwise(0)
    return links.best_match(routes, numbered, score).select("query", "step_no", F.col("score").cast("long").alias("score"))


@query
def before_after_roles(spark: SparkSession, base: str) -> DataFrame:
    shots = E.load(spark, base, "file_change").where("file_change.path is not null").select("event_id", F.concat_ws(" ", "session_id", "file_change.path").alias("route"), "seq")
    return links.first_last_roles(shots, "route", "seq").select("event_id", "role")


@query
def round_robin_index(spark: SparkSession, base: str) -> DataFrame:
    dealt = links.round_robin(steps(spark, base).select("report", "step_no", "doc_id"), "report", "step_no", 40)
    return dealt.select("report", "doc_id", F.col("round").cast("long").alias("round"))


@query
def round_robin_overflow(spark: SparkSession, base: str) -> DataFrame:
    """How many steps of each report the index leaves over."""
    return links.round_robin_left(steps(spark, base), "report", "step_no", 40)


@query
def view_mode(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents").withColumn("item", F.when(F.col("doc_kind") == "plan", "Journey ").when(F.col("doc_kind") == "readme", "end-state").otherwise(F.col("doc_kind")))
    return rows.withColumn("step", F.when(F.col("lang") == "de", "end-state")).select("doc_id", report.view_mode("item", "step").alias("view"))


@query
def step_order(spark: SparkSession, base: str) -> DataFrame:
    return steps(spark, base).withColumn("wish", F.regexp_extract("title", r"Step (\d+)", 1)).select("doc_id", report.step_order("wish", "step_no").cast("long").alias("place"))


@query
def evidence_scent(spark: SparkSession, base: str) -> DataFrame:
    rows = E.load(spark, base, "file_change", "command")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    per = rows.groupBy("session_id").agg(
        F.count_distinct("file_change.path").alias("files"), n(F.col("file_change.diff").isNotNull()).alias("diffs"), n(F.col("command.cmd") != "").alias("commands"), n(F.col("command.exit_code") != 0).alias("failed"), n(F.col("kind") == "screenshot").alias("shots"),
    )
    return per.select("session_id", report.scent("files", "diffs", "commands", "failed", "shots").alias("scent"))


def _changed(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "session_events").where("file_change.path is not null").select("event_id", F.col("file_change.path").alias("path"), F.coalesce("repo_root", F.lit("")).alias("root"))


@query
def noisy_paths(spark: SparkSession, base: str) -> DataFrame:
    return _changed(spark, base).select("event_id", report.noisy("path", "root").alias("noisy"))


@query
def displayable_refs(spark: SparkSession, base: str) -> DataFrame:
    return _changed(spark, base).select("event_id", report.displayable("path", "root", overview=True).alias("shown"))


@query
def shared_ranges(spark: SparkSession, base: str) -> DataFrame:
    return report.shared_ranges(table(spark, base, "chunks").withColumn("source_path", F.col("chunk_id")))


@query
def text_lints(spark: SparkSession, base: str) -> DataFrame:
    return report.lints(table(spark, base, "documents"))


@query
def glossary_dead_terms(spark: SparkSession, base: str) -> DataFrame:
    terms = table(spark, base, "contributors").select(F.col("handle").alias("term")).unionByName(table(spark, base, "eval_items").select(F.col("suite").alias("term")).distinct()).distinct()
    return links.word_matches(table(spark, base, "documents").where("text is not null").select(F.col("doc_id").alias("text_id"), "text"), terms)


@query
def diff_counts(spark: SparkSession, base: str) -> DataFrame:
    rows = E.load(spark, base, "file_change").where("file_change.diff is not null")
    added, removed = report.diff_counts("file_change.diff")
    return rows.groupBy(F.col("file_change.path").alias("path")).agg(F.sum(added).alias("n_added"), F.sum(removed).alias("n_removed"))


@query
def view_stats(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents").where("text is not null")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return rows.groupBy("doc_kind").agg(F.count("*").alias("n"), F.sum(words).cast("long").alias("n_words")).withColumn("minutes", F.ceil(F.col("n_words") / 200).cast("long"))


@query
def prose_path_links(spark: SparkSession, base: str) -> DataFrame:
    return _texts(spark, base).select("doc_id", F.explode(report.path_links("text")).alias("path"))


@query
def glossary_cap(spark: SparkSession, base: str) -> DataFrame:
    """The first four places of each path within a repository."""
    docs = table(spark, base, "documents").where("text is not null and source is not null")
    places = docs.select("source", "doc_id", F.explode(report.path_links("text")).alias("path"))
    return report.cap_per(places, ["source", "path"], "doc_id", 4).select("source", "doc_id", "path", F.col("rank").cast("long").alias("rank"))


@query
def skim_slice(spark: SparkSession, base: str) -> DataFrame:
    rows = steps(spark, base).withColumn("takeaway", T.first_sentence("body"))
    return report.skim(rows).select("report", F.md5("slice").alias("slice_md5"), F.length("slice").cast("long").alias("n_chars"))


@query
def capture_skip(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "session_events").where("kind is not null").select("event_id", (F.col("command.exit_code") + 399).alias("status"), F.when(F.col("provider") == "codex", "application/json; x").otherwise("text/html").alias("ctype"), "text")
    return rows.select("event_id", report.capture_skip("status", "ctype", "text").alias("reason")).where("reason is not null")


@query
def svg_safety(spark: SparkSession, base: str) -> DataFrame:
    """Over texts dressed as SVG."""
    rows = _texts(spark, base).withColumn("svg", F.concat(F.lit('<?xml version="1.0"?>\n<svg>'), F.when(F.col("doc_id") % 3 == 0, "<script>").when(F.col("doc_id") % 3 == 1, "<g onload = x>").otherwise(""), F.col("text"), F.lit("</svg>")))
    return rows.select("doc_id", F.length(report.safe_svg("svg")).cast("long").alias("n_chars"))


@query
def link_map_match(spark: SparkSession, base: str) -> DataFrame:
    """Changed paths, as a link map, among the words of the documents."""
    paths = E.load(spark, base, "file_change").where("file_change.path <> ''").select(F.col("file_change.path").alias("token")).distinct()
    found = D.link_tokens(_texts(spark, base).withColumnRenamed("doc_id", "text_id"), paths)
    return found.groupBy("token").agg(F.count("*").alias("n_places"), F.count_distinct("text_id").alias("n_docs"))


@query
def glossary_faults(spark: SparkSession, base: str) -> DataFrame:
    """The roster as a glossary of all documents: given names are terms, teams definitions, handles aliases."""
    people = table(spark, base, "contributors").select(F.lit("all").alias("report"), F.col("person_id").cast("int").alias("pos"), F.col("given_name").alias("term"), F.col("team").alias("definition"), F.lit(None).cast("string").alias("expanded"), F.array("handle").alias("aliases"))
    return D.glossary_faults(people, _texts(spark, base).select(F.lit("all").alias("report"), "text"))


@query
def undeclared_refs(spark: SparkSession, base: str) -> DataFrame:
    """Transcripts that events cite and that no session of their provider declares, by path or last part."""
    cited = E.load(spark, base, "provider", "source_path").select(F.col("provider").alias("report"), F.col("source_path").alias("path")).distinct()
    return D.undeclared(cited, latest_sessions(spark, base).select(F.col("provider").alias("report"), F.col("source_path").alias("path")))


@query
def visible_items(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "documents").withColumn("mode", F.when(F.col("doc_kind") == "plan", " Journey").when(F.col("doc_kind") == "readme", "end-state").when(F.col("doc_kind") == "tool_log", ""))
    return D.visible(rows, "journey").groupBy("doc_kind").agg(F.count("*").alias("n"))


@query
def json_tree_strip(spark: SparkSession, base: str) -> DataFrame:
    """Strings deep in tool inputs that gave way, in order of each document; inputs that aren't JSON pass unchanged."""
    rows = table(spark, base, "session_events").where("tool.input is not null")
    stripped = clean.strip_json(rows.select("event_id", F.col("tool.input").alias("json"), "source_path", "source_line"), 200)
    return stripped.where("size(markers) > 0").select("event_id", F.size("markers").cast("long").alias("n_markers"), F.array_join("markers", "\n").alias("markers"))


@query
def kinds_seen(spark: SparkSession, base: str) -> DataFrame:
    """Spelling variants of the kinds, and what they are."""
    return table(spark, base, "session_events").groupBy(F.col("kind").alias("spelling"), clean_kind().alias("kind")).agg(F.count("*").alias("n"))


@query
def tool_pair_orphans(spark: SparkSession, base: str) -> DataFrame:
    """Calls whose result isn't in the same listed chunk."""
    return links.unpaired(_chunk_lines(spark, base), "session_id", "chunk_id")


@query
def ref_bounds(spark: SparkSession, base: str) -> DataFrame:
    refs = table(spark, base, "chunks").join(latest_sessions(spark, base).select("session_id", F.col("line_count").alias("n_lines")), "session_id", "left")
    return report.ref_bounds(refs, widest=30).select("chunk_key", "fault")


@query
def projected_checks(spark: SparkSession, base: str) -> DataFrame:
    """The checks of a projection, over events before and after it."""
    rows = E.load(spark, base, "tool", "turn_index")
    small = projection.compress(projection.name_results(rows))
    before, after = checks.projected(rows, small.limit(0)), checks.projected(projection.drop_noise(rows), small)
    return before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))


@query
def manifest_checks(spark: SparkSession, base: str) -> DataFrame:
    """The manifest of the chunks that are packed here against their lines, hashes and sizes computed anew."""
    rows = grouping.refine(grouping.chunk_rows(_grouped(spark, base), TARGET), TARGET)
    chunks = grouping.manifest(rows)
    number = F.dense_rank().over(W.partitionBy("session_id").orderBy("chunk", "half"))
    lines = rows.withColumn("line", grouping.line()).withColumn("chunk_id", F.format_string("chunk-%03d", number))
    return checks.chunked(chunks, lines)


# --- the gate ---------------------------------------------------------------


def gate_steps(spark: SparkSession, base: str) -> DataFrame:
    """Report steps with takeaways and claims: a claim is a listed line, grounded if it holds a digit, its full stops are its references."""
    listed = F.transform(F.filter(F.split("body", "\n"), lambda x: x.startswith("- ")), lambda x: F.substring(x, 3, 1 << 30))
    claim = lambda x: F.struct(x.alias("text"), F.when(x.rlike("[0-9]"), "Grounded ").otherwise("inferred").alias("confidence"), (F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))).alias("n_refs"))
    none = F.lit(None)
    return steps(spark, base).select(
        "doc_id", "report", "step_no", "title", T.first_sentence("body").alias("takeaway"), F.get(listed, F.lit(0)).alias("intent"), F.transform(listed, claim).alias("claims"), none.cast("array<struct<decision:string,rationale:string,alternatives:array<string>>>").alias("decisions"),
        none.cast("array<struct<error:string,resolution:string>>").alias("errors"), F.col("body").contains("```").alias("has_diagram"), F.lit(False).alias("has_video"), F.col("body").contains("/").alias("has_files"), none.cast("boolean").alias("has_evidence"),
    )


def gate_reports(spark: SparkSession, base: str) -> DataFrame:
    """Their reports: the first title is the goal, the first five titles are the summary."""
    first = gate_steps(spark, base).where("step_no <= 5").groupBy("report").agg(F.array_sort(F.collect_list(F.struct("step_no", "title"))).alias("l"))
    none = F.lit(None)
    return first.select("report", F.col("l")[0]["title"].alias("goal"), F.transform("l", lambda x: x["title"]).alias("summary"), F.transform("l", lambda x: F.concat(F.when(x["title"].contains("/"), "/tmp/").otherwise("src/"), F.lit("x"))).alias("key_files"), none.cast("string").alias("end_goal"), none.cast("array<string>").alias("end_summary"))


@query
def density_estimate(spark: SparkSession, base: str) -> DataFrame:
    """Pixels of each step and what they come to in screens, tenths cut off."""
    px = gate.step_height()
    return gate_steps(spark, base).select("doc_id", F.round(px * 100).cast("long").alias("hundredths"), (px > gate.SCREEN * gate.STEP_SCREENS).alias("too_tall"))


@query
def overview_density(spark: SparkSession, base: str) -> DataFrame:
    return gate_reports(spark, base).select("report", F.round(gate.overview_height() * 100).cast("long").alias("hundredths"))


@query
def gate_faults(spark: SparkSession, base: str) -> DataFrame:
    return gate.report_faults(gate_reports(spark, base), gate_steps(spark, base)).groupBy("report", "severity", "fault").agg(F.count("*").alias("n"))


@query
def quality_gate(spark: SparkSession, base: str) -> DataFrame:
    reports = gate_reports(spark, base)
    return gate.gate(reports, gate.report_faults(reports, gate_steps(spark, base)))


@query
def grounded_refs(spark: SparkSession, base: str) -> DataFrame:
    return gate_steps(spark, base).select("doc_id", gate.grounded().alias("grounded"))


@query
def fault_examples(spark: SparkSession, base: str) -> DataFrame:
    """The first titles of each repository."""
    return gate.examples(steps(spark, base), "report", "title", "step_no")


@query
def monoculture(spark: SparkSession, base: str) -> DataFrame:
    """Reports with 20 claims or more that are all grounded."""
    claims = gate_steps(spark, base).select("report", F.explode("claims").alias("c")).select("report", F.lower(F.trim("c.confidence")).alias("confidence"))
    per = claims.groupBy("report").agg(F.count("*").alias("n"), F.count_distinct("confidence").alias("n_kinds"), F.min("confidence").alias("least"))
    return per.select("report", "n", "n_kinds", ((F.col("n") >= 20) & (F.col("n_kinds") == 1) & (F.col("least") == "grounded")).alias("uniform"))


@query
def media_lints(spark: SparkSession, base: str) -> DataFrame:
    """Steps show the first path of their text as a diagram, the last as a video; what is there are changed paths. Terms are readmes."""
    paths = report.path_links("body")
    none = F.lit(None).cast("string")
    nodes = steps(spark, base).select("report", F.col("doc_id").cast("string").alias("label"), F.get(paths, F.lit(0)).alias("diagram"), none.alias("live_script"), none.alias("live_view"), F.element_at(F.when(F.size(paths) > 0, paths), -1).alias("video"), none.alias("poster"), F.lit(True).alias("embed"))
    files = E.load(spark, base, "file_change").where("file_change.path is not null").groupBy(F.col("file_change.path").alias("path")).agg((F.count("*") * 8_000_000).alias("size_bytes"))
    terms = table(spark, base, "documents").where("source is not null").groupBy(F.col("source").alias("report")).agg(F.count_if(F.col("doc_kind") == "readme").alias("n_terms"))
    return gate.media_faults(terms, nodes, files)


@query
def glossary_shapes(spark: SparkSession, base: str) -> DataFrame:
    """The roster as a glossary that is a list, and as one that is a map."""
    people = table(spark, base, "contributors").where("handle is not null and given_name is not null")
    listed = people.agg(F.to_json(F.collect_list(F.struct(F.col("handle").alias("term"), F.col("given_name").alias("definition")))).alias("j")).select(F.lit("list").alias("report"), "j")
    mapped = people.groupBy("handle").agg(F.min("given_name").alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("handle", "g")))).alias("j")).select(F.lit("map").alias("report"), "j")
    docs = listed.unionByName(mapped).select("report", F.parse_json("j").alias("doc"))
    return gate.glossary_entries(docs).select("report", "term", "definition").distinct()


@query
def search_steps(spark: SparkSession, base: str) -> DataFrame:
    return gate.search(steps(spark, base), " Cache ", "title", "body").select("doc_id")


@query
def view_totals(spark: SparkSession, base: str) -> DataFrame:
    """Items and words of each view."""
    rows = table(spark, base, "documents").where("text is not null").withColumn("mode", F.when(F.col("doc_kind") == "plan", " Journey").when(F.col("doc_kind") == "readme", "end-state"))
    words = F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).cast("long")
    per = [D.visible(rows, v).agg(F.count("*").alias("n_items"), words.alias("n_words")).withColumn("view", F.lit(v)) for v in ("journey", "end-state")]
    return per[0].unionByName(per[1])


@query
def chunk_providers(spark: SparkSession, base: str) -> DataFrame:
    return summaries.providers(table(spark, base, "chunks"), E.load(spark, base, "provider", "source_line"))


# --- files written and read again -------------------------------------------


@query
def jsonl_roundtrip(spark: SparkSession, base: str) -> DataFrame:
    """Events written as JSON lines, scanned again as records of variants."""
    path = scratch(spark, "events")
    jsonl.write_jsonl(E.load(spark, base, "text", "turn_index"), path)
    get = lambda p, kind: F.expr(f"try_variant_get(rec, '$.{p}', '{kind}')").alias(p)
    return jsonl.scan_jsonl(spark, path).select(get("event_id", "long"), get("kind", "string"), get("turn_index", "int"), F.md5(F.expr("try_variant_get(rec, '$.text', 'string')")).alias("text_md5"))


@query
def chunk_files(spark: SparkSession, base: str) -> DataFrame:
    """The listed chunks as folders of lines, and what they hold when read again."""
    path = scratch(spark, "chunks")
    rows = _chunk_lines(spark, base).select("session_id", "chunk_id", F.col("source_line").alias("place"), F.concat_ws("|", F.col("seq").cast("string"), "kind").alias("line"))
    jsonl.write_chunks(rows, path)
    return jsonl.read_chunks(spark, path).groupBy("session_id", "chunk_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value")).cast("long").alias("n_bytes"))


@query
def capture_manifest(spark: SparkSession, base: str) -> DataFrame:
    """Changed files as shots of their repository, failed ones skipped; how many shots each has, in order."""
    rows = E.load(spark, base, "file_change", "repo_root").where("file_change.path is not null and repo_root is not null")
    shots = rows.select(F.col("event_id").alias("place"), F.col("repo_root").alias("commit"), F.col("file_change.path").alias("route"), F.col("file_change.path").alias("path"), F.when(F.col("file_change.kind") == "delete", "gone").alias("skip"))
    made = jsonl.captures(shots)
    return made.select(F.posexplode("order").alias("at", "commit"), "commits", "skipped").select("at", "commit", F.size(F.element_at("commits", F.col("commit"))).cast("long").alias("n_shots"), F.size("skipped").cast("long").alias("n_skipped"))
