"""Chunk summaries: repair of their shapes, merging with the deterministic fallback, and the report they make.

Summaries come from outside as JSON of loose shape: a list may be a text, an entry a text or an object. Each list is repaired
by expressions on its variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import command_status
from tracemill.operators.links import coverage

#: The keys of a summary.
KEYS = ("chunk_id", "narrative", "claims", "files_changed", "commands", "decisions", "diff_hunks", "errors", "key_concepts", "screenshots")
NO_ITEMS = "cast(array() as array<variant>)"


def _text(v: Column, *paths: str) -> Column:
    """The first of the fields that holds some text."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")) for p in paths))


def _plain(v: Column) -> Column:
    """The text of an entry that is one; null for objects and lists."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _items(doc: str, path: str) -> Column:
    """The list at a path; anything else is none."""
    return F.coalesce(F.expr(f"case when schema_of_variant(try_variant_get({doc}, '$.{path}', 'variant')) like 'ARRAY%' then try_variant_get({doc}, '$.{path}', 'array<variant>') end"), F.expr(NO_ITEMS))


def _entries(items: Column, plain, keyed) -> Column:
    """Entries that are texts by one rule, objects by another; others, and objects without their text, are left out."""
    return F.filter(F.transform(items, lambda v: F.when(_plain(v).isNotNull(), plain(_plain(v))).when(F.schema_of_variant(v).startswith("OBJECT"), keyed(v))), lambda e: e.isNotNull())


def repaired(summaries: DataFrame, doc: str = "doc") -> DataFrame:
    """Summaries with their lists as arrays of structs."""
    narrative = F.expr(f"try_variant_get({doc}, '$.narrative', 'array<string>')")
    pair = lambda a, b, x, y: F.struct(x.alias(a), F.coalesce(y, F.lit("")).alias(b))
    status = lambda v: F.lower(F.coalesce(_text(v, "status"), F.lit("pass")))
    keyed = lambda a, b, text, more: lambda v: F.when(_text(v, *text).isNotNull(), pair(a, b, _text(v, *text), _text(v, *more)))
    command = lambda cmd, state, said: F.struct(cmd.alias("cmd"), state.alias("status"), F.coalesce(said, F.lit("")).alias("summary"))
    file = lambda path, kind, said: F.struct(path.alias("path"), kind.alias("kind"), said.alias("summary"))
    blank = F.lit("")
    return summaries.withColumns({
        "narrative": F.coalesce(F.array_join(narrative, " "), F.expr(f"try_variant_get({doc}, '$.narrative', 'string')"), blank),
        "claims": _entries(_items(doc, "claims"), lambda t: pair("text", "confidence", t, F.lit("inferred")), keyed("text", "confidence", ("text",), ("confidence",))),
        "files_changed": _entries(_items(doc, "files_changed"), lambda t: file(t, F.lit("unknown"), blank), lambda v: file(F.coalesce(_text(v, "path"), blank), F.coalesce(_text(v, "kind"), F.lit("unknown")), F.coalesce(_text(v, "summary"), blank))),
        "commands": _entries(_items(doc, "commands"), lambda t: command(command_status(t)["cmd"], command_status(t)["status"], blank), lambda v: F.when(_text(v, "cmd", "command").isNotNull(), command(_text(v, "cmd", "command"), F.when(status(v).isin("pass", "fail"), status(v)).otherwise("pass"), _text(v, "summary", "output_preview")))),
        "decisions": _entries(_items(doc, "decisions"), lambda t: pair("decision", "rationale", t, blank), keyed("decision", "rationale", ("decision", "text"), ("rationale",))),
        "errors": _entries(_items(doc, "errors"), lambda t: pair("error", "resolution", t, blank), keyed("error", "resolution", ("error", "text", "message"), ("resolution",))),
        "key_concepts": F.transform(_items(doc, "key_concepts"), lambda v: F.coalesce(_plain(v), F.to_json(v))),
    })


def merge(chunks: DataFrame, summaries: DataFrame, fallback: DataFrame, allow_fallback: bool = True) -> DataFrame:
    """One step per chunk, in order: its summary by id and hash, else the fallback; ``source`` tells which.

    ``chunks``: session_id, chunk_id, sha256; ``summaries``: session_id, chunk_id, prefix, narrative; ``fallback``: session_id,
    chunk_id, narrative. Without fallback, chunks lacking a summary are an error, as a merge must be whole.
    """
    covered = coverage(chunks, summaries)
    if not allow_fallback and not covered.where("not covered").isEmpty():
        raise ValueError("some chunks have no summary of their hash")
    both = covered.join(fallback.withColumnRenamed("narrative", "spare"), ["session_id", "chunk_id"], "left")
    source = F.when(F.col("covered"), "summary").when(F.col("spare").isNotNull(), "fallback").otherwise("stub")
    number = F.row_number().over(W.partitionBy("session_id").orderBy("chunk_id"))
    return both.select("session_id", number.cast("long").alias("step_no"), "chunk_id", source.alias("source"), F.coalesce(F.when(F.col("covered"), F.col("narrative")), "spare", F.lit("")).alias("narrative"))


def report(steps: DataFrame, sources: DataFrame, meta: DataFrame) -> DataFrame:
    """Nested reports, one row per session: meta, sources in order, steps in order.

    ``sources``: session_id, provider, source_path, first_ts; ``meta``: session_id and consensus columns.
    """
    ordered = steps.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "chunk_id", "source", "narrative"))).alias("steps"))
    listed = sources.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("first_ts", F.lit("9999-12-31T23:59:59Z")).alias("first_ts"), F.col("source_path").alias("path"), "provider"))).alias("sources"))
    info = meta.select("session_id", F.struct(*(c for c in meta.columns if c != "session_id")).alias("meta"))
    return ordered.join(listed, "session_id", "left").join(info, "session_id", "left")


def providers(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, provider): that of the first event of a session's first chunk, ``unknown`` if there is none."""
    first = chunks.groupBy("session_id").agg(F.min_by(F.struct("line_start", "line_end"), "chunk_id").alias("c"))
    inside = events.join(first, "session_id").where("source_line between c.line_start and c.line_end").groupBy("session_id").agg(F.min_by("provider", "seq").alias("provider"))
    return first.select("session_id").join(inside, "session_id", "left").withColumn("provider", F.coalesce(F.nullif("provider", F.lit("")), F.lit("unknown")))


def merged_cards(*cards: DataFrame) -> DataFrame:
    """Cards from several runs as one table, ordered by name; of cards without a session nothing is kept."""
    out = cards[0]
    for more in cards[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.where("session_id is not null").sort("session_id")
