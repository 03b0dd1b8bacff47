"""Operators on report documents laid out as tables of their parts: media, references, reasoning, glossary and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import base_name, route_tokens, slug, strip
from tracemill.operators.links import first_last_roles
from tracemill.runtime import cut

GLOSSARY_CHARS, GLOSSARY_ENTRIES = 300, 50
#: Words of routes and words that mean as much in a step.
SYNONYMS = {
    "login": ("auth", "signin", "sign", "in"), "signin": ("login", "auth"), "auth": ("login", "signin", "signup"), "register": ("registration", "signup", "wizard"), "registration": ("register", "signup", "wizard"),
    "signup": ("register", "registration"), "dashboard": ("home", "analytics"), "checkout": ("payment", "pay"), "payment": ("checkout", "pay"),
}


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def resolve_media(media: DataFrame, shots: DataFrame) -> DataFrame:
    """Media with the data of the screenshot event they cite: by session path and line, else by source path and line.

    ``media``: media_id, session_path, line_start, source_path, source_line; ``shots``: source_path, source_line, seq, data_b64.
    Of several events at a place the last counts, and it must hold data.
    """
    last = shots.groupBy("source_path", "source_line").agg(F.max_by("data_b64", "seq").alias("data"))
    at = lambda path, line, name: last.select(F.col("source_path").alias(path), F.col("source_line").alias(line), F.col("data").alias(name), F.lit(True).alias(f"{name}_there"))
    both = media.join(at("session_path", "line_start", "a"), ["session_path", "line_start"], "left").join(at("source_path", "source_line", "b"), ["source_path", "source_line"], "left")
    return both.withColumn("data_b64", F.when(F.col("a_there"), F.col("a")).otherwise(F.col("b"))).select("media_id", F.nullif("data_b64", F.lit("")).alias("data_b64"))


def resolve_steps(refs: DataFrame, steps: DataFrame) -> DataFrame:
    """References to steps with their labels; unknown ones are dropped. ``refs``: report, item_no, ref_no, step_id."""
    known = steps.select("report", "step_id", F.concat(F.lit("Step "), F.col("step_no").cast("string")).alias("step_label"))
    first = refs.groupBy("report", "item_no", "step_id").agg(F.min("ref_no").alias("ref_no"))
    return first.join(known, ["report", "step_id"])


def undeclared(refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """References whose path isn't, in full or by its last part, among the report's declared sessions; reports that
    declare none are passed. Both have report and path."""
    names = sessions.where("path <> ''").select("report", F.explode(F.array("path", base_name("path"))).alias("name")).distinct()
    declaring = names.select("report").distinct()
    by = lambda rows, name: rows.join(names.withColumnRenamed("name", "_name"), (rows["report"] == names["report"]) & (name == F.col("_name")), "left_anti")
    rows = refs.join(declaring, "report", "left_semi")
    return by(by(rows, F.col("path")), base_name("path"))


def bridge_screenshots(shots: DataFrame) -> DataFrame:
    """Legacy screenshots of steps as media stubs. ``shots``: step_id, idx (from 0), id, caption, context, source_ref, source_refs."""
    ident = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.coalesce("step_id", F.lit("step")), F.lit("-ss-"), (F.col("idx") + 1).cast("string")))
    caption = F.coalesce(F.nullif("caption", F.lit("")), F.nullif("context", F.lit("")), F.lit(""))
    return shots.select("step_id", "idx", ident.alias("media_id"), F.lit("screenshot").alias("type"), caption.alias("caption"), F.coalesce("source_ref", F.get(F.col("source_refs"), 0)).alias("source_ref"))


def route_score(route: str, narrative: str, files: str, commands: str, everything: str) -> Column:
    """How well a step fits a route: 5 for the route itself, and for each of its words 3 in the narrative, 2 in files, 1 in
    commands, a point less (but one at least) for each word that means as much."""
    meaning = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    holds = lambda c, w, points: F.when(F.contains(F.col(c), w), points).otherwise(0)
    in_step = lambda w, points: holds(narrative, w, points[0]) + holds(files, w, points[1]) + holds(commands, w, points[2])
    add = lambda points: lambda total, w: total + in_step(w, points)
    own = F.aggregate(route_tokens(route), F.lit(0), add((3, 2, 1)))
    like = F.flatten(F.transform(route_tokens(route), lambda w: F.coalesce(F.try_element_at(meaning, w), F.array().cast("array<string>"))))
    return F.when(F.contains(F.col(everything), F.lower(route)), 5).otherwise(0) + own + F.aggregate(like, F.lit(0), add((2, 1, 1)))


def match_routes(routes: DataFrame, steps: DataFrame, limit: int = 10_000) -> DataFrame:
    """(route, step_no): the step that fits a route best, ties to the first; else the one that names its commits; else the
    last; the root goes to the first. ``routes``: route, commits; ``steps``: step_no, narrative, files, commands, all in lower case.

    There is no key to join routes by, so they go to the steps in blocks of ``limit``, and each comes back as one row.
    """
    blocks = -(-routes.count() // limit)
    if blocks > 1:
        return reduce(DataFrame.unionByName, (match_routes(cut(routes.where(F.pmod(F.xxhash64("route"), F.lit(blocks)) == b)), steps, 4 * limit) for b in range(blocks)))
    steps = steps.withColumn("everything", F.concat_ws(" ", "narrative", "files", "commands"))
    pairs = steps.join(F.broadcast(routes)).withColumn("fit", route_score("route", "narrative", "files", "commands", "everything"))
    named = F.aggregate(F.coalesce("commits", F.array().cast("array<string>")), F.lit(0), lambda n, c: n + F.when((c != "") & F.contains(F.col("everything"), F.lower(c)), 10).otherwise(0))
    best = lambda score: F.max_by("step_no", F.struct(score, -F.col("step_no")))
    found = pairs.withColumn("names", named).groupBy("route").agg(F.max("fit").alias("fit"), best(F.col("fit")).alias("a"), F.max("names").alias("names"), best(F.col("names")).alias("b"), F.max("step_no").alias("last"), F.min("step_no").alias("first"))
    root = F.trim("route").isin("", "/")
    return found.select("route", F.when(root, F.col("first")).when(F.col("fit") > 0, F.col("a")).when(F.col("names") > 0, F.col("b")).otherwise(F.col("last")).alias("step_no"))


def attach_captures(shots: DataFrame, matched: DataFrame, media: DataFrame) -> DataFrame:
    """Captures as media of the steps their routes match; those whose path the step has already, or had before, are left out.

    ``shots``: route, commit, path, place; ``matched``: route, step_no; ``media``: step_no, path of the items that stay.
    """
    placed = first_last_roles(shots, "route", "place").join(matched, "route")
    fresh = placed.join(media.select("step_no", "path").distinct(), ["step_no", "path"], "left_anti")
    fresh = fresh.withColumn("_r", F.row_number().over(W.partitionBy("step_no", "path").orderBy("place", "route"))).where("_r = 1")
    word = F.when(F.col("role") == "standalone", "").otherwise(F.concat(F.lit(" "), F.col("role")))
    name = F.coalesce(F.nullif(slug("route"), F.lit("")), F.lit("root"))
    return fresh.select(
        "step_no", F.format_string("capture-%s-%s-%d", name, F.col("commit"), F.col("rank")).alias("media_id"), F.format_string("%s%s (%s)", "route", word, "commit").alias("caption"), "path",
        F.concat(F.lit("capture-route-"), name).alias("media_group"), "role",
    )


def reasoning(items: DataFrame, kind: str = "decision", doc: str = "item") -> DataFrame:
    """Decisions or gotchas, texts or objects under any of their names, as (key columns, text, detail); empty ones are dropped."""
    get = lambda *names: F.coalesce(*(F.nullif(one_line(F.expr(f"try_variant_get({doc}, '$.{n}', 'string')")), F.lit("")) for n in names))
    plain = F.nullif(one_line(F.expr(f"try_variant_get({doc}, '$', 'string')")), F.lit(""))
    is_text = F.schema_of_variant(doc).startswith("OBJECT")
    text, detail = (get("decision", "text", "message"), get("rationale", "detail")) if kind == "decision" else (get("error", "text", "message"), get("resolution", "fix", "detail"))
    return items.withColumn("text", F.when(is_text, text).otherwise(plain)).withColumn("detail", F.when(is_text, detail)).where("text is not null").drop(doc)


def glossary_faults(entries: DataFrame, prose: DataFrame) -> DataFrame:
    """(report, term, fault): incomplete, duplicate, too long or dead entries. ``entries``: report, pos, term, definition,
    expanded, aliases; ``prose``: report, text.

    Terms are looked up among the runs of words of the prose of as many words as they have, not searched in every text.
    """
    entries = entries.withColumn("term", one_line(F.col("term"))).withColumn("key", F.lower("term"))
    whole = (F.col("term") != "") & ((one_line(F.col("definition")) != "") | (one_line(F.col("expanded")) != ""))
    ranked = entries.where(whole).withColumn("n", F.row_number().over(W.partitionBy("report", "key").orderBy("pos")))
    kept = ranked.where("n = 1")
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda w: w != "")
    names = kept.select("report", "pos", F.explode(F.filter(F.concat(F.array("term"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))), lambda a: F.length(a) >= 2)).alias("name")).withColumn("w", words("name")).where("size(w) > 0")
    sizes = names.select("report", F.size("w").alias("k")).distinct()
    told = prose.select("report", words("text").alias("p")).join(sizes, "report")
    grams = told.where("size(p) >= k").select("report", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("k")), lambda i: F.array_join(F.slice("p", i + 1, F.col("k")), " "))).alias("gram")).distinct()
    alive = names.select("report", "pos", F.array_join("w", " ").alias("gram")).join(grams, ["report", "gram"], "left_semi").select("report", "pos").distinct()
    fault = lambda rows, name: rows.select("report", "term", F.lit(name).alias("fault"))
    return (
        fault(entries.where(~whole), "incomplete").unionByName(fault(ranked.where("n > 1"), "duplicate"))
        .unionByName(fault(kept.where(F.length("definition") > GLOSSARY_CHARS), "long")).unionByName(fault(kept.join(alive, ["report", "pos"], "left_anti"), "dead"))
    )


def tooltips(links: DataFrame, glossary: DataFrame) -> DataFrame:
    """The tooltip of each link: its own, else that of the glossary entry of its text or an alias, else of its target path.

    ``links``: link_id, text, path, tooltip; ``glossary``: name (term or alias), path, definition.
    """
    by_text = glossary.groupBy(F.lower("name").alias("_text")).agg(F.min("definition").alias("_a"))
    by_path = glossary.where("path <> ''").groupBy(F.col("path").alias("_path")).agg(F.min("definition").alias("_b"))
    rows = links.join(by_text, F.lower("text") == F.col("_text"), "left").join(by_path, F.col("path") == F.col("_path"), "left")
    return rows.select("link_id", F.coalesce(F.nullif("tooltip", F.lit("")), "_a", "_b").alias("tooltip"))


def longest_tokens(spans: DataFrame) -> DataFrame:
    """Of the tokens found at a place the longest. ``spans``: text_id, start, token."""
    return spans.withColumn("_r", F.row_number().over(W.partitionBy("text_id", "start").orderBy(F.desc(F.length("token")), "token"))).where("_r = 1").drop("_r")


def link_tokens(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(text_id, start, token): whole words of the texts that are in the link map, by an equi-join."""
    words = texts.select("text_id", F.posexplode(F.split("text", r"[^A-Za-z0-9_./-]+")).alias("start", "word")).where("word <> ''")
    return longest_tokens(words.join(tokens, words["word"] == tokens["token"]).select("text_id", "start", "token"))


def visible(items: DataFrame, view: str, mode: str = "mode") -> DataFrame:
    """The items that a view shows: those of both views and its own; alternatives only on the journey."""
    own = F.coalesce(F.nullif(F.lower(F.trim(mode)), F.lit("")), F.lit("both"))
    return items.where(own.isin("both", view))


def link_target(path: str) -> Column:
    """Whether a repository path is shown as a file (blob) or a folder (tree): by a dot in its last part, or a known name."""
    last = base_name(path)
    return F.when(last.contains(".") | last.isin("Makefile", "Dockerfile", "LICENSE", "README"), "blob").otherwise("tree")
