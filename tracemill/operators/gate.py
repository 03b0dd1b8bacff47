"""The editorial gate of a report: faults of its steps and overview, an estimate of their height, lints of media and glossary.

Reports are tables of their parts. Faults are rows (report, step_no, severity, fault); step_no is null for the report as a whole.
Null texts are empty texts, null lists are empty lists; a report is ok if it has no fault of severity ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import strip
from tracemill.operators.report import LINTS

#: Pixels per character, by kind of text.
PX = {"title": 1.0, "lead": 0.45, "body": 0.34, "hero": 2.2, "hero_long": 1.3}
#: Pixels per block whatever it says.
BLOCK_PX = {"step": 300, "claim": 16, "callout": 110, "alternative": 10, "bullet": 12, "diagram": 560, "video": 480, "files": 90, "evidence": 60, "overview": 260}
#: A screen in pixels, and how many of them a step and an overview may take.
SCREEN, STEP_SCREENS, OVERVIEW_SCREENS, LONG_HERO = 900, 2.0, 1.2, 140
MOST_STEPS, LEAST_BULLETS, EMBED_LIMIT = 12, 3, 15 * 1024 * 1024
#: Keys whose texts no reader sees as prose.
NO_PROSE = (
    "aliases", "code", "commands", "confidence", "diagram_image", "diagram_mermaid", "diff", "evidence", "file", "files_changed", "github_path", "github_ref", "href", "id",
    "key_files", "media", "mode", "output", "path", "provider", "screenshots", "session_path", "source_refs", "step_ref", "step_refs", "timestamp", "url",
)


def said(c) -> Column:
    return strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def chars(c) -> Column:
    return F.length(said(c))


def _sum(items: str, each) -> Column:
    return F.aggregate(F.coalesce(F.transform(items, each), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)


def step_height(video: bool = True) -> Column:
    """Pixels of a step. Columns: title, takeaway, intent, claims array<struct<text>>, decisions array<struct<decision, rationale, alternatives
    array<string>>>, errors array<struct<error, resolution>>, has_diagram, has_video, has_files, has_evidence."""
    px, block = PX, BLOCK_PX
    note = lambda *texts: block["callout"] + px["body"] * sum((chars(t) for t in texts), F.lit(0))
    other = lambda d: F.aggregate(F.coalesce(d["alternatives"], F.array().cast("array<string>")), F.lit(0.0), lambda a, x: a + block["alternative"] + px["body"] * chars(x))
    flag = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(False)), n).otherwise(0)
    fixed = block["step"] + flag("has_diagram", block["diagram"]) + flag("has_files", block["files"]) + flag("has_evidence", block["evidence"]) + (flag("has_video", block["video"]) if video else 0)
    return (
        fixed + px["title"] * chars("title") + px["lead"] * (chars("takeaway") + chars("intent")) + _sum("claims", lambda c: block["claim"] + px["body"] * chars(c["text"]))
        + _sum("decisions", lambda d: note(d["decision"], d["rationale"]) + other(d)) + _sum("errors", lambda e: note(e["error"], e["resolution"]))
    )


def overview_height() -> Column:
    """Pixels of an overview, the taller of its two views. Columns: goal, summary array<string>, end_goal, end_summary; an end state that
    lacks one shows the journey's."""
    hero = lambda c: chars(c) * F.when(chars(c) > LONG_HERO, PX["hero_long"]).otherwise(PX["hero"])
    bullets = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<string>")), F.lit(0.0), lambda a, x: a + BLOCK_PX["bullet"] + PX["lead"] * chars(x))
    end_goal = F.when(said("end_goal") == "", F.col("goal")).otherwise(F.col("end_goal"))
    end_summary = F.when(F.coalesce(F.size("end_summary"), F.lit(0)) < 1, F.col("summary")).otherwise(F.col("end_summary"))
    return BLOCK_PX["overview"] + F.greatest(hero("goal") + bullets(F.col("summary")), hero(end_goal) + bullets(end_summary))


def grounded(claims: str = "claims") -> Column:
    """Whether some claim is grounded and cites a source. ``claims``: array<struct<text, confidence, n_refs>>."""
    return F.coalesce(F.exists(claims, lambda c: (F.lower(said(c["confidence"])) == "grounded") & (c["n_refs"] > 0)), F.lit(False))


def _raw(c) -> Column:
    return said(c).rlike(LINTS["chunk_title"]) | said(c).rlike(LINTS["event_count"])


def _faults(rows: DataFrame, number: Column, severity: str, **conditions: Column) -> DataFrame:
    held = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))
    return rows.select("report", number.cast("long").alias("step_no"), F.lit(severity).alias("severity"), F.explode(held).alias("fault"))


def step_faults(steps: DataFrame) -> DataFrame:
    """Faults of steps (report, step_no, title, takeaway, intent, claims and what ``step_height`` takes)."""
    title, takeaway, intent = (said(c) for c in ("title", "takeaway", "intent"))
    control = lambda c: said(c).rlike(LINTS["raw_intent"])
    dot = lambda c: F.regexp_replace(c, r"\.+$", "")
    errors = _faults(
        steps, F.col("step_no"), "error", no_title=title == "", raw_title=_raw("title"), control_title=control("title"), no_takeaway=takeaway == "",
        generic_takeaway=(takeaway != "") & (takeaway.rlike(LINTS["generic"]) | takeaway.rlike(LINTS["event_count"])), raw_intent=_raw("intent"), control_intent=~_raw("intent") & control("intent"), not_grounded=~grounded(),
    )
    tall, prose = step_height(), step_height(video=False)
    video = F.coalesce("has_video", F.lit(False))
    warnings = _faults(
        steps, F.col("step_no"), "warning", takeaway_is_title=(title != "") & (takeaway != "") & (dot(title) == dot(takeaway)), too_tall=tall > SCREEN * STEP_SCREENS, video_and_prose=video & (prose > SCREEN * STEP_SCREENS * 0.6)
    )
    return errors.unionByName(warnings)


def report_faults(reports: DataFrame, steps: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """Faults of reports (report, goal, summary, key_files array<string>, end_goal, end_summary) and of all their steps.

    Steps of one report are only counted, never gathered.
    """
    usable = (said("takeaway") != "") & ~said("takeaway").rlike(LINTS["generic"]) & ~said("takeaway").rlike(LINTS["event_count"])
    lines = steps.where(usable).groupBy("report", said("takeaway").alias("t")).agg(F.count("*").alias("n")).groupBy("report").agg(F.max("n").alias("same"))
    counts = steps.groupBy("report").agg(F.count("*").alias("n_steps"))
    rows = reports.join(counts, "report", "left").join(lines, "report", "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0)))
    bullets = F.filter(F.coalesce("summary", F.array().cast("array<string>")), lambda x: said(x) != "")
    enough = F.size(bullets) >= LEAST_BULLETS
    bad_bullet = F.exists(bullets, lambda x: _raw(x) | said(x).rlike(LINTS["raw_intent"]))
    noisy_key = F.coalesce(F.exists("key_files", lambda p: (said(p) == "") | said(p).startswith("/tmp/") | said(p).contains("/.claude/") | said(p).contains("/.codex/")), F.lit(False))
    none = F.lit(None)
    errors = _faults(rows, none, "error", no_goal=said("goal") == "", raw_goal=_raw("goal"), raw_bullet=enough & bad_bullet, noisy_key_file=noisy_key, no_steps=F.col("n_steps") == 0, too_many_steps=F.col("n_steps") > most)
    ends = (said("end_goal") != "") | (F.coalesce(F.size("end_summary"), F.lit(0)) > 0)
    warnings = _faults(rows, none, "warning", few_bullets=~enough, same_takeaways=F.coalesce(F.col("same") > 1, F.lit(False)), no_end_state=~ends, tall_overview=overview_height() > SCREEN * OVERVIEW_SCREENS)
    return errors.unionByName(warnings).unionByName(step_faults(steps))


def gate(reports: DataFrame, faults: DataFrame) -> DataFrame:
    """(report, n_errors, n_warnings, ok) of every report."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = faults.groupBy("report").agg(n("error").alias("n_errors"), n("warning").alias("n_warnings"))
    out = reports.select("report").join(counts, "report", "left").fillna(0, ["n_errors", "n_warnings"])
    return out.withColumn("ok", F.col("n_errors") == 0)


def examples(rows: DataFrame, key: str, value: str, order: str, n: int = 3) -> DataFrame:
    """(key, examples): of each key the first ``n`` distinct values by first sight, and dots if there are more."""
    seen = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    ranked = seen.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_first", value))).where(F.col("_r") <= n + 1)
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))).alias("l"))
    text = F.array_join(F.transform(F.slice("l", 1, n), lambda x: x["v"]), ", ")
    return listed.select(key, F.concat(text, F.when(F.size("l") > n, ", ...").otherwise("")).alias("examples"))


def media_faults(reports: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(report, label, fault) of missing or broken media, all warnings.

    ``reports``: report, n_terms; ``nodes``: report, label, diagram, live_script, live_view, video, poster, embed; ``files``: path, size_bytes - what is
    there. A path is looked up as it is written.
    """
    remote = lambda c: said(c).rlike(r"^https?://")
    known = lambda c, name: files.select(F.col("path").alias(c), F.lit(True).alias(name), F.col("size_bytes").alias(f"{name}_size")).dropDuplicates([c])
    rows = nodes
    for c, name in (("diagram", "d"), ("live_script", "s"), ("video", "v"), ("poster", "p")):
        rows = rows.join(known(c, name), c, "left")
    has = lambda c: said(c) != ""
    live = has("live_script") | has("live_view")
    whole = has("live_script") & has("live_view")
    held = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in {
        "live_needs_script_and_view": live & ~whole, "live_is_remote": whole & remote("live_script"), "live_not_found": whole & ~remote("live_script") & F.col("s").isNull(),
        "live_without_picture": whole & ~remote("live_script") & F.col("d").isNull(), "video_not_found": has("video") & ~remote("video") & F.col("v").isNull(),
        "video_too_large_to_embed": has("video") & F.coalesce("embed", F.lit(False)) & F.coalesce(F.col("v_size") > EMBED_LIMIT, F.lit(False)), "poster_not_found": has("video") & has("poster") & F.col("p").isNull(),
    }.items())))
    of_nodes = rows.select("report", "label", F.explode(held).alias("fault"))
    drawn = nodes.where(has("diagram") | live).select("report").distinct()
    whole_report = lambda df, fault: df.select("report", F.lit("report").alias("label"), F.lit(fault).alias("fault"))
    return of_nodes.unionByName(whole_report(reports.where(F.coalesce("n_terms", F.lit(0)) == 0), "no_glossary")).unionByName(whole_report(reports.join(drawn, "report", "left_anti"), "no_diagram"))


def glossary_entries(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(report, pos, term, definition): a glossary that is a list of objects or a map of terms to texts or objects; other items are left out."""
    kind = F.schema_of_variant(doc)
    text = lambda v, p: F.try_variant_get(v, p, "string")
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    listed = docs.where(kind.startswith("ARRAY")).select("report", F.posexplode(F.expr(f"try_variant_get({doc}, '$', 'array<variant>')")).alias("pos", "v"))
    mapped = docs.where(kind.startswith("OBJECT")).select("report", F.posexplode(F.map_entries(F.expr(f"try_variant_get({doc}, '$', 'map<string,variant>')"))).alias("pos", "e")).select("report", "pos", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    plain = F.schema_of_variant("v") == "STRING"
    own = F.coalesce(F.when(is_object(F.col("v")), text(F.col("v"), "$.term")), F.col("k"))
    a = listed.where(is_object(F.col("v"))).select("report", "pos", text(F.col("v"), "$.term").alias("term"), text(F.col("v"), "$.definition").alias("definition"))
    b = mapped.where(plain | is_object(F.col("v"))).select("report", "pos", own.alias("term"), F.when(plain, text(F.col("v"), "$")).otherwise(text(F.col("v"), "$.definition")).alias("definition"))
    return a.unionByName(b)


def search(texts: DataFrame, phrase: str, *columns: str) -> DataFrame:
    """The rows in some column of which the phrase stands, without letter case; a blank phrase finds all."""
    wanted = phrase.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
    return texts.where(hit) if wanted else texts
