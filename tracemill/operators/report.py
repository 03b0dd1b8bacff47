"""Operators on the report document: references, teasers, scents, views, lints and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import base_name, strip, truncate_words

#: Top folders whose files an overview shows.
ROOT_DIRS = ("src", "e2e", "scripts", "docs", "db", "repos", "likec4")
#: Text shapes that a report shouldn't have.
LINTS = {
    "chunk_title": r"(?i)^\s*chunk-\d+\b",
    "event_count": r"(?i)\b\d+\s+events\b",
    "raw_intent": r"(?i)<(?:environment_context|local-command-caveat)>|#\s*AGENTS\b|continued from a previous conversation",
    "generic": r"(?i)^\s*(this chunk|chunk-\d+|n/a|none|todo)\b",
}
#: What makes SVG unsafe.
UNSAFE_SVG = (r"(?i)<\s*script\b", r"(?i)\son\w+\s*=", r"(?i)(?:href|xlink:href)\s*=\s*['\"]\s*javascript:")


def outside(path: Column, root: Column) -> Column:
    """Whether an absolute path isn't the root or below it."""
    r = F.regexp_replace(root, "/+$", "")
    return path.startswith("/") & (r != "") & (path != r) & ~path.startswith(F.concat(r, F.lit("/")))


def noisy(path: str, root: str) -> Column:
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    base = F.lower(base_name(p))
    return (p == "") | p.startswith("/tmp/") | p.contains("/.claude/") | p.contains("/.codex/") | base.startswith(".env") | (base.contains("worklog") & base.endswith(".md")) | F.coalesce(outside(p, F.col(root)), F.lit(False))


def displayable(path: str, root: str, overview: bool = False) -> Column:
    """The renderer's rule: like ``noisy``, but end-to-end results go and, in an overview, only known folders stay."""
    p, r = F.col(path), F.regexp_replace(F.coalesce(F.col(root), F.lit("")), "/+$", "")
    full = F.when(p.startswith("/") | (r == ""), p).otherwise(F.concat(r, F.lit("/"), F.regexp_replace(p, r"^\./", "")))
    inside = (r != "") & ((full == r) | full.startswith(F.concat(r, F.lit("/"))))
    label = F.when(inside & (full != r), F.substring(full, F.length(r) + 2, F.length(full))).otherwise(F.regexp_replace(p, r"^\./", ""))
    base = F.lower(base_name(label))
    bad = (p == "") | base.startswith(".env") | (base.contains("worklog") & base.endswith(".md")) | label.startswith("e2e-test-results/") | (full.startswith("/tmp/") & ~inside) | ((r != "") & full.startswith("/") & ~inside)
    if overview:
        bad = bad | (inside & ~F.substring_index(label, "/", 1).isin(*ROOT_DIRS))
    return ~F.coalesce(bad, F.lit(True))


def teaser(*candidates: str, cap: int = 180) -> Column:
    """The first of the texts that says something, on one line, cut at a word."""
    said = F.coalesce(*(F.nullif(strip(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit("")) for c in candidates), F.lit(""))
    return truncate_words(said, cap)


def scent(files: str, diffs: str, commands: str, failed: str, shots: str) -> Column:
    """What evidence holds, as ``2 files · 1 cmd · 1 failed``."""
    some = lambda c, one, many: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" "), F.when(F.col(c) == 1, one).otherwise(many)))
    said = F.concat_ws(" · ", some(files, "file", "files"), some(diffs, "diff", "diffs"), some(commands, "cmd", "cmds"), some(failed, "failed", "failed"), some(shots, "shot", "shots"))
    return F.when(said == "", "View Evidence").otherwise(said)


def view_mode(item: str, step: str) -> Column:
    """both, journey or end-state; a step that is pinned to one overrides its items."""
    clean = lambda c: F.when(F.lower(F.trim(c)).isin("journey", "end-state"), F.lower(F.trim(c))).otherwise("both")
    return F.when(clean(step) != "both", clean(step)).otherwise(clean(item))


def step_order(order: str, number: str) -> Column:
    """A whole number that says where in the end state a step comes, else 900 and its place."""
    return F.coalesce(F.col(order).try_cast("int"), 900 + F.col(number))


def lints(texts: DataFrame, col: str = "text") -> DataFrame:
    return texts.select(*[F.count_if(F.col(col).rlike(p)).alias(n) for n, p in LINTS.items()])


def ref_bounds(refs: DataFrame, widest: int = 200) -> DataFrame:
    """References with what is wrong with them: out of the file's lines, upside down, too wide, not declared."""
    start, end, lines = F.col("line_start"), F.col("line_end"), F.col("n_lines")
    fault = F.when(lines.isNull(), "undeclared").when((start < 1) | (start > end) | (end > lines), "out_of_bounds").when(end - start > widest, "too_wide")
    return refs.withColumn("fault", fault).where("fault is not null")


def shared_ranges(refs: DataFrame, least: int = 3) -> DataFrame:
    return refs.groupBy("source_path", "line_start", "line_end").agg(F.count("*").alias("n_refs")).where(F.col("n_refs") >= least)


def capture_skip(status: str, content_type: str, body: str) -> Column:
    """Why a capture isn't worth keeping; null if it is."""
    compact = F.regexp_replace(F.substring(strip(F.coalesce(F.col(body), F.lit(""))), 1, 2000), r"\s+", "")
    broken = compact.startswith("{") & compact.contains('"status":500') & compact.contains('"unhandled":true')
    return F.when(F.col(status) >= 400, F.concat(F.lit("http_status_"), F.col(status).cast("string"))).when(F.lower(content_type).contains("application/json"), "json_response").when(broken, "error_payload")


def safe_svg(svg: str) -> Column:
    """The SVG without its prologue, '' if it is unsafe or none."""
    s = F.regexp_replace(F.regexp_replace(F.col(svg), r"(?i)^\s*<\?xml[^>]*>\s*", ""), r"(?i)^\s*<!DOCTYPE[^>]*>\s*", "")
    bad = s.rlike(UNSAFE_SVG[0]) | s.rlike(UNSAFE_SVG[1]) | s.rlike(UNSAFE_SVG[2])
    return F.when(bad | ~F.lower(s).contains("<svg"), "").otherwise(s)


def diff_counts(diff: str) -> tuple[Column, Column]:
    """Added and removed lines, headers not counted."""
    lines = F.split(F.col(diff), "\n")
    mine = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return mine("+").cast("long"), mine("-").cast("long")


def path_links(text: str) -> Column:
    """Distinct path-like words of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_-]+\.[a-z]{1,5})"), 1))


def cap_per(rows: DataFrame, key: list[str], order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(order))).where(F.col("rank") <= cap)


def skim(steps: DataFrame) -> DataFrame:
    """One text per report: the numbered titles and takeaways of its steps in order."""
    line = F.concat(F.col("step_no").cast("string"), F.lit(". "), F.col("title"), F.when(F.col("takeaway") != "", F.concat(F.lit(" - "), F.col("takeaway"))).otherwise(""))
    rows = steps.select("report", "step_no", line.alias("line"))
    return rows.groupBy("report").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "line"))), lambda x: x["line"]), "\n").alias("slice"))
