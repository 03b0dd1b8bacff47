"""Schemas that drift between files to one consistent table, with a report of every change (problem 2).

Each record is flattened to its leaves with their JSON types. Per directory and release the leaves that hold a value are
the release's fingerprint; fingerprints of consecutive releases are compared path by path. The migrations are explicit:
``FIELDS`` lists, for every column of the consistent table, the paths it had in the course of time and the
type it gets. The release of a record's file decides the chain of rename, default and cast that the record takes: names
outside ``FIELDS`` follow the renames that the fingerprints show, and only columns that the release lacks get a default.

Defined results
* Blank lines and lines that are no JSON object hold no record. Files without a readable version belong to no release
  (``p2_events`` keeps their records with a null version). Equal rows count once in fingerprints, each time as events.
* ``tool``, ``meta`` and ``usage`` are containers when they are objects; any other object is one field.
* A field that has several types in a release counts with the one most of its values have (ties: first by name).
* A field that goes is renamed to one that comes in the same container if both are names of the same column of
  ``FIELDS``, or the same words in another case style; or, for names that ``FIELDS`` doesn't know, if the one takes over the
  other's content: of one type, each the other's nearest in the container by what their values are like (length, digits,
  blanks, size of numbers, least hashes of the values), and no farther than ``FARTHEST``. What is left is removed and added.
* A value that a cast can't take becomes null, and the line is listed in ``failed``.
* A value without a column, or whose column another name of the record holds already (names of ``FIELDS`` go first), is kept
  in ``extra`` as JSON, under the earliest name that the renames of its directory lead back to.
* Records of no release get no default: what their release lacks isn't known.
"""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.runtime import cut, map_batches, table

CONTAINERS = ("tool", "meta", "usage")

#: Columns of the consistent table, their type, and the paths that releases use for them.
FIELDS = {
    "kind": ("string", ("kind", "event_kind", "kindName")),
    "seq": ("long", ("seq", "event_seq", "ordinal")),
    "session_id": ("string", ("session_id", "sessionId", "session")),
    "ts": ("string", ("ts", "timestamp", "at")),
    "turn_index": ("long", ("turn_index", "turnIndex", "turn")),
    "agent_id": ("string", ("agent_id", "agentId", "worker")),
    "trace_id": ("string", ("trace_id", "traceId", "span")),
    "text": ("string", ("text", "body", "content")),
    "lang": ("string", ("lang", "locale", "language")),
    "tags": ("string", ("tags", "labels", "marks")),
    "tool_name": ("string", ("tool.name", "tool.tool_name", "tool.toolName")),
    "call_id": ("string", ("tool.call_id", "tool.callId", "tool.id")),
    "tool_input": ("string", ("tool.input", "tool.arguments", "tool.args")),
    "tool_output": ("string", ("tool.output", "tool.result", "tool.stdout")),
    "is_error": ("boolean", ("tool.is_error", "tool.isError", "tool.failed")),
    "duration_ms": ("double", ("tool.duration_ms", "tool.durationMs", "tool.elapsed_ms")),
    "retries": ("long", ("tool.retries", "tool.retryCount", "tool.attempts")),
    "truncated": ("boolean", ("tool.truncated", "tool.is_truncated", "tool.cut")),
    "tokens_in": ("long", ("usage.tokens_in", "usage.tokensIn", "usage.prompt_tokens")),
    "tokens_out": ("long", ("usage.tokens_out", "usage.tokensOut", "usage.completion_tokens")),
    "cwd": ("string", ("meta.cwd", "meta.workdir", "meta.directory")),
    "model": ("string", ("meta.model", "meta.modelName", "meta.engine")),
    "branch": ("string", ("meta.branch", "meta.gitBranch", "meta.git_branch")),
    "cli_version": ("string", ("meta.cli_version", "meta.cliVersion")),
}
#: What a column gets in a record of a release that has no field for it.
DEFAULTS = {"is_error": False, "truncated": False, "retries": 0}
COLUMN_OF = {path: column for column, (_, paths) in FIELDS.items() for path in paths}
ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
#: What is known of the values of a path: sums over them, and least hashes, which agree as often as two sets of values do.
SUMS, LEAST = ("n", "chars", "digits", "blanks", "total"), ("h0", "h1", "h2", "h3")
FARTHEST = 0.25
_NO_DIGITS = str.maketrans("", "", "0123456789")
VERSION = r"(\d+)\.(\d+)\.(\d+)"


def json_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def record(line: str | None) -> dict | None:
    if not line or line.lstrip()[:1] != "{":
        return None
    try:
        found = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def leaves(rec: dict) -> list[tuple[str, object]]:
    """(path, value) of the fields that hold a value."""
    out = []
    for k, v in rec.items():
        if k in CONTAINERS and isinstance(v, dict):
            out += [(f"{k}.{a}", b) for a, b in v.items() if b is not None]
        elif v is not None:
            out.append((k, v))
    return out


def cast(value, kind: str):
    """The value as ``kind``; raises ValueError or TypeError where that can't be."""
    if kind == "string":
        if isinstance(value, list) and all(isinstance(x, str) for x in value):
            return "\n".join(value)
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    if kind == "boolean":
        if isinstance(value, bool):
            return value
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[str(value).strip().lower()]
    if isinstance(value, bool) or isinstance(value, (list, dict)):
        raise ValueError(value)
    number = float(value)
    if kind == "double":
        return number
    if number != int(number) or abs(number) >= 1 << 63:
        raise ValueError(value)
    return int(value) if isinstance(value, (int, str)) and "." not in str(value) and "e" not in str(value).lower() else int(number)


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def migrate(rec: dict, route: dict) -> tuple[dict, list[str], list[str], dict[str, str]]:
    """The record's columns; the paths that were renamed or cast on the way; the paths that failed; what has no column."""
    row, changed, failed, extra = {}, [], [], {}
    for path, value in sorted(leaves(rec), key=lambda x: x[0] not in COLUMN_OF):
        column = COLUMN_OF.get(path) or route["columns"].get(path)
        if column is None or column in row:
            key = path if column else route["names"].get(path, path)
            if key != path:
                changed.append(path)
            while key in extra:
                key += "+"
            extra[key] = as_json(value)
            continue
        kind, paths = FIELDS[column]
        try:
            row[column] = cast(value, kind)
            if path != paths[0] or json_type(value) != {"long": "integer", "double": "number"}.get(kind, kind):
                changed.append(path)
        except (ValueError, TypeError, KeyError, OverflowError):
            row[column] = None
            failed.append(path)
    if isinstance(rec.get("tool"), dict):
        row |= {c: DEFAULTS[c] for c in route["lacks"] if c not in row}
    return row, changed, failed, extra


#: The route of files without a release.
STRAIGHT = {"columns": {}, "names": {}, "lacks": []}


def routes_of(releases: list[tuple[str, list[str]]], renames: dict[str, dict[str, str]]) -> dict[str, dict]:
    """The route of each of a directory's releases, given in order as (version, paths); ``renames`` has new to old names by version.

    A route has the columns of names that ``FIELDS`` doesn't list, the earliest names of those without column, and the
    columns of ``DEFAULTS`` that the release lacks.
    """
    columns: list[dict] = []
    names: list[dict] = []
    for version, paths in releases:
        old = renames.get(version, {})
        before, called = (columns[-1], names[-1]) if columns else ({}, {})
        columns.append({p: COLUMN_OF.get(p) or before.get(old.get(p, p)) for p in paths})
        names.append({p: called.get(old.get(p, p), p) for p in paths})
    for i in range(len(releases) - 2, -1, -1):
        new = {o: n for n, o in renames.get(releases[i + 1][0], {}).items()}
        columns[i] = {p: c or columns[i + 1].get(new.get(p, p)) for p, c in columns[i].items()}
    out = {}
    for (version, paths), column, name in zip(releases, columns, names):
        taken = set(paths)
        earliest = {}
        for p in sorted(paths):
            if column[p] is None and name[p] not in taken:
                earliest[p] = name[p]
                taken.add(name[p])
        out[version] = {"columns": {p: c for p, c in column.items() if c and p not in COLUMN_OF}, "names": earliest, "lacks": [c for c in DEFAULTS if c not in column.values()]}
    return out


def _directory(col: str):
    return F.regexp_extract(F.col(col), r"^(.*)/[^/]*$", 1)


def _number(version: str):
    """A version as (a, b, c), from the spelling of a meta record; null if there is none."""
    part = lambda i: F.regexp_extract(version, VERSION, i).try_cast("long")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")))


def portrait(value) -> tuple:
    """What ``SUMS`` and ``LEAST`` take from one value."""
    said = value if isinstance(value, str) else as_json(value)
    h = zlib.crc32(said.encode("utf-8", "surrogatepass"))
    number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else 0.0
    return 1, len(said), len(said) - len(said.translate(_NO_DIGITS)), said.count(" "), number, h, *((h * x + 1 & 0xFFFFFFFF) for x in (2654435761, 2246822519, 3266489917))


def observed(lines: DataFrame) -> DataFrame:
    """(source_path, path, type, version, and ``SUMS`` and ``LEAST`` of the values) of the leaves of each file, within batches."""
    shape = "source_path string, path string, type string, version string, n long, chars long, digits long, blanks long, total double, " + ", ".join(f"{h} long" for h in LEAST)
    types = (*(pa.string(),) * 4, *(pa.int64(),) * 4, pa.float64(), *(pa.int64(),) * 4)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[tuple, list] = {}
        versions: dict[str, str] = {}
        for source, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rec = record(line)
            if rec is not None:
                for path, value in leaves(rec):
                    new, own = portrait(value), seen.get(key := (source, path, json_type(value)))
                    if own is None:
                        seen[key] = list(new)
                    else:
                        for i in range(5):
                            own[i] += new[i]
                        for i in range(5, 9):
                            if new[i] < own[i]:
                                own[i] = new[i]
                    if COLUMN_OF.get(path) == "cli_version" and isinstance(value, str):
                        versions[source] = max(versions.get(source, ""), value)
        rows = [(*key, versions.get(key[0]), *own) for key, own in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=["source_path", "path", "type", "version", *SUMS, *LEAST])

    return map_batches(lines.select("source_path", "line_text").where("source_path is not null and line_text is not null"), scan, shape)


def _releases(seen: DataFrame) -> DataFrame:
    """(source_path, release) of the files with a readable version."""
    return seen.groupBy("source_path").agg(_number(F.max("version")).alias("release")).where("release is not null")


def fingerprints(lines: DataFrame) -> DataFrame:
    """(source_dir, release, fields) with fields an array of (path, type, meaning, box and averages of the values), one row per release of a directory."""
    together = lambda: (*(F.sum(c).alias(c) for c in SUMS), *(F.min(c).alias(c) for c in LEAST))
    # the lines are read once: what is known of a file's paths is small, and both the releases and the fields come from it
    seen = cut(observed(lines).groupBy("source_path", "path", "type").agg(*together(), F.max("version").alias("version")))
    each = lambda c: (F.col(c) / F.col("n")).alias(c)
    like = F.struct("type", *(each(c) for c in SUMS[1:]), *LEAST)
    typed = (
        seen.join(_releases(seen), "source_path").groupBy(_directory("source_path").alias("source_dir"), "release", "path", "type").agg(*together())
        .groupBy("source_dir", "release", "path").agg(F.min_by(like, F.struct(-F.col("n"), F.col("type"))).alias("v"))
    )
    known = F.create_map(*(F.lit(x) for path, column in COLUMN_OF.items() for x in (path, column)))
    box, name = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1), F.regexp_extract("path", r"([^.]*)$", 1)
    same_words = F.concat(F.lit("?"), box, F.lit("."), F.lower(F.regexp_replace(name, "[_-]", "")))
    meaning = F.coalesce(F.try_element_at(known, F.col("path")), same_words)
    fields = F.array_sort(F.collect_list(F.struct("path", F.col("v.type").alias("type"), meaning.alias("meaning"), box.alias("box"), *(F.col(f"v.{c}").alias(c) for c in (*SUMS[1:], *LEAST)))))
    return typed.groupBy("source_dir", "release").agg(fields.alias("fields"))


def distance(c, g):
    """How unlike the values of two paths are, from 0 to 1: the means of length, digits, blanks and numbers; none if their least hashes agree."""
    part = lambda x: F.abs(c[x] - g[x]) / F.greatest(F.abs(c[x]), F.abs(g[x]), F.lit(1.0))
    share = lambda x: F.abs(c[x] / F.greatest(c["chars"], F.lit(1.0)) - g[x] / F.greatest(g["chars"], F.lit(1.0)))
    alike = sum((F.when(c[h] == g[h], 1.0).otherwise(0.0) for h in LEAST), F.lit(0.0)) / len(LEAST)
    return (1 - alike) * F.greatest(part("chars"), part("total"), share("digits"), share("blanks"))


def changes(prints: DataFrame) -> DataFrame:
    """(source_dir, cli_version, change_type, field_path, old_field_path) between consecutive releases of a directory."""
    pairs = prints.withColumn("old", F.lag("fields").over(W.partitionBy("source_dir").orderBy("release"))).where("old is not null")
    has = lambda fields, c: F.exists(fields, lambda x: x["path"] == c["path"])
    rank = lambda fields: F.transform(fields, lambda c: c.withField("rank", F.size(F.filter(fields, lambda x: (x["meaning"] == c["meaning"]) & (x["box"] == c["box"]) & (x["path"] < c["path"])))))
    new, old = F.col("fields"), F.col("old")
    step = pairs.select(
        "source_dir", "release",
        F.filter(new, lambda c: F.exists("old", lambda p: (p["path"] == c["path"]) & (p["type"] != c["type"]))).alias("retyped"),
        rank(F.filter(new, lambda c: ~has(old, c))).alias("come"), rank(F.filter(old, lambda c: ~has(new, c))).alias("gone"),
    )
    twin = lambda a, b: (a["meaning"] == b["meaning"]) & (a["box"] == b["box"]) & (a["rank"] == b["rank"])
    step = step.select(
        "*", F.filter("come", lambda c: ~F.exists("gone", lambda g: twin(c, g))).alias("come_alone"), F.filter("gone", lambda g: ~F.exists("come", lambda c: twin(c, g))).alias("gone_alone"),
    )
    # names that FIELDS doesn't know: each other's nearest in their container
    may = lambda c, g: (c["box"] == g["box"]) & (c["type"] == g["type"]) & (c["meaning"].startswith("?") | g["meaning"].startswith("?"))
    nearest = lambda fields, pair, d: F.coalesce(F.array_min(F.transform(F.filter(fields, lambda x: may(*pair(x))), lambda x: distance(*pair(x)))) >= d, F.lit(False))
    heir = lambda c, g: may(c, g) & (distance(c, g) <= FARTHEST) & nearest(F.col("gone_alone"), lambda x: (c, x), distance(c, g)) & nearest(F.col("come_alone"), lambda x: (x, g), distance(c, g))
    said = lambda kind, new_path, old_path: F.struct(F.lit(kind).alias("change_type"), new_path.alias("field_path"), old_path.alias("old_field_path"))
    none = F.lit("")
    rows = F.concat(
        F.transform("retyped", lambda c: said("type_changed", c["path"], none)),
        F.flatten(F.transform("come", lambda c: F.transform(F.filter("gone", lambda g: twin(c, g)), lambda g: said("renamed", c["path"], g["path"])))),
        F.flatten(F.transform("come_alone", lambda c: F.transform(F.filter("gone_alone", lambda g: heir(c, g)), lambda g: said("renamed", c["path"], g["path"])))),
        F.transform(F.filter("come_alone", lambda c: ~F.exists("gone_alone", lambda g: heir(c, g))), lambda c: said("added", c["path"], none)),
        F.transform(F.filter("gone_alone", lambda g: ~F.exists("come_alone", lambda c: heir(c, g))), lambda g: said("removed", g["path"], none)),
    )
    return step.select("source_dir", F.concat_ws(".", "release.a", "release.b", "release.c").alias("cli_version"), F.inline(rows))


def routes(lines: DataFrame) -> DataFrame:
    """(source_path, release, route) of every file with a release, the route as JSON; a directory's releases go into it together."""
    prints = fingerprints(lines)
    dotted = F.concat_ws(".", "release.a", "release.b", "release.c")
    per = prints.groupBy("source_dir").agg(F.array_sort(F.collect_list(F.struct("release", dotted.alias("version"), F.col("fields.path").alias("paths")))).alias("releases"))
    renamed = changes(prints).where("change_type = 'renamed'").groupBy("source_dir").agg(F.collect_list(F.struct("cli_version", "field_path", "old_field_path")).alias("renames"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for directory, releases, pairs in zip(*(c.to_pylist() for c in batch.columns)):
            old: dict[str, dict[str, str]] = {}
            for x in pairs or []:
                old.setdefault(x["cli_version"], {})[x["field_path"]] = x["old_field_path"]
            rows += [(directory, v, as_json(r)) for v, r in routes_of([(x["version"], x["paths"]) for x in releases], old).items()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], names=["source_dir", "release", "route"])

    known = map_batches(per.join(renamed, "source_dir", "left"), run, "source_dir string, release string, route string")
    files = _releases(observed(lines)).select("source_path", _directory("source_path").alias("source_dir"), dotted.alias("release"))
    return files.join(known, ["source_dir", "release"]).drop("source_dir")


def consistent(lines: DataFrame) -> DataFrame:
    """Every record as a row of FIELDS' columns, with its line and release, the paths that a rule changed, those that failed, and what has no column."""
    names = ["line_key", "source_path", "source_line", "release", *FIELDS, "changed", "failed", "extra"]
    schema = ", ".join(["line_key long, source_path string, source_line int, release string", *(f"{c} {t}" for c, (t, _) in FIELDS.items()), "changed array<string>, failed array<string>, extra map<string,string>"])
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), *(ARROW[t] for t, _ in FIELDS.values()), pa.list_(pa.string()), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, parsed = [], {None: STRAIGHT}
        for key, source, at, line, release, route in zip(*(c.to_pylist() for c in batch.columns)):
            rec = record(line)
            if rec is not None:
                if route not in parsed:
                    parsed[route] = json.loads(route)
                row, changed, failed, extra = migrate(rec, parsed[route])
                rows.append((key, source, at, release, *(row.get(c) for c in FIELDS), changed, failed, list(extra.items())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    routed = lines.where("line_text is not null").join(routes(lines), "source_path", "left")
    return map_batches(routed.select("line_key", "source_path", "source_line", "line_text", "release", "route"), run, schema)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return changes(fingerprints(table(spark, base, "artifact_lines")))


def p2_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """A digest of the fields of each release of each directory."""
    prints = fingerprints(table(spark, base, "artifact_lines"))
    return prints.select("source_dir", F.concat_ws(".", "release.a", "release.b", "release.c").alias("cli_version"), F.size("fields").alias("n_fields"), F.sha2(F.array_join(F.transform("fields", lambda c: F.concat_ws(":", c["path"], c["type"])), "\n"), 256).alias("fingerprint"))


def p2_events(spark: SparkSession, base: str) -> DataFrame:
    """The consistent table; ``release`` is that of the record's file, ``extra`` a JSON object, empty if all has a column."""
    events = consistent(table(spark, base, "artifact_lines"))
    joined = {c: F.array_join(c, ",") for c in ("changed", "failed")}
    return events.withColumns(joined | {"extra": F.to_json("extra")})
