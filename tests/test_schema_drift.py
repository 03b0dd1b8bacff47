import json

from tracemill.operators import schema_drift as D


def lines(spark, files):
    rows, key = [], 0
    for path, recs in files.items():
        for i, r in enumerate(recs, 1):
            key += 1
            rows.append((key, path, i, r if r is None or isinstance(r, str) else json.dumps(r)))
    return spark.createDataFrame(rows, "line_key long, source_path string, source_line int, line_text string")


def meta(version, **kw):
    return {"kind": "meta", "meta": {"cli_version": version, **kw}}


def said(spark, files):
    return {(r.source_dir, r.cli_version, r.change_type, r.field_path, r.old_field_path) for r in D.changes(D.fingerprints(lines(spark, files))).collect()}


def test_every_kind_of_change(spark):
    files = {
        "/d/f2.jsonl": [meta("v1.10.0", workdir="/x"), {"kind": "x", "body": "t", "tool": {"tool_name": "Bash", "arguments": "{}"}, "seq": "3", "usage": {"tokensOut": 4}, "fooBar": 1}, None, "", "not json", "[1]"],
        "/d/f1.jsonl": [meta("1.9.0+build.3 ", cwd="/x"), {"kind": "x", "text": "t", "tool": {"name": "Bash", "input": {"a": 1}}, "seq": 3, "usage": {"tokens_in": 4}, "gone": None, "foo_bar": 1}, {"lang": "en"}],
    }
    assert said(spark, files) == {("/d", "1.10.0", *c) for c in [
        ("renamed", "meta.workdir", "meta.cwd"), ("renamed", "body", "text"), ("renamed", "tool.tool_name", "tool.name"), ("renamed", "tool.arguments", "tool.input"), ("type_changed", "seq", ""),
        ("removed", "usage.tokens_in", ""), ("added", "usage.tokensOut", ""), ("removed", "lang", ""), ("renamed", "fooBar", "foo_bar"),
    ]}


def test_objects_in_place_of_values_fractions_and_order(spark):
    files = {"/d/a.jsonl": [meta("0.9.0", model="m"), {"tool": {"duration_ms": 5}}], "/d/b.jsonl": [meta("0.10.0", model={"id": "m"}), {"tool": {"duration_ms": 5.0}}], "/e/x.jsonl": [meta("0.10.0")], "/e/y.jsonl": [{"kind": "no meta"}]}
    assert said(spark, files) == {("/d", "0.10.0", "type_changed", "meta.model", ""), ("/d", "0.10.0", "type_changed", "tool.duration_ms", "")}


def test_unknown_names_are_renamed_by_their_content(spark):
    old = [meta("1.0.0"), *({"speed": 40 + i % 20, "site": f"rack-{i % 7}", "memo": "a sentence of some words " * (1 + i % 3), "gone": "g" * 30} for i in range(60))]
    new = [meta("1.0.1"), *({"velocity": 41 + i % 19, "place": f"rack-{i % 5}", "remark": "other words in a sentence " * (1 + i % 3), "height": i % 3, "fresh": str(i) * 4} for i in range(60))]
    got = {c[2:] for c in said(spark, {"/d/a.jsonl": old, "/d/b.jsonl": new})}
    assert got == {("renamed", "velocity", "speed"), ("renamed", "place", "site"), ("renamed", "remark", "memo"), ("added", "height", ""), ("added", "fresh", ""), ("removed", "gone", "")}
    # another type or other content is no heir
    assert {c[2] for c in said(spark, {"/d/a.jsonl": [meta("1.0.0"), {"speed": 1}], "/d/b.jsonl": [meta("1.0.1"), {"velocity": "fast"}]})} == {"removed", "added"}


def test_consistent_table(spark):
    files = {"/d/a.jsonl": [meta("1.0.0"), {"kindName": "tool_use", "ordinal": "7", "tool": {"id": "c", "stdout": ["a", "b"], "failed": 1, "attempts": "x"}, "labels": ["p", "q"]}, "junk", None, {"extra": {"deep": 1}}]}
    rows = D.consistent(lines(spark, files)).orderBy("line_key").collect()
    assert len(rows) == 3
    r = rows[1]
    assert (r.kind, r.seq, r.call_id, r.tool_output, r.is_error, r.retries, r.tags) == ("tool_use", 7, "c", "a\nb", True, None, "p\nq")
    assert r.failed == ["tool.attempts"] and "ordinal" in r.changed and rows[0].cli_version == "1.0.0" and rows[2].kind is None


def test_empty(spark):
    empty = lines(spark, {"/d/a.jsonl": [None]})
    assert D.changes(D.fingerprints(empty)).count() == 0 and D.consistent(empty).count() == 0
