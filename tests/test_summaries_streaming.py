import json

import pytest

from tracemill.functions import text as T
from tracemill.operators import summaries as S
from tracemill.streaming import turns


def test_repair_of_loose_shapes(spark):
    doc = {
        "narrative": ["a", "b"], "claims": ["x", {"text": "y", "confidence": "grounded"}, {"no": 1}, 5], "files_changed": ["p", {"path": "q", "kind": "modify"}], "commands": ["make [FAIL]", {"command": "ls", "status": "odd"}, {}],
        "decisions": "none", "errors": [{"message": "boom", "resolution": "r"}], "key_concepts": ["k", 1],
    }
    rows = spark.createDataFrame([(json.dumps(doc),), (json.dumps({"narrative": 7}),)], "j string").selectExpr("parse_json(j) as doc")
    a, b = (r.asDict(recursive=True) for r in S.repaired(rows).drop("doc").collect())
    assert a["narrative"] == "a b" and a["claims"] == [{"text": "x", "confidence": "inferred"}, {"text": "y", "confidence": "grounded"}]
    assert a["files_changed"] == [{"path": "p", "kind": "unknown", "summary": ""}, {"path": "q", "kind": "modify", "summary": ""}]
    assert a["commands"] == [{"cmd": "make", "status": "fail", "summary": ""}, {"cmd": "ls", "status": "pass", "summary": ""}]
    assert a["decisions"] == [] and a["errors"] == [{"error": "boom", "resolution": "r"}] and a["key_concepts"] == ["k", "1"]
    assert b["narrative"] == "7" and b["claims"] == []


def test_merge_and_report(spark):
    chunks = spark.createDataFrame([("s", "chunk-001", "aaaaaaaa1"), ("s", "chunk-002", "bbbbbbbb2"), ("s", "chunk-003", "cccccccc3")], "session_id string, chunk_id string, sha256 string")
    good = spark.createDataFrame([("s", "chunk-001", "aaaaaaaa", "told"), ("s", "chunk-002", "stale000", "old")], "session_id string, chunk_id string, prefix string, narrative string")
    spare = spark.createDataFrame([("s", "chunk-002", "counted")], "session_id string, chunk_id string, narrative string")
    steps = S.merge(chunks, good, spare)
    assert [(r.step_no, r.source, r.narrative) for r in steps.orderBy("step_no").collect()] == [(1, "summary", "told"), (2, "fallback", "counted"), (3, "stub", "")]
    with pytest.raises(ValueError):
        S.merge(chunks, good, spare, allow_fallback=False)
    sources = spark.createDataFrame([("s", "codex", "/b", None), ("s", "claude", "/a", "2026")], "session_id string, provider string, source_path string, first_ts string")
    doc = S.report(steps, sources, spark.createDataFrame([("s", "/w")], "session_id string, cwd string")).first()
    assert [x.chunk_id for x in doc.steps] == ["chunk-001", "chunk-002", "chunk-003"] and [x.path for x in doc.sources] == ["/a", "/b"] and doc.meta.cwd == "/w"


def test_text_functions(spark):
    one = lambda e, v: spark.createDataFrame([(v,)], "x string").select(e).first()[0]
    assert one(T.truncate_words("x", 20), "alpha beta gamma delta epsilon") == "alpha beta gamma..." and one(T.truncate_words("x", 20), "a" * 30) == "a" * 20 + "..." and one(T.truncate_words("x", 20), " short\n text ") == "short text"
    assert one(T.first_sentence("x"), " Who? Me! v1.2") == "Who? Me! v1." and one(T.first_sentence("x", 80, False), "x" * 90) == "x" * 80 + "..." and one(T.first_sentence("x"), "") == ""
    assert one(T.split_lines("x"), "a\r\nb\x0bc d\n") == ["a", "b", "c", "d"] and one(T.split_lines("x"), "") == [] and one(T.first_meaningful_line("x"), " \n\t b ") == "b"
    assert one(T.route_tokens("x"), "/Users/list_all/42?x=y") == ["users", "list", "all"] and one(T.sha_tokens("x"), "git log abcdef1 abcdef1 12") == ["abcdef1"]
    assert [one(T.coerce_int("x"), v) for v in (" -12 ", "1.5", "", None, "+7")] == [-12, None, None, None, 7]


def test_links_and_dates(spark):
    from datetime import datetime

    one = lambda e, v=None: spark.createDataFrame([(v,)], "x string").select(e).first()[0]
    assert one(T.editor_link("x"), "/a b/c+d.py") == "vscode://file//a%20b/c%2Bd.py" and one(T.editor_link("x"), "") == "" and one(T.script_json("x"), "</script>&") == "\\u003c/script\\u003e\\u0026"
    now = datetime(2026, 3, 8)
    assert one(T.since("7d", now).cast("string")) == "2026-03-01 00:00:00" and one(T.since("2026-03-01", now).cast("string")) == "2026-03-01 00:00:00" and one(T.since("2026-03-01T02:00:00+02:00", now).cast("string")) == "2026-03-01 00:00:00"


def test_streaming(spark, tmp_path):
    schema = "session_id string, agent_id string, seq long, kind string, text string, ingested_at timestamp"
    batches = [[("s", None, 1, "USER_MESSAGE ", "q", "2026-01-01 00:00:00"), ("s", None, 2, "assistant_message", "a", "2026-01-01 00:00:01"), ("s", "x", 3, "meta", None, "2026-01-01 00:00:01")], [("s", None, 4, "user_message", "q", "2026-01-01 00:30:00"), ("s", None, 4, "user_message", "q", "2026-01-01 00:31:00"), ("s", None, 5, "tool_use", None, "2026-01-01 05:00:00")]]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr("* except (ingested_at)", "cast(ingested_at as timestamp) as ingested_at").coalesce(1).write.mode("append").parquet(str(source))

    def run(frame, name):
        q = frame.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    assert {(r.agent_id, r.seq, r.turn) for r in run(turns.running_turns(turns.deduplicated(stream())), "turns")} == {("", 1, 1), ("", 2, 1), ("x", 3, 0), ("", 4, 2), ("", 5, 2)}
    assert {(r.kind, r.n) for r in run(turns.kind_counts(stream()), "counts")} == {("user_message", 3), ("assistant_message", 1), ("meta", 1)}


def test_times_in_utc_whatever_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = [r[0] for r in spark.createDataFrame([("1760000000000",), ("1760000001500",), ("x",)], "x string").select(T.epoch_ms_iso("x")).collect()]
            assert rows == ["2025-10-09T08:53:20Z", "2025-10-09T08:53:21.500000Z", ""]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
