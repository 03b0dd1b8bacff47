import json

from tracemill.sources import discover, jsonl


def write(path, *recs, pad=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in recs) + " " * pad)
    return str(path)


def test_scan_keeps_line_numbers_and_skips_what_is_no_object(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", {"a": 1}, "", "bad", "[1]", {"b": 2})
    got = jsonl.scan_jsonl(spark, p).orderBy("source_line").collect()
    assert [(r.source_line, json.loads(r.line)) for r in got] == [(1, {"a": 1}), (5, {"b": 2})]
    assert jsonl.count_lines(jsonl.scan_lines(spark, p)).first().line_count == 5


def test_discovery(spark, tmp_path):
    write(tmp_path / "cx/2026/rollout-1.jsonl", {"type": "session_meta", "timestamp": "t1", "payload": {"cwd": "/w", "model_provider": "m"}}, pad=2000)
    write(tmp_path / "cx/rollout-2.jsonl", {"type": "other"}, pad=2000)
    write(tmp_path / "cx/rollout-3.jsonl", {"type": "session_meta", "payload": {}})
    got = discover.codex(spark, str(tmp_path / "cx")).collect()
    assert [(r.cwd, r.model, r.timestamp, r.line_count) for r in got] == [("/w", "m", "t1", 2)]
    write(tmp_path / "cl/p/s1.jsonl", {"type": "user", "cwd": "/a", "sessionId": "s1", "version": "2", "timestamp": "2026-01-02T00:00:00Z"}, {"type": "assistant", "message": {"model": "mm"}}, pad=2000)
    write(tmp_path / "cl/p/s1/subagents/agent-x.jsonl", {"type": "user"}, pad=2000)
    found = discover.claude(spark, str(tmp_path / "cl"))
    r = found.first()
    assert found.count() == 1 and (r.cwd, r.model, r.session_id, len(r.subagent_paths)) == ("/a", "mm", "s1", 1)
    assert discover.matching(found, since="2026-01-02", cwd="/a").count() == 1 and discover.matching(found, until="2026-01-01").count() == 0 and discover.matching(found, project="zz").count() == 0


def test_store_and_export(spark, tmp_path):
    session = spark.createDataFrame([("a", None, "/w", "T", "1", 1000, 2000), ("b", "a", None, None, None, 0, 3000)], "id string, parent_id string, directory string, title string, version string, time_created long, time_updated long")
    data = spark.createDataFrame([("a", "xxxx"), ("a", None)], "session_id string, data string")
    rows = {r.session_id: r for r in discover.opencode(session, data, data.limit(0)).collect()}
    assert (rows["a"].size_bytes, rows["a"].line_count, rows["a"].timestamp) == (7, 3, "1970-01-01T00:00:01Z") and (rows["b"].parent_session_id, rows["b"].timestamp) == ("a", "1970-01-01T00:00:03Z")
    p = write(tmp_path / "e.json", {"info": {"id": "s"}, "messages": [{"info": {"id": "m"}, "parts": [1]}, 5, {"info": 3}]})
    lines = [json.loads(r.line) for r in jsonl.flatten_export(jsonl.read_document(spark, p)).orderBy("at").collect()]
    assert lines == [{"type": "session", "info": {"id": "s"}}, {"type": "message", "info": {"id": "m"}, "parts": [1]}]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "seq int, k string, n string")
    jsonl.write_jsonl(rows, str(tmp_path / "o"), order=["seq"])
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "o")).collect()] == [{"seq": 1, "k": "a", "n": "x"}, {"seq": 2, "k": "b"}]
    jsonl.write_chunks(spark.createDataFrame([("s", "c1", 2, "y\n"), ("s", "c1", 1, "x"), ("s", "c2", 1, "z"), ("t", "c1", 1, "w")], "session_id string, chunk_id string, place int, line string"), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c/session_id=s/chunk_id=c1")).collect()] == ["x", "y"] and jsonl.read_chunks(spark, str(tmp_path / "c")).where("session_id = 't'").count() == 1


def test_strict_export_and_manifest(spark, tmp_path):
    import pytest

    good, bad = write(tmp_path / "g.jsonl", {"type": "session", "info": {"id": "s"}}, ""), write(tmp_path / "b.jsonl", "{broken")
    assert jsonl.load_export(spark, good).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        jsonl.load_export(spark, bad).collect()
    jsonl.write_manifest(spark.createDataFrame([("s", "chunk-002", 5), ("s", "chunk-001", 7)], "session_id string, chunk_id string, byte_size int"), str(tmp_path / "m"), "x.jsonl", 6000)
    head, *entries = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert head == {"source": "x.jsonl", "target_bytes": 6000} and [e["chunk_id"] for e in entries] == ["chunk-001", "chunk-002"]
