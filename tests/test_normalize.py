import json

import pytest

from tracemill.operators import normalize as N
from tracemill.sources.jsonl import records


def recs(spark, **files):
    rows = [(path.replace("__", "/") + ".jsonl", i, x if isinstance(x, str) else json.dumps(x)) for path, lines in files.items() for i, x in enumerate(lines, 1)]
    return records(spark.createDataFrame(rows, "source_path string, source_line int, line string"))


def user(text, **kw):
    return {"type": "user", "sessionId": "s1", "timestamp": kw.pop("ts", "2026-01-01T00:00:01Z"), "message": {"content": text}, **kw}


def assistant(*items, ts="2026-01-01T00:00:02Z"):
    return {"type": "assistant", "timestamp": ts, "message": {"model": "m1", "content": list(items)}}


def use(name, call, **args):
    return {"type": "tool_use", "id": call, "name": name, "input": args}


def test_claude_turns_tools_and_meta(spark):
    rows = N.claude(recs(spark, s1=[
        user([{"type": "text", "text": "hello"}], cwd="/w", version="2.1", gitBranch="dev"),
        assistant({"type": "thinking", "text": "x"}, {"type": "text", "text": "hi"}, use("Edit", "c1", file_path="a.py", old_string="x\n", new_string="y\nz")),
        "", "not json", user([{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "ok"}, {"type": "text", "text": "done"}]}]),
        assistant(use("Write", "c2", file_path="b.py", content="q"), use("Bash", "c3", command="ls")),
        user([{"type": "tool_result", "tool_use_id": "c3", "content": "bad", "is_error": True}]), user("again"), {"type": "system", "subtype": "stop"}, {"type": "progress"},
    ])).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 14)) and rows[0].kind == "meta"
    assert sorted(r.kind for r in rows) == sorted(["meta", "user_message", "assistant_message", "tool_use", "file_change", "tool_result", "tool_use", "file_change", "tool_use", "command", "tool_result", "user_message", "system"])
    by = {}
    for r in rows:
        by.setdefault(r.kind, []).append(r)
    assert by["meta"][0].meta.cwd == "/w" and by["meta"][0].meta.model == "m1" and by["meta"][0].meta.branch == "dev" and by["meta"][0].turn_index == 0
    assert [r.turn_index for r in by["user_message"]] == [1, 2]
    assert by["file_change"][0].file_change.diff == "--- a/a.py\n+++ b/a.py\n@@ -1,1 +1,2 @@\n-x\n+y\n+z" and by["file_change"][1].file_change.kind == "create"
    assert by["tool_result"][0].tool.output == "ok\ndone" and by["tool_result"][0].tool.is_error is None and by["tool_result"][1].tool.is_error is True
    assert by["command"][0].command.cmd == "ls" and {r.session_id for r in rows} == {"s1"}
    assert by["system"][0].text == "stop" and by["system"][0].ts != ""
    assert by["assistant_message"][0].source_line == 2 and by["tool_result"][0].source_line == 5


def test_claude_other_sessions_records_are_left_out(spark):
    rows = N.claude(recs(spark, s1=[user("before", sessionId="old"), user("mine"), user("theirs", sessionId="other")]), by_file_name=True).where("kind = 'user_message'").collect()
    assert [r.text for r in rows] == ["mine"]


@pytest.mark.parametrize("progress,basis", [(True, "progress"), (False, "single")])
def test_claude_subagent_links(spark, progress, basis):
    lines = [user("go"), assistant(use("Agent", "call1", task="t"))] + ([{"type": "progress", "data": {"agentId": "a1", "parentToolUseID": "call1"}}] if progress else [])
    rows = N.claude(recs(spark, s1=lines, **{"s1__subagents__agent-a1": [user("sub", ts="2026-01-01T00:00:05Z")]})).where("agent_id = 'a1' and kind = 'user_message'").collect()
    assert [(r.session_id, r.parent_call_id, r.root_turn_index, r.parent_link_status, r.parent_link_basis) for r in rows] == [("s1", "call1", 1, "matched", basis)]


def test_claude_links_by_time_all_or_none(spark):
    lines = [user("go"), assistant(use("Agent", "c1"), ts="2026-01-01T00:00:02Z"), assistant(use("Agent", "c2"), ts="2026-01-01T00:01:00Z")]
    subs = lambda t: {f"s1__subagents__agent-a{i}": [user("x", ts=x)] for i, x in enumerate(t)}
    good = N.claude(recs(spark, s1=lines, **subs(["2026-01-01T00:02:00Z", "2026-01-01T00:00:03Z"]))).where("agent_id is not null and kind = 'user_message'").collect()
    assert {(r.agent_id, r.parent_call_id, r.parent_link_basis) for r in good} == {("a1", "c1", "time"), ("a0", "c2", "time")}
    bad = N.claude(recs(spark, s1=lines, **subs(["2026-01-01T00:00:30Z", "2026-01-01T00:00:03Z"]))).where("agent_id is not null and kind = 'user_message'").collect()
    assert {(r.parent_call_id, r.parent_link_status) for r in bad} == {(None, "ambiguous")}


def test_codex(spark):
    msg = lambda role, text: {"type": "response_item", "timestamp": "t", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}}
    item = lambda **p: {"type": "response_item", "timestamp": "t", "payload": p}
    rows = N.codex(recs(spark, r=[
        msg("user", "early"), {"type": "session_meta", "timestamp": "t0", "payload": {"id": "sid", "cwd": "/w", "model_provider": "mp", "git": {"branch": "b", "dirty": False}}},
        msg("developer", "no"), msg("user", "hi"), msg("user", "   "), msg("assistant", "yo"),
        item(type="custom_tool_call", name="fileChange", call_id="c1", input=json.dumps({"path": "a.py", "kind": "create", "diff": "+x"})),
        item(type="custom_tool_call", name="CommandExecution", call_id="c2", input=json.dumps({"command": "make", "exitCode": "2", "status": "failed", "output": "boom"})),
        item(type="function_call_output", call_id="c3", output="saved /tmp/a.png and /tmp/b.jpg"), item(type="reasoning", summary=[{"text": "one"}, {"text": ""}, {"text": "two"}]),
        {"type": "event_msg", "payload": {"type": "agent_plan", "plan": ["a", "b"]}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "more"}},
        {"type": "compacted", "payload": {"message": "", "replacement_history": [1, 2]}}, {"type": "turn_context", "payload": {"model": "mm", "cwd": "/w"}}, {"type": "turn/diff/updated", "payload": {"diff": "d"}},
    ])).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["user_message", "meta", "user_message", "assistant_message", "tool_use", "file_change", "tool_use", "command", "tool_result", "screenshot", "screenshot", "reasoning", "plan_update", "user_message", "compaction", "turn_context", "aggregate_diff"]
    assert rows[0].session_id == "" and rows[1].session_id == "sid" and rows[1].meta.dirty is False
    assert [r.turn_index for r in rows if r.kind == "user_message"] == [1, 2, 3]
    assert rows[5].file_change.asDict() == {"path": "a.py", "kind": "create", "diff": "+x"} and rows[7].command.exit_code == 2 and rows[7].command.output_preview == "boom"
    assert [r.media.file_path for r in rows if r.kind == "screenshot"] == ["/tmp/a.png", "/tmp/b.jpg"]
    assert rows[11].text == "one\ntwo" and rows[12].text == "a\nb" and rows[14].text.endswith("items: 2")


def test_opencode(spark):
    ms = 1_760_000_000_000
    rows = N.opencode(recs(spark, o=[
        {"type": "session", "info": {"id": "ses", "directory": "/w", "title": "T", "version": "1", "time": {"created": ms}}},
        {"type": "message", "info": {"id": "u1", "role": "user", "time": {"created": ms + 1500}, "model": {"providerID": "p", "modelID": "m"}, "summary": {"diffs": [{"file": "a", "before": "", "after": "x"}]}}, "parts": [{"type": "text", "text": "hi"}]},
        {"type": "message", "info": {"id": "a1", "role": "assistant", "parentID": "u1", "time": {"created": ms + 2000}}, "parts": [
            {"type": "tool", "tool": "bash", "callID": "c1", "state": {"status": "completed", "input": {"command": "ls"}, "output": "a\nb", "metadata": {"exit": 0}, "time": {"start": ms, "end": ms}, "attachments": [{"mime": "image/png", "url": "data:image/png;base64,QUJD"}]}},
            {"type": "patch", "files": ["z"]}, {"type": "compaction", "auto": True}, {"type": "text", "text": "done"}]},
        {"type": "message", "info": {"id": "u2", "role": "user", "summary": {"diffs": [{"file": "b", "before": "x", "after": ""}]}}, "parts": [{"type": "text", "text": " "}]},
        {"type": "message", "info": {"id": "a2", "role": "assistant", "parentID": "zz", "error": {"message": "bad"}}, "parts": [{"type": "patch", "files": ["z"]}, {"type": "tool", "tool": "read", "callID": "c2", "state": {"status": "error", "error": "no"}}]},
    ])).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["meta", "user_message", "tool_use", "command", "tool_result", "screenshot", "compaction", "assistant_message", "file_change", "file_change", "tool_use", "tool_result", "system", "file_change"]
    assert rows[0].meta.model == "p/m" and rows[0].ts == "2025-10-09T08:53:20Z" and rows[1].ts == "2025-10-09T08:53:21.500000Z"
    assert rows[3].command.status == "pass" and rows[3].command.output_lines == 2 and rows[5].media.data_b64 == "QUJD"
    assert [(r.file_change.path, r.file_change.kind) for r in rows if r.kind == "file_change"] == [("a", "create"), ("z", "modify"), ("b", "delete")]
    assert {r.session_id for r in rows} == {"ses"} and rows[11].tool.is_error is True and rows[12].text == "Assistant error: bad"


def test_vendors_in_one_table(spark):
    rows = N.normalize_all(claude=recs(spark, s1=[user("hi")]), codex=recs(spark, r=[{"type": "session_meta", "payload": {"id": "x"}}])).collect()
    assert {(r.provider, r.session_id, r.kind) for r in rows} == {("claude", "s1", "user_message"), ("codex", "x", "meta")}
