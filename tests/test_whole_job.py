"""Queries that take the whole of their tables, against counts and SQL of their own."""

import os

import pytest

from tracemill.operators import events as E
from tracemill.operators import grouping
from tracemill.plans import event_queries as Q

BASE = "/root/testdata/sf0.001"
EV = "ev AS (SELECT * EXCLUDE (kind, rn), lower(trim(kind)) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY event_id) AS rn FROM session_events) WHERE rn = 1)"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(BASE):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{BASE}/{f}'")
    return con


def test_chunk_checks_count_subagents_too(spark):
    bad = {r.check: r.n_bad for r in Q.chunk_checks(spark, BASE).collect()}
    assert bad["no_rows"] == 0 and bad["wrong_count"] == 0 and bad["bad_range"] == 0


def test_split_pairs_see_subagents(spark, duck):
    want = duck.sql(f"""WITH {EV}, cl AS (SELECT ev.*, c.chunk_id FROM ev JOIN chunks c ON c.session_id = ev.session_id WHERE source_line BETWEEN line_start AND line_end)
        SELECT DISTINCT session_id, chunk_id, tool.call_id FROM cl a WHERE kind = 'tool_result' AND tool.call_id <> ''
        AND NOT EXISTS (SELECT 1 FROM cl b WHERE b.kind = 'tool_use' AND b.session_id = a.session_id AND b.chunk_id = a.chunk_id AND b.tool.call_id = a.tool.call_id)""").fetchall()
    assert {(r.session_id, r.chunk_id, r.call_id) for r in Q.split_pairs(spark, BASE).collect()} == set(want)


def test_chunks_hold_all_streams_like_one_fold(spark):
    import hashlib

    text = lambda e: f"{e.seq}|{e.kind}|{e.text or ''}|{e.tool and e.tool.input or ''}|{e.tool and e.tool.output or ''}\n"
    sessions = {}
    for e in E.load(spark, BASE, "agent_id", "text", "tool", "source_line").orderBy("session_id", "seq").collect():
        sessions.setdefault(e.session_id, []).append(e)
    assert any(e.agent_id for events in sessions.values() for e in events)
    leaders, packed, halves, hashes = {}, {}, {}, set()
    for s, events in sessions.items():
        lead = grouping.fold_groups([(e.kind, e.agent_id or "", e.tool and e.tool.call_id or "") for e in events])
        groups = {}
        for i, e in enumerate(events):
            leaders[e.event_id] = events[lead[i]].seq
            groups.setdefault(lead[i], []).append(e)
        used, chunk, rows = 0, -1, {}
        for i in sorted(groups):
            size = sum(len(text(e)) for e in groups[i])
            if size >= Q.TARGET or not used or used + size > Q.TARGET:
                chunk, used = chunk + 1, 0
            used = 0 if size >= Q.TARGET else used + size
            packed[s, events[i].seq] = (size, chunk)
            rows.setdefault(chunk, []).extend(groups[i])
        for chunk, held in rows.items():
            split, running, whole = len(held), 0, sum(len(text(e)) for e in held)
            for place, e in enumerate(held, 1):
                running += len(text(e))
                if whole > Q.TARGET and e.kind == "user_message" and 1 < place < len(held) and running <= Q.TARGET:
                    split = place
            for half, part in enumerate((held[:split], held[split:])):
                if part:
                    halves[s, chunk, half] = len(part)
                    hashes.add((s, len(part), min(e.source_line for e in part), max(e.source_line for e in part), hashlib.sha256("".join(map(text, part)).encode()).hexdigest()))
    assert {r.event_id: r.leader for r in Q.atomic_groups(spark, BASE).collect()} == leaders
    assert {(r.session_id, r.leader): (r.size, r.chunk) for r in Q.chunk_pack(spark, BASE).collect()} == packed
    assert {(r.session_id, r.chunk, r.half): r.n for r in Q.chunk_refine(spark, BASE).collect()} == halves
    assert {(r.session_id, r.event_count, r.line_start, r.line_end, r.sha256) for r in Q.chunk_manifest(spark, BASE).collect()} == hashes


def test_undeclared_refs_take_every_descriptor(spark, tmp_path):
    events = [(i, f"s{i}", 1, "meta", p, f"/t/{f}.jsonl") for i, (p, f) in enumerate([("claude", "a"), ("claude", "b"), ("claude", "c"), ("claude", "missing"), ("codex", "d")])]
    spark.createDataFrame(events, "event_id long, session_id string, seq long, kind string, provider string, source_path string").write.parquet(f"{tmp_path}/session_events.parquet")
    listed = [(1, "s0", "claude", "/t/a.jsonl"), (2, "s1", "claude", "b.jsonl"), (3, "s2", "claude", "/t/c.jsonl")]
    spark.createDataFrame(listed, "session_row long, session_id string, provider string, source_path string").selectExpr("*", "timestamp '2026-01-01' AS discovered_at").write.parquet(f"{tmp_path}/sessions.parquet")
    assert [tuple(r) for r in Q.undeclared_refs(spark, str(tmp_path)).collect()] == [("claude", "/t/missing.jsonl")]


def test_svg_safety_searches_the_whole_text(spark, tmp_path):
    texts = [(2, "x" * 60), (5, "x" * 60 + "<script>"), (8, "short"), (11, "x" * 50 + " onload = y"), (3, "x" * 60), (14, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in Q.svg_safety(spark, str(tmp_path)).collect()} == {(2, 71), (5, 0), (8, 16), (11, 0), (3, 0)}


def test_consistent_table_follows_the_release(spark):
    import json

    from tracemill.operators import schema_drift as D

    use = lambda **tool: {"kind": "tool_use", "tool": {"name": "x", **tool}}
    files = {
        "/d/a.jsonl": [{"meta": {"cli_version": "1.0.0"}}, {"text": "t", "speed": 1}, use()],
        "/d/b.jsonl": [{"meta": {"cli_version": "1.1.0"}}, {"prose": "u", "velocity": 2}, use()],
        "/d/c.jsonl": [{"meta": {"cli_version": "1.10.0"}}, {"prose": "v", "velocity": 2, "lang": "de", "locale": "fr"}, use(is_error=True, retries=2), use()],
        "/e/n.jsonl": [use()],
    }
    # text is renamed to prose, as the only ones of their type in the container are these; speed to velocity needs a release of its own
    files["/d/b.jsonl"][1].pop("velocity"), files["/d/b.jsonl"][1].update(speed=1)
    rows = [(i, path, n, json.dumps(r)) for i, (path, n, r) in enumerate((p, n, r) for p, recs in files.items() for n, r in enumerate(recs, 1))]
    got = {(r.source_path[3], r.source_line): r for r in D.consistent(spark.createDataFrame(rows, "line_key long, source_path string, source_line int, line_text string")).collect()}
    assert len(got) == 11
    defaults = lambda r: (r.is_error, r.truncated, r.retries)
    assert defaults(got["a", 3]) == defaults(got["b", 3]) == (False, False, 0)
    assert defaults(got["c", 3]) == (True, False, 2) and defaults(got["c", 4]) == (None, False, None) and defaults(got["n", 1]) == (None, None, None)
    assert got["b", 2].text == "u" and "prose" in got["b", 2].changed and got["c", 2].text == "v" and got["c", 2].release == "1.10.0" and got["n", 1].release is None
    assert got["a", 2].extra == {"speed": "1"} and got["c", 2].lang == "de" and got["c", 2].extra["locale"] == '"fr"'
    assert D.routes_of([("1", ["a", "text"]), ("2", ["b", "text"]), ("3", ["c", "a"])], {"2": {"b": "a"}, "3": {"c": "b"}})["3"]["names"] == {}
    assert D.routes_of([("1", ["a"]), ("2", ["b"]), ("3", ["text"])], {"2": {"b": "a"}, "3": {"text": "b"}})["1"]["columns"] == {"a": "text"}


def test_round_robin_counts_what_is_left(spark):
    from tracemill.operators import links

    items = spark.createDataFrame([(k, i) for k, n in (("a", 4), ("b", 1), (None, 2), ("z", 3)) for i in range(n)], "k string, i long")
    dealt, left = links.round_robin(items, "k", "i", 5).collect(), {r.k: r.n_left for r in links.round_robin_left(items, "k", "i", 5).collect()}
    assert left == {"a": 3, "b": 0, None: 0, "z": 2} and len(dealt) + sum(left.values()) == 10
