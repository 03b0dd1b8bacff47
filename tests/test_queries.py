"""Every core query against its SQL on the smallest test tables."""

import os
import random

import pytest

from tracemill.operators import grouping, links, report
from tracemill.operators.clean import LONG, Stripper, strip_json
from tracemill.plans.queries import CORE

BASE = "/root/testdata/sf0.001"
WITH_SQL = [n for n, (_, sql) in CORE.items() if sql]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(BASE):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{BASE}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: None if v is None else str(v)
    return sorted((tuple(text(r[i]) for i in order) for r in values), key=lambda r: tuple((x is None, x or "") for x in r))


@pytest.mark.parametrize("name", WITH_SQL)
def test_like_sql(spark, duck, name):
    query, sql = CORE[name]
    got, want = query(spark, BASE), duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in CORE.items() if not sql and not n.startswith("p")])
def test_without_sql_runs(spark, name):
    assert CORE[name][0](spark, BASE).count() >= 0


def test_window_groups_like_the_fold(spark):
    rng = random.Random(2)
    data = []
    for s in range(40):
        for q in range(rng.randrange(1, 40)):
            kind = rng.choice(["tool_use", "tool_result", "file_change", "command", "user_message", "assistant_message"])
            data.append((f"s{s}", q, kind, None, (rng.choice(["a", "b", "", None]) if kind.startswith("tool") else None,)))
    frame = spark.createDataFrame(data, "session_id string, seq long, kind string, agent_id string, tool struct<call_id:string>")
    a = {(r.session_id, r.seq): r.leader for r in grouping.atomic_groups(frame).collect()}
    b = {(r.session_id, r.seq): r.leader for r in grouping.interleaved_groups(frame).collect()}
    assert a == b


def test_fold_keeps_streams_apart():
    use, res = ("tool_use", "m", "c"), ("tool_result", "m", "c")
    other = ("tool_use", "n", "d")
    assert grouping.fold_groups([use, other, ("file_change", "n", ""), res, ("command", "m", ""), ("user_message", "m", "")]) == [0, 1, 1, 0, 0, 5]
    assert grouping.fold_groups([use, ("user_message", "m", ""), ("tool_use", "m", "e")]) == [0, 0, 2]


def test_one_after_the_other_like_the_fold():
    rng = random.Random(8)
    for _ in range(3000):
        rows = [(rng.choice(["tool_use", "tool_result", "file_change", "command", "user_message"]), rng.choice("mno"), rng.choice(["a", "b", ""])) for _ in range(rng.randrange(1, 14))]
        groups = grouping.Groups()
        assert [groups.leader(i, *r) for i, r in enumerate(rows)] == grouping.fold_groups(rows)


def test_next_fit(spark):
    got = spark.sql("select array(40L, 50L, 120L, 30L, 30L, 60L) as s").select(grouping.next_fit(grouping.F.col("s"), 100)).first()[0]
    assert got == [0, 0, 1, 2, 2, 3]


def test_time_links_all_or_none(spark):
    streams = spark.createDataFrame([("s", "a1", "5"), ("s", "a2", "2"), ("t", "b", "1")], "session_id string, agent_id string, ts string")
    calls = spark.createDataFrame([("s", "c1", "1"), ("s", "c2", "3"), ("t", "d", "2")], "session_id string, call_id string, ts string")
    assert {(r.agent_id, r.call_id) for r in links.timed_links(streams, calls).collect()} == {("a2", "c1"), ("a1", "c2")}


def test_stripped_trees(spark):
    import json

    image = {"type": "image", "source": {"media_type": "image/png", "data": "A" * 2000}}
    file = {"type": "file", "mime": "image/png", "url": "data:image/png;base64," + "B" * 2000}
    strip = lambda doc, **more: Stripper("p:1", **more).run(json.loads(json.dumps(doc)))
    assert strip({"a": ["A" * 2000, image]}, most=5000)["a"][0] == "[BASE64: 2000 bytes, source: p:1]"
    assert strip({"a": image, "f": [file]}, most=50, keep_images=True) == {"a": image, "f": [file]} and strip(image)["source"]["data"].startswith("[BASE64: 2000")
    assert strip("xy z", most=2) == "xy... [TRUNCATED at 4 bytes, source: p:1]" and strip([1, None, {"k": True}]) == [1, None, {"k": True}]
    deep = json.loads("[" * 400 + '"' + "é" * 9 + '"' + "]" * 400)
    assert json.dumps(strip(deep, most=5)).count("TRUNCATED at 9 bytes") == 1
    # a base64 string beyond LONG gives way although the line is shorter than the cap, as only the string's length counts
    rows = [(1, json.dumps({"a": "A" * (LONG + 1)}), "p", 1), (2, json.dumps({"a": "A" * LONG}), "p", 2), (3, "{broken " + "A" * 2000, "p", 3), (4, None, "p", 4), (5, "", None, None)]
    got = {r.event_id: r for r in strip_json(spark.createDataFrame(rows, "event_id long, json string, source_path string, source_line int")).collect()}
    assert json.loads(got[1].json) == {"a": f"[BASE64: {LONG + 1} bytes, source: p:1]"} and len(got[1].markers) == 1
    assert {i: got[i].json for i in (2, 3, 4, 5)} == {i: rows[i - 1][1] for i in (2, 3, 4, 5)} and not any(got[i].markers for i in (2, 3, 4, 5))


def test_svg(spark):
    texts = ["<?xml v?> <svg/>", "<svg><script>", "<svg onload = 1>", "<svg><a href=' javascript:x'>", "<b>", None]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(report.safe_svg("s")).collect()]
    assert out[:5] == ["<svg/>", "", "", "", ""]


def test_entry(spark):
    import __spark_entry__ as e

    frame = e.entry(spark)
    assert frame.columns == ["src_table", "row_key", "utc_micros"] and frame.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_scans_do_not_depend_on_blocks(spark, monkeypatch, block):
    from tracemill.operators import events

    monkeypatch.setattr(events, "BLOCK", block)
    rng = random.Random(6)
    data = [(i, f"s{rng.randrange(3)}", q, rng.choice(["user_message", "meta"]), rng.choice([None, "a"]), rng.choice(["t", " ", None]), rng.choice(["", None, f"2026-01-0{q % 9 + 1}"]), f"/p{rng.randrange(2)}") for i, q in enumerate(rng.sample(range(200), 80))]
    frame = spark.createDataFrame(data, "event_id long, session_id string, seq long, kind string, agent_id string, text string, ts string, source_path string")
    turns, last, first, want_ts, want = {}, {}, {}, {}, {}
    for e, s, q, k, a, t, ts, _ in sorted(data, key=lambda r: (r[1], r[2])):
        turns[s, a] = turns.get((s, a), 0) + (k == "user_message" and t == "t")
        want[e] = turns[s, a]
        last[s, a] = ts or last.get((s, a))
        first.setdefault((s, a), None)
        first[s, a] = first[s, a] or ts
        want_ts[e] = (last[s, a], (s, a))
    assert {r.event_id: r.turn for r in events.turn_index(frame).collect()} == want
    assert {r.event_id: r.carried_ts for r in events.carry_ts(frame).collect()} == {e: v or first[k] or "" for e, (v, k) in want_ts.items()}
    begin = {s: (min((r[6] for r in data if r[1] == s and r[6]), default="9999"), min(r[7] for r in data if r[1] == s), s) for s in {r[1] for r in data}}
    order = [r[0] for r in sorted(data, key=lambda r: (begin[r[1]], r[2]))]
    assert {r.event_id: r.global_seq for r in events.resequence(frame).collect()} == {e: i for i, e in enumerate(order, 1)}
