from tracemill.operators import checks, gate, summaries
from tracemill.sources import jsonl

STEP = "report string, step_no long, title string, takeaway string, intent string, claims array<struct<text:string,confidence:string,n_refs:int>>, decisions array<struct<decision:string,rationale:string,alternatives:array<string>>>, errors array<struct<error:string,resolution:string>>, has_diagram boolean, has_video boolean, has_files boolean, has_evidence boolean"
GROUNDED = [("c" * 100, " Grounded", 1)]


def test_height_of_steps_and_overviews(spark):
    rows = [
        ("r", 1, "t" * 10, "a" * 20, None, GROUNDED, [("d" * 100, None, ["x" * 100, ""])], [("e" * 50, "f" * 50)], True, True, True, True),
        ("r", 2, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.step_no: (r.a, r.b) for r in spark.createDataFrame(rows, STEP).select("step_no", gate.step_height().alias("a"), gate.step_height(video=False).alias("b")).collect()}
    want = 300 + 10 + 9 + 16 + 34 + 110 + 34 + 10 + 34 + 10 + 110 + 34 + 560 + 90 + 60
    assert abs(got[1][1] - want) < 1e-6 and abs(got[1][0] - want - 480) < 1e-6 and got[2] == (300, 300)
    shape = "goal string, summary array<string>, end_goal string, end_summary array<string>"
    over = [("g" * 10, ["s" * 100], None, None), ("g" * 10, [], "g" * 200, ["s"]), (None, None, "", [])]
    assert [round(r[0], 6) for r in spark.createDataFrame(over, shape).select(gate.overview_height()).collect()] == [260 + 22 + 12 + 45, 260 + 260 + 12.45, 260]


def test_faults_and_gate(spark):
    steps = [
        ("good", 1, "Add the cache", "Reads are twice as fast", "why", GROUNDED, None, None, None, None, None, None), ("bad", 1, "chunk-001 of it", "n/a", "12 events", None, None, None, None, None, None, None),
        ("bad", 2, "Same.", "Same", "# AGENTS", [("x", "grounded", 0), ("y", "inferred", 2)], None, None, None, None, None, None), ("bad", 3, "", "Same", None, GROUNDED, None, None, None, True, None, None), ("bad", 4, "z" * 2000, "", None, GROUNDED, None, None, None, True, None, None),
    ]
    reports = [("good", "A goal", ["a", "b", "c"], ["src/a.py"], "end", None), ("bad", "3 events", ["chunk-1", "b", "c"], ["/tmp/x"], None, []), ("none", None, None, None, None, ["s"])]
    frame, listed = spark.createDataFrame(steps, STEP), spark.createDataFrame(reports, "report string, goal string, summary array<string>, key_files array<string>, end_goal string, end_summary array<string>")
    faults = gate.report_faults(listed, frame)
    said = {(r.report, r.step_no, r.fault) for r in faults.collect()}
    assert {f for f in said if f[0] == "bad"} == {("bad", *x) for x in [
        (1, "raw_title"), (1, "generic_takeaway"), (1, "raw_intent"), (1, "not_grounded"), (2, "takeaway_is_title"), (2, "control_intent"), (2, "not_grounded"), (3, "no_title"), (4, "no_takeaway"), (4, "too_tall"), (4, "video_and_prose"),
        (None, "raw_goal"), (None, "raw_bullet"), (None, "noisy_key_file"), (None, "same_takeaways"), (None, "no_end_state"),
    ]}
    assert {f for f in said if f[0] == "none"} == {("none", None, "no_goal"), ("none", None, "no_steps"), ("none", None, "few_bullets")} and not any(f[0] == "good" for f in said)
    assert {r.report: r.ok for r in gate.gate(listed, faults).collect()} == {"good": True, "bad": False, "none": False}
    assert {r.report: r.examples for r in gate.examples(frame, "report", "title", "step_no").collect()}["bad"] == "chunk-001 of it, Same., , ..."
    assert gate.report_faults(listed.limit(0), frame.limit(0)).count() == 0


def test_media_and_glossary(spark):
    nodes = [("r", "overview", "d.png", "v.js", "main", "m.mp4", "p.png", True), ("r", "step 1", None, "https://x/v.js", "a", "https://x/m.mp4", None, False), ("r", "step 2", "gone.png", "v.js", None, None, None, None), ("s", "overview", None, None, None, "lost.mp4", None, None)]
    frame = spark.createDataFrame(nodes, "report string, label string, diagram string, live_script string, live_view string, video string, poster string, embed boolean")
    files = spark.createDataFrame([("d.png", 1), ("v.js", 1), ("m.mp4", 16 << 20), ("m.mp4", 16 << 20)], "path string, size_bytes long")
    reports = spark.createDataFrame([("r", 3), ("s", None)], "report string, n_terms long")
    assert {tuple(r) for r in gate.media_faults(reports, frame, files).collect()} == {
        ("r", "overview", "video_too_large_to_embed"), ("r", "overview", "poster_not_found"), ("r", "step 1", "live_is_remote"), ("r", "step 2", "live_needs_script_and_view"), ("s", "overview", "video_not_found"), ("s", "report", "no_glossary"), ("s", "report", "no_diagram"),
    }
    docs = spark.createDataFrame([("l", '[{"term":"a","definition":"x"}, 5, {"definition":"y"}]'), ("m", '{"b":"z","c":{"definition":"w"},"d":7}'), ("t", '"text"')], "report string, j string").selectExpr("report", "parse_json(j) as doc")
    assert {(r.report, r.term, r.definition) for r in gate.glossary_entries(docs).collect()} == {("l", "a", "x"), ("l", None, "y"), ("m", "b", "z"), ("m", "c", "w")}
    texts = spark.createDataFrame([(1, "A Cache", None), (2, None, "cached"), (3, "x", "y")], "i int, a string, b string")
    assert [r.i for r in gate.search(texts, " cache", "a", "b").collect()] == [1, 2] and gate.search(texts, " ", "a").count() == 3


def test_manifest_checks_see_what_is_wrong(spark):
    import hashlib

    text = ["a\n", "bé\n"]
    rows = spark.createDataFrame([("s", "c1", i, t, "tool_result" if i else "tool_use", (f"x{i}",)) for i, t in enumerate(text)], "session_id string, chunk_id string, place int, line string, kind string, tool struct<call_id:string>")
    good = ("s", "c1", 1, 2, 2, len("".join(text).encode()), hashlib.sha256("".join(text).encode()).hexdigest())
    shape = "session_id string, chunk_id string, line_start int, line_end int, event_count long, byte_size long, sha256 string"
    bad = lambda *chunks: {r.check: r.n_bad for r in checks.chunked(spark.createDataFrame(list(chunks), shape), rows).collect() if not r.passed}
    assert bad(good) == {"split_pair": 1}
    assert bad((*good[:4], 3, 9, "0" * 64), ("s", "c2", 5, 4, 1, 1, None)) == {"split_pair": 1, "wrong_count": 1, "wrong_size": 1, "wrong_hash": 1, "missing_hash": 1, "bad_range": 1, "no_rows": 1}
    assert {r.check: r.n_bad for r in checks.chunked(spark.createDataFrame([], shape), rows.limit(0)).collect() if r.n_bad} == {"empty_input": 1}


def test_seqs_rise_in_blocks(spark):
    rows = [("p", i, i) for i in range(1, 10_000)] + [("q", 1, 5), ("q", 2, 5), ("q", 5000, 4), ("q", 5001, 9)]
    assert checks.repeated_or_falling(spark.createDataFrame(rows, "source_path string, source_line int, seq long")).first().n_bad == 2


def test_captures_providers_and_cards(spark):
    shots = spark.createDataFrame([(3, "b", "/x", "1.png", None), (1, "a", "/y", "2.png", None), (2, "b", "/z", "3.png", None), (4, "b", "/bad", None, "http_status_404")], "place int, commit string, route string, path string, skip string")
    r = jsonl.captures(shots).first()
    assert r.order == ["a", "b"] and [(s.route, s.path) for s in r.commits["b"]] == [("/z", "3.png"), ("/x", "1.png")] and [(s.route, s.reason) for s in r.skipped] == [("/bad", "http_status_404")]
    chunks = spark.createDataFrame([("s", "c2", 9, 12), ("s", "c1", 1, 8), ("t", "c1", 1, 2)], "session_id string, chunk_id string, line_start int, line_end int")
    events = spark.createDataFrame([("s", "codex", 3, 3), ("s", "claude", 2, 2), ("s", "opencode", 10, 1)], "session_id string, provider string, source_line int, seq long")
    assert {tuple(x) for x in summaries.providers(chunks, events).collect()} == {("s", "claude"), ("t", "unknown")}
    card = lambda *names: spark.createDataFrame([(n, 1) for n in names], "session_id string, events int")
    assert [x.session_id for x in summaries.merged_cards(card("b", None), card("a")).collect()] == ["a", "b"]
