import json

from tracemill.operators import documents as D


def test_media_and_steps(spark):
    media = spark.createDataFrame([("m1", "/s", 3, None, None), ("m2", None, None, "/p", 4), ("m3", "/s", 9, "/p", 4), ("m4", "/s", 5, "/p", 4)], "media_id string, session_path string, line_start int, source_path string, source_line int")
    shots = spark.createDataFrame([("/s", 3, 1, "old"), ("/s", 3, 2, "new"), ("/p", 4, 1, "P"), ("/s", 5, 1, "")], "source_path string, source_line int, seq int, data_b64 string")
    assert {r.media_id: r.data_b64 for r in D.resolve_media(media, shots).collect()} == {"m1": "new", "m2": "P", "m3": "P", "m4": None}
    steps = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "report string, step_id string, step_no int")
    refs = spark.createDataFrame([("r", 1, 1, "b"), ("r", 1, 2, "b"), ("r", 1, 3, "zz"), ("r", 2, 1, "a")], "report string, item_no int, ref_no int, step_id string")
    assert {(r.item_no, r.step_label) for r in D.resolve_steps(refs, steps).collect()} == {(1, "Step 2"), (2, "Step 1")}


def test_undeclared(spark):
    refs = spark.createDataFrame([("r", "/x/a.jsonl"), ("r", "/y/b.jsonl"), ("r", "c.jsonl"), ("q", "any")], "report string, path string")
    sessions = spark.createDataFrame([("r", "/z/a.jsonl"), ("r", "/w/c.jsonl")], "report string, path string")
    assert [r.path for r in D.undeclared(refs, sessions).collect()] == ["/y/b.jsonl"]


def test_captures_and_bridge(spark):
    shots = spark.createDataFrame([("/login", "aaa", "1.png", 1), ("/login", "bbb", "2.png", 2), ("/", "aaa", "3.png", 1), ("/dup", "aaa", "1.png", 9)], "route string, commit string, path string, place int")
    matched = spark.createDataFrame([("/login", 2), ("/", 1), ("/dup", 2)], "route string, step_no int")
    got = {(r.step_no, r.media_id, r.caption, r.role) for r in D.attach_captures(shots, matched, spark.createDataFrame([(1, "x.png"), (2, "2.png")], "step_no int, path string")).collect()}
    assert got == {(1, "capture-root-aaa-1", "/ (aaa)", "standalone"), (2, "capture-login-aaa-1", "/login before (aaa)", "before")}
    old = spark.createDataFrame([("s", 0, "", None, "ctx", None, ["r1"]), (None, 1, "own", "cap", None, "r0", None)], "step_id string, idx int, id string, caption string, context string, source_ref string, source_refs array<string>")
    assert [(r.media_id, r.caption, r.source_ref) for r in D.bridge_screenshots(old).orderBy("idx").collect()] == [("s-ss-1", "ctx", "r1"), ("own", "cap", "r0")]


def test_reasoning(spark):
    items = ["plain \n text", {"text": "t", "detail": "d"}, {"decision": "x"}, {"no": 1}, " "]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i int, j string").selectExpr("i", "parse_json(j) as item")
    assert [(r.text, r.detail) for r in D.reasoning(rows).orderBy("i").collect()] == [("plain text", None), ("t", "d"), ("x", None)]


def test_glossary_and_links(spark):
    entries = spark.createDataFrame([("r", 1, "Token Bucket", "def", None, None), ("r", 2, "token bucket", "again", None, None), ("r", 3, "", "d", None, None), ("r", 4, "Ghost", "x" * 301, None, ["phantom"]), ("r", 5, "Alias", None, "exp", ["a-side"]), ("r", 6, "Nothing", "", None, None)], "report string, pos int, term string, definition string, expanded string, aliases array<string>")
    prose = spark.createDataFrame([("r", "The token  bucket; has an A-side. ghostly"), ("q", "ghost")], "report string, text string")
    assert {(r.term, r.fault) for r in D.glossary_faults(entries, prose).collect()} == {("token bucket", "duplicate"), ("", "incomplete"), ("Nothing", "incomplete"), ("Ghost", "long"), ("Ghost", "dead")}
    links = spark.createDataFrame([(1, "Foo", "/a", "mine"), (2, "FOO", "/a", ""), (3, "bar", "/a", None), (4, "x", "/z", None)], "link_id int, text string, path string, tooltip string")
    names = spark.createDataFrame([("foo", "/b", "by text"), ("q", "/a", "by path")], "name string, path string, definition string")
    assert {r.link_id: r.tooltip for r in D.tooltips(links, names).collect()} == {1: "mine", 2: "by text", 3: "by path", 4: None}
    spans = spark.createDataFrame([(1, 5, "src"), (1, 5, "src/a.py"), (1, 9, "b")], "text_id int, start int, token string")
    assert {r.token for r in D.longest_tokens(spans).collect()} == {"src/a.py", "b"}
    found = D.link_tokens(spark.createDataFrame([(1, "see src/a.py, or run make")], "text_id int, text string"), spark.createDataFrame([("src/a.py",), ("mak",)], "token string"))
    assert [r.token for r in found.collect()] == ["src/a.py"]
    modes = spark.createDataFrame([("both",), ("journey",), ("end-state",), (None,)], "mode string")
    assert D.visible(modes, "journey").count() == 3 and D.visible(modes, "end-state").count() == 3
    assert [r[0] for r in spark.createDataFrame([("a/b.py",), ("a/b",), ("Makefile",)], "p string").select(D.link_target("p")).collect()] == ["blob", "tree", "blob"]


def test_routes(spark):
    steps = spark.createDataFrame([(1, "sets up the base", "src/a", ""), (2, "adds the signin page", "src/auth.py", "make"), (3, "pays", "", "git show abc1234")], "step_no int, narrative string, files string, commands string")
    routes = spark.createDataFrame([("/", []), ("/login?x=1", []), ("/zzz", ["abc1234"]), ("/qqq", [None, ""]), ("/base", [])], "route string, commits array<string>")
    assert {r.route: r.step_no for r in D.match_routes(routes, steps).collect()} == {"/": 1, "/login?x=1": 2, "/zzz": 3, "/qqq": 3, "/base": 1}
