import random

from tracemill.llm import conversations as C

COLS = "event_id long, session_id string, source_path string, seq long, kind string, turn_index int, agent_id string, parent_call_id string, text string, tool struct<call_id:string>"


def events(spark, rows):
    return spark.createDataFrame([(i, s, f"/{s}", q, k, t, a, None, x, None) for i, (s, q, k, t, a, x) in enumerate(rows)], COLS)


U, A = "user_message", "assistant_message"
ROWS = [
    ("good", 1, " User_Message", 1, None, "q"), ("good", 2, A, 1, None, "a"), ("good", 2, A, 1, None, "a"), ("good", 3, U, 2, None, "q"), ("good", 5, A, 2, None, "a"), ("good", 4, A, 9, "sub", "x"),
    ("empty", 1, "meta", 0, None, "m"), ("empty", 2, U, 1, None, " \n "), ("empty", 3, A, 1, None, None),
    ("opening", 1, A, 1, None, "a"), ("opening", 2, U, 1, None, "q"),
    ("regress", 1, U, 1, None, "q"), ("regress", 2, A, 2, None, "a"), ("regress", 3, A, 1, None, "a"), ("regress", 4, U, 2, None, "q"),
    ("gap", 1, U, 1, None, "q"), ("gap", 2, A, 1, None, "a"), ("gap", 3, U, 3, None, "q"), ("gap", 4, A, 3, None, "a"),
    ("unanswered", 1, U, 1, None, "q"), ("unanswered", 2, A, 1, None, "a"), ("unanswered", 3, U, 2, None, "q"),
]
WANT = {("empty", "empty"), ("opening", "no_opening"), ("regress", "turn_regress"), ("gap", "turn_gap"), ("unanswered", "missing_reply")}


def test_reasons_in_blocks_of_any_size(spark, monkeypatch):
    frame = events(spark, ROWS)
    for block in (4096, 2, 1):
        monkeypatch.setattr(C, "BLOCK", block)
        assert {tuple(r) for r in C.validate(frame).collect()} == WANT
        kept = C.conversations(frame).orderBy("position").collect()
        assert [(r.session_id, r.position, r.speaker, r.text) for r in kept] == [("good", 1, "user", "q"), ("good", 2, "assistant", "a"), ("good", 3, "user", "q"), ("good", 4, "assistant", "a")]
    assert C.validate(frame.limit(0)).count() == 0


def test_rows_without_identifier_are_joined(spark):
    asked = "Why does the importer drop the last row of each file?"
    rows = [
        (1, None, "/f", 1, U, 1, None, None, asked, None), (2, " ", "/f", 2, A, 1, None, None, f"> {asked}\nBecause of the trailing newline.", ("c",)), (3, None, "/g", 3, U, 2, None, "c", "q", None),
        (4, None, "/h", 1, A, 1, None, None, f"> > {asked}\r\nsee there", None), (5, "s", "/s", 1, "meta", 0, None, None, None, None), (6, None, "/f", 1, U, 1, None, None, "ok", None), (7, None, "/f", 2, A, 1, None, None, "> ok\nyes", None), (8, None, None, 3, A, 1, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, COLS)
    assert {(r.event_id, r.session_id) for r in C.identify(frame).collect()} == {*((i, "unnamed:1") for i in (1, 2, 3, 4)), (5, "s"), *((i, f"unnamed:{i}") for i in (6, 7, 8))}
    reasons = {tuple(r) for r in C.validate(frame).collect()}
    assert ("unnamed:1", "missing_reply") in reasons and ("unnamed:7", "no_opening") in reasons and ("s", "empty") in reasons and ("unnamed:6", "missing_reply") in reasons


def test_components_like_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 360)] + [(None, 1), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
