from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import splitting as S


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n#é漢😀-", max_size=600), st.integers(12, 90), st.integers(0, 30))
def test_pieces_are_the_text(text, limit, overlap):
    pieces = S.split(text, limit, overlap)
    assert "".join(text[a:b] for _, a, b in pieces) == text
    for (o, a, b), before in zip(pieces, [None, *pieces]):
        assert len(text[o:b].encode()) <= limit and o <= a < b
        assert len(text[o:a].encode()) <= overlap and (before is None or o >= before[1])


def test_natural_boundaries():
    text = "# One\n" + "word " * 10 + "\n\n# Two\nSentence one is here. Sentence two is here.\n"
    cut = [text[a:b] for _, a, b in S.split(text, 70, 0)]
    assert cut[1].startswith("# Two") and S.split("x" * 10, 10) == [(0, 0, 10)] and S.split(None, 10) == []


def test_tables(spark):
    big, mid = "word " * 900, "line of text. " * 300
    rows = [(1, "s", None, 1, 1, big), (2, "s", None, 1, 1, big), (3, "s", None, 1, 2, mid), (4, "s", None, 1, 3, mid), (5, "s", "a", 1, 4, "x"), (6, "s", None, None, 5, big), (7, None, None, 1, 1, big), (8, "s", None, 2, 9, None)]
    events = spark.createDataFrame(rows, "event_id long, session_id string, agent_id string, turn_index int, seq long, text string")
    one = S.split_events(events).orderBy("seq", "piece").collect()
    assert {(r.session_id, r.agent_id, r.turn_index, r.seq) for r in one} == {("s", "", 1, 1), ("s", "", 1, 2), ("s", "", 1, 3), ("s", "", -1, 5)} and all(r.piece_bytes <= 4000 for r in one)
    turns = S.split_turns(events).orderBy("piece").collect()
    assert {(r.session_id, r.turn_index) for r in turns} == {("s", 1)} and len(turns) == 2 and all(r.piece_bytes <= 12_000 for r in turns) and turns[1].overlap_bytes > 150
    assert S.split_turns(events.limit(0)).count() == 0 and S.split_events(events.limit(0)).count() == 0


def brute(texts, limit, overlap, run_bytes):
    """The same rule event by event, for one turn in one list."""
    runs, before = {}, 0
    for t in texts:
        runs.setdefault(before // run_bytes, []).append(t)
        before += len(t.encode())
    out, tail = [], ""
    for n, run in enumerate(runs[r] for r in sorted(runs)):
        whole = ("\n\n" if n else "") + "\n\n".join(run)
        pieces = S.split(whole, limit, overlap, overlap if n else 0)
        out += [(tail if i == 0 else whole[o:a], whole[a:b]) for i, (o, a, b) in enumerate(pieces)]
        tail = whole[S._tail(whole, *pieces[-1][1:], overlap) :]
    return out


def test_huge_turns_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_BYTES", 20_000)
    monkeypatch.setattr(S, "BLOCK_SEQS", 8)
    texts = [f"event {i} " + ("wörd " * 300 if i % 3 else "ok") for i in range(60)] + ["x" * 45_000]
    events = spark.createDataFrame([(i, "s", None, 1, i, t) for i, t in enumerate(texts)] + [(900, "s", None, 1, 3, "again")], "event_id long, session_id string, agent_id string, turn_index int, seq long, text string")
    rows = S.split_turns(events).orderBy("piece").collect()
    want = brute(texts, 12_000, 200, 20_000)
    assert [(r.piece_text.encode()[: r.overlap_bytes].decode(), r.piece_text.encode()[r.overlap_bytes :].decode()) for r in rows] == want
    assert [r.piece for r in rows] == list(range(len(want))) and {r.n_pieces for r in rows} == {len(want)} and all(r.piece_bytes == len(r.piece_text.encode()) <= 12_000 for r in rows)
    assert "".join(body for _, body in want) == "\n\n".join(texts) and sum(r.overlap_bytes == 0 for r in rows) == 1
