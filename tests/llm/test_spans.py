import random

import pytest

from tracemill.llm import spans as S


def brute(docs, span):
    owners = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            owners.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in docs:
        if d is not None:
            covered = {x for i in range(len(t or "") - span + 1) if len(owners[t[i : i + span]] - {None}) > 1 for x in range(i, i + span)}
            out[d] = out.get(d, set()) | covered
    return {d: len(c) for d, c in out.items() if c}


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_like_brute_force(spark, hot):
    rng = random.Random(hot)
    word = lambda: "".join(rng.choices("abcdefgé漢😀 ", k=rng.randrange(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(rng.randrange(60, 200)) for _ in range(6)]
    docs = []
    for d in range(50):
        parts = [text(rng.randrange(5, 120))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            parts += [s[a : a + rng.choice([150, 299, 300, 301, 450, len(s)])], text(rng.randrange(0, 40))]
        docs.append((d, "".join(parts)))
    docs += [(60, docs[3][1]), (61, "=" * 700), (62, "-" + "=" * 500), (63, "ab" * 400), (64, shared[0][:100] + shared[0][:100]), (65, None), (66, ""), (67, "x" * 299)]
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, start string")
    got = {r.doc_id: r.n for r in S.shared_spans(frame, hot=hot).groupBy("doc_id").agg(S.F.sum(S.F.col("end") - S.F.col("start")).alias("n")).collect()}
    assert got == brute(docs, 300)


def test_repeats_within_a_document_and_equal_ids(spark):
    rng = random.Random(9)
    a = "".join(rng.choices("abcdefghij ", k=400))
    frame = spark.createDataFrame([(1, a + "|" + a), (2, None), (3, a[:200]), (4, a[:310]), (4, a[:310]), (None, a)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in S.shared_spans(frame).groupBy("doc_id").agg(S.F.sum(S.F.col("end") - S.F.col("start")).alias("n")).collect()}
    assert got == {1: 620, 4: 310}
    assert S.shared_spans(frame.limit(0)).count() == 0


def test_chunks_do_not_shift(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghij ", k=3000))
    texts = [text, "inserted " + text, "short", "", text[:301]]
    which, keys, starts, ends = S.chunk_pairs(texts)
    of = lambda i: [(int(k), int(a), int(b)) for t, k, a, b in zip(which, keys, starts, ends) if t == i]
    w = S.near(300)
    late = lambda rows, n: {(k, a - n, b - n) for k, a, b in rows if a > 2 * w + n}
    assert late(of(0), 0) == late(of(1), 9) and max(b - a for _, a, b in of(0)) <= 2 * w and not of(2) and not of(3)
    # one by one as together, and the first 301 characters have a pair that the whole text has too
    assert all(of(i) == [(int(k), int(a), int(b)) for _, k, a, b in zip(*S.chunk_pairs([t]))] for i, t in enumerate(texts)) and set(of(4)) & set(of(0))
    monkeypatch.setattr(S, "SLICE", 10)
    assert S.slices(["aaaa", "b" * 20, "c", ""]) == [(0, 2), (2, 4)] and S.slices([]) == []


def test_a_group_is_bounded_and_rows_of_one_id_stay_apart(spark):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghij ", k=60_000))
    rows = [(1, text), *((d, text[a : a + 900]) for d, a in enumerate(range(0, 59_000, 700), 2)), (500, "x" + text[100:700]), (500, "y" + text[30_000:30_600]), (500, "z" * 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", S.F.hash("text"))
    groups = S.carved(frame, S.marked(frame), 1000, 300).groupBy("least", "reach").agg(S.F.sum(S.F.length("part")).alias("n")).collect()
    assert len(groups) > 5 and max(g.n for g in groups) < 6 * S.REACH
    got = {r.doc_id: r.n for r in S.shared_spans(frame).groupBy("doc_id").agg(S.F.sum(S.F.col("end") - S.F.col("start")).alias("n")).collect()}
    assert got == brute(rows, 300)
