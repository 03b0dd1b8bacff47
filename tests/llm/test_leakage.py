from tracemill.llm import leakage as L

CLOSE = "Answer with the name of one file only and do not add anything else to it."
OWN = "Given lib/a_b.py, name whichever helper besides foo_bar could have produced a nullable epoch like moveFrame. In tests/x.tsx a reviewer notices that sort_broker was invoked 53 times."
ITEMS = [(1, OWN + " " + CLOSE, "53")] + [(i, f"Unlike number {i} the widget of store {i} reads {i} rows from shelf {i} and {i} more later on. " + CLOSE, str(i)) for i in range(2, 16)] + [(20, "too short", "x"), (21, None, None)]


def test_spans_survive_mess_and_shorter_ones_do_not_count(spark):
    words = L.words(OWN)
    mess = OWN.upper().replace(" ", "&nbsp;\n * ").replace("NULLABLE", "n​ull­able").replace("REVIEWER", "ｒｅｖｉｅｗｅｒ")
    docs = [(1, f"x {OWN} y"), (2, "pre " + mess), (3, " ".join(words[3:15])), (4, " ".join(words[3:14])), (5, CLOSE), (6, None), (7, ""), (8, "pad " * 50_000 + " ".join(words[:12])), (9, " ".join(words[:11] + ["other"] + words[11:20])), (1, "nothing")]
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string, answer string")
    rows = {(r.doc_id, r.item_id): r for r in L.leaked(frame, items).collect()}
    assert set(rows) == {(1, 1), (2, 1), (3, 1), (8, 1)} and rows[1, 1].shared_words == len(words) and rows[1, 1].answer_words == 1 and rows[3, 1].shared_words == 12
    assert L.leaked(frame.limit(0), items).count() == 0 and L.leaked(frame, items.limit(0)).count() == 0


def test_parts_and_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(L, "PART", 5)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30)), "a") for i in range(12)]
    docs = []
    for d in range(60):
        text = rng.choices(vocabulary, k=80)
        own = items[rng.randrange(12)][1].split()
        a, n = rng.randrange(10), rng.randrange(8, 18)
        text[20 : 20 + n] = own[a : a + n]
        docs.append((d, " ".join(text)))
    want = set()
    for d, text in docs:
        grams = {tuple(text.split()[i : i + 12]) for i in range(69)}
        want |= {(d, k) for k, t, _ in items if any(tuple(t.split()[i : i + 12]) in grams for i in range(19))}
    got = {(r.doc_id, r.item_id) for r in L.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string")).collect()}
    assert got == want and len(want) > 20
