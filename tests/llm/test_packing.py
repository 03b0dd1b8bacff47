import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packs_every_item_once_within_capacity(sizes):
    sets = P.pack(sizes, 100)
    assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and all(0 < sum(sizes[i] for i in s) <= 100 for s in sets)
    assert len(sets) <= 2 * (-(-sum(sizes) // 100)) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(1, 70))
def test_fullest_is_the_best_of_all_subsets(sizes, capacity):
    sums = [0]
    for s in sizes:
        sums += [x + s for x in sums]
    chosen = P.fullest(sizes, capacity)
    assert len(set(chosen)) == len(chosen) and sum(sizes[i] for i in chosen) == max(x for x in sums if x <= capacity)


def best_fit_decreasing(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        best = max((x for x in range(len(bins)) if bins[x] + s <= capacity), key=lambda x: bins[x], default=None)
        if best is None:
            bins.append(s)
        else:
            bins[best] += s
    return len(bins)


@pytest.mark.parametrize("low,high,n", [(300, 1500, 400), (300, 1500, 256), (20, 600, 256), (500, 1100, 256), (50, 2047, 256), (600, 700, 100), (1000, 1100, 60)])
def test_no_more_containers_than_best_fit_decreasing(low, high, n):
    rng = random.Random(low + high)
    sizes = [rng.randint(low, high) for _ in range(n)]
    assert len(P.pack(sizes)) <= best_fit_decreasing(sizes, P.CAPACITY)


def test_fill_is_high():
    rng = random.Random(1)
    sizes = [min(2047, int(rng.lognormvariate(6, 0.6)) + 20) for _ in range(500)]
    assert sum(sizes) / 2048 / len(P.pack(sizes, 2048)) > 0.98


def test_near_equal_parts():
    parts = [sum(s) for s in ([[5, 5, 4, 3, 3][i] for i in x] for x in P.difference([5, 5, 4, 3, 3], 2))]
    assert sorted(parts) == [10, 10] or max(parts) - min(parts) <= 2


def texts():
    return [(i, "alpha beta gamma delta " * (3 + i % 40)) for i in range(200)] + [(900, "word " * 5000), (901, None), (902, ""), (903, " "), *[(7, "alpha beta")] * 5, (None, "x y z"), (None, "x y z")]


def test_tables(spark):
    frame = spark.createDataFrame([(*t, "clash") for t in texts()], "doc_id long, text string, tokens string")
    rows = P.containers(frame, window=64).collect()
    assert all(0 < r.tokens <= 2048 and r.tokens == sum(r.item_tokens) for r in rows) and len({r.container for r in rows}) == len(rows)
    items = [(d, f) for r in rows for d, f in zip(r.doc_ids, r.first_tokens)]
    whole = P.encoder(P.TOKENIZER)
    assert sum(r.tokens for r in rows) == sum(len(whole.encode_ordinary(t)) for _, t in texts() if t)
    assert {d for d, _ in items} == {*range(200), 900, 903, None} and sum(d == 7 for d, _ in items) == 6 and sum(d is None for d, _ in items) == 2 and sum(d == 900 for d, _ in items) > 1
    assert P.containers(frame.limit(0)).count() == 0


def test_containers_do_not_depend_on_partitions(spark):
    frame = spark.createDataFrame(texts(), "doc_id long, text string")
    packed = lambda df: {tuple(map(str, r)) for r in P.containers(df, window=64).collect()}
    want = packed(frame)
    for n in (1, 7, 50):
        assert packed(frame.repartition(n)) == want
    assert packed(frame.orderBy("text")) == want
