import random
from collections import Counter

import pytest

from tracemill.operators import hierarchy as H


def expected(links):
    parent = {}
    for n, p in links:
        if n is not None:
            parent[n] = max((x for x in (parent.get(n), p) if x is not None), default=None)
    out, sizes = {}, Counter()
    for n in parent:
        path, x = [], n
        while x is not None and x not in path:
            path.append(x)
            x = parent[x] if parent[x] in parent else None
        if x is not None:
            out[n] = ("", -1, None)
        else:
            out[n] = (path[-1], len(path) - 1, path[::-1])
            sizes.update(path)
    return out, sizes


def check(spark, links):
    frame = spark.createDataFrame(links, "node string, parent string")
    want, sizes = expected(links)
    resolved = H.resolve(frame)
    rows = resolved.collect()
    assert {r.node: (r.root, r.depth, r.path) for r in rows} == want and len(rows) == len(want)
    assert {r.node: r.size for r in rows if r.size is not None} == dict(sizes)
    plain = H.resolve(frame, sizes=False, paths=False).collect()
    assert {r.node: (r.root, r.depth) for r in plain} == {n: w[:2] for n, w in want.items()} and all(r.path is None and r.size is None for r in plain)
    pairs = {(r.ancestor, r.node, r.distance) for r in H.descendants(resolved).collect()}
    assert pairs == {(a, n, len(p) - 1 - i) for n, (_, _, p) in want.items() if p for i, a in enumerate(p[:-1])}


def test_chain_star_cycle_and_dirt(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)]
    star = [("hub", None)] + [(f"leaf{i}", "hub") for i in range(50)]
    loops = [("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("lower", "below"), ("self", "self"), ("a", "b"), ("b", "a")]
    dirt = [(None, "c1"), ("gone", "nowhere"), ("twice", None), ("twice", "c3"), ("twice", "c3")]
    check(spark, chain + star + loops + dirt)


@pytest.mark.parametrize("seed", [1])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    check(spark, [(f"n{i}", f"n{rng.randrange(0, 120)}" if rng.random() < 0.9 else None) for i in range(120)])


def test_empty(spark):
    assert H.resolve(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_links_from_tables(spark):
    sessions = spark.createDataFrame([(1, "S1", None, "2026-01-01"), (2, "s2", " opencode://session/s1 ", "2026-01-01"), (3, "s2", "gone", "2025-01-01"), (4, "s3", "S2", "2026-01-01"), (5, None, "s1", None)], "session_row long, session_id string, parent_session_id string, discovered_at string")
    assert {(r.node, r.parent) for r in H.session_links(sessions).collect()} == {("S1", None), ("s2", "S1"), ("s3", "s2")}
    events = spark.createDataFrame([("s", None, None, " Tool_Use", ("c1",)), ("s", "a", "c1", "meta", None), ("s", "a", None, "tool_use", ("c2",)), ("s", "b", "c2", "x", None), ("s", "d", "c9", "x", None), ("s", "e", None, "x", None)], "session_id string, agent_id string, parent_call_id string, kind string, tool struct<call_id:string>")
    assert {(r.node, r.parent) for r in H.stream_links(events).collect()} == {("s::agent:a", "s"), ("s::agent:b", "s::agent:a"), ("s::agent:d", None), ("s::agent:e", None)}
