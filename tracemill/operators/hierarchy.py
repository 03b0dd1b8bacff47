"""Parent-child links of unknown depth to full hierarchies (problem 6).

Bottom-up leaf peeling: each round takes off the nodes without children and sends their subtree sizes to their parents.
As a chain would take a round per node, each round also splices out nodes with one child left, picked by a coin per node
and round so that no two neighbours go at once: the child then hangs on the grandparent by a longer link. So the rounds
grow with the logarithm of the nodes. What can't be taken off at last are nodes that hang on themselves: each
stands for a cycle. In reverse order of peeling every node gets root and depth from its parent, and its path where paths
are asked for; nodes that end in a cycle get none. All descendants of all nodes are the pairs of a path's nodes:
a list of them travels to no parent, as that of a root is the whole tree and would be one value in one task.

Defined results
* A parent that is null or not a node makes a root. A node listed twice with different parents keeps the
  greatest; null nodes are left out. Empty tables give empty tables.
* ``tree_depth`` is -1 and ``root_key`` empty where the chain of parents never ends, in and below a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.runtime import clean_kind, cut, table

AGENT = "::agent:"


def session_key(col: str):
    """A session id as references compare it: without letter case, surrounding blanks and a leading scheme."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""))), r"^opencode://session/", ""))


def session_links(sessions: DataFrame) -> DataFrame:
    """(node, parent) of the sessions; of a session listed twice the row discovered last holds."""
    newest = F.max_by("parent_session_id", F.struct(F.coalesce(F.col("discovered_at").cast("string"), F.lit("")), F.col("session_row")))
    rows = sessions.where("session_id is not null").groupBy("session_id").agg(newest.alias("parent_session_id"))
    ids = rows.groupBy(session_key("session_id").alias("ref")).agg(F.min("session_id").alias("parent"))
    wanted = rows.select("session_id", session_key("parent_session_id").alias("ref"))
    return wanted.join(ids, "ref", "left").select(F.col("session_id").alias("node"), "parent")


def stream_links(events: DataFrame) -> DataFrame:
    """(node, parent) of the subagent streams: the parent is the stream with the tool_use that a stream answers."""
    rows = events.select("session_id", "agent_id", "parent_call_id", clean_kind().alias("kind"), F.col("tool.call_id").alias("call_id")).where("session_id is not null")
    node = lambda s, a: F.when(F.coalesce(a, F.lit("")) == "", s).otherwise(F.concat(s, F.lit(AGENT), a))
    streams = rows.where("agent_id is not null and agent_id <> ''").groupBy("session_id", "agent_id").agg(F.max("parent_call_id").alias("call_id"))
    calls = rows.where("kind = 'tool_use' and call_id is not null").groupBy("session_id", "call_id").agg(F.min(F.struct(F.coalesce("agent_id", F.lit("")).alias("caller"))).alias("c"))
    joined = streams.join(calls, ["session_id", "call_id"], "left")
    s = F.col("session_id")
    return joined.select(node(s, F.col("agent_id")).alias("node"), F.when(F.col("c").isNotNull(), node(s, F.col("c.caller"))).alias("parent"))


def _rooted(links: DataFrame) -> DataFrame:
    """(node, parent, n) with one row per node, parents that are no nodes nulled, and the number of children."""
    nodes = links.where("node is not null").groupBy("node").agg(F.max("parent").alias("parent"))
    counts = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    rooted = nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    return rooted.join(counts, "node", "left").select("node", "parent", F.coalesce("n", F.lit(0)).alias("n"))


def peel(given: DataFrame, paths: bool = True, rounds: int = 200) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, and what is left of cycles.

    A node's row holds the node it hangs on by then (``up``), of the link's nodes with itself the highest (``top``), their number (``long``)
    and, with ``paths``, all (``seg``), the number of nodes gathered below it (``own``) and within the link (``extra``), and of its children the number left (``n``).
    Every round is two exchanges of messages, up to the parents and down to the children of spliced nodes.
    """
    state = given.select("node", F.col("parent").alias("up"), F.col("node").alias("top"), F.lit(1).alias("long"), (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("seg"), F.lit(1).cast("long").alias("own"), F.lit(0).cast("long").alias("extra"), "n")
    keep = ("up", "top", "long", "seg", "own", "extra", "n")
    only = lambda c: F.first(c, ignorenulls=True)  # of one row that has it
    off: list[DataFrame] = []
    for k in range(rounds):
        heads = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 0  # noqa: B023, E731
        leaf = F.col("n") == 0
        sent = state.where("up is not null").select(
            F.col("up").alias("node"), F.when(leaf, F.col("own") + F.col("extra")).alias("sent"), F.when(~leaf, F.col("node")).alias("child"), F.when(~leaf, F.col("extra")).alias("child_extra")
        )
        merged = state.select("node", F.struct(*keep).alias("s")).unionByName(sent, allowMissingColumns=True).groupBy("node").agg(
            only("s").alias("s"), F.sum("sent").alias("sent"), F.count("sent").alias("leaves"), F.max("child").alias("child"), F.max("child_extra").alias("child_extra")
        )
        now = merged.select("node", "s.up", "s.top", "s.long", "s.seg", (F.col("s.own") + F.coalesce("sent", F.lit(0))).alias("own"), "s.extra", F.col("s.n").alias("before"), (F.col("s.n") - F.col("leaves")).alias("n"), "child", "child_extra")
        # out goes a leaf, or a node with one child and that no leaf, whose coin is heads while its parent's is tails
        chained = (F.col("before") == 1) & (F.col("n") == 1) & F.col("up").isNotNull() & (F.col("up") != F.col("node")) & heads("node") & ~heads("up")
        now = now.withColumn("go", F.when(F.col("before") == 0, "leaf").when(chained, "chain"))
        down = now.where("go = 'chain'").select(F.col("child").alias("node"), F.struct("up", "top", "long", "seg", (F.col("own") + F.col("extra")).alias("more")).alias("over"))
        carried = now.select("node", F.struct(*keep, "go", "child", "child_extra").alias("s")).unionByName(down, allowMissingColumns=True)
        state = carried.groupBy("node").agg(only("s").alias("s"), only("over").alias("o")).select(
            "node", F.coalesce("o.up", "s.up").alias("up"), F.coalesce("o.top", "s.top").alias("top"), (F.col("s.long") + F.coalesce("o.long", F.lit(0))).alias("long"),
            F.when(F.col("o").isNotNull(), F.concat("o.seg", "s.seg")).otherwise(F.col("s.seg")).alias("seg"),
            "s.own", (F.col("s.extra") + F.coalesce("o.more", F.lit(0))).alias("extra"), "s.n", "s.go", "s.child", "s.child_extra", F.lit(k).alias("peeled"),
        )
        state = cut(state)
        off.append(state.where("go is not null"))
        state = state.where("go is null")
        if state.where("up is null or up <> node").isEmpty():
            return off, state
    raise RuntimeError(f"the hierarchy did not peel in {rounds} rounds")


def resolve(links: DataFrame, sizes: bool = True, paths: bool = True) -> DataFrame:
    """(node, parent, root, depth, path, size, peeled) of every node of ``links`` (node, parent).

    ``size`` is that of the node's subtree, itself included; ``peeled`` the round that took it off, null for
    what is left of cycles. Nodes in and below cycles have root '', depth -1 and path and size null. Without ``paths`` (and ``sizes``)
    these are null, and no row grows with the depth of its tree.
    """
    given = cut(_rooted(links))
    off, rest = peel(given, paths)
    none = F.lit(None)
    done = rest.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth"), none.cast("array<string>").alias("path"), none.cast("long").alias("size"), none.cast("int").alias("peeled"))
    lost = F.coalesce(F.col("depth") == -1, F.lit(False))
    for gone in reversed(off):
        above = ("root", "depth", "path") if paths else ("root", "depth")
        now = gone.join(done.select(F.col("node").alias("up"), *above), "up", "left")
        if sizes:
            now = now.join(done.select(F.col("node").alias("child"), F.col("size").alias("child_size")), "child", "left")
        else:
            now = now.withColumn("child_size", none.cast("long"))
        path = F.when(lost, none).when(F.col("up").isNull(), F.col("seg")).otherwise(F.concat("path", "seg")) if paths else none.cast("array<string>")
        fresh = now.select(
            "node",
            F.when(lost, "").when(F.col("up").isNull(), F.col("top")).otherwise(F.col("root")).alias("root"),
            F.when(lost, -1).when(F.col("up").isNull(), F.col("long") - 1).otherwise(F.col("depth") + F.col("long")).alias("depth"), path.alias("path"),
            none.cast("long").alias("size") if not sizes else F.when(lost, none).otherwise(F.col("own") + F.when(F.col("go") == "chain", F.col("child_extra") + F.col("child_size")).otherwise(0)).alias("size"), "peeled",
        )
        done = done.unionByName(cut(fresh))
    return done.join(given.select("node", "parent"), "node")


def hierarchy(sessions: DataFrame, events: DataFrame, sizes: bool = True, paths: bool = True) -> DataFrame:
    return resolve(session_links(sessions).unionByName(stream_links(events)), sizes, paths)


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, distance) of every node and each node above it."""
    up = resolved.where("path is not null").select("node", F.posexplode("path").alias("at", "ancestor"), F.size("path").alias("n"))
    return up.where("ancestor <> node").select("ancestor", "node", (F.col("n") - 1 - F.col("at")).alias("distance"))


def _of(spark: SparkSession, base: str, sizes: bool = False, paths: bool = True) -> DataFrame:
    return hierarchy(table(spark, base, "sessions"), table(spark, base, "session_events"), sizes, paths)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return _of(spark, base, paths=False).select(F.col("node").alias("node_key"), F.col("root").alias("root_key"), F.col("depth").alias("tree_depth"))


def p6_tree(spark: SparkSession, base: str) -> DataFrame:
    """Every node with its full path, subtree size and parent."""
    return _of(spark, base, sizes=True).select(F.col("node").alias("node_key"), F.col("parent").alias("parent_key"), F.col("root").alias("root_key"), F.col("depth").alias("tree_depth"), F.array_join("path", " > ").alias("full_path"), F.col("size").alias("subtree_size"))


def p6_descendants(spark: SparkSession, base: str) -> DataFrame:
    return descendants(_of(spark, base))
