"""Three vendors' raw transcripts to one event table.

A record becomes an array of events by expressions on its variant, which is unfolded; what depends on the records before it
(turn, session, carried timestamps, diffs held back) are windows and joins by transcript. No Python runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import coerce_int, epoch_ms_iso, split_lines, strip, synthetic_diff
from tracemill.operators.links import single_links, timed_links

SHAPE = {
    "text": "string", "tool": "struct<name:string,call_id:string,input:string,output:string,is_error:boolean>", "file_change": "struct<path:string,kind:string,diff:string>",
    "command": "struct<cmd:string,exit_code:int,status:string,output_preview:string,output_lines:int>", "media": "struct<data_b64:string,file_path:string,mime_type:string,context:string,tool_name:string,source:string>",
    "meta": "struct<cwd:string,model:string,cli_version:string,source:string,title:string,parent_session_id:string,branch:string,commit:string,dirty:boolean,repository_url:string>",
}
ENVELOPE = ("source_path", "source_line", "provider", "session_id", "ts", "kind", "turn_index", "seq")


def get(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def said(c: Column) -> Column:
    """Whether a text is more than whitespace."""
    return F.coalesce(strip(c) != "", F.lit(False))


def is_object(v: str) -> Column:
    return F.coalesce(F.expr(f"schema_of_variant({v})").startswith("OBJECT"), F.lit(False))


def struct(shape: str, **fields: Column) -> Column:
    """A struct of a SHAPE with the fields given, all others null."""
    inner = SHAPE[shape][len("struct<") : -1].split(",")
    return F.struct(*(F.coalesce(fields[n], F.lit(None)).cast(t).alias(n) if n in fields else F.lit(None).cast(t).alias(n) for n, t in (x.split(":") for x in inner)))


def event(kind: str | Column, at: Column | None = None, **payload: Column) -> Column:
    """An event as one type: its kind, a time of its own if it has one, and its payload."""
    cols = [(kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), (F.lit(None).cast("string") if at is None else at).alias("at")]
    return F.struct(*cols, *((payload[n] if n in payload else F.lit(None)).cast(t).alias(n) for n, t in SHAPE.items()))


def some(*events: tuple[Column, Column]) -> Column:
    """The array of the events whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(cond, e) for cond, e in events)))


def unfold(rows: DataFrame, events: Column, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(events).alias("part", "e")).select(*keep, "part", "e.*")


def _numbered(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("source_path").orderBy(*order)).cast("long"))


# --- claude -----------------------------------------------------------------


def _claude_items(recs: DataFrame) -> DataFrame:
    content = get("rec", "message.content", "array<variant>")
    plain = F.when(content.isNull(), get("rec", "message.content"))
    whole = recs.withColumn("plain", plain)
    item = whole.select("*", F.posexplode_outer(content).alias("item_no", "item"))
    kind, name = get("item", "type"), get("item", "name")
    user, assistant = F.col("type") == "user", F.col("type") == "assistant"
    text = get("item", "text")
    parts = get("item", "content", "array<variant>")
    image = lambda p: F.try_variant_get(p, "$.type", "string") == "image"
    data = lambda p: F.coalesce(F.try_variant_get(p, "$.source.data", "string"), F.lit(""))
    call = get("item", "tool_use_id")
    shots = F.transform(
        F.filter(F.coalesce(parts, F.expr("cast(array() as array<variant>)")), lambda p: F.coalesce(image(p), F.lit(False)) & (data(p) != "") & ~data(p).startswith("[BASE64:")),
        lambda p: event("screenshot", media=struct("media", data_b64=data(p), mime_type=F.coalesce(F.try_variant_get(p, "$.source.media_type", "string"), F.lit("image/png")), context=F.concat(F.lit("tool_result for "), F.coalesce(call, F.lit(""))), tool_name=F.lit("computer"), source=F.lit("session"))),
    )
    words = F.transform(F.filter(parts, lambda p: ~F.coalesce(image(p), F.lit(False))), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"), F.lit("")))
    output = F.coalesce(F.array_join(F.filter(words, lambda w: w != ""), "\n"), get("item", "content"), F.lit(""))
    result = event("tool_result", tool=struct("tool", call_id=call, output=output, is_error=F.when(get("item", "is_error", "boolean"), True)))
    path, old, new, cmd = (get("item", f"input.{k}") for k in ("file_path", "old_string", "new_string", "command"))
    has = lambda c: F.coalesce(c != "", F.lit(False))
    tracked = get("rec", "snapshot.trackedFileBackups", "map<string,variant>")
    use = kind == "tool_use"
    events = F.concat(
        some((user & said(F.col("plain")), event("user_message", text=F.col("plain"))), (user & (kind == "text") & said(text), event("user_message", text=text))),
        F.when(user & (kind == "tool_result"), F.concat(shots, F.array(result))).otherwise(F.array().cast(f"array<struct<kind:string,at:string,{','.join(f'{n}:{t}' for n, t in SHAPE.items())}>>")),
        some(
            (assistant & (kind == "text") & said(text), event("assistant_message", text=text)),
            (assistant & use, event("tool_use", tool=struct("tool", name=name, call_id=get("item", "id"), input=F.expr("to_json(try_variant_get(item, '$.input', 'variant'))")))),
            (assistant & use & (name == "Edit") & has(path) & (has(old) | has(new)), event("file_change", file_change=struct("file_change", path=path, kind=F.lit("modify"), diff=synthetic_diff(old, new, path)))),
            (assistant & use & (name == "Write") & has(path), event("file_change", file_change=struct("file_change", path=path, kind=F.lit("create")))),
            (assistant & use & (name == "Bash") & has(cmd), event("command", command=struct("command", cmd=cmd))),
            ((F.col("type") == "file-history-snapshot"), event("file_snapshot", text=F.when(F.size(tracked) > 0, F.concat(F.lit('{"files": '), F.to_json(F.map_keys(tracked)), F.lit("}"))))),
            ((F.col("type") == "system"), event("system", text=F.coalesce(get("rec", "subtype"), F.lit("")))),
        ),
    )
    return unfold(item, events, "source_path", "main_path", "agent_id", "source_line", "item_no", "ts", "turn_index")


def claude(recs: DataFrame, by_file_name: bool = False) -> DataFrame:
    """Main transcripts and their ``<stem>/subagents/agent-<id>.jsonl``. With ``by_file_name`` a main transcript's own session is
    that of its name, and records of other sessions, and those before its first, are left out."""
    agent = filled(F.regexp_extract("source_path", r"/subagents/(?:agent-)?([^/]+)\.jsonl$", 1))
    main = F.when(agent.isNotNull(), F.concat(F.regexp_extract("source_path", r"^(.*)/subagents/[^/]+$", 1), F.lit(".jsonl"))).otherwise(F.col("source_path"))
    recs = recs.select("source_path", "source_line", "rec", get("rec", "type").alias("type"), agent.alias("agent_id"), main.alias("main_path"), filled(F.coalesce(get("rec", "sessionId"), get("rec", "session_id"))).alias("own"), filled(get("rec", "timestamp")).alias("stamp"))
    order = W.partitionBy("source_path").orderBy("source_line")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if by_file_name:
        expected = F.when(F.col("agent_id").isNull(), F.regexp_extract("source_path", r"([^/]+)\.jsonl$", 1))
        recs = recs.withColumn("expected", expected).where("expected is null or own is null or own = expected")
        recs = recs.withColumn("seen", F.max((F.col("own") == F.col("expected")).cast("int")).over(order)).where("expected is null or seen = 1").drop("seen")
    else:
        recs = recs.withColumn("expected", F.lit(None).cast("string"))
    content = get("rec", "message.content", "array<variant>")
    visible = (F.col("type") == "user") & (said(F.when(content.isNull(), get("rec", "message.content"))) | F.coalesce(F.exists(content, lambda x: (F.try_variant_get(x, "$.type", "string") == "text") & said(F.try_variant_get(x, "$.text", "string"))), F.lit(False)))
    recs = recs.withColumn("turn_index", F.sum(visible.cast("int")).over(order).cast("int"))
    recs = recs.withColumn("ts", F.coalesce(F.last("stamp", ignorenulls=True).over(order), F.first("stamp", ignorenulls=True).over(whole), F.lit("")))
    sessions = recs.where("agent_id is null").groupBy("main_path").agg(F.coalesce(F.max("expected"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("source_line"))), F.lit("")).alias("session_id"))
    told = recs.where("type in ('user', 'assistant', 'file-history-snapshot', 'system')").select(
        "source_path", "main_path", "agent_id", "source_line", "ts", filled(get("rec", "cwd")).alias("cwd"), filled(get("rec", "version")).alias("cli_version"), F.when(F.col("type") == "assistant", filled(get("rec", "message.model"))).alias("model"), filled(get("rec", "gitBranch")).alias("branch"),
    ).where("coalesce(cwd, cli_version, model, branch) is not null")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("source_line")))
    meta = told.groupBy("source_path", "main_path", "agent_id").agg(F.min("source_line").alias("source_line"), F.min_by("ts", "source_line").alias("ts"), *(newest(c).alias(c) for c in ("cwd", "cli_version", "model", "branch")))
    meta = meta.select("source_path", "main_path", "agent_id", "source_line", F.lit(-1).alias("item_no"), "ts", F.lit(0).alias("turn_index"), F.lit(-1).alias("part"), event("meta", meta=struct("meta", **{c: F.col(c) for c in ("cwd", "cli_version", "model", "branch")})).alias("e")).select("*", "e.*").drop("e")
    events = _numbered(_claude_items(recs).unionByName(meta), (F.col("kind") != "meta"), "source_line", "item_no", "part").join(sessions, "main_path", "left")
    linked = events.join(_claude_links(recs, events), ["main_path", "agent_id"], "left").withColumn("provider", F.lit("claude"))
    status = F.when(F.col("agent_id").isNotNull(), F.coalesce("parent_link_status", F.lit("unavailable")))
    rank = F.row_number().over(W.partitionBy("main_path").orderBy("ts", "seq", F.coalesce("agent_id", F.lit("")), "source_path"))
    return linked.withColumn("parent_link_status", status).withColumn("seq", rank.cast("long")).select("main_path", *ENVELOPE, *SHAPE, "agent_id", "parent_call_id", "root_turn_index", "parent_link_status", "parent_link_basis")


def _claude_links(recs: DataFrame, events: DataFrame) -> DataFrame:
    """The parents of subagents: named by progress records, else the only one left, else in order of time, else none."""
    calls = events.where("kind = 'tool_use' and agent_id is null and tool.name = 'Agent' and tool.call_id <> ''").groupBy("main_path", F.col("tool.call_id").alias("call_id")).agg(F.max_by("turn_index", "seq").alias("root_turn_index"), F.max_by("ts", "seq").alias("ts"))
    told = recs.where("agent_id is null").select("main_path", "source_line", get("rec", "data.agentId").alias("agent_id"), F.coalesce(get("rec", "data.parentToolUseID"), get("rec", "data.parentToolUseId")).alias("call_id"))
    named = told.where("agent_id <> ''").join(calls, ["main_path", "call_id"]).groupBy("main_path", "agent_id").agg(F.max_by("call_id", "source_line").alias("call_id")).withColumn("basis", F.lit("progress"))
    streams = recs.where("agent_id is not null").groupBy("main_path", "agent_id").agg(F.min_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("source_line"))).alias("ts"))
    as_session = lambda rows: rows.withColumnRenamed("main_path", "session_id")
    loose, free = as_session(streams.join(named, ["main_path", "agent_id"], "left_anti")), as_session(calls.join(named, ["main_path", "call_id"], "left_anti"))
    single = single_links(loose.drop("ts"), free.select("session_id", "call_id")).select("session_id", "agent_id", "call_id").withColumn("basis", F.lit("single"))
    timed = timed_links(loose, free.select("session_id", "call_id", "ts")).join(single.select("session_id"), "session_id", "left_anti").withColumn("basis", F.lit("time"))
    found = as_session(named).unionByName(single).unionByName(timed)
    left = free.groupBy("session_id").agg(F.count("*").alias("n_free"))
    rest = loose.select("session_id", "agent_id").join(found, ["session_id", "agent_id"], "left_anti").join(left, "session_id", "left")
    rest = rest.select(F.col("session_id").alias("main_path"), "agent_id", F.lit(None).cast("string").alias("parent_call_id"), F.lit(None).cast("int").alias("root_turn_index"), F.when(F.col("n_free") > 0, "ambiguous").otherwise("unavailable").alias("parent_link_status"), F.lit(None).cast("string").alias("parent_link_basis"))
    good = found.withColumnRenamed("session_id", "main_path").join(calls.drop("ts"), ["main_path", "call_id"]).select("main_path", "agent_id", F.col("call_id").alias("parent_call_id"), "root_turn_index", F.lit("matched").alias("parent_link_status"), F.col("basis").alias("parent_link_basis"))
    return good.unionByName(rest)


# --- codex ------------------------------------------------------------------


def codex(recs: DataFrame) -> DataFrame:
    recs = recs.select("source_path", "source_line", get("rec", "type").alias("type"), F.coalesce(get("rec", "timestamp"), F.lit("")).alias("ts"), F.expr("try_variant_get(rec, '$.payload', 'variant')").alias("p"))
    p, json_of = lambda path, kind="string": get("p", path, kind), lambda path: F.expr(f"to_json(try_variant_get(p, '$.{path}', 'variant'))")
    any_text = lambda *paths: filled(F.coalesce(*(filled(F.coalesce(F.array_join(p(x, "array<string>"), "\n"), p(x), json_of(x))) for x in paths)))
    kind, role, name = p("type"), p("role"), F.lower(F.trim(p("name")))
    texts = F.transform(p("content", "array<variant>"), lambda x: F.coalesce(*(filled(F.try_variant_get(x, f"$.{k}", "string")) for k in ("output_text", "input_text", "text"))))
    message = F.array_join(F.filter(texts, said), "\n")
    item, msg = F.col("type") == "response_item", F.col("type") == "event_msg"
    spoken = item & (kind == "message")
    visible = (spoken & (role == "user") & said(message)) | (msg & (kind == "user_message") & said(p("message")))
    call, output = p("call_id"), p("output")
    calling, called = item & kind.isin("function_call", "custom_tool_call"), item & kind.isin("function_call_output", "custom_tool_call_output")
    raw = F.coalesce(filled(p("arguments")), filled(p("input")), json_of("input"), F.lit(""))
    args, out = F.try_parse_json(raw), F.try_parse_json(F.coalesce(output, json_of("output")))
    recs = recs.withColumn("a", args).withColumn("o", out)
    a, o = lambda path: get("a", path), lambda path: get("o", path)

    def command(of) -> tuple[Column, Column]:
        cmd, code, status, shown = F.coalesce(filled(of("command")), filled(of("cmd"))), coerce_int(F.coalesce(of("exitCode"), of("exit_code"))), filled(of("status")), filled(of("output"))
        return cmd.isNotNull() | code.isNotNull() | status.isNotNull(), event("command", command=struct("command", cmd=cmd, exit_code=code, status=status, output_preview=F.substring(shown, 1, 500)))

    changed = F.coalesce(filled(a("path")), filled(a("file_path")))
    ran, run = command(a)
    did, done = command(o)
    custom = kind.isin("custom_tool_call", "custom_tool_call_output")
    shots = F.transform(F.when(called, F.regexp_extract_all(output, F.lit(r"(/\S+\.(?:png|jpg|jpeg|gif|webp))"), 1)), lambda f: event("screenshot", media=struct("media", file_path=f, mime_type=F.lit("image/png"), context=F.concat(F.lit("tool output for "), F.coalesce(call, F.lit(""))), source=F.lit("file"))))
    summary = F.array_join(F.filter(F.transform(p("summary", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda t: t != ""), "\n")
    plan = (msg & kind.isin("agent_plan", "turn/plan/updated")) | (F.col("type") == "turn/plan/updated")
    diff = (msg & (kind == "turn/diff/updated")) | (F.col("type") == "turn/diff/updated")
    items = F.size(F.coalesce(p("replacement_history", "array<variant>"), F.expr("cast(array() as array<variant>)")))
    compacted = F.when(said(p("message")), p("message")).when(items > 0, F.concat(F.lit("Context compacted; replacement_history items: "), items.cast("string"))).otherwise("Context compacted")
    own = F.coalesce(filled(p("id")), p("session_id"), F.lit(""))
    meta = struct(
        "meta", cwd=p("cwd"), model=F.coalesce(filled(p("model_provider")), p("model")), cli_version=filled(p("cli_version")), source=filled(p("source")), branch=filled(p("git.branch")), commit=F.coalesce(filled(p("git.commit")), filled(p("git.commit_hash"))),
        dirty=p("git.dirty", "boolean"), repository_url=F.coalesce(filled(p("git.repository_url")), filled(p("git.repo")), filled(p("git.repository"))),
    )
    events = F.concat(
        some(
            (F.col("type") == "session_meta", event("meta", meta=meta)),
            (spoken & (role == "user") & (message != ""), event("user_message", text=message)), (spoken & (role == "assistant") & (message != ""), event("assistant_message", text=message)),
            (calling, event("tool_use", tool=struct("tool", name=p("name"), call_id=call, input=raw))),
            (calling & custom & is_object("a") & (name == "filechange") & changed.isNotNull(), event("file_change", file_change=struct("file_change", path=changed, kind=F.coalesce(filled(a("kind")), F.lit("modify")), diff=filled(a("diff"))))),
            (calling & custom & is_object("a") & (name == "commandexecution") & ran, run),
            (called, event("tool_result", tool=struct("tool", call_id=call, output=F.coalesce(output, json_of("output"), F.lit(""))))), (called & custom & is_object("o") & did, done),
        ),
        F.coalesce(shots, F.expr(f"cast(array() as array<struct<kind:string,at:string,{','.join(f'{n}:{t}' for n, t in SHAPE.items())}>>)")),
        some(
            (item & (kind == "reasoning") & (summary != ""), event("reasoning", text=summary)),
            (msg & (kind == "user_message") & F.coalesce(p("message") != "", F.lit(False)), event("user_message", text=p("message"))), (msg & (kind == "agent_message") & F.coalesce(p("message") != "", F.lit(False)), event("assistant_message", text=p("message"))),
            (msg & (kind == "agent_reasoning") & F.coalesce(p("text") != "", F.lit(False)), event("reasoning", text=p("text"))),
            (plan & any_text("plan", "text", "message").isNotNull(), event("plan_update", text=any_text("plan", "text", "message"))), (diff & any_text("diff", "text", "message").isNotNull(), event("aggregate_diff", text=any_text("diff", "text", "message"))),
            (F.col("type") == "turn_context", event("turn_context", meta=struct("meta", cwd=filled(p("cwd")), model=filled(p("model"))))), (F.col("type") == "compacted", event("compaction", text=compacted)),
        ),
    )
    order = W.partitionBy("source_path").orderBy("source_line")
    recs = recs.withColumn("turn_index", F.sum(F.coalesce(visible, F.lit(False)).cast("int")).over(order).cast("int"))
    recs = recs.withColumn("session_id", F.coalesce(F.last(F.when(F.col("type") == "session_meta", own), ignorenulls=True).over(order), F.lit("")))
    rows = unfold(recs, events, "source_path", "source_line", "session_id", "ts", "turn_index").withColumn("provider", F.lit("codex"))
    return _numbered(rows, "source_line", "part").select(*ENVELOPE, *SHAPE)


# --- opencode ---------------------------------------------------------------


def _changes(diffs: Column, at: Column | None = None) -> Column:
    """File changes of an array of diffs."""
    of = lambda d, k: F.try_variant_get(d, f"$.{k}", "string")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    kind = lambda d: F.when(of(d, "status") == "added", "create").when(of(d, "status") == "deleted", "delete").when(of(d, "status") == "modified", "modify").when(~blank(of(d, "before")) & blank(of(d, "after")), "delete").when(blank(of(d, "before")) & ~blank(of(d, "after")), "create").otherwise("modify")
    return F.transform(F.filter(diffs, lambda d: ~blank(of(d, "file"))), lambda d: event("file_change", at=at, file_change=struct("file_change", path=of(d, "file"), kind=kind(d), diff=synthetic_diff(of(d, "before"), of(d, "after"), of(d, "file")))))


def opencode(recs: DataFrame) -> DataFrame:
    recs = recs.select("source_path", "source_line", get("rec", "type").alias("type"), F.expr("try_variant_get(rec, '$.info', 'variant')").alias("info"), get("rec", "parts", "array<variant>").alias("parts")).where(is_object("info"))
    i = lambda path, kind="string": get("info", path, kind)
    iso = lambda c: filled(epoch_ms_iso(c))
    first = lambda c, order="source_line": F.min_by(c, F.when(c.isNotNull(), F.col(order)))
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("/", a, b)).otherwise(F.coalesce(b, a))
    model = F.when(F.col("type") == "message", F.when(i("role") == "assistant", pair(filled(i("providerID")), filled(i("modelID")))).otherwise(pair(filled(i("model.providerID")), filled(i("model.modelID")))))
    is_session, is_message = F.col("type") == "session", F.col("type") == "message"
    last_session = lambda c: F.max_by(c, F.when(is_session, F.col("source_line")))
    heads = recs.groupBy("source_path").agg(
        F.coalesce(filled(last_session(i("id"))), first(F.when(is_message, filled(i("sessionID")))), F.lit("")).alias("session_id"),
        F.coalesce(last_session(iso(i("time.created"))), first(F.when(is_message, iso(i("time.created")))), F.lit("")).alias("meta_ts"),
        struct("meta", cwd=filled(last_session(i("directory"))), cli_version=filled(last_session(i("version"))), title=filled(last_session(i("title"))), parent_session_id=filled(last_session(i("parentID"))), model=first(model)).alias("meta"),
    )
    messages = recs.where(is_message).join(heads.select("source_path", "meta_ts"), "source_path").withColumn("user", i("role") == "user").withColumn("user", F.coalesce("user", F.lit(False)))
    shown = F.filter(F.col("parts"), lambda x: (F.try_variant_get(x, "$.type", "string") == "text") & ~F.coalesce(F.try_variant_get(x, "$.ignored", "boolean"), F.lit(False)) & said(F.try_variant_get(x, "$.text", "string")))
    order = W.partitionBy("source_path").orderBy("source_line")
    messages = messages.withColumn("turn_index", F.coalesce(F.sum((F.col("user") & (F.size(shown) > 0)).cast("int")).over(order), F.lit(0)).cast("int")).withColumn("ts", F.coalesce(iso(i("time.created")), "meta_ts"))
    # diffs of a user message wait for the first answer to it, or for the end
    held = messages.where("user").select("source_path", i("id").alias("parent"), get("info", "summary.diffs", "array<variant>").alias("diffs"), F.col("source_line").alias("asked_line"), F.col("ts").alias("asked_ts"), F.col("turn_index").alias("asked_turn")).where("size(diffs) > 0")
    answers = messages.where("not user").select("source_path", i("parentID").alias("parent"), "source_line")
    taken = held.join(answers, ["source_path", "parent"], "left").groupBy("source_path", "parent", "asked_line").agg(F.min(F.when(F.col("source_line") > F.col("asked_line"), F.col("source_line"))).alias("source_line"))
    held = held.join(taken, ["source_path", "parent", "asked_line"])
    given = held.where("source_line is not null").groupBy("source_path", "source_line").agg(F.max_by("diffs", "asked_line").alias("diffs"))
    messages = messages.join(given, ["source_path", "source_line"], "left")
    part = messages.select("*", F.posexplode_outer("parts").alias("part_no", "x"))
    x = lambda path, kind="string": get("x", path, kind)
    t, text = x("type"), x("text")
    begun = F.coalesce(iso(x("state.time.start")), F.col("ts"))
    ended = F.coalesce(iso(x("state.time.end")), begun)
    tool, status = t == "tool", x("state.status")
    cmd, code = F.coalesce(filled(x("state.input.command")), filled(x("state.input.cmd"))), coerce_int(x("state.metadata.exit"))
    said_out = F.coalesce(x("state.output"), x("state.error"), x("state.metadata.output"), F.lit(""))
    outcome = F.when(code.isNotNull(), F.when(code == 0, "pass").otherwise("fail")).when(status == "completed", "pass").when(status == "error", "fail")
    ran = struct("command", cmd=cmd, exit_code=code, status=outcome, output_preview=filled(F.substring(said_out, 1, 500)), output_lines=F.when(said_out != "", F.greatest(F.size(split_lines(said_out)), F.lit(1))))
    call = x("callID")
    at = lambda y, k: F.coalesce(F.try_variant_get(y, f"$.{k}", "string"), F.lit(""))
    data = lambda y: F.substring_index(at(y, "url"), ",", -1)
    inline = lambda y: at(y, "url").startswith("data:") & at(y, "url").contains(";base64,") & (data(y) != "") & ~data(y).startswith("[BASE64:")
    file = lambda y: F.when(at(y, "url").startswith("file://"), F.try_url_decode(F.regexp_replace(F.substring(at(y, "url"), 8, 10_000), r"\+", "%2B"))).when(at(y, "url").startswith("/"), at(y, "url"))
    shots = F.transform(
        F.filter(x("state.attachments", "array<variant>"), lambda y: at(y, "mime").startswith("image/") & (inline(y) | file(y).isNotNull())),
        lambda y: event("screenshot", at=ended, media=struct("media", data_b64=F.when(inline(y), data(y)), file_path=F.when(~inline(y), file(y)), mime_type=at(y, "mime"), context=F.concat(F.lit("tool result for "), F.coalesce(call, F.lit(""))), tool_name=x("tool"), source=F.when(inline(y), "session").otherwise("file"))),
    )
    nothing = F.expr(f"cast(array() as array<struct<kind:string,at:string,{','.join(f'{n}:{k}' for n, k in SHAPE.items())}>>)")
    patches = F.transform(F.when((t == "patch") & F.col("diffs").isNull() & ~F.col("user"), x("files", "array<string>")), lambda f: event("file_change", file_change=struct("file_change", path=f, kind=F.lit("modify"))))
    speaks = (t == "text") & ~F.coalesce(x("ignored", "boolean"), F.lit(False)) & said(text)
    retry = F.coalesce(filled(x("error.data.message")), filled(x("error.message")), filled(x("error")), F.lit(""))
    other = ~F.col("user")
    events = F.concat(
        some(
            (F.col("user") & speaks, event("user_message", at=iso(x("time.start")), text=text)), (other & speaks, event("assistant_message", at=iso(x("time.start")), text=text)), (other & (t == "reasoning") & said(text), event("reasoning", at=iso(x("time.start")), text=text)),
            (other & tool, event("tool_use", at=begun, tool=struct("tool", name=x("tool"), call_id=call, input=F.coalesce(F.when(F.expr("schema_of_variant(try_variant_get(x, '$.state.input', 'variant'))").startswith("OBJECT"), F.expr("to_json(try_variant_get(x, '$.state.input', 'variant'))")), F.lit("{}"))))),
            (other & tool & (F.lower(x("tool")) == "bash") & cmd.isNotNull(), event("command", at=ended, command=ran)),
            (other & tool & (status == "completed"), event("tool_result", at=ended, tool=struct("tool", call_id=call, output=F.coalesce(x("state.output"), F.lit(""))))),
            (other & tool & (status == "error"), event("tool_result", at=ended, tool=struct("tool", call_id=call, output=F.coalesce(x("state.error"), F.lit("")), is_error=F.lit(True)))),
        ),
        F.coalesce(F.when(other & tool & (status == "completed"), shots), nothing), F.coalesce(patches, nothing),
        some(
            (other & (t == "compaction"), event("compaction", text=F.concat(F.lit("Context compacted"), F.when(x("auto", "boolean"), " automatically").otherwise(""), F.when(x("overflow", "boolean"), " after overflow").otherwise("")))),
            (other & (t == "retry"), event("system", at=iso(x("time.created")), text=strip(F.concat(F.lit("Retry attempt "), F.coalesce(x("attempt"), F.lit("0")), F.lit(": "), retry)))),
        ),
    )
    keep = ("source_path", "source_line", "part_no", "ts", "turn_index")
    rows = unfold(part, events, *keep)
    finished = F.coalesce(iso(i("time.completed")), F.col("ts"))
    problem = F.coalesce(filled(i("error.data.message")), filled(i("error.message")))
    closing = F.concat(some((problem.isNotNull(), event("system", at=finished, text=F.concat(F.lit("Assistant error: "), problem)))), F.coalesce(_changes(F.col("diffs"), finished), nothing))
    tail = unfold(messages.where("not user").withColumn("part_no", F.lit(1 << 30)), closing, *keep)
    rest = held.where("source_line is null").select("source_path", F.lit(1 << 30).alias("source_line"), F.col("asked_line").alias("part_no"), F.col("asked_ts").alias("ts"), F.col("asked_turn").alias("turn_index"), "diffs")
    rest = unfold(rest, _changes(F.col("diffs")), *keep)
    head = heads.select("source_path", F.lit(1).alias("source_line"), F.lit(-1).alias("part_no"), F.col("meta_ts").alias("ts"), F.lit(0).alias("turn_index"), F.lit(0).alias("part"), event("meta", meta=F.col("meta")).alias("e")).select("*", "e.*").drop("e")
    every = reduce(DataFrame.unionByName, (rows, tail, rest)).withColumn("late", F.lit(1)).unionByName(head.withColumn("late", F.lit(0)))
    every = _numbered(every, "late", "source_line", F.coalesce("part_no", F.lit(-1)), "part").withColumn("ts", F.coalesce("at", "ts"))
    every = every.withColumn("source_line", F.when(F.col("source_line") == 1 << 30, F.col("part_no")).otherwise(F.col("source_line")))
    return every.join(heads.select("source_path", "session_id"), "source_path").withColumn("provider", F.lit("opencode")).select(*ENVELOPE, *SHAPE)


BY_PROVIDER = {"claude": claude, "codex": codex, "opencode": opencode}


def normalize(recs: DataFrame, provider: str) -> DataFrame:
    """Records of one vendor to events."""
    return BY_PROVIDER[provider](recs)


def normalize_all(**recs: DataFrame) -> DataFrame:
    """``claude=..., codex=...``: several vendors' events in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (normalize(r, p) for p, r in recs.items()))
