"""The queries' equals in plain SQL, written apart from them for an engine of its own."""

from __future__ import annotations

EV = """ev AS (SELECT * EXCLUDE (kind, rn), lower(trim(kind)) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY event_id) AS rn FROM session_events) WHERE rn = 1)"""
LATEST = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY discovered_at DESC, session_row DESC) AS rn FROM sessions) WHERE rn = 1)"""
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STREAM = "PARTITION BY session_id, coalesce(agent_id, '') ORDER BY seq"
LINE = "seq || '|' || kind || '|' || coalesce(text, '') || '|' || coalesce(tool.input, '') || '|' || coalesce(tool.output, '') || chr(10)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def lines(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '{LINE_END}'), lambda s: {strip('s')}), lambda s: s <> '')"


def sentence(x: str, cap: int) -> str:
    return f"""CASE WHEN {x} = '' THEN '' WHEN contains({x}, '.') THEN left({x}, position('.' IN {x})) WHEN contains({x}, '!') THEN left({x}, position('!' IN {x}))
        WHEN contains({x}, '?') THEN left({x}, position('?' IN {x})) ELSE left({x}, {cap}) || CASE WHEN length({x}) > {cap} THEN '...' ELSE '' END END"""


#: All streams of a session in one order: an open group for each stream, as the state of a recursion from event to event.
GROUPS = """
    o AS (SELECT *, coalesce(agent_id, '') AS stream, coalesce(tool.call_id, '') AS call, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i FROM ev),
    f AS (SELECT session_id, i, seq AS leader, CASE WHEN kind = 'tool_use' AND call <> '' THEN [{'s': stream, 'l': seq, 'c': call, 'd': false}] ELSE [] END AS open FROM o WHERE i = 1
        UNION ALL SELECT session_id, i, coalesce(took, seq), list_concat(
            list_transform(list_filter(open, lambda x: CASE WHEN x.s = stream THEN took IS NOT NULL ELSE NOT x.d OR coalesce(took < x.l, false) END), lambda x: {'s': x.s, 'l': x.l, 'c': x.c, 'd': x.d OR (x.s = stream AND kind = 'tool_result' AND call = x.c)}),
            CASE WHEN kind = 'tool_use' AND call <> '' THEN [{'s': stream, 'l': seq, 'c': call, 'd': false}] ELSE [] END)
        FROM (SELECT o.session_id, o.i, o.seq, o.kind, o.stream, o.call, f.open, CASE WHEN o.kind <> 'tool_use' THEN list_filter(f.open, lambda x: x.s = o.stream AND (NOT x.d OR o.kind IN ('file_change', 'command')))[1].l END AS took
            FROM f JOIN o ON o.session_id = f.session_id AND o.i = f.i + 1)),
    g AS (SELECT o.*, f.leader FROM o JOIN f ON f.session_id = o.session_id AND f.i = o.i)"""

PACK = f"""{GROUPS},
    s AS (SELECT session_id, leader, sum(length({LINE})) AS size FROM g GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY leader) AS i FROM s),
    r AS (SELECT session_id, leader, size, i, 0 AS chunk, CASE WHEN size >= 6000 THEN 0 ELSE size END AS used FROM n WHERE i = 1
        UNION ALL SELECT n.session_id, n.leader, n.size, n.i, CASE WHEN n.size >= 6000 OR r.used = 0 OR r.used + n.size > 6000 THEN r.chunk + 1 ELSE r.chunk END,
            CASE WHEN n.size >= 6000 THEN 0 WHEN r.used = 0 OR r.used + n.size > 6000 THEN n.size ELSE r.used + n.size END
        FROM r JOIN n ON n.session_id = r.session_id AND n.i = r.i + 1)"""

REFINE = f"""{PACK},
    p AS (SELECT g.*, r.chunk, row_number() OVER (PARTITION BY g.session_id, r.chunk ORDER BY g.leader, g.seq) AS place FROM g JOIN r ON r.session_id = g.session_id AND r.leader = g.leader),
    q AS (SELECT *, sum(length({LINE})) OVER (PARTITION BY session_id, chunk ORDER BY place) AS running, sum(length({LINE})) OVER (PARTITION BY session_id, chunk) AS whole, count(*) OVER (PARTITION BY session_id, chunk) AS total FROM p),
    t AS (SELECT *, max(CASE WHEN kind = 'user_message' AND place > 1 AND place < total AND running <= 6000 AND whole > 6000 THEN place END) OVER (PARTITION BY session_id, chunk) AS split_at FROM q),
    h AS (SELECT *, CASE WHEN place > split_at THEN 1 ELSE 0 END AS half FROM t)"""

ERRORS = f"""er AS (SELECT session_id, seq, CASE WHEN kind = 'command' AND command.cmd <> '' AND coalesce(command.exit_code, 0) <> 0
        THEN 'Command failed (exit ' || command.exit_code || '): ' || left(command.cmd, 120)
        WHEN kind = 'tool_result' AND tool.is_error THEN nullif(left(coalesce({lines('tool.output')}[1], ''), 200), '') END AS error FROM ev)"""

INTENTS = f"""said AS (SELECT session_id, seq, {strip('text')} AS s, text FROM ev WHERE kind = 'user_message' AND text <> '')"""

STEPS = f"""steps AS (SELECT doc_id, source AS report, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS step_no, regexp_replace(coalesce({lines('text')}[1], ''), '^#+ *', '') AS title, text AS body
    FROM documents WHERE doc_kind = 'report_step' AND text IS NOT NULL AND source IS NOT NULL)"""

NAMED = """idx AS (SELECT tool.call_id AS call_id, arg_max(tool.name, (session_id, seq)) AS tool_name FROM ev WHERE kind = 'tool_use' AND tool.call_id <> '' AND tool.name <> '' GROUP BY 1),
    res AS (SELECT ev.*, coalesce(ev.tool.call_id, '') AS call_id, coalesce(idx.tool_name, '') AS tool_name FROM ev LEFT JOIN idx ON idx.call_id = coalesce(ev.tool.call_id, '') WHERE kind = 'tool_result')"""

CHANGED = "ch AS (SELECT event_id, file_change.path AS path, coalesce(repo_root, '') AS root FROM session_events WHERE file_change.path IS NOT NULL)"
CHUNKED = "cl AS (SELECT ev.*, c.chunk_id FROM ev JOIN chunks c ON c.session_id = ev.session_id WHERE source_line BETWEEN line_start AND line_end)"
PATHS = r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_-]+\.[a-z]{1,5}"

TREE = r"""WITH RECURSIVE s AS (SELECT session_id, arg_max(struct_pack(p := parent_session_id), (discovered_at, session_row)).p AS p FROM sessions GROUP BY 1),
        k AS (SELECT session_id, trim(regexp_replace(lower(trim(session_id)), '^opencode://session/', '')) AS ref, trim(regexp_replace(lower(trim(p)), '^opencode://session/', '')) AS want FROM s),
        a AS (SELECT session_id, agent_id, max(parent_call_id) AS call FROM session_events WHERE agent_id IS NOT NULL GROUP BY 1, 2),
        c AS (SELECT session_id, tool.call_id AS call, min(coalesce(agent_id, '')) AS caller FROM session_events WHERE lower(trim(kind)) = 'tool_use' AND tool.call_id IS NOT NULL GROUP BY 1, 2),
        l AS (SELECT x.session_id AS node, y.session_id AS parent FROM k x LEFT JOIN k y ON x.want = y.ref
            UNION ALL SELECT a.session_id || '::agent:' || a.agent_id, CASE WHEN c.caller = '' THEN a.session_id WHEN c.caller IS NOT NULL THEN a.session_id || '::agent:' || c.caller END FROM a LEFT JOIN c ON c.session_id = a.session_id AND c.call = a.call),
        n AS (SELECT l.node, CASE WHEN l.parent IN (SELECT node FROM l) THEN l.parent END AS parent FROM l),
        u AS (SELECT node, node AS above FROM n UNION SELECT u.node, n.parent FROM u JOIN n ON n.node = u.above WHERE n.parent IS NOT NULL),
        t AS (SELECT u.node, max(CASE WHEN n.parent IS NULL THEN u.above END) AS root, count(*) - 1 AS depth FROM u JOIN n ON n.node = u.above GROUP BY 1)"""

GATE = f"""{STEPS}, b AS (SELECT *, {strip('body')} AS stripped, list_transform(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '- ')), lambda x: substr(x, 3)) AS claims FROM steps),
    st AS (SELECT doc_id, report, step_no, {strip('title')} AS title, {strip(f"({sentence('stripped', 120)})")} AS takeaway, {strip("coalesce(claims[1], '')")} AS intent, claims, contains(body, '```') AS pic, contains(body, '/') AS files FROM b),
    h AS (SELECT *, 30000 + 100 * length(title) + 45 * (length(takeaway) + length(intent)) + list_sum(list_transform(claims, lambda x: 1600 + 34 * length({strip('x')}))) AS base FROM st),
    px AS (SELECT *, coalesce(base, 30000 + 100 * length(title) + 45 * (length(takeaway) + length(intent))) + CASE WHEN pic THEN 56000 ELSE 0 END + CASE WHEN files THEN 9000 ELSE 0 END AS hundredths,
        coalesce(list_bool_or(list_transform(claims, lambda x: regexp_matches(x, '[0-9]') AND contains(x, '.'))), false) AS grounded FROM h),
    ov AS (SELECT report, arg_min(title, step_no) AS goal, list(title ORDER BY step_no) FILTER (step_no <= 5) AS bullets, list(title ORDER BY step_no) FILTER (step_no <= 5 AND title <> '') AS told, count(*) AS n_steps FROM st GROUP BY 1),
    oh AS (SELECT *, 26000 + length(goal) * CASE WHEN length(goal) > 140 THEN 130 ELSE 220 END + list_sum(list_transform(bullets, lambda x: 1200 + 45 * length(x))) AS hundredths FROM ov)"""

_RAW = r"(regexp_matches({0}, '(?i)^\s*chunk-\d+\b') OR regexp_matches({0}, '(?i)\b\d+\s+events\b'))"
_CONTROL = r"regexp_matches({0}, '(?i)<(?:environment_context|local-command-caveat)>|#\s*AGENTS\b|continued from a previous conversation')"
_DULL = r"(regexp_matches({0}, '(?i)^\s*(this chunk|chunk-\d+|n/a|none|todo)\b') OR regexp_matches({0}, '(?i)\b\d+\s+events\b'))"


def _said(severity: str, fault: str, rows: str, where: str) -> str:
    return f"SELECT report, '{severity}' AS severity, '{fault}' AS fault FROM {rows} WHERE {where}"


FAULTS = f"""{GATE}, ft AS ({' UNION ALL '.join((
    _said('error', 'no_title', 'px', "title = ''"), _said('error', 'raw_title', 'px', _RAW.format('title')), _said('error', 'control_title', 'px', _CONTROL.format('title')), _said('error', 'no_takeaway', 'px', "takeaway = ''"),
    _said('error', 'generic_takeaway', 'px', "takeaway <> '' AND " + _DULL.format('takeaway')), _said('error', 'raw_intent', 'px', _RAW.format('intent')), _said('error', 'control_intent', 'px', 'NOT ' + _RAW.format('intent') + ' AND ' + _CONTROL.format('intent')),
    _said('error', 'not_grounded', 'px', 'NOT grounded'), _said('warning', 'takeaway_is_title', 'px', "title <> '' AND takeaway <> '' AND rtrim(title, '.') = rtrim(takeaway, '.')"), _said('warning', 'too_tall', 'px', 'hundredths > 180000'),
    _said('error', 'no_goal', 'ov', "goal = ''"), _said('error', 'raw_goal', 'ov', _RAW.format('goal')), _said('error', 'raw_bullet', 'ov', f"len(told) >= 3 AND list_bool_or(list_transform(told, lambda x: {_RAW.format('x')} OR {_CONTROL.format('x')}))"),
    _said('error', 'noisy_key_file', 'ov', "list_bool_or(list_transform(bullets, lambda x: contains(x, '/')))"), _said('error', 'too_many_steps', 'ov', 'n_steps > 12'), _said('warning', 'few_bullets', 'ov', 'coalesce(len(told), 0) < 3'),
    _said('warning', 'same_takeaways', f"(SELECT report, takeaway, count(*) AS n FROM px WHERE takeaway <> '' AND NOT {_DULL.format('takeaway')} GROUP BY 1, 2 HAVING count(*) > 1)", 'true').replace('SELECT report', 'SELECT DISTINCT report', 1),
    _said('warning', 'no_end_state', 'ov', 'true'), _said('warning', 'tall_overview', 'oh', 'hundredths > 108000'),
))})"""

SQL: dict[str, str] = {
    "p6_found": f"""{TREE}
        SELECT node AS node_key, coalesce(root, '') AS root_key, CAST(CASE WHEN root IS NULL THEN -1 ELSE depth END AS INTEGER) AS tree_depth FROM t""",
    "p6_tree": f"""{TREE}, g AS (SELECT t.node, string_agg(u.above, ' > ' ORDER BY a.depth) AS path FROM t JOIN u USING (node) JOIN t a ON a.node = u.above WHERE t.root IS NOT NULL GROUP BY 1),
        z AS (SELECT u.above AS node, count(*) AS size FROM u GROUP BY 1)
        SELECT t.node AS node_key, n.parent AS parent_key, coalesce(t.root, '') AS root_key, CAST(CASE WHEN t.root IS NULL THEN -1 ELSE t.depth END AS INTEGER) AS tree_depth, g.path AS full_path, CASE WHEN t.root IS NOT NULL THEN z.size END AS subtree_size
        FROM t JOIN n USING (node) LEFT JOIN g USING (node) LEFT JOIN z USING (node)""",
    "p6_descendants": f"""{TREE} SELECT u.above AS ancestor, u.node, CAST(t.depth - a.depth AS INTEGER) AS distance FROM u JOIN t USING (node) JOIN t a ON a.node = u.above WHERE t.root IS NOT NULL AND u.above <> u.node""",
    "turn_index": f"WITH {EV} SELECT event_id, CAST(sum(CASE WHEN kind = 'user_message' AND text IS NOT NULL AND trim(text) <> '' THEN 1 ELSE 0 END) OVER ({STREAM}) AS BIGINT) AS turn FROM ev",
    "turn_regressions": f"WITH {EV}, f AS (SELECT session_id, turn_index < lag(turn_index) OVER ({STREAM}) AS fell FROM ev) SELECT session_id, count(*) AS n_regressions FROM f WHERE fell GROUP BY 1",
    "seq_reseq": f"""WITH {EV}, o AS (SELECT session_id, coalesce(min(nullif(ts, '')), '9999-12-31T23:59:59Z') AS t, min(source_path) AS p FROM ev GROUP BY 1)
        SELECT event_id, row_number() OVER (ORDER BY t, p, session_id, seq) AS global_seq FROM ev JOIN o USING (session_id)""",
    "ts_carry_forward": f"""WITH {EV} SELECT event_id, coalesce(last_value(nullif(ts, '') IGNORE NULLS) OVER ({STREAM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(nullif(ts, '') IGNORE NULLS) OVER ({STREAM} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS carried_ts FROM ev""",
    "expected_session_filter": f"""WITH {EV}, x AS (SELECT source_path, max(session_id) AS want FROM ev GROUP BY 1), f AS (SELECT source_path, min((source_line, seq)) AS begins FROM ev JOIN x USING (source_path) WHERE session_id = want GROUP BY 1)
        SELECT event_id, source_path FROM ev JOIN x USING (source_path) JOIN f USING (source_path) WHERE session_id = want AND (source_line, seq) >= begins""",
    "session_contiguity": f"WITH {EV} SELECT session_id, min(event_id) AS first_pos, max(event_id) AS last_pos, count(*) AS n_events FROM ev GROUP BY 1 HAVING max(event_id) - min(event_id) + 1 <> count(*)",
    "union_providers": f"WITH {EV} SELECT event_id, provider, CASE WHEN provider = 'claude' THEN agent_id END AS agent_id, CASE WHEN provider = 'codex' THEN repo_root END AS repo_root FROM ev WHERE provider IN ('claude', 'codex', 'opencode')",
    "kind_histogram": f"WITH {EV} SELECT provider, kind, count(*) AS n FROM ev GROUP BY 1, 2",
    "project_drop": f"WITH {EV} SELECT event_id, kind FROM ev WHERE kind IS NULL OR kind NOT IN ('file_snapshot', 'turn_context', 'compaction')",
    "project_drop_keeping": f"WITH {EV} SELECT kind, count(*) AS n FROM ev WHERE kind IS NULL OR kind <> 'compaction' GROUP BY 1",
    "call_index_join": f"WITH {EV}, {NAMED} SELECT event_id, call_id, tool_name FROM res",
    "project_compress": f"""WITH {EV}, {NAMED} SELECT session_id, seq, turn_index, call_id, tool_name, CAST(strlen(coalesce(tool.output, '')) AS BIGINT) AS output_bytes,
        CAST(length(coalesce(tool.output, '')) - length(replace(coalesce(tool.output, ''), chr(10), '')) + CASE WHEN coalesce(tool.output, '') = '' THEN 0 ELSE 1 END AS BIGINT) AS output_lines,
        left(coalesce({lines("coalesce(tool.output, '')")}[1], ''), 200) AS output_head FROM res WHERE NOT coalesce(tool.is_error, false)""",
    "projection_stats": f"""WITH {EV}, z AS (SELECT kind, kind IN ('file_snapshot', 'turn_context', 'compaction') AS gone, kind = 'tool_result' AND NOT coalesce(tool.is_error, false) AS small,
        60 + strlen(coalesce(text, '')) + strlen(coalesce(tool.input, '')) + strlen(coalesce(tool.output, '')) AS size, least(strlen(coalesce(tool.output, '')), 200) AS head FROM ev),
        y AS (SELECT count(*) FILTER (gone) AS n_dropped, count(*) FILTER (small AND NOT gone) AS n_compressed, count(*) FILTER (NOT gone AND NOT small) AS n_kept, CAST(sum(size) AS BIGINT) AS bytes_in,
        CAST(sum(CASE WHEN gone THEN 0 WHEN small THEN 60 + head ELSE size END) AS BIGINT) AS bytes_out FROM z) SELECT *, CAST(round_even((1 - bytes_out / bytes_in) * 100, 0) AS BIGINT) AS reduction_percent FROM y""",
    "atomic_groups": f"WITH RECURSIVE {EV}, {GROUPS} SELECT event_id, leader FROM g",
    "interleaved_groups": f"WITH RECURSIVE {EV}, {GROUPS} SELECT session_id, seq, leader FROM g",
    "chunk_pack": f"WITH RECURSIVE {EV}, {PACK} SELECT session_id, leader, CAST(size AS BIGINT) AS size, chunk FROM r",
    "chunk_refine": f"WITH RECURSIVE {EV}, {REFINE} SELECT session_id, chunk, half, count(*) AS n FROM h GROUP BY ALL",
    "chunk_manifest": f"""WITH RECURSIVE {EV}, {REFINE} SELECT session_id, min(source_line) AS line_start, max(source_line) AS line_end, CAST(sum(strlen({LINE})) AS BIGINT) AS byte_size, count(*) AS event_count,
        min(nullif(ts, '')) AS range_start, max(nullif(ts, '')) AS range_end, sha256(string_agg({LINE}, '' ORDER BY place)) AS sha256,
        'chunk-' || lpad(CAST(row_number() OVER (PARTITION BY session_id ORDER BY chunk, half) AS VARCHAR), 3, '0') AS chunk_id FROM h GROUP BY session_id, chunk, half""",
    "split_pairs": f"""WITH {EV}, {CHUNKED} SELECT DISTINCT session_id, chunk_id, tool.call_id AS call_id FROM cl a WHERE kind = 'tool_result' AND tool.call_id <> ''
        AND NOT EXISTS (SELECT 1 FROM cl b WHERE b.kind = 'tool_use' AND b.session_id = a.session_id AND b.chunk_id = a.chunk_id AND b.tool.call_id = a.tool.call_id)""",
    "session_card_scalars": f"""WITH {EV} SELECT session_id, arg_min(nullif(provider, ''), seq) FILTER (provider <> '') AS provider, coalesce(arg_min(meta.model, seq) FILTER (kind = 'meta' AND meta.model <> ''), '') AS model,
        min(nullif(ts, '')) AS ts_start, max(nullif(ts, '')) AS ts_end, CAST(CASE WHEN coalesce(max(turn_index), 0) > 0 THEN max(turn_index) WHEN bool_or(kind = 'user_message') THEN 1 ELSE 0 END AS BIGINT) AS turns,
        count(*) AS events, coalesce(string_agg(DISTINCT nullif(agent_id, ''), ',' ORDER BY nullif(agent_id, '')), '') AS subagents FROM ev GROUP BY 1""",
    "card_files": f"""WITH {EV}, f AS (SELECT session_id, file_change.path AS path, string_agg(DISTINCT coalesce(file_change.kind, 'modify'), ',' ORDER BY coalesce(file_change.kind, 'modify')) AS kinds,
        array_to_string(list_sort(list_distinct(list(turn_index) FILTER (turn_index IS NOT NULL))), ',') AS turns FROM ev WHERE kind = 'file_change' AND file_change.path <> '' GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY path) AS rank FROM f) SELECT session_id, path, kinds, coalesce(turns, '') AS turns, rank FROM r WHERE rank <= 50""",
    "card_commands": f"""WITH {EV}, r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rank, left(command.cmd, 200) AS cmd, command.exit_code AS exit_code, turn_index AS turn
        FROM ev WHERE kind = 'command' AND command.cmd <> '') SELECT * FROM r WHERE rank <= 30""",
    "card_errors": f"""WITH {EV}, {ERRORS}, f AS (SELECT session_id, error, min(seq) AS first FROM er WHERE error IS NOT NULL GROUP BY 1, 2), r AS (SELECT session_id, error, row_number() OVER (PARTITION BY session_id ORDER BY first, error) AS rank FROM f)
        SELECT * FROM r WHERE rank <= 20""",
    "card_intents": f"""WITH {EV}, {INTENTS}, i AS (SELECT session_id, seq, {sentence('s', 120)} AS intent FROM said), f AS (SELECT session_id, intent, min(seq) AS first FROM i WHERE intent <> '' GROUP BY 1, 2),
        r AS (SELECT session_id, intent, row_number() OVER (PARTITION BY session_id ORDER BY first, intent) AS rank FROM f) SELECT * FROM r WHERE rank <= 20""",
    "kind_top5": f"""WITH {EV}, k AS (SELECT session_id, kind, count(*) AS n, min(seq) AS first FROM ev GROUP BY 1, 2), r AS (SELECT session_id, kind, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS rank FROM k)
        SELECT * FROM r WHERE rank <= 5""",
    "fallback_narrative": f"""WITH {EV}, {ERRORS}, {INTENTS},
        k AS (SELECT session_id, kind, count(*) AS n, min(seq) AS first FROM ev GROUP BY 1, 2), kr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS rank FROM k),
        ks AS (SELECT session_id, string_agg(kind || ': ' || n, ', ' ORDER BY rank) AS v FROM kr WHERE rank <= 5 GROUP BY 1),
        i AS (SELECT session_id, seq, {sentence('text', 80)} AS intent FROM said), fi AS (SELECT session_id, intent, min(seq) AS first FROM i WHERE intent <> '' GROUP BY 1, 2),
        ri AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first, intent) AS rank FROM fi), si AS (SELECT session_id, string_agg(intent, '; ' ORDER BY rank) AS v FROM ri WHERE rank <= 5 GROUP BY 1),
        ff AS (SELECT session_id, file_change.path AS path, min(seq) AS first FROM ev WHERE kind = 'file_change' AND file_change.path <> '' GROUP BY 1, 2), rf AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first, path) AS rank FROM ff),
        sf AS (SELECT session_id, string_agg(regexp_replace(path, '^.*/', ''), ', ' ORDER BY rank) AS v FROM rf WHERE rank <= 8 GROUP BY 1),
        n AS (SELECT session_id, count(*) AS n, count(*) FILTER (kind = 'command' AND command.cmd <> '') AS c FROM ev GROUP BY 1), e AS (SELECT session_id, count(error) AS x FROM er GROUP BY 1)
        SELECT n.session_id, n.session_id || ': ' || n.n || ' events (' || ks.v || ').' || coalesce(' User intents: ' || si.v || '.', '') || coalesce(' Files: ' || sf.v || '.', '')
        || CASE WHEN c > 0 THEN ' ' || c || ' commands run.' ELSE '' END || CASE WHEN x > 0 THEN ' ' || x || ' error(s).' ELSE '' END AS narrative
        FROM n JOIN ks USING (session_id) JOIN e USING (session_id) LEFT JOIN si USING (session_id) LEFT JOIN sf USING (session_id)""",
    "source_sessions": f"WITH {EV} SELECT provider, source_path, min(nullif(ts, '')) AS first_ts FROM ev WHERE provider <> '' AND source_path <> '' GROUP BY 1, 2",
    "consensus_meta": f"""WITH {EV} SELECT repo_root, CASE WHEN count(DISTINCT nullif(meta.cwd, '')) = 1 THEN max(nullif(meta.cwd, '')) END AS cwd, CASE WHEN count(DISTINCT nullif(meta.model, '')) = 1 THEN max(nullif(meta.model, '')) END AS model,
        CASE WHEN count(DISTINCT nullif(meta.cli_version, '')) = 1 THEN max(nullif(meta.cli_version, '')) END AS cli_version FROM ev WHERE repo_root IS NOT NULL AND kind = 'meta' GROUP BY 1""",
    "session_rollup": f"""WITH {EV}, {LATEST} SELECT l.session_id, l.provider, count(*) FILTER (kind IN ('user_message', 'assistant_message')) AS n_messages,
        CAST(coalesce(sum(length(coalesce(text, ''))) FILTER (kind IN ('user_message', 'assistant_message')), 0) AS BIGINT) AS message_chars, count(*) FILTER (kind IN ('tool_use', 'tool_result')) AS n_parts,
        CAST(coalesce(sum(length(coalesce(tool.output, ''))) FILTER (kind IN ('tool_use', 'tool_result')), 0) AS BIGINT) AS part_chars FROM latest l LEFT JOIN ev USING (session_id) GROUP BY 1, 2""",
    "discover_filter": f"""WITH {LATEST} SELECT session_id, provider, size_bytes FROM latest WHERE size_bytes >= 1024 AND starts_with(cwd, '/home/dev/src/')
        AND CASE WHEN regexp_full_match(timestamp_raw, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\.\\d{{3}}Z') THEN coalesce(TRY_CAST(replace(replace(timestamp_raw, 'T', ' '), 'Z', '') AS TIMESTAMP) >= TIMESTAMP '2026-03-01', true) ELSE true END""",
    "provider_counts": f"WITH {LATEST} SELECT provider, count(*) AS n_sessions, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(line_count) AS BIGINT) AS lines FROM latest GROUP BY 1",
    "summary_coverage": "SELECT session_id, chunk_id, event_count % 2 = 0 AND sha256 IS NOT NULL AS covered FROM chunks",
    "merged_steps": """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) AS step_no, chunk_id,
        CASE WHEN event_count % 2 = 0 AND sha256 IS NOT NULL THEN 'summary' WHEN event_count % 3 = 0 THEN 'fallback' ELSE 'stub' END AS source,
        CASE WHEN event_count % 2 = 0 AND sha256 IS NOT NULL THEN 'told ' || chunk_id WHEN event_count % 3 = 0 THEN 'counted ' || event_count ELSE '' END AS narrative FROM chunks""",
    "subagent_link_explicit": f"""WITH {EV}, s AS (SELECT session_id, agent_id, arg_max(parent_call_id, seq) AS call_id FROM ev WHERE agent_id IS NOT NULL AND parent_call_id IS NOT NULL GROUP BY 1, 2),
        c AS (SELECT session_id, tool.call_id AS call_id, arg_min(coalesce(agent_id, ''), seq) AS parent_agent FROM ev WHERE kind = 'tool_use' AND tool.call_id <> '' GROUP BY 1, 2) SELECT * FROM s JOIN c USING (session_id, call_id)""",
    "subagent_link_single": f"""WITH {EV}, s AS (SELECT session_id, agent_id FROM ev WHERE agent_id IS NOT NULL GROUP BY 1, 2 HAVING max(parent_call_id) IS NULL),
        c AS (SELECT DISTINCT session_id, tool.call_id AS call_id FROM ev a WHERE kind = 'tool_use' AND agent_id IS NULL AND tool.call_id <> '' AND tool.name IN ('Agent', 'Task', 'task', 'agent')
            AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.session_id = a.session_id AND b.parent_call_id = a.tool.call_id))
        SELECT session_id, any_value(agent_id) AS agent_id, any_value(call_id) AS call_id FROM s JOIN c USING (session_id) GROUP BY 1 HAVING count(DISTINCT agent_id) = 1 AND count(DISTINCT call_id) = 1""",
    "subagent_link_time": f"""WITH {EV}, s AS (SELECT session_id, agent_id, min(nullif(ts, '')) AS t FROM ev WHERE agent_id IS NOT NULL AND parent_call_id IS NOT NULL GROUP BY 1, 2),
        w AS (SELECT DISTINCT session_id, parent_call_id AS call_id FROM ev WHERE agent_id IS NOT NULL AND parent_call_id IS NOT NULL),
        c AS (SELECT session_id, tool.call_id AS call_id, min(nullif(ts, '')) AS t FROM ev WHERE kind = 'tool_use' AND tool.call_id <> '' AND (session_id, tool.call_id) IN (SELECT (session_id, call_id) FROM w) GROUP BY 1, 2),
        a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(t, '9999'), agent_id) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM s),
        b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(t, '9999'), call_id) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM c),
        p AS (SELECT a.session_id, agent_id, call_id, bool_and(coalesce(a.t >= b.t, true)) OVER (PARTITION BY a.session_id) AS ok FROM a JOIN b ON a.session_id = b.session_id AND a.r = b.r AND a.n = b.n)
        SELECT session_id, agent_id, call_id FROM p WHERE ok""",
    "pending_diff_attach": f"""WITH {EV} SELECT d.event_id, (SELECT min(a.seq) FROM ev a WHERE a.kind = 'assistant_message' AND a.agent_id IS NULL AND a.session_id = d.session_id AND a.turn_index = d.turn_index) AS after_seq
        FROM ev d WHERE d.kind = 'file_change' AND d.agent_id IS NULL AND d.turn_index IS NOT NULL""",
    "normalized_checks": f"""WITH {EV}, c("check", n_bad) AS (
        SELECT 'missing_seq', count(*) FILTER (seq IS NULL) FROM ev UNION ALL SELECT 'missing_kind', count(*) FILTER (kind IS NULL) FROM ev UNION ALL SELECT 'missing_turn_index', count(*) FILTER (turn_index IS NULL) FROM ev
        UNION ALL SELECT 'missing_ts', count(*) FILTER (ts IS NULL) FROM ev UNION ALL SELECT 'missing_provider', count(*) FILTER (provider IS NULL) FROM ev UNION ALL SELECT 'missing_session_id', count(*) FILTER (session_id IS NULL) FROM ev
        UNION ALL SELECT 'missing_source_path', count(*) FILTER (source_path IS NULL) FROM ev UNION ALL SELECT 'invalid_provider', count(*) FILTER (provider NOT IN ('codex', 'claude', 'opencode')) FROM ev
        UNION ALL SELECT 'empty_session', count(*) FILTER (session_id IS NULL OR session_id = '') FROM ev UNION ALL SELECT 'meta_turn', count(*) FILTER (kind = 'meta' AND turn_index <> 0) FROM ev
        UNION ALL SELECT 'first_user_turn', count(*) FROM (SELECT turn_index, row_number() OVER ({STREAM}) AS r FROM ev WHERE kind = 'user_message') WHERE r = 1 AND turn_index <> 1
        UNION ALL SELECT 'turn_regression', count(*) FILTER (fell) FROM (SELECT turn_index < lag(turn_index) OVER ({STREAM}) AS fell FROM ev)
        UNION ALL SELECT 'orphan_tool_use', count(*) FROM (SELECT tool.call_id AS i FROM ev WHERE kind = 'tool_use' AND tool.call_id <> '' EXCEPT SELECT tool.call_id FROM ev WHERE kind = 'tool_result' AND tool.call_id <> '')
        UNION ALL SELECT 'empty_input', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM ev
        UNION ALL SELECT 'seq_not_rising', count(*) FILTER (bad) FROM (SELECT seq <= lag(seq) OVER (PARTITION BY source_path ORDER BY source_line, seq) AS bad FROM ev)
        UNION ALL SELECT 'not_contiguous', count(*) FROM (SELECT session_id FROM ev GROUP BY 1 HAVING max(event_id) - min(event_id) + 1 <> count(*)))
        SELECT "check", n_bad, n_bad = 0 AS passed FROM c""",
    "strip_text": """SELECT event_id, CASE WHEN length(text) > 1000 AND regexp_full_match(text, '[A-Za-z0-9+/=\\n\\r]+') THEN '[BASE64: ' || length(text) || ' bytes, source: ' || source_path || ':' || source_line || ']'
        WHEN length(text) > 4000 THEN left(text, 4000) || '... [TRUNCATED at ' || length(text) || ' bytes, source: ' || source_path || ':' || source_line || ']' ELSE text END AS text FROM session_events WHERE text IS NOT NULL""",
    "json_tree_strip": """WITH t AS (SELECT e.event_id, j.id, json_extract_string(j.atom, '$') AS v, ' bytes, source: ' || e.source_path || ':' || e.source_line || ']' AS tail
            FROM (SELECT * FROM session_events WHERE json_valid(tool.input)) e, json_tree(e.tool.input) j WHERE j.type = 'VARCHAR'),
        m AS (SELECT event_id, id, CASE WHEN length(v) > 1000 AND regexp_full_match(v, '[A-Za-z0-9+/=\\n\\r]+') THEN '[BASE64: ' || length(v) || tail ELSE left(v, 200) || '... [TRUNCATED at ' || length(v) || tail END AS marker FROM t WHERE length(v) > 200)
        SELECT event_id, count(*) AS n_markers, string_agg(marker, chr(10) ORDER BY id) AS markers FROM m GROUP BY 1""",
    "first_sentence_card": f"WITH d AS (SELECT doc_id, {strip('text')} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, {sentence('s', 120)} AS sentence FROM d",
    "first_sentence_merge": f"SELECT doc_id, {sentence('text', 80)} AS sentence FROM documents WHERE text IS NOT NULL",
    "first_meaningful_line": f"""SELECT doc_id, coalesce({lines('text')}[1], '') AS line, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' THEN 0 ELSE 1 END AS BIGINT) AS n_lines FROM documents WHERE text IS NOT NULL""",
    "coerce_int": f"""WITH w AS (SELECT event_id, unnest(string_split(command.output_preview, ' ')) AS word, generate_subscripts(string_split(command.output_preview, ' '), 1) - 1 AS place FROM session_events WHERE command.output_preview IS NOT NULL)
        SELECT event_id, CAST(place AS INTEGER) AS place, TRY_CAST({strip('word')} AS BIGINT) AS number FROM w WHERE regexp_full_match({strip('word')}, '[+-]?\\d+') AND TRY_CAST({strip('word')} AS BIGINT) IS NOT NULL""",
    "command_status_parse": f"""SELECT event_id, CASE WHEN regexp_matches({strip('command.cmd')}, '(?i)\\[(pass|fail)\\]$') AND command.exit_code IS NULL THEN regexp_replace({strip('command.cmd')}, '(?i)\\s*\\[(pass|fail)\\]$', '')
        WHEN command.exit_code IS NULL THEN {strip('command.cmd')} ELSE regexp_replace({strip('command.cmd')}, '\\s*$', '') END AS cmd, CASE WHEN command.exit_code IS NULL OR command.exit_code = 0 THEN 'pass' ELSE 'fail' END AS status
        FROM session_events WHERE command.cmd <> ''""",
    "screenshot_paths": """WITH m AS (SELECT doc_id, regexp_extract_all(text, '/\\S+\\.(?:py|go|rs|java)') AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(p) AS path, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS place FROM m""",
    "slug": f"WITH {LATEST} SELECT session_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM latest WHERE title IS NOT NULL",
    "html_escape": "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM documents WHERE text IS NOT NULL",
    "epoch_ms_iso": """SELECT session_row, CASE WHEN timestamp_raw::BIGINT % 1000 = 0 THEN strftime(make_timestamp(timestamp_raw::BIGINT * 1000), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(timestamp_raw::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso
        FROM sessions WHERE regexp_full_match(timestamp_raw, '\\d{13}')""",
    "before_after_roles": f"""WITH {EV}, s AS (SELECT event_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY session_id, file_change.path) AS n FROM ev WHERE file_change.path IS NOT NULL WINDOW w AS (PARTITION BY session_id, file_change.path ORDER BY seq))
        SELECT event_id, CASE WHEN n > 1 AND r = 1 THEN 'before' WHEN n > 1 AND r = n THEN 'after' ELSE 'standalone' END AS role FROM s""",
    "route_step_match": f"""WITH {EV}, {STEPS}, q AS (SELECT DISTINCT split_part(file_change.path, '/', 1) AS query FROM ev WHERE file_change.path IS NOT NULL AND length(split_part(file_change.path, '/', 1)) BETWEEN 3 AND 12),
        s AS (SELECT query, doc_id AS step_no, CAST(CASE WHEN contains(lower(title), query) THEN 3 ELSE 0 END + CASE WHEN contains(body, query || '/') THEN 2 ELSE 0 END AS BIGINT) AS score FROM q, steps),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, step_no) AS k FROM s) SELECT query, step_no, score FROM r WHERE k = 1""",
    "round_robin_index": f"WITH {STEPS} SELECT report, doc_id, step_no AS round FROM steps ORDER BY step_no, report LIMIT 40",
    "view_mode": """SELECT doc_id, CASE WHEN lang = 'de' THEN 'end-state' WHEN doc_kind = 'plan' THEN 'journey' WHEN doc_kind = 'readme' THEN 'end-state' ELSE 'both' END AS view FROM documents""",
    "step_order": f"WITH {STEPS} SELECT doc_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(title, 'Step (\\d+)', 1), '') AS INTEGER), 900 + step_no) AS BIGINT) AS place FROM steps",
    "evidence_scent": f"""WITH {EV}, n AS (SELECT session_id, count(DISTINCT file_change.path) AS f, count(*) FILTER (file_change.diff IS NOT NULL) AS d, count(*) FILTER (command.cmd <> '') AS c, count(*) FILTER (command.exit_code <> 0) AS x, count(*) FILTER (kind = 'screenshot') AS s FROM ev GROUP BY 1)
        SELECT session_id, coalesce(nullif(concat_ws(' · ', CASE WHEN f > 0 THEN f || CASE WHEN f = 1 THEN ' file' ELSE ' files' END END, CASE WHEN d > 0 THEN d || CASE WHEN d = 1 THEN ' diff' ELSE ' diffs' END END,
        CASE WHEN c > 0 THEN c || CASE WHEN c = 1 THEN ' cmd' ELSE ' cmds' END END, CASE WHEN x > 0 THEN x || ' failed' END, CASE WHEN s > 0 THEN s || CASE WHEN s = 1 THEN ' shot' ELSE ' shots' END END), ''), 'View Evidence') AS scent FROM n""",
    "noisy_paths": f"""WITH {CHANGED} SELECT event_id, path = '' OR starts_with(path, '/tmp/') OR contains(path, '/.claude/') OR contains(path, '/.codex/') OR starts_with(lower(regexp_replace(path, '^.*/', '')), '.env')
        OR (contains(lower(regexp_replace(path, '^.*/', '')), 'worklog') AND ends_with(lower(path), '.md')) OR (starts_with(path, '/') AND root <> '' AND path <> root AND NOT starts_with(path, root || '/')) AS noisy FROM ch""",
    "displayable_refs": f"""WITH {CHANGED}, p AS (SELECT event_id, path, root, CASE WHEN starts_with(path, '/') OR root = '' THEN path ELSE root || '/' || regexp_replace(path, '^\\./', '') END AS full_path FROM ch),
        i AS (SELECT *, root <> '' AND starts_with(full_path, root || '/') AS inside, CASE WHEN root <> '' AND starts_with(full_path, root || '/') THEN substr(full_path, length(root) + 2) ELSE regexp_replace(path, '^\\./', '') END AS label FROM p)
        SELECT event_id, NOT (path = '' OR starts_with(lower(regexp_replace(label, '^.*/', '')), '.env') OR (contains(lower(regexp_replace(label, '^.*/', '')), 'worklog') AND ends_with(lower(label), '.md')) OR starts_with(label, 'e2e-test-results/')
        OR (starts_with(full_path, '/tmp/') AND NOT inside) OR (root <> '' AND starts_with(full_path, '/') AND NOT inside) OR (inside AND split_part(label, '/', 1) NOT IN ('src', 'e2e', 'scripts', 'docs', 'db', 'repos', 'likec4'))) AS shown FROM i""",
    "shared_ranges": "SELECT chunk_id AS source_path, line_start, line_end, count(*) AS n_refs FROM chunks GROUP BY ALL HAVING count(*) >= 3",
    "text_lints": """SELECT count(*) FILTER (regexp_matches(text, '(?i)^\\s*chunk-\\d+\\b')) AS chunk_title, count(*) FILTER (regexp_matches(text, '(?i)\\b\\d+\\s+events\\b')) AS event_count,
        count(*) FILTER (regexp_matches(text, '(?i)<(?:environment_context|local-command-caveat)>|#\\s*AGENTS\\b|continued from a previous conversation')) AS raw_intent,
        count(*) FILTER (regexp_matches(text, '(?i)^\\s*(this chunk|chunk-\\d+|n/a|none|todo)\\b')) AS generic FROM documents""",
    "glossary_dead_terms": r"""WITH t AS (SELECT handle AS term FROM contributors UNION SELECT suite FROM eval_items), w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents WHERE text IS NOT NULL)
        SELECT term, count(doc_id) AS n_texts FROM t LEFT JOIN w ON word = lower(term) GROUP BY 1""",
    "diff_counts": f"""WITH {EV}, l AS (SELECT file_change.path AS path, unnest(string_split(file_change.diff, chr(10))) AS x FROM ev WHERE file_change.diff IS NOT NULL)
        SELECT path, count(*) FILTER (starts_with(x, '+') AND NOT starts_with(x, '+++')) AS n_added, count(*) FILTER (starts_with(x, '-') AND NOT starts_with(x, '---')) AS n_removed FROM l GROUP BY 1""",
    "view_stats": """WITH w AS (SELECT doc_kind, len(list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_kind, count(*) AS n, CAST(sum(w.n) AS BIGINT) AS n_words FROM w GROUP BY 1)
        SELECT *, (n_words + 199) // 200 AS minutes FROM s""",
    "prose_path_links": f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{PATHS}')) AS path FROM documents WHERE text IS NOT NULL",
    "glossary_cap": f"""WITH p AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(text, '{PATHS}')) AS path FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source, path ORDER BY doc_id) AS rank FROM p)
        SELECT * FROM r WHERE rank <= 4""",
    "skim_slice": f"""WITH {STEPS}, s AS (SELECT report, step_no, title, {strip('body')} AS b FROM steps), t AS (SELECT report, step_no, title, {sentence('b', 120)} AS takeaway FROM s),
        a AS (SELECT report, string_agg(step_no || '. ' || title || CASE WHEN takeaway <> '' THEN ' - ' || takeaway ELSE '' END, chr(10) ORDER BY step_no) AS slice FROM t GROUP BY 1) SELECT report, md5(slice) AS slice_md5, CAST(length(slice) AS BIGINT) AS n_chars FROM a""",
    "capture_skip": """WITH c AS (SELECT event_id, command.exit_code + 399 AS status, provider, text FROM session_events WHERE kind IS NOT NULL), r AS (SELECT event_id, CASE WHEN status >= 400 THEN 'http_status_' || status WHEN provider = 'codex' THEN 'json_response'
        WHEN starts_with(regexp_replace(left(trim(coalesce(text, '')), 2000), '\\s+', '', 'g'), '{') AND contains(text, '"status":500') AND contains(text, '"unhandled":true') THEN 'error_payload' END AS reason FROM c) SELECT * FROM r WHERE reason IS NOT NULL""",
    "svg_safety": r"""WITH d AS (SELECT doc_id, '<svg>' || CASE doc_id % 3 WHEN 0 THEN '<script>' WHEN 1 THEN '<g onload = x>' ELSE '' END || text || '</svg>' AS s FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(CASE WHEN regexp_matches(s, '<\s*script\b|\son\w+\s*=|(href|xlink:href)\s*=\s*[''"]\s*javascript:', 'i') THEN 0 ELSE length(s) END AS BIGINT) AS n_chars FROM d""",
    "sha_tokens": r"""WITH m AS (SELECT event_id, regexp_extract_all(text, '\b[0-9a-f]{7,40}\b') AS x FROM session_events WHERE regexp_matches(lower(text), 'git|commit')) SELECT event_id, array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: list_position(x, x[i]) = i), lambda i: x[i]), ',') AS shas FROM m WHERE len(x) > 0""",
    "route_tokens": r"""WITH m AS (SELECT event_id, list_filter(regexp_split_to_array(lower(split_part(file_change.path, '?', 1)), '[/:._-]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\d+') AND w NOT IN ('http', 'https', 'localhost', 'www')) AS x FROM session_events WHERE file_change.path IS NOT NULL)
        SELECT event_id, array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: list_position(x, x[i]) = i), lambda i: x[i]), ',') AS tokens FROM m""",
    "teaser": f"""WITH {STEPS}, s AS (SELECT doc_id, coalesce(nullif({strip("regexp_replace(body, '" + SPACE + "+', ' ', 'g')")}, ''), nullif({strip("regexp_replace(title, '" + SPACE + "+', ' ', 'g')")}, ''), '') AS s FROM steps),
        h AS (SELECT *, left(s, 181) AS h FROM s), b AS (SELECT *, CASE WHEN contains(h, ' ') THEN length(h) - position(' ' IN reverse(h)) ELSE -1 END AS b FROM h)
        SELECT doc_id, CASE WHEN length(s) <= 180 THEN s ELSE regexp_replace(left(s, CASE WHEN b < 117 THEN 180 ELSE b END), '[ .,;:]+$', '') || '...' END AS teaser FROM b""",
    "link_map_match": f"""WITH {EV}, t AS (SELECT DISTINCT file_change.path AS token FROM ev WHERE file_change.path <> ''), w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_./-]+')) AS token FROM documents WHERE text IS NOT NULL)
        SELECT token, count(*) AS n_places, count(DISTINCT doc_id) AS n_docs FROM w JOIN t USING (token) GROUP BY 1""",
    "glossary_faults": """WITH e AS (SELECT trim(given_name) AS term, team, handle, row_number() OVER (PARTITION BY lower(trim(given_name)) ORDER BY person_id) AS n FROM contributors WHERE coalesce(team, '') <> ''),
        w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS word FROM documents WHERE text IS NOT NULL),
        c AS (SELECT e.*, list_filter(regexp_split_to_array(lower(term), '[^a-z0-9_]+'), lambda x: x <> '') AS parts FROM e),
        d AS (SELECT ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL AND len(text) > 0)
        SELECT 'all' AS report, given_name AS term, 'incomplete' AS fault FROM contributors WHERE coalesce(team, '') = '' UNION ALL SELECT 'all', term, 'duplicate' FROM e WHERE n > 1
        UNION ALL SELECT 'all', term, 'dead' FROM c WHERE n = 1 AND lower(handle) NOT IN (SELECT word FROM w) AND (len(parts) = 0 OR CASE WHEN len(parts) = 1 THEN parts[1] NOT IN (SELECT word FROM w) ELSE NOT EXISTS (SELECT 1 FROM d WHERE contains(d.t, ' ' || array_to_string(parts, ' ') || ' ')) END)""",
    "undeclared_refs": f"""WITH {EV}, {LATEST}, n AS (SELECT provider, unnest([source_path, regexp_replace(source_path, '^.*/', '')]) AS name FROM latest WHERE source_path <> '')
        SELECT DISTINCT provider AS report, source_path AS path FROM ev WHERE provider IN (SELECT provider FROM n) AND (provider, source_path) NOT IN (SELECT (provider, name) FROM n) AND (provider, regexp_replace(source_path, '^.*/', '')) NOT IN (SELECT (provider, name) FROM n)""",
    "visible_items": "SELECT doc_kind, count(*) AS n FROM documents WHERE doc_kind IS NULL OR doc_kind <> 'readme' GROUP BY 1",
    "kinds_seen": "SELECT kind AS spelling, lower(trim(kind)) AS kind, count(*) AS n FROM session_events GROUP BY 1, 2",
    "tool_pair_orphans": f"""WITH {EV}, {CHUNKED} SELECT session_id, chunk_id, tool.call_id AS call_id, count(*) AS n_uses FROM cl a WHERE kind = 'tool_use' AND tool.call_id <> ''
        AND NOT EXISTS (SELECT 1 FROM cl b WHERE b.kind = 'tool_result' AND b.session_id = a.session_id AND b.chunk_id = a.chunk_id AND b.tool.call_id = a.tool.call_id) GROUP BY 1, 2, 3""",
    "ref_bounds": f"""WITH {LATEST}, b AS (SELECT chunk_key, CASE WHEN l.line_count IS NULL THEN 'undeclared' WHEN line_start < 1 OR line_start > line_end OR line_end > l.line_count THEN 'out_of_bounds' WHEN line_end - line_start > 30 THEN 'too_wide' END AS fault
        FROM chunks c LEFT JOIN latest l ON l.session_id = c.session_id) SELECT chunk_key, fault FROM b WHERE fault IS NOT NULL""",
    "projected_checks": f"""WITH {EV}, k AS (SELECT *, kind IN ('file_snapshot', 'turn_context', 'compaction') AS noise, coalesce(tool.is_error, false) AS failed FROM ev),
        c("check", n_bad, stage) AS (SELECT 'kept_' || x, (SELECT count(*) FROM k WHERE kind = x), 'before' FROM (VALUES ('file_snapshot'), ('turn_context'), ('compaction')) t(x)
            UNION ALL SELECT 'kept_' || x, (SELECT count(*) FROM k WHERE kind = x AND NOT noise), 'after' FROM (VALUES ('file_snapshot'), ('turn_context'), ('compaction')) t(x)
            UNION ALL SELECT 'uncompressed_result', count(*) FILTER (kind = 'tool_result' AND NOT failed), 'before' FROM k UNION ALL SELECT 'uncompressed_result', count(*) FILTER (kind = 'tool_result' AND NOT failed AND noise), 'after' FROM k
            UNION ALL SELECT x, 0, y FROM (VALUES ('compressed_error'), ('kept_data')) t(x), (VALUES ('before'), ('after')) u(y)
            UNION ALL SELECT 'empty_input', (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM k), y FROM (VALUES ('before'), ('after')) u(y)) SELECT "check", CAST(n_bad AS BIGINT) AS n_bad, n_bad = 0 AS passed, stage FROM c""",
    "chunk_checks": f"""WITH {EV}, {CHUNKED}, n AS (SELECT session_id, chunk_id, count(*) AS n FROM cl GROUP BY 1, 2), b AS (SELECT c.*, n.n FROM chunks c LEFT JOIN n USING (session_id, chunk_id)),
        sp AS (SELECT DISTINCT session_id, chunk_id, tool.call_id AS i FROM cl a WHERE kind = 'tool_result' AND tool.call_id <> '' AND NOT EXISTS (SELECT 1 FROM cl b WHERE b.kind = 'tool_use' AND b.session_id = a.session_id AND b.chunk_id = a.chunk_id AND b.tool.call_id = a.tool.call_id)),
        c("check", n_bad) AS (SELECT 'missing_hash', count(*) FILTER (sha256 IS NULL) FROM b UNION ALL SELECT 'bad_range', count(*) FILTER (line_start > line_end) FROM b UNION ALL SELECT 'no_rows', count(*) FILTER (n IS NULL) FROM b
        UNION ALL SELECT 'wrong_count', count(*) FILTER (n <> event_count) FROM b UNION ALL SELECT 'split_pair', count(*) FROM sp UNION ALL SELECT 'empty_input', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM b) SELECT "check", n_bad, n_bad = 0 AS passed FROM c""",
    "density_estimate": f"WITH {GATE} SELECT doc_id, CAST(hundredths AS BIGINT) AS hundredths, hundredths > 180000 AS too_tall FROM px",
    "overview_density": f"WITH {GATE} SELECT report, CAST(hundredths AS BIGINT) AS hundredths FROM oh",
    "gate_faults": f"WITH {FAULTS} SELECT report, severity, fault, count(*) AS n FROM ft GROUP BY ALL",
    "quality_gate": f"WITH {FAULTS}, n AS (SELECT report, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM ft GROUP BY 1) SELECT ov.report, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings, coalesce(n_errors, 0) = 0 AS ok FROM ov LEFT JOIN n USING (report)",
    "grounded_refs": f"WITH {GATE} SELECT doc_id, grounded FROM px",
    "fault_examples": f"""WITH {STEPS}, d AS (SELECT report, title, min(step_no) AS f FROM steps GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY f, title) AS k FROM d)
        SELECT report, string_agg(title, ', ' ORDER BY k) FILTER (k <= 3) || CASE WHEN max(k) > 3 THEN ', ...' ELSE '' END AS examples FROM r GROUP BY 1""",
    "monoculture": f"WITH {GATE}, c AS (SELECT report, CASE WHEN regexp_matches(x, '[0-9]') THEN 'grounded' ELSE 'inferred' END AS k FROM (SELECT report, unnest(claims) AS x FROM px)) SELECT report, count(*) AS n, count(DISTINCT k) AS n_kinds, count(*) >= 20 AND count(DISTINCT k) = 1 AND min(k) = 'grounded' AS uniform FROM c GROUP BY 1",
    "media_lints": f"""WITH {EV}, {STEPS}, n AS (SELECT report, CAST(doc_id AS VARCHAR) AS label, regexp_extract_all(body, '{PATHS}') AS p FROM steps), f AS (SELECT file_change.path AS path, count(*) * 8000000 AS size FROM ev WHERE file_change.path IS NOT NULL GROUP BY 1),
        v AS (SELECT report, label, p[1] AS pic, list_sort(list_distinct(p)) AS q, p FROM n), w AS (SELECT report, label, list_filter(p, lambda x, i: list_position(p, x) = i)[-1] AS film FROM v),
        t AS (SELECT source AS report, count(*) FILTER (doc_kind = 'readme') AS terms FROM documents WHERE source IS NOT NULL GROUP BY 1)
        SELECT report, label, 'video_not_found' AS fault FROM w WHERE film IS NOT NULL AND film NOT IN (SELECT path FROM f) UNION ALL SELECT report, label, 'video_too_large_to_embed' FROM w JOIN f ON film = path WHERE size > 15728640
        UNION ALL SELECT report, 'report', 'no_glossary' FROM t WHERE terms = 0 UNION ALL SELECT report, 'report', 'no_diagram' FROM t WHERE report NOT IN (SELECT report FROM v WHERE pic IS NOT NULL)""",
    "glossary_shapes": "SELECT DISTINCT 'list' AS report, handle AS term, given_name AS definition FROM contributors WHERE handle IS NOT NULL AND given_name IS NOT NULL UNION ALL SELECT 'map', handle, min(given_name) FROM contributors WHERE handle IS NOT NULL AND given_name IS NOT NULL GROUP BY handle",
    "search_steps": f"WITH {STEPS} SELECT doc_id FROM steps WHERE contains(lower(title), 'cache') OR contains(lower(body), 'cache')",
    "view_totals": r"""WITH d AS (SELECT doc_kind, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents WHERE text IS NOT NULL)
        SELECT 'journey' AS view, count(*) AS n_items, CAST(sum(w) AS BIGINT) AS n_words FROM d WHERE coalesce(doc_kind, '') <> 'readme' UNION ALL SELECT 'end-state', count(*), CAST(sum(w) AS BIGINT) FROM d WHERE coalesce(doc_kind, '') <> 'plan'""",
    "chunk_providers": f"""WITH {EV}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) AS k FROM chunks) WHERE k = 1)
        SELECT c.session_id, coalesce(nullif(arg_min(ev.provider, ev.seq), ''), 'unknown') AS provider FROM c LEFT JOIN ev ON ev.session_id = c.session_id AND source_line BETWEEN line_start AND line_end GROUP BY 1""",
    "jsonl_roundtrip": f"WITH {EV} SELECT event_id, kind, turn_index, md5(text) AS text_md5 FROM ev",
    "chunk_files": f"WITH {EV}, {CHUNKED} SELECT session_id, chunk_id, count(*) AS n_lines, CAST(sum(strlen(seq || '|' || kind)) AS BIGINT) AS n_bytes FROM cl GROUP BY 1, 2",
    "capture_manifest": f"""WITH {EV}, s AS (SELECT event_id, repo_root AS r, coalesce(file_change.kind = 'delete', false) AS gone FROM ev WHERE file_change.path IS NOT NULL AND repo_root IS NOT NULL), c AS (SELECT r, min(event_id) AS f, count(*) AS n FROM s WHERE NOT gone GROUP BY 1)
        SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS at, r AS "commit", n AS n_shots, (SELECT count(*) FROM s WHERE gone) AS n_skipped FROM c""",
}
