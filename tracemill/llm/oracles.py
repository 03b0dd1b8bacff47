"""SQL equals of the queries that SQL can express on whole tables."""

from __future__ import annotations

SQL = {
    "p3_found": """WITH o AS (SELECT session_id, coalesce(agent_id, '') AS agent_id, seq, min(event_id) AS first FROM session_events WHERE text IS NOT NULL GROUP BY 1, 2, 3),
        d AS (SELECT o.session_id, o.agent_id, o.seq, s.turn_index, strlen(s.text) AS n FROM o JOIN session_events s ON s.event_id = o.first)
        SELECT session_id, agent_id, CAST(coalesce(turn_index, -1) AS INTEGER) AS turn_index, seq FROM d WHERE n > 4000
        UNION ALL SELECT session_id, agent_id, turn_index, CAST(-1 AS BIGINT) FROM d WHERE turn_index IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(n) > 12000""",
    "p7_found": r"""WITH r AS (SELECT session_id, seq, lower(trim(kind)) AS k, turn_index AS t, row_number() OVER (PARTITION BY session_id, seq ORDER BY event_id) AS n FROM session_events
            WHERE agent_id IS NULL AND lower(trim(kind)) IN ('user_message', 'assistant_message') AND text IS NOT NULL AND regexp_matches(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')),
        m AS (SELECT * FROM r WHERE n = 1), x AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM m WHERE t IS NOT NULL)
        SELECT DISTINCT session_id, 'empty' AS reason FROM session_events WHERE agent_id IS NULL AND session_id NOT IN (SELECT session_id FROM m)
        UNION ALL SELECT session_id, 'no_opening' FROM m GROUP BY 1 HAVING arg_min(k, seq) <> 'user_message'
        UNION ALL SELECT session_id, 'turn_regress' FROM x GROUP BY 1 HAVING bool_or(t < before)
        UNION ALL SELECT session_id, 'turn_gap' FROM x GROUP BY 1 HAVING min(t) <> 1 OR max(t) <> count(DISTINCT t)
        UNION ALL SELECT DISTINCT session_id, 'missing_reply' FROM (SELECT session_id, t FROM x GROUP BY 1, 2 HAVING bool_or(k = 'user_message') AND NOT bool_or(k = 'assistant_message'))""",
}
