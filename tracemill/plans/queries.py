"""The registry of core queries: name -> (query, SQL or None)."""

from __future__ import annotations

from tracemill.operators import hierarchy, schema_drift, timestamps
from tracemill.plans.event_queries import QUERIES
from tracemill.plans.oracles import SQL

PROBLEMS = {
    "p2_found": schema_drift.p2_found, "p2_events": schema_drift.p2_events, "p2_fingerprints": schema_drift.p2_fingerprints,
    "p4_found": timestamps.p4_found, "p4_report": timestamps.p4_report,
    "p6_found": hierarchy.p6_found, "p6_tree": hierarchy.p6_tree, "p6_descendants": hierarchy.p6_descendants,
}
CORE: dict = {name: (fn, SQL.get(name)) for name, fn in {**PROBLEMS, **QUERIES}.items()}
