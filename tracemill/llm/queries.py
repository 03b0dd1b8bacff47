"""The registry of this package's queries: name -> (query, SQL or None)."""

from __future__ import annotations

from tracemill.llm import conversations, credentials, leakage, packing, pii, spans, splitting
from tracemill.llm.oracles import SQL

LLM: dict = {
    "p1_found": (credentials.p1_found, None),
    "p1_redacted": (credentials.p1_redacted, None),
    "p3_found": (splitting.p3_found, SQL["p3_found"]),
    "p3_pieces": (splitting.p3_pieces, None),
    "p5_found": (pii.p5_found, None),
    "p5_redacted": (pii.p5_redacted, None),
    "p7_found": (conversations.p7_found, SQL["p7_found"]),
    "p7_conversations": (conversations.p7_conversations, None),
    "p8_packed": (packing.p8_packed, None),
    "p9_found": (leakage.p9_found, None),
    "p9_report": (leakage.p9_report, None),
    "p10_found": (spans.p10_found, None),
    "p10_spans": (spans.p10_spans, None),
}
