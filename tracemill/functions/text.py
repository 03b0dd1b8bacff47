"""Text functions of the reference as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Python's str.strip and str.splitlines know it.
SPACE = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    return F.regexp_replace(_c(x), f"^{SPACE}+|{SPACE}+$", "")


def split_lines(x) -> Column:
    """Lines without their ends; no empty last one, and none for the empty string."""
    lines = F.split(_c(x), LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def first_sentence(x, cap: int = 120, stripped: bool = True) -> Column:
    """Up to the first full stop anywhere, else exclamation mark, else question mark, else the first ``cap`` characters."""
    s = strip(x) if stripped else _c(x)
    out = F.concat(F.substring(s, 1, cap), F.when(F.length(s) > cap, "...").otherwise(""))
    for end in "?!.":
        out = F.when(F.instr(s, end) > 0, F.substring(s, F.lit(1), F.instr(s, end))).otherwise(out)
    return F.when(s == "", "").otherwise(out)


def first_meaningful_line(x) -> Column:
    found = F.filter(F.transform(split_lines(x), strip), lambda line: line != "")
    return F.coalesce(F.get(found, 0), F.when(_c(x).isNotNull(), ""))


def output_lines(x) -> Column:
    return F.length(_c(x)) - F.length(F.replace(_c(x), F.lit("\n"), F.lit(""))) + F.when(_c(x) == "", 0).otherwise(1)


def base_name(x) -> Column:
    return F.substring_index(_c(x), "/", -1)


def truncate_words(x, cap: int = 180) -> Column:
    """Collapse whitespace; cut at the last word break if that keeps at least 65 %, else at ``cap``; trailing ` .,;:` go, three dots come."""
    s = strip(F.regexp_replace(_c(x), f"{SPACE}+", " "))
    head = F.substring(s, 1, cap + 1)
    at = F.when(F.instr(head, " ") > 0, F.length(head) - F.instr(F.reverse(head), " ")).otherwise(-1)
    cut = F.substring(s, F.lit(1), F.when(at < int(cap * 0.65), cap).otherwise(at))
    return F.when(F.length(s) <= cap, s).otherwise(F.concat(F.regexp_replace(cut, r"[ .,;:]+$", ""), F.lit("...")))


def html_escape(x) -> Column:
    s = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def coerce_int(x) -> Column:
    """Whole numbers with a sign; anything else null."""
    return F.when(strip(x).rlike(r"^[+-]?\d+$"), strip(x).try_cast("long"))


def command_status(x) -> Column:
    """``cmd [pass|fail]`` as struct(cmd, status); pass if it isn't said."""
    s = strip(x)
    said = F.lower(F.regexp_extract(s, r"(?i)\s*\[(pass|fail)\]$", 1))
    return F.struct(F.regexp_replace(s, r"(?i)\s*\[(pass|fail)\]$", "").alias("cmd"), F.when(said == "", "pass").otherwise(said).alias("status"))


def sha_tokens(x) -> Column:
    """Distinct words that look like commit ids, in order, where git or commit is spoken of."""
    s = _c(x)
    return F.when(F.lower(s).rlike("git|commit"), F.array_distinct(F.regexp_extract_all(s, F.lit(r"\b([0-9a-f]{7,40})\b"), 1))).otherwise(F.array().cast("array<string>"))


#: Parts of addresses that say nothing about a route.
ROUTE_STOP = ("http", "https", "localhost", "127", "0", "www")


def route_tokens(x, stop: tuple[str, ...] = ROUTE_STOP) -> Column:
    """The distinct telling words of a route, in order."""
    words = F.split(F.lower(F.substring_index(_c(x), "?", 1)), r"[/:._-]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$") & ~w.isin(*stop)))


def synthetic_diff(old, new, path) -> Column:
    """A header and all old lines with ``-``, all new ones with ``+``."""
    a, b = split_lines(F.coalesce(_c(old), F.lit(""))), split_lines(F.coalesce(_c(new), F.lit("")))
    head = F.concat(F.lit("--- a/"), _c(path), F.lit("\n+++ b/"), _c(path), F.lit("\n@@ -1,"), F.size(a).cast("string"), F.lit(" +1,"), F.size(b).cast("string"), F.lit(" @@"))
    return F.array_join(F.concat(F.array(head), F.transform(a, lambda x: F.concat(F.lit("-"), x)), F.transform(b, lambda x: F.concat(F.lit("+"), x))), "\n")


def epoch_ms_iso(x) -> Column:
    """Milliseconds since 1970 as ISO time in UTC, with six digits only where there is a fraction; '' if not a number."""
    ms = _c(x).try_cast("long")
    at = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    shape = F.when(ms % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.when(ms.isNull(), "").otherwise(shape)


def editor_link(path, scheme: str = "vscode") -> Column:
    """A link that opens a file: the path percent-encoded but for its slashes; '' for none."""
    encoded = F.replace(F.replace(F.url_encode(_c(path)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.when(F.coalesce(_c(path), F.lit("")) == "", "").otherwise(F.concat(F.lit(f"{scheme}://file/"), encoded))


def script_json(x) -> Column:
    """JSON that may stand within a script element."""
    s = _c(x)
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def since(text: str, now) -> Column:
    """``7d`` before ``now``, or a time as ISO has it, without zone in UTC."""
    import re

    days = re.fullmatch(r"(\d+)d", text.strip())
    if days:
        return F.lit(now) - F.make_interval(days=F.lit(int(days.group(1))))
    return F.to_timestamp(F.lit(text if re.search(r"(?:Z|[+-]\d\d:?\d\d)$", text) else text + ("Z" if "T" in text else "T00:00:00Z")))
