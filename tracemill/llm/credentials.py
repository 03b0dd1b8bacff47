"""Credentials in free text, code and tool calls (problem 1).

A keyword automaton (Aho-Corasick) passes only values that hold some cue; of those the text around the
cues is searched with anchored expressions for issuer formats, key blocks, assignments, headers, URLs, command
lines and prose; candidates are then validated: by the checksum of issuers that have one, by decoding (the header of a JSON web
token, the alphabet of an access key id), else by their variety. Redaction puts placeholders of the same
length and the same alphabet in their place - hex stays hex, base32 stays base32 - so that the code around them parses as before.

Defined results
* Null and empty values have no secrets; a value found twice in a field is one row, redacted at each place.
* ``tool.input`` is JSON text, perhaps cut off: it is searched as its unescaped text, and places are
  mapped back, so secrets come out with their escapes. Very long values are searched whole.
* Placeholders, masked values, variable references, lookups in stores, public keys, digests and ids are none.
* Tokens and the names before them may be of any length. Between a cue in a sentence or on a command line and its value may
  stand as many characters as the patterns say; a quoted value reaches to the end of its line at most.
* A token whose checksum is wrong still counts where its variety is that of a secret, as tokens are typed and cut wrongly;
  ``proof`` tells what stands for a secret: ``checksum``, ``structure`` (issuer format, key block) or ``context``.
* An encrypted private key counts as one. A key block without its end marker is cut off, unusable, and none.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.runtime import map_batches, table

FIELDS = ("text", "tool.input", "tool.output")

#: Cues of the automaton, in lower case.
CUES = (
    "secret", "passw", "pwd", "passphrase", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "accountkey", "storagekey",
    "_key", "-key", "key=", "key:", "key\"", "key'", "key is", "key ->", "my key", "key for", "private key", "bearer", "basic ", "authoriz", "cookie",
    "credential", "_pass", "smtp", "contrase", "kennwort", "motdepasse", "mot de passe", "identified by", "login", "akia", "asia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_",
    "glpat-", "npm_", "pypi-", "xox", "sk-", "sk_", "rk_", "pk_", "live_", "test_", "aiza", "hf_", "sg.", "dop_v1_", "eyj", "@", "signature=", "sig=", " -p", "-u ",
)

#: Words that hold a cue and never name a secret.
HARMLESS = ("tokenizer", "tokeniser", "tokenize", "token-counter", "token_counter", "tokencounter", "max_tokens", "token_url", "digest")

#: Names of settings that hold a secret, as the end of a name in snake, kebab or camel case.
SECRET_NAMES = (
    "password", "passwd", "passwort", "passphrase", "pwd", "pass", "contrasena", "contraseña", "kennwort", "motdepasse", "mot_de_passe", "senha",
    "secret", "token", "apikey", "api_key", "access_key", "secret_key", "private_key", "signing_key", "encryption_key", "storage_key", "account_key",
    "auth_key", "master_key", "session_key", "credential", "credentials", "license_key", "shared_key", "jwt",
)

#: Formats of issuers.
ISSUERS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"glpat-[A-Za-z0-9_-]{16,}",
    r"npm_[A-Za-z0-9]{20,}",
    r"pypi-[A-Za-z0-9_-]{16,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
    r"sk-(?:[a-z]+-)?[A-Za-z0-9_-]{20,}",
    r"[a-z]{0,6}(?:sk|rk)?_?(?:live|test)_[A-Za-z0-9]{16,}",
    r"AIza[A-Za-z0-9_-]{30,}",
    r"hf_[A-Za-z0-9]{20,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"dop_v1_[a-f0-9]{64}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}",
)
#: Tokens that end in the CRC-32 of what stands between, as six digits to base 62.
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_Q = r"\\{0,3}[\"'`]"
_VALUE = r"[^\s\"'`<>,;\\]{4,}"
#: A name with the stem of some secret in it; names without one are passed over, so that what stands behind them is still seen.
_NAME = r"(?<![A-Za-z0-9_.-])(?=[A-Za-z_])[A-Za-z0-9_.-]*(?:pass|pwd|secret|token|key|credential|contrase|kennwort|senha|jwt|mot_?de_?passe)[A-Za-z0-9_ñ]{0,16}"
_KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY((?: BLOCK)?)-----(?P<body>.{16,}?)-----END \1PRIVATE KEY\2-----", re.S)
_ISSUER = re.compile(r"(?<![A-Za-z0-9_+-])(" + "|".join(ISSUERS) + r")(?![A-Za-z0-9_+=-])")
_PATTERNS = [
    (kind, re.compile(pattern, re.I if kind not in ("flag_p",) else 0))
    for kind, pattern in (
        # name = value, name: value, "name": "value", name => 'value', NAME=value
        ("named_quoted", rf"(?P<name>{_NAME}){_Q}?\]?\s{{0,3}}(?::=|=>|=|:)\s{{0,3}}[a-zA-Z]?(?P<q>{_Q})(?P<v>[^\"'`\r\n]{{4,}}?)(?P=q)"),
        ("named_bare", rf"(?P<name>{_NAME}){_Q}?\s{{0,3}}(?:=|:)[ \t]{{0,3}}(?P<v>{_VALUE})"),
        ("named_query", rf"[?&;](?P<name>{_NAME}|sig|signature|code)=(?P<v>[^\s\"'`<>&;\\]{{4,}})"),
        ("named_arrow", rf"(?P<name>{_NAME}){_Q}?\s*(?:=>|->|:=)\s*(?P<v>{_VALUE})"),
        ("named_tag", rf"<(?P<name>{_NAME})>(?P<v>[^<>\s]{{4,}})</(?P=name)>"),
        ("named_pair", rf"{_Q}(?P<name>{_NAME}){_Q}\s*,\s*(?P<q>{_Q})(?P<v>[^\"'`\s]{{4,}}?)(?P=q)"),
        ("named_call", rf"(?:with|set)(?P<name>[A-Za-z]{{0,30}}(?:pass|pwd|secret|token|key|credential)[A-Za-z]{{0,16}})\(\s*(?P<q>{_Q})(?P<v>[^\"'`\s]{{4,}}?)(?P=q)"),
        ("named_flag", rf"--?(?P<name>(?:[a-z]+-){{0,4}}(?:password|passwd|pass|passphrase|pwd|secret|token|key|api-?key|credentials?))[ =]{_Q}?(?P<v>{_VALUE})"),
        ("flag_p", rf"(?:login|mysql|psql|mysqldump|sshpass|curl|docker)\b[^\n]{{0,300}}? -p ?{_Q}?(?P<v>{_VALUE})"),
        ("flag_u", rf"\bcurl\b[^\n]{{0,300}}? (?:-u|--user)[ =]{_Q}?[\w.@-]+:(?P<v>{_VALUE})"),
        ("netrc", rf"\blogin\s+\S+\s+password\s+(?P<v>{_VALUE})"),
        ("sql", rf"(?:identified\s+by|with\s+password|set\s+password(?:\s+for\s+\S+)?\s*=|\bpassword)\s+(?P<q>{_Q})(?P<v>[^\"'`\s]{{4,}}?)(?P=q)"),
        ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/@:\"'`<>]{0,60}:(?P<v>[^\s/@\"'`<>]{3,})@[\w.\[-]"),
        ("header", rf"\b(?:Bearer|Basic|Digest|Token)\s+(?P<v>[A-Za-z0-9._~+/=-]{{8,}})"),
        ("cookie", rf"\b(?:Set-)?Cookie:\s*(?P<v0>[\w.-]+)=(?P<v>[^\s;\"'`]{{8,}})"),
        ("prose", rf"\b(?:password|passwd|passwort|pwd|passphrase|token|secret|api key|key)\s+(?:is|was|ist|es|=|->)\s+{_Q}?(?P<v>{_VALUE})"),
        ("typed", rf"\b(?:password|passwd|passwort|pwd|passphrase|kennwort|contraseña)\s+{_Q}?(?P<v>{_VALUE})"),
        ("prose", rf"\b(?:use|using|with|take|try)\s+(?:the\s+|this\s+)?(?:password|token|secret|api key|key)\s+{_Q}?(?P<v>{_VALUE})"),
        ("prose", rf"\b(?:use|using|try|take|enter)\s+{_Q}?(?P<v>{_VALUE}){_Q}?\s+as\s+(?:the\s+|your\s+|my\s+)?(?:password|token|secret|api key|key|passphrase)\b"),
        ("prose", rf"\b(?:key|token|password|secret|credentials?)\b[^\n\"'`=]{{0,40}}?(?:->|:)\s+{_Q}?(?P<v>{_VALUE})"),
        ("prose", rf"\blogin\s+(?:is\s+|with\s+)?[\w.@-]+\s*/\s*(?P<v>{_VALUE})"),
        ("connect", rf"\b(?:connect|client|auth|authenticate|login)\(\s*(?P<q>{_Q})(?P<v>[^\"'`\s]{{8,}}?)(?P=q)"),
    )
]

#: Kinds whose value ends at a blank, so that punctuation of the sentence may follow.
_OPEN_ENDED = {"prose", "typed", "named_bare", "named_arrow", "named_flag", "flag_p", "flag_u", "netrc"}
#: The next parameter of a URL.
_MORE = re.compile(r"&[A-Za-z_]\w*=")
_HEX_ID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_NOT = re.compile(
    r"""[<\[{(%$*#]|\$\{|.*(?:\$\{|\{\{|<[^>]*>|\*{3,}|x{6,}|X{6,}|\.{3}|…|•{2,}|_{4,})|.*[()\[\]{}]  # references, calls, placeholders, masks
    |(?:your|my|the|an?|some|change|insert|replace|enter|redacted|masked|hidden|removed|example|placeholder|dummy|todo|fixme|none|null|nil|undefined|true|false|empty|unset|required|optional|string|str|bytes|int|bool|env|os|process|vault|secrets?|config|settings|self|this|await|getenv)(?:[-_.\s|].*)?$
    |(?:https?|file|arn|env|vault|ssm|op|keychain|secret|secrets|aws-sm|gcp-sm):.*|\./|~/|sha\d{1,3}[:-]|md5[:-]|\d{1,9}$|\d{4}-\d\d-\d\d""",
    re.I | re.X,
)
#: What ``mask`` leaves of a secret.
_MASKED = re.compile(r"(?:[XxAa012\W_]|%58)+")
_PASSWORDISH = re.compile(r"pass|pwd|contrase|kennwort|senha", re.I)
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|[\"\\/bfnrt])")
_PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word in CUES + HARMLESS:
        a.add_word(word, (len(word), word in HARMLESS))
    a.make_automaton()
    return a


_SPACE = re.compile(r"\s")
#: How far before and behind a cue a search reaches: to whole words, and behind it to the end of the line if that is within ``LINE``.
BEFORE, BEHIND, LINE = 90, 260, 4096


def cue_windows(value: str) -> list[tuple[int, int]]:
    """The stretches of ``value`` around its cues, as far as a name before or a secret behind them may reach."""
    hits, harmless = [], 0
    folded = value.lower()
    if len(folded) != len(value):
        folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    for end, (size, is_harmless) in _automaton().iter(folded):
        if is_harmless:
            start = end + 1 - size
            while hits and hits[-1][0] >= start:
                hits.pop()
            harmless = end
        elif end + 1 - size > harmless or not harmless:
            hits.append((end + 1 - size, end + 1))
    windows: list[tuple[int, int]] = []
    for a, b in hits:
        a = max(0, a - BEFORE)
        if windows and a <= windows[-1][1]:
            a = windows[-1][0]
            if b + BEHIND <= windows[-1][1]:
                continue
            windows.pop()
        else:
            while a and not value[a - 1].isspace():
                a -= 1
        line = value.find("\n", b, b + LINE)
        if line < 0 and len(value) - b <= LINE:
            line = len(value)
        b = max(b + BEHIND, line)
        m = _SPACE.search(value, b) if b < len(value) else None
        windows.append((a, m.start() if m else len(value)))
    whole: list[tuple[int, int]] = []
    for a, b in windows:
        if whole and a <= whole[-1][1]:
            whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
        else:
            whole.append((a, b))
    return whole


def unescape(raw: str) -> tuple[str, list[int] | None]:
    """The text of JSON with its escapes undone, and where each character stands in ``raw`` (None: the same)."""
    if "\\" not in raw:
        return raw, None
    out, at, last = [], [], 0
    for m in _ESCAPE.finditer(raw):
        out.append(raw[last : m.start()])
        at.extend(range(last, m.start()))
        e = m.group(0)[1:]
        out.append(chr(int(e[1:], 16)) if e[0] == "u" else _PLAIN.get(e, e))
        at.append(m.start())
        last = m.end()
    out.append(raw[last:])
    at.extend(range(last, len(raw) + 1))
    return "".join(out), at


@lru_cache(4096)
def secret_name(name: str) -> bool:
    """Whether a setting of this name holds a secret: its last words, in any case style, are one of SECRET_NAMES."""
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").replace(".", "_").lower().strip("_")
    flat = snake.replace("_", "")
    if snake.startswith(("max_", "min_", "num_", "n_", "total_")) or snake.endswith(("_tokens", "_url", "_uri", "_id", "_name", "_path", "_file", "_type", "_field", "_hash")):
        return False
    return any(snake == s or snake.endswith("_" + s) or flat.endswith(s.replace("_", "")) and len(s) > 4 for s in SECRET_NAMES) or flat.endswith(("pwd", "password", "passwd"))


def checksum(token: str) -> bool | None:
    """Whether the checksum of a token is right; None if its issuer has none or its length is not the issuer's."""
    m = _CHECKED.fullmatch(token)
    if not m:
        return None
    crc, said = zlib.crc32(m.group(1).encode()), 0
    for c in m.group(2):
        said = said * 62 + _DIGITS.index(c)
    return crc == said


def web_token(value: str) -> bool:
    """Whether the first part of a JSON web token decodes to an object that names an algorithm or a type."""
    head = value.split(".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(found, dict) and ("alg" in found or "typ" in found or "enc" in found)


def proof(secret: str) -> str:
    """What stands for a secret that was found: its checksum, its structure, or only the text around it."""
    if checksum(secret):
        return "checksum"
    return "structure" if secret.startswith("-----BEGIN") or _ISSUER.fullmatch(secret) else "context"


def usable(value: str, kind: str, name: str = "") -> bool:
    """Structure that a real secret has: no placeholder, reference or plain word, enough variety for its length."""
    if len(value) < 6 or _NOT.match(value) or _HEX_ID.fullmatch(value):
        return False
    if len(set(value)) < 5 or _MASKED.fullmatch(value):
        return False
    digit, upper, lower = any(c.isdigit() for c in value), any(c.isupper() for c in value), any(c.islower() for c in value)
    other = any(not c.isalnum() for c in value)
    mixed = bool(re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value)) and len(value) >= 10
    if value[0] == "/":  # a path, unless it looks like base64
        return digit and upper and lower and bool(re.fullmatch(r"[A-Za-z0-9+/]{20,}={0,2}", value))
    if kind == "issuer":
        if value.startswith("eyJ"):
            return web_token(value)
        return digit or mixed or value.startswith(("AKIA", "ASIA"))
    if kind in ("url", "netrc", "flag_p", "flag_u", "sql"):
        return digit or upper and lower or (upper and other) or len(value) >= 12
    if kind.startswith("named") and _PASSWORDISH.search(name):
        return digit or mixed or (upper and other)
    if kind == "typed":
        return digit and (upper or other) or mixed and upper and lower
    if kind == "header":
        return len(value) >= 8 and (digit or upper) and (lower or upper)
    return (digit and (upper or lower) or mixed and upper and lower) and len(value) >= 8


def find_secrets(value: str, is_json: bool = False) -> list[tuple[int, int]]:
    """Places of the secrets in ``value``, in order, none within another."""
    if not value or not (windows := cue_windows(value)):
        return []
    text, at = unescape(value) if is_json else (value, None)
    if at:
        windows = cue_windows(text)
    found = [m.span() for m in _KEY_BLOCK.finditer(text) if not _MASKED.fullmatch(m.group("body"))] if "PRIVATE KEY" in text else []
    blocks = list(found)
    for a, b in windows:
        found += [m.span(1) for m in _ISSUER.finditer(text, a, b) if usable(m.group(1), "issuer")]
        for kind, pattern in _PATTERNS:
            for m in pattern.finditer(text, a, b):
                name = m.groupdict().get("name") or ""
                if kind.startswith("named") and not secret_name(name) and not (kind == "named_query" and name.lower() in ("sig", "signature", "key", "code")):
                    continue
                x, y = m.span("v")
                v = _MORE.split(text[x:y])[0].rstrip(".,;:?)]}") if kind in _OPEN_ENDED else text[x:y]
                if usable(v, kind, name):
                    found.append((x, x + len(v)))
    spans: list[tuple[int, int]] = []
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if any(x <= a and b <= y for x, y in blocks if (x, y) != (a, b)):
            continue
        if spans and a < spans[-1][1]:
            continue
        spans.append((a, b))
    return [(at[a], at[b - 1] + 1 if value[at[b - 1]] != "\\" else at[b]) for a, b in spans] if at else spans


#: Alphabets whose placeholders keep to them, as (all characters, lower-case letter, upper-case letter, digit).
ALPHABETS = (
    (re.compile(r"[0-9a-f]+"), "a", "A", "0"),  # hex
    (re.compile(r"[0-9A-F]+"), "a", "A", "0"),
    (re.compile(r"[A-Z2-7]+"), "a", "A", "2"),  # base32
    (re.compile(r"[1-9A-HJ-NP-Za-km-z]+"), "x", "X", "1"),  # base58
    (re.compile(r".*", re.S), "x", "X", "0"),
)
_MARKER = re.compile(r"(-----(?:BEGIN|END) [A-Z0-9 ]+-----)")
_KEPT = re.compile(r"\\u[0-9a-fA-F]{4}|\\[\"\\/bfnrt]|%[0-9A-Fa-f]{2}")


def mask(secret: str) -> str:
    """A placeholder of the same length and alphabet; marker lines of key blocks and JSON escapes stay, escapes of URLs become another's."""
    out = []
    for part in _MARKER.split(secret):
        if part.startswith("-----"):
            out.append(part)
            continue
        plain = "".join(c for c in _KEPT.sub("", part) if c.isalnum())
        low, up, digit = next(x[1:] for x in ALPHABETS if x[0].fullmatch(plain))
        last = 0
        for m in [*_KEPT.finditer(part), None]:
            out += [digit if c.isdigit() else up if c.isupper() else low if c.isalpha() else c for c in part[last : m.start() if m else len(part)]]
            if m:
                out.append("%58" if m.group(0)[0] == "%" else m.group(0))
                last = m.end()
    return "".join(out)


def redact(value: str | None, is_json: bool = False) -> str | None:
    """``value`` with each secret masked and everything else unchanged."""
    if not value:
        return value
    out, last = [], 0
    for a, b in find_secrets(value, is_json):
        out += [value[last:a], mask(value[a:b])]
        last = b
    return "".join(out) + value[last:] if last else value


def _fields(events: DataFrame) -> DataFrame:
    return events.selectExpr("event_id", "text", "tool.input as tool_input", "tool.output as tool_output")


def secrets(events: DataFrame) -> DataFrame:
    """(event_id, field_name, secret_text, n_places, proof), one row per secret value and field."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column(0).to_pylist(), []
        for field, column in zip(FIELDS, batch.columns[1:]):
            for i, v in enumerate(column.to_pylist()):
                if v and (spans := find_secrets(v, field == "tool.input")):
                    counts: dict[str, int] = {}
                    for a, b in spans:
                        counts[v[a:b]] = counts.get(v[a:b], 0) + 1
                    rows += [(ids[i], field, s, n, proof(s)) for s, n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=["event_id", "field_name", "secret_text", "n_places", "proof"])

    return map_batches(_fields(events), find, "event_id long, field_name string, secret_text string, n_places int, proof string")


def redacted(events: DataFrame) -> DataFrame:
    """(event_id, text, tool_input, tool_output) of every event, secrets masked."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(0)]
        for field, column in zip(FIELDS, batch.columns[1:]):
            cols.append(pa.array([redact(v, field == "tool.input") for v in column.to_pylist()], pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=["event_id", "text", "tool_input", "tool_output"])

    return map_batches(_fields(events), run, "event_id long, text string, tool_input string, tool_output string")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return secrets(table(spark, base, "session_events")).select("event_id", "field_name", "secret_text")


def p1_redacted(spark: SparkSession, base: str) -> DataFrame:
    return redacted(table(spark, base, "session_events"))
