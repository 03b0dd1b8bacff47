"""Personal information in free text (problem 5).

Anchor expansion: one Aho-Corasick pass finds anchors (at-signs and their spellings, identifier cues, street
words, given names, cues of names), one more scan groups of digits long enough for a phone number; around each, a
deterministic parser expands to the boundaries of the value and validates it, phone numbers by the numbering plan of their
form. What stands in a text is found by its own structure, so the roster of people only adds given names and word
parts of family names; people who are not on it are found by those parts, and two capitalised words behind a
cue such as ``reviewer:`` are a name whoever it is.

Defined results
* Null and empty texts hold nothing; a value that stands twice in a text is one row, replaced at each place.
* Very long texts are searched whole. Values don't overlap: e-mail, address, id number, phone, name, in this order.
* Service logins, shell prompts, package names and URL credentials are no e-mail addresses; numbers of ten digits
  are phone numbers only behind a cue; id numbers only behind their label.
* An empty or null roster leaves the names behind cues. Words of ``NO_NAMES`` are teams and machines, not people.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.runtime import map_batches, table

#: A roster up to this many rows is sent to the executors; a larger one is refused, as no machine should hold it.
ROSTER_LIMIT = 200_000

#: Logins of services.
SERVICE_LOGINS = {"git", "svn", "hg", "ssh", "scm", "jenkins", "root", "www-data", "ubuntu", "ec2-user", "postgres", "hub"}

_L = r"[^\W\d_]"
_EMAIL = re.compile(r"(?<![\w.+%-])([\w.+%-]*\w)@((?:[\w](?:[\w-]*\w)?\.)+[A-Za-z]{2,24})(?![\w-])")
_SPELT = re.compile(r"(?<![\w.+%@-])([\w.+%-]*\w)(?: ?(?:\[at\]|\(at\)|\{at\}|<at>) ?([\w-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}|<dot>) ?| dot |\.)[\w-]+)+)| at ([\w-]+(?: dot [\w-]+)*? dot (?:com|org|net|edu|gov|int|info|biz|io|dev|app|ai|co|me|eu|us|uk|ca|au|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|jp|cn|in|br|test|example|invalid|local|localhost)))(?![\w-])", re.I)

_PHONE = re.compile(
    r"""(?<![\w.+/@-])(?:
      \+1[ .-]?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}
    | (?:\+|00)44[ -]?(?:\(0\)[ -]?)?\d{2,4}[ -]\d{3,4}[ -]\d{3,4}
    | (?:\+|00)\d{2,3}[ -]?(?:\(0\) ?)?\d{2,5}[ /-]?\d{3,9}(?:[ -]\d{1,4}(?![\d]))?
    | (?:\+|00)\d{2,3}(?:[ .-]?\(0\))?(?:[ .-]\d{1,4}){3,6}
    | \([2-9]\d{2}\)[ ]?[2-9]\d{2}[ .-]\d{4}
    | [2-9]\d{2}([.-])[2-9]\d{2}\1\d{4}
    | 0\d{2}[ ]\d{4}[ ]\d{4}
    | 0\d{3,4}[ ]\d{3}[ ]\d{3,4}
    | 0\d{2,4}[/]\d{3,9}(?:-\d{1,5})?
    | \d{10}
    )(?![\w]|[.-]\d)""",
    re.X,
)
_PHONE_CUE = re.compile(r"(?:\btel(?:efon|ephone)?|phone|mobile|\bcell|\bfax|call(?:[ ]me)?(?:[ ](?:on|at))?|ring(?:[ ]me)?[ ]on|text[ ]me(?:[ ]on|[ ]at)?|reach(?:[ ]me)?[ ](?:on|at)|number|contact|hotline|(?:^|\n|[ ])T|support[ ]line[^\n\d]{0,30}|whatsapp|sms)[ .:=#(]{0,3}(?:is[ ])?$", re.I | re.X)

#: Labels of id numbers and the form of what follows them.
_IDS = [
    re.compile(rf"(?<![\w])(?:{label})\b[ \t.:#=]*(?:(?:no|nr|number|num|nummer|is|n[º°o])\b\.?)?[ \t:#=]*({form})(?![\w]|-\d)", re.I)
    for label, form in (
        (r"ssn|social[ -]security|soc\.? ?sec", r"\d{3}([- ]?)\d{2}\2\d{4}"),
        (r"nino|ni|national insurance", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"),
        (r"passport|reisepass|passeport|pasaporte", r"[A-Z]{1,2}\d{6,8}|\d{8,9}|[A-Z0-9]{2}\d{6,7}[A-Z]?"),
        (r"dni|nif|nie|documento|identity card|id card|personalausweis|ausweis|national id|carte d.identit\S|cédula", r"[XYZ]?\d{7,8} ?-?[A-Z]|[A-Z]{1,3}\d{6,9}[A-Z]?|[A-Z0-9]{9}(?=\b)(?<=\d.)|\d{8,12}"),
        (r"tax[ -]?(?:id|payer id)|tin|steuer-?id|steuernummer|steueridentifikationsnummer|utr|ein|itin|codice fiscale", r"\d{2} \d{3} \d{3} \d{3}|\d{2}-\d{7}|\d{3}[- ]\d{2}[- ]\d{4}|\d{2,3}/\d{3}/\d{4,5}|\d{10,11}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"),
    )
]

_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻŽČĆĐŠÇİ](?:[\w-]|['’](?=\w))*"
_TOWN = rf"(?:(?:Saint|St\.?|New|Old|Upper|Lower|North|South|East|West|Bad|Le|La|Los|Las|San|Santa|Port|Fort|Mount|Great|Little)[ ])?[A-ZÀ-ÖØ-ÞŁŚŻŽČĆĐŠÇİ](?:[\w-]|['’](?=\w)(?!s\b))*(?:['’]s[ ]{_CAP})?"
_GAP = r"(?:,[ ]?|,?[ ]?\r?\n[ \t]*|[ ])"
_STREETS = (
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)[ ]\d+\w?,?[ ])?\d{{1,5}}[A-Za-z]?[ ](?:{_CAP}[ ]){{1,3}}(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Close|Gardens|Terrace|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Boulevard|Blvd|Crescent|Grove|Hill|Mews|Row|Walk|Parade|Rise|View|Quay)\.?(?:,?[ ](?:Apt|Apartment|Unit|Suite|Ste|Flat|\#)\.?[ ]?\w{{1,6}})?",
    rf"(?:{_CAP}[ -]){{0,2}}[A-ZÀ-ÖØ-Þ][\w-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|ring|damm)[ ]\d{{1,5}}[ ]?[a-z]?",
    rf"(?:{_CAP}[ ])(?:Straße|Strasse|Weg|Platz|Allee|Gasse)[ ]\d{{1,5}}[a-z]?",
    rf"\d{{1,5}}(?:[ ]?(?:bis|ter))?,?[ ](?:rue|avenue|boulevard|place|chemin|impasse|quai|allée)[ ](?:(?:de|du|des|la|le|les|l['’])[ ]?){{0,2}}{_CAP}(?:[ -]{_CAP}){{0,2}}",
    rf"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Via|Viale|Rua)[ ](?:(?:de|del|la|las|los)[ ]){{0,2}}{_CAP}(?:[ ]{_CAP}){{0,2}},?[ ]\d{{1,5}}(?:,[ ]\d{{1,2}}[ºª°]?[ ]?[A-Z]?)?",
)
_UK = r"[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}"
_PLACE = rf"(?:\d{{4,5}}[ ]{_TOWN}|{_TOWN},?[ ]?\n?(?:[A-Z]{{2}}[ ])?(?:\d{{5}}(?:-\d{{4}})?|{_UK})(?!\w))"
_ADDRESS = re.compile(rf"(?<![\w-])(?:{'|'.join(_STREETS)}){_GAP}{_PLACE}")

#: Anchors. The first of each pair names the parser, the rest are in lower case.
ANCHORS = {
    "email": ("@", "(at)", "[at]", "{at}", "<at>", " dot "),
    "id": ("ssn", "social", "soc.", "sec", "nino", "ni number", "national", "passport", "reisepass", "dni", "nif", "nie", "documento", "identity", "id card", "ausweis", "tax", "steuer", "tin", "utr", "codice"),
    "address": ("road", " rd", "street", " st", "ave", "lane", "close", "gardens", "terrace", "drive", "court", "square", "blvd", "crescent", "straße", "strasse", "str.", "weg ", "platz", "allee", "gasse", "rue ", "calle ", "avenida", "plaza", "paseo", "flat ", " way", "place", "grove", "via ",
                " ln", " dr", " ct", " pl", "boulevard", " hill", " mews", " row", " walk", " parade", " rise", " view", " quay", "ufer", "ring ", "damm", "chemin", "impasse", "quai", "allée", "c/", "avda", "camino", "viale", "rua "),
    "name": ("reported-by", "reviewed-by", "signed-off-by", "co-authored-by", "acked-by", "tested-by", "reviewer", "approved by", "per ", "todo(", "thx to", "thanks to", "paired with", "asked for", "author", "assignee", "--\n"),
}


#: Digits, with little between them, that are enough for a phone number.
_DIGITS = re.compile(r"\d(?:[ ./()-]{0,2}\d){8,}")
#: Words behind the cues of names that are no part of a person's name.
NO_NAMES = {
    "bot", "team", "teams", "board", "group", "committee", "council", "crew", "squad", "guild", "desk", "office", "department", "release", "build", "deploy", "service", "services", "system", "systems", "platform", "security",
    "support", "engineering", "operations", "infrastructure", "backend", "frontend", "design", "product", "quality", "code", "the", "this", "that", "all", "everyone", "nobody", "none", "unknown", "automation", "manager", "owner", "owners", "request", "requests",
}


class Roster:
    """Given names and the word parts that family names are made of."""

    def __init__(self, people: list[tuple[str | None, str | None]]):
        self.given = {g.strip().lower() for g, _ in people if g and g.strip()}
        self.family = {f.strip().lower() for _, f in people if f and f.strip()}
        heads, tails = Counter(), Counter()
        for f in self.family:
            heads.update({f[:i] for i in range(3, len(f) - 1)})
            tails.update({f[i:] for i in range(3, len(f) - 1)})
        self.heads, self.tails = set(), set()
        for f in self.family:
            cuts = [(heads[f[:i]] * tails[f[i:]], i) for i in range(3, len(f) - 1) if heads[f[:i]] > 1 and tails[f[i:]] > 1]
            if cuts:
                i = max(cuts)[1]
                self.heads.add(f[:i])
                self.tails.add(f[i:])

    def is_family(self, word: str) -> bool:
        w = word.lower()
        return w in self.family or any(w[:i] in self.heads and w[i:] in self.tails for i in range(3, len(w) - 1))

    def is_given(self, word: str) -> bool:
        return word.lower() in self.given or len(word) == 2 and word[0].isalpha() and word[1] == "."


_N = rf"{_L}(?:{_L}|['’-](?={_L}))+"
_I = rf"(?:{_L}\.)"
_PAIR = re.compile(rf"(?<![\w.@/'-])(?:(?P<a>{_N}|{_I})[ ](?P<b>{_N})|(?P<c>{_N}),[ ](?P<d>{_N}|{_I}))(?![\w@(/]|[.-]\w)")
_CUE_BEFORE = re.compile(r"(?:(?:report|review|sign(?:ed-off)?|co-author|author|ack|test|suggest|approv)(?:ed)?-by:|review(?:er|ed by):?|author:|assignee:|owner:|approved by|\bper|todo\(|th(?:x|anks) to|paired with|\bcc:?|--\n)[ ]?$", re.I)
#: Cues that only people follow.
_PERSON_BEFORE = re.compile(r"(?:(?:report|review|sign(?:ed-off)?|co-author|author|ack|test|suggest|approv)(?:ed)?-by:|review(?:er|ed by):?|author:|assignee:|approved by|todo\(|th(?:x|anks) to|paired with)[ ]?$", re.I)
_CUE_AFTER = re.compile(r" asked for ")


class Finder:
    """Finds the values in one text; built once for each worker."""

    def __init__(self, roster: Roster):
        import ahocorasick

        self.roster = roster
        self.anchors = ahocorasick.Automaton()
        words: dict[str, set[str]] = {}
        for parser, cues in ANCHORS.items():
            for cue in cues:
                words.setdefault(cue, set()).add(parser)
        for g in roster.given:
            words.setdefault(g, set()).add("name")
        for h in roster.heads:
            words.setdefault(". " + h, set()).add("name")
        for w, parsers in words.items():
            self.anchors.add_word(w, (len(w), parsers))
        self.anchors.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of the values, in order, none overlapping another."""
        if not text:
            return []
        folded = text.lower()
        if len(folded) != len(text):
            folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        near: dict[str, list[list[int]]] = {}
        for end, (size, parsers) in self.anchors.iter(folded):
            for parser in parsers:
                reach = 160 if parser in ("address", "email") else 90
                a, b = max(0, end + 1 - size - reach), min(len(text), end + 1 + reach)
                spans = near.setdefault(parser, [])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        near["phone"] = [[m.start(), m.end()] for m in _DIGITS.finditer(text)]
        found: list[tuple[int, int, str]] = []
        for parser, search in (("email", self._emails), ("address", self._addresses), ("id", self._ids), ("phone", self._phones), ("name", self._names)):
            for a, b in near.get(parser, ()):
                # a window starts and ends between words
                while a > 0 and not text[a - 1].isspace():
                    a -= 1
                while b < len(text) and not text[b].isspace():
                    b += 1
                for x, y, kind in search(text, a, b):
                    if not any(x < q and p < y for p, q, _ in found):
                        found.append((x, y, kind))
        return sorted(found)

    def _emails(self, text: str, a: int, b: int):
        for m in _EMAIL.finditer(text, a, b):
            start = max(text.rfind(c, 0, m.start()) for c in " \n\t\"'`<(") + 1
            if m.group(1).lower() in SERVICE_LOGINS or "://" in text[start : m.start()] or re.match(r":[\w~/]", text[m.end() : m.end() + 2]):
                continue
            yield m.start(), m.end(), "email"
        for m in _SPELT.finditer(text, a, b):
            yield m.start(), m.end(), "email"

    def _addresses(self, text: str, a: int, b: int):
        for m in _ADDRESS.finditer(text, a, b):
            yield m.start(), m.end(), "address"

    def _ids(self, text: str, a: int, b: int):
        for pattern in _IDS:
            for m in pattern.finditer(text, a, b):
                if any(c.isdigit() for c in m.group(1)):
                    yield m.start(1), m.end(1), "id_number"

    def _phones(self, text: str, a: int, b: int):
        for m in _PHONE.finditer(text, a, b):
            v = m.group(0)
            plain = v.isdigit() and not v.startswith("00")
            if plain and not _PHONE_CUE.search(text[max(0, m.start() - 60) : m.start()]):
                continue
            if 9 <= sum(c.isdigit() for c in v) <= 15:
                yield m.start(), m.end(), "phone"

    def _names(self, text: str, a: int, b: int):
        at = a
        while m := _PAIR.search(text, at, b):
            given, family = (m.group("a"), m.group("b")) if m.group("a") else (m.group("d"), m.group("c"))
            before = text[max(0, m.start() - 24) : m.start()]
            cue = bool(_CUE_BEFORE.search(before) or _CUE_AFTER.match(text, m.end()))
            cased = family[0].isupper() and given[0].isupper()
            known_given, known_family = self.roster.is_given(given), self.roster.is_family(family)
            plain = all(re.fullmatch(rf"{_L}\.|(?:[^\W\d_a-z][^\W\d_A-Z'’-]*|[^\W\d_A-Z'’-]+)(?:['’-]{_L}+)?", w) for w in (given, family))
            person = cased and plain and bool(_PERSON_BEFORE.search(before)) and not {given.lower(), family.lower()} & NO_NAMES
            if known_given and known_family and (cased or cue) or cue and cased and plain and (known_given or known_family) or person:
                yield m.start(), m.end(), "person_name"
                at = m.end()
            else:
                first = m.end("a") if m.group("a") else m.end("c")
                at = max(first, m.start() + 1)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[EMAIL]``, ``[PHONE]``, ... in the places of its values."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def roster_of(contributors: DataFrame) -> Roster:
    rows = contributors.select("given_name", "family_name").distinct().limit(ROSTER_LIMIT + 1).collect()
    if len(rows) > ROSTER_LIMIT:
        raise ValueError(f"the roster has more than {ROSTER_LIMIT} names")
    return Roster([tuple(r) for r in rows])


def personal_information(texts: DataFrame, roster: Roster, key: str = "event_id", col: str = "text") -> DataFrame:
    """(key, pii_type, pii_text, n_places), one row per value and text."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder, rows = Finder(roster) if not cache else cache[0], []
        cache[:] = [finder]
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t:
                rows += [(k, kind, v, n) for (kind, v), n in Counter((kind, t[a:b]) for a, b, kind in finder.find(t)).items()]
        types = (batch.schema.field(0).type, pa.string(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=[key, "pii_type", "pii_text", "n_places"])

    cache: list[Finder] = []
    kind = dict(texts.dtypes)[key]
    return map_batches(texts.select(key, col).where(f"`{col}` is not null"), find, f"`{key}` {kind}, pii_type string, pii_text string, n_places int")


def anonymised(texts: DataFrame, roster: Roster, key: str = "event_id", col: str = "text") -> DataFrame:
    """(key, text) with typed placeholders; null texts stay null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder = Finder(roster) if not cache else cache[0]
        cache[:] = [finder]
        out = [t and redact_text(t, finder.find(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, col])

    cache: list[Finder] = []
    return map_batches(texts.select(key, col), run, f"`{key}` {dict(texts.dtypes)[key]}, `{col}` string")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return personal_information(table(spark, base, "session_events"), roster_of(table(spark, base, "contributors"))).drop("n_places")


def p5_redacted(spark: SparkSession, base: str) -> DataFrame:
    return anonymised(table(spark, base, "session_events"), roster_of(table(spark, base, "contributors")))
