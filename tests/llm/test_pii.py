import pytest

from tracemill.llm import pii as P

PEOPLE = [(g, h + t) for g in ("Edda", "Zoë", "Bao") for h in ("Brack", "Wick", "Holm") for t in ("mond", "worth")] + [(None, None)]
F = P.Finder(P.Roster(PEOPLE))

FOUND = [
    ("cc edda.wickmond@mail.test, they", "email", "edda.wickmond@mail.test"), ("E: A.B@UNI-X.EXAMPLE\n", "email", "A.B@UNI-X.EXAMPLE"), ("ping a+b(at)post.invalid when", "email", "a+b(at)post.invalid"), ("E: n [at] quill [dot] example", "email", "n [at] quill [dot] example"),
    ("cc a.h at quill dot example, they", "email", "a.h at quill dot example"), ("Tel. +44 20 7946 0632, ask", "phone", "+44 20 7946 0632"), ("Tel. 0049 (0)30 23125 380, ask", "phone", "0049 (0)30 23125 380"), ("call me on 030/23125-432 if", "phone", "030/23125-432"),
    ("T: (635) 555-0124\n", "phone", "(635) 555-0124"), ("contact=2695550115;a=1", "phone", "2695550115"), ("my number +1-399-555-0139 in", "phone", "+1-399-555-0139"), ("on 347.555.0129 if", "phone", "347.555.0129"), ("T: 020 7946 0815", "phone", "020 7946 0815"),
    ("SSN 974 22 4679 in", "id_number", "974 22 4679"), ("soc. sec. no. 926 75 4636", "id_number", "926 75 4636"), ("ssn: 939-84-4397 x", "id_number", "939-84-4397"), ("NI number QQ 74 74 65 C is", "id_number", "QQ 74 74 65 C"), ("passport no. J28236610 in", "id_number", "J28236610"),
    ("documento 89730407-R in", "id_number", "89730407-R"), ("Steuer-ID 92 416 134 803 is", "id_number", "92 416 134 803"), ("Home address: 138 Rookery Road Apt 24B\nRavenshaw, 56644 A", "address", "138 Rookery Road Apt 24B\nRavenshaw, 56644"),
    ("to 67 Pewter Ave, Dunwick 36998. The", "address", "67 Pewter Ave, Dunwick 36998"), ("on 'Emberstraße 39, 19932 Marshgate' as", "address", "Emberstraße 39, 19932 Marshgate"), ("to Flat 2, 71 Vesper Terrace, Fallbrook QX6 6ZZ.", "address", "Flat 2, 71 Vesper Terrace, Fallbrook QX6 6ZZ"),
    ("on '58 rue Beacon, 42378 Calder's Reach' as", "address", "58 rue Beacon, 42378 Calder's Reach"), ("164 rue Alder, 98431 Calder's Reach is", "address", "164 rue Alder, 98431 Calder's Reach"), ("Calle Osprey 94, 8º C, 96865 Pellworth", "address", "Calle Osprey 94, 8º C, 96865 Pellworth"), ("reviewer: edda wickworth", "person_name", "edda wickworth"),
    ("Approved by Holmmond, Zoë after the", "person_name", "Holmmond, Zoë"), ("thx to B. Brackmond for", "person_name", "B. Brackmond"), ("Bao Wickmond asked for the", "person_name", "Bao Wickmond"), ("TODO(Zoë Holmworth): drop", "person_name", "Zoë Holmworth"),
]
NONE = ["", "remote is git@code.internal.test:a/b.git", "dev@buildbox:~$ make", "npm install @harborline/experiment@2.6.2", "https://app:pw1234@db.test:99/x", "schematic rev 915-33-1517 is obsolete", "epoch 1234567890 in services", "listening on 10.120.100.200", "Step 34 Parser Road Map, milestone 35010", "@pytest.fixture", "Bao and Zoë met", "look at the dot on the map"]


@pytest.mark.parametrize("text,kind,value", FOUND)
def test_found_and_replaced(text, kind, value):
    spans = F.find(text)
    assert [(k, text[a:b]) for a, b, k in spans] == [(kind, value)]
    assert P.redact_text(text, spans) == text.replace(value, f"[{kind.upper()}]")
    padded = "the mesh " * 20_000 + "\n" + text + "\n" + "drops it " * 20_000
    assert [(k, padded[a:b]) for a, b, k in F.find(padded)] == [(kind, value)]


@pytest.mark.parametrize("text", NONE)
def test_none(text):
    assert F.find(text) == []


@pytest.mark.parametrize("text,value", [("415-867-2390", "415-867-2390"), ("Call 415-867-2390 tomorrow", "415-867-2390"), ("ask 020 7123 4567", "020 7123 4567"), ("or (212) 736-3100.", "(212) 736-3100"), ("T +33 1 42 68 53 00", "+33 1 42 68 53 00")])
def test_phones_of_any_range(text, value):
    assert [(k, text[a:b]) for a, b, k in P.Finder(P.Roster([])).find(text)][:1] == [("phone", value)]


@pytest.mark.parametrize("text,name", [("reviewer: Maria Gonzalez", "Maria Gonzalez"), ("Signed-off-by: Nguyen, Linh", "Nguyen, Linh"), ("paired with Øyvind Strøm on it", "Øyvind Strøm"), ("thanks to J. Okafor", "J. Okafor"), ("approved by Ana-Lucía O'Neill.", "Ana-Lucía O'Neill")])
def test_names_behind_cues_need_no_roster(text, name):
    for people in ([], PEOPLE):
        assert [(k, text[a:b]) for a, b, k in P.Finder(P.Roster(people)).find(text)] == [("person_name", name)]


@pytest.mark.parametrize("text", ["approved by Release Bot", "reviewer: Platform Team", "thanks to The Cache", "order 123-456-7890", "at 2026-03-01 12-30-45", "id 0.123.456.7890", "Maria Gonzalez"])
def test_no_names_no_phones(text):
    assert P.Finder(P.Roster([])).find(text) == []


def held_out():
    """Numbers of other ranges and names of other people than the fixtures', in other sentences."""
    import random

    rng = random.Random(5)
    digits = lambda n, first="23456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    out = []
    for _ in range(30):
        a, b, c = digits(3), digits(3), digits(4, "0123456789")
        out += [(f, "phone") for f in (f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"{a}.{b}.{c}", f"+44 20 {digits(4)} {digits(4)}", f"020 {digits(4, '378')} {digits(4)}", f"+49 30 {digits(8)}", f"+33 {digits(3, '1')} {digits(6)}")]
    given = ["María", "Jürgen", "Aoife", "Kwame", "Priya", "Tomasz", "Linh", "Søren", "Ngozi", "Pierre"]
    family = ["González", "Müller", "O'Sullivan", "Mensah", "Iyer", "Kowalski", "Nguyễn", "Kierkegaard", "Adeyemi", "Dubois"]
    cues = ["reviewer: {}", "Reviewed-by: {}", "Signed-off-by: {}", "Co-authored-by: {}", "TODO({}): fix", "thanks to {} for this", "paired with {} on it", "approved by {}.", "author: {}", "assignee: {}"]
    out += [(cue.format(f"{g} {f}"), f"{g} {f}") for cue in cues for g, f in zip(rng.sample(given, 8), rng.sample(family, 8))]
    return [(f"please use {t} there", t, "phone") if k == "phone" else (t, k, "person_name") for t, k in out]


def test_recall_on_held_out_forms():
    finder, cases = P.Finder(P.Roster(PEOPLE)), held_out()
    missed = [(t, v) for t, v, kind in cases if (kind, v) not in [(k, t[a:b]) for a, b, k in finder.find(t)]]
    assert len(missed) <= 0.1 * len(cases)


def test_tables(spark):
    frame = spark.createDataFrame([(1, "a@b.test or a@b.test", "x"), (2, None, "y"), (None, "", None)], "event_id long, text string, pii_type string")
    people = spark.createDataFrame(PEOPLE, "given_name string, family_name string")
    roster = P.roster_of(people)
    assert [tuple(r) for r in P.personal_information(frame, roster).collect()] == [(1, "email", "a@b.test", 2)]
    assert {tuple(r) for r in P.anonymised(frame, roster).collect()} == {(1, "[EMAIL] or [EMAIL]"), (2, None), (None, "")}
    assert P.personal_information(frame.limit(0), P.roster_of(people.limit(0))).count() == 0
