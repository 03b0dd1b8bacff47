from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.operators import timestamps as T

US = 1_000_000


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * US + micro


def instants(spark, rows, tz="UTC", order="dmy"):
    frame = spark.createDataFrame([(i, x, tz, order) for i, x in enumerate(rows)], "i int, ts string, tz_name string, date_order string")
    out = T.localise(T.parse(frame, "ts")).orderBy("i").collect()
    return [r.early for r in out]


NOON = us(2026, 3, 4, 12, 5, 6)


@pytest.mark.parametrize("text,expected", [
    ("2026-03-04T12:05:06.000Z", NOON), (" 2026-03-04T12:05:06.789Z ", NOON + 789_000), ("2026-03-04t12:05:06z", NOON), ("2026-03-04T12:05:06.123456789Z", NOON + 123_456), ("2026-03-04T12:05:06+00", NOON),
    ("2026-03-04T14:05:06.5+02:00", NOON + 500_000), ("2026-03-04 17:50:06 +0545", NOON), ("2026-03-04 07:05:06 EST", NOON), ("20260304T120506Z", NOON), ("1772625906", NOON), ("1772625906.25", NOON + 250_000),
    ("1772625906123", NOON + 123_000), ("1772625906123456", NOON + 123_456), ("1772625906123456789", NOON + 123_456), ("Wed, 04 Mar 2026 13:05:06 +0100", NOON), ("4 Mar 2026 12:05:06 GMT", NOON), ("Mar 4, 2026 12:05:06", NOON),
    ("04.03.2026 12:05:06", NOON), ("2026-03-04 12:05:06,250", NOON + 250_000), ("4/3/2026 12:05", us(2026, 3, 4, 12, 5)), ("2026-03-04 12:05:06", NOON),
    ("", None), (None, None), ("n/a", None), ("NaN", None), ("0000-00-00T00:00:00.000Z", None), ("2026-02-30T00:00:00Z", None), ("2026-03-04T25:00:00Z", None), ("2026-03-04 12:05:06 QQQ", None), ("31/31/2026 10:00", None), ("12", None), ("x" * 5000, None),
])
def test_formats(spark, text, expected):
    assert instants(spark, [text]) == [expected]


def test_date_order_and_half_days(spark):
    assert instants(spark, ["3/4/2026 12:05 AM", "3/4/2026 12:05 PM", "3/4/2026 1:05 PM"], order="mdy") == [us(2026, 3, 4, 0, 5), us(2026, 3, 4, 12, 5), us(2026, 3, 4, 13, 5)]


def test_zones_overlap_and_gap(spark):
    rows = T.localise(T.parse(spark.createDataFrame([(1, "2025-10-26 02:30:00"), (2, "2026-03-29 02:30:00"), (3, "2026-07-01 00:00:00")], "i int, ts string").selectExpr("*", "'Europe/Berlin' as tz_name", "'dmy' as date_order"), "ts")).orderBy("i").collect()
    assert (rows[0].early, rows[0].late) == (us(2025, 10, 26, 0, 30), us(2025, 10, 26, 1, 30))
    assert rows[1].skipped and rows[1].late is None and rows[1].early == us(2026, 3, 29, 1, 30)
    assert rows[2].early == us(2026, 6, 30, 22)
    assert instants(spark, ["2026-03-04 12:05:06"], tz="No/Where") == [NOON] and instants(spark, ["2026-03-04 12:05:06"], tz=None) == [NOON]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(1_750_000_000, 1_800_000_000), st.sampled_from(["Europe/London", "America/New_York", "Asia/Kathmandu", "Australia/Lord_Howe"])), min_size=30, max_size=60))
def test_local_times_like_the_zone_database(spark, cases):
    rows = [(i, datetime.fromtimestamp(s, ZoneInfo(z)).strftime("%Y-%m-%d %H:%M:%S"), z, "dmy") for i, (s, z) in enumerate(cases)]
    out = T.localise(T.parse(spark.createDataFrame(rows, "i int, ts string, tz_name string, date_order string"), "ts")).collect()
    for r in out:
        assert cases[r.i][0] * US in (r.early, r.late)


def test_settle_like_a_loop(spark):
    import random

    rng = random.Random(4)
    rows = []
    for s in range(12):
        seq = 0
        for _ in range(rng.randrange(1, 40)):
            seq += rng.randrange(1, 4)
            early = rng.randrange(0, 200) * 60 * US + rng.randrange(0, 60) * US
            rows.append((f"s{s}", seq, early, early + 3600 * US if rng.random() < 0.7 else None))
    frame = spark.createDataFrame(rows + rows[:9], "session_id string, seq long, early long, late long")
    for block in (4096, 5):
        got = {(r.session_id, r.seq): r.use_late for r in T.settle(frame, block).collect()}
        want, last = {}, {}
        for s, q, e, late in sorted(rows):
            pick = e
            if late is not None:
                want[s, q] = s in last and e // (60 * US) < last[s] // (60 * US)
                pick = late if want[s, q] else e
            last[s] = pick
        assert got == want


def test_events_and_sessions_with_duplicates_and_empty(spark):
    events = spark.createDataFrame([(1, "s", 1, "2025-10-26 02:59:00"), (2, "s", 2, "2025-10-26 02:01:00"), (3, "s", 2, "2025-10-26 02:01:00"), (4, None, None, "2026-03-04T12:05:06.000Z"), (5, "t", 1, None)], "event_id long, session_id string, seq long, ts string")
    sessions = spark.createDataFrame([(1, "s", "UTC", "dmy", datetime(2026, 1, 1), None), (2, "s", "Europe/Berlin", "dmy", datetime(2026, 1, 2), "26/10/2025 02:30")], "session_row long, session_id string, tz_name string, date_order string, discovered_at timestamp_ntz, timestamp_raw string")
    got = {r.event_id: r.utc_micros for r in T.normalise_events(events, sessions).collect()}
    assert got == {1: us(2025, 10, 26, 0, 59), 2: us(2025, 10, 26, 1, 1), 3: us(2025, 10, 26, 1, 1), 4: NOON, 5: None}
    assert {r.session_row: r.utc_micros for r in T.normalise_sessions(sessions).collect()} == {1: None, 2: us(2025, 10, 26, 0, 30)}
    assert T.normalise_events(events.limit(0), sessions.limit(0)).count() == 0
