"""Mixed timestamp formats and zones to one UTC time (problem 4).

An ordered cascade of anchored patterns picks the one format a value may have; the parts are then
checked strictly (a 30th of February is no time) and put together by integer arithmetic. Everything is
built-in expressions, so it stays in generated code and doesn't depend on the session's time zone.

Policies
* Blanks around a value don't matter. Digits beyond microseconds are cut off, missing ones are zero.
* A zone in the value (``Z``, offset, abbreviation of ``ABBREVIATIONS``) holds. Without one the value is local
  time in the row's zone, or UTC if that is null or unknown.
* All-numeric dates with slashes follow the row's ``date_order`` (day first if that is null), with dots day first.
* A local time that occurs twice is the earlier instant, unless that lies, in whole minutes, before the instant
  of the nearest event of the session with a lower ``seq`` that has one; then the later one.
* A local time that a clock change skips is moved forward by the length of the gap (the offset before the
  change holds); ``skipped`` tells so.
* Null, blank, meaningless and impossible values have no instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.runtime import cut, table

#: Hours east of Greenwich of the zone abbreviations that are understood.
ABBREVIATIONS = {
    "UTC": 0, "UT": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
    "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "BRT": -3, "BRST": -2, "ART": -3, "SAST": 2, "IST": 5.5, "PKT": 5, "NPT": 5.75,
    "SGT": 8, "HKT": 8, "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"
_ZONE = r"(?: ?(Z|z|[+-]\d\d(?::?\d\d)?|[A-Za-z]{2,5}))?"
_TIME = r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?(?: ?([AaPp][Mm]))?"
_NAME = r"([A-Za-z]{3})[a-z]*\.?"
#: The cascade. The replacement of each puts a value into year|month|day|hour|minute|second|fraction|am/pm|zone|order.
FORMATS = (
    (r"^(\d{4})-(\d\d)-(\d\d)[Tt ]" + _TIME + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|ymd"),
    (r"^(\d{4})/(\d\d?)/(\d\d?)[Tt ]" + _TIME + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|ymd"),
    (r"^(\d{4})(\d\d)(\d\d)[Tt](\d\d)(\d\d)(\d\d)(?:[.,](\d{1,9}))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8|ymd"),
    (r"^(\d\d?)\.(\d\d?)\.(\d{4}),? " + _TIME + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|ymd"),
    (r"^(\d\d?)/(\d\d?)/(\d{4}),? " + _TIME + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|slash"),
    (r"^(?:[A-Za-z]{3,9},? )?(\d\d?)[ -]" + _NAME + r"[ -](\d{4}),? " + _TIME + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|name"),
    (r"^(?:[A-Za-z]{3,9},? )?" + _NAME + r" (\d\d?),? (\d{4}),? " + _TIME + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|name"),
    (r"^[A-Za-z]{3} " + _NAME + r" {1,2}(\d\d?) " + _TIME + r"(?: ([A-Z]{2,5}))? (\d{4})$", "$9|$1|$2|$3|$4|$5|$6|$7|$8|name"),
)
#: Seconds, milliseconds, microseconds and nanoseconds since 1970, told apart by their digits.
_EPOCH = r"^\d{10}(?:\.\d{1,9}|\d{3}|\d{6}|\d{9})?$"
_BLANK = r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$"
_US = 1_000_000


def _long(part: Column) -> Column:
    return part.try_cast("long")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01; null for a day that isn't in the calendar."""
    return F.unix_date(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")).cast("long")


def _pinned(df: DataFrame, *cols: Column) -> DataFrame:
    """Add columns that the optimizer computes once: it doesn't push filters on generated columns into their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def parse(df: DataFrame, raw: str) -> DataFrame:
    """Add ``canonical``; ``utc``, microseconds, of values that carry their zone; of the others ``wall``, the same count as
    if the local time were UTC, and ``wall_mdy``, read month first, of slashed dates (with ``slash_offset`` if they have a zone)."""
    names = F.create_map(*(F.lit(x) for k, h in ABBREVIATIONS.items() for x in (k, int(h * 3600))))
    own = df.columns
    df = _pinned(df, F.coalesce(F.col(raw).rlike(CANONICAL), F.lit(False)).alias("canonical"), F.regexp_replace(F.col(raw), _BLANK, "").alias("_s"))
    parts = F.lit(None).cast("string")
    for pattern, order in reversed(FORMATS):
        parts = F.when(F.col("_s").rlike(pattern), F.regexp_replace("_s", pattern, order)).otherwise(parts)
    fixed = F.concat_ws("|", *(F.substring("_s", a, n) for a, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2), (21, 3))), F.lit(""), F.lit("Z"), F.lit("ymd"))
    df = _pinned(df, F.split(F.when(F.col("canonical"), fixed).otherwise(parts), r"\|").alias("_p"), F.when(~F.col("canonical"), F.regexp_extract("_s", _EPOCH, 0)).alias("_e"))
    p = [F.get(F.col("_p"), i) for i in range(10)]
    month = F.when(p[9] == "name", F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(p[1])).cast("string")).otherwise(p[1])
    half, h, z = F.lower(p[7]), _long(p[3]), F.upper(p[8])
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "pm", 12).otherwise(0))
    df = _pinned(
        df, p[0].alias("_y"), month.alias("_m"), p[2].alias("_d"), hour.alias("_h"), _long(p[4]).alias("_mi"), F.when(p[5] == "", 0).otherwise(_long(p[5])).alias("_sec"),
        _long(F.rpad(F.substring(p[6], 1, 6), 6, "0")).alias("_us"), F.replace(z, F.lit(":"), F.lit("")).alias("_z"), F.coalesce(p[9] == "slash", F.lit(False)).alias("slash"),
    )
    clock = F.when(F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_sec").between(0, 59), ((F.col("_h") * 60 + F.col("_mi")) * 60 + F.col("_sec")) * _US + F.col("_us"))
    hh, mm = _long(F.substring("_z", 2, 2)), F.when(F.length("_z") > 3, _long(F.substring("_z", 4, 2))).otherwise(0)
    offset = F.when(F.col("_z").rlike(r"^[+-]"), F.when((hh <= 18) & (mm <= 59), (hh * 3600 + mm * 60) * F.when(F.startswith("_z", F.lit("-")), -1).otherwise(1))).otherwise(F.element_at(names, F.col("_z")))
    digits, whole = F.length(F.substring_index("_e", ".", 1)), _long(F.substring_index("_e", ".", 1))
    frac = _long(F.rpad(F.substring(F.element_at(F.split(F.concat("_e", F.lit(".")), r"\."), 2), 1, 6), 6, "0"))
    epoch = F.when(digits == 10, whole * _US + frac).when(digits == 13, whole * 1000).when(digits == 16, whole).when(digits == 19, F.floor(whole / 1000).cast("long"))
    df = _pinned(
        df, (_days(F.col("_y"), F.col("_m"), F.col("_d")) * (86_400 * _US) + clock).alias("_dmy"), F.when(F.col("slash"), _days(F.col("_y"), F.col("_d"), F.col("_m")) * (86_400 * _US) + clock).alias("_mdy"),
        F.coalesce(F.col("_z") != "", F.lit(False)).alias("_zoned"), offset.alias("_off"), epoch.alias("_epoch"),
    )
    zoned, slash = F.col("_zoned"), F.col("slash")
    df = _pinned(
        df, F.coalesce("_epoch", F.when(zoned & ~slash, F.col("_dmy") - F.col("_off") * _US)).alias("utc"), F.when(~zoned | slash, F.col("_dmy")).alias("wall"),
        F.when(~zoned | slash, F.col("_mdy")).alias("wall_mdy"), F.when(zoned & slash, F.coalesce(F.col("_off").cast("long"), F.lit(1 << 40))).alias("slash_offset"),
    )
    return df.select(*own, "canonical", "utc", "wall", "wall_mdy", "slash", "slash_offset")


def zones(spark: SparkSession) -> list[str]:
    """The region names the JVM knows, a fixed list of a few hundred."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def localise(df: DataFrame, tz: str = "tz_name", order: str = "date_order") -> DataFrame:
    """Turn ``wall`` into ``early`` and, where the local time occurs twice, ``late``; ``utc`` rows keep their instant."""
    zone = F.when(F.trim(tz).isin(zones(df.sparkSession)), F.trim(tz)).otherwise("UTC")
    local = F.when(F.col("slash") & (F.lower(F.trim(order)) == "mdy"), F.col("wall_mdy")).otherwise(F.col("wall"))
    own = [c for c in df.columns if c not in ("wall", "wall_mdy", "slash", "slash_offset", "utc")]
    at = lambda us: F.timestamp_micros(us)
    back = lambda us: F.unix_micros(F.from_utc_timestamp(at(us), F.col("_zone")))
    df = _pinned(df, zone.alias("_zone"), local.alias("_local"))
    df = _pinned(df, F.when(F.col("slash_offset").isNull(), F.unix_micros(F.to_utc_timestamp(at(F.col("_local")), F.col("_zone")))).alias("_early"))
    again = lambda minutes: back(F.col("_early") + minutes * 60 * _US) == F.col("_local")
    late = F.when(F.col("_zone") == "UTC", None).when(again(60), F.col("_early") + 3600 * _US).when(again(30), F.col("_early") + 1800 * _US)
    early = F.coalesce("utc", "_early", F.when(F.col("slash_offset") < (1 << 40), F.col("_local") - F.col("slash_offset") * _US))
    df = _pinned(df, early.alias("early"), late.cast("long").alias("late"), F.coalesce(back(F.col("_early")) != F.col("_local"), F.lit(False)).alias("skipped"))
    return df.select(*own, "early", "late", "skipped")


def settle(events: DataFrame, block: int = 4096) -> DataFrame:
    """Choose between ``early`` and ``late`` of events (session_id, seq, early, late) by their predecessors.

    Returns (session_id, seq, use_late), one row per ambiguous seq. With the predecessor's choice as state,
    each event is one of three functions of it: always early, always late, or the same choice; so the state is
    that of the last event that isn't the third. This is a running ``last``, and sessions are
    cut into blocks of ``block`` seqs whose short summaries carry it on: no task gets a whole long session.
    """
    minute = lambda c: F.floor(F.col(c) / (60 * _US))
    one = (
        events.where("early is not null and session_id is not null and seq is not null")
        .withColumn("blk", F.floor(F.col("seq") / block))
        .groupBy("session_id", "blk", "seq")
        .agg(F.max("early").alias("early"), F.max("late").alias("late"))
    )
    inside = W.partitionBy("session_id", "blk").orderBy("seq")
    across = W.partitionBy("session_id").orderBy("blk")
    ends = one.groupBy("session_id", "blk").agg(F.max_by(F.struct("early", "late"), "seq").alias("last"), F.max(F.col("late").isNotNull()).alias("any"))
    carried = ends.select("session_id", "blk", "any", F.lag("last").over(across).alias("before"), F.max("any").over(W.partitionBy("session_id")).alias("needed")).where("needed")
    rows = one.join(carried.drop("any", "needed"), ["session_id", "blk"]).withColumn("prev", F.coalesce(F.lag(F.struct("early", "late")).over(inside), "before"))
    prev_early, prev_late = minute("prev.early"), F.floor(F.coalesce(F.col("prev.late"), F.col("prev.early")) / (60 * _US))
    after_early, after_late = minute("early") < prev_early, minute("early") < prev_late
    effect = F.when(F.col("late").isNull() | F.col("prev").isNull(), False).when(after_early == after_late, after_early)
    rows = rows.withColumn("effect", effect).withColumn("state", F.last("effect", ignorenulls=True).over(inside))
    final = rows.groupBy("session_id", "blk").agg(F.max_by("state", "seq").alias("final"))
    incoming = final.select("session_id", "blk", F.last("final", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("incoming"))
    return rows.where("late is not null").join(incoming, ["session_id", "blk"]).select("session_id", "seq", F.coalesce("state", "incoming", F.lit(False)).alias("use_late"))


def descriptors(sessions: DataFrame) -> DataFrame:
    """Zone and date order of each session: those of its row discovered last (ties: the highest session_row)."""
    newest = F.max_by(F.struct("tz_name", "date_order"), F.struct(F.coalesce(F.col("discovered_at").cast("string"), F.lit("")), F.col("session_row")))
    return sessions.where("session_id is not null").groupBy("session_id").agg(newest.alias("_n")).select("session_id", "_n.tz_name", "_n.date_order")


def normalise_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(event_id, canonical, utc_micros, ambiguous, skipped) for every event; ``utc_micros`` is null where ``ts`` names no instant.

    Values are parsed once; what they came to is kept in the checkpoint folder, and only sessions that hold a local time which occurs
    twice are gone through in order.
    """
    parsed = parse(events.select("event_id", "session_id", "seq", "ts"), "ts").drop("ts")
    every = cut(localise(parsed.join(descriptors(sessions), "session_id", "left")).select("event_id", "session_id", "seq", "canonical", "early", "late", "skipped"))
    twice = every.where("late is not null")
    affected = every.select("session_id", "seq", "early", "late").join(twice.select("session_id").distinct(), "session_id", "left_semi")
    settled = twice.join(settle(affected), ["session_id", "seq"], "left").withColumn("utc_micros", F.when(F.coalesce("use_late", F.lit(False)), F.col("late")).otherwise(F.col("early")))
    done = every.where("late is null").withColumn("utc_micros", F.col("early")).unionByName(settled.drop("use_late"))
    return done.select("event_id", "canonical", "utc_micros", F.col("late").isNotNull().alias("ambiguous"), "skipped")


def normalise_sessions(sessions: DataFrame) -> DataFrame:
    """The same for ``timestamp_raw`` of every session row; no event comes before, so the earlier instant holds."""
    rows = sessions.select("session_row", "session_id", "timestamp_raw").join(descriptors(sessions), "session_id", "left")
    return localise(parse(rows, "timestamp_raw")).select("session_row", "timestamp_raw", "canonical", F.col("early").alias("utc_micros"), F.col("late").isNotNull().alias("ambiguous"), "skipped")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    events = normalise_events(table(spark, base, "session_events"), table(spark, base, "sessions"))
    sessions = normalise_sessions(table(spark, base, "sessions"))
    named = "utc_micros is not null and not canonical"
    return (
        events.where(named)
        .select(F.lit("session_events").alias("src_table"), F.col("event_id").alias("row_key"), "utc_micros")
        .unionByName(sessions.where(named).select(F.lit("sessions").alias("src_table"), F.col("session_row").alias("row_key"), "utc_micros"))
    )


def p4_report(spark: SparkSession, base: str) -> DataFrame:
    """Per table: rows, instants, and how often a policy was needed."""
    events = normalise_events(table(spark, base, "session_events"), table(spark, base, "sessions")).select(F.lit("session_events").alias("src_table"), "canonical", "utc_micros", "ambiguous", "skipped")
    sessions = normalise_sessions(table(spark, base, "sessions")).select(F.lit("sessions").alias("src_table"), "canonical", "utc_micros", "ambiguous", "skipped")
    count = lambda c: F.count_if(c)
    return events.unionByName(sessions).groupBy("src_table").agg(
        F.count("*").alias("n_rows"), count(F.col("utc_micros").isNotNull()).alias("n_instants"), count(F.col("canonical")).alias("n_canonical"),
        count(F.col("ambiguous")).alias("n_ambiguous"), count(F.col("skipped")).alias("n_skipped"),
    )
