"""Turning log time texts into instants.

Instants are TIMESTAMP, wall clocks are TIMESTAMP_NTZ; the session time zone is UTC throughout, so that a
cast between the two is the identity on the digits.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.text import bind, blank_to_null, capture_groups

# Month names, the syslog prefix, and the slack for lines newer than the file's mtime.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SYSLOG_PREFIX = r"(?s)^(" + "|".join(MONTHS) + r")\s+(\d{1,2})\s(\d{2}):(\d{2}):(\d{2})\s+(.*)$"
ISO_ANCHOR = r"^(\d{4})-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
MTIME_SLACK_DAYS = 2
YEARS_TRIED = 8
ANCHOR_LINES = 202
WEBKIT_EPOCH_SECONDS = 11644473600

MICROS = 1_000_000


def known_zone(zone: Column) -> Column:
    """Zone id that Spark accepts, ``UTC`` for anything else (Spark fails a whole job on a bad id)."""
    return F.when(zone.isin(*sorted(available_timezones())), zone).otherwise("UTC")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP (or NTZ read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("long"))


def to_utc(wall_clock: Column, zone: Column) -> Column:
    """Instant of a host-local wall clock.  Overlaps take the earlier instant, gaps shift forward."""
    return F.to_utc_timestamp(wall_clock.cast("timestamp"), zone)


def to_local(instant: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def has_syslog_prefix(line: Column) -> Column:
    return line.rlike(SYSLOG_PREFIX)


def syslog_rest(line: Column) -> Column:
    """Text after the prefix, the whole line where there is none."""
    return F.when(has_syslog_prefix(line), F.regexp_extract(line, SYSLOG_PREFIX, 6)).otherwise(line)


def syslog_wall_clock(line: Column, mtime_seconds: Column, zone: Column,
                      anchor_year: Column | None = None) -> Column:
    """Year-less prefix to wall clock.

    With an anchor year the newest valid date in or before that year counts.  Without one the file's
    mtime (in host time) plus two days is an upper bound, and the year steps back below it.
    """
    anchor = anchor_year if anchor_year is not None else F.lit(None).cast("int")
    mtime_local = F.from_utc_timestamp(F.timestamp_micros((mtime_seconds * MICROS).cast("long")), zone)
    upper = F.when(anchor.isNull(), mtime_local + F.expr(f"INTERVAL {MTIME_SLACK_DAYS} DAYS"))
    months = F.lit("".join(MONTHS))

    def resolve(parts: Column) -> Column:
        # Names of three letters in a row: the place of one gives its number.
        month = F.floor((F.position(parts[1], months) + 2) / 3).cast("int")
        numbers = F.struct(
            F.coalesce(anchor, F.year(mtime_local)).alias("year"), month.alias("month"),
            *[parts[i].try_cast("int").alias(n) for i, n in ((2, "day"), (3, "hour"), (4, "minute"), (5, "second"))],
            upper.alias("upper"))

        def in_year(p: Column, back: int) -> Column:
            made = F.try_make_timestamp_ntz(
                p["year"] - back, p["month"], p["day"], p["hour"], p["minute"], p["second"])
            return bind(made, lambda t: F.when(p["upper"].isNull() | (t.cast("timestamp") <= p["upper"]), t))

        # Nearly every line is settled by the first year; the others are only looked at after it.
        return bind(numbers, lambda p: F.coalesce(*[in_year(p, back) for back in range(YEARS_TRIED)]))

    return bind(capture_groups(line, SYSLOG_PREFIX, 5), lambda parts: F.when(parts.isNotNull(), resolve(parts)))


def iso_instant(text: Column, zone: Column) -> Column:
    """ISO-8601 text to an instant; a text without offset is host-local.  Null where it does not parse."""
    shape = (r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?))?"
             r"(Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?$")

    def resolve(parts: Column) -> Column:
        clock = F.replace(F.coalesce(blank_to_null(parts[2]), F.lit("00:00:00")), F.lit(","), F.lit("."))
        wall = F.try_to_timestamp(F.concat(parts[1], F.lit(" "), clock))
        offset = parts[3]
        sign = F.when(offset.startswith("-"), -1).otherwise(1)
        digits = F.rpad(F.regexp_replace(offset, r"[^\d]", ""), 6, "0")
        seconds = (F.substring(digits, 1, 2).try_cast("long") * 3600
                   + F.substring(digits, 3, 2).try_cast("long") * 60
                   + F.substring(digits, 5, 2).try_cast("long"))
        shifted = lambda w: F.timestamp_micros(F.unix_micros(w) - sign * seconds * MICROS)
        return bind(wall, lambda w: F.when(offset == "", to_utc(w, zone)).when(offset == "Z", w)
                    .otherwise(shifted(w)))

    # The end of the text must be the end of the match, so the test comes before the groups are taken.
    clean = F.trim(text)
    return bind(F.when(clean.rlike(shape), capture_groups(clean, shape, 3)),
                lambda parts: F.when(parts.isNotNull(), resolve(parts)))


def rpm_iso(text: Column) -> Column:
    """Bring rpm's ISO variants to one form: comma fractions, ``Z`` and ``+0500``."""
    dotted = F.replace(F.trim(text), F.lit(","), F.lit("."))
    zulu = F.regexp_replace(dotted, "Z$", "+00:00")
    return F.regexp_replace(zulu, r"([+-])(\d{2})(\d{2})$", "$1$2:$3")


def epoch_seconds(value: Column) -> Column:
    return F.timestamp_micros(F.round(value.cast("double") * MICROS).cast("long"))


def epoch_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("long"))


def webkit_micros(value: Column) -> Column:
    """Microseconds since 1601; null unless the result is after 1970."""
    shifted = value.cast("long") - WEBKIT_EPOCH_SECONDS * MICROS
    return F.when(shifted > 0, F.timestamp_micros(shifted))


def clf_instant(text: Column) -> Column:
    """``05/Jan/2024:01:02:03 +0000`` of web access logs."""
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def ctime_instant(text: Column) -> Column:
    """``Fri Jan 05 01:02:03 2024`` read as UTC; the weekday is not needed to place it."""
    no_weekday = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^\S+ ", "")
    return F.try_to_timestamp(no_weekday, F.lit("MMM d HH:mm:ss yyyy"))


def days_to_date(text: Column) -> Column:
    """Days since 1970 as an ISO date text; null for blanks and non-positive values."""
    days = F.trim(text).try_cast("int")
    return F.when(days > 0, F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"))


def _part(amount: Column, unit: str, shown: Column) -> Column:
    return F.when(shown, F.concat(amount.cast("string"), F.lit(unit)))


def duration_text(seconds: Column) -> Column:
    """``1d 2h 3m 4s``, leading zero units left out."""
    s = seconds.cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    text = F.concat_ws(
        " ", _part(days, "d", days > 0), _part(hours, "h", s >= 3600),
        _part(minutes, "m", s >= 60), _part(s % 60, "s", s >= 0))
    return F.when(s < 0, "0s").otherwise(text)


def device_duration_text(seconds: Column) -> Column:
    """``2h 3m 4s`` or ``3m 4s`` for attached devices."""
    s = seconds.cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.concat_ws(" ", _part(hours, "h", hours > 0), _part(minutes, "m", s >= 0),
                       _part(s % 60, "s", s >= 0))


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def minute_text(ts: Column) -> Column:
    """Minute precision for sentences, ``an unknown time`` for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("an unknown time"))


def iso_text(ts: Column) -> Column:
    """``2024-01-05T01:02:03+00:00``, with microseconds only where there are any."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.unix_micros(ts.cast("timestamp")) % MICROS
    return F.concat(base, F.when(fraction != 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0")))
                    .otherwise(""), F.lit("+00:00"))


def export_instant(ts: Column) -> Column:
    """``2024-01-05T01:02:03.000000+00:00``: six digits always, as canonical exports have them."""
    fraction = F.lpad(F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(MICROS)).cast("string"), 6, "0")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), fraction, F.lit("+00:00"))


def outside_hours(local_ts: Column, start_hour: int, end_hour: int) -> Column:
    """True where the local hour is not in [start, end)."""
    hour = F.hour(local_ts)
    return (hour < start_hour) | (hour >= end_hour)


def hour_range(text: str) -> tuple[int, int]:
    """``'08-18'`` to ``(8, 18)``."""
    start, end = text.split("-", 1)
    return int(start), int(end)


# The first ISO timestamp inside an undated event's texts; one without offset is read as UTC (the session
# zone).  Kept as SQL text because findings quote it in their evidence predicate.
WRITTEN_TIME_SQL = (
    "try_to_timestamp(nullif(regexp_extract(concat_ws(' ', coalesce(description, ''), coalesce(notes, '')), "
    r"r'(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[+-]\d{2}:\d{2}|Z)?)', 1), ''))"
)


def written_instant() -> Column:
    return F.expr(WRITTEN_TIME_SQL)
