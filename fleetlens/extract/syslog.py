"""Login, cron and journal records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.extract.base import (
    OFFSET_CHUNK_BYTES, dated, extractor, join_small, tool_generated, with_columns,
)
from fleetlens.extract.grammar import line_matches, sentence
from fleetlens.functions.patterns import suspicious_reasons
from fleetlens.functions.structured import first_field
from fleetlens.functions.text import blank_to_null, truncate_bytes
from fleetlens.functions.times import (
    ANCHOR_LINES, ISO_ANCHOR, epoch_micros, has_syslog_prefix, iso_instant, syslog_wall_clock, to_utc,
)
from fleetlens.operators.windows import chunked_scan
from fleetlens.session import cut_lineage

# Where these logs lie, journal fields, and the cron command form.
AUTH_LOGS = ("var/log/auth.log", "var/log/auth.log.*", "var/log/secure", "var/log/secure.*")
CRON_LOGS = ("var/log/cron", "var/log/cron.*", "var/log/cron-*", "var/log/cron.log*", "var/log/syslog",
             "var/log/syslog.*", "var/log/messages", "var/log/messages.*")
JOURNALS = ("journal/*.json", "journal/*.json.gz")
CRON_COMMAND = r"CMD \((.*)\)\s*$"
JOURNAL_SCHEMA = ("MESSAGE string, _COMM string, SYSLOG_IDENTIFIER string, _EXE string, _PID string, "
                  "SYSLOG_PID string, __REALTIME_TIMESTAMP string, __SEQNUM string, _broken string")
LOGIN_PROGRAMS = ("sshd", "login", "sudo")
MESSAGE_LENGTH = 500


def anchor_years(lines: DataFrame) -> DataFrame:
    """Year of the first ISO timestamp near the top of a file, for files that have one."""
    year = F.regexp_extract("line", ISO_ANCHOR, 1)
    return (lines.filter((F.col("line_no") <= ANCHOR_LINES) & F.col("line").rlike(ISO_ANCHOR))
            .groupBy("host_id", "artifact_path")
            .agg(F.min_by(year.cast("int"), "line_no").alias("anchor_year")))


def grammar_events(lines: DataFrame, cron: bool = False) -> DataFrame:
    """One event per grammar rule found in a line."""
    # Lines without a match have no row after this.
    timed = with_log_time(lines.withColumn("m", F.explode(line_matches("line", "distro_id"))))
    m = F.col("m")
    return dated(
        timed, F.col("instant"), F.col("confidence"), category=m["category"], subcategory=m["subcategory"],
        severity=m["severity"], actor_user=m["user"], actor_uid=m["uid"].try_cast("long"),
        actor_process=m["process"], source_ip=m["ip"], description=sentence(m, cron), raw_line=F.col("line"),
        raw_line_offset=F.col("byte_offset"), notes=F.concat(F.lit("grammar:"), m["rule"]),
        tool_generated_flag=tool_generated(m["ip"], F.col("instant"), m["user"], F.col("contamination")))


def with_log_time(rows: DataFrame) -> DataFrame:
    """Add ``instant`` and ``confidence`` from a syslog prefix or a leading ISO timestamp.

    Rows carry the ``anchor_year`` of their file, see :func:`with_years`.
    """
    zone = F.col("tz_name")
    wall = syslog_wall_clock(F.col("line"), F.col("artifact_mtime"), zone, F.col("anchor_year"))
    rows = rows.withColumns({"wall": wall, "prefixed": has_syslog_prefix(F.col("line"))})
    return (rows.withColumn("instant", F.when(F.col("prefixed"), to_utc(F.col("wall"), zone)).otherwise(
                iso_instant(F.substring("line", 1, 32), zone)))
            .withColumn("confidence", F.when(F.col("prefixed"), "year_inferred").otherwise("exact"))
            .drop("wall", "prefixed"))


def with_years(lines: DataFrame) -> DataFrame:
    """Attach the anchor year of each file (null for most), unless the lines have it."""
    if "anchor_year" in lines.columns:
        return lines
    return join_small(lines, cut_lineage(anchor_years(lines)), ["host_id", "artifact_path"])


@extractor("authlog_parser", AUTH_LOGS, by_year=True)
def auth_log(lines: DataFrame) -> DataFrame:
    return grammar_events(with_years(lines))


@extractor("cronlog_parser", CRON_LOGS, by_year=True)
def cron_log(lines: DataFrame) -> DataFrame:
    """Grammar events plus a derived event for cron commands that look planted."""
    events = grammar_events(with_years(lines), cron=True)
    stored = truncate_bytes(F.col("line"))
    planted = (F.col("subcategory") == "cron_command") & stored.rlike(CRON_COMMAND)
    events = events.withColumn("command", F.when(planted, F.trim(F.regexp_extract(stored, CRON_COMMAND, 1))))
    events = events.withColumn("why", F.when(F.col("command").isNotNull(), suspicious_reasons(F.col("command"))))
    # Lines are read once: a row whose command looks planted becomes two.
    found = F.coalesce(F.size("why") > 0, F.lit(False))
    rows = events.withColumn("derived", F.explode(F.when(found, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    own = lambda value, name: F.when(F.col("derived"), value).otherwise(F.col(name))
    # The command is quoted with its own offset, so both events keep different ids.
    offset = F.col("byte_offset") + F.greatest(F.position(F.col("command"), stored) - 1, F.lit(0))
    description = F.concat(
        F.lit("Suspicious command executed by cron as "),
        F.coalesce(blank_to_null(F.col("actor_user")), F.lit("unknown user")), F.lit(": "), F.col("command"),
        F.lit(" -- "), F.array_join("why", "; "))
    none = F.lit(None)
    return with_columns(
        rows, subcategory=own(F.lit("suspicious_cron_command"), "subcategory"), actor_process=own(F.lit("cron"), "actor_process"),
        severity=own(F.lit("high"), "severity"), raw_line=own(F.col("command"), "raw_line"),
        notes=own(F.lit("derived_from:cron_command"), "notes"), actor_uid=own(none, "actor_uid"), source_ip=own(none, "source_ip"),
        raw_line_offset=own(offset, "raw_line_offset"), description=own(description, "description")).drop("command", "why", "derived")


def journal_entries(lines: DataFrame) -> DataFrame:
    """JSON lines to one row per readable entry; broken lines and non-objects are left out."""
    entry = F.from_json("line", JOURNAL_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    octets = F.from_json("line", "MESSAGE array<int>")["MESSAGE"]
    hex_text = F.array_join(F.transform(octets, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), "")
    rows = lines.filter(F.col("line").rlike(r"^\s*\{")).withColumn("e", entry)
    rows = rows.filter(F.col("e").isNotNull() & F.col("e._broken").isNull())
    message = F.when(octets.isNotNull(), F.make_valid_utf8(F.unhex(hex_text).cast("string"))).otherwise(
        F.coalesce(F.col("e.MESSAGE"), F.lit("")))
    e = F.col("e")
    return with_columns(
        rows, message=message,
        comm=F.coalesce(first_field(e, "_COMM", "SYSLOG_IDENTIFIER", "_EXE"), F.lit("")),
        pid=F.coalesce(first_field(e, "_PID", "SYSLOG_PID"), F.lit("")),
        instant=epoch_micros(e["__REALTIME_TIMESTAMP"].try_cast("long")),
        seq=e["__SEQNUM"].try_cast("long")).drop("e")


def sequence_gaps(entries: DataFrame) -> DataFrame:
    """Entries whose number is more than one above the last number before them, with ``before``."""
    scanned = chunked_scan(entries, ["host_id", "artifact_path"], F.col("byte_offset"),
                           width=OFFSET_CHUNK_BYTES, carried_before={"before": F.col("seq")})
    return scanned.filter(F.col("seq") > F.col("before") + 1)


@extractor("journald_parser", JOURNALS)
def journal(lines: DataFrame) -> DataFrame:
    """Grammar events of journal messages, plain messages for the rest, and sequence gaps."""
    entries = journal_entries(lines)
    text = F.when(F.col("comm") != "", F.concat(
        "comm", F.lit("["), "pid", F.lit("]: "), "message")).otherwise(F.col("message"))
    notes = F.concat(F.lit("journald _COMM="), "comm", F.lit(" _PID="), "pid")
    rows = entries.withColumn("text", text).withColumn("m", F.explode_outer(line_matches("text", "distro_id")))
    m, none = F.col("m"), F.col("m").isNull()
    events = dated(
        rows, F.col("instant"),
        category=F.when(none, F.when(F.col("comm").isin(*LOGIN_PROGRAMS), "login_activity").otherwise(
            "environment")).otherwise(m["category"]),
        subcategory=F.when(none, "journal_message").otherwise(m["subcategory"]),
        severity=F.when(none, "info").otherwise(m["severity"]),
        actor_user=m["user"], actor_uid=m["uid"].try_cast("long"),
        actor_process=F.coalesce(m["process"], blank_to_null(F.col("comm"))), source_ip=m["ip"],
        description=F.when(none, F.coalesce(blank_to_null(F.substring("message", 1, MESSAGE_LENGTH)),
                                            F.lit("(empty journal entry)"))).otherwise(sentence(m)),
        raw_line=F.col("line"), raw_line_offset=F.col("byte_offset"),
        notes=F.when(none, notes).otherwise(F.concat(notes, F.lit(" grammar:"), m["rule"])),
        tool_generated_flag=F.when(none, False).otherwise(
            tool_generated(m["ip"], F.col("instant"), m["user"], F.col("contamination"))))
    gap, expected = F.col("seq") - F.col("before") - 1, F.col("before") + 1
    gaps = dated(
        sequence_gaps(entries), F.col("instant"), category="environment", subcategory="journal_sequence_gap",
        severity="high", actor_process="systemd-journald", raw_line=F.col("line"),
        raw_line_offset=F.col("byte_offset"),
        description=F.format_string("Journal sequence gap detected: expected seq %d, got %d (%d missing records)",
                                    expected, F.col("seq"), gap),
        notes=F.format_string("SEQUENCE_GAP expected=%d actual=%d gap=%d", expected, F.col("seq"), gap))
    return events.drop("m", "text").unionByName(gaps.drop("before"), allowMissingColumns=True)
