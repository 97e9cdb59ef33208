"""Rules about what is missing or out of order in the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import sql_quote, strip_quotes
from fleetlens.functions.times import iso_text, micros, minute_text
from fleetlens.operators.joins import with_scalar
from fleetlens.operators.windows import HOUR_MICROS, chunked_scan
from fleetlens.rules.base import LOGINS, finish, listed, per_event, row_order, rule, text
from fleetlens.session import cut_lineage

# Accounts that never use an interactive shell.
SERVICE_ACCOUNTS = (
    "lightdm", "nobody", "daemon", "messagebus", "_apt", "postgres", "mysql",
    "systemd-resolve", "systemd-network", "systemd-timesync", "systemd-coredump",
    "avahi", "colord", "geoclue", "rtkit", "syslog", "sshd", "dnsmasq", "sync",
    "games", "man", "lp", "mail", "news", "uucp", "proxy", "www-data", "backup",
    "list", "irc", "gnats", "bin", "sys", "reboot", "shutdown", "halt", "statd",
    "_rpc", "tss", "uuidd", "tcpdump", "nm-openvpn", "Debian-snmp", "speech-dispatcher",
)
HISTORY_STATES = ("history_missing", "history_empty", "history_symlinked_devnull")
COMMANDS = ("shell_command", "suspicious_command")
EMPTY_LOGIN_RECORDS = ("utmp_empty", "lastlog_absent_or_empty")
MIN_EVENTS_PER_LOG = 40
MIN_RATE_PER_HOUR = 1.0
OFFSET_CHUNK_BYTES = 262_144


def _match_name(column: str = "actor_user"):
    """Name under which rows are counted: the name itself or the one inside single quotes."""
    return F.regexp_replace(F.col(column), r"(?s)^'(.*)'$", "$1")


@rule("wiped_history", wiped_history_min_sessions=3)
def wiped_history(events: DataFrame, wiped_history_min_sessions: int = 3) -> DataFrame:
    """Accounts that log in but leave no command history."""
    clean = strip_quotes(F.col("actor_user"))
    person = (F.col("user") != "") & ~F.col("user").isin(*SERVICE_ACCOUNTS)
    reported = (
        events.filter(F.col("subcategory").isin(*HISTORY_STATES) & F.col("actor_user").isNotNull())
        .withColumn("user", clean).filter(person).groupBy("user")
        .agg(F.min_by(F.struct("event_id", "host_id", "subcategory", "source_artifact_path"), row_order())
             .alias("row")).select("user", "row.*"))
    logins = events.filter(F.col("actor_user").isNotNull() & F.col("subcategory").isin(*LOGINS))
    active = (logins.groupBy("actor_user")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.min_by(F.struct("event_id", "host_id"), row_order()).alias("row"))
              .filter(F.col("n") >= wiped_history_min_sessions)
              .withColumn("user", clean).filter(person)
              .groupBy("user").agg(F.min_by("row", "actor_user").alias("row")))
    typed = (events.filter((F.col("category") == "user_activity") & F.col("subcategory").isin(*COMMANDS)
                           & F.col("actor_user").isNotNull())
             .select(_match_name().alias("user")).distinct())
    silent = (active.join(typed, "user", "left_anti").join(reported, "user", "left_anti")
              .select("user", "row.event_id", "row.host_id", F.lit("history_missing").alias("subcategory"),
                      F.concat(F.lit("home/"), F.col("user"), F.lit("/.bash_history"))
                      .alias("source_artifact_path")))
    sessions = (logins.withColumn("user", _match_name()).groupBy("user")
                .agg(F.count("timestamp_utc").alias("sessions"), F.min("timestamp_utc").alias("lo"),
                     F.max("timestamp_utc").alias("hi"))
                .filter(F.col("sessions") >= wiped_history_min_sessions))
    heads = per_event(reported.unionByName(silent).join(sessions, "user"))
    user, n = F.col("user"), F.col("sessions")
    state = F.when(F.col("subcategory") == "history_missing", "missing").otherwise("empty")
    return finish(
        heads, "wiped_history", "1.0", "high",
        title=text("Command history for ", user, " is missing or empty"),
        what=text(user, " logged in ", n, " times, yet its command history is ", state, "."),
        why="People who work in a shell leave a history; none after many logins means it was removed or "
            "never written, and both take intent.",
        confidence="Medium",
        next_step=text("Check that ", user, " is a person and not a service, then see what happened in "
                       "these sessions."),
        detail=text(f"at least {wiped_history_min_sessions} sessions; counted ", n, " from ",
                    iso_text(F.col("lo")), " to ", iso_text(F.col("hi")), "; history file ",
                    F.col("source_artifact_path"), "; ", F.col("subcategory")),
        host=F.col("host_id"))


@rule("zero_length_login_log")
def zero_length_login_log(events: DataFrame) -> DataFrame:
    """A login record file that exists but holds nothing."""
    others = events.agg(F.count_if(
        F.col("subcategory").isin("successful_login", "session_opened")
        & F.col("timestamp_utc").isNotNull()).alias("others"))
    heads = per_event(with_scalar(events.filter(F.col("subcategory").isin(*EMPTY_LOGIN_RECORDS)), others))
    path, n = F.col("source_artifact_path"), F.col("others")
    return finish(
        heads, "zero_length_login_log", "1.0", "high",
        title=text("Login record file ", path, " is empty"),
        what=text(path, " has no usable login records", F.when(
            n > 0, text(" although other logs show ", n, " logins")), "."),
        why="Emptying the login records is a common way to hide that someone was there.",
        confidence=F.when(n > 0, "High").otherwise("Medium"),
        next_step="Look at the rotated copies and at the journal, which records logins on its own.",
        detail=text(F.col("subcategory"), " at ", path, "; logins elsewhere ", n, "; ", F.col("description")),
        host=F.col("host_id"))


def missing_ranges(present: DataFrame, key: str, number: str, width: int = 10_000) -> DataFrame:
    """Gaps in 1..max per key as rows (key, gap_from, gap_to).

    Ranges instead of single numbers: a dated name such as ``x.20240101`` would otherwise stand for twenty
    million missing copies.
    """
    distinct = present.select(key, number).distinct().filter(F.col(number) >= 1)
    scanned = chunked_scan(distinct, [key], F.col(number), width=width, lags={"below": F.col(number)})
    gaps = scanned.select(key, (F.coalesce("below", F.lit(0)) + 1).alias("gap_from"),
                          (F.col(number) - 1).alias("gap_to"))
    return gaps.filter(F.col("gap_from") <= F.col("gap_to"))


def rotation_members(events: DataFrame) -> DataFrame:
    """(family, number) of every numbered log copy that gave events."""
    pattern = r"^(.+?)\.(\d+)(\.gz)?$"
    path = F.col("source_artifact_path")
    return (events.filter(path.rlike(pattern)).select("source_artifact_path").distinct()
            .select(F.regexp_extract(path, pattern, 1).alias("family"),
                    F.regexp_extract(path, pattern, 2).try_cast("long").alias("number")))


@rule("rotation_gap")
def rotation_gap(events: DataFrame) -> DataFrame:
    """A numbered sequence of log copies with holes."""
    shown = F.when(F.col("gap_from") == F.col("gap_to"), F.col("gap_from").cast("string")).otherwise(
        F.concat("gap_from", F.lit("-"), "gap_to"))
    members = cut_lineage(rotation_members(events))
    # A family has as many gaps as numbered copies at most.
    heads = (missing_ranges(members, "family", "number").groupBy("family")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("gap_from", shown.alias("s")))),
                              lambda g: g["s"]).alias("gaps"))
             .join(members.groupBy("family").agg(F.max("number").alias("highest")), "family")
             .withColumn("evidence_filter", text("startswith(source_artifact_path, ",
                                                 sql_quote(F.concat("family", F.lit("."))), ")")))
    family = F.col("family")
    return finish(
        listed(heads, F.array().cast("array<string>")), "rotation_gap", "1.0", "medium",
        title=text("Gap in the rotation sequence of ", family),
        what=text("Copies ", F.array_join("gaps", ", "), " of ", family, " are missing, while number ",
                  F.col("highest"), " is there."),
        why="Rotation numbers its copies without holes; a missing one was deleted or not collected.",
        confidence="Medium",
        next_step="See whether the missing copies were unreadable at collection, or rotation was changed.",
        detail=text("family ", family, "; highest ", F.col("highest"), "; missing ",
                    F.array_join("gaps", ", ")))


def first_long_gaps(events: DataFrame, keys: list[str], min_gap_hours: float, min_events: int,
                    min_rate: float) -> DataFrame:
    """First silence of at least the given length in every log that is otherwise busy."""
    dated = events.filter(F.col("timestamp_utc").isNotNull()).select(
        *keys, "event_id", "event_hash", micros(F.col("timestamp_utc")).alias("at"))
    dated = cut_lineage(dated)
    stats = (dated.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
             .withColumn("span_hours", (F.col("hi") - F.col("lo")) / HOUR_MICROS)
             .filter((F.col("n") >= min_events) & (F.col("span_hours") > 0)
                     & (F.col("n") / F.col("span_hours") >= min_rate)))
    previous = chunked_scan(dated, keys, F.col("at"), ["event_hash"],
                            lags={"previous": F.struct("at", "event_id")})
    gaps = (previous.filter(F.col("at") - F.col("previous.at") >= int(min_gap_hours * HOUR_MICROS))
            .groupBy(*keys)
            .agg(F.min_by(F.struct("previous", "at", "event_id"), F.struct("at", "event_hash")).alias("gap")))
    return gaps.join(stats, keys).select(
        *keys, "n", "span_hours", F.col("gap.previous.at").alias("from_us"), F.col("gap.at").alias("to_us"),
        F.col("gap.previous.event_id").alias("from_id"), F.col("gap.event_id").alias("to_id"))


@rule("timeline_gap", timeline_gap_hours=6)
def timeline_gap(events: DataFrame, timeline_gap_hours: float = 6, min_events: int = MIN_EVENTS_PER_LOG,
                 min_rate: float = MIN_RATE_PER_HOUR, scope: str = "case") -> DataFrame:
    """A busy log that falls silent for hours; the first silence of each log."""
    keys = ["source_artifact_path"] + (["host_id"] if scope == "host" else [])
    heads = first_long_gaps(events, keys, timeline_gap_hours, min_events, min_rate)
    pair = F.array_sort(F.array("from_id", "to_id"))
    heads = (listed(heads, pair)
             .withColumn("evidence_filter", text("event_id IN ('", F.array_join(pair, "', '"), "')"))
             .withColumn("first", F.timestamp_micros("from_us")).withColumn("last", F.timestamp_micros("to_us"))
             .withColumn("hours", (F.col("to_us") - F.col("from_us")) / HOUR_MICROS))
    path = F.col("source_artifact_path")
    return finish(
        heads, "timeline_gap", "1.0", "medium",
        title=text(F.format_string("%.1f", "hours"), "-hour silence in ", path),
        what=text(path, " writes about ", F.format_string("%.1f", F.col("n") / F.col("span_hours")),
                  " lines an hour but none between ", minute_text(F.col("first")), " and ",
                  minute_text(F.col("last")), "."),
        why="The machine was off, logging was stopped, or lines were taken out; only the first is harmless.",
        confidence="Medium",
        next_step="Compare with the boot records and with restarts of the logging service.",
        detail=text(F.col("n"), " events in ", F.format_string("%.1f", "span_hours"),
                    f" hours; silence of at least {timeline_gap_hours:g}h from ", iso_text(F.col("first")),
                    " to ", iso_text(F.col("last"))),
        host=F.col("host_id") if scope == "host" else None,
        first=F.col("first"), last=F.col("last"))


def inversions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per log: how many lines are dated before the line above them, and the first such pair."""
    dated = events.filter(F.col("timestamp_utc").isNotNull() & F.col("raw_line_offset").isNotNull()).select(
        *keys, "event_id", "event_hash", "raw_line_offset", "timestamp_utc")
    scanned = chunked_scan(dated, keys, F.col("raw_line_offset"), ["event_hash"], width=OFFSET_CHUNK_BYTES,
                           lags={"above": F.struct("event_id", "timestamp_utc", "raw_line_offset")})
    row = F.struct("event_id", "timestamp_utc", "raw_line_offset", "above")
    return (scanned.filter(F.col("timestamp_utc") < F.col("above.timestamp_utc")).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("inversions"),
                 F.min_by(row, F.struct("raw_line_offset", "event_hash")).alias("bad")))


@rule("backwards_timestamps")
def backwards_timestamps(events: DataFrame, scope: str = "case") -> DataFrame:
    """Time runs backwards inside one log."""
    keys = ["source_artifact_path"] + (["host_id"] if scope == "host" else [])
    pair = F.array_sort(F.array("bad.above.event_id", "bad.event_id"))
    heads = (listed(inversions(events, keys), pair)
             .withColumn("evidence_filter", text("event_id IN ('", F.array_join(pair, "', '"), "')")))
    path, n = F.col("source_artifact_path"), F.col("inversions")
    return finish(
        heads, "backwards_timestamps", "1.0", "medium",
        title=text("Timestamps run backwards inside ", path),
        what=text(n, " line(s) of ", path, " carry an earlier time than the line above, the first at ",
                  minute_text(F.col("bad.timestamp_utc")), "."),
        why="A log is written in order; going back means a changed clock or edited lines, and times around "
            "it cannot be compared.",
        confidence="High",
        next_step="Look for clock changes at that time; do not trust the order of this file until then.",
        detail=text(n, " inversion(s) by offset; first at ", F.col("bad.raw_line_offset"), ": ",
                    iso_text(F.col("bad.timestamp_utc")), " after ",
                    iso_text(F.col("bad.above.timestamp_utc")), " at ", F.col("bad.above.raw_line_offset")),
        host=F.col("host_id") if scope == "host" else None, first=F.col("bad.timestamp_utc"))


@rule("journald_sequence_gap")
def journald_sequence_gap(events: DataFrame) -> DataFrame:
    """Journal records that are missing by their sequence numbers."""
    heads = per_event(events.filter(F.col("subcategory") == "journal_sequence_gap"))
    path = F.col("source_artifact_path")
    return finish(
        heads, "journald_sequence_gap", "1.0", "high",
        title=text("Journald log sequence gap detected in ", path),
        what=text("Sequence numbers jump in ", path, ": ", F.col("description"), "."),
        why="Journal numbers have no holes; missing ones were dropped, purged or deleted.",
        confidence="High",
        next_step="Check for a restart of the journal service, a full disk or rate limiting at that time.",
        detail=text(F.col("description"), "; ", F.col("notes")),
        host=F.col("host_id"), first=F.col("timestamp_utc"))
