"""Rules about commands that were run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ids import evidence_lanes
from fleetlens.functions.patterns import MALICIOUS_COMMAND
from fleetlens.functions.text import COMMAND_SQL, command_of, first_filled, sql_quote
from fleetlens.functions.times import micros, minute_text
from fleetlens.operators.joins import MINUTE_MICROS, look_along_time, salted_join
from fleetlens.rules.auth import HEAVY_FAILURE_COUNT, guessing_addresses
from fleetlens.rules.base import (
    EVIDENCE, ONE_EVENT, EvidenceKind, counted, finish, keyed, pair_key, quoted_list, row_order, rule, text,
)
from fleetlens.session import cut_lineage

# Which artifact an execution event comes from.
SOURCE_KIND = {
    "process_execution": "audit",
    "sudo_execution": "audit",
    "running_process": "process_list",
    "shell_command": "history",
    "suspicious_command": "history",
}
SOURCE_LABEL = {
    "audit": "kernel audit trail",
    "process_list": "process snapshot",
    "history": "shell history",
}
CRON_FINDINGS = ("suspicious_cron_command", "suspicious_cron_job")

MALICIOUS_SQL = ("rlike(concat(coalesce(description, ''), ' ', coalesce(raw_line, '')), "
                 f"r'{MALICIOUS_COMMAND}')")


def is_malicious() -> Column:
    return F.col("subcategory").isin(*SOURCE_KIND) & F.expr(MALICIOUS_SQL)


def planted() -> Column:
    return F.col("subcategory").isin(*CRON_FINDINGS)


def cron_command() -> Column:
    return F.trim(F.coalesce("raw_line", F.lit("")))


EVIDENCE["malicious_commands"] = EvidenceKind(is_malicious, lambda: pair_key(F.col("host_id"), command_of()))
EVIDENCE["planted_cron_commands"] = EvidenceKind(planted, lambda: pair_key(F.col("host_id"), cron_command()))


@rule("suspicious_process", "1.1", suspicious_process_window=60)
def suspicious_process(events: DataFrame, suspicious_process_window: float = 60,
                       heavy_failures: int = HEAVY_FAILURE_COUNT) -> DataFrame:
    """A command of malicious shape; the same command of a host in several artifacts is one finding.

    Confidence is High when a login from a password-guessing address came at most the window before.
    """
    width = int(suspicious_process_window * MINUTE_MICROS)
    kind = F.coalesce(*[F.when(F.col("subcategory").isin(*[s for s, k in SOURCE_KIND.items() if k == name]),
                               name) for name in SOURCE_LABEL])
    members = (events.filter(is_malicious())
               .select("event_id", "event_hash", "host_id", "timestamp_utc", "subcategory",
                       "source_artifact_path", "raw_line", command_of().alias("command"),
                       kind.alias("kind")))
    members = cut_lineage(members)  # one pass over the event table
    key = ["host_id", "command"]
    heads = members.groupBy(*key).agg(
        *counted(), F.min("timestamp_utc").alias("first"),
        F.max("timestamp_utc").alias("last"),
        F.min_by(F.struct("raw_line", "source_artifact_path"), row_order()).alias("row"),
        *[F.min(F.when(F.col("kind") == k, row_order())).alias(f"first_{k}") for k in SOURCE_LABEL],
        *[F.max((F.col("subcategory") == s).cast("int")).alias(f"has_{s}") for s in SOURCE_KIND])
    logins = cut_lineage(salted_join(
        events.filter((F.col("subcategory") == "successful_login") & F.col("source_ip").isNotNull()
                      & F.col("timestamp_utc").isNotNull())
        .select("event_id", "event_hash", "source_ip", "timestamp_utc"),
        guessing_addresses(events, heavy_failures), ["source_ip"], "left_semi"))
    at = micros(F.col("timestamp_utc"))
    near = look_along_time(
        members.filter(F.col("timestamp_utc").isNotNull())
        .select(*key, "event_id", "event_hash", "timestamp_utc"), logins, anchor_id="event_id", keys=[],
        instants={"before": at - width - 1}, item_time=at, sums={"n": F.lit(1)},
        item=F.struct("event_id", "source_ip", "timestamp_utc"))
    first_login = F.col("before.next")
    matched = (near.filter(first_login.getField("at") <= at).groupBy(*key)
               .agg(F.min_by(first_login.getField("item"), row_order()).alias("login")))
    login, key_of = F.col("login.event_id"), pair_key(F.col("host_id"), F.col("command"))
    heads = (heads.join(matched, key, "left")
             .withColumn("members", F.col("event_count"))
             .withColumns({lane: F.col(lane) + F.when(login.isNull(), 0).otherwise(own)
                           for lane, own in evidence_lanes(login).items()})
             .withColumn("event_count", F.col("event_count") + F.when(login.isNull(), 0).otherwise(1))
             .withColumn("evidence", F.filter(
                 F.array(keyed("malicious_commands", key_of), keyed(ONE_EVENT, login)), lambda e: e["key"].isNotNull()))
             .withColumn("evidence_filter", text(
                 "(host_id = ", sql_quote(F.col("host_id")),
                 f" AND subcategory IN ({quoted_list(SOURCE_KIND)}) AND {MALICIOUS_SQL} AND {COMMAND_SQL} = ",
                 sql_quote(F.col("command")), ")",
                 F.when(F.col("login").isNotNull(), text(" OR event_id = '", F.col("login.event_id"), "'"))))
             .withColumn("kinds", F.transform(
                 F.array_sort(F.filter(
                     F.array(*[F.struct(F.col(f"first_{k}").alias("o"), F.lit(k).alias("k"))
                               for k in SOURCE_LABEL]), lambda e: e["o"].isNotNull())),
                 lambda e: e["k"])))
    shown = first_filled(F.col("command"), F.col("row.raw_line"), "(unparsed)")
    labels = F.array_join(F.transform("kinds", lambda k: F.coalesce(
        *[F.when(k == name, label) for name, label in SOURCE_LABEL.items()])), ", ")
    history_only = F.array_join("kinds", ",") == "history"
    subcats = F.array_join(F.array_compact(F.array(
        *[F.when(F.col(f"has_{s}") == 1, s) for s in sorted(SOURCE_KIND)])), ", ")
    why = text(
        F.when(F.col("login").isNotNull(), text(
            "It ran soon after a login from ", F.col("login.source_ip"),
            ", an address that had guessed passwords: break-in first, payload next."))
        .when(F.col("first").isNull() & history_only,
              "A shell history holds this command without a time; it still has to be explained.")
        .when(F.col("first").isNull(),
              "It was running when evidence was collected; when it started is not known.")
        .otherwise("Commands of this shape have no place in normal work."),
        F.when(history_only, " A history shows what was typed, not what ran, and its owner can edit it."))
    return finish(
        heads, "suspicious_process", "1.1", "high",
        title=text("Suspicious command executed: ", shown),
        what=text("A command of a known malicious shape was seen: ", shown,
                  F.when(F.size("kinds") > 1, text(" (recorded in the ", labels, ")"))),
        why=why, confidence=F.when(F.col("login").isNotNull(), "High").otherwise("Medium"),
        next_step=F.when(history_only, "Confirm it in a second record before relying on it.").otherwise(
            "Find parent process, user and outbound connection; keep the program as evidence."),
        detail=text("in ", subcats, " at ", F.col("row.source_artifact_path"), "; sources ", labels,
                    "; occurrences ", F.col("members"),
                    F.when(F.col("login").isNotNull(), text(
                        "; login ", F.col("login.event_id"), " from ", F.col("login.source_ip")))),
        host=F.col("host_id"), first=F.col("first"), last=F.col("last"))


@rule("suspicious_cron")
def suspicious_cron(events: DataFrame) -> DataFrame:
    """A scheduled command of suspicious shape, with or without a login near it."""
    rows = events.filter(planted()).withColumn("command", cron_command())
    key = ["host_id", "command"]
    ran = F.col("subcategory") == "suspicious_cron_command"
    named = F.col("actor_user") != ""
    heads = rows.groupBy(*key).agg(
        *counted(), F.count_if(ran).alias("executions"),
        F.count_if(~ran).alias("schedules"),
        F.min(F.when(ran, F.col("timestamp_utc"))).alias("first"),
        F.max(F.when(ran, F.col("timestamp_utc"))).alias("last"),
        F.min_by("actor_user", F.when(named, row_order())).alias("user"),
        F.min("source_artifact_path").alias("path"))
    matched = F.regexp_extract("command", MALICIOUS_COMMAND, 0)
    heads = heads.withColumn("evidence_filter", text(
        "host_id = ", sql_quote(F.col("host_id")), f" AND subcategory IN ({quoted_list(CRON_FINDINGS)})"
        " AND trim(coalesce(raw_line, '')) = ", sql_quote(F.col("command")))).withColumn(
        "evidence", F.array(keyed("planted_cron_commands", pair_key(F.col("host_id"), F.col("command")))))
    shown = first_filled(F.trim(matched), F.col("command"), "(unparsed cron command)")
    return finish(
        heads, "suspicious_cron", "1.0", "high",
        title=text("Suspicious command run from cron: ", shown),
        what=text("A scheduled task of ", F.coalesce("user", F.lit("root")), " runs: ", shown, ".",
                  F.when(F.col("schedules") > 0, " It is on a schedule."),
                  F.when(F.col("executions") > 0, text(" It ran ", F.col("executions"), " time(s)")),
                  F.when(F.col("first").isNotNull(), text(
                      " from ", minute_text(F.col("first")), " to ", minute_text(F.col("last")))),
                  F.when(F.col("executions") > 0, ".")),
        why="A timer that fetches or opens a shell keeps an intruder's code running without any login.",
        confidence=F.when(matched != "", "High").otherwise("Medium"),
        next_step="Open the entry, check where it connects to, and keep a copy before removing it.",
        detail=text("first path ", F.col("path"), "; schedules ", F.col("schedules"), "; executions ",
                    F.col("executions")),
        host=F.col("host_id"), first=F.col("first"), last=F.col("last"))
