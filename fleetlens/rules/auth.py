"""Rules about logins, new accounts and administrator activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ids import evidence_lanes
from fleetlens.functions.text import first_filled, sql_quote, strip_quotes
from fleetlens.functions.times import (
    WRITTEN_TIME_SQL, iso_text, micros, minute_text, outside_hours, written_instant,
)
from fleetlens.operators.joins import MINUTE_MICROS, look_along_time, salted_join
from fleetlens.operators.search import not_tool_noise
from fleetlens.rules.base import (
    EVIDENCE, FAILURES, ONE_EVENT, PASSWORD_FAILURES, EvidenceKind, counted, finish, keyed, quoted_list, row_order, rule, text,
)
from fleetlens.session import cut_lineage

NOT_NOISE_SQL = "NOT coalesce(tool_generated_flag, false)"

# Events that grant rights, and events that leave a way back in.
GRANTS = ("group_membership_added", "group_added", "privileged_group_member", "passwordless_sudo",
          "sudo_privilege")
PERSISTENCE = ("cron_job", "suspicious_cron_job", "cron_job_added", "systemd_unit", "systemd_timer",
               "suspicious_systemd_unit", "authorized_key", "authorized_key_added",
               "suspicious_startup_line", "ld_preload_set")
HEAVY_FAILURE_COUNT = 5
NARROW = ("event_id", "event_hash", "host_id", "subcategory", "timestamp_utc", "source_ip", "actor_user",
          "source_artifact_path")
SUCCESS_GRACE_MINUTES = 10


def is_failure() -> Column:
    return (F.col("subcategory").isin(*FAILURES) & F.col("source_ip").isNotNull()
            & F.col("timestamp_utc").isNotNull() & not_tool_noise())


def failures_of(events: DataFrame) -> DataFrame:
    return events.filter(is_failure())


def sums_between(start: str, end: str, anchor: str) -> dict[str, Column]:
    """Digest sums of the items between two instants of :func:`look_along_time`, and of the anchor's own event."""
    return {lane: F.col(f"{end}.{lane}") - F.col(f"{start}.{lane}") + own for lane, own in evidence_lanes(F.col(anchor)).items()}


def instant() -> Column:
    return micros(F.col("timestamp_utc"))


def written() -> Column:
    return micros(F.when(F.col("timestamp_utc").isNull(), written_instant()))


def grants_rights() -> Column:
    return F.col("subcategory").isin(*GRANTS)


def lasts() -> Column:
    return F.col("subcategory").isin(*PERSISTENCE)


EVIDENCE["failures_of_address"] = EvidenceKind(is_failure, lambda: F.col("source_ip"))
EVIDENCE["failures_before_login"] = EvidenceKind(is_failure, lambda: F.col("source_ip"), instant, 15 * MINUTE_MICROS)
EVIDENCE["grants_to_account"] = EvidenceKind(grants_rights, lambda: F.col("actor_user"), instant, 60 * MINUTE_MICROS)
EVIDENCE["lasting_changes_case"] = EvidenceKind(lasts, lambda: F.lit(""), instant, 120 * MINUTE_MICROS)
EVIDENCE["undated_changes_case"] = EvidenceKind(lasts, lambda: F.lit(""), written, 120 * MINUTE_MICROS)
EVIDENCE["lasting_changes_host"] = EvidenceKind(lasts, lambda: F.col("host_id"), instant, 120 * MINUTE_MICROS)
EVIDENCE["undated_changes_host"] = EvidenceKind(lasts, lambda: F.col("host_id"), written, 120 * MINUTE_MICROS)


def guessing_addresses(events: DataFrame, at_least: int = HEAVY_FAILURE_COUNT) -> DataFrame:
    """Addresses with many password failures over the whole table (PAM failures not counted)."""
    return (events.filter(F.col("subcategory").isin(*PASSWORD_FAILURES) & F.col("source_ip").isNotNull())
            .groupBy("source_ip").agg(F.count(F.lit(1)).alias("failures"))
            .filter(F.col("failures") >= at_least).select("source_ip"))


def peak_in_window(events: DataFrame, key: str, window_minutes: float) -> DataFrame:
    """Largest number of events of a key in any trailing window, both ends included."""
    width = int(window_minutes * MINUTE_MICROS)
    at = F.col("at")
    per_instant = (events.groupBy(key, micros(F.col("timestamp_utc")).alias("at"))
                   .agg(F.count(F.lit(1)).alias("n")))
    # Every instant opens a window [at, at + width]: its total ends at the last event inside.
    ends = look_along_time(
        per_instant.select(key, "at", F.struct(key, "at").alias("point")), per_instant, anchor_id="point",
        keys=[key], instants={"before": at - 1, "end": at + width}, item_time=at, sums={"n": F.col("n")})
    return ends.groupBy(key).agg(F.max(F.col("end.n") - F.col("before.n")).alias("peak"))


@rule("brute_force", brute_force_min=5, brute_force_window=5)
def brute_force(events: DataFrame, brute_force_min: int = 5, brute_force_window: float = 5) -> DataFrame:
    """Many failures from one address inside a short window; all its failures are the evidence."""
    failures = cut_lineage(failures_of(events).select(*NARROW))
    bursts = (peak_in_window(failures, "source_ip", brute_force_window)
              .filter(F.col("peak") >= brute_force_min))
    campaigns = failures.groupBy("source_ip").agg(
        *counted(),
        F.min("timestamp_utc").alias("first"), F.max("timestamp_utc").alias("last"),
        F.min_by("host_id", row_order()).alias("host"),
        F.count_distinct(F.when(F.col("actor_user") != "", F.col("actor_user"))).alias("users"),
        F.min(F.when(F.col("actor_user") != "", F.col("actor_user"))).alias("a_user"))
    heads = campaigns.join(bursts, "source_ip").withColumn("evidence_filter", text(
        "source_ip = ", sql_quote(F.col("source_ip")), f" AND subcategory IN ({quoted_list(FAILURES)})"
        f" AND timestamp_utc IS NOT NULL AND {NOT_NOISE_SQL}"))
    heads = heads.withColumn("evidence", F.array(keyed("failures_of_address", F.col("source_ip"))))
    ip, n = F.col("source_ip"), F.col("event_count")
    target = F.when(F.col("users") == 1, text("account ", F.col("a_user"))).otherwise(
        text(F.col("users"), " accounts"))
    return finish(
        heads, "brute_force", "1.0", "medium",
        title=text("Repeated failed logins from ", ip),
        what=text(n, " logins from ", ip, " failed between ", minute_text(F.col("first")), " and ",
                  minute_text(F.col("last")), "; they were aimed at ", target, "."),
        why="Passwords are being guessed from this address; later events tell whether one was right.",
        confidence="High",
        next_step=text("Find out who owns ", ip, " and whether a later login from it worked."),
        detail=text(f"at least {brute_force_min} failures in {brute_force_window} minutes; peak ",
                    F.col("peak"), ", total ", n, ", accounts tried ", F.col("users")),
        host=F.col("host"), first=F.col("first"), last=F.col("last"))


@rule("brute_force_success", brute_force_min=5)
def brute_force_success(events: DataFrame, brute_force_min: int = 5,
                        look_back_minutes: float = 5 + SUCCESS_GRACE_MINUTES) -> DataFrame:
    """A login that works right after many failures from the same address."""
    width = int(look_back_minutes * MINUTE_MICROS)
    login = F.col("subcategory") == "successful_login"
    # One pass over the event table; everything below works on this narrow part.
    rows = cut_lineage(events.filter(
        F.col("subcategory").isin(*FAILURES, "successful_login") & F.col("source_ip").isNotNull()
        & F.col("timestamp_utc").isNotNull() & not_tool_noise()).select(*NARROW))
    failures, at = rows.filter(~login), F.col("at")
    logins = rows.filter(login).select(
        F.col("event_id").alias("login_id"), "source_ip", "host_id", "actor_user", "source_artifact_path",
        F.col("timestamp_utc").alias("anchor_ts"), micros(F.col("timestamp_utc")).alias("at"))
    looked = look_along_time(
        logins, failures, anchor_id="login_id", keys=["source_ip"],
        instants={"before": at - width - 1, "end": at - 1}, item_time=micros(F.col("timestamp_utc")),
        sums={"n": F.lit(1), **evidence_lanes(F.col("event_id"))}, item=F.col("timestamp_utc"))
    heads = cut_lineage(
        looked.withColumns(sums_between("before", "end", anchor="login_id")).withColumn("prior", F.col("end.n") - F.col("before.n"))
        .withColumn("first", F.col("before.next.item"))
        .filter(F.col("prior") >= brute_force_min).drop("before", "end"))
    ip = F.col("source_ip")
    user = first_filled(F.col("actor_user"), "an account")
    heads = (heads.withColumn("event_count", F.col("prior") + 1)
             .withColumn("evidence", F.array(keyed("failures_before_login", ip, F.col("at") - width, F.col("at") - 1),
                                             keyed(ONE_EVENT, F.col("login_id"))))
             .withColumn("evidence_filter", text(
                 "event_id = '", F.col("login_id"), "' OR (source_ip = ", sql_quote(ip),
                 f" AND subcategory IN ({quoted_list(FAILURES)}) AND timestamp_utc >= timestamp_micros(",
                 F.col("at") - width, ") AND timestamp_utc < timestamp_micros(", F.col("at"),
                 f") AND {NOT_NOISE_SQL})")))
    return finish(
        heads, "brute_force_success", "1.0", "high",
        title=text("Successful login from ", ip, " immediately after repeated failures"),
        what=text("After ", F.col("prior"), " failures the address ", ip, " got in as ", user, " at ",
                  minute_text(F.col("anchor_ts")), "."),
        why="Success after a run of failures mostly means a guessed password; what the account did next "
            "may be the intruder's work.",
        confidence="High",
        next_step=text("Ask whether ", user, " really logs in from ", ip,
                       "; if not, lock the account and revoke its keys."),
        detail=text(F.col("prior"), f" failures from ", ip, f" in the {look_back_minutes:g} minutes before ",
                    iso_text(F.col("anchor_ts")), "; login ", F.col("login_id"), " in ",
                    F.col("source_artifact_path")),
        host=F.col("host_id"), first=F.col("first"), last=F.col("anchor_ts"))


@rule("new_account_privilege_grant", account_grant_window=60)
def new_account_privilege_grant(events: DataFrame, account_grant_window: float = 60) -> DataFrame:
    """An account is created and gets administrator rights soon after."""
    width = int(account_grant_window * MINUTE_MICROS)
    creation = (F.col("subcategory") == "account_created") & (F.col("actor_user") != "") & not_tool_noise()
    rows = cut_lineage(events.filter(
        (creation | F.col("subcategory").isin(*GRANTS)) & F.col("actor_user").isNotNull()
        & F.col("timestamp_utc").isNotNull()).select(*NARROW))
    grants, at = rows.filter(F.col("subcategory").isin(*GRANTS)), F.col("at")
    created = rows.filter(F.col("subcategory") == "account_created").select(
        F.col("event_id").alias("created_id"), "actor_user", "host_id",
        F.col("timestamp_utc").alias("anchor_ts"), micros(F.col("timestamp_utc")).alias("at"))
    looked = look_along_time(
        created, grants, anchor_id="created_id", keys=["actor_user"],
        instants={"before": at - 1, "end": at + width}, item_time=micros(F.col("timestamp_utc")),
        sums={"n": F.lit(1), **evidence_lanes(F.col("event_id"))}, item=F.struct("event_id", "timestamp_utc", "subcategory"))
    heads = cut_lineage(
        looked.withColumns(sums_between("before", "end", anchor="created_id")).withColumn("grants", F.col("end.n") - F.col("before.n"))
        .withColumn("first_grant", F.col("before.next.item")).withColumn("last_grant", F.col("end.last.item"))
        .filter(F.col("grants") > 0).drop("before", "end"))
    user = F.col("actor_user")
    heads = (heads.withColumn("event_count", F.col("grants") + 1)
             .withColumn("evidence", F.array(keyed("grants_to_account", user, F.col("at"), F.col("at") + width),
                                             keyed(ONE_EVENT, F.col("created_id"))))
             .withColumn("evidence_filter", text(
                 "event_id = '", F.col("created_id"), "' OR (actor_user = ", sql_quote(user),
                 f" AND subcategory IN ({quoted_list(GRANTS)}) AND timestamp_utc >= timestamp_micros(",
                 F.col("at"), ") AND timestamp_utc <= timestamp_micros(", F.col("at") + width, "))")))
    return finish(
        heads, "new_account_privilege_grant", "1.0", "high",
        title=text("Account ", user, " was created and given administrator rights"),
        what=text("Account ", user, " was made at ", minute_text(F.col("anchor_ts")),
                  " and promoted at ", minute_text(F.col("first_grant.timestamp_utc")), "."),
        why="A fresh account with administrator rights keeps a door open after the first one is shut.",
        confidence="High",
        next_step=text("Ask who requested ", user, "; if nobody did, disable it but keep it as evidence."),
        detail=text(f"within {account_grant_window:g} minutes; created by ", F.col("created_id"),
                    ", first grant ", F.col("first_grant.event_id"), " (",
                    F.col("first_grant.subcategory"), ")"),
        host=F.col("host_id"), first=F.col("anchor_ts"), last=F.col("last_grant.timestamp_utc"))


@rule("persistence_after_login", persistence_window=120)
def persistence_after_login(events: DataFrame, persistence_window: float = 120,
                            heavy_failures: int = HEAVY_FAILURE_COUNT, scope: str = "case") -> DataFrame:
    """Something that survives a reboot appears near a login from a guessing address.

    Dated items count in [login, login + window]; undated ones when the first time written in their
    description or notes is within the window on either side.  ``scope='host'`` keeps to one host.
    """
    width = int(persistence_window * MINUTE_MICROS)
    keys = ["host_id"] if scope == "host" else []
    logins = cut_lineage(salted_join(
        events.filter((F.col("subcategory") == "successful_login") & F.col("timestamp_utc").isNotNull()
                      & F.col("source_ip").isNotNull() & not_tool_noise())
        .select(F.col("event_id").alias("login_id"), "source_ip", "host_id",
                F.col("timestamp_utc").alias("anchor_ts"), micros(F.col("timestamp_utc")).alias("at")),
        guessing_addresses(events, heavy_failures), ["source_ip"], "left_semi"))
    items = cut_lineage(events.filter(F.col("subcategory").isin(*PERSISTENCE)).select(
        *keys, "event_id", "event_hash", "subcategory", "timestamp_utc",
        F.when(F.col("timestamp_utc").isNull(), written_instant()).alias("written_ts")))
    at, dated = F.col("at"), F.col("timestamp_utc").isNotNull()
    # A count costs a running total per row, so only what occurs is counted: two rows per kind are collected at most.
    occurring = sorted((row["subcategory"], "dated" if row["dated"] else "undated") for row in items.filter(
        F.coalesce("timestamp_utc", "written_ts").isNotNull()).select("subcategory", dated.alias("dated")).distinct().collect())
    measures = {f"{side}_{k}": ((F.col("subcategory") == k) & (dated if side == "dated" else ~dated)).cast("long")
                for k, side in occurring}
    nothing = F.lit(0).cast("decimal(20,0)")
    measures |= {f"{side}_{lane}": F.when(dated if side == "dated" else ~dated, value).otherwise(nothing)
                 for side in ("dated", "undated") for lane, value in evidence_lanes(F.col("event_id")).items()}
    looked = look_along_time(
        logins, items, anchor_id="login_id", keys=keys,
        instants={"before": at - width - 1, "start": at - 1, "end": at + width},
        item_time=micros(F.coalesce("timestamp_utc", "written_ts")), sums=measures,
        item=F.col("timestamp_utc"))
    n_dated = {k: F.col(f"end.dated_{k}") - F.col(f"start.dated_{k}") for k, side in occurring if side == "dated"}
    n_undated = {k: F.col(f"end.undated_{k}") - F.col(f"before.undated_{k}") for k, side in occurring if side == "undated"}
    none = F.lit(0).cast("long")
    add = lambda counts: reduce(lambda a, b: a + b, counts.values(), none)
    kinds = sorted({*n_dated, *n_undated})
    n_items = F.col("n_dated") + F.col("n_undated")
    heads = cut_lineage(looked.select(
        "login_id", "source_ip", "host_id", "anchor_ts", "at", *[(
            F.col(f"end.dated_{lane}") - F.col(f"start.dated_{lane}") + F.col(f"end.undated_{lane}")
            - F.col(f"before.undated_{lane}") + own).cast("decimal(38,0)").alias(lane)
            for lane, own in evidence_lanes(F.col("login_id")).items()], add(n_dated).alias("n_dated"),
        add(n_undated).alias("n_undated"), F.col("end.last.item").alias("last_dated"),
        F.array_compact(F.array(*[F.when(n_dated.get(k, none) + n_undated.get(k, none) > 0, F.lit(k.replace("_", " ")))
                                  for k in kinds]).cast("array<string>")).alias("kinds"))
        .filter(n_items > 0))
    scope_sql = text("host_id = ", sql_quote(F.col("host_id")), " AND ") if keys else F.lit("")
    owner = F.col("host_id") if keys else F.lit("")
    heads = (heads.withColumn("event_count", n_items + 1)
             .withColumn("evidence", F.array(
                 keyed(f"lasting_changes_{scope}", owner, F.col("at"), F.col("at") + width),
                 keyed(f"undated_changes_{scope}", owner, F.col("at") - width, F.col("at") + width),
                 keyed(ONE_EVENT, F.col("login_id"))))
             .withColumn("evidence_filter", text(
                 "event_id = '", F.col("login_id"), "' OR (", scope_sql,
                 f"subcategory IN ({quoted_list(PERSISTENCE)}) AND (timestamp_utc BETWEEN timestamp_micros(",
                 F.col("at"), ") AND timestamp_micros(", F.col("at") + width,
                 f") OR (timestamp_utc IS NULL AND abs(unix_micros({WRITTEN_TIME_SQL}) - ",
                 F.col("at"), f") <= {width})))")))
    return finish(
        heads, "persistence_after_login", "1.0", "high",
        title=F.lit("A way back in was created shortly after a suspicious login"),
        what=text(n_items, f" lasting change(s) appeared within {persistence_window:g} minutes of the login from ",
                  F.col("source_ip"), " at ", minute_text(F.col("anchor_ts")), ": ",
                  F.array_join("kinds", ", "), "."),
        why="Scheduled jobs and added keys outlive a password change, so the incident may not be over.",
        confidence="Medium",
        next_step="Go through the listed items with the system's owner; record them before removing any.",
        detail=text("login ", F.col("login_id"), " from ", F.col("source_ip"), " at ",
                    iso_text(F.col("anchor_ts")), "; dated items ", F.col("n_dated"), ", undated items ",
                    F.col("n_undated")),
        host=F.col("host_id"), first=F.col("anchor_ts"),
        last=F.when(F.col("n_undated") == 0, F.col("last_dated")))


def admin_activity() -> Column:
    return ((F.col("category") == "privilege_escalation") & (F.col("event_kind") == "event")
            & F.col("timestamp_local").isNotNull() & not_tool_noise())


def account() -> Column:
    return strip_quotes(first_filled(F.col("actor_user"), "unknown"))


# Administrator activity of an account by hour of the day.
EVIDENCE["admin_hours"] = EvidenceKind(admin_activity, account, lambda: F.hour("timestamp_local").cast("long"), 24)


@rule("off_hours_privileged", business_hours=(8, 18))
def off_hours_privileged(events: DataFrame, business_hours: tuple[int, int] = (8, 18)) -> DataFrame:
    """Administrator activity outside working hours, one finding per account."""
    start, end = business_hours
    user_sql = "btrim(coalesce(nullif(actor_user, ''), 'unknown'), '\\'\"')"
    hits = events.filter(admin_activity() & outside_hours(F.col("timestamp_local"), start, end)).withColumn("user", account())
    order = F.struct("timestamp_utc", "event_hash")
    row = F.struct("timestamp_utc", "timestamp_local", "host_id", "subcategory")
    heads = hits.groupBy("user").agg(
        *counted(), F.min_by(row, order).alias("first"),
        F.max_by(row, order).alias("last"))
    user, n = F.col("user"), F.col("event_count")
    heads = heads.withColumn("evidence_filter", text(
        "category = 'privilege_escalation' AND event_kind = 'event' AND timestamp_local IS NOT NULL AND "
        f"{NOT_NOISE_SQL} AND (hour(timestamp_local) < {start} OR hour(timestamp_local) >= {end}) AND "
        f"{user_sql} = ", sql_quote(user)))
    spans = [(a, b) for a, b in ((0, start - 1), (end, 23)) if a <= b]
    heads = heads.withColumn("evidence", F.array(*[keyed("admin_hours", user, F.lit(a), F.lit(b)) for a, b in spans]))
    return finish(
        heads, "off_hours_privileged", "1.0", F.when(n > 1, "medium").otherwise("low"),
        title=text("Administrator activity outside working hours by ", user),
        what=text(user, " acted as administrator ", n, f" time(s) before {start:02d}:00 or after {end:02d}:00 "
                  "local time, from ", minute_text(F.col("first.timestamp_local")), " to ",
                  minute_text(F.col("last.timestamp_local")), "."),
        why="Night work by an administrator is often on-call duty, but it shows where to look first.",
        confidence="Medium",
        next_step=text("Compare the times with the on-call plan and ask ", user, "."),
        detail=text(f"working hours {start:02d}:00-{end:02d}:00; events outside ", n, "; first is ",
                    F.col("first.subcategory")),
        host=F.col("first.host_id"), first=F.col("first.timestamp_utc"), last=F.col("last.timestamp_utc"))
