"""Rules about risky configuration found on a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import first_filled, privileged_group, sorted_text, sql_quote, strip_quotes
from fleetlens.operators.search import ascii_ilike
from fleetlens.rules.base import EVIDENCE, EvidenceKind, counted, finish, keyed, per_event, row_order, rule, text

USER_SQL = "btrim(coalesce(nullif(actor_user, ''), 'unknown'), '\\'\"')"


# Which rows speak about an account.
ABOUT = {
    "uid0_account": "subcategory = 'uid0_account' OR (actor_uid = 0 AND actor_user IS NOT NULL AND actor_user != 'root')",
    "passwordless_account": "subcategory = 'passwordless_account'",
    "privileged_group_member": "subcategory = 'privileged_group_member'",
}


def account() -> Column:
    return strip_quotes(first_filled(F.col("actor_user"), "unknown"))


def _about(kind: str):
    return lambda: F.expr(ABOUT[kind])


EVIDENCE.update({kind: EvidenceKind(_about(kind), account) for kind in ABOUT})


def _by_user(events: DataFrame, kind: str, *extra: Column) -> DataFrame:
    """One head per account over the rows of a kind."""
    heads = events.filter(F.expr(ABOUT[kind])).withColumn("user", account()).groupBy("user").agg(
        *counted(),
        F.min_by(F.struct("host_id", first_filled(F.col("description"), F.col("raw_line")).alias("shown")),
                 row_order()).alias("row"), *extra)
    return heads.withColumn("evidence_filter", text(
        f"({ABOUT[kind]}) AND {USER_SQL} = ", sql_quote(F.col("user")))).withColumn(
        "evidence", F.array(keyed(kind, F.col("user"))))


@rule("uid0_account")
def uid0_account(events: DataFrame) -> DataFrame:
    """Accounts other than root that have user id 0."""
    heads = _by_user(events, "uid0_account")
    user = F.col("user")
    return finish(
        heads, "uid0_account", "1.0", "high",
        title=text("Non-root account with root privileges: ", user),
        what=text("Account '", user, "' has user id 0, which makes it root under another name."),
        why="A second root account is a lasting back door that password changes for root do not close.",
        confidence="High",
        next_step="Find out when the account was added and remove it if nobody can explain it.",
        detail=text(F.col("event_count"), " record(s) of '", user, "', first: ", F.col("row.shown")),
        host=F.col("row.host_id"))


@rule("passwordless_account")
def passwordless_account(events: DataFrame) -> DataFrame:
    heads = _by_user(events, "passwordless_account")
    user = F.col("user")
    return finish(
        heads, "passwordless_account", "1.0", "high",
        title=text("Passwordless user account: ", user),
        what=text("Account '", user, "' has an empty password field."),
        why="Anyone can become this user without knowing a secret.",
        confidence="High",
        next_step="Check the account's logins, then lock it or give it a password.",
        detail=text(F.col("event_count"), " record(s) of '", user, "', first: ", F.col("row.shown")),
        host=F.col("row.host_id"))


@rule("privileged_group_member")
def privileged_group_member(events: DataFrame) -> DataFrame:
    """Members of administrative groups, one finding per account naming all its groups."""
    # The groups are those of a short fixed list, so the set per account stays small.
    heads = _by_user(events, "privileged_group_member",
                     F.collect_set(privileged_group(F.col("description"))).alias("groups"))
    user = F.col("user")
    groups = first_filled(sorted_text(F.col("groups")), "a privileged group")
    return finish(
        heads, "privileged_group_member", "1.0", "medium",
        title=text("User ", user, " in privileged administrative group"),
        what=text("User '", user, "' is in: ", groups, "."),
        why="These groups give full or nearly full control of the host.",
        confidence="High",
        next_step="Confirm that this account needs the membership.",
        detail=text("groups ", groups, "; ", F.col("event_count"), " record(s)"),
        host=F.col("row.host_id"))


@rule("sshd_config_risk")
def sshd_config_risk(events: DataFrame) -> DataFrame:
    """Unsafe settings of the SSH server, one finding per setting."""
    rows = events.filter(
        (F.col("subcategory") == "sshd_setting")
        | (ascii_ilike(F.col("source_artifact_path"), "sshd_config")
           & ascii_ilike(F.col("description"), "PermitRootLogin")))
    shown = first_filled(F.col("description"), F.col("raw_line"))
    return finish(
        per_event(rows), "sshd_config_risk", "1.0", "high",
        title=text("Insecure SSH configuration: ", first_filled(F.trim("raw_line"), shown)),
        what=text(shown),
        why="A loose SSH server can be attacked over the network, often without naming a user.",
        confidence="High",
        next_step="Forbid root and empty-password logins, prefer keys, and restart the server.",
        detail=text("setting: ", shown), host=F.col("host_id"))


@rule("ld_preload_rootkit")
def ld_preload_rootkit(events: DataFrame) -> DataFrame:
    rows = events.filter((F.col("subcategory") == "ld_preload_set")
                         | ascii_ilike(F.col("source_artifact_path"), "ld.so.preload"))
    return finish(
        per_event(rows), "ld_preload_rootkit", "1.0", "high",
        title=F.lit("Suspicious dynamic linker preload library configured"),
        what=F.lit("The linker is told to load an extra library into every program."),
        why="Rootkits use this to hook system calls and hide files, processes and connections.",
        confidence="High",
        next_step="Inspect the library and verify the core system binaries.",
        detail=text("preload: ", first_filled(F.col("description"), F.col("raw_line"))),
        host=F.col("host_id"))
