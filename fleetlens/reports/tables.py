"""Report tables over events: each function gives one table.

The newest-500 style limits belong to the reports; they run as top-k without a full sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import first_filled, terminal
from fleetlens.functions.times import duration_text, micros
from fleetlens.operators.aggregates import counts_and_span, distinct_text
from fleetlens.operators.groups import linked_groups
from fleetlens.operators.search import ascii_ilike, external_address
from fleetlens.operators.windows import fifo_pairs
from fleetlens.rules.base import FAILURES
from fleetlens.session import cut_lineage

NEWEST = 500


def _newest(df: DataFrame, *columns: Column | str, limit: int | None = NEWEST) -> DataFrame:
    """Newest first with undated last; the event hash makes the cut deterministic."""
    ordered = df.orderBy(F.col("timestamp_utc").desc_nulls_last(), "event_hash")
    return (ordered.limit(limit) if limit else ordered).select(*columns)


def _has(column: str, *texts: str) -> Column:
    return reduce(lambda a, b: a | b,
                  [F.coalesce(ascii_ilike(F.col(column), t), F.lit(False)) for t in texts])


def users(events: DataFrame) -> DataFrame:
    """Known accounts with the time and wording of their first record."""
    rows = events.filter((F.col("category") == "user_accounts")
                         & F.col("subcategory").isin("account", "uid0_account"))
    order = F.struct(F.col("timestamp_utc").isNull(), "timestamp_utc", "event_hash")
    return (rows.groupBy("actor_user").agg(
        F.min_by("description", order).alias("description"), F.min("timestamp_utc").alias("first_seen"))
        .orderBy("actor_user"))


def user_diffs(events: DataFrame) -> DataFrame:
    rows = events.filter(
        ((F.col("category") == "user_accounts") & ~F.col("subcategory").isin("account", "uid0_account"))
        | ((F.col("category") == "privilege_escalation")
           & (F.col("subcategory") == "group_membership_added")))
    return _newest(rows, "subcategory", "actor_user", "description", "timestamp_utc", "severity", limit=None)


# What opens and what closes a session.
SESSION_OPENS = ("successful_login", "session_opened", "login")
SESSION_CLOSES = ("logout", "session_closed", "disconnect")


def _session_rows(events: DataFrame) -> DataFrame:
    opens = F.col("subcategory").isin(*SESSION_OPENS)
    user = first_filled(F.col("actor_user"))
    return (events.filter((F.col("category") == "login_activity") & F.col("timestamp_utc").isNotNull()
                          & F.col("subcategory").isin(*SESSION_OPENS, *SESSION_CLOSES))
            .select("host_id", "event_id", "event_hash", "timestamp_utc", opens.alias("opens"),
                    F.when(opens, F.coalesce(user, F.lit("unknown"))).otherwise(user).alias("user"),
                    first_filled(F.col("source_ip"), F.col("source_host"), "local").alias("source_ip"),
                    terminal(F.col("raw_line"), F.col("description")).alias("terminal")))


def _session_table(logins: DataFrame) -> DataFrame:
    seconds = F.floor((micros(F.col("logout_time")) - micros(F.col("login_time"))) / 1_000_000)
    closed = F.col("logout_time").isNotNull()
    return logins.select(
        "host_id", F.col("user").alias("actor_user"), "source_ip", "terminal", "login_time", "logout_time",
        F.when(closed, duration_text(seconds)).otherwise("Active / Session Open").alias("duration"),
        F.when(closed, "Closed").otherwise("Active / Unclosed").alias("status"))


def sessions(events: DataFrame) -> DataFrame:
    """Logins with the logout that ends them: same host and account, first come first served."""
    rows = _session_rows(events).filter(F.col("user").isNotNull())
    paired = fifo_pairs(rows, ["host_id", "user"], micros(F.col("timestamp_utc")), F.col("opens"),
                        ["event_hash"])
    logins = paired.filter("opens").withColumnRenamed("timestamp_utc", "login_time")
    logouts = (paired.filter(~F.col("opens") & F.col("pair_no").isNotNull())
               .select("host_id", "user", "pair_no", F.col("timestamp_utc").alias("logout_time")))
    return _session_table(logins.join(logouts, ["host_id", "user", "pair_no"], "left"))


def sessions_by_terminal(events: DataFrame) -> DataFrame:
    """Like :func:`sessions`, but a logout also ends a login of another account on the same known terminal.

    With either of two keys matching, accounts and terminals that ever met depend on each other, and only those: each such
    group of a host is one chain of decisions, and streamed through in time order in Arrow batches with only the logins still
    open held.  Giving each logout to the earliest waiting login it fits is the same as letting each login take its earliest
    unused logout.  A logout without account and terminal fits none.
    """
    import pandas as pd

    def pair(batches):
        place, waiting = None, []

        def unclosed():
            return [{**w, "logout_time": None} for w in waiting]

        for batch in batches:
            done = []
            for row in batch.to_dict("records"):
                if (row["host_id"], row["group"]) != place:
                    done += unclosed()
                    place, waiting = (row["host_id"], row["group"]), []
                if row["opens"]:
                    waiting.append({k: row[k] for k in ("host_id", "user", "source_ip", "terminal")}
                                   | {"login_time": row["timestamp_utc"]})
                    continue
                for i, login in enumerate(waiting):
                    same_user = row["user"] is not None and row["user"] == login["user"]
                    same_terminal = login["terminal"] != "unknown" and row["terminal"] == login["terminal"]
                    if same_user or same_terminal:
                        done.append({**waiting.pop(i), "logout_time": row["timestamp_utc"]})
                        break
            if done:
                yield pd.DataFrame(done, columns=names)
        if waiting:
            yield pd.DataFrame(unclosed(), columns=names)

    names = ["host_id", "user", "source_ip", "terminal", "login_time", "logout_time"]
    known = F.when(F.col("terminal") != "unknown", F.col("terminal"))
    rows = cut_lineage(_session_rows(events).withColumn("known", known).filter("user is not null or known is not null"))
    by_user, by_terminal = linked_groups(rows, ["host_id"], "user", "known")
    grouped = (rows.join(by_user.withColumnRenamed("group", "by_user"), ["host_id", "user"], "left")
               .join(by_terminal.withColumnRenamed("group", "by_terminal"), ["host_id", "known"], "left"))
    rows = (grouped.withColumn("group", F.coalesce(
                F.concat(F.lit("g:"), F.coalesce("by_user", "by_terminal")), F.concat(F.lit("u:"), "user"), F.concat(F.lit("t:"), "known")))
            .repartition("host_id", "group")
            .sortWithinPartitions("host_id", "group", "timestamp_utc", F.col("opens").desc(), "event_hash")
            .select("host_id", "group", "user", "source_ip", "terminal", "timestamp_utc", "opens"))
    paired = rows.mapInPandas(pair, "host_id string, user string, source_ip string, terminal string, "
                                    "login_time timestamp, logout_time timestamp")
    return _session_table(paired)


def logins(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("category") == "login_activity")
    return (counts_and_span(rows, ["actor_user", "source_ip", "subcategory"])
            .orderBy(F.col("attempt_count").desc(), "actor_user", "source_ip", "subcategory"))


def failed_logins(events: DataFrame) -> DataFrame:
    rows = events.filter((F.col("category") == "login_activity") & F.col("subcategory").isin(*FAILURES))
    return (counts_and_span(rows, ["actor_user", "source_ip"])
            .orderBy(F.col("attempt_count").desc(), "actor_user", "source_ip"))


def usb(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("category") == "hardware_usb")
            .orderBy(F.col("timestamp_utc").asc_nulls_first(), "event_hash")
            .select("timestamp_utc", "subcategory", "description", "notes", "raw_line"))


def storage(events: DataFrame) -> DataFrame:
    return (events.filter((F.col("category") == "environment")
                          & F.col("subcategory").isin("storage_device", "filesystem_mount"))
            .orderBy("subcategory", "event_hash").select("subcategory", "description", "notes", "raw_line"))


def network_interfaces(events: DataFrame) -> DataFrame:
    return (events.filter((F.col("category") == "network_config")
                          & (F.col("subcategory") == "network_interface"))
            .orderBy(F.col("source_ip").asc_nulls_first(), "event_hash")
            .select("subcategory", "source_ip", "description", "notes", "raw_line"))


def firewall_network(events: DataFrame) -> DataFrame:
    rows = events.filter((F.col("category") == "network_config")
                         & F.col("subcategory").isin("firewall_block", "known_host"))
    return _newest(rows, "subcategory", "timestamp_utc", "source_ip", "description", limit=None)


def remote_ips(events: DataFrame) -> DataFrame:
    """Per external address: events, accounts, kinds of event, first and last time."""
    rows = events.filter(external_address())
    spans = rows.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("connection_count"),
        # Subcategories are a closed vocabulary: the set per address stays small.
        F.array_join(F.array_sort(F.collect_set("subcategory")), ",").alias("services"),
        F.min("timestamp_utc").alias("first_seen"), F.max("timestamp_utc").alias("last_seen"))
    return (spans.join(distinct_text(rows, ["source_ip"], "actor_user", "users"), "source_ip", "left")
            .select("source_ip", "connection_count", "users", "n_users", "services", "first_seen", "last_seen")
            .orderBy(F.col("connection_count").desc(), "source_ip"))


def direction() -> Column:
    return F.when(F.col("subcategory") == "known_host", "Outbound").otherwise("Inbound")


def ssh_connections(events: DataFrame) -> DataFrame:
    rows = events.filter((F.col("subcategory") == "known_host") | (F.col("actor_process") == "sshd")
                         | _has("raw_line", "sshd"))
    return _newest(rows, "timestamp_utc", direction().alias("direction"), "actor_user", "source_ip",
                   "subcategory", "description", "raw_line")


def dns_activity(events: DataFrame) -> DataFrame:
    rows = events.filter(
        F.col("subcategory").isin("dns_nameserver", "dns_search", "dns_mapping", "dns_query")
        | F.col("notes").isin("resolv.conf", "etc/hosts"))
    return (rows.orderBy("subcategory", F.col("source_ip").asc_nulls_first(), "event_hash")
            .select("subcategory", "source_ip", "source_host", "description", "notes", "raw_line"))


_CLIENT_COLUMNS = ("timestamp_utc", "client_ip", "actor_user", "description", "notes", "severity")


def http_logs(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("subcategory") == "http_request").withColumn("client_ip", F.col("source_ip"))
    return _newest(rows, *_CLIENT_COLUMNS)


def ftp_connections(events: DataFrame) -> DataFrame:
    rows = events.filter(
        (F.col("subcategory") == "ftp_transfer")
        | ((F.col("category") == "user_activity") & (_has("description", "FTP") | _has("raw_line", "vsftpd"))))
    return _newest(rows.withColumn("client_ip", F.col("source_ip")), *_CLIENT_COLUMNS)


def browser_and_downloads(events: DataFrame) -> DataFrame:
    rows = events.filter(
        F.col("subcategory").isin("browser_history", "browser_download")
        | ((F.col("category") == "user_activity") & _has("description", "wget ", "curl ", "download")))
    return _newest(rows, "timestamp_utc", "subcategory", "actor_user", "description", "notes")


def internet_services(events: DataFrame) -> DataFrame:
    rows = events.filter((F.col("category") == "user_activity") & F.col("subcategory").isin(
        "http_request", "ftp_transfer", "browser_history", "browser_download"))
    return _newest(rows, "subcategory", "timestamp_utc", "actor_user", "source_ip", "description", "notes")


def system(events: DataFrame) -> DataFrame:
    rows = events.filter((F.col("category") == "environment") & ~F.col("subcategory").isin(
        "journal_message", "storage_device", "filesystem_mount"))
    return (rows.orderBy("subcategory", F.col("timestamp_utc").asc_nulls_first(), "event_hash")
            .select("subcategory", "description", "raw_line", "timestamp_utc"))


def system_additional(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("subcategory").isin(
        "suspicious_command", "sudo_command", "sudo_failure", "sudo_denied", "cron_command",
        "crontab_modified", "systemd_service", "package_install", "package_remove"))
    return _newest(rows, "category", "subcategory", "actor_user", "timestamp_utc", "description", "severity")


def shell_history(events: DataFrame, limit: int = 1500) -> DataFrame:
    return (events.filter(F.col("subcategory") == "shell_command")
            .orderBy(F.col("timestamp_utc").asc_nulls_first(), "event_hash").limit(limit)
            .select("actor_user", "timestamp_utc", "description", "notes", "severity"))


def volatile_sockets(events: DataFrame, limit: int = 1000) -> DataFrame:
    rows = events.filter((F.col("category") == "network_config") & F.col("subcategory").isin(
        "established", "listen", "unconn", "time_wait", "close_wait"))
    return (rows.orderBy("subcategory", "description", "event_hash").limit(limit)
            .select("subcategory", "source_ip", "actor_process", "description", "notes", "severity"))


def network_persistence(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("category").isin("network_config", "persistence", "software_changes"))
    return _newest(rows, "category", "subcategory", "timestamp_utc", "description")


EVENT_TABLES = {
    "users": users, "user_diffs": user_diffs, "sessions": sessions, "logins": logins,
    "failed_logins": failed_logins, "usb": usb, "storage": storage,
    "network_interfaces": network_interfaces, "firewall_network": firewall_network,
    "remote_ips": remote_ips, "ssh_connections": ssh_connections, "dns_activity": dns_activity,
    "http_logs": http_logs, "ftp_connections": ftp_connections,
    "browser_and_downloads": browser_and_downloads, "internet_services": internet_services,
    "system": system, "system_additional": system_additional, "shell_history": shell_history,
    "volatile_sockets": volatile_sockets, "network_persistence": network_persistence,
}
