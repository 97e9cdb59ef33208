"""Report tables over the event views, and the same tables in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.plans.registry import query
from fleetlens.plans.rule_queries import ALL_FINDINGS_SQL, NOISE, all_findings
from fleetlens.plans.views import AUDIT_SQL, MIXED_SQL, audit_events, mixed_events, read_table
from fleetlens.reports import summary, tables
from fleetlens.operators.windows import numbered
from fleetlens.rules import REGISTRY, ranked
from fleetlens.rules.base import FAILURES, quoted_list, rank_order
from fleetlens.rules.integrity import rotation_members

NEWEST = "ORDER BY timestamp_utc DESC NULLS LAST, event_hash LIMIT 500"
FAIL_LIST = quoted_list(FAILURES)
USER_ACTIVITY = "category = 'user_activity'"


def _table(number: int, name: str, select: str):
    """Register one function of ``tables`` over the mixed events."""
    fn = tables.EVENT_TABLES[name]
    query(f"rpt_{number}_{name}", f"WITH {MIXED_SQL}\n{select}")(
        lambda spark, sf_dir: fn(mixed_events(spark, sf_dir)))


_BY_SEVERITY = ", ".join(f"count(*) FILTER (severity = '{x}') AS {x}_findings" for x in ("high", "medium", "low", "info"))


@query("rpt_1_case_summary", f"""WITH {ALL_FINDINGS_SQL},
f AS (SELECT count(*) AS finding_count, {_BY_SEVERITY} FROM findings),
e AS (SELECT count(*) AS event_count, min(timestamp_utc) AS first_event_utc, max(timestamp_utc) AS last_event_utc FROM mixed)
SELECT * FROM e, f""")
def _case_summary(spark, sf_dir):
    events, findings = all_findings(spark, sf_dir)
    return summary.case_summary(events, findings)


_table(2, "users", """SELECT actor_user, arg_min(description, (timestamp_utc IS NULL,
    coalesce(timestamp_utc, TIMESTAMP '1970-01-01'), event_hash)) AS description, min(timestamp_utc) AS first_seen
FROM mixed WHERE category = 'user_accounts' AND subcategory IN ('account', 'uid0_account') GROUP BY 1""")
_table(3, "user_diffs", """SELECT subcategory, actor_user, description, timestamp_utc, severity FROM mixed
WHERE category = 'user_accounts' AND subcategory NOT IN ('account', 'uid0_account')
   OR (category = 'privilege_escalation' AND subcategory = 'group_membership_added')""")

# First come first served with a reflected balance: a logout that would take the number of open sessions
# below zero ends nothing.
SESSIONS_SQL = f"""WITH {AUDIT_SQL},
r AS (SELECT *, subcategory IN ('successful_login', 'session_opened', 'login') AS opens FROM audit
    WHERE category = 'login_activity' AND subcategory IN ('successful_login', 'session_opened', 'login', 'logout',
      'session_closed', 'disconnect')),
b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER w AS bal, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS n_open,
    sum(CASE WHEN opens THEN 0 ELSE 1 END) OVER w AS n_close FROM r
    WINDOW w AS (PARTITION BY host_id, actor_user ORDER BY timestamp_utc, opens DESC, event_hash)),
c AS (SELECT *, least(0, min(bal) OVER w) AS low, coalesce(least(0, min(bal) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS before
    FROM b WINDOW w AS (PARTITION BY host_id, actor_user ORDER BY timestamp_utc, opens DESC, event_hash)),
i AS (SELECT *, n_open AS k FROM c WHERE opens), o AS (SELECT *, n_close + low AS k FROM c WHERE NOT opens AND low = before),
s AS (SELECT i.host_id, i.actor_user, i.source_ip, i.raw_line, i.timestamp_utc AS login_time, o.timestamp_utc AS logout_time,
    CAST(floor((epoch_us(o.timestamp_utc) - epoch_us(i.timestamp_utc)) / 1000000) AS BIGINT) AS d
    FROM i LEFT JOIN o ON o.host_id = i.host_id AND o.actor_user = i.actor_user AND o.k = i.k)
SELECT host_id, actor_user, source_ip, 'unknown' AS terminal, login_time, logout_time,
    CASE WHEN d IS NULL THEN 'Active / Session Open' ELSE
      CASE WHEN d >= 86400 THEN CAST(d // 86400 AS VARCHAR) || 'd ' ELSE '' END ||
      CASE WHEN d >= 3600 THEN CAST(d // 3600 % 24 AS VARCHAR) || 'h ' ELSE '' END ||
      CASE WHEN d >= 60 THEN CAST(d // 60 % 60 AS VARCHAR) || 'm ' ELSE '' END ||
      CAST(d % 60 AS VARCHAR) || 's' END AS duration,
    CASE WHEN d IS NULL THEN 'Active / Unclosed' ELSE 'Closed' END AS status FROM s"""


@query("rpt_4_sessions", SESSIONS_SQL)
def _sessions(spark, sf_dir):
    return tables.sessions(audit_events(spark, sf_dir))


@query("rpt_4_sessions_by_terminal", SESSIONS_SQL)
def _sessions_by_terminal(spark, sf_dir):
    # No terminals in this view, so both pairings agree; terminals are tested on a fixture.
    return tables.sessions_by_terminal(audit_events(spark, sf_dir))


@query("joi_8_first_match", SESSIONS_SQL.replace("'unknown' AS terminal", "'pts/' || substr(actor_user, 2) AS terminal"))
def _first_match(spark, sf_dir):
    """Every account has a terminal of its own, so that its logouts fit by either key."""
    events = audit_events(spark, sf_dir).withColumn(
        "raw_line", F.concat(F.lit("line=pts/"), F.substring("actor_user", 2, 20), F.lit(" "), "raw_line"))
    return tables.sessions_by_terminal(events)


_table(5, "logins", """SELECT actor_user, source_ip, subcategory, count(*) AS attempt_count,
    min(timestamp_utc) AS first_attempt, max(timestamp_utc) AS last_attempt
FROM mixed WHERE category = 'login_activity' GROUP BY 1, 2, 3""")
_table(6, "failed_logins", f"""SELECT actor_user, source_ip, count(*) AS attempt_count,
    min(timestamp_utc) AS first_attempt, max(timestamp_utc) AS last_attempt
FROM mixed WHERE category = 'login_activity' AND subcategory IN ({FAIL_LIST}) GROUP BY 1, 2""")
_table(7, "usb", """SELECT timestamp_utc, subcategory, description, notes, raw_line FROM mixed
WHERE category = 'hardware_usb'""")
_table(8, "storage", """SELECT subcategory, description, notes, raw_line FROM mixed
WHERE category = 'environment' AND subcategory IN ('storage_device', 'filesystem_mount')""")
_table(9, "network_interfaces", """SELECT subcategory, source_ip, description, notes, raw_line FROM mixed
WHERE category = 'network_config' AND subcategory = 'network_interface'""")
_table(10, "firewall_network", """SELECT subcategory, timestamp_utc, source_ip, description FROM mixed
WHERE category = 'network_config' AND subcategory IN ('firewall_block', 'known_host')""")
_table(11, "remote_ips", """SELECT source_ip, count(*) AS connection_count,
    string_agg(DISTINCT actor_user, ',' ORDER BY actor_user) AS users, count(DISTINCT actor_user) AS n_users,
    string_agg(DISTINCT subcategory, ',' ORDER BY subcategory) AS services,
    min(timestamp_utc) AS first_seen, max(timestamp_utc) AS last_seen
FROM mixed WHERE source_ip IS NOT NULL AND source_ip NOT LIKE ':%'
    AND source_ip NOT IN ('127.0.0.1', '::1', 'localhost', 'local', '', ':0.0', ':0') GROUP BY 1""")
_table(12, "ssh_connections", f"""SELECT timestamp_utc, CASE WHEN subcategory = 'known_host' THEN 'Outbound'
    ELSE 'Inbound' END AS direction, actor_user, source_ip, subcategory, description, raw_line FROM mixed
WHERE subcategory = 'known_host' OR actor_process = 'sshd' OR raw_line ILIKE '%sshd%' {NEWEST}""")
_table(13, "dns_activity", """SELECT subcategory, source_ip, source_host, description, notes, raw_line FROM mixed
WHERE subcategory IN ('dns_nameserver', 'dns_search', 'dns_mapping', 'dns_query')
   OR notes IN ('resolv.conf', 'etc/hosts')""")
_CLIENT = "timestamp_utc, source_ip AS client_ip, actor_user, description, notes, severity"
_table(14, "http_logs", f"SELECT {_CLIENT} FROM mixed WHERE subcategory = 'http_request' {NEWEST}")
_table(15, "ftp_connections", f"""SELECT {_CLIENT} FROM mixed WHERE subcategory = 'ftp_transfer'
   OR ({USER_ACTIVITY} AND (description ILIKE '%FTP%' OR raw_line ILIKE '%vsftpd%')) {NEWEST}""")
_table(16, "browser_and_downloads", f"""SELECT timestamp_utc, subcategory, actor_user, description, notes FROM mixed
WHERE subcategory IN ('browser_history', 'browser_download') OR ({USER_ACTIVITY} AND (description ILIKE '%wget %'
   OR description ILIKE '%curl %' OR description ILIKE '%download%')) {NEWEST}""")
_table(17, "internet_services", f"""SELECT subcategory, timestamp_utc, actor_user, source_ip, description, notes
FROM mixed WHERE {USER_ACTIVITY} AND subcategory IN ('http_request', 'ftp_transfer', 'browser_history',
   'browser_download') {NEWEST}""")
_table(18, "system", """SELECT subcategory, description, raw_line, timestamp_utc FROM mixed
WHERE category = 'environment' AND subcategory NOT IN ('journal_message', 'storage_device', 'filesystem_mount')""")
_table(19, "system_additional", f"""SELECT category, subcategory, actor_user, timestamp_utc, description, severity
FROM mixed WHERE subcategory IN ('suspicious_command', 'sudo_command', 'sudo_failure', 'sudo_denied', 'cron_command',
   'crontab_modified', 'systemd_service', 'package_install', 'package_remove') {NEWEST}""")
_table(20, "shell_history", """SELECT actor_user, timestamp_utc, description, notes, severity FROM mixed
WHERE subcategory = 'shell_command' ORDER BY timestamp_utc NULLS FIRST, event_hash LIMIT 1500""")
_table(21, "volatile_sockets", """SELECT subcategory, source_ip, actor_process, description, notes, severity FROM mixed
WHERE category = 'network_config' AND subcategory IN ('established', 'listen', 'unconn', 'time_wait', 'close_wait')
ORDER BY subcategory, description, event_hash LIMIT 1000""")
_table(22, "network_persistence", f"""SELECT category, subcategory, timestamp_utc, description FROM mixed
WHERE category IN ('network_config', 'persistence', 'software_changes') {NEWEST}""")


@query("rpt_23_findings_list", f"WITH {ALL_FINDINGS_SQL} SELECT title, severity, first_ts_utc FROM findings")
def _findings_list(spark, sf_dir):
    _, findings = all_findings(spark, sf_dir)
    return ranked(findings).select("title", "severity", "first_ts_utc")


@query("lim_5_severity_ranked", f"""WITH {ALL_FINDINGS_SQL}
SELECT finding_id, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
    first_ts_utc NULLS LAST, finding_id) AS place FROM findings""")
def _ranked_places(spark, sf_dir):
    _, findings = all_findings(spark, sf_dir)
    return numbered(findings.select("finding_id", "severity", "first_ts_utc"), rank_order(), "place").select("finding_id", "place")


@query("rpt_23_event_sample", f"""WITH {MIXED_SQL}
SELECT event_id, event_kind, category, subcategory, severity, timestamp_utc, actor_user, source_ip, description,
    raw_line, source_artifact_path FROM mixed ORDER BY timestamp_utc NULLS LAST, event_id LIMIT 1000""")
def _event_sample(spark, sf_dir):
    return summary.event_sample(mixed_events(spark, sf_dir))


@query("rpt_24_events_per_day", f"""WITH {AUDIT_SQL}
SELECT strftime(timestamp_utc, '%Y-%m-%d') AS day, count(*) AS n FROM audit
WHERE timestamp_utc IS NOT NULL GROUP BY 1""")
def _per_day(spark, sf_dir):
    return summary.events_per_day(audit_events(spark, sf_dir))


@query("rpt_24_failures_per_hour", f"""WITH {AUDIT_SQL}
SELECT strftime(timestamp_utc, '%Y-%m-%dT%H') AS hour, count(*) AS n FROM audit
WHERE timestamp_utc IS NOT NULL AND subcategory IN ({FAIL_LIST}) GROUP BY 1""")
def _per_hour(spark, sf_dir):
    return summary.failures_per_hour(audit_events(spark, sf_dir))


@query("rpt_24_busiest_users", f"""WITH {AUDIT_SQL}
SELECT actor_user, count(*) AS n FROM audit WHERE actor_user <> '' GROUP BY 1 ORDER BY n DESC, actor_user LIMIT 10""")
def _busiest(spark, sf_dir):
    return summary.busiest_users(audit_events(spark, sf_dir))


@query("rpt_24_findings_per_severity", f"""WITH {ALL_FINDINGS_SQL}
SELECT s.severity, count(f.finding_id) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('info')) s(severity)
LEFT JOIN findings f ON f.severity = s.severity GROUP BY 1""")
def _per_severity(spark, sf_dir):
    _, findings = all_findings(spark, sf_dir)
    return summary.findings_per_severity(findings)


@query("rpt_25_recommended_actions", f"""WITH {AUDIT_SQL}, f AS (SELECT actor_user, count(*) AS n,
    min(timestamp_utc) AS t FROM audit WHERE category = 'privilege_escalation' AND {NOISE}
    AND (hour(timestamp_local) < 8 OR hour(timestamp_local) >= 18) GROUP BY 1 HAVING count(*) > 1)
SELECT 'Compare the times with the on-call plan and ask ' || actor_user || '.' AS step FROM f ORDER BY t LIMIT 5""")
def _actions(spark, sf_dir):
    return summary.recommended_actions(REGISTRY["off_hours_privileged"].findings(audit_events(spark, sf_dir)))


@query("rpt_25_key_observations", f"""WITH {ALL_FINDINGS_SQL}, graded AS (SELECT * FROM findings WHERE severity IN ('high', 'medium'))
SELECT title, severity FROM graded WHERE severity = (SELECT min(severity) FROM graded)
ORDER BY first_ts_utc NULLS LAST, finding_id LIMIT 5""")
def _observations(spark, sf_dir):
    _, findings = all_findings(spark, sf_dir)
    return summary.key_observations(findings).select("title", "severity")


@query("lim_6_observations_of_an_account", f"""WITH {AUDIT_SQL}, f AS (SELECT actor_user, min(timestamp_utc) AS t FROM audit
    WHERE category = 'privilege_escalation' AND {NOISE}
    AND (hour(timestamp_local) < 8 OR hour(timestamp_local) >= 18) GROUP BY 1 HAVING count(*) > 1)
SELECT 'Administrator activity outside working hours by ' || actor_user AS title, 'medium' AS severity
FROM f ORDER BY t LIMIT 5""")
def _medium_observations(spark, sf_dir):
    return summary.key_observations(
        REGISTRY["off_hours_privileged"].findings(audit_events(spark, sf_dir))).select("title", "severity")


@query("rpt_25_headline", f"""WITH {ALL_FINDINGS_SQL},
f AS (SELECT {_BY_SEVERITY} FROM findings), e AS (SELECT count(*) AS event_count FROM mixed)
SELECT event_count, high_findings, medium_findings,
    'Case C1: ' || CAST(high_findings AS VARCHAR) || ' high-severity finding(s) and ' || CAST(medium_findings AS VARCHAR)
    || ' medium-severity one(s) in ' || format('{{:,}}', event_count) || ' events; review at once.' AS headline FROM e, f""")
def _headline(spark, sf_dir):
    events, findings = all_findings(spark, sf_dir)
    return summary.headline(events, findings, "C1")


def _artifacts(spark, sf_dir):
    """Pages as collected files: the path comes from the URL, the status from its digits."""
    pages = read_table(spark, sf_dir, "pages")
    status = F.when(F.col("page_id") % 5 == 0, "fail").when(F.col("page_id") % 7 == 0, "skip").otherwise("success")
    return pages.select(
        F.concat(F.lit("host-"), (F.col("page_id") % 8).cast("string")).alias("host_id"),
        F.regexp_replace("url", r"^https?://[^/]+", "").alias("original_path"), status.alias("parse_status"))


_ARTIFACTS = """artifacts AS (SELECT 'host-' || CAST(page_id % 8 AS VARCHAR) AS host_id,
    regexp_replace(url, '^https?://[^/]+', '') AS original_path, CASE WHEN page_id % 5 = 0 THEN 'fail'
    WHEN page_id % 7 = 0 THEN 'skip' ELSE 'success' END AS parse_status FROM pages)"""


@query("rpt_23_artifact_list", f"WITH {_ARTIFACTS} SELECT host_id, original_path, parse_status FROM artifacts")
def _artifact_list(spark, sf_dir):
    return summary.artifact_list(_artifacts(spark, sf_dir))


@query("rpt_25_coverage", f"WITH {_ARTIFACTS} SELECT parse_status, count(*) AS artifacts FROM artifacts GROUP BY 1")
def _coverage(spark, sf_dir):
    return summary.coverage(_artifacts(spark, sf_dir))


@query("rpt_25_failed_artifacts",
       f"WITH {_ARTIFACTS} SELECT host_id, original_path FROM artifacts WHERE parse_status = 'fail'")
def _failed(spark, sf_dir):
    return summary.failed_artifacts(_artifacts(spark, sf_dir))


@query("rpt_28_artifact_folders", f"""WITH {_ARTIFACTS}
SELECT CASE WHEN regexp_matches(original_path, '[^/]/+[^/]') THEN '/' || regexp_extract(original_path, '[^/]+')
    ELSE '/root' END AS folder, count(*) AS files FROM artifacts WHERE lower(original_path) LIKE '%html%' GROUP BY 1""")
def _folders(spark, sf_dir):
    return summary.artifact_folders(_artifacts(spark, sf_dir), "HTML")


def _threats(spark, sf_dir):
    """Every region expects a rule: two that fire on the view, one that does not, and none."""
    key = F.col("r_regionkey") % 4
    return read_table(spark, sf_dir, "region").select(
        F.col("r_name").alias("threat_id"),
        F.when(key == 0, "ld_preload_rootkit").when(key == 1, "passwordless_account")
        .when(key == 2, "no_such_rule").alias("expected_rule"))


_SCORES = f"""WITH {ALL_FINDINGS_SQL},
t AS (SELECT r_name AS threat_id, CASE r_regionkey % 4 WHEN 0 THEN 'ld_preload_rootkit'
    WHEN 1 THEN 'passwordless_account' WHEN 2 THEN 'no_such_rule' END AS expected_rule FROM region),
s AS (SELECT threat_id, expected_rule, CASE WHEN expected_rule IS NULL THEN 'EVIDENCE'
    WHEN expected_rule IN (SELECT rule_name FROM findings) THEN 'PASS' ELSE 'MISS' END AS status FROM t)
"""


def _scores(spark, sf_dir):
    _, findings = all_findings(spark, sf_dir)
    return summary.scorecard(_threats(spark, sf_dir), findings)


@query("rpt_26_scorecard", _SCORES + "SELECT * FROM s")
def _scorecard(spark, sf_dir):
    return _scores(spark, sf_dir)


@query("rpt_26_detection_rate", _SCORES + """SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS detected,
    count(*) FILTER (status = 'MISS') AS missed, count(*) FILTER (status = 'EVIDENCE') AS evidence_only,
    round(count(*) FILTER (status = 'PASS') * 100.0 / count(*) FILTER (status <> 'EVIDENCE'), 1) AS rate FROM s""")
def _rate(spark, sf_dir):
    return summary.detection_rate(_scores(spark, sf_dir))


@query("rpt_27_case_rollup", f"""WITH {ALL_FINDINGS_SQL},
e AS (SELECT 'case-' || host_id AS case_id, count(*) AS events_count, count(DISTINCT host_id) AS hosts FROM mixed GROUP BY 1),
f AS (SELECT 'case-' || host_id AS case_id, count(*) AS findings_count, count(*) FILTER (severity = 'high') AS high_findings
    FROM findings GROUP BY 1)
SELECT coalesce(e.case_id, f.case_id) AS case_id, coalesce(events_count, 0) AS events_count, coalesce(hosts, 0) AS hosts,
    coalesce(findings_count, 0) AS findings_count, coalesce(high_findings, 0) AS high_findings
FROM e FULL JOIN f ON f.case_id = e.case_id""")
def _rollup(spark, sf_dir):
    case = F.concat(F.lit("case-"), F.col("host_id"))
    events, findings = all_findings(spark, sf_dir)
    return summary.case_rollup(events.withColumn("case_id", case), findings.withColumn("case_id", case))


@query("win_10_earliest_per_user", f"""WITH {AUDIT_SQL}
SELECT actor_user, event_id, event_hash, timestamp_utc, row_number() OVER (PARTITION BY actor_user
    ORDER BY timestamp_utc, event_hash) AS rank_in_group FROM audit QUALIFY rank_in_group <= 25""")
def _earliest(spark, sf_dir):
    return summary.earliest_per_user(audit_events(spark, sf_dir))


@query("src_10_rotated_families", f"""WITH {MIXED_SQL}
SELECT DISTINCT regexp_extract(source_artifact_path, '^(.+?)\\.([0-9]+)(\\.gz)?$', 1) AS family,
    CAST(regexp_extract(source_artifact_path, '^(.+?)\\.([0-9]+)(\\.gz)?$', 2) AS BIGINT) AS number FROM mixed""")
def _families(spark, sf_dir):
    return rotation_members(mixed_events(spark, sf_dir))
