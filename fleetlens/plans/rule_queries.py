"""Detection rules over the event views, and the same findings in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.patterns import MALICIOUS_COMMAND
from fleetlens.functions.text import COMMAND_PREFIX, COMMAND_SUFFIX
from fleetlens.plans.registry import ORACLES, query
from fleetlens.plans.views import AUDIT_SQL, MIXED_SQL, audit_events, mixed_events
from fleetlens.rules import REGISTRY, pivot_to_events, run_rules
from fleetlens.rules.auth import GRANTS, PERSISTENCE
from fleetlens.rules.base import FAILURES, PASSWORD_FAILURES, RunReport, quoted_list
from fleetlens.rules.execution import SOURCE_KIND
from fleetlens.rules.integrity import SERVICE_ACCOUNTS
from fleetlens.session import cut_lineage

SHOWN = ("finding_id", "rule_name", "severity", "title", "host_id", "confidence", "first_ts_utc",
         "last_ts_utc", "event_count")
NOISE = "NOT coalesce(tool_generated_flag, false)"
ORDER = "(timestamp_utc IS NULL, coalesce(timestamp_utc, TIMESTAMP '1970-01-01'), event_hash)"


def shown(findings: DataFrame) -> DataFrame:
    return findings.select(*SHOWN)


def finding_sql(name: str, severity: str, title: str, source: str, *, host: str = "host_id",
                confidence: str = "'High'", first: str = "NULL", last: str = "NULL", ids: str = "ids",
                version: str = "1.0") -> str:
    """SELECT of finding rows from ``source``, which has the list ``ids``; their order does not matter to the id."""
    lane = lambda k: (f"CAST(coalesce(list_sum(list_transform(ids, lambda i: CAST(CAST('0x' || substr(sha256(i), {1 + 15 * k}, 15) AS BIGINT)"  # noqa: E731
                      f" AS HUGEINT))), 0) AS VARCHAR)")
    return f"""SELECT substr(sha256(concat_ws(chr(31), '{name}', '{version}', title, coalesce(host_id, ''),
        CAST(len(ids) AS VARCHAR), {lane(0)}, {lane(1)})), 1, 32) AS finding_id, '{name}' AS rule_name, severity,
        title, host_id, confidence, first_ts_utc, last_ts_utc, CAST(len(ids) AS BIGINT) AS event_count
    FROM (SELECT {severity} AS severity, {title} AS title, CAST({host} AS VARCHAR) AS host_id,
        {confidence} AS confidence, CAST({first} AS TIMESTAMP) AS first_ts_utc,
        CAST({last} AS TIMESTAMP) AS last_ts_utc, {ids} AS ids FROM {source})"""


FAILED = f"""failed AS (SELECT * FROM audit WHERE subcategory IN ({quoted_list(FAILURES)})
    AND source_ip IS NOT NULL AND timestamp_utc IS NOT NULL AND {NOISE})"""

BRUTE_FORCE_SQL = f"""WITH {AUDIT_SQL}, {FAILED},
peaks AS (SELECT source_ip FROM (SELECT a.source_ip, a.event_id, count(*) AS n FROM failed a JOIN failed b
    ON a.source_ip = b.source_ip AND b.timestamp_utc BETWEEN a.timestamp_utc - INTERVAL 24 HOUR
    AND a.timestamp_utc GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 3),
g AS (SELECT source_ip, min(timestamp_utc) AS f, max(timestamp_utc) AS l, list(event_id) AS ids,
    arg_min(host_id, {ORDER}) AS host FROM failed WHERE source_ip IN (SELECT source_ip FROM peaks) GROUP BY 1)
""" + finding_sql("brute_force", "'medium'", "'Repeated failed logins from ' || source_ip", "g",
                  host="host", first="f", last="l")


@query("rul_1_brute_force", BRUTE_FORCE_SQL)
def _brute_force(spark, sf_dir):
    return shown(REGISTRY["brute_force"].findings(
        audit_events(spark, sf_dir), brute_force_min=3, brute_force_window=24 * 60))


@query("rul_2_brute_force_success", f"""WITH {AUDIT_SQL}, {FAILED},
g AS (SELECT s.event_id, s.source_ip, s.host_id, s.timestamp_utc AS l, min(p.timestamp_utc) AS f,
    list_append(list(p.event_id), s.event_id) AS ids
    FROM audit s JOIN failed p ON p.source_ip = s.source_ip AND p.timestamp_utc < s.timestamp_utc
    AND p.timestamp_utc >= s.timestamp_utc - INTERVAL 24 HOUR
    WHERE s.subcategory = 'successful_login' AND NOT coalesce(s.tool_generated_flag, false)
    GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
""" + finding_sql(
    "brute_force_success", "'high'",
    "'Successful login from ' || source_ip || ' immediately after repeated failures'", "g", first="f", last="l"))
def _brute_force_success(spark, sf_dir):
    from fleetlens.rules.auth import brute_force_success
    return shown(brute_force_success(audit_events(spark, sf_dir), 5, 24 * 60))


@query("rul_3_new_account_privilege_grant", f"""WITH {AUDIT_SQL},
g AS (SELECT c.event_id, c.actor_user, c.host_id, c.timestamp_utc AS f, max(p.timestamp_utc) AS l,
    list_append(list(p.event_id), c.event_id) AS ids
    FROM audit c JOIN audit p ON p.actor_user = c.actor_user AND p.subcategory IN ({quoted_list(GRANTS)})
    AND p.timestamp_utc BETWEEN c.timestamp_utc AND c.timestamp_utc + INTERVAL 60 MINUTE
    WHERE c.subcategory = 'account_created' AND NOT coalesce(c.tool_generated_flag, false)
    GROUP BY 1, 2, 3, 4)
""" + finding_sql(
    "new_account_privilege_grant", "'high'",
    "'Account ' || actor_user || ' was created and given administrator rights'", "g", first="f", last="l"))
def _new_account(spark, sf_dir):
    return shown(REGISTRY["new_account_privilege_grant"].findings(audit_events(spark, sf_dir)))


GUESSING = f"""guessing AS (SELECT source_ip FROM mixed WHERE subcategory IN ({quoted_list(PASSWORD_FAILURES)})
    AND source_ip IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)"""


@query("rul_4_persistence_after_login", f"""WITH {MIXED_SQL}, {GUESSING},
items AS (SELECT *, CASE WHEN timestamp_utc IS NULL THEN CAST(nullif(regexp_extract(
    coalesce(description, '') || ' ' || coalesce(notes, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}'), '')
    AS TIMESTAMP) END AS written FROM mixed WHERE subcategory IN ({quoted_list(PERSISTENCE)})),
g AS (SELECT s.event_id, s.host_id, s.timestamp_utc AS f, max(p.timestamp_utc) AS l, count(p.written) AS undated,
    list_append(list(p.event_id), s.event_id) AS ids
    FROM mixed s JOIN items p ON p.timestamp_utc BETWEEN s.timestamp_utc AND s.timestamp_utc + INTERVAL 120 MINUTE
    OR p.written BETWEEN s.timestamp_utc - INTERVAL 120 MINUTE AND s.timestamp_utc + INTERVAL 120 MINUTE
    WHERE s.subcategory = 'successful_login' AND NOT coalesce(s.tool_generated_flag, false)
    AND s.source_ip IN (SELECT source_ip FROM guessing) GROUP BY 1, 2, 3)
""" + finding_sql(
    "persistence_after_login", "'high'", "'A way back in was created shortly after a suspicious login'", "g",
    confidence="'Medium'", first="f", last="CASE WHEN undated = 0 THEN l END"))
def _persistence(spark, sf_dir):
    return shown(REGISTRY["persistence_after_login"].findings(mixed_events(spark, sf_dir)))


@query("rul_5_off_hours_privileged", f"""WITH {AUDIT_SQL},
g AS (SELECT trim(actor_user, chr(39) || chr(34)) AS u, arg_min(host_id, {ORDER}) AS host,
    min(timestamp_utc) AS f, max(timestamp_utc) AS l, list(event_id) AS ids FROM audit
    WHERE category = 'privilege_escalation' AND {NOISE}
    AND (hour(timestamp_local) < 8 OR hour(timestamp_local) >= 18) GROUP BY 1)
""" + finding_sql(
    "off_hours_privileged", "CASE WHEN len(ids) > 1 THEN 'medium' ELSE 'low' END",
    "'Administrator activity outside working hours by ' || u", "g", host="host", confidence="'Medium'",
    first="f", last="l"))
def _off_hours(spark, sf_dir):
    return shown(REGISTRY["off_hours_privileged"].findings(audit_events(spark, sf_dir)))


@query("rul_6_wiped_history", f"""WITH {MIXED_SQL},
logins AS (SELECT * FROM mixed WHERE actor_user IS NOT NULL
    AND subcategory IN ('successful_login', 'session_opened', 'login')),
g AS (SELECT actor_user, arg_min(host_id, {ORDER}) AS host, [arg_min(event_id, {ORDER})] AS ids FROM logins
    WHERE actor_user NOT IN ({quoted_list(SERVICE_ACCOUNTS)}) AND actor_user NOT IN (SELECT actor_user FROM mixed
      WHERE category = 'user_activity' AND subcategory IN ('shell_command', 'suspicious_command'))
    GROUP BY 1 HAVING count(timestamp_utc) >= 3)
""" + finding_sql(
    "wiped_history", "'high'", "'Command history for ' || actor_user || ' is missing or empty'", "g",
    host="host", confidence="'Medium'"))
def _wiped(spark, sf_dir):
    return shown(REGISTRY["wiped_history"].findings(mixed_events(spark, sf_dir)))


@query("rul_7_zero_length_login_log", f"""WITH {MIXED_SQL},
g AS (SELECT *, [event_id] AS ids, (SELECT count(*) FROM mixed WHERE timestamp_utc IS NOT NULL
    AND subcategory IN ('successful_login', 'session_opened')) AS others
    FROM mixed WHERE subcategory IN ('utmp_empty', 'lastlog_absent_or_empty'))
""" + finding_sql(
    "zero_length_login_log", "'high'", "'Login record file ' || source_artifact_path || ' is empty'", "g",
    confidence="CASE WHEN others > 0 THEN 'High' ELSE 'Medium' END"))
def _zero_length(spark, sf_dir):
    return shown(REGISTRY["zero_length_login_log"].findings(mixed_events(spark, sf_dir)))


@query("rul_8_rotation_gap", f"""WITH {MIXED_SQL},
n AS (SELECT DISTINCT regexp_extract(source_artifact_path, '^(.+?)\\.([0-9]+)(\\.gz)?$', 1) AS family,
    CAST(regexp_extract(source_artifact_path, '^(.+?)\\.([0-9]+)(\\.gz)?$', 2) AS BIGINT) AS number FROM mixed),
g AS (SELECT family, CAST([] AS VARCHAR[]) AS ids FROM n GROUP BY family
    HAVING max(number) > count(DISTINCT number) FILTER (number >= 1))
""" + finding_sql("rotation_gap", "'medium'", "'Gap in the rotation sequence of ' || family", "g",
                  host="NULL", confidence="'Medium'"))
def _rotation(spark, sf_dir):
    return shown(REGISTRY["rotation_gap"].findings(mixed_events(spark, sf_dir)))


@query("rul_9_timeline_gap", f"""WITH {AUDIT_SQL},
p AS (SELECT *, lag(timestamp_utc) OVER w AS pt, lag(event_id) OVER w AS pid FROM audit
    WHERE timestamp_utc IS NOT NULL WINDOW w AS (PARTITION BY source_artifact_path ORDER BY timestamp_utc, event_hash)),
s AS (SELECT source_artifact_path FROM audit WHERE timestamp_utc IS NOT NULL GROUP BY 1 HAVING count(*) >= 40
    AND max(timestamp_utc) > min(timestamp_utc)
    AND count(*) / ((epoch_us(max(timestamp_utc)) - epoch_us(min(timestamp_utc))) / 3600000000.0) >= 1),
q AS (SELECT *, row_number() OVER (PARTITION BY source_artifact_path ORDER BY timestamp_utc, event_hash) AS rn
    FROM p WHERE timestamp_utc - pt >= INTERVAL 3 HOUR),
g AS (SELECT *, [pid, event_id] AS ids FROM q WHERE rn = 1
    AND source_artifact_path IN (SELECT source_artifact_path FROM s))
""" + finding_sql(
    "timeline_gap", "'medium'",
    "printf('%.1f', (epoch_us(timestamp_utc) - epoch_us(pt)) / 3600000000.0) || '-hour silence in ' || "
    "source_artifact_path", "g", host="NULL", confidence="'Medium'", first="pt", last="timestamp_utc"))
def _timeline_gap(spark, sf_dir):
    return shown(REGISTRY["timeline_gap"].findings(audit_events(spark, sf_dir), timeline_gap_hours=3))


@query("rul_10_backwards_timestamps", f"""WITH {MIXED_SQL},
p AS (SELECT *, lag(timestamp_utc) OVER w AS pt, lag(event_id) OVER w AS pid FROM mixed
    WHERE timestamp_utc IS NOT NULL WINDOW w AS (PARTITION BY source_artifact_path ORDER BY raw_line_offset, event_hash)),
q AS (SELECT *, row_number() OVER (PARTITION BY source_artifact_path ORDER BY raw_line_offset, event_hash) AS rn
    FROM p WHERE timestamp_utc < pt),
g AS (SELECT *, [pid, event_id] AS ids FROM q WHERE rn = 1)
""" + finding_sql(
    "backwards_timestamps", "'medium'", "'Timestamps run backwards inside ' || source_artifact_path", "g",
    host="NULL", first="timestamp_utc"))
def _backwards(spark, sf_dir):
    return shown(REGISTRY["backwards_timestamps"].findings(mixed_events(spark, sf_dir)))


@query("rul_11_journald_sequence_gap", f"""WITH {MIXED_SQL},
g AS (SELECT *, [event_id] AS ids FROM mixed WHERE subcategory = 'journal_sequence_gap')
""" + finding_sql(
    "journald_sequence_gap", "'high'", "'Journald log sequence gap detected in ' || source_artifact_path", "g",
    first="timestamp_utc"))
def _journal_gap(spark, sf_dir):
    return shown(REGISTRY["journald_sequence_gap"].findings(mixed_events(spark, sf_dir)))


def _first_seen_sql(column: str, label: str) -> str:
    return f"""SELECT '{label}' AS label, v.value, v.f, v.l, list(r.event_id) AS ids, arg_min(r.host_id, r.rn) AS host
    FROM (SELECT {column} AS value, min(timestamp_utc) AS f, max(timestamp_utc) AS l FROM audit
          WHERE {column} IS NOT NULL AND {NOISE} GROUP BY 1) v
    JOIN (SELECT {column} AS value, event_id, host_id, row_number() OVER (PARTITION BY {column}
          ORDER BY timestamp_utc, event_hash) AS rn FROM audit WHERE timestamp_utc IS NOT NULL) r ON r.value = v.value
    WHERE epoch_us(v.f) >= (SELECT round(epoch_us(min(timestamp_utc)) + (epoch_us(max(timestamp_utc))
          - epoch_us(min(timestamp_utc))) * 0.02) FROM audit) GROUP BY 2, 3, 4"""


@query("rul_12_first_seen", f"""WITH {AUDIT_SQL},
g AS ({_first_seen_sql('source_ip', 'address')} UNION ALL {_first_seen_sql('actor_user', 'username')})
""" + finding_sql("first_seen", "'low'", "'First appearance of ' || label || ' ' || value", "g", host="host",
                  confidence="'Medium'", first="f", last="l"))
def _first_seen(spark, sf_dir):
    return shown(REGISTRY["first_seen"].findings(audit_events(spark, sf_dir), late_fraction=0.02))


# RE2 has the same syntax for these two expressions; the group-only prefix is the same as well.
_COMMAND = (f"coalesce(nullif(trim(regexp_replace(regexp_replace(trim(coalesce(description, '')), "
            f"'{COMMAND_PREFIX}', ''), '{COMMAND_SUFFIX}', '')), ''), trim(coalesce(raw_line, '')))")


@query("rul_13_suspicious_process", f"""WITH {MIXED_SQL}, {GUESSING},
m AS (SELECT *, {_COMMAND} AS cmd FROM mixed WHERE subcategory IN ({quoted_list(SOURCE_KIND)})
    AND regexp_matches(coalesce(description, '') || ' ' || coalesce(raw_line, ''), '{MALICIOUS_COMMAND}')),
hits AS (SELECT m.host_id, m.cmd, l.event_id AS lid, row_number() OVER (PARTITION BY m.host_id, m.cmd
    ORDER BY m.timestamp_utc, m.event_hash, l.timestamp_utc, l.event_hash) AS rn
    FROM m JOIN mixed l ON l.subcategory = 'successful_login'
    AND l.source_ip IN (SELECT source_ip FROM guessing)
    AND l.timestamp_utc BETWEEN m.timestamp_utc - INTERVAL 60 MINUTE AND m.timestamp_utc),
e AS (SELECT host_id, cmd, list(event_id) AS mids, min(timestamp_utc) AS f, max(timestamp_utc) AS l
    FROM m GROUP BY 1, 2),
g AS (SELECT e.*, h.lid, CASE WHEN h.lid IS NULL THEN mids ELSE list_append(mids, h.lid) END AS ids
    FROM e LEFT JOIN hits h ON h.rn = 1 AND h.host_id = e.host_id AND h.cmd = e.cmd)
""" + finding_sql(
    "suspicious_process", "'high'", "'Suspicious command executed: ' || cmd", "g", first="f", last="l",
    confidence="CASE WHEN lid IS NULL THEN 'Medium' ELSE 'High' END", version="1.1"))
def _suspicious_process(spark, sf_dir):
    return shown(REGISTRY["suspicious_process"].findings(mixed_events(spark, sf_dir)))


@query("rul_14_suspicious_cron", f"""WITH {MIXED_SQL},
c AS (SELECT *, trim(coalesce(raw_line, '')) AS cmd FROM mixed
    WHERE subcategory IN ('suspicious_cron_command', 'suspicious_cron_job')),
g AS (SELECT host_id, cmd, regexp_extract(cmd, '{MALICIOUS_COMMAND}') AS m, list(event_id) AS ids,
    min(timestamp_utc) FILTER (subcategory = 'suspicious_cron_command') AS f,
    max(timestamp_utc) FILTER (subcategory = 'suspicious_cron_command') AS l FROM c GROUP BY 1, 2)
""" + finding_sql(
    "suspicious_cron", "'high'",
    "'Suspicious command run from cron: ' || coalesce(nullif(trim(m), ''), cmd)", "g", first="f", last="l",
    confidence="CASE WHEN m <> '' THEN 'High' ELSE 'Medium' END"))
def _suspicious_cron(spark, sf_dir):
    return shown(REGISTRY["suspicious_cron"].findings(mixed_events(spark, sf_dir)))


def _state_sql(name: str, severity: str, title: str, where: str) -> str:
    return f"""WITH {MIXED_SQL},
g AS (SELECT trim(coalesce(nullif(actor_user, ''), 'unknown'), chr(39) || chr(34)) AS u,
    arg_min(host_id, {ORDER}) AS host, list(event_id) AS ids FROM mixed WHERE {where} GROUP BY 1)
""" + finding_sql(name, f"'{severity}'", title, "g", host="host")


@query("rul_15_uid0_account", _state_sql(
    "uid0_account", "high", "'Non-root account with root privileges: ' || u",
    "subcategory = 'uid0_account' OR (actor_uid = 0 AND actor_user IS NOT NULL AND actor_user <> 'root')"))
def _uid0(spark, sf_dir):
    return shown(REGISTRY["uid0_account"].findings(mixed_events(spark, sf_dir)))


@query("rul_16_passwordless_account", _state_sql(
    "passwordless_account", "high", "'Passwordless user account: ' || u",
    "subcategory = 'passwordless_account'"))
def _passwordless(spark, sf_dir):
    return shown(REGISTRY["passwordless_account"].findings(mixed_events(spark, sf_dir)))


@query("rul_17_privileged_group_member", _state_sql(
    "privileged_group_member", "medium", "'User ' || u || ' in privileged administrative group'",
    "subcategory = 'privileged_group_member'"))
def _privileged_group(spark, sf_dir):
    return shown(REGISTRY["privileged_group_member"].findings(mixed_events(spark, sf_dir)))


@query("rul_18_sshd_config_risk", f"""WITH {MIXED_SQL},
g AS (SELECT *, [event_id] AS ids FROM mixed WHERE subcategory = 'sshd_setting'
    OR (source_artifact_path ILIKE '%sshd_config%' AND description ILIKE '%PermitRootLogin%'))
""" + finding_sql("sshd_config_risk", "'high'", "'Insecure SSH configuration: ' || trim(raw_line)", "g"))
def _sshd_config(spark, sf_dir):
    return shown(REGISTRY["sshd_config_risk"].findings(mixed_events(spark, sf_dir)))


@query("rul_19_ld_preload_rootkit", f"""WITH {MIXED_SQL},
g AS (SELECT *, [event_id] AS ids FROM mixed WHERE subcategory = 'ld_preload_set'
    OR source_artifact_path ILIKE '%ld.so.preload%')
""" + finding_sql("ld_preload_rootkit", "'high'",
                  "'Suspicious dynamic linker preload library configured'", "g"))
def _ld_preload(spark, sf_dir):
    return shown(REGISTRY["ld_preload_rootkit"].findings(mixed_events(spark, sf_dir)))


#: Entries of the rules, and what their SQL says instead of the parameters that rules have by default.
RULE_ENTRIES = {
    "rul_1_brute_force": {"INTERVAL 24 HOUR": "INTERVAL 5 MINUTE", "HAVING max(n) >= 3": "HAVING max(n) >= 5"},
    "rul_2_brute_force_success": {"INTERVAL 24 HOUR": "INTERVAL 15 MINUTE"},
    "rul_3_new_account_privilege_grant": {}, "rul_4_persistence_after_login": {}, "rul_5_off_hours_privileged": {},
    "rul_6_wiped_history": {}, "rul_7_zero_length_login_log": {}, "rul_8_rotation_gap": {},
    "rul_9_timeline_gap": {"INTERVAL 3 HOUR": "INTERVAL 6 HOUR"}, "rul_10_backwards_timestamps": {},
    "rul_11_journald_sequence_gap": {}, "rul_12_first_seen": {"* 0.02)": "* 0.5)"}, "rul_13_suspicious_process": {},
    "rul_14_suspicious_cron": {}, "rul_15_uid0_account": {}, "rul_16_passwordless_account": {},
    "rul_17_privileged_group_member": {}, "rul_18_sshd_config_risk": {}, "rul_19_ld_preload_rootkit": {},
}


def _over_mixed(name: str, changes: dict[str, str]) -> str:
    """The SQL of a rule's entry over the mixed events, with default parameters."""
    sql = ORACLES[name]
    for view in (AUDIT_SQL, MIXED_SQL):
        sql = sql.removeprefix(f"WITH {view},")
    for old, new in changes.items():
        if old not in sql:
            raise ValueError(f"{name} no longer says {old!r}")
        sql = sql.replace(old, new)
    return f"SELECT * FROM (WITH {sql})"


#: All rules with their default parameters: tables ``mixed`` and ``findings``.
ALL_FINDINGS_SQL = f"{MIXED_SQL}, audit AS (SELECT * FROM mixed),\nfindings AS (" + "\nUNION ALL ".join(
    _over_mixed(name, changes) for name, changes in RULE_ENTRIES.items()) + ")"

#: Columns of the event table that neither rules nor the summaries beside them look at.
UNREAD = ("case_id", "timestamp_tz", "tz_source", "timestamp_confidence", "source_host", "source_artifact_sha256",
          "parser_name", "parser_version")

_all: dict[tuple[str, str], tuple[DataFrame, RunReport]] = {}


def all_rules(spark, sf_dir) -> tuple[DataFrame, RunReport]:
    """(mixed events, report of all rules over them with default parameters), written once per session and folder.

    A report with failed rules is not kept: the next query tries them again.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key in _all:
        return _all[key]
    events = cut_lineage(mixed_events(spark, sf_dir).drop(*UNREAD))
    report = run_rules(events, stored=True)
    if not report.failed:
        _all[key] = events, report
    return events, report


def all_findings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(mixed events, findings of all rules); an error if a rule failed, for no table shows that its findings are missing."""
    events, report = all_rules(spark, sf_dir)
    return events, report.whole()


@query("rul_20_rule_runner", f"""WITH {ALL_FINDINGS_SQL}
SELECT n.rule_name, 1 AS success, 0 AS fail, count(f.finding_id) AS findings
FROM (VALUES {', '.join(f"('{name.split('_', 2)[2]}')" for name in RULE_ENTRIES)}) n(rule_name)
LEFT JOIN findings f ON f.rule_name = n.rule_name GROUP BY 1""")
def _runner(spark, sf_dir):
    _, report = all_rules(spark, sf_dir)
    return report.stats()


@query("rul_20_all_findings", f"WITH {ALL_FINDINGS_SQL} SELECT * FROM findings")
def _all_rules(spark, sf_dir):
    _, findings = all_findings(spark, sf_dir)
    return shown(findings)


@query("joi_10_finding_events", f"""WITH {MIXED_SQL}
SELECT 'User ' || actor_user || ' in privileged administrative group' AS title, event_id, subcategory
FROM mixed WHERE subcategory = 'privileged_group_member'""")
def _pivot(spark, sf_dir):
    events = mixed_events(spark, sf_dir)
    findings = REGISTRY["privileged_group_member"].findings(events)
    return (pivot_to_events(findings, events, events.select("event_id", "subcategory"))
            .join(findings.select("finding_id", "title"), "finding_id")
            .select("title", "event_id", "subcategory"))
