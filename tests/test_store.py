"""Reading files, writing the store, exports, manifests and the query catalogue."""

from __future__ import annotations

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.extract import extract_all
from fleetlens.functions import binary, text as tx, times
from fleetlens.functions.ids import uuid5
from fleetlens.rules import REGISTRY
from fleetlens.sinks import exports
from fleetlens.sources.lines import read_lines
from fleetlens.sources.manifests import read_hash_manifests, read_host_contexts
from fleetlens.sources.records import read_binary_files
from fleetlens.plans.views import audit_events, mixed_events

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def bundle(tmp_path):
    """Evidence of two hosts: a large log cut into splits, CRLF and bad bytes, a gzip, manifests."""
    def put(path, data):
        full = tmp_path / "raw" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)
    log = b"".join(b"Jan  5 01:02:%02d n1 sshd[7]: Failed password for u%d from 10.0.0.%d port 4 ssh2\n" % (i % 60, i, i % 9)
                   for i in range(3000))
    put("h1/collected/files/var/log/auth.log", log)
    put("h1/collected/files/var/log/auth.log.1", b"first\r\nJan  5 01:02:03 n1 sshd[7]: Failed password for \xff from 10.0.0.1 port 4 ssh2\n")
    put("h2/collected/files/var/log/auth.log.2.gz", gzip.compress(b"x\nJan  5 01:02:03 n1 sshd[7]: Invalid user bob from 10.0.0.1\n"))
    for host, first in (("h1", b"original_path,sha256,size,mode,owner,atime,mtime,ctime,source_was_active,status\n"), ("h2", b"")):
        put(f"{host}/hash_manifest.csv", first + b'"/var/log/auth.log",ab,1,0644,root,1,1706000000,3,0,collected\n ,,,,,,,,,\n')
        put(f"{host}/manifest.json", json.dumps({
            "host": {"machine_id": host, "timezone": "Asia/Karachi" if host == "h2" else "Nowhere/X", "timezone_source": "etc_localtime",
                     "distro_id": "debian"}, "contamination": {"source_ip": "10.0.0.1"}}).encode())
    return str(tmp_path / "raw"), log


def test_lines_have_their_byte_offsets(spark, bundle):
    root, log = bundle
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = read_lines(spark, f"{root}/*/collected/files/var/log/*", root).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    mine = sorted((r for r in lines if r.artifact_path == "var/log/auth.log"), key=lambda r: r.byte_offset)
    at = 0
    for n, (got, want) in enumerate(zip(mine, log.split(b"\n")[:-1], strict=True), 1):
        assert (got.line_no, got.byte_offset, got.line) == (n, at, want.decode())
        at += len(want) + 1
    other = {r.line_no: r for r in lines if r.artifact_path == "var/log/auth.log.1"}
    assert other[1].line == "first" and other[2].byte_offset == 7 and other[2].had_decode_error
    zipped = {r.line_no: (r.host_id, r.byte_offset) for r in lines if r.artifact_path.endswith(".gz")}
    assert zipped == {1: ("h2", 0), 2: ("h2", 2)}


def test_evidence_to_store(spark, bundle, tmp_path):
    root, _ = bundle
    hosts = read_host_contexts(spark, f"{root}/*/manifest.json")
    assert {r.host_id: (r.tz_name, r.tz_source) for r in hosts.collect()} == {
        "h1": ("UTC", "assumed_utc"), "h2": ("Asia/Karachi", "etc_localtime")}
    manifest = read_hash_manifests(spark, f"{root}/*/hash_manifest.csv")
    assert [(r.original_path, r.mtime) for r in manifest.collect()] == [("/var/log/auth.log", "1706000000")] * 2
    lines = read_lines(spark, f"{root}/*/collected/files/var/log/*", root)
    events = extract_all(lines, hosts, only=["authlog_parser"])
    store = str(tmp_path / "store")
    first = exports.append_events(events, store)
    assert first == {"inserted": 3002, "deduped": 0, "invalid": 0}
    again = exports.append_events(events.unionByName(events), store)
    assert again == {"inserted": 0, "deduped": 6004, "invalid": 0}
    stored = exports.read_events(spark, store)
    assert stored.count() == 3002
    bad = stored.filter(F.col("source_artifact_path") == "var/log/auth.log.1").first()
    assert bad.actor_user == "�" and "�" in bad.raw_line
    plan = stored.filter(F.col("host_id") == "h1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(host_id" in plan


def test_names_keep_their_types_and_characters(spark, tmp_path):
    raw = tmp_path / "raw"
    names = ["my app/auth.log", "100%/auth.log", "a+b#1/auth.log", "größe/auth.log"]
    for host in ("007", "1e5"):
        for name in names:
            file = raw / host / "collected/files/var/log" / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(b"Jan  5 01:02:03 n1 sshd[7]: Invalid user bob from 10.0.0.1\n")
    lines = read_lines(spark, f"{raw}/*/collected/files/var/log/*/*", str(raw))
    want = {(h, f"var/log/{n}") for h in ("007", "1e5") for n in names}
    assert {(r.host_id, r.artifact_path) for r in lines.collect()} == want
    binary_files = read_binary_files(spark, str(raw), str(raw))
    assert {(r.host_id, r.artifact_path) for r in binary_files.collect()} == want
    events = audit_events(spark, SMALL).withColumn("host_id", F.when(F.col("host_id") == "host-1", "007").otherwise("1e5"))
    store = str(tmp_path / "store")
    assert exports.append_events(events, store)["inserted"] == events.select("event_hash").distinct().count()
    assert {r.host_id for r in exports.read_events(spark, store).select("host_id").distinct().collect()} == {"007", "1e5"}
    assert exports.append_events(events, store)["inserted"] == 0


def test_pivot_returns_all_events_of_long_findings(spark):
    """Keys shared by findings, spans that reach over steps, and an account with 3 000 events, without a list in a row."""
    from fleetlens.rules.base import empty_findings, finding_events, pivot_to_events

    big = 3000
    columns = {f.name: F.lit(None).cast(f.dataType) for f in audit_events(spark, SMALL).schema.fields}
    given = {"event_id": F.concat(F.lit("e"), F.col("id")), "actor_user": F.lit("u"), "subcategory": F.lit("sudo_privilege"),
             "category": F.lit("privilege_escalation"), "event_kind": F.lit("event"), "timestamp_utc": F.timestamp_micros(F.col("id") * 60_000_000)}
    events = spark.range(big).select(*[given.get(c, v).alias(c) for c, v in columns.items()])
    minute = 60_000_000
    rows = spark.createDataFrame(
        [(f"f{i}", [("grants_to_account", "u", 0, big * minute)]) for i in range(3)]
        + [("part", [("grants_to_account", "u", 59 * minute, 181 * minute), ("event", "e1", None, None)]), ("g", [("event", "e1", None, None), ("event", "e2", None, None)]),
           ("none", []), ("other", [("grants_to_account", "nobody", 0, big * minute)])],
        "finding_id string, evidence array<struct<kind:string,key:string,`from`:bigint,`to`:bigint>>")
    findings = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                             for f in empty_findings(spark).schema.fields])
    got = {r.finding_id: r["count"] for r in finding_events(findings, events).groupBy("finding_id").count().collect()}
    assert got == {"f0": big, "f1": big, "f2": big, "part": 124, "g": 2}
    assert pivot_to_events(findings, events).filter("finding_id = 'g'").count() == 2


@pytest.mark.parametrize("few", [0, 3, 1_000_000])
def test_append_by_hashes(spark, tmp_path, monkeypatch, few):
    """Known rows, rows there twice and new ones, however many hashes may be sent to every task."""
    monkeypatch.setattr(exports, "BROADCAST_HASHES", few)
    events, store = audit_events(spark, SMALL).cache(), str(tmp_path / "store")
    first = events.filter("actor_uid % 3 = 0")
    n, m = first.count(), events.count()
    assert exports.append_events(first.unionByName(first.limit(2)), store) == {"inserted": n, "deduped": 2, "invalid": 0}
    copies = events.filter("actor_uid % 3 = 1").limit(2).withColumn("parser_name", F.lit("a"))
    assert exports.append_events(events.unionByName(copies), store) == {"inserted": m - n, "deduped": n + 2, "invalid": 0}
    assert exports.append_events(events, store) == {"inserted": 0, "deduped": m, "invalid": 0}
    rows = exports.read_events(spark, store)
    assert rows.count() == rows.select("event_hash").distinct().count() == m
    assert rows.filter("parser_name = 'a'").count() == copies.count() == 2


def whole_seconds(spark):
    events = audit_events(spark, SMALL).limit(3)
    return events.withColumn("timestamp_utc", F.timestamp_seconds(F.lit(1706250714)))


def test_whole_seconds_keep_six_digits_in_exports(spark):
    for row in exports.json_rows(whole_seconds(spark)).collect():
        assert json.loads(row["json"])["timestamp_utc"] == "2024-01-26T06:31:54.000000+00:00"
    early = spark.sql("SELECT timestamp_micros(-1) AS t").select(times.export_instant(F.col("t"))).first()[0]
    assert early == "1969-12-31T23:59:59.999999+00:00"


def test_digest_of_whole_seconds_is_that_of_the_exported_text(spark):
    import hashlib
    events = whole_seconds(spark).cache()
    shas = []
    for row in events.collect():
        shown = {c: row[c] for c in sorted(events.columns)}
        shown["timestamp_utc"] = "2024-01-26T06:31:54.000000+00:00"
        shown["timestamp_local"] = row["timestamp_local"].strftime("%Y-%m-%dT%H:%M:%S")
        shas.append(hashlib.sha256(json.dumps(shown, separators=(",", ":")).encode()).hexdigest())
    sums = [str(sum(int(x[8 * i: 8 * i + 8], 16) for x in shas)) for i in range(4)]
    want = hashlib.sha256(":".join(["3", *sums]).encode()).hexdigest()
    assert tuple(exports.content_digest(events).first()) == (3, want)


def test_exports_are_the_same_every_time(spark, tmp_path):
    events = audit_events(spark, SMALL)
    digest = lambda df: tuple(exports.content_digest(df).first())
    assert digest(events) == digest(events.orderBy(F.rand(1)).repartition(5))
    assert digest(events) != digest(events.filter(F.col("raw_line_offset") > 0))
    read = lambda folder, ending: b"".join(
        open(os.path.join(base, f), "rb").read() for base, _, files in sorted(os.walk(folder))
        for f in sorted(files) if f.endswith(ending))
    for n in ("1", "2"):
        exports.export_json(events.repartition(int(n) + 1), str(tmp_path / n))
        exports.export_csv_per_category(events.repartition(int(n) + 1), str(tmp_path / ("c" + n)))
    assert read(tmp_path / "1", ".txt") == read(tmp_path / "2", ".txt")
    rows = [json.loads(x) for x in read(tmp_path / "1", ".txt").splitlines()]
    assert list(rows[0]) == sorted(rows[0]) and "notes" in rows[0]
    order = [(r["timestamp_utc"], r["category"], r["event_hash"]) for r in rows]
    assert order == sorted(order) and len(rows) == events.count()
    assert {d for d in os.listdir(tmp_path / "c1") if "=" in d} == {
        "category_folder=login_activity", "category_folder=privilege_escalation", "category_folder=user_accounts"}


def test_findings_are_replaced_per_case(spark, tmp_path):
    findings = REGISTRY["off_hours_privileged"].findings(audit_events(spark, SMALL))
    path = str(tmp_path / "findings")
    exports.write_findings(findings, path, "A")
    exports.write_findings(findings, path, "B")
    exports.write_findings(findings.limit(2), path, "A")
    counts = {r.case_id: r["count"] for r in spark.read.parquet(path).groupBy("case_id").count().collect()}
    assert counts == {"A": 2, "B": findings.count()}
    with pytest.raises(ValueError, match="confidence"):
        exports.write_findings(findings.withColumn("confidence", F.lit("Sure")), path, "A")


def test_binary_files(spark, tmp_path):
    path = tmp_path / "raw/h1/collected/files/var/log/wtmp"
    path.parent.mkdir(parents=True)
    path.write_bytes(b"abc")
    [row] = read_binary_files(spark, str(tmp_path / "raw"), str(tmp_path / "raw")).collect()
    assert (row.host_id, row.artifact_path, row.size) == ("h1", "var/log/wtmp", 3)


def test_scalar_edges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    import uuid
    from fleetlens.functions.ids import EVENT_NAMESPACE_HEX
    assert value(uuid5(F.lit("abc"))) == str(uuid.uuid5(uuid.UUID(EVENT_NAMESPACE_HEX), "abc"))
    assert value(tx.truncate_bytes(F.lit("é" * 1025), 2047)) == "é" * 1023
    import ipaddress
    for text in ("::1", "2001:db8::1", "1:0:0:2:0:0:0:3", "fe80::1:0:0:1", "1:2:3:4:5:6:7:8"):
        packed = ipaddress.IPv6Address(text).packed
        assert value(binary.address_text(F.lit(packed), 0)) == str(ipaddress.IPv6Address(text))
        assert value(tx.is_ip(F.lit(text)))
    for text in ("1.2.3", "256.1.1.1", "gw.example", "1::2::3", ":", "12345::1", ""):
        assert not value(tx.is_ip(F.lit(text)))
    assert value(binary.signed_le(F.lit(b"\xfe\xff\xff\xff"), 0)) == -2
    clock = lambda line, mtime, anchor=None: value(times.syslog_wall_clock(
        F.lit(line), F.lit(mtime), F.lit("UTC"), F.lit(anchor).cast("int")))
    # 29 February steps back to a leap year; two days of slack; no year at all.
    assert str(clock("Feb 29 01:02:03 x y", 1706000000.0)) == "2020-02-29 01:02:03"
    assert str(clock("Jan 24 08:00:00 x y", 1706000000.0)) == "2024-01-24 08:00:00"
    assert str(clock("Jan 26 08:00:00 x y", 1706000000.0)) == "2023-01-26 08:00:00"
    assert clock("Jan 26 08:00:00 x y", None) is None and clock("Foo 26 08:00:00 x y", 1.0) is None
    iso = lambda t: value(times.iso_instant(F.lit(t), F.lit("America/New_York")))
    assert str(iso("2024-03-10 02:30:00")) == "2024-03-10 07:30:00" and str(iso("2024-11-03 01:30:00")) == "2024-11-03 05:30:00"
    assert iso("2024-13-01 00:00:00") is None and iso("x") is None and str(iso("2024-01-01")) == "2024-01-01 05:00:00"


def test_search_reaches_the_scan(spark, tmp_path):
    from fleetlens.operators.search import search_events
    path = str(tmp_path / "events")
    mixed_events(spark, SMALL).write.parquet(path)
    page = search_events(spark.read.parquet(path), category="persistence", from_ts="2024-01-05")
    plan = spark._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    assert "EqualTo(category,persistence)" in plan and "GreaterThanOrEqual(timestamp_utc" in plan
    assert "TakeOrderedAndProject" in plan


def test_no_nested_loops_in_interval_rules(spark):
    events = audit_events(spark, SMALL)
    for name in ("brute_force", "brute_force_success", "new_account_privilege_grant", "persistence_after_login"):
        plan = REGISTRY[name].findings(events)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_catalogue():
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200
    areas = {name.split("_")[0] for name in queries}
    assert areas >= {"src", "out", "prd", "prj", "fn", "tim", "jsn", "arr", "cnd", "xtr", "joi", "agg", "win", "lim", "set",
                     "rul", "rpt", "int", "str", "udx"}


def test_rows_are_spread_by_shuffle_width_before_lines_are_made(spark):
    from fleetlens.plans.extract_queries import apt_lines
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    try:
        lines = apt_lines(spark, SMALL)
        assert lines.rdd.getNumPartitions() == 19
        # Read from above: lines are made of rows that were shuffled as events.
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Repartition") == 1 and plan.index("Generate") < plan.index("Repartition")
        assert audit_events(spark, SMALL).rdd.getNumPartitions() == 19
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
