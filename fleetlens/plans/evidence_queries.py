"""Sources, sinks and integrity checks over data that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.integrity.verify import artifacts_table, reverify, run_statistics, verify_manifest, without_failed
from fleetlens.operators.dedupe import dedupe_events
from fleetlens.plans.registry import query
from fleetlens.plans.views import AUDIT_SQL, MIXED_SQL, audit_events, mixed_events, read_table
from fleetlens.rules import REGISTRY
from fleetlens.rules.base import evidence_of, finding_errors, rule
from fleetlens.schema import EVENT_COLUMNS
from fleetlens.session import shared_folder
from fleetlens.sinks.exports import (
    append_events, content_digest, event_errors, export_csv_per_category, findings_for_export, json_rows, read_events, split_valid,
    write_findings,
)
from fleetlens.sources.manifests import hash_manifest_lines, host_contexts

# --------------------------------------------------------------- sources


@query("src_5_hash_manifest", """SELECT doc_id, '/d/' || CAST(doc_id AS VARCHAR) AS original_path, sha256(text) AS sha256,
    CAST(n_chars AS VARCHAR) AS size FROM documents WHERE doc_id % 10 > 1""")
def _manifest(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 10 == 0, "original_path").when(F.col("doc_id") % 10 == 1, "  ").otherwise(
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string")))
    line = F.concat_ws(",", path, F.sha2("text", 256), F.col("n_chars").cast("string"),
                       F.lit("0644,root,1,2,3,0,collected"))
    return hash_manifest_lines(docs.select("doc_id", line.alias("line"))).select(
        "doc_id", "original_path", "sha256", "size")


@query("src_6_host_contexts", """SELECT CASE c_custkey % 3 WHEN 0 THEN 'm' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_name
    ELSE 'unknown-host' END AS host_id, CASE WHEN c_custkey % 3 < 2 AND c_custkey % 2 = 0 THEN 'Asia/Karachi' ELSE 'UTC' END AS tz_name,
    CASE WHEN c_custkey % 3 < 2 AND c_custkey % 2 = 0 THEN 'etc_localtime' ELSE 'assumed_utc' END AS tz_source
FROM customer WHERE c_custkey % 3 < 2 OR c_custkey = 2""")
def _hosts(spark, sf_dir):
    k = F.col("c_custkey")
    host = F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("machine_id"),
        F.when(k % 3 == 1, F.col("c_name")).otherwise("").alias("hostname"),
        F.when((k % 3 < 2) & (k % 2 == 0), "Asia/Karachi").otherwise("Mars/Base").alias("timezone"),
        F.lit("etc_localtime").alias("timezone_source"))
    docs = read_table(spark, sf_dir, "customer").select(F.to_json(F.struct(host.alias("host"))).alias("value"))
    return host_contexts(docs).select("host_id", "tz_name", "tz_source")


@query("src_7_all_hosts", f"WITH {AUDIT_SQL} SELECT host_id, count(*) AS n FROM audit GROUP BY 1")
def _all_hosts(spark, sf_dir):
    return audit_events(spark, sf_dir).groupBy("host_id").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- sinks



def _damaged(spark, sf_dir):
    """Audit events of which some break one rule of the event model each."""
    k = F.col("actor_uid") % 7
    return (audit_events(spark, sf_dir)
            .withColumn("severity", F.when(k == 0, "grave").otherwise(F.col("severity")))
            .withColumn("timestamp_utc", F.when(k != 1, F.col("timestamp_utc")))
            .withColumn("raw_line", F.when(k == 2, F.repeat("raw_line", 60)).otherwise(F.col("raw_line")))
            .withColumn("raw_line_offset", F.when(k == 3, F.lit(-1)).otherwise(F.col("raw_line_offset"))))


@query("out_5_validation", f"""WITH {AUDIT_SQL} SELECT event_id, CASE user_id % 7 WHEN 0 THEN 'severity: unknown word'
    WHEN 1 THEN 'timestamp_utc: missing but not unknown' WHEN 2 THEN CASE WHEN strlen(raw_line) * 60 > 2048
    THEN 'raw_line: too long' ELSE '' END WHEN 3 THEN 'raw_line_offset: invalid' ELSE '' END AS problems FROM audit""")
def _validation(spark, sf_dir):
    return _damaged(spark, sf_dir).select("event_id", F.array_join(event_errors(), "; ").alias("problems"))


@query("out_5_valid_rows", f"WITH {AUDIT_SQL} SELECT event_id FROM audit WHERE user_id % 7 > 3")
def _valid(spark, sf_dir):
    valid, _ = split_valid(_damaged(spark, sf_dir))
    return valid.select("event_id")


@query("out_1_deduplicated_batch", f"WITH {AUDIT_SQL} SELECT event_hash, event_id FROM audit")
def _batch(spark, sf_dir):
    # The batch arrives twice; every hash must come out once.
    events = audit_events(spark, sf_dir)
    return dedupe_events(events.unionByName(events.withColumn("parser_name", F.lit("copy")))).select(
        "event_hash", "event_id")


@query("out_1_append_twice", f"""WITH {AUDIT_SQL}, n AS (SELECT count(DISTINCT event_hash) AS n FROM audit)
SELECT 1 AS batch, n AS inserted, 0 AS deduped, 0 AS invalid, n AS stored FROM n
UNION ALL SELECT 2, 0, n, 0, n FROM n""")
def _append_twice(spark, sf_dir):
    store, rows = shared_folder(spark, "store"), []
    for batch in (1, 2):
        counts = append_events(audit_events(spark, sf_dir), store)
        rows.append((batch, counts["inserted"], counts["deduped"], counts["invalid"], read_events(spark, store).count()))
    return spark.createDataFrame(rows, "batch int, inserted bigint, deduped bigint, invalid bigint, stored bigint")


@query("src_11_store_read_back", f"WITH {AUDIT_SQL} SELECT event_hash, event_id, host_id, timestamp_utc, description FROM audit")
def _read_back(spark, sf_dir):
    store = shared_folder(spark, "store")
    append_events(audit_events(spark, sf_dir), store)
    return read_events(spark, store).select("event_hash", "event_id", "host_id", "timestamp_utc", "description")


def _json_sql(column: str) -> str:
    fixed = {
        "timestamp_utc": "strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'",
        "timestamp_local": "strftime(timestamp_local, '%Y-%m-%dT%H:%M:%S')", "timestamp_tz": "'UTC'",
        "tz_source": "'assumed_utc'", "timestamp_confidence": "'exact'", "parser_name": "'authlog_parser'",
        "parser_version": "'1.0'", "source_artifact_sha256": "sha256(source_artifact_path)"}
    return fixed.get(column, column)


_JSON = "to_json({" + ", ".join(f"'{c}': {_json_sql(c)}" for c in sorted(EVENT_COLUMNS)) + "})"


@query("out_2_canonical_json", f"WITH {AUDIT_SQL} SELECT event_hash, CAST({_JSON} AS VARCHAR) AS json FROM audit")
def _canonical_json(spark, sf_dir):
    return json_rows(audit_events(spark, sf_dir)).select("event_hash", "json")


@query("out_4_content_digest", f"""WITH {AUDIT_SQL}, d AS (SELECT sha256(CAST({_JSON} AS VARCHAR)) AS h FROM audit),
s AS (SELECT count(*) AS rows, {', '.join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR) AS l{i}" for i in range(4))} FROM d)
SELECT rows, sha256(concat_ws(':', CAST(rows AS VARCHAR), l0, l1, l2, l3)) AS digest FROM s""")
def _digest(spark, sf_dir):
    return content_digest(audit_events(spark, sf_dir))


@query("out_6_finding_validation", f"""WITH {MIXED_SQL} SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'confidence: unknown word'
    ELSE 'check_next: missing' END AS problems FROM mixed WHERE subcategory = 'ld_preload_set'""")
def _finding_validation(spark, sf_dir):
    events = mixed_events(spark, sf_dir)
    findings = REGISTRY["ld_preload_rootkit"].findings(events).withColumn("event_id", F.col("evidence")[0]["key"])
    even = events.select("event_id", (F.col("actor_uid") % 2 == 0).alias("even"))
    broken = findings.join(even, "event_id").withColumns({
        "confidence": F.when(F.col("even"), "Sure").otherwise(F.col("confidence")),
        "check_next": F.when(~F.col("even"), " ").otherwise(F.col("check_next"))})
    return broken.select("event_id", F.array_join(finding_errors(broken), "; ").alias("problems"))


@query("out_6_findings_with_json_ids", f"""WITH {MIXED_SQL} SELECT 'Passwordless user account: ' || actor_user AS title,
    '["' || string_agg(event_id, '","' ORDER BY event_id) || '"]' AS event_ids FROM mixed
WHERE subcategory = 'passwordless_account' GROUP BY actor_user""")
def _json_ids(spark, sf_dir):
    events = mixed_events(spark, sf_dir)
    return findings_for_export(REGISTRY["passwordless_account"].findings(events), events).select("title", "event_ids")


@query("joi_10_evidence_filter", f"""WITH {MIXED_SQL} SELECT 'u' || CAST(user_id AS VARCHAR) AS actor_user, event_id FROM mixed
WHERE user_id = (SELECT min(user_id) FROM mixed WHERE subcategory = 'passwordless_account')
    AND subcategory = 'passwordless_account'""")
def _evidence(spark, sf_dir):
    # The predicate a finding carries selects its evidence from the event table.
    events = mixed_events(spark, sf_dir)
    first = events.filter(F.col("subcategory") == "passwordless_account").agg(F.min("actor_uid")).first()[0]
    finding = REGISTRY["passwordless_account"].findings(events).filter(
        F.col("title") == f"Passwordless user account: u{first}").first()
    return evidence_of(events, finding["evidence_filter"]).select("actor_user", "event_id")


# ------------------------------------------------------------- integrity

def _files(spark, sf_dir):
    """Documents as stored files; the content of every ninth one was changed after collection."""
    docs = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    manifest = docs.select(
        F.concat(F.lit("host-"), (k % 8).cast("string")).alias("host_id"),
        F.concat(F.lit("/d/"), k.cast("string")).alias("original_path"),
        F.when(k % 11 == 0, "").otherwise(F.sha2("text", 256)).alias("sha256"),
        F.when(k % 13 == 0, "redacted").otherwise("collected").alias("status"))
    files = docs.filter(k % 7 != 0).select(
        F.concat(F.lit("host-"), (k % 8).cast("string")).alias("host_id"),
        F.concat(F.lit("collected/files/d/"), k.cast("string")).alias("stored_path"),
        F.sha2(F.when(k % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("actual_sha256"),
        (k % 17 == 0).alias("is_directory"))
    return manifest, files


_REASON = """CASE WHEN doc_id % 13 = 0 THEN 'redacted' WHEN doc_id % 7 <> 0 AND doc_id % 17 = 0 THEN 'is_directory'
    WHEN doc_id % 7 = 0 THEN 'absent' WHEN doc_id % 9 = 0 AND doc_id % 11 <> 0 THEN 'hash mismatch' END"""


@query("int_1_manifest_verification", f"""WITH r AS (SELECT *, {_REASON} AS reason FROM documents)
SELECT 'host-' || CAST(doc_id % 8 AS VARCHAR) AS host_id, '/d/' || CAST(doc_id AS VARCHAR) AS original_path, reason,
    CASE WHEN reason IS NULL THEN 'verified' WHEN reason IN ('absent', 'hash mismatch') THEN 'failed' ELSE 'skipped' END AS result FROM r""")
def _verify(spark, sf_dir):
    return verify_manifest(*_files(spark, sf_dir)).select("host_id", "original_path", "reason", "result")


@query("joi_7_verification_counts", f"""WITH r AS (SELECT *, {_REASON} AS reason FROM documents)
SELECT CASE WHEN reason IS NULL THEN 'verified' WHEN reason IN ('absent', 'hash mismatch') THEN 'failed' ELSE 'skipped' END AS result,
    count(*) AS n FROM r GROUP BY 1""")
def _verify_counts(spark, sf_dir):
    return verify_manifest(*_files(spark, sf_dir)).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


@query("int_2_quarantine", f"""SELECT 'collected/files/d/' || CAST(doc_id AS VARCHAR) AS stored_path FROM documents
WHERE doc_id % 7 <> 0 AND coalesce({_REASON}, '') <> 'hash mismatch'""")
def _quarantine(spark, sf_dir):
    manifest, files = _files(spark, sf_dir)
    return without_failed(files, verify_manifest(manifest, files)).select("stored_path")


@query("int_3_reverification", """SELECT 'host-' || CAST(doc_id % 8 AS VARCHAR) AS host_id,
    CASE WHEN doc_id % 8 <> 5 THEN 'collected/files/d/' || CAST(doc_id AS VARCHAR) END AS stored_path,
    CASE WHEN doc_id % 8 = 5 THEN 'unrecorded' WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 9 = 0 THEN 'modified'
    ELSE 'reverified' END AS status FROM documents WHERE doc_id % 8 <> 5 OR doc_id = 5""")
def _reverify(spark, sf_dir):
    _, files = _files(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").filter(F.col("doc_id") % 8 != 5)
    recorded = docs.select(
        F.concat(F.lit("host-"), (F.col("doc_id") % 8).cast("string")).alias("host_id"),
        F.concat(F.lit("collected/files/d/"), F.col("doc_id").cast("string")).alias("stored_path"),
        F.sha2("text", 256).alias("sha256"))
    return reverify(recorded, files)


@query("out_7_artifacts_table", """SELECT 'host-' || CAST(doc_id % 8 AS VARCHAR) AS host_id, '/d/' || CAST(doc_id AS VARCHAR) AS original_path,
    CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE 'verified' END AS integrity, 'success' AS parse_status, n_chars AS parse_events
FROM documents""")
def _artifacts(spark, sf_dir):
    manifest, _ = _files(spark, sf_dir)
    manifest = manifest.withColumn("size", F.lit("1")).withColumn("mtime", F.lit("2"))
    docs = read_table(spark, sf_dir, "documents")
    status = docs.select(
        F.concat(F.lit("host-"), (F.col("doc_id") % 8).cast("string")).alias("host_id"),
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("artifact_path"),
        F.lit("success").alias("parse_status"), F.col("n_chars").alias("parse_events"))
    return artifacts_table(manifest, status).select("host_id", "original_path", "integrity", "parse_status", "parse_events")


@query("joi_6_manifest_and_status", """SELECT '/d/' || CAST(doc_id AS VARCHAR) AS original_path,
    CASE WHEN doc_id % 13 = 0 THEN 'redacted' ELSE 'collected' END AS status,
    CASE WHEN doc_id % 2 = 0 THEN 'success' ELSE 'skip' END AS parse_status FROM documents""")
def _manifest_status(spark, sf_dir):
    manifest, _ = _files(spark, sf_dir)
    manifest = manifest.withColumn("size", F.lit("1")).withColumn("mtime", F.lit("2"))
    k = F.col("doc_id")
    status = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("host-"), (k % 8).cast("string")).alias("host_id"),
        F.concat(F.lit("d/"), k.cast("string")).alias("artifact_path"),
        F.when(k % 2 == 0, "success").otherwise("skip").alias("parse_status"), F.lit(0).cast("long").alias("parse_events"))
    return artifacts_table(manifest, status).select("original_path", "status", "parse_status")


@query("int_4_run_statistics", f"""WITH {AUDIT_SQL}, a AS (SELECT count(*) AS seen, count(*) FILTER (page_id % 5 = 0) AS failed FROM pages)
SELECT any_value(a.seen) AS artifacts_seen, CAST(0 AS BIGINT) AS skipped, any_value(a.failed) AS failed,
    count(*) FILTER (user_id % 7 <> 0) AS events_inserted, count(*) FILTER (user_id % 7 <> 0) AS events_deduped,
    2 * count(*) FILTER (user_id % 7 = 0) AS events_invalid FROM audit, a""")
def _run_statistics(spark, sf_dir):
    artifacts = read_table(spark, sf_dir, "pages").select(
        F.when(F.col("page_id") % 5 == 0, "fail").otherwise("success").alias("parse_status"))
    events = audit_events(spark, sf_dir).withColumn("severity", F.when(
        F.col("actor_uid") % 7 == 0, "grave").otherwise(F.col("severity")))
    return run_statistics(artifacts, events.unionByName(events), event_errors())


# -------------------------------------------------------------- plug-ins

@query("udx_2_own_rule", f"""WITH {MIXED_SQL} SELECT 'Firewall hit on ' || host_id AS title, count(*) AS event_count FROM mixed
WHERE subcategory = 'firewall_block' GROUP BY host_id HAVING count(*) >= 5""")
def _own_rule(spark, sf_dir):
    from fleetlens.rules.base import EVIDENCE, EvidenceKind, counted, finish, keyed, text

    if "firewall_hits" not in REGISTRY:
        blocked = lambda: F.col("subcategory") == "firewall_block"
        EVIDENCE["firewall_hits"] = EvidenceKind(blocked, lambda: F.col("host_id"))

        @rule("firewall_hits", firewall_min=3)
        def firewall_hits(events, firewall_min=3):
            heads = events.filter(blocked()).groupBy("host_id").agg(*counted()).filter(F.col("event_count") >= firewall_min).withColumns({
                "evidence": F.array(keyed("firewall_hits", F.col("host_id"))),
                "evidence_filter": text("subcategory = 'firewall_block' AND host_id = '", F.col("host_id"), "'")})
            return finish(
                heads, "firewall_hits", "1.0", "low",
                title=text("Firewall hit on ", F.col("host_id")), what=text("blocked traffic"),
                why="someone knocks", confidence="Low", next_step="look at the source", detail=text("firewall"),
                host=F.col("host_id"))
    own = REGISTRY["firewall_hits"]
    try:
        return own.findings(mixed_events(spark, sf_dir), firewall_min=5).select("title", "event_count")
    finally:
        del REGISTRY["firewall_hits"], EVIDENCE["firewall_hits"]


@query("udx_1_own_extractor", """SELECT event_id * 1000 AS raw_line_offset, 'app_error' AS subcategory, 'code ' ||
    CAST(user_id AS VARCHAR) AS description FROM events WHERE event_type = 'error'""")
def _own_extractor(spark, sf_dir):
    from fleetlens.extract.base import Extractor, state
    from fleetlens.plans.extract_queries import hosts_of, lines_from

    def run(lines):
        code = F.regexp_extract("line", r"^ERROR (\d+)", 1)
        return state(lines.filter(code != ""), category="environment", subcategory="app_error", severity="low",
                     description=F.concat(F.lit("code "), code), raw_line=F.col("line"),
                     raw_line_offset=F.col("byte_offset"))

    lines = lines_from(read_table(spark, sf_dir, "events"), "opt/app/app.log", F.concat(
        F.upper("event_type"), F.lit(" "), F.col("user_id").cast("string")))
    own = Extractor("app_parser", "0.1", ("opt/app/*.log",), run)
    return own.extract(lines, hosts_of(spark, sf_dir)).select("raw_line_offset", "subcategory", "description")


@query("udx_3_own_grammar", """SELECT event_id, 'shop_' || event_type AS rule, 'u' || CAST(user_id AS VARCHAR) AS user_name FROM events
WHERE event_type IN ('click', 'purchase')""")
def _own_grammar(spark, sf_dir):
    from fleetlens.extract.grammar import GrammarRule, line_matches

    made = [GrammarRule(f"shop_{kind}", kind, rf"{kind} by (\S+)", ("user",), "user_activity", kind, "info", "shop")
            for kind in ("click", "purchase")]
    line = F.concat("event_type", F.lit(" by u"), F.col("user_id").cast("string"))
    return read_table(spark, sf_dir, "events").withColumn("line", line).select(
        "event_id", F.explode(line_matches("line", "''", made)).alias("m")).select(
        "event_id", F.col("m.rule").alias("rule"), F.col("m.user").alias("user_name"))


@query("udx_4_rule_parameters", f"""WITH {AUDIT_SQL} SELECT 'Administrator activity outside working hours by ' || actor_user AS title,
    count(*) AS event_count FROM audit WHERE category = 'privilege_escalation' AND NOT coalesce(tool_generated_flag, false)
    AND (hour(timestamp_local) < 6 OR hour(timestamp_local) >= 22) GROUP BY actor_user""")
def _parameters(spark, sf_dir):
    return REGISTRY["off_hours_privileged"].findings(audit_events(spark, sf_dir), business_hours=(6, 22)).select(
        "title", "event_count")


# ----------------------------------------------------- written and read back

@query("out_3_csv_per_category", f"""WITH {AUDIT_SQL} SELECT category, event_id, subcategory, description, severity,
    CAST(raw_line_offset AS VARCHAR) AS raw_line_offset FROM audit""")
def _csv_files(spark, sf_dir):
    """Events written as one folder of CSV files per category, and what the files say."""
    path = shared_folder(spark, "csv")
    export_csv_per_category(audit_events(spark, sf_dir), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(F.col("category_folder").alias("category"), "event_id", "subcategory", "description", "severity", "raw_line_offset")


@query("out_6_findings_replaced", f"""WITH {MIXED_SQL}
SELECT 'C1' AS case_id, 'ld_preload_rootkit' AS rule_name, count(*) AS findings FROM mixed WHERE subcategory = 'ld_preload_set'
UNION ALL SELECT 'C2', 'passwordless_account', count(DISTINCT actor_user) FROM mixed WHERE subcategory = 'passwordless_account'""")
def _findings_replaced(spark, sf_dir):
    """Findings of two cases are written; then those of the first are replaced."""
    events, path = mixed_events(spark, sf_dir), shared_folder(spark, "findings-store")
    accounts = REGISTRY["passwordless_account"].findings(events)
    for case, findings in (("C1", accounts), ("C2", accounts), ("C1", REGISTRY["ld_preload_rootkit"].findings(events))):
        write_findings(findings, path, case)
    return spark.read.parquet(path).groupBy("case_id", "rule_name").agg(F.count(F.lit(1)).alias("findings"))
