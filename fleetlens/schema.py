"""Table schemas and the closed vocabularies of the event model."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("host_id", T.StringType()),
    T.StructField("event_hash", T.StringType()),
    T.StructField("event_kind", T.StringType()),
    T.StructField("timestamp_utc", T.TimestampType()),
    T.StructField("timestamp_local", T.TimestampNTZType()),
    T.StructField("timestamp_tz", T.StringType()),
    T.StructField("tz_source", T.StringType()),
    T.StructField("timestamp_confidence", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("actor_user", T.StringType()),
    T.StructField("actor_uid", T.LongType()),
    T.StructField("actor_process", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("source_host", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source_artifact_path", T.StringType()),
    T.StructField("source_artifact_sha256", T.StringType()),
    T.StructField("raw_line", T.StringType()),
    T.StructField("raw_line_offset", T.LongType()),
    T.StructField("parser_name", T.StringType()),
    T.StructField("parser_version", T.StringType()),
    T.StructField("tool_generated_flag", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

RAW_LINE_SCHEMA = T.StructType([
    T.StructField("host_id", T.StringType()),
    T.StructField("artifact_path", T.StringType()),
    T.StructField("artifact_sha256", T.StringType()),
    T.StructField("artifact_mtime", T.DoubleType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("byte_offset", T.LongType()),
    T.StructField("line", T.StringType()),
    T.StructField("had_decode_error", T.BooleanType()),
])

CONTAMINATION_TYPE = T.StructType([
    T.StructField("operator_user", T.StringType()),
    T.StructField("operator_login_user", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("start_utc", T.StringType()),
    T.StructField("end_utc", T.StringType()),
])

HOST_SCHEMA = T.StructType([
    T.StructField("host_id", T.StringType()),
    T.StructField("tz_name", T.StringType()),
    T.StructField("tz_source", T.StringType()),
    T.StructField("distro_id", T.StringType()),
    T.StructField("version_id", T.StringType()),
    T.StructField("init_system", T.StringType()),
    T.StructField("contamination", CONTAMINATION_TYPE),
])

# Where a finding's events are: a key in a kind of evidence, with the span of its order where only a part counts.
EVIDENCE_TYPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("from", T.LongType()),
    T.StructField("to", T.LongType()),
])

FINDING_SCHEMA = T.StructType([
    T.StructField("finding_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("rule_version", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("what_happened", T.StringType()),
    T.StructField("why_it_matters", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("check_next", T.StringType()),
    T.StructField("technical_detail", T.StringType()),
    T.StructField("first_ts_utc", T.TimestampType()),
    T.StructField("last_ts_utc", T.TimestampType()),
    T.StructField("host_id", T.StringType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("evidence", T.ArrayType(EVIDENCE_TYPE)),
    T.StructField("evidence_filter", T.StringType()),
])
FINDING_COLUMNS = FINDING_SCHEMA.fieldNames()

MANIFEST_SCHEMA = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("original_path", "sha256", "size", "mode", "owner", "atime", "mtime", "ctime",
                 "source_was_active", "status")
])

# The vocabularies an event must use.
EVENT_KINDS = ("event", "state_finding")
TZ_SOURCES = ("etc_localtime", "etc_timezone", "log_offset", "assumed_utc")
TIMESTAMP_CONFIDENCES = ("exact", "year_inferred", "unknown")
SEVERITIES = ("info", "low", "medium", "high")
CATEGORIES = (
    "user_accounts", "login_activity", "privilege_escalation", "persistence", "software_changes",
    "hardware_usb", "network_config", "user_activity", "environment",
)
REQUIRED_TEXT = (
    "event_id", "case_id", "host_id", "event_hash", "event_kind", "tz_source",
    "timestamp_confidence", "category", "subcategory", "description", "severity",
    "source_artifact_path", "source_artifact_sha256", "parser_name", "parser_version",
)
RAW_LINE_MAX_BYTES = 2048
CONFIDENCE_WORDS = ("High", "Medium", "Low")
