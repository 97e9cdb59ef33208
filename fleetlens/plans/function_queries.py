"""Scalar functions over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import binary, patterns, structured, times
from fleetlens.functions import text as tx
from fleetlens.functions.ids import EVENT_NAMESPACE_HEX, event_hash, finding_id, uuid5
from fleetlens.plans.registry import query
from fleetlens.plans.views import MIXED_SQL, mixed_events, read_table


def _select(name: str, table: str, sql: str, **columns):
    """Register a projection: ``columns`` are functions that give a column."""
    def run(spark, sf_dir):
        rows = read_table(spark, sf_dir, table)
        return rows.select(*[fn().alias(c) for c, fn in columns.items()])
    query(name, sql)(run)


def _doc(name: str, sql_value: str, value, column: str = "v", table: str = "documents", key: str = "doc_id"):
    """One computed column next to the key."""
    _select(name, table, f"SELECT {key}, {sql_value} AS {column} FROM {table}",
            **{key: lambda: F.col(key), column: value})


c = F.col  # the tables' columns, used inside functions only

_doc("fn_1_event_hash", "sha256(concat_ws(chr(31), source, lang, CAST(n_chars AS VARCHAR), text, 'x'))",
     lambda: event_hash(c("source"), c("lang"), c("n_chars"), c("text"), F.lit("x")))
_doc("fn_2_event_id", f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
    substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' ||
    substr(h, 21, 12) FROM (SELECT sha1(from_hex('{EVENT_NAMESPACE_HEX}') || encode(text)) AS h))""",
     lambda: uuid5(c("text")))


@query("fn_3_finding_id", """SELECT conv_id, substr(sha256(concat_ws(chr(31), 'r', '1', CAST(conv_id AS VARCHAR), '',
    string_agg(role || CAST(turn AS VARCHAR), chr(30) ORDER BY role || CAST(turn AS VARCHAR)))), 1, 32) AS v
FROM conversations GROUP BY conv_id""")
def _finding_id(spark, sf_dir):
    # A conversation has a handful of turns.
    ids = F.collect_list(F.concat("role", F.col("turn").cast("string")))
    grouped = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ids.alias("ids"))
    return grouped.select("conv_id", finding_id(
        F.lit("r"), F.lit("1"), F.col("conv_id").cast("string"), F.lit(None), F.col("ids")).alias("v"))


_doc("fn_4_truncate_bytes", """left(text, CAST((SELECT max(k) FROM range(0, 102) t(k)
    WHERE strlen(left(text, CAST(k AS INTEGER))) <= 101) AS INTEGER))""",
     lambda: tx.truncate_bytes(c("text"), 101))
_doc("fn_5_clean_utf8", "chr(65533) || text",
     lambda: tx.clean_utf8(F.unhex(F.concat(F.lit("FF"), F.hex("text"))).cast("string")))
_QUOTED = "CASE doc_id % 4 WHEN 0 THEN chr(39) || source || chr(39) WHEN 1 THEN '\"' || source || '\"' " \
          "WHEN 2 THEN chr(39) || source ELSE 'o' || chr(39) || source END"


def _quoted():
    q, s, k = F.lit("'"), c("source"), c("doc_id") % 4
    return (F.when(k == 0, F.concat(q, s, q)).when(k == 1, F.concat(F.lit('"'), s, F.lit('"')))
            .when(k == 2, F.concat(q, s)).otherwise(F.concat(F.lit("o"), q, s)))


_doc("fn_6_unquote_identifier", f"CASE WHEN doc_id % 4 < 2 THEN source ELSE {_QUOTED} END",
     lambda: tx.unquote_identifier(_quoted()))
_doc("fn_7_strip_quotes", f"trim({_QUOTED}, chr(39) || chr(34))", lambda: tx.strip_quotes(_quoted()))
_doc("fn_8_owner_from_path", "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'root' END",
     lambda: tx.owner_from_path(F.when(c("doc_id") % 3 == 0, F.concat(F.lit("home/"), "source", F.lit("/.ssh/x")))
                                .when(c("doc_id") % 3 == 1, "root/.bashrc").otherwise(F.concat(F.lit("etc/"), "source"))))

_TOOL = "CASE p_partkey % 4 WHEN 0 THEN 'nmap' WHEN 1 THEN 'fail2ban' WHEN 2 THEN 'python3-johnson' ELSE '' END"
_PACKAGE = f"replace(p_name, ' ', '-') || '-' || {_TOOL} || ':amd64'"


def _package():
    k = c("p_partkey") % 4
    tool = F.when(k == 0, "nmap").when(k == 1, "fail2ban").when(k == 2, "python3-johnson").otherwise("")
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), tool, F.lit(":amd64"))


_doc("fn_9_package_severity", "CASE p_partkey % 4 WHEN 0 THEN 'medium' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'high' "
     "ELSE 'info' END ELSE 'info' END",
     lambda: tx.package_severity(_package(), F.when(c("p_size") % 2 == 0, "purge").otherwise("install")),
     table="part", key="p_partkey")
_doc("fn_10_rpm_name", "replace(p_name, ' ', '-')",
     lambda: tx.rpm_name(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-1:"), c("p_size").cast("string"),
                                  F.lit(".0-3.el9.x86_64"))), table="part", key="p_partkey")

_INDICATORS = " || ".join(
    f"CASE WHEN regexp_matches(raw_line, '{p.replace(chr(39), chr(39) * 2)}') THEN '{why};' ELSE '' END"
    for p, why in patterns.PERSISTENCE_INDICATORS)


@query("fn_11_suspicious_reasons", f"WITH {MIXED_SQL} SELECT event_id, {_INDICATORS} AS v FROM mixed")
def _reasons(spark, sf_dir):
    found = patterns.suspicious_reasons(F.col("raw_line"))
    return mixed_events(spark, sf_dir).select("event_id", F.array_join(
        F.transform(found, lambda r: F.concat(r, F.lit(";"))), "").alias("v"))


def _regex(name: str, pattern: str, value):
    query(name, f"WITH {MIXED_SQL} SELECT event_id, regexp_matches(raw_line, '{pattern}') AS v FROM mixed")(
        lambda spark, sf_dir: mixed_events(spark, sf_dir).select("event_id", value(F.col("raw_line")).alias("v")))


_regex("fn_12_malicious_command", patterns.MALICIOUS_COMMAND, patterns.is_malicious)
_regex("fn_14_execution_shape", patterns.EXECUTION_SHAPE, patterns.is_execution_shape)
_regex("fn_14_startup_shape", patterns.STARTUP_SHAPE, patterns.is_startup_shape)


@query("fn_13_shell_class", f"""WITH {MIXED_SQL}, g AS (SELECT event_id, CASE
    WHEN {' OR '.join(f"regexp_matches(raw_line, '{p}')" for p in patterns.SHELL_HIGH)} THEN 'high'
    WHEN {' OR '.join(f"regexp_matches(raw_line, '{p}')" for p in patterns.SHELL_MEDIUM)} THEN 'medium'
    ELSE 'info' END AS severity FROM mixed)
SELECT event_id, severity, CASE severity WHEN 'info' THEN 'shell_command' ELSE 'suspicious_command' END AS subcategory FROM g""")
def _shell_class(spark, sf_dir):
    grade = patterns.shell_class(F.col("raw_line"))
    return mixed_events(spark, sf_dir).select("event_id", grade["severity"].alias("severity"),
                                              grade["subcategory"].alias("subcategory"))


_doc("fn_15_web_attack", f"regexp_matches(url || html, '{patterns.WEB_ATTACK}')",
     lambda: patterns.is_web_attack(F.concat("url", "html")), table="pages", key="page_id")
_ADDRESS = "CAST(n_chars % 300 AS VARCHAR) || '.0.2.' || CAST(doc_id % 300 AS VARCHAR)"
_doc("fn_16_address_or_host", f"CASE WHEN n_chars % 300 < 256 AND doc_id % 300 < 256 THEN {_ADDRESS} END",
     lambda: tx.source_ip_of(F.concat((c("n_chars") % 300).cast("string"), F.lit(".0.2."),
                                      (c("doc_id") % 300).cast("string"))))
_doc("fn_17_record_address", "'198.51.' || CAST(n_chars % 256 AS VARCHAR) || '.' || CAST(doc_id % 256 AS VARCHAR)",
     lambda: binary.address_text(F.unhex(F.concat(
         F.lit("C633"), F.lpad(F.hex(c("n_chars") % 256), 2, "0"), F.lpad(F.hex(c("doc_id") % 256), 2, "0"),
         F.lit("00" * 12))), 0))
_doc("fn_18_key_fingerprint", "'SHA256:' || rtrim(base64(from_hex(sha256(text))), '=')",
     lambda: tx.key_fingerprint(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")))

_BARE = (f"coalesce(nullif(trim(regexp_replace(regexp_replace(trim(description), '{tx.COMMAND_PREFIX}', ''), "
         f"'{tx.COMMAND_SUFFIX}', '')), ''), trim(raw_line))")


@query("fn_19_command_of", f"WITH {MIXED_SQL} SELECT event_id, {_BARE} AS v FROM mixed")
def _command_of(spark, sf_dir):
    return mixed_events(spark, sf_dir).select("event_id", tx.command_of().alias("v"))


_doc("fn_20_terminal", "CASE doc_id % 4 WHEN 0 THEN 'pts/' || CAST(n_chars AS VARCHAR) WHEN 1 THEN source "
     "WHEN 2 THEN 'tty1' ELSE 'unknown' END",
     lambda: tx.terminal(
         F.when(c("doc_id") % 4 == 0, F.concat(F.lit("type=7 line=pts/"), c("n_chars").cast("string"), F.lit(" user=x")))
         .when(c("doc_id") % 4 == 1, F.concat(F.lit("a ; TTY="), "source", F.lit(" ; b"))).otherwise("plain"),
         F.when(c("doc_id") % 4 == 2, "login at tty1").otherwise("nothing")))
_doc("fn_21_privileged_group", "lang", lambda: tx.privileged_group(
    F.concat(F.lit("User x belongs to privileged group "), "lang", F.lit(". (more)"))))

# ------------------------------------------------------------------- time

_EVENT = dict(table="events", key="event_id")
_SECOND = "date_trunc('second', ts)"
_stamp = lambda fmt: F.date_format("ts", fmt)
_utc = lambda: F.lit("UTC")
_mtime = lambda: F.lit(1706745600.0)
_doc("tim_1_syslog_rest", "'n1 x: ' || props", lambda: times.syslog_rest(F.concat(
    _stamp("MMM"), F.lit(" "), F.lpad(_stamp("d"), 2, " "), F.lit(" "), _stamp("HH:mm:ss"), F.lit(" n1 x: "), "props")),
    **_EVENT)
_doc("tim_2_year_inference", _SECOND, lambda: times.syslog_wall_clock(
    F.concat(_stamp("MMM"), F.lit(" "), F.lpad(_stamp("d"), 2, " "), F.lit(" "), _stamp("HH:mm:ss"), F.lit(" n1 x")),
    _mtime(), _utc()), **_EVENT)
_doc("tim_2_anchor_year", f"{_SECOND} - INTERVAL 3 YEAR", lambda: times.syslog_wall_clock(
    F.concat(_stamp("MMM d HH:mm:ss"), F.lit(" n1 x")), _mtime(), _utc(), F.lit(2021)), **_EVENT)
_doc("tim_3_local_to_utc", "ts - INTERVAL 5 HOUR", lambda: times.to_utc(c("ts"), F.lit("Asia/Karachi")), **_EVENT)
_doc("tim_3_unknown_zone", "ts", lambda: times.to_utc(c("ts"), times.known_zone(F.lit("Mars/Base"))), **_EVENT)
_doc("tim_4_iso", f"CASE event_id % 3 WHEN 0 THEN {_SECOND} - INTERVAL 330 MINUTE WHEN 1 THEN ts "
     "ELSE ts - INTERVAL 5 HOUR END",
     lambda: times.iso_instant(
         F.when(c("event_id") % 3 == 0, F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
         .when(c("event_id") % 3 == 1, F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
         .otherwise(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.lit("Asia/Karachi")), **_EVENT)
_doc("tim_5_epoch", "ts", lambda: times.epoch_micros(times.micros(c("ts"))), **_EVENT)
_doc("tim_6_webkit", "ts", lambda: times.webkit_micros(
    times.micros(c("ts")) + times.WEBKIT_EPOCH_SECONDS * times.MICROS), **_EVENT)
_doc("tim_7_clf", f"{_SECOND} + INTERVAL 2 HOUR", lambda: times.clf_instant(
    F.concat(_stamp("dd/MMM/yyyy:HH:mm:ss"), F.lit(" -0200"))), **_EVENT)
_doc("tim_7_ctime", _SECOND, lambda: times.ctime_instant(_stamp("EEE MMM dd HH:mm:ss yyyy")), **_EVENT)
_doc("tim_8_rpm_iso", "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.5' || CASE WHEN event_id % 2 = 0 THEN '+00:00' "
     "ELSE '+05:30' END", lambda: times.rpm_iso(F.concat(
         _stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit(",5"), F.when(c("event_id") % 2 == 0, "Z").otherwise("+0530"))), **_EVENT)
_doc("tim_9_days_to_date", "CASE WHEN n_chars % 5 > 0 THEN strftime(DATE '1970-01-01' + CAST(n_chars % 5 * 4000 AS "
     "INTEGER), '%Y-%m-%d') END", lambda: times.days_to_date((c("n_chars") % 5 * 4000).cast("string")))
_HMS = "CAST(n_chars // 60 % 60 AS VARCHAR) || 'm ' || CAST(n_chars % 60 AS VARCHAR) || 's'"
_doc("tim_10_duration", f"""CASE WHEN n_chars >= 86400 THEN CAST(n_chars // 86400 AS VARCHAR) || 'd ' ELSE '' END ||
    CASE WHEN n_chars >= 3600 THEN CAST(n_chars // 3600 % 24 AS VARCHAR) || 'h ' ELSE '' END ||
    CASE WHEN n_chars >= 60 THEN {_HMS} ELSE CAST(n_chars AS VARCHAR) || 's' END""",
     lambda: times.duration_text(c("n_chars")))
_doc("tim_10_device_duration", f"CASE WHEN n_chars >= 3600 THEN CAST(n_chars // 3600 AS VARCHAR) || 'h ' ELSE '' END || {_HMS}",
     lambda: times.device_duration_text(c("n_chars")))
_doc("tim_11_buckets", "strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%Y-%m-%dT%H')",
     lambda: F.concat_ws(" ", times.day_bucket(c("ts")), times.hour_bucket(c("ts"))), **_EVENT)
_doc("tim_12_outside_hours", "hour(ts) < 8 OR hour(ts) >= 18",
     lambda: times.outside_hours(c("ts"), *times.hour_range("08-18")), **_EVENT)

# --------------------------------------------------------- JSON and arrays

_doc("jsn_1_first_field", "CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'id' ELSE 'exe' END",
     lambda: structured.first_field(F.from_json(
         F.concat(F.lit('{"_COMM":"'), F.when(c("event_id") % 3 == 0, c("event_type")).otherwise(""),
                  F.lit('","SYSLOG_IDENTIFIER":'), F.when(c("event_id") % 3 == 1, '"id"').otherwise("null"),
                  F.lit(',"_EXE":"exe"}')), "_COMM string, SYSLOG_IDENTIFIER string, _EXE string"),
         "_COMM", "SYSLOG_IDENTIFIER", "_EXE"), **_EVENT)
_doc("jsn_2_ids", "CASE WHEN doc_id % 2 = 0 THEN '[\"' || lang || '\",\"' || source || '\"]' ELSE '[\"' || lang || '\"]' END",
     lambda: structured.ids_to_json(structured.ids_from_json(
         F.when(c("doc_id") % 2 == 0, F.concat(F.lit('["'), "source", F.lit('", "'), "lang", F.lit('"]')))
         .otherwise(c("lang")))))
_doc("arr_2_ordered_argv", "event_type || ' -u ' || CAST(user_id AS VARCHAR)",
     lambda: structured.ordered_argv(F.concat(
         F.lit('argc=3 a2="'), c("user_id").cast("string"), F.lit('" a0="'), "event_type", F.lit('" a1="-u"'))), **_EVENT)


@query("arr_3_package_list", """SELECT p_partkey, replace(p_name, ' ', '-') AS name, CAST(p_size AS VARCHAR) || '.0' AS versions FROM part
UNION ALL SELECT p_partkey, 'lib' || lower(p_type), '1, automatic' FROM part""")
def _package_list(spark, sf_dir):
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" ("), F.col("p_size").cast("string"),
                    F.lit(".0), lib"), F.lower("p_type"), F.lit(" (1, automatic)"))
    entries = read_table(spark, sf_dir, "part").select("p_partkey", F.explode(
        structured.package_entries(text)).alias("e"))
    return entries.select("p_partkey", "e.name", "e.versions")


@query("cnd_1_severity_rank", f"""WITH {MIXED_SQL} SELECT severity, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1
    WHEN 'low' THEN 2 ELSE 3 END AS rank, count(*) AS n FROM mixed GROUP BY 1, 2""")
def _rank(spark, sf_dir):
    return mixed_events(spark, sf_dir).groupBy("severity", tx.severity_rank(F.col("severity")).alias("rank")).agg(
        F.count(F.lit(1)).alias("n"))
