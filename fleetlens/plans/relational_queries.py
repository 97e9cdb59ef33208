"""Search, joins, windows, aggregates, order and set operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.text import sorted_text
from fleetlens.functions.times import from_micros, micros
from fleetlens.operators import aggregates, dedupe, search
from fleetlens.operators.joins import look_along_time, salted_join, within_minutes
from fleetlens.operators.windows import chunked_scan, fifo_pairs, first_per_group, numbered, stitch_runs
from fleetlens.plans.registry import query
from fleetlens.plans.views import AUDIT_SQL, MIXED_SQL, audit_events, mixed_events, read_table
from fleetlens.reports.tables import direction
from fleetlens.rules.auth import guessing_addresses, peak_in_window
from fleetlens.rules.integrity import first_long_gaps, inversions, missing_ranges, rotation_members


def _search(name: str, where: str, **filters):
    """Ids of the events that a filter keeps."""
    query(name, f"WITH {MIXED_SQL} SELECT event_id FROM mixed WHERE {where}")(
        lambda spark, sf_dir: search.filter_events(mixed_events(spark, sf_dir), **filters).select("event_id"))


_LIKE = " OR ".join(f"{c} ILIKE '%cUrL %.7%'" for c in search.SEARCH_COLUMNS)
_search("prd_1_keyword", _LIKE, q="cUrL %.7")
_search("prd_2_category", "category = 'persistence'", category="persistence")
_search("prd_3_severity", "severity = 'high'", severity="high")
_search("prd_4_user", "actor_user IN ('u7', chr(39) || 'u7' || chr(39))", user="u7")
_search("prd_5_host", "host_id = 'host-3'", host="host-3")
_search("prd_6_time_range", "timestamp_utc BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'",
        from_ts="2024-01-05", to_ts="2024-01-06 12:00:00")


@query("prd_7_ids_of_finding", f"""WITH {MIXED_SQL},
ids AS (SELECT event_id FROM mixed WHERE subcategory = 'passwordless_account')
SELECT event_id, host_id FROM mixed WHERE event_id IN (SELECT event_id FROM ids)""")
def _ids(spark, sf_dir):
    from fleetlens.rules import REGISTRY
    from fleetlens.rules.base import finding_events
    events = mixed_events(spark, sf_dir)
    wanted = finding_events(REGISTRY["passwordless_account"].findings(events), events)
    return events.join(wanted.select("event_id"), "event_id", "left_semi").select("event_id", "host_id")


@query("prd_8_no_tool_noise",
       f"WITH {AUDIT_SQL} SELECT event_id FROM audit WHERE NOT coalesce(tool_generated_flag, false)")
def _no_noise(spark, sf_dir):
    return audit_events(spark, sf_dir).filter(search.not_tool_noise()).select("event_id")


@query("prd_10_path_contains", f"""WITH {MIXED_SQL} SELECT event_id FROM mixed
WHERE source_artifact_path ILIKE '%SYSLOG.7%'""")
def _path(spark, sf_dir):
    return mixed_events(spark, sf_dir).filter(
        search.ascii_ilike(F.col("source_artifact_path"), "SYSLOG.7")).select("event_id")


@query("prd_11_external_addresses", """SELECT doc_id, ip FROM (SELECT doc_id,
    unnest(['127.0.0.1', ':0', source, '10.0.0.' || CAST(n_chars % 9 AS VARCHAR)]) AS ip FROM documents)
WHERE ip NOT IN ('127.0.0.1', '::1', 'localhost', 'local', '', ':0.0', ':0') AND ip NOT LIKE ':%'""")
def _external(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    ips = F.array(F.lit("127.0.0.1"), F.lit(":0"), F.col("source"),
                  F.concat(F.lit("10.0.0."), (F.col("n_chars") % 9).cast("string")))
    return (docs.select("doc_id", F.explode(ips).alias("source_ip")).filter(search.external_address())
            .select("doc_id", F.col("source_ip").alias("ip")))


@query("prd_12_service_accounts", """SELECT doc_id, who FROM (SELECT doc_id, CASE WHEN n_chars % 3 = 0
    THEN 'www-data' ELSE source END AS who FROM documents) WHERE who <> 'www-data'""")
def _service(spark, sf_dir):
    from fleetlens.functions.text import strip_quotes
    from fleetlens.rules.integrity import SERVICE_ACCOUNTS
    docs = read_table(spark, sf_dir, "documents")
    quoted = F.when(F.col("n_chars") % 3 == 0, "'www-data'").otherwise(F.concat(F.lit('"'), "source", F.lit('"')))
    return (docs.select("doc_id", strip_quotes(quoted).alias("who"))
            .filter(~F.col("who").isin(*SERVICE_ACCOUNTS)))


_SEARCH = dict(q="failed", category="login_activity", severity="low", from_ts="2024-01-03", to_ts="2024-01-20")
_SEARCH_WHERE = ("category = 'login_activity' AND severity = 'low' AND timestamp_utc BETWEEN TIMESTAMP '2024-01-03' "
                 "AND TIMESTAMP '2024-01-20' AND ("
                 + " OR ".join(f"{c} ILIKE '%failed%'" for c in search.SEARCH_COLUMNS) + ")")


@query("prd_13_search_counts", f"""WITH {AUDIT_SQL}
SELECT count(*) AS total, count(*) FILTER ({_SEARCH_WHERE}) AS filtered_total,
    count(DISTINCT actor_user) FILTER (actor_user <> '') AS distinct_users FROM audit""")
def _search_counts(spark, sf_dir):
    return search.search_counts(audit_events(spark, sf_dir), **_SEARCH)


@query("prd_13_search_page", f"""WITH {AUDIT_SQL}
SELECT event_id, timestamp_utc, actor_user, severity FROM audit WHERE {_SEARCH_WHERE}
ORDER BY actor_user DESC NULLS LAST, event_hash LIMIT 40 OFFSET 20""")
def _search_page(spark, sf_dir):
    return search.search_events(
        audit_events(spark, sf_dir), sort="actor_user", order="desc", limit=40, offset=20, **_SEARCH
    ).select("event_id", "timestamp_utc", "actor_user", "severity")


@query("prd_13_distinct_users", f"WITH {AUDIT_SQL} SELECT DISTINCT actor_user FROM audit WHERE actor_user <> ''")
def _distinct_users(spark, sf_dir):
    return search.distinct_users(audit_events(spark, sf_dir))


@query("prj_1_direction", f"""WITH {MIXED_SQL} SELECT event_id, CASE WHEN subcategory = 'known_host'
    THEN 'Outbound' ELSE 'Inbound' END AS direction FROM mixed""")
def _direction(spark, sf_dir):
    return mixed_events(spark, sf_dir).select("event_id", direction().alias("direction"))


@query("prj_2_coalesce_chain", """SELECT doc_id, coalesce(nullif(CASE WHEN n_chars % 2 = 0 THEN '' ELSE source END, ''),
    nullif(CASE WHEN n_chars % 3 = 0 THEN NULL ELSE lang END, ''), 'local') AS origin FROM documents""")
def _coalesce(spark, sf_dir):
    from fleetlens.functions.text import first_filled
    n = F.col("n_chars")
    return read_table(spark, sf_dir, "documents").select("doc_id", first_filled(
        F.when(n % 2 == 0, "").otherwise(F.col("source")), F.when(n % 3 != 0, F.col("lang")), "local")
        .alias("origin"))


# ---------------------------------------------------------------- joins

@query("joi_1_events_within", f"""WITH {AUDIT_SQL}
SELECT a.event_id AS anchor_id, b.event_id AS near_id FROM audit a JOIN audit b
ON b.timestamp_utc BETWEEN a.timestamp_utc - INTERVAL 30 MINUTE AND a.timestamp_utc + INTERVAL 30 MINUTE
WHERE a.subcategory = 'account_created' AND b.subcategory = 'failed_login'""")
def _within(spark, sf_dir):
    events = audit_events(spark, sf_dir)
    anchors = events.filter(F.col("subcategory") == "account_created").select(
        F.col("event_id").alias("anchor_id"), F.col("timestamp_utc").alias("anchor_ts"))
    others = events.filter(F.col("subcategory") == "failed_login").select("event_id", "timestamp_utc")
    return within_minutes(anchors, others, 30).select("anchor_id", F.col("event_id").alias("near_id"))


_INTERVAL = """SELECT s.event_id AS login_id, count(f.event_id) AS failures, {extra} AS {name}
FROM audit s LEFT JOIN audit f ON f.subcategory = 'failed_login' AND f.source_ip = s.source_ip AND {near}
WHERE s.subcategory = '{anchor}' GROUP BY 1"""


def _look(events, anchor: str, key: str, before: str, end: str):
    at, day = F.col("at"), 24 * 3_600_000_000
    times = {"before_look_back": at - day - 1, "end_look_back": at - 1, "before_ahead": at - 1,
             "end_ahead": at + day}
    anchors = events.filter(F.col("subcategory") == anchor).select(
        F.col("event_id").alias("login_id"), key, micros(F.col("timestamp_utc")).alias("at"))
    items = events.filter(F.col("subcategory") == "failed_login")
    return look_along_time(
        anchors, items, anchor_id="login_id", keys=[key], instants={"before": times[before], "end": times[end]},
        item_time=micros(F.col("timestamp_utc")), sums={"n": F.lit(1)}, item=F.col("event_id"))


@query("joi_2_look_back_interval", f"WITH {AUDIT_SQL} " + _INTERVAL.format(
    extra="min(f.timestamp_utc)", name="first_failure", anchor="successful_login",
    near="f.timestamp_utc >= s.timestamp_utc - INTERVAL 24 HOUR AND f.timestamp_utc < s.timestamp_utc"))
def _look_back(spark, sf_dir):
    looked = _look(audit_events(spark, sf_dir), "successful_login", "source_ip", "before_look_back",
                   "end_look_back")
    n = F.col("end.n") - F.col("before.n")
    return looked.select("login_id", n.alias("failures"),
                         F.when(n > 0, from_micros(F.col("before.next.at"))).alias("first_failure"))


@query("joi_3_forward_interval", f"WITH {AUDIT_SQL} " + _INTERVAL.format(
    extra="max(f.timestamp_utc)", name="last_failure", anchor="account_created",
    near="f.timestamp_utc >= s.timestamp_utc AND f.timestamp_utc <= s.timestamp_utc + INTERVAL 24 HOUR"))
def _forward(spark, sf_dir):
    looked = _look(audit_events(spark, sf_dir), "account_created", "source_ip", "before_ahead", "end_ahead")
    n = F.col("end.n") - F.col("before.n")
    return looked.select("login_id", n.alias("failures"),
                         F.when(n > 0, from_micros(F.col("end.last.at"))).alias("last_failure"))


@query("joi_4_semi_join_on_aggregate", f"""WITH {AUDIT_SQL}
SELECT event_id FROM audit WHERE subcategory = 'successful_login' AND source_ip IN (SELECT source_ip FROM audit
    WHERE subcategory IN ('failed_login', 'invalid_user') GROUP BY 1 HAVING count(*) >= 80)""")
def _semi(spark, sf_dir):
    events = audit_events(spark, sf_dir)
    logins = events.filter(F.col("subcategory") == "successful_login").select("event_id", "source_ip")
    return salted_join(logins, guessing_addresses(events, 80), ["source_ip"], "left_semi").select("event_id")


@query("joi_5_anti_join", f"""WITH {MIXED_SQL}
SELECT DISTINCT actor_user FROM mixed WHERE category = 'login_activity' AND actor_user NOT IN
    (SELECT actor_user FROM mixed WHERE subcategory IN ('shell_command', 'suspicious_command'))""")
def _anti(spark, sf_dir):
    events = mixed_events(spark, sf_dir)
    typed = events.filter(F.col("subcategory").isin("shell_command", "suspicious_command"))
    return dedupe.difference(events.filter(F.col("category") == "login_activity"), typed,
                             ["actor_user"]).select("actor_user").distinct()


@query("joi_9_dimension_lookup", """SELECT e.event_id, c.c_name AS user_name FROM events e
LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def _lookup(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("uid"))
    people = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"),
                                                         F.col("c_name").alias("user_name"))
    return salted_join(events, people, ["uid"], "left", salts=4).select("event_id", "user_name")


@query("joi_11_equi_join", """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def _equi(spark, sf_dir):
    orders, people = (read_table(spark, sf_dir, t) for t in ("orders", "customer"))
    return orders.join(people, orders.o_custkey == people.c_custkey).select("o_orderkey", "c_name")


@query("joi_12_first_earlier_login", f"""WITH {AUDIT_SQL}
SELECT c.event_id AS change_id, arg_min(l.event_id, (l.timestamp_utc, l.event_hash)) AS login_id
FROM audit c JOIN audit l ON l.subcategory = 'successful_login' AND l.host_id = c.host_id
AND l.timestamp_utc BETWEEN c.timestamp_utc - INTERVAL 60 MINUTE AND c.timestamp_utc
WHERE c.subcategory = 'group_membership_added' GROUP BY 1""")
def _earlier(spark, sf_dir):
    events, at = audit_events(spark, sf_dir), F.col("at")
    changes = events.filter(F.col("subcategory") == "group_membership_added").select(
        F.col("event_id").alias("change_id"), "host_id", micros(F.col("timestamp_utc")).alias("at"))
    logins = events.filter(F.col("subcategory") == "successful_login")
    looked = look_along_time(
        changes, logins, anchor_id="change_id", keys=["host_id"],
        instants={"before": at - 3_600_000_000 - 1}, item_time=micros(F.col("timestamp_utc")),
        sums={"n": F.lit(1)}, item=F.col("event_id"))
    return looked.filter(F.col("before.next.at") <= at).select(
        "change_id", F.col("before.next.item").alias("login_id"))


# ---------------------------------------------------------------- aggregates

@query("agg_1_counts", f"""WITH {MIXED_SQL} SELECT count(*) AS events, count(*) FILTER (severity = 'high') AS high
FROM mixed""")
def _counts(spark, sf_dir):
    return mixed_events(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("severity") == "high").alias("high"))


@query("agg_2_span", "SELECT min(ts) AS lo, max(ts) AS hi FROM events")
def _span(spark, sf_dir):
    return read_table(spark, sf_dir, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query("agg_3_category_counts", f"WITH {MIXED_SQL} SELECT category, count(*) AS n FROM mixed GROUP BY 1")
def _category(spark, sf_dir):
    from fleetlens.reports.summary import category_counts
    return category_counts(mixed_events(spark, sf_dir))


@query("agg_4_counts_and_span", f"""WITH {AUDIT_SQL} SELECT host_id, actor_user, count(*) AS attempt_count,
    min(timestamp_utc) AS first_attempt, max(timestamp_utc) AS last_attempt FROM audit GROUP BY 1, 2""")
def _keys(spark, sf_dir):
    return aggregates.counts_and_span(audit_events(spark, sf_dir), ["host_id", "actor_user"])


@query("agg_5_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def _having(spark, sf_dir):
    return aggregates.at_least(read_table(spark, sf_dir, "orders"), ["o_custkey"], 12)


@query("agg_6_distinct_text", """SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities,
    string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1""")
def _distinct_text(spark, sf_dir):
    return aggregates.distinct_text(read_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority",
                                    "priorities")


@query("agg_7_distinct", "SELECT DISTINCT lang, source FROM documents")
def _distinct(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("agg_8_severity_counts", f"""WITH {AUDIT_SQL} SELECT host_id, count(*) FILTER (severity = 'high') AS high,
    count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
    count(*) FILTER (severity = 'info') AS info FROM audit GROUP BY 1""")
def _severity(spark, sf_dir):
    return aggregates.severity_counts(audit_events(spark, sf_dir), ["host_id"])


@query("agg_9_time_buckets", """SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1""")
def _buckets(spark, sf_dir):
    return (read_table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("agg_10_ordered_members", """SELECT conv_id, count(*) AS members,
    string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def _members(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    return aggregates.ordered_members(turns, ["conv_id"], ["turn"], "role").select(
        "conv_id", "members", F.array_join("ordered", ">").alias("roles"))


@query("agg_11_representative", f"""WITH {AUDIT_SQL} SELECT source_ip, arg_min(event_id, (timestamp_utc, event_hash))
    AS event_id, arg_min(host_id, (timestamp_utc, event_hash)) AS host_id FROM audit GROUP BY 1""")
def _first_row(spark, sf_dir):
    return first_per_group(audit_events(spark, sf_dir), ["source_ip"], [F.col("timestamp_utc"), F.col("event_hash")],
                           ["event_id", "host_id"])


@query("agg_12_pinned_column", """SELECT o_custkey, min(o_totalprice) AS low,
    arg_min(o_orderpriority, (o_totalprice, o_orderkey)) AS priority FROM orders GROUP BY 1""")
def _pinned(spark, sf_dir):
    return aggregates.representative(
        read_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_totalprice", "o_orderpriority"],
        ["o_totalprice", "o_orderkey"]).select(
        "o_custkey", F.col("o_totalprice").alias("low"), F.col("o_orderpriority").alias("priority"))


@query("agg_13_outcomes_per_parser", f"""WITH {MIXED_SQL} SELECT category AS parser,
    count(*) FILTER (severity <> 'high') AS success, count(*) FILTER (severity = 'high') AS fail, count(*) AS events
FROM mixed GROUP BY 1""")
def _outcomes(spark, sf_dir):
    return mixed_events(spark, sf_dir).groupBy(F.col("category").alias("parser")).agg(
        F.count_if(F.col("severity") != "high").alias("success"),
        F.count_if(F.col("severity") == "high").alias("fail"), F.count(F.lit(1)).alias("events"))


# ---------------------------------------------------------------- ordered scans

@query("win_1_peak_in_window", f"""WITH {AUDIT_SQL}
SELECT source_ip, max(n) AS peak FROM (SELECT a.source_ip, a.event_id, count(*) AS n FROM audit a JOIN audit b
    ON a.source_ip = b.source_ip AND b.timestamp_utc BETWEEN a.timestamp_utc - INTERVAL 6 HOUR AND a.timestamp_utc
    GROUP BY 1, 2) GROUP BY 1""")
def _peak(spark, sf_dir):
    return peak_in_window(audit_events(spark, sf_dir), "source_ip", 360)


@query("win_2_first_long_gap", f"""WITH {AUDIT_SQL},
p AS (SELECT actor_user, timestamp_utc, event_id, event_hash, lag(timestamp_utc) OVER w AS pt, lag(event_id) OVER w
    AS pid FROM audit WINDOW w AS (PARTITION BY actor_user ORDER BY timestamp_utc, event_hash)),
s AS (SELECT actor_user, count(*) AS n FROM audit GROUP BY 1 HAVING count(*) >= 40)
SELECT p.actor_user, s.n, epoch_us(pt) AS from_us, epoch_us(timestamp_utc) AS to_us, pid AS from_id, event_id AS to_id
FROM p JOIN s ON s.actor_user = p.actor_user WHERE timestamp_utc - pt >= INTERVAL 48 HOUR
QUALIFY row_number() OVER (PARTITION BY p.actor_user ORDER BY timestamp_utc, event_hash) = 1""")
def _gap(spark, sf_dir):
    return first_long_gaps(audit_events(spark, sf_dir), ["actor_user"], 48, 40, 0.0).drop("span_hours")


@query("win_3_inversions", f"""WITH {MIXED_SQL},
p AS (SELECT host_id, timestamp_utc, raw_line_offset, lag(timestamp_utc) OVER (PARTITION BY host_id
    ORDER BY raw_line_offset, event_hash) AS pt FROM mixed WHERE timestamp_utc IS NOT NULL)
SELECT host_id, count(*) AS inversions, min(raw_line_offset) AS first_offset FROM p WHERE timestamp_utc < pt
GROUP BY 1""")
def _inversions(spark, sf_dir):
    return inversions(mixed_events(spark, sf_dir), ["host_id"]).select(
        "host_id", "inversions", F.col("bad.raw_line_offset").alias("first_offset"))


@query("win_4_sequence_gaps", """WITH s AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view'
    THEN event_id END AS seq FROM events),
p AS (SELECT *, last_value(seq IGNORE NULLS) OVER (PARTITION BY user_id % 8 ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT event_id, before + 1 AS expected, seq - before - 1 AS gap FROM p WHERE seq > before + 40""")
def _sequence(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("stream"), "event_id",
        F.when(F.col("event_type") != "view", F.col("event_id")).alias("seq"))
    scanned = chunked_scan(rows, ["stream"], F.col("event_id"), width=500,
                           carried_before={"before": F.col("seq")})
    return scanned.filter(F.col("seq") > F.col("before") + 40).select(
        "event_id", (F.col("before") + 1).alias("expected"), (F.col("seq") - F.col("before") - 1).alias("gap"))


@query("win_5_first_seen", """WITH span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
f AS (SELECT user_id, event_type, epoch_us(min(ts)) AS first_us FROM events GROUP BY 1, 2)
SELECT user_id, event_type, first_us FROM f, span WHERE first_us >= lo + (hi - lo) * 0.1""")
def _first(spark, sf_dir):
    from fleetlens.operators.joins import with_scalar
    events = read_table(spark, sf_dir, "events").withColumn("at", micros(F.col("ts")))
    span = events.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    firsts = events.groupBy("user_id", "event_type").agg(F.min("at").alias("first_us"))
    return with_scalar(firsts, span).filter(
        F.col("first_us") >= F.col("lo") + (F.col("hi") - F.col("lo")) * 0.1).drop("lo", "hi")


@query("win_6_fifo_pairs", """WITH r AS (SELECT *, event_type = 'click' AS opens FROM events
    WHERE event_type IN ('click', 'view')),
b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER w AS bal, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS n_open,
    sum(CASE WHEN opens THEN 0 ELSE 1 END) OVER w AS n_close FROM r
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, opens DESC, event_id)),
c AS (SELECT *, least(0, min(bal) OVER w) AS low, coalesce(least(0, min(bal) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING)), 0) AS before FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, opens DESC, event_id))
SELECT event_id, user_id, CAST(CASE WHEN opens THEN n_open WHEN low = before THEN n_close + low END AS BIGINT) AS pair_no
FROM c""")
def _fifo(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view")).select(
        "event_id", "user_id", "event_type", "ts")
    return fifo_pairs(rows, ["user_id"], micros(F.col("ts")), F.col("event_type") == "click", ["event_id"]
                      ).select("event_id", "user_id", "pair_no")


@query("win_7_running_offset", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - strlen(line) - 1
    AS BIGINT) AS byte_offset FROM l""")
def _offsets(spark, sf_dir):
    from fleetlens.sources.lines import lines_of_texts
    docs = read_table(spark, sf_dir, "documents")
    lines = lines_of_texts(docs.select(F.col("doc_id").cast("string").alias("host_id"),
                                       F.lit("text").alias("artifact_path"), "text"))
    return lines.select(F.col("host_id").cast("long").alias("doc_id"), "line_no", "byte_offset")


@query("win_8_carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn) AS last_user_turn FROM conversations""")
def _carry(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return chunked_scan(turns, ["conv_id"], F.col("turn"), width=3, carried={
        "last_user_turn": F.when(F.col("role") == "user", F.col("turn"))}).drop("role")


@query("win_9_stitched_runs", """WITH p AS (SELECT event_id, user_id % 8 AS stream, event_type, CASE WHEN event_type
    IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id % 8 ORDER BY event_id) THEN 1 ELSE 0 END AS starts
    FROM events),
r AS (SELECT *, sum(starts) OVER (PARTITION BY stream ORDER BY event_id) AS run_id FROM p)
SELECT stream, CAST(run_id AS BIGINT) AS run_id, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def _runs(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("stream"),
                                                      "event_type")
    return (stitch_runs(rows, ["stream"], "event_id", "event_type", width=1000)
            .groupBy("stream", "run_id").agg(F.any_value("event_type").alias("event_type"),
                                             F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- order and limits

@query("lim_1_newest", """SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey
LIMIT 500""")
def _newest(spark, sf_dir):
    return (read_table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey")
            .limit(500).select("o_orderkey", "o_orderdate"))


@query("lim_2_page", f"""WITH {MIXED_SQL} SELECT event_id, timestamp_utc FROM mixed
ORDER BY timestamp_utc ASC NULLS FIRST, event_hash LIMIT 100 OFFSET 850""")
def _page(spark, sf_dir):
    return search.page(mixed_events(spark, sf_dir), limit="100", offset="850").select("event_id", "timestamp_utc")


@query("lim_2_deep_page", f"""WITH {MIXED_SQL} SELECT event_id, timestamp_utc FROM mixed
ORDER BY timestamp_utc DESC NULLS LAST, event_hash LIMIT 100 OFFSET 5000""")
def _deep_page(spark, sf_dir):
    return search.page(mixed_events(spark, sf_dir), order="desc", limit=100, offset=5000, deep_offset=1000).select(
        "event_id", "timestamp_utc")


@query("lim_3_canonical_order", f"""WITH {MIXED_SQL} SELECT event_id, row_number() OVER (ORDER BY timestamp_utc
    NULLS LAST, category, event_hash) AS position FROM mixed""")
def _canonical(spark, sf_dir):
    from fleetlens.sinks.exports import canonical_order
    return numbered(mixed_events(spark, sf_dir), canonical_order(), "position").select("event_id", "position")


@query("lim_4_top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _top(spark, sf_dir):
    return (read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "user_id").limit(10))


# ---------------------------------------------------------------- sets

@query("set_1_union", """SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS id FROM events
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents""")
def _union(spark, sf_dir):
    part = lambda t, kind, c: read_table(spark, sf_dir, t).select(
        F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    return part("events", "event", "event_id").unionByName(part("documents", "document", "doc_id"))


@query("set_2_both_differences", """WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type NOT IN ('click', 'view'))
SELECT user_id, day, 'left' AS side FROM a ANTI JOIN b USING (user_id, day)
UNION ALL SELECT user_id, day, 'right' FROM b ANTI JOIN a USING (user_id, day)""")
def _differences(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    looking = F.col("event_type").isin("click", "view")
    return dedupe.both_differences(events.filter(looking), events.filter(~looking), ["user_id", "day"])


@query("set_3_dedupe", """SELECT sha256(text) AS event_hash, min(doc_id) AS kept FROM documents GROUP BY 1""")
def _dedupe(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("event_hash"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("parser_name"),
        F.lit("1").alias("parser_version"))
    return dedupe.dedupe_events(docs).select("event_hash", F.col("parser_name").cast("long").alias("kept"))


@query("set_4_missing_numbers", """WITH n AS (SELECT DISTINCT user_id % 8 AS stream, event_id // 40 + 1 AS number FROM events),
m AS (SELECT stream, max(number) AS hi FROM n GROUP BY 1),
r AS (SELECT stream, unnest(range(1, hi + 1)) AS number FROM m)
SELECT stream, count(*) AS missing, min(number) AS first_missing FROM r WHERE NOT EXISTS
    (SELECT 1 FROM n WHERE n.stream = r.stream AND n.number = r.number) GROUP BY 1""")
def _missing(spark, sf_dir):
    numbers = read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("stream"), (F.floor(F.col("event_id") / 40) + 1).alias("number"))
    return missing_ranges(numbers, "stream", "number").groupBy("stream").agg(
        F.sum(F.col("gap_to") - F.col("gap_from") + 1).alias("missing"), F.min("gap_from").alias("first_missing"))


@query("set_5_timed_and_untimed", f"""WITH {MIXED_SQL} SELECT event_id, timestamp_utc IS NOT NULL AS dated FROM mixed
WHERE subcategory IN ('authorized_key', 'systemd_unit')""")
def _timed(spark, sf_dir):
    rows = mixed_events(spark, sf_dir).filter(F.col("subcategory").isin("authorized_key", "systemd_unit"))
    timed = rows.filter(F.col("timestamp_utc").isNotNull()).select("event_id", F.lit(True).alias("dated"))
    return timed.unionByName(rows.filter(F.col("timestamp_utc").isNull()).select(
        "event_id", F.lit(False).alias("dated")))


@query("arr_1_sorted_distinct", """SELECT conv_id, string_agg(DISTINCT role, ', ' ORDER BY role) AS roles
FROM conversations GROUP BY 1""")
def _sorted(spark, sf_dir):
    # Roles are a closed vocabulary, so the set per conversation is small.
    return (read_table(spark, sf_dir, "conversations").groupBy("conv_id")
            .agg(sorted_text(F.collect_set("role")).alias("roles")))
