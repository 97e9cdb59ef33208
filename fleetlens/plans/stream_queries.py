"""Streams over the given tables, run until all waiting files are read, and what the batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.extract_queries import hosts_of
from fleetlens.plans.registry import query
from fleetlens.plans.rule_queries import FAILED
from fleetlens.plans.views import AUDIT_SQL, audit_rows, read_table
from fleetlens.session import shared_folder
from fleetlens.streaming import jobs


def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit view over a stream of the events table's files."""
    schema = read_table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return audit_rows(files.parquet(sf_dir))


def _finish(spark, rows: DataFrame) -> DataFrame:
    folder = shared_folder(spark, "stream")
    running = jobs.write_stream(rows, f"{folder}/out", f"{folder}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("str_1_incremental_ingest", """SELECT 'u' || CAST(user_id AS VARCHAR) AS actor_user, ts AS timestamp_utc,
    CASE WHEN event_type = 'error' THEN 'failed_login' ELSE 'successful_login' END AS subcategory FROM events
WHERE event_type IN ('error', 'click')""")
def _ingest(spark, sf_dir):
    folder = shared_folder(spark, "landing")
    root = f"{folder}/landing"
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00 n1 sshd[7]: "),
        F.when(F.col("event_type") == "error", "Failed password for ").otherwise("Accepted password for "), user,
        F.lit(" from 198.51.100.9 port 4 ssh2"))
    rows = read_table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "click"))
    for host in ("host-1", "host-2"):
        # Two bundles arrive one after the other; the second run reads only the new one.
        mine = rows.filter((F.col("event_type") == "error") == F.lit(host == "host-1"))
        mine.select(line.alias("value")).write.text(f"{root}/{host}/var/log/auth.log.d")
        running = jobs.ingest_stream(spark, root, root, hosts_of(spark, sf_dir), f"{folder}/store",
                                     f"{folder}/checkpoint", only=["authlog_parser"])
        running.awaitTermination()
    return spark.read.parquet(f"{folder}/store").select("actor_user", "timestamp_utc", "subcategory")


@query("str_2_deduplicated_stream", f"WITH {AUDIT_SQL} SELECT event_id, event_hash FROM audit")
def _dedupe(spark, sf_dir):
    twice = audit_stream(spark, sf_dir).unionByName(audit_stream(spark, sf_dir))
    return _finish(spark, jobs.dedupe_stream(twice).select("event_id", "event_hash"))


@query("str_3_failure_bursts", f"""WITH {AUDIT_SQL}, {FAILED},
s AS (SELECT source_ip, date_trunc('minute', timestamp_utc) - INTERVAL 1 MINUTE * k AS window_start FROM failed, range(0, 5) t(k)),
g AS (SELECT source_ip, window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS failures FROM s GROUP BY 1, 2)
SELECT * FROM g WHERE window_end <= (SELECT max(timestamp_utc) - INTERVAL 10 MINUTE FROM failed)""")
def _bursts(spark, sf_dir):
    return _finish(spark, jobs.failure_bursts(audit_stream(spark, sf_dir)))


@query("str_4_success_after_failures", f"""WITH {AUDIT_SQL}, {FAILED}
SELECT s.event_id, s.source_ip, s.timestamp_utc, count(*) AS failures FROM audit s JOIN failed p ON p.source_ip = s.source_ip
    AND p.timestamp_utc < s.timestamp_utc AND p.timestamp_utc >= s.timestamp_utc - INTERVAL 24 HOUR
WHERE s.subcategory = 'successful_login' AND NOT coalesce(s.tool_generated_flag, false) GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def _success(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    running = jobs.success_after_failures(
        audit_stream(spark, sf_dir), f"{folder}/state", f"{folder}/out", f"{folder}/checkpoint", 5, 24 * 60)
    running.awaitTermination()
    return jobs.latest_matches(spark, f"{folder}/out")


@query("str_4_any_order", f"""WITH {AUDIT_SQL}, {FAILED}
SELECT s.event_id, s.source_ip, s.timestamp_utc, count(*) AS failures FROM audit s JOIN failed p ON p.source_ip = s.source_ip
    AND p.timestamp_utc < s.timestamp_utc AND p.timestamp_utc >= s.timestamp_utc - INTERVAL 24 HOUR
WHERE s.subcategory = 'successful_login' AND NOT coalesce(s.tool_generated_flag, false) GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def _success_any_order(spark, sf_dir):
    """The logins arrive first and their failures in two later deliveries."""
    folder = shared_folder(spark, "stream")
    rows = read_table(spark, sf_dir, "events")
    kind, odd = F.col("event_type"), F.col("event_id") % 2 == 1
    for part in (kind != "error", (kind == "error") & odd, (kind == "error") & ~odd):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arriving = audit_rows(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        jobs.success_after_failures(arriving, f"{folder}/state", f"{folder}/out", f"{folder}/checkpoint", 5, 24 * 60).awaitTermination()
    return jobs.latest_matches(spark, f"{folder}/out")


@query("str_5_late_rows", "SELECT count(*) AS rows, max(ts) AS newest, CAST(0 AS BIGINT) AS dropped FROM events")
def _late(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    watched = jobs.dedupe_stream(jobs.count_late(audit_stream(spark, sf_dir), "1 HOUR"))
    running = jobs.write_stream(watched.select("event_id"), f"{folder}/out", f"{folder}/checkpoint")
    running.awaitTermination()
    seen = [p["observedMetrics"]["late"] for p in running.recentProgress if p["numInputRows"]]
    totals = spark.createDataFrame(
        [(int(s["rows"]), int(s["newest_us"])) for s in seen], "rows long, newest_us long")
    return totals.agg(F.sum("rows").alias("rows"), F.timestamp_micros(F.max("newest_us")).alias("newest"),
                      F.lit(jobs.late_rows(running)).cast("long").alias("dropped"))


@query("str_5_late_rows_kept", """WITH r AS (SELECT event_id, ts, event_id % 4 AS batch FROM events),
w AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r GROUP BY 1)
SELECT event_id, batch FROM r JOIN w USING (batch) WHERE ts < seen - INTERVAL 6 HOUR""")
def _late_kept(spark, sf_dir):
    """Events come in four deliveries that cover the same days; the stream is started anew for each."""
    folder = shared_folder(spark, "late")
    rows = read_table(spark, sf_dir, "events")
    for k in range(4):
        rows.filter(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/in").withColumn("timestamp_utc", F.col("ts").cast("timestamp"))
        jobs.keep_late_rows(arriving.select("event_id", "timestamp_utc"), folder, f"{folder}/checkpoint", 6 * 3600).awaitTermination()
    return jobs.late_table(spark, folder, "event_id bigint, timestamp_utc timestamp, batch bigint").select("event_id", "batch")
