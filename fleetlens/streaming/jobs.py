"""Continuous arrival of evidence with Structured Streaming.

Each job has a batch twin: the stream over a set of files ends with the rows the batch gives for them.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.extract import extract_all
from fleetlens.functions.times import micros
from fleetlens.operators.joins import MINUTE_MICROS, look_along_time, salted_join
from fleetlens.operators.search import not_tool_noise
from fleetlens.rules.base import FAILURES
from fleetlens.sinks.exports import append_events
from fleetlens.session import remove_path
from fleetlens.sources.lines import place_lines, scan_lines


def ingest_stream(spark: SparkSession, landing: str, root: str, hosts: DataFrame, store: str, checkpoint: str,
                  case_id: str = "case", only: list[str] | None = None) -> StreamingQuery:
    """Read new log files of a landing folder, extract their events and add them to the store.

    A file is read whole in one micro-batch, so offsets are right.  A batch that is run again after a
    failure adds nothing twice, because the store drops hashes it has.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        append_events(extract_all(place_lines(batch, root), hosts, case_id, only), store)

    lines = scan_lines(spark.readStream.option("recursiveFileLookup", "true"), landing)
    return (lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def dedupe_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First event of every hash; a hash is remembered until the watermark has passed it."""
    return events.withWatermark("timestamp_utc", delay).dropDuplicatesWithinWatermark(["event_hash"])


def failure_bursts(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                   delay: str = "10 minutes") -> DataFrame:
    """Failures per address and sliding window.

    Windows start on full slides, so this approximates the exact trailing window of the batch rule.  Map
    tasks pre-aggregate, so a hot address reaches its state as one row per task and window.
    """
    failures = events.filter(F.col("subcategory").isin(*FAILURES) & F.col("source_ip").isNotNull()
                             & not_tool_noise())
    return (failures.withWatermark("timestamp_utc", delay)
            .groupBy(F.window("timestamp_utc", window, slide).alias("w"), "source_ip")
            .agg(F.count(F.lit(1)).alias("failures"))
            .select("source_ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "failures"))


def success_after_failures(events: DataFrame, state: str, out: str, checkpoint: str, min_failures: int = 5,
                           look_back_minutes: float = 15, keep_days: int | None = None) -> StreamingQuery:
    """Logins with many failures of their address just before, written to ``out`` as they and their failures arrive.

    Failures and logins are kept in ``state`` by day.  A micro-batch judges its own logins, and again those kept ones that
    its failures lie just before, so the order of arrival does not matter: :func:`latest_matches` has the last word on each
    login.  It reads back the days these can look at and counts with the batch operator along time, so no pairs of login and
    failure are held as state, whatever an address does.  Batch folders are overwritten, so a repeated batch changes nothing.
    Days more than ``keep_days`` before the newest event are dropped; what comes later than that is judged without them.
    """
    spark = events.sparkSession
    width = int(look_back_minutes * MINUTE_MICROS)
    login = F.col("subcategory") == "successful_login"
    reach = F.expr(f"INTERVAL {int(look_back_minutes * 60)} SECONDS")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("day", F.to_date("timestamp_utc"))
        (rows.withColumn("batch", F.lit(batch_id)).withColumn("kind", F.when(login, "login").otherwise("failure"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "day", "batch").parquet(state))
        whole = rows.withColumns({"batch": F.lit(0), "kind": F.lit("")}).schema
        kept = spark.read.schema(whole).parquet(state)
        mine = kept.filter(F.col("batch") == batch_id)
        span = mine.agg(F.min("timestamp_utc").alias("lo"), F.max("timestamp_utc").alias("hi")).first()
        columns = ("event_id", "source_ip", "timestamp_utc")
        if span["lo"] is None:
            found = rows.filter(F.lit(False)).select(*columns, F.lit(0).cast("long").alias("failures"))
        else:
            # The day folders are pruned to those that the batch's rows can be paired with.
            near = kept.filter(F.col("day").between(F.to_date(F.lit(span["lo"]) - reach), F.to_date(F.lit(span["hi"]) + reach)))
            logins, failures = near.filter(F.col("kind") == "login"), near.filter(F.col("kind") == "failure")
            step = lambda at: F.floor(at / F.lit(width))
            # A failure can tell on logins of its own step of time and the next.
            touched = mine.filter(F.col("kind") == "failure").select(
                "source_ip", F.explode(F.array(step(micros(F.col("timestamp_utc"))), step(micros(F.col("timestamp_utc"))) + 1)).alias("step")).distinct()
            older = salted_join(logins.filter(F.col("batch") != batch_id).withColumn("step", step(micros(F.col("timestamp_utc")))),
                                touched, ["source_ip", "step"], "left_semi").drop("step")
            judged = logins.filter(F.col("batch") == batch_id).unionByName(older)
            at = F.col("at")
            looked = look_along_time(
                judged.select(*columns, micros(F.col("timestamp_utc")).alias("at")),
                failures, anchor_id="event_id", keys=["source_ip"], instants={"before": at - width - 1, "end": at - 1},
                item_time=micros(F.col("timestamp_utc")), sums={"n": F.lit(1)})
            found = (looked.withColumn("failures", F.col("end.n") - F.col("before.n"))
                     .filter(F.col("failures") >= min_failures).select(*columns, "failures"))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if keep_days is not None and span["hi"] is not None:
            drop_days(spark, state, span["hi"].date() - timedelta(days=keep_days))

    wanted = events.filter(F.col("subcategory").isin(*FAILURES, "successful_login") & F.col("source_ip").isNotNull()
                           & F.col("timestamp_utc").isNotNull() & not_tool_noise())
    return (wanted.select("event_id", "event_hash", "source_ip", "subcategory", "timestamp_utc").writeStream
            .foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_matches(spark: SparkSession, out: str) -> DataFrame:
    """Per login its last count of failures, of all batches that judged it."""
    rows = spark.read.option("basePath", out).parquet(out)
    last = F.max_by(F.struct("source_ip", "timestamp_utc", "failures"), "batch").alias("last")
    return rows.groupBy("event_id").agg(last).select("event_id", "last.*")


def drop_days(spark: SparkSession, state: str, before: date) -> None:
    """Remove the day folders of both kinds that end before a day."""
    for kind in ("login", "failure"):
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/kind={kind}")
        files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []:
            if name.startswith("day=") and name.removeprefix("day=") < before.isoformat():
                remove_path(spark, f"{state}/kind={kind}/{name}")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to Parquet until the waiting files are read."""
    return (rows.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their watermark and were left out by the stateful operators of a query."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for op in progress["stateOperators"])


def count_late(events: DataFrame, delay: str, name: str = "late") -> DataFrame:
    """Observe the time span of every micro-batch against the watermark delay.

    The numbers are in ``progress["observedMetrics"]`` of the query: rows, newest and oldest time, and the
    time before which rows count as late.
    """
    newest = F.unix_micros(F.max("timestamp_utc"))
    return events.observe(name, F.count(F.lit(1)).alias("rows"), newest.alias("newest_us"),
                          F.unix_micros(F.min("timestamp_utc")).alias("oldest_us"),
                          F.unix_micros(F.expr(f"max(timestamp_utc) - INTERVAL {delay}")).alias("late_before_us"))


MARK = "batch bigint, rows bigint, late bigint, newest_us bigint, late_before_us bigint"


def keep_late_rows(events: DataFrame, folder: str, checkpoint: str, delay_seconds: int) -> StreamingQuery:
    """Put rows that come behind their watermark aside, in ``folder/late``, and keep account of every batch in ``folder/marks``.

    The watermark of a batch is the newest time of all batches before it less the delay.  It is kept with the batches, one row
    each that carries the newest time so far, so it outlives restarts and does not depend on progress records.  A batch that is
    run again overwrites its own rows and mark.  Undated rows are counted but never late.
    """
    spark = events.sparkSession
    delay = delay_seconds * 1_000_000

    def newest_before(batch_id: int) -> int | None:
        done = [b for b in stored_batches(spark, f"{folder}/marks") if b < batch_id]
        if not done:
            return None
        return spark.read.schema(MARK).parquet(f"{folder}/marks/batch={max(done)}").first()["newest_us"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = newest_before(batch_id)
        limit = None if before is None else before - delay
        at = micros(F.col("timestamp_utc"))
        late = F.coalesce(at < F.lit(limit).cast("long"), F.lit(False))
        batch.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"), F.max(at).alias("newest")).select(
            F.lit(batch_id).cast("long").alias("batch"), "rows", "late",
            F.greatest(F.col("newest"), F.lit(before).cast("long")).alias("newest_us"),
            F.lit(limit).cast("long").alias("late_before_us")).write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``batch=`` folders below a path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(found):
        return []
    names = [s.getPath().getName() for s in files.listStatus(found)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def late_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows that :func:`keep_late_rows` has put aside, with their batch."""
    return spark.read.schema(schema).option("basePath", f"{folder}/late").parquet(f"{folder}/late")
