"""Writing events, findings and canonical exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.structured import ids_to_json
from fleetlens.functions.times import export_instant
from fleetlens.operators.dedupe import dedupe_events
from fleetlens.rules.base import finding_errors, with_event_ids
from fleetlens.schema import (
    CATEGORIES, EVENT_COLUMNS, EVENT_KINDS, EVENT_SCHEMA, RAW_LINE_MAX_BYTES, REQUIRED_TEXT, SEVERITIES,
    TIMESTAMP_CONFIDENCES, TZ_SOURCES,
)
from fleetlens.session import remove_path, shared_folder
from fleetlens.sources.manifests import existing_paths


def canonical_order() -> list[Column]:
    """Dated events first, then category and hash: a total order that does not depend on arrival."""
    return [F.col("timestamp_utc").asc_nulls_last(), F.col("category"), F.col("event_hash")]


def event_errors() -> Column:
    """Problems of an event as an array of texts; empty for a valid one."""
    allowed = {"event_kind": EVENT_KINDS, "tz_source": TZ_SOURCES,
               "timestamp_confidence": TIMESTAMP_CONFIDENCES, "severity": SEVERITIES, "category": CATEGORIES}
    checks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c}: missing")) for c in REQUIRED_TEXT]
    checks += [F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.lit(f"{c}: unknown word"))
               for c, values in allowed.items()]
    checks += [
        F.when((F.col("event_kind") == "event") & F.col("timestamp_utc").isNull()
               & (F.col("timestamp_confidence") != "unknown"), F.lit("timestamp_utc: missing but not unknown")),
        F.when(F.coalesce(F.col("raw_line_offset") < 0, F.lit(True)), F.lit("raw_line_offset: invalid")),
        F.when(F.col("tool_generated_flag").isNull(), F.lit("tool_generated_flag: missing")),
        F.when(F.octet_length("raw_line") > RAW_LINE_MAX_BYTES, F.lit("raw_line: too long")),
        F.when(~F.coalesce(F.col("event_hash").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)),
               F.lit("event_hash: not a sha256")),
    ]
    return F.array_compact(F.array(*checks))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected events with their ``errors``)."""
    checked = events.withColumn("errors", event_errors())
    return (checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0))


#: The store as it is on disk: without a schema, folder names such as host_id=007 would be read as numbers.
STORE_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.StringType())])
#: Events of one host and day that go to one file.
FILE_EVENTS = 1_000_000


#: Hashes that are few enough to be sent to every task: about 100 bytes each.
BROADCAST_HASHES = 200_000


def new_rows(checked: DataFrame, hashes: DataFrame, count: Row) -> DataFrame:
    """One row per hash that is not ``known``; ``count`` has how many hashes are new, known, and new but there ``twice``.

    Whole rows are shuffled by hash only where neither the hashes to leave out nor those to keep are few.
    """
    of = lambda which: hashes.filter(which).select("event_hash")
    known, twice = F.col("known"), ~F.col("known") & F.col("twice")
    if not count["new"]:
        return checked.limit(0)
    if count["known"] + count["twice"] <= BROADCAST_HASHES:
        rest = checked.join(F.broadcast(of(known | twice)), "event_hash", "left_anti")
        if not count["twice"]:
            return rest
        return rest.unionByName(dedupe_events(checked.join(F.broadcast(of(twice)), "event_hash", "left_semi")))
    wanted = of(~known)
    if count["new"] <= BROADCAST_HASHES:
        wanted = F.broadcast(wanted)
    return dedupe_events(checked.join(wanted, "event_hash", "left_semi") if count["known"] else checked)


def append_events(events: DataFrame, path: str) -> dict[str, int]:
    """Add valid, new events to the Parquet store; gives inserted, deduped and invalid counts.

    Extraction is the dear part, so its result is written once to the shared folder; counts and the
    deduplicated append read that copy.  The store is partitioned by host and day; a host-day gets as many files as its
    events fill.  An event's hash covers its host, so only the folders of the batch's hosts are asked for known hashes.
    The inserted rows are this batch's own, whoever else writes.
    """
    spark = events.sparkSession
    staged = shared_folder(spark, "batch")
    events.withColumn("errors", event_errors()).write.parquet(staged)
    batch = spark.read.parquet(staged)
    bad = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("invalid")).first()
    checked = batch.filter(F.size("errors") == 0).select(*EVENT_COLUMNS).withColumn(
        "event_date", F.coalesce(F.to_date("timestamp_utc").cast("string"), F.lit("undated")))
    # One narrow row per hash decides what is new and what comes twice; it is settled before rows are published, so that the
    # count is that of this batch, whoever else writes.
    hashes = checked.groupBy("event_hash").agg((F.count(F.lit(1)) > 1).alias("twice"))
    if existing_paths(spark, [path]):
        stored = spark.read.schema(STORE_SCHEMA).parquet(path)
        known = stored.join(checked.select("host_id").distinct(), "host_id", "left_semi").select(
            "event_hash", F.lit(True).alias("known")).distinct()
        hashes = hashes.join(known, "event_hash", "left")
    else:
        hashes = hashes.withColumn("known", F.lit(False))
    settled = shared_folder(spark, "hashes")
    hashes.withColumn("known", F.coalesce("known", F.lit(False))).write.parquet(settled)
    hashes = spark.read.schema("event_hash string, twice boolean, known boolean").parquet(settled)
    count = hashes.agg(F.count_if(~F.col("known")).alias("new"), F.count_if(F.col("known")).alias("known"),
                       F.count_if(~F.col("known") & F.col("twice")).alias("twice")).first()
    new, inserted = new_rows(checked, hashes, count), count["new"]
    days = checked.groupBy("host_id", "event_date").agg(F.ceil(F.count(F.lit(1)) / FILE_EVENTS).alias("__files"))
    if inserted or not existing_paths(spark, [path]):
        (new.join(days, ["host_id", "event_date"])
         .repartition("host_id", "event_date", F.pmod(F.xxhash64("event_hash"), F.col("__files")))
         .select(*STORE_SCHEMA.fieldNames())
         .write.mode("append").partitionBy("host_id", "event_date").parquet(path))
    remove_path(spark, settled)
    remove_path(spark, staged)
    return {"inserted": inserted, "deduped": bad["rows"] - bad["invalid"] - inserted, "invalid": bad["invalid"]}


def read_events(spark, path: str) -> DataFrame:
    """The event store; filters on host_id and event_date prune its folders."""
    return spark.read.schema(STORE_SCHEMA).parquet(path).select(*EVENT_COLUMNS)


def _export_values(events: DataFrame) -> list[Column]:
    """Columns as export texts: instants in ISO form with all six digits, everything else as it is."""
    shown = {"timestamp_utc": export_instant(F.col("timestamp_utc")),
             "timestamp_local": F.date_format("timestamp_local", "yyyy-MM-dd'T'HH:mm:ss")}
    return [shown.get(c, F.col(c)).alias(c) for c in events.columns]


def json_rows(events: DataFrame) -> DataFrame:
    """Events as JSON text with keys in alphabetical order and nulls kept."""
    rows = events.select(*sorted(EVENT_COLUMNS))
    return rows.select("timestamp_utc", "category", "event_hash", F.to_json(
        F.struct(*_export_values(rows)), {"ignoreNullFields": "false"}).alias("json"))


def export_json(events: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write JSON lines in canonical order; part files follow each other in that order."""
    rows = json_rows(events)
    ordered = rows.repartitionByRange(partitions, *canonical_order()) if partitions else \
        rows.repartitionByRange(*canonical_order())
    ordered.sortWithinPartitions(*canonical_order()).select("json").write.mode("overwrite").text(path)


def export_csv_per_category(events: DataFrame, path: str) -> None:
    """One folder of CSV files per category, in canonical order.

    Range partitioning by category and order splits a large category over many files.
    """
    rows = events.select(*EVENT_COLUMNS)
    shown = rows.select(*_export_values(rows), F.col("category").alias("category_folder"),
                        F.col("timestamp_utc").alias("__ts"))
    order = [F.col("category_folder"), F.col("__ts").asc_nulls_last(), F.col("event_hash")]
    (shown.repartitionByRange(*order).sortWithinPartitions(*order).drop("__ts")
     .write.mode("overwrite").partitionBy("category_folder")
     .csv(path, header=True, nullValue="", emptyValue=""))


def content_digest(events: DataFrame) -> DataFrame:
    """One row that identifies the exported content: rows, and order-free sums of row digests.

    Two stores with the same events give the same values however they are partitioned.  Four 32-bit slices
    of the sha256 of each row are summed, so that a changed, missing or doubled row shows.
    """
    digest = F.sha2("json", 256)
    lanes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    total = json_rows(events).agg(F.count(F.lit(1)).alias("rows"), *[
        F.sum(lane).alias(f"lane_{i}") for i, lane in enumerate(lanes)])
    return total.select("rows", F.sha2(F.concat_ws(
        ":", F.col("rows").cast("string"), *[F.col(f"lane_{i}").cast("string") for i in range(4)]), 256)
        .alias("digest"))


def write_findings(findings: DataFrame, path: str, case_id: str) -> None:
    """Replace the findings of one case; other cases in the folder stay.

    Findings that fail validation stop the write, as they point to a broken rule.
    """
    spark = findings.sparkSession
    staged = shared_folder(spark, "findings")
    # The rules run once: what is checked is what is published.
    findings.withColumn("errors", finding_errors(findings)).write.parquet(staged)
    checked = spark.read.parquet(staged)
    broken = checked.filter(F.size("errors") > 0).select("rule_name", "errors").limit(1).collect()
    if not broken:
        (checked.drop("errors").dropDuplicates(["finding_id"]).withColumn("case_id", F.lit(case_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("case_id").parquet(path))
    remove_path(spark, staged)
    if broken:
        raise ValueError(f"rule {broken[0]['rule_name']} gave an invalid finding: {broken[0]['errors']}")


def findings_for_export(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings with the ids of all their events as JSON text."""
    return with_event_ids(findings, events).withColumn("event_ids", ids_to_json(F.col("event_ids")))
