"""Checking collected files against the hashes taken at collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.lines import stored_path

# Manifest states without a file to check.
NO_FILE = ("unreadable", "redacted", "copy_failed", "stat_failed")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with ``result``: verified, failed or skipped, and ``reason``.

    ``manifest`` has host_id, original_path, sha256 and status; ``files`` has host_id, stored_path,
    actual_sha256 and is_directory.  A row without an expected hash is verified if its file is there.
    """
    rows = manifest.withColumn("stored_path", stored_path(F.col("original_path")))
    joined = rows.join(files.select("host_id", "stored_path", "actual_sha256", "is_directory"),
                       ["host_id", "stored_path"], "left")
    expected = F.trim(F.coalesce("sha256", F.lit("")))
    no_path = F.trim(F.coalesce("original_path", F.lit(""))) == ""
    reason = (F.when(F.col("status").isin(*NO_FILE), F.col("status")).when(no_path, "no_path")
              .when(F.col("is_directory"), "is_directory").when(F.col("actual_sha256").isNull(), "absent")
              .when((expected != "") & (expected != F.col("actual_sha256")), "hash mismatch"))
    joined = joined.withColumn("reason", reason)
    result = (F.when(F.col("reason").isNull(), "verified")
              .when(F.col("reason").isin("absent", "hash mismatch"), "failed").otherwise("skipped"))
    return joined.withColumn("result", result).select(
        "host_id", "original_path", "stored_path", "sha256", "actual_sha256", "result", "reason")


def without_failed(files: DataFrame, verified: DataFrame) -> DataFrame:
    """Files that may be read: those with a wrong hash stay out."""
    bad = verified.filter(F.col("reason") == "hash mismatch").select("host_id", "stored_path")
    return files.join(bad, ["host_id", "stored_path"], "left_anti")


def reverify(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded hashes against a fresh scan: reverified, missing, modified, or unrecorded for whole hosts.

    ``recorded`` has host_id, stored_path and sha256; a host with files but no record gives one row.
    """
    known = recorded.join(files.select("host_id", "stored_path", "actual_sha256"), ["host_id", "stored_path"], "left")
    status = (F.when(F.col("actual_sha256").isNull(), "missing")
              .when(F.col("actual_sha256") != F.col("sha256"), "modified").otherwise("reverified"))
    unrecorded = (files.select("host_id").distinct()
                  .join(recorded.select("host_id").distinct(), "host_id", "left_anti"))
    return known.select("host_id", "stored_path", status.alias("status")).unionByName(unrecorded.select(
        "host_id", F.lit(None).cast("string").alias("stored_path"), F.lit("unrecorded").alias("status")))


def artifacts_table(manifest: DataFrame, parse_status: DataFrame) -> DataFrame:
    """Manifest facts and parse results per artifact, one row per (host_id, original_path).

    ``parse_status`` comes from :func:`fleetlens.extract.status.artifact_status`; parsed artifacts that no
    manifest names are kept under their path.
    """
    from fleetlens.sources.lines import artifact_path

    facts = manifest.withColumn("artifact_path", artifact_path(stored_path(F.col("original_path"))))
    joined = facts.join(parse_status, ["host_id", "artifact_path"], "right")
    original = F.coalesce("original_path", F.concat(F.lit("/"), "artifact_path"))
    rows = joined.select(
        "host_id", original.alias("original_path"), F.col("artifact_path").alias("stored_path"), "sha256", "size",
        "mtime", "status", F.when(F.coalesce("sha256", F.lit("")) != "", "verified").otherwise("unknown")
        .alias("integrity"), "parse_status", "parse_events")
    return rows.groupBy("host_id", "original_path").agg(
        F.max(F.struct(*[c for c in rows.columns if c not in ("host_id", "original_path")])).alias("r")).select(
        "host_id", "original_path", "r.*")


def run_statistics(artifacts: DataFrame, extracted: DataFrame, errors) -> DataFrame:
    """One row: artifacts seen, skipped and failed; events inserted, deduplicated and invalid.

    ``errors`` is the validation column of an event (see :func:`fleetlens.sinks.exports.event_errors`).
    """
    from fleetlens.operators.joins import with_scalar

    files = artifacts.agg(
        F.count(F.lit(1)).alias("artifacts_seen"), F.count_if(F.col("parse_status") == "skip").alias("skipped"),
        F.count_if(F.col("parse_status") == "fail").alias("failed"))
    # Copies are folded per hash before they are counted.
    hashes = (extracted.withColumn("bad", F.size(errors) > 0).groupBy("event_hash", "bad")
              .agg(F.count(F.lit(1)).alias("n")))
    events = hashes.agg(
        F.count_if(~F.col("bad")).alias("events_inserted"),
        F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n") - 1)), F.lit(0)).alias("events_deduped"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("events_invalid"))
    return with_scalar(files, events)
