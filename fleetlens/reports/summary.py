"""Case summaries, chart series, coverage and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import severity_rank
from fleetlens.functions.times import day_bucket, hour_bucket
from fleetlens.operators.joins import with_scalar
from fleetlens.operators.windows import first_n_per_group
from fleetlens.rules.base import FAILURES

# How much an executive summary shows.
OBSERVATIONS = 5
ACTIONS = 5
SEVERITY_ORDER = ("high", "medium", "low", "info")


def case_summary(events: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: events, findings, covered period, findings per severity."""
    event_part = events.agg(F.count(F.lit(1)).alias("event_count"),
                            F.min("timestamp_utc").alias("first_event_utc"),
                            F.max("timestamp_utc").alias("last_event_utc"))
    finding_part = findings.agg(
        F.count(F.lit(1)).alias("finding_count"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_findings") for s in SEVERITY_ORDER])
    return with_scalar(event_part, finding_part)


def category_counts(events: DataFrame) -> DataFrame:
    return (events.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "category"))


def events_per_day(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("timestamp_utc").isNotNull())
            .groupBy(day_bucket(F.col("timestamp_utc")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy("day"))


def failures_per_hour(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("timestamp_utc").isNotNull() & F.col("subcategory").isin(*FAILURES))
            .groupBy(hour_bucket(F.col("timestamp_utc")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy("hour"))


def findings_per_severity(findings: DataFrame) -> DataFrame:
    """Always four rows, zero where there is no finding."""
    spark = findings.sparkSession
    fixed = spark.createDataFrame(list(enumerate(SEVERITY_ORDER)), "position int, severity string")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return (fixed.join(counts, "severity", "left")
            .select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "position")
            .orderBy("position").drop("position"))


def busiest_users(events: DataFrame, limit: int = 10) -> DataFrame:
    return (events.filter(F.col("actor_user") != "").groupBy("actor_user")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "actor_user").limit(limit))


def event_sample(events: DataFrame, limit: int = 1000) -> DataFrame:
    columns = ("event_id", "event_kind", "category", "subcategory", "severity", "timestamp_utc",
               "actor_user", "source_ip", "description", "raw_line", "source_artifact_path")
    return (events.orderBy(F.col("timestamp_utc").asc_nulls_last(), "event_id").limit(limit)
            .select(*columns))


def artifact_list(artifacts: DataFrame) -> DataFrame:
    return artifacts.orderBy("host_id", "original_path")


def coverage(artifacts: DataFrame) -> DataFrame:
    """Artifacts per parse status."""
    return (artifacts.groupBy("parse_status").agg(F.count(F.lit(1)).alias("artifacts"))
            .orderBy("parse_status"))


def failed_artifacts(artifacts: DataFrame) -> DataFrame:
    return (artifacts.filter(F.col("parse_status") == "fail").select("host_id", "original_path")
            .orderBy("host_id", "original_path"))


def _report_order():
    return [severity_rank(F.col("severity")), F.col("first_ts_utc").asc_nulls_last(), F.col("finding_id")]


def key_observations(findings: DataFrame, limit: int = OBSERVATIONS) -> DataFrame:
    """First findings of the highest of the two severities that has any."""
    graded = findings.filter(F.col("severity").isin("high", "medium"))
    top = graded.agg(F.min(severity_rank(F.col("severity"))).alias("top"))
    return (with_scalar(graded, top).filter(severity_rank(F.col("severity")) == F.col("top"))
            .orderBy(*_report_order()).limit(limit)
            .select("title", "what_happened", "why_it_matters", "severity"))


def recommended_actions(findings: DataFrame, limit: int = ACTIONS) -> DataFrame:
    """First distinct next steps of high and medium findings; apostrophes do not make a step distinct."""
    step = F.trim("check_next")
    rows = (findings.filter(F.col("severity").isin("high", "medium") & (step != ""))
            .withColumn("step", step).withColumn("same", F.replace(step, F.lit("'"), F.lit(""))))
    order = F.struct(severity_rank(F.col("severity")), F.col("first_ts_utc").isNull(), "first_ts_utc",
                     "finding_id")
    firsts = rows.groupBy("same").agg(F.min(order).alias("order"), F.min_by("step", order).alias("step"))
    return firsts.orderBy("order").limit(limit).select("step")


def headline(events: DataFrame, findings: DataFrame, case_id: str) -> DataFrame:
    """One row with the counts and an opening sentence."""
    summary = case_summary(events, findings)
    high, medium, n = F.col("high_findings"), F.col("medium_findings"), F.format_number("event_count", 0)
    sentence = (
        F.when(high > 0, F.format_string(
            f"Case {case_id}: %d high-severity finding(s) and %d medium-severity one(s) in %s events; "
            "review at once.", high, medium, n))
        .when(medium > 0, F.format_string(
            f"Case {case_id}: no high-severity finding, %d medium-severity one(s) in %s events; "
            "an analyst should look.", medium, n))
        .otherwise(F.format_string(
            f"Case {case_id}: no finding of high or medium severity in %s events.", n)))
    return summary.select("event_count", "high_findings", "medium_findings", sentence.alias("headline"))


def scorecard(ground_truth: DataFrame, findings: DataFrame) -> DataFrame:
    """Expected threats with PASS, MISS or EVIDENCE (no rule expected, not scored)."""
    fired = findings.select(F.col("rule_name").alias("expected_rule")).distinct().withColumn("fired", F.lit(True))
    status = (F.when(F.col("expected_rule").isNull(), "EVIDENCE").when(F.col("fired"), "PASS")
              .otherwise("MISS"))
    return (ground_truth.join(fired, "expected_rule", "left")
            .select("threat_id", "expected_rule", status.alias("status")))


def detection_rate(scores: DataFrame) -> DataFrame:
    hits, misses = F.count_if(F.col("status") == "PASS"), F.count_if(F.col("status") == "MISS")
    return scores.agg(
        F.count(F.lit(1)).alias("total"), hits.alias("detected"), misses.alias("missed"),
        F.count_if(F.col("status") == "EVIDENCE").alias("evidence_only"),
        F.when(hits + misses > 0, F.round(hits / (hits + misses) * 100, 1)).otherwise(0.0).alias("rate"))


def case_rollup(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Events, hosts, findings and high findings per case; ``findings`` carries case_id."""
    event_part = events.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("events_count"), F.count_distinct("host_id").alias("hosts"))
    finding_part = findings.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("findings_count"),
        F.count_if(F.col("severity") == "high").alias("high_findings"))
    zero = F.lit(0).cast("long")
    return (event_part.join(finding_part, "case_id", "full_outer")
            .select("case_id", *[F.coalesce(c, zero).alias(c) for c in
                                 ("events_count", "hosts", "findings_count", "high_findings")])
            .orderBy(F.col("case_id").desc()))


def artifact_folders(artifacts: DataFrame, contains: str = "") -> DataFrame:
    """Files per top-level folder, optionally only paths that hold a text in any case."""
    path = F.col("original_path")
    kept = artifacts.filter(F.lower(path).contains(contains.lower())) if contains else artifacts
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folder = F.when(F.size(parts) > 1, F.concat(F.lit("/"), parts.getItem(0))).otherwise("/root")
    return (kept.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files")).orderBy("folder"))


def earliest_per_user(events: DataFrame, n: int = 25) -> DataFrame:
    """The first events of every account."""
    dated = events.filter(F.col("timestamp_utc").isNotNull() & F.col("actor_user").isNotNull())
    return first_n_per_group(dated.select("actor_user", "event_id", "event_hash", "timestamp_utc"),
                             ["actor_user"], [F.col("timestamp_utc"), F.col("event_hash")], n)
