"""Which jobs claim an artifact and how that went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.extract.base import REGISTRY

# Record files are read by jobs of their own, not line by line.
BINARY_CLAIMS = {
    "utmp_parser": ("var/log/wtmp", "var/log/wtmp.*", "var/log/btmp", "var/log/btmp.*", "var/run/utmp", "run/utmp"),
    "lastlog_parser": ("var/log/lastlog",),
    "browser_parser": ("home/*/.mozilla/firefox/*/places.sqlite", "root/.mozilla/firefox/*/places.sqlite",
                       "home/*/.config/google-chrome/*/History", "home/*/.config/chromium/*/History",
                       "root/.config/google-chrome/*/History", "root/.config/chromium/*/History"),
}


def claims(artifacts: DataFrame) -> DataFrame:
    """(host_id, artifact_path, parser_name) for every job whose globs match the path."""
    from fleetlens.sources.lines import matches_any

    path = F.col("artifact_path")
    globs = {**{n: e.globs for n, e in REGISTRY.items()}, **BINARY_CLAIMS}
    names = F.array_compact(F.array(*[
        F.when(matches_any(path, g), F.lit(n)) for n, g in sorted(globs.items())]))
    return artifacts.select("host_id", "artifact_path", F.explode_outer(names).alias("parser_name"))


def artifact_status(artifacts: DataFrame, events: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Per artifact: skip (nobody claims it), fail (a claiming job failed) or success, and its events.

    ``failures`` has (host_id, artifact_path).
    """
    key = ["host_id", "artifact_path"]
    claimed = claims(artifacts).groupBy(*key).agg(F.count("parser_name").alias("parsers"))
    made = events.groupBy("host_id", F.col("source_artifact_path").alias("artifact_path")).agg(
        F.count(F.lit(1)).alias("parse_events"))
    out = claimed.join(made, key, "left")
    if failures is not None:
        out = out.join(failures.select(*key).distinct().withColumn("failed", F.lit(True)), key, "left")
    else:
        out = out.withColumn("failed", F.lit(None).cast("boolean"))
    status = (F.when(F.col("parsers") == 0, "skip").when(F.col("failed"), "fail").otherwise("success"))
    return out.select(*key, "parsers", F.coalesce("parse_events", F.lit(0).cast("long")).alias("parse_events"),
                      status.alias("parse_status"))


def parser_stats(artifacts: DataFrame, events: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Per job: artifacts handled, artifacts failed, events made."""
    key = ["host_id", "artifact_path"]
    each = claims(artifacts).filter(F.col("parser_name").isNotNull())
    if failures is not None:
        each = each.join(failures.select(*key).distinct().withColumn("failed", F.lit(True)), key, "left")
    else:
        each = each.withColumn("failed", F.lit(None).cast("boolean"))
    handled = each.groupBy("parser_name").agg(
        F.count_if(F.col("failed").isNull()).alias("success"), F.count("failed").alias("fail"))
    made = events.groupBy("parser_name").agg(F.count(F.lit(1)).alias("events"))
    return handled.join(made, "parser_name", "left").withColumn("events", F.coalesce("events", F.lit(0).cast("long")))
