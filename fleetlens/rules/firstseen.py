"""Addresses and accounts that turn up late in the collected period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.extract.base import join_small
from fleetlens.functions.text import sql_quote
from fleetlens.functions.times import from_micros, iso_text, micros, minute_text
from fleetlens.operators.joins import with_scalar
from fleetlens.operators.search import not_tool_noise
from fleetlens.rules.base import EVIDENCE, EvidenceKind, counted, finish, keyed, rule, text
from fleetlens.session import cut_lineage

# Looked-at columns with their label, and the smallest case.
FIELDS = (("source_ip", "address"), ("actor_user", "username"))
MIN_EVENTS = 50


def dated_value(column: str):
    return lambda: F.col(column).isNotNull() & F.col("timestamp_utc").isNotNull()


def _value(column: str):
    return lambda: F.col(column)


EVIDENCE.update({f"events_of_{label}": EvidenceKind(dated_value(column), _value(column)) for column, label in FIELDS})


def late_values(events: DataFrame, column: str, late_fraction: float, min_events: int) -> DataFrame:
    """Values whose first event (tool noise aside) lies in the late part of the covered period, with all their events counted.

    Times alone tell which values are late; only events of these are looked at for their digests and host.
    """
    at = micros(F.col("timestamp_utc"))
    span = (events.filter(F.col("timestamp_utc").isNotNull())
            .agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n_all"))
            .withColumn("threshold", F.round(
                F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(late_fraction)).cast("long")))
    own = F.when(not_tool_noise(), at)
    having = events.filter(dated_value(column)()).withColumn("value", F.col(column))
    first = having.groupBy("value").agg(F.min(own).alias("first_us"), F.max(own).alias("last_us"), F.count(own).alias("n"))
    late = cut_lineage(with_scalar(first, span).filter(
        (F.col("n_all") >= min_events) & (F.col("hi") > F.col("lo")) & (F.col("first_us") >= F.col("threshold"))))
    theirs = join_small(having.select("value", "event_id", "event_hash", "host_id", "timestamp_utc"), late.select("value"), ["value"], "left_semi")
    return late.join(theirs.groupBy("value").agg(
        *counted(), F.min_by("host_id", F.struct("timestamp_utc", "event_hash")).alias("host")), "value")


@rule("first_seen", late_fraction=0.5)
def first_seen(events: DataFrame, late_fraction: float = 0.5, min_events: int = MIN_EVENTS) -> DataFrame:
    parts = []
    for column, label in FIELDS:
        heads = late_values(events, column, late_fraction, min_events).withColumns({
            "evidence": F.array(keyed(f"events_of_{label}", F.col("value"))),
            "evidence_filter": text(f"{column} = ", sql_quote(F.col("value")), " AND timestamp_utc IS NOT NULL")})
        value, first = F.col("value"), from_micros(F.col("first_us"))
        parts.append(finish(
            heads, "first_seen", "1.0", "low",
            title=text(f"First appearance of {label} ", value),
            what=text(f"The {label} ", value, " shows up for the first time on ", minute_text(first),
                      " and ", F.col("n"), " time(s) in all."),
            why=text("The records start at ", minute_text(from_micros(F.col("lo"))),
                     "; what comes only in their late part is new and legitimate, or a first trace."),
            confidence="Medium",
            next_step=f"Ask whether this {label} is expected.",
            detail=text(f"field {column}; first ", iso_text(first), "; last ",
                        iso_text(from_micros(F.col("last_us"))), "; count ", F.col("n"), "; late from ",
                        iso_text(from_micros(F.col("threshold")))),
            host=F.col("host"), first=first, last=from_micros(F.col("last_us"))))
    return parts[0].unionByName(parts[1])
