"""How detection rules turn events into findings.

A rule yields one row per finding with its texts, its time span, the exact number of events it stands on and where they
are: ``evidence`` names keys to join events on (:func:`finding_events`), ``evidence_filter`` is a Spark SQL predicate over the
event table that selects exactly these events (:func:`evidence_of`).  A campaign of a billion failed logins is thereby one
small row like any other.  ``finding_id`` covers rule, title, host and the events through sums of their digests, which
tasks add up before they shuffle; it is the same formula for one event and for all.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from fleetlens.functions.ids import LANES, evidence_finding_id, evidence_lanes
from fleetlens.functions.text import severity_rank
from fleetlens.operators.joins import salted_join
from fleetlens.schema import CONFIDENCE_WORDS, EVIDENCE_TYPE, FINDING_COLUMNS, FINDING_SCHEMA, SEVERITIES
from fleetlens.session import cut_lineage

log = logging.getLogger(__name__)

# Subcategory groups the rules speak about.
FAILURES = ("failed_login", "invalid_user", "auth_failure")
PASSWORD_FAILURES = ("failed_login", "invalid_user")
LOGINS = ("successful_login", "session_opened", "login")

# Rules whose jobs run side by side: many of their steps are too small for a whole cluster.
RULES_AT_ONCE = 6


@dataclass(frozen=True)
class Rule:
    """A registered rule: ``run(events, **params)`` gives findings."""

    name: str
    version: str
    run: Callable[..., DataFrame]
    params: Mapping[str, object] = field(default_factory=dict)

    def findings(self, events: DataFrame, **overrides) -> DataFrame:
        known = {k: v for k, v in overrides.items() if k in self.params}
        return self.run(events, **{**self.params, **known})


REGISTRY: dict[str, Rule] = {}

@dataclass(frozen=True)
class EvidenceKind:
    """Which events are of a kind, by which key findings name them, and ``at`` where findings take a span of it.

    The three are functions that give columns over the event table; ``step`` cuts spans into pieces to join on.
    """

    events: Callable[[], Column]
    key: Callable[[], Column]
    at: Callable[[], Column] | None = None
    step: int = 1


EVIDENCE: dict[str, EvidenceKind] = {}
#: Events that a finding names one by one.
ONE_EVENT = "event"


def keyed(kind: str, key: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """An entry of a finding's ``evidence``."""
    number = lambda c: F.lit(None).cast("long") if c is None else c.cast("long")
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), number(start).alias("from"), number(end).alias("to"))


def pair_key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def counted(event_id: str = "event_id") -> list[Column]:
    """Aggregates of evidence: its number of events and the sums of their digests."""
    return [F.count(F.lit(1)).alias("event_count"), *[F.sum(v).alias(n) for n, v in evidence_lanes(F.col(event_id)).items()]]


def rule(name: str, version: str = "1.0", **params):
    """Register a function as a rule; keyword values are its thresholds."""
    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = Rule(name, version, run, params)
        return run
    return register


def quoted_list(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def text(*parts: Column | str) -> Column:
    """Sentence from literals and columns; a null part counts as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(""))
                      for p in parts])


def row_order() -> Column:
    """Total order of events: dated first, then by time and hash."""
    return F.struct(F.col("timestamp_utc").isNull(), "timestamp_utc", "event_hash")


def listed(heads: DataFrame, ids: Column) -> DataFrame:
    """Heads whose few events are known one by one."""
    zero = F.lit(0).cast("decimal(38,0)")

    def total(lane: str) -> Column:
        return F.aggregate("__ids", zero, lambda acc, i: (acc + evidence_lanes(i)[lane]).cast("decimal(38,0)"))

    return heads.withColumn("__ids", ids).withColumns({
        "event_count": F.size("__ids").cast("long"),
        "evidence": F.transform("__ids", lambda i: keyed(ONE_EVENT, i)),
        **{lane: total(lane) for lane in LANES},
    }).drop("__ids")


def finish(heads: DataFrame, name: str, version: str, severity: Column | str, *, title: Column,
           what: Column, why: Column | str, confidence: Column | str, next_step: Column | str,
           detail: Column, host: Column | None = None, first: Column | None = None,
           last: Column | None = None) -> DataFrame:
    """Bring a rule's rows to the finding schema and give them their ids."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    null_text, null_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    rows = heads.select(
        F.lit(name).alias("rule_name"), F.lit(version).alias("rule_version"),
        lit(severity).alias("severity"), title.alias("title"), what.alias("what_happened"),
        lit(why).alias("why_it_matters"), lit(confidence).alias("confidence"),
        lit(next_step).alias("check_next"), detail.alias("technical_detail"),
        (first if first is not None else null_time).alias("first_ts_utc"),
        (last if last is not None else null_time).alias("last_ts_utc"),
        (host if host is not None else null_text).alias("host_id"),
        F.col("event_count").cast("long").alias("event_count"),
        F.col("evidence").cast(T.ArrayType(EVIDENCE_TYPE)).alias("evidence"), F.col("evidence_filter"),
        *[F.col(lane).cast("decimal(38,0)").alias(lane) for lane in LANES])
    identity = [F.col(c) for c in ("rule_name", "rule_version", "title", "host_id", "event_count", *LANES)]
    return rows.withColumn("finding_id", evidence_finding_id(*identity)).select(*FINDING_COLUMNS)


def per_event(rows: DataFrame) -> DataFrame:
    """Heads for rules that report single events."""
    lanes = {lane: own.cast("decimal(38,0)") for lane, own in evidence_lanes(F.col("event_id")).items()}
    return rows.withColumns({
        "event_count": F.lit(1).cast("long"), "evidence": F.array(keyed(ONE_EVENT, F.col("event_id"))), **lanes,
        "evidence_filter": text("event_id = '", F.col("event_id"), "'")})


def finding_errors(findings: DataFrame) -> Column:
    """Why a finding may not be stored: missing texts, unknown severity or confidence word."""
    needed = ("title", "what_happened", "why_it_matters", "confidence", "check_next", "technical_detail")
    checks = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c}: missing")) for c in needed]
    checks.append(F.when(~F.col("severity").isin(*SEVERITIES), F.lit("severity: unknown word")))
    checks.append(F.when(~F.col("confidence").isin(*CONFIDENCE_WORDS), F.lit("confidence: unknown word")))
    return F.array_compact(F.array(*checks))


def evidence_of(events: DataFrame, evidence_filter: str) -> DataFrame:
    """The whole evidence of one finding, however long."""
    return events.filter(F.expr(evidence_filter))


def finding_events(findings: DataFrame, events: DataFrame) -> DataFrame:
    """(finding_id, event_id) of all events that findings stand on, of one or a billion.

    One pass over the events gives each the keys it has in the kinds of evidence, and one join finds the findings that name
    them.  The join is salted, because a key with very many events is what a finding is about; spans are joined on the steps
    they cover.  ``events`` must have the columns that the kinds look at.
    """
    entries = findings.select("finding_id", F.explode("evidence").alias("e")).select("finding_id", "e.*")
    named = entries.filter(F.col("kind") == ONE_EVENT).select("finding_id", F.col("key").alias("event_id"))
    step_of = lambda at, kind: F.floor(at / F.lit(kind.step)).cast("long")
    whole = F.array(F.lit(-1).cast("long"))
    steps = F.coalesce(*[F.when(F.col("kind") == name, F.sequence(step_of(F.col("from"), kind), step_of(F.col("to"), kind)))
                         for name, kind in sorted(EVIDENCE.items()) if kind.at], whole)
    wanted = entries.filter(F.col("kind") != ONE_EVENT).withColumn("step", F.explode(steps))
    none = F.lit(None).cast("long")
    places = F.array_compact(F.array(*[
        F.when(kind.events(), F.struct(
            F.lit(name).alias("kind"), kind.key().cast("string").alias("key"), (kind.at() if kind.at else none).alias("at"),
            (step_of(kind.at(), kind) if kind.at else F.lit(-1).cast("long")).alias("step"))) for name, kind in sorted(EVIDENCE.items())]))
    rows = events.select("event_id", F.explode(places).alias("p")).select("event_id", "p.*").filter("key is not null and step is not null")
    found = salted_join(rows, wanted, ["kind", "key", "step"]).filter(
        F.col("from").isNull() | F.col("at").between(F.col("from"), F.col("to")))
    return named.unionByName(found.select("finding_id", "event_id"))


def with_event_ids(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings with all their event ids as one sorted list each, for exports that want them in the row."""
    lists = finding_events(findings, events).groupBy("finding_id").agg(F.array_sort(F.collect_list("event_id")).alias("event_ids"))
    return findings.join(lists, "finding_id", "left").withColumn(
        "event_ids", F.coalesce("event_ids", F.array().cast("array<string>")))


def pivot_to_events(findings: DataFrame, events: DataFrame, narrow: DataFrame | None = None) -> DataFrame:
    """Finding to events, as (finding_id, event columns), for findings of any size.

    ``events`` must have the columns that evidence predicates name; ``narrow`` are the columns to return, if fewer.
    """
    return finding_events(findings, events).join(events if narrow is None else narrow, "event_id", "inner")


def rank_order() -> list[Column]:
    """Most severe first, then by time with undated last, then by id."""
    return [severity_rank(F.col("severity")), F.col("first_ts_utc").asc_nulls_last(), F.col("finding_id")]


def ranked(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*rank_order())


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


@dataclass
class RunReport:
    """Findings of the rules that ran, plus the names of rules that failed; :meth:`whole` tells the two apart."""

    findings: DataFrame
    failed: dict[str, str]

    def whole(self) -> DataFrame:
        """The findings, if every rule ran; what a failed rule would have found is missing, not absent."""
        if self.failed:
            raise RuntimeError(f"findings are not whole, rules failed: {self.failed}")
        return self.findings

    def stats(self) -> DataFrame:
        """Per rule: success, fail and number of findings."""
        spark = self.findings.sparkSession
        known = spark.createDataFrame(
            [(n, int(n not in self.failed), int(n in self.failed)) for n in sorted(REGISTRY)],
            "rule_name string, success int, fail int")
        counts = self.findings.groupBy("rule_name").agg(F.count(F.lit(1)).alias("findings"))
        return (known.join(counts, "rule_name", "left")
                .withColumn("findings", F.coalesce("findings", F.lit(0).cast("long"))))


def run_rules(events: DataFrame, only: Sequence[str] | None = None, *, stored: bool = False, **params) -> RunReport:
    """Union of all rules in name order.  A rule that cannot be planned is reported, not fatal; ``whole()`` of the report is.

    Rules are planned side by side, because their first steps run then.  With ``stored`` each writes its findings to the shared
    folder as well, so that no plan holds all rules, and a rule that fails while it runs is reported likewise.
    ``events`` is read once per rule branch, each with its own pushed-down filter; keep it as Parquet
    partitioned by date, or persist the narrow projection when the case is small.
    """
    failed: dict[str, str] = {}

    def found(name: str) -> DataFrame | None:
        try:
            findings = REGISTRY[name].findings(events, **params).select(*FINDING_COLUMNS)
            return cut_lineage(findings) if stored else findings
        except Exception as error:  # isolation: one broken rule must not stop the others
            log.exception("rule %s could not be %s", name, "run" if stored else "planned")
            failed[name] = repr(error)
            return None

    with ThreadPoolExecutor(RULES_AT_ONCE) as pool:
        results = [f for f in pool.map(inheritable_thread_target(events.sparkSession)(found), sorted(only or REGISTRY)) if f is not None]
    union = results[0] if results else empty_findings(events.sparkSession)
    for other in results[1:]:
        union = union.unionByName(other)
    return RunReport(union, failed)
