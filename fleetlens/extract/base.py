"""From raw lines to events: registry, host context and the common tail of every extraction job."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ids import event_hash, uuid5
from fleetlens.functions.text import blank_to_null, truncate_bytes
from fleetlens.functions.times import to_local
from fleetlens.operators.joins import salted_join
from fleetlens.schema import EVENT_SCHEMA
from fleetlens.session import cut_lineage
from fleetlens.sources.lines import matches_any

BROADCAST_ROWS = 200_000
OFFSET_CHUNK_BYTES = 262_144


@dataclass(frozen=True)
class Extractor:
    """``run(lines)`` turns lines of matching artifacts into partial events; ``complete`` adds the rest.

    Lines carry the host columns tz_name, tz_source, distro_id and contamination.
    """

    name: str
    version: str
    globs: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]
    #: Whether it needs the year that the file's first lines give.
    by_year: bool = False

    def claims(self, path: Column) -> Column:
        return matches_any(path, self.globs)

    def extract(self, lines: DataFrame, hosts: DataFrame, case_id: str = "case") -> DataFrame:
        claimed = lines.filter(self.claims(F.col("artifact_path")))
        return complete(self.run(with_hosts(claimed, hosts)), self.name, self.version, case_id)


REGISTRY: dict[str, Extractor] = {}


def extractor(name: str, globs: Sequence[str], version: str = "1.0", by_year: bool = False):
    """Register a function as the extraction job of the artifacts that match a glob."""
    def register(run: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REGISTRY[name] = Extractor(name, version, tuple(globs), run, by_year)
        return run
    return register


def join_small(left: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a dimension table: broadcast when a count proves it small, salted shuffle otherwise."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), list(keys), how)
    return salted_join(left, small, keys, how)


def with_hosts(lines: DataFrame, hosts: DataFrame) -> DataFrame:
    """Attach the host context; a host without one is in UTC and has no collection window."""
    context = hosts.select("host_id", "tz_name", "tz_source", "distro_id", "contamination")
    return (join_small(lines, context, ["host_id"])
            .withColumn("tz_name", F.coalesce("tz_name", F.lit("UTC")))
            .withColumn("tz_source", F.coalesce("tz_source", F.lit("assumed_utc"))))


def state(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Undated facts about a host's configuration."""
    return with_columns(df, event_kind="state_finding", timestamp_utc=F.lit(None).cast("timestamp"),
                        timestamp_confidence="unknown", **columns)


def dated(df: DataFrame, instant: Column, confidence: Column | str = "exact", **columns: Column | str
          ) -> DataFrame:
    """Events with a time; the confidence of an event without one is ``unknown``."""
    word = F.lit(confidence) if isinstance(confidence, str) else confidence
    df = df.withColumn("timestamp_utc", instant)
    return with_columns(
        df, event_kind="event",
        timestamp_confidence=F.when(F.col("timestamp_utc").isNull(), "unknown").otherwise(word), **columns)


def with_columns(df: DataFrame, **columns: Column | str | None) -> DataFrame:
    """Columns from literals or expressions, all over the same input row."""
    return df.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in columns.items()})


def complete(df: DataFrame, name: str, version: str, case_id: str = "case") -> DataFrame:
    """Fill the event schema, hash the whole raw line, then cut it to its stored length."""
    have = set(df.columns)
    local = F.col("timestamp_local") if "timestamp_local" in have else to_local(
        F.col("timestamp_utc"), F.col("tz_name"))
    given = {
        "case_id": F.lit(case_id), "timestamp_local": local, "timestamp_tz": F.col("tz_name"),
        "source_artifact_path": F.col("artifact_path"), "parser_name": F.lit(name),
        "source_artifact_sha256": F.col("artifact_sha256"), "parser_version": F.lit(version),
        "tool_generated_flag": (F.coalesce("tool_generated_flag", F.lit(False))
                                if "tool_generated_flag" in have else F.lit(False)),
        "event_hash": event_hash(F.col("host_id"), F.col("artifact_path"), F.col("raw_line_offset"),
                                 F.col("raw_line"), F.col("subcategory")),
        "raw_line": truncate_bytes(F.make_valid_utf8("raw_line")),
    }
    columns = []
    for field in EVENT_SCHEMA.fields:
        if field.name == "event_id":
            continue
        value = given.get(field.name)
        if value is None:
            value = F.col(field.name) if field.name in have else F.lit(None)
            if field.name in ("description", "actor_user"):
                value = F.make_valid_utf8(value.cast("string"))
        columns.append(value.cast(field.dataType).alias(field.name))
    rows = df.select(*columns)
    return rows.withColumn("event_id", uuid5(F.col("event_hash"))).select(*EVENT_SCHEMA.fieldNames())


def claimed_lines(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """The lines that some job wants, once per job, with its name as ``job``.

    The globs of all jobs are tried once per path, not per line.
    """
    path = F.col("artifact_path")
    jobs = F.array_compact(F.array(*[F.when(REGISTRY[n].claims(path), F.lit(n)) for n in names]))
    claims = cut_lineage(lines.select("artifact_path").distinct().withColumn("jobs", jobs).filter(F.size("jobs") > 0))
    return join_small(lines, claims, ["artifact_path"], "inner").withColumn("job", F.explode("jobs")).drop("jobs")


def extract_all(lines: DataFrame, hosts: DataFrame, case_id: str = "case",
                only: Sequence[str] | None = None) -> DataFrame:
    """Union of all registered jobs.  One artifact may be claimed by several of them.

    The text is read once: each line goes, with the context of its host, to the folder of every job that claims its
    artifact.  From there each job reads its own lines, as often as its plan needs them, and the years that files of some logs
    give are looked up once for all.  The plans of the jobs themselves run nothing.
    """
    from fleetlens.extract.syslog import anchor_years

    names = list(only or sorted(REGISTRY))
    staged = cut_lineage(with_hosts(claimed_lines(lines, names), hosts), by=["job"])
    # Jobs whose folder is empty would only make the plan longer; there are as many rows here as jobs at most.
    present = {row["job"] for row in staged.select("job").distinct().collect()}
    names = [n for n in names if n in present]
    if not names:
        return lines.sparkSession.createDataFrame([], EVENT_SCHEMA)
    dating = [n for n in names if REGISTRY[n].by_year]
    years = None
    if dating:
        years = join_small(staged, cut_lineage(anchor_years(staged.filter(F.col("job").isin(*dating)))), ["host_id", "artifact_path"])
    union = None
    for name in names:
        job = REGISTRY[name]
        own = (years if job.by_year else staged).filter(F.col("job") == name).drop("job")
        part = complete(job.run(own), job.name, job.version, case_id)
        union = part if union is None else union.unionByName(part)
    return union


def tool_generated(source_ip: Column, instant: Column, user: Column, contamination: Column) -> Column:
    """True for traces of the evidence collection itself.

    With an address: the operator's address, inside the collection window widened by five minutes; an
    unknown window counts as inside.  Without one: an operator's account inside a known window.
    """
    start_text, end_text = contamination["start_utc"], contamination["end_utc"]
    start, end = F.try_to_timestamp(start_text), F.try_to_timestamp(end_text)
    slack = F.expr("INTERVAL 5 MINUTES")
    known = (F.coalesce(start_text, F.lit("")) != "") & (F.coalesce(end_text, F.lit("")) != "") \
        & instant.isNotNull()
    readable = start.isNotNull() & end.isNotNull()
    inside = instant.between(start - slack, end + slack)
    same_ip = F.coalesce(source_ip == blank_to_null(contamination["source_ip"]), F.lit(False))
    operator = F.coalesce(user == blank_to_null(contamination["operator_user"]), F.lit(False)) | F.coalesce(
        user == blank_to_null(contamination["operator_login_user"]), F.lit(False))
    remote = same_ip & F.when(~known | ~readable, True).otherwise(inside)
    local = operator & (F.coalesce(user, F.lit("")) != "") & F.when(~known | ~readable, False).otherwise(inside)
    has_ip = F.coalesce(source_ip, F.lit("")) != ""
    return F.when(contamination.isNull(), False).when(has_ip, remote).otherwise(local)


_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, fields: dict[str, Column]) -> Column:
    """Sentence from a template: ``{name}`` is a field, ``[...]`` is left out when a field in it is null."""
    def plain(text: str, empty: bool) -> Column:
        parts, at = [], 0
        for match in _FIELD.finditer(text):
            if match.start() > at:
                parts.append(F.lit(text[at:match.start()]))
            value = fields[match.group(1)].cast("string")
            parts.append(F.coalesce(value, F.lit("")) if empty else value)
            at = match.end()
        if at < len(text):
            parts.append(F.lit(text[at:]))
        return F.concat(*parts) if parts else F.lit("")

    pieces = []
    for piece in re.split(r"(\[[^\]]*\])", template):
        if piece.startswith("["):
            pieces.append(F.coalesce(plain(piece[1:-1], False), F.lit("")))
        elif piece:
            pieces.append(plain(piece, True))
    return F.concat(*pieces)


def content(lines: DataFrame) -> DataFrame:
    """Lines with ``text`` (trimmed) that are neither blank nor comments."""
    text = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    rows = lines.withColumn("text", text)
    return rows.filter((F.col("text") != "") & ~F.col("text").startswith("#"))


def mtime_text() -> Column:
    """File mtime as an ISO text for descriptions."""
    from fleetlens.functions.times import epoch_seconds, iso_text
    return F.coalesce(iso_text(epoch_seconds(F.col("artifact_mtime"))), F.lit("unknown"))


def mtime_note() -> Column:
    return F.concat(F.lit("file_mtime_epoch="), F.bround("artifact_mtime").cast("long").cast("string"))
