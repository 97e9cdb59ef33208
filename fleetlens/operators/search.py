"""Event search: filters, counts and pages over the event table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Searched columns, sortable columns, page limits, and ignored addresses.
SEARCH_COLUMNS = ("description", "raw_line", "actor_user", "source_ip", "actor_process",
                  "source_artifact_path", "subcategory")
SORT_COLUMNS = ("timestamp_utc", "category", "subcategory", "severity", "actor_user", "actor_process",
                "source_artifact_path", "event_id")
DEFAULT_LIMIT = 50
MAX_LIMIT = 500
LOCAL_ADDRESSES = ("127.0.0.1", "::1", "localhost", "local", "", ":0.0", ":0")


def ascii_ilike(column: Column, text: str) -> Column:
    """LIKE %text% in which only ASCII letters fold; ``%`` and ``_`` in the text are wildcards.

    A backslash is an ordinary character here, so it is doubled for Spark's default escape.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "%" + text.translate(str.maketrans(upper, lower)).replace("\\", "\\\\") + "%"
    return F.translate(column, upper, lower).like(pattern)


def keyword(text: str) -> Column:
    return reduce(lambda a, b: a | b,
                  [F.coalesce(ascii_ilike(F.col(c), text), F.lit(False)) for c in SEARCH_COLUMNS])


def not_tool_noise() -> Column:
    return ~F.coalesce(F.col("tool_generated_flag"), F.lit(False))


def user_is(user: str) -> Column:
    """The account, or the same name kept with single quotes around it."""
    return F.col("actor_user").isin(user, f"'{user}'")


def external_address() -> Column:
    ip = F.col("source_ip")
    return ip.isNotNull() & ~ip.isin(*LOCAL_ADDRESSES) & ~ip.startswith(":")


def event_condition(*, q: str = "", category: str = "", severity: str = "", user: str = "",
                    host: str = "", from_ts: str = "", to_ts: str = "", ids: Sequence[str] = ()) -> Column:
    """All given filters together as one condition.  Blank and ``all`` mean no filter.

    Equality and range filters compare bare columns with literals, so as a WHERE they reach the Parquet scan.
    """
    given = lambda value: bool(value.strip()) and value.strip() != "all"
    parts = []
    if given(category):
        parts.append(F.col("category") == category.strip())
    if given(severity):
        parts.append(F.col("severity") == severity.strip())
    if given(user):
        parts.append(user_is(user.strip()))
    if given(host):
        parts.append(F.col("host_id") == host.strip())
    if from_ts.strip():
        parts.append(F.col("timestamp_utc") >= F.lit(from_ts.strip()).cast("timestamp"))
    if to_ts.strip():
        parts.append(F.col("timestamp_utc") <= F.lit(to_ts.strip()).cast("timestamp"))
    wanted = [i.strip() for i in ids if i.strip()]
    if wanted:
        parts.append(F.col("event_id").isin(*wanted))
    if q.strip():
        parts.append(keyword(q.strip()))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_events(events: DataFrame, **filters) -> DataFrame:
    return events.filter(event_condition(**filters))


def clamp_page(limit: object = DEFAULT_LIMIT, offset: object = 0) -> tuple[int, int]:
    def number(value: object, default: int) -> int:
        try:
            return int(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return default
    return min(max(number(limit, DEFAULT_LIMIT), 1), MAX_LIMIT), max(number(offset, 0), 0)


DEEP_OFFSET = 10_000


def page(events: DataFrame, *, sort: str = "timestamp_utc", order: str = "asc",
         limit: object = DEFAULT_LIMIT, offset: object = 0, deep_offset: int = DEEP_OFFSET) -> DataFrame:
    """One page in a total order.  Nulls come first in rising and last in falling order.

    A top-k keeps offset + limit rows on the driver, so beyond ``deep_offset`` the rows before the page are
    counted by bucket instead, and only the buckets the page touches are sorted.
    """
    name = sort if sort in SORT_COLUMNS else "timestamp_utc"
    falling = str(order).lower() == "desc"
    directed = lambda c: F.col(c).desc_nulls_last() if falling else F.col(c).asc_nulls_first()
    size, skip = clamp_page(limit, offset)
    if skip > deep_offset:
        events, skip = _page_buckets(events, name, directed, size, skip)
    return events.orderBy(directed(name), F.col("event_hash").asc()).offset(skip).limit(size)


def _page_buckets(events: DataFrame, name: str, directed, size: int, skip: int) -> tuple[DataFrame, int]:
    """Rows of the buckets that hold places skip .. skip + size, and the places left to skip in them."""
    # Buckets follow the sort order: hours of time, leading digits of ids, and values of short vocabularies.
    bucket = {"timestamp_utc": F.date_trunc("hour", "timestamp_utc"),
              "event_id": F.substring("event_id", 1, 5)}.get(name, F.col(name))
    counts = events.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy(directed("__b")))
    touched = (counts.withColumn("__upto", upto)
               .filter((F.col("__upto") > skip) & (F.col("__upto") - F.col("__n") < skip + size)))
    before = touched.agg(F.min(F.col("__upto") - F.col("__n")).alias("n")).first()["n"]
    # Every touched bucket holds a row of the page: at most ``size`` of them, at most 500.
    kept = events.withColumn("__b", bucket).join(
        F.broadcast(touched.select(F.col("__b").alias("__t"))), F.col("__b").eqNullSafe(F.col("__t")), "left_semi")
    return kept.drop("__b"), skip - (before if before is not None else 0)


def search_counts(events: DataFrame, **filters) -> DataFrame:
    """One row from one pass: all events, matching events, distinct named users of the whole table."""
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(event_condition(**filters)).alias("filtered_total"),
        F.count_distinct(F.when(F.col("actor_user") != "", F.col("actor_user"))).alias("distinct_users"))


def distinct_users(events: DataFrame) -> DataFrame:
    return events.filter(F.col("actor_user") != "").select("actor_user").distinct()


def search_events(events: DataFrame, *, sort: str = "timestamp_utc", order: str = "asc",
                  limit: object = DEFAULT_LIMIT, offset: object = 0, **filters) -> DataFrame:
    return page(filter_events(events, **filters), sort=sort, order=order, limit=limit, offset=offset)
