"""Content-derived identifiers, all from built-in hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators and the name space of the event ids.
UNIT_SEPARATOR = "\x1f"
RECORD_SEPARATOR = "\x1e"
EVENT_NAMESPACE_HEX = "6c1f0a529d0b4e6a8f3e2b7a1c9d4e10"


def _joined(*parts: Column) -> Column:
    # concat_ws drops nulls, which would move the separators: make every part a string first.
    return F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def event_hash(host_id: Column, path: Column, offset: Column, raw_line: Column,
               subcategory: Column) -> Column:
    """sha256 over host, path, offset, the whole line and the subcategory."""
    return F.sha2(_joined(host_id, path, offset, raw_line, subcategory), 256)


def uuid5(name: Column, namespace_hex: str = EVENT_NAMESPACE_HEX) -> Column:
    """RFC 4122 version-5 id of ``name``, assembled from the sha1 hex text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    # Two variant bits become 10: of the 16 hex digits, digit d maps to 8 + d mod 4.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def finding_id(rule_name: Column, rule_version: Column, title: Column, host_id: Column,
               event_ids: Column) -> Column:
    """First 32 hex digits of the sha256 over rule, title, host and the sorted evidence ids."""
    ids_text = F.array_join(F.array_sort(event_ids), RECORD_SEPARATOR)
    return F.substring(F.sha2(_joined(rule_name, rule_version, title, host_id, ids_text), 256), 1, 32)


#: Hex digits of one lane of an evidence digest: 60 bits, so that a sum of 10^20 of them still fits a decimal(38).
LANE_DIGITS = 15
LANES = ("digest_0", "digest_1")


def evidence_lanes(event_id: Column) -> dict[str, Column]:
    """Two numbers from the sha256 of an event id; their sums over a set of events do not depend on order or grouping."""
    digest = F.sha2(event_id, 256)
    return {name: F.conv(F.substring(digest, 1 + k * LANE_DIGITS, LANE_DIGITS), 16, 10).cast("decimal(20,0)") for k, name in enumerate(LANES)}


def evidence_finding_id(rule_name: Column, rule_version: Column, title: Column, host_id: Column, event_count: Column, *lanes: Column) -> Column:
    """First 32 hex digits of the sha256 over rule, title, host, and the number and digest sums of the evidence."""
    return F.substring(F.sha2(_joined(rule_name, rule_version, title, host_id, event_count, *lanes), 256), 1, 32)
