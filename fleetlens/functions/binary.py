"""Reading fixed-width little-endian records with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.text import bind, blank_to_null


def unsigned_le(record: Column, start: int, width: int) -> Column:
    """Unsigned little-endian integer at byte ``start`` (from 0)."""
    # The byte order is turned on the hex text: reversing BINARY itself would go through a string.
    turned = lambda digits: F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.conv(bind(F.hex(F.substring(record, start + 1, width)), turned), 16, 10).cast("long")


def signed_le(record: Column, start: int, width: int = 4) -> Column:
    return bind(unsigned_le(record, start, width), lambda value: F.when(
        value >= 1 << (8 * width - 1), value - (1 << (8 * width))).otherwise(value))


def c_string(record: Column, start: int, width: int) -> Column:
    """Bytes up to the first NUL, undecodable ones replaced, blanks trimmed."""
    digits = F.hex(F.substring(record, start + 1, width))
    head = F.regexp_replace(digits, r"^((?:(?!00)..)*)00.*$", "$1")
    return F.trim(F.make_valid_utf8(F.unhex(head).cast("string")))


def c_string_keep_inner(record: Column, start: int, width: int) -> Column:
    """Like :func:`c_string`, but only trailing NULs go."""
    digits = F.hex(F.substring(record, start + 1, width))
    return F.trim(F.make_valid_utf8(F.unhex(F.regexp_replace(digits, "(?:00)+$", "")).cast("string")))


def all_zero(record: Column) -> Column:
    return F.hex(record).rlike("^0*$")


def address_text(record: Column, start: int) -> Column:
    """Sixteen address bytes to text: IPv4 when only the first four are used, IPv6 otherwise, null for none."""
    def shown(digits: Column) -> Column:
        octets = [F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10) for i in range(4)]
        groups = [F.ltrim(F.lower(F.substring(digits, 4 * i + 1, 4)), F.lit("0")) for i in range(8)]
        full = F.concat_ws(":", *[F.coalesce(blank_to_null(g), F.lit("0")) for g in groups])
        return (F.when(digits.rlike("^0*$"), F.lit(None).cast("string"))
                .when(F.substring(digits, 9, 24).rlike("^0*$"), F.concat_ws(".", *octets))
                .otherwise(bind(full, compress_v6)))

    return bind(F.hex(F.substring(record, start + 1, 16)), shown)


def compress_v6(full: Column) -> Column:
    """Replace the longest run (two or more, the first one wins) of zero groups by ``::``."""
    runs = [blank_to_null(F.regexp_extract(full, rf"(?:^|:)(0(?::0){{{n - 1}}})(?=:|$)", 1))
            for n in range(8, 1, -1)]

    def cut(run: Column) -> Column:
        pattern = F.concat(F.lit("^(.*?)(?:^|:)"), run, F.lit("(?::|$)"))
        return F.when(run.isNull(), full).otherwise(F.regexp_replace(full, pattern, F.lit("$1::")))

    return bind(F.coalesce(*runs), cut)
