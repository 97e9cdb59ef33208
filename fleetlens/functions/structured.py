"""JSON and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.text import first_filled


def ids_to_json(ids: Column) -> Column:
    return F.to_json(F.array_sort(ids))


def ids_from_json(text: Column) -> Column:
    """Array of ids; text that is not a JSON array counts as one id, blank text as none."""
    parsed = F.from_json(text, "array<string>")
    return (F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>"))
            .when(F.trim(text).startswith("[") & parsed.isNotNull(), parsed)
            .otherwise(F.array(text)))


def first_field(entry: Column, *names: str) -> Column:
    """First filled field of a struct, in the order given."""
    return first_filled(*[entry.getField(n) for n in names])


def ordered_argv(text: Column) -> Column:
    """``a0="ls" a1="-l"`` records to the command line, by argument number."""
    pattern = F.lit(r'\ba(\d+)="?([^"\s]*)"?')
    numbers = F.regexp_extract_all(text, pattern, F.lit(1))
    values = F.regexp_extract_all(text, pattern, F.lit(2))
    pairs = F.zip_with(numbers, values, lambda n, v: F.struct(
        F.coalesce(n.try_cast("int"), F.lit(0)).alias("n"), v.alias("v")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["v"]), " ")


def package_entries(text: Column) -> Column:
    """``name (ver, ver), name (ver)`` to an array of STRUCT<name, versions>."""
    pattern = F.lit(r"([^\s(),]+)\s*\(([^)]*)\)")
    return F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)),
        lambda n, v: F.struct(n.alias("name"), v.alias("versions")))


def trimmed_parts(text: Column, separator: str = ",") -> Column:
    """Parts of a separated list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")
