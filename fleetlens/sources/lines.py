"""Raw lines with byte offsets, from files or from texts held in a table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of line counts that are small enough to be sent to every task; more are joined by a shuffle.
BROADCAST_RANGES = 500_000


def scan_lines(reader, paths: str | Sequence[str]) -> DataFrame:
    """Text lines with the file facts needed to place them; ``reader`` is spark.read or spark.readStream."""
    # Only \n ends a line here; \r before it is content that counts for the offset and is cut off later.
    return reader.option("lineSep", "\n").format("text").load(paths).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.col("_metadata.file_modification_time").alias("__mtime"))


def decoded_path(uri: Column) -> Column:
    """The path a file has, from the URI that the scan gives: %20 and the like decoded, + kept."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def place_lines(text: DataFrame, root: str) -> DataFrame:
    """Raw lines of scanned files below ``root/<host>/``.

    The offset of a line is the length of everything before it: a running sum inside each file split plus
    the total of the earlier splits of the file.  The running sum is thereby bounded by the split size
    (128 MB), however long a file is.  Undecodable bytes stay in ``line``, because ids are computed from
    them; events get them replaced.
    """
    text = (text.withColumn("__seq", F.monotonically_increasing_id())
            .withColumn("__bytes", F.octet_length("value").cast("long") + 1))
    split = ["__file", "__block"]
    totals = text.groupBy(*split).agg(F.sum("__bytes").alias("__sum"), F.count(F.lit(1)).alias("__lines"))
    earlier = W.partitionBy("__file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*split, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"),
                           F.coalesce(F.sum("__lines").over(earlier), F.lit(0)).alias("__first"))
    inside = W.partitionBy(*split).orderBy("__seq")
    below = re.escape("/" + root.strip("/").split("://")[-1].strip("/") + "/") + r"([^/]+)/(.*)$"
    return text.join(starts, split).select(
        F.regexp_extract(decoded_path(F.col("__file")), below, 1).alias("host_id"),
        artifact_path(F.regexp_extract(decoded_path(F.col("__file")), below, 2)).alias("artifact_path"),
        F.lit("0" * 64).alias("artifact_sha256"), (F.unix_micros("__mtime") / 1_000_000).alias("artifact_mtime"),
        (F.row_number().over(inside) + F.col("__first")).cast("long").alias("line_no"),
        (F.sum("__bytes").over(inside) - F.col("__bytes") + F.col("__start")).alias("byte_offset"),
        F.rtrim("value", F.lit("\r")).alias("line"), (~F.is_valid_utf8("value")).alias("had_decode_error"))


def placed_below(root: str, file: Column) -> tuple[Column, Column]:
    """(host, path inside the host's folder) of a file below ``root/<host>/``."""
    below = re.escape("/" + root.strip("/").split("://")[-1].strip("/") + "/") + r"([^/]+)/(.*)$"
    return F.regexp_extract(file, below, 1), F.regexp_extract(file, below, 2)


def read_lines(spark: SparkSession, paths: str | Sequence[str], root: str,
               manifest: DataFrame | None = None, split_bytes: int | None = None) -> DataFrame:
    """Raw lines of log files below ``root/<host>/``, with the byte each begins at.

    Files are read in ranges of ``split_bytes`` (64 MB), compressed ones (gz, bz2, xz) as a stream; a line belongs to the range
    it begins in.  Names that begin with a dot are read too.  Offsets come from the ranges themselves.  Line numbers do as
    well in files of one range; longer files are read a second time for their number of lines per range, a row for each.

    ``manifest`` (host_id, artifact_path, sha256, mtime) gives the hash and time taken at collection;
    without it the time of the stored file counts and the hash is a zero digest.
    """
    from fleetlens.sources import ranges

    split = split_bytes or ranges.SPLIT_BYTES
    rows = ranges.scan(spark, ranges.LineRanges, paths, split)
    number = F.col("line_in_split")
    files = ranges.list_files([paths] if isinstance(paths, str) else paths)
    cuts = sum(-(-f.size // split) for f in files if f.size > split and not f.unpack)
    if cuts:
        counts = ranges.scan(spark, ranges.LineCounts, paths, split)
        earlier = W.partitionBy("file").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1)
        starts = counts.select("file", "split_start", F.coalesce(F.sum("split_lines").over(earlier), F.lit(0)).alias("lines_before"))
        # The listing says how many rows these are: about 100 bytes for each 64 MB of text.
        rows = rows.join(F.broadcast(starts) if cuts <= BROADCAST_RANGES else starts, ["file", "split_start"], "left")
        number = number + F.coalesce("lines_before", F.lit(0))
    host, path = placed_below(root, F.col("file"))
    text = F.col("raw").cast("string")
    lines = rows.select(
        host.alias("host_id"), artifact_path(path).alias("artifact_path"), F.lit("0" * 64).alias("artifact_sha256"),
        F.col("mtime").alias("artifact_mtime"), number.alias("line_no"), "byte_offset",
        F.rtrim(text, F.lit("\r\n")).alias("line"), (~F.is_valid_utf8(text)).alias("had_decode_error"))
    return with_collected_facts(lines, manifest)


def with_collected_facts(rows: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Hash and time of an artifact as its manifest has them, where there is one."""
    if manifest is None:
        return rows
    facts = manifest.groupBy("host_id", "artifact_path").agg(
        F.max("sha256").alias("__sha256"), F.max(F.col("mtime").try_cast("double")).alias("__collected"))
    joined = rows.join(facts, ["host_id", "artifact_path"], "left")
    return joined.withColumns({
        "artifact_sha256": F.coalesce("__sha256", "artifact_sha256"),
        "artifact_mtime": F.coalesce("__collected", "artifact_mtime")}).drop("__sha256", "__collected")


def lines_of_texts(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """Lines of whole texts that are already rows, such as small configuration files.

    The other columns are kept.  Offsets are summed inside each text, without a shuffle.
    """
    parts = F.split(F.col(text_column), "\n")
    keep = [c for c in texts.columns if c != text_column]
    ends = F.aggregate(
        parts, F.array(F.lit(0).cast("long")),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(x) + 1)))
    lines = texts.select(*keep, F.posexplode(F.arrays_zip(
        parts.alias("line"), F.slice(ends, 1, F.size(parts)).alias("at"))))
    return lines.select(*keep, (F.col("pos") + 1).cast("long").alias("line_no"),
                        F.col("col.at").alias("byte_offset"), F.rtrim(F.col("col.line"), F.lit("\r")).alias("line"))


def artifact_path(stored: Column) -> Column:
    """Path on the examined host from the path inside the evidence folder."""
    return F.regexp_replace(F.regexp_replace(stored, "^collected/files/", ""), "^collected/", "")


def stored_path(original: Column) -> Column:
    """Place of an original path inside the evidence folder."""
    return F.when(original.startswith("/"), F.concat(F.lit("collected/files"), original)).otherwise(
        F.concat(F.lit("collected/"), original))


def glob_regex(pattern: str) -> str:
    """Whole-path expression of a glob; ``*`` and ``?`` also match ``/``."""
    special = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(special.get(c, re.escape(c)) for c in pattern) + "$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
