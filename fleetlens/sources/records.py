"""Fixed-width binary record files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.lines import artifact_path, placed_below, with_collected_facts


def read_binary_files(spark: SparkSession, paths: str | Sequence[str], root: str) -> DataFrame:
    """(host_id, artifact_path, artifact_sha256, size, content) of files below ``root/<host>/``."""
    base = re.escape("/" + root.strip("/").split("://")[-1].strip("/") + "/") + r"([^/]+)/(.*)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(
        F.regexp_extract("path", base, 1).alias("host_id"),
        artifact_path(F.regexp_extract("path", base, 2)).alias("artifact_path"),
        F.sha2("content", 256).alias("artifact_sha256"), F.col("length").alias("size"), "content")


def read_records(spark: SparkSession, paths: str | Sequence[str], root: str, width: int, manifest: DataFrame | None = None,
                 split_bytes: int | None = None) -> DataFrame:
    """One row per whole record of files below ``root/<host>/``: ``record_index`` from 0 and the ``record`` bytes.

    A file is read in ranges of whole records, so it may be of any size; compressed files are read as a stream.  Hash and
    time come from ``manifest``, as in :func:`fleetlens.sources.lines.read_lines`.
    """
    from fleetlens.sources import ranges

    rows = ranges.scan(spark, ranges.RecordRanges, paths, split_bytes or ranges.SPLIT_BYTES, width=str(width))
    host, path = placed_below(root, F.col("file"))
    return with_collected_facts(rows.select(
        host.alias("host_id"), artifact_path(path).alias("artifact_path"), F.lit("0" * 64).alias("artifact_sha256"),
        F.col("mtime").alias("artifact_mtime"), "size", "record_index", "record"), manifest)


def split_records(files: DataFrame, width: int) -> DataFrame:
    """One row per whole record: ``record_index`` from 0 and the ``record`` bytes.

    For files that are rows already; :func:`read_records` reads files of any size.
    """
    count = F.floor(F.col("size") / width).cast("int")
    rows = files.filter(F.col("size") >= width).select(
        *[c for c in files.columns if c != "content"], "content",
        F.explode(F.sequence(F.lit(0), count - 1)).alias("record_index"))
    return rows.select(
        *[c for c in rows.columns if c != "content"],
        F.expr(f"substring(content, record_index * {width} + 1, {width})").alias("record"))
