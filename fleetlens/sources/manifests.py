"""Collection manifests: expected hashes of files and the context of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import first_filled
from fleetlens.functions.times import known_zone
from fleetlens.schema import CONTAMINATION_TYPE, HOST_SCHEMA, MANIFEST_SCHEMA

_HOST_JSON = ("host struct<distro_id string, version_id string, hostname string, machine_id string, timezone string, "
              f"timezone_source string, init_system string>, contamination {CONTAMINATION_TYPE.simpleString()}")


def _real_rows(rows: DataFrame) -> DataFrame:
    """Without header lines and rows that name no file."""
    path = F.trim(F.coalesce("original_path", F.lit("")))
    return rows.filter((path != "") & (path != "original_path"))


def read_hash_manifests(spark: SparkSession, paths) -> DataFrame:
    """Manifest rows with ``manifest_file``.  The header may be there or not: it is just a row to drop."""
    rows = spark.read.csv(paths, schema=MANIFEST_SCHEMA, header=False)
    return _real_rows(rows.select("*", F.col("_metadata.file_path").alias("manifest_file")))


def hash_manifest_lines(lines: DataFrame, text_column: str = "line") -> DataFrame:
    """The same for CSV lines that are already rows; other columns are kept."""
    parsed = F.from_csv(F.col(text_column), MANIFEST_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " "))
    keep = [c for c in lines.columns if c != text_column]
    return _real_rows(lines.select(*keep, parsed.alias("__m")).select(*keep, "__m.*"))


def host_id_of(host: Column) -> Column:
    """Machine id, else host name, else ``unknown-host``; blanks count as missing."""
    chosen = first_filled(host["machine_id"], host["hostname"], "unknown-host")
    return first_filled(F.trim(chosen), "unknown-host")


def host_contexts(documents: DataFrame, text_column: str = "value") -> DataFrame:
    """One row per manifest document (JSON text), in the host schema."""
    parsed = documents.select(F.from_json(text_column, _HOST_JSON).alias("m"))
    host = F.col("m.host")
    zone = known_zone(host["timezone"])
    given = F.coalesce(host["timezone"] == zone, F.lit(False))
    rows = parsed.select(
        host_id_of(host).alias("host_id"), zone.alias("tz_name"),
        F.when(given, first_filled(host["timezone_source"], "assumed_utc")).otherwise("assumed_utc").alias("tz_source"),
        host["distro_id"].alias("distro_id"), host["version_id"].alias("version_id"),
        host["init_system"].alias("init_system"), F.col("m.contamination").alias("contamination"))
    # Bundles of one host: any of its manifests, but always the same one.
    names = HOST_SCHEMA.fieldNames()
    return (rows.groupBy("host_id").agg(F.min(F.struct(*names[1:])).alias("h"))
            .select("host_id", *[F.col(f"h.{n}").alias(n) for n in names[1:]]))


def read_host_contexts(spark: SparkSession, paths) -> DataFrame:
    return host_contexts(spark.read.text(paths, wholetext=True))


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that exist, asked of the file system they name; the others are left out of a run."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        if path.getFileSystem(conf).globStatus(path):
            found.append(text)
    return found
