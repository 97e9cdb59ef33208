"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "fleetlens", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC wall clock and adaptive execution.

    Nothing about cluster size is set here: executors, memory and the shuffle width belong to the
    submitter.  ``shuffle_partitions`` is for tests and benches on one machine.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are instants; every wall-clock conversion in the library assumes a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new path below the folder all executors share, for data written once and read back.

    On one machine without such a folder it lies in a temporary one.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


_stages: dict[str, list[str]] = {}


def cut_lineage(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    Later steps read only the columns they need, plans stay short, and a lost executor costs a re-read, not
    a rerun.  ``by`` names columns whose values get folders of their own.  :func:`remove_stages` deletes these tables at the
    end of a run.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "stage")
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    _stages.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; DataFrames made from them end with it."""
    for path in _stages.pop(spark.sparkContext.applicationId, []):
        remove_path(spark, path)


def remove_path(spark: SparkSession, text: str) -> None:
    """Remove a folder this library has made itself."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
