from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.schema import HOST_SCHEMA  # noqa: E402
from fleetlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tests-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hosts(spark):
    window = ("op", "opuser", "203.0.113.9", "2024-01-05T10:00:00Z", "2024-01-05T10:30:00Z")
    return spark.createDataFrame([
        ("h1", "UTC", "etc_localtime", "debian", "12", "systemd", window),
        ("h2", "Asia/Karachi", "etc_localtime", "rocky", "9", "systemd", None),
    ], HOST_SCHEMA)


@pytest.fixture(scope="session")
def as_lines(spark):
    """Lines of texts: as_lines({path: text}, host, mtime)."""
    from pyspark.sql import functions as F

    from fleetlens.sources.lines import lines_of_texts

    def build(texts: dict[str, str], host: str = "h1", mtime: float = 1706000000.0):
        rows = [(host, path, "0" * 64, mtime, text) for path, text in texts.items()]
        df = spark.createDataFrame(
            rows, "host_id string, artifact_path string, artifact_sha256 string, artifact_mtime double, text string")
        return lines_of_texts(df).withColumn("had_decode_error", F.lit(False))

    return build
