from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def words():
    """A seeded maker of texts of n words from a vocabulary of its own."""
    def make(n: int, seed: int, vocabulary: int = 900) -> str:
        rng = random.Random(seed)
        pool = random.Random(1)
        names = ["".join(pool.choice("abcdefghiklmnoprstuv") for _ in range(pool.randint(2, 8))) for _ in range(vocabulary)]
        return " ".join(rng.choice(names) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of texts, numbered from 0."""
    def build(texts, langs=None, sources=None):
        rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"s{i % 3}"), None if t is None else len(t))
                for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)
    return build


@pytest.fixture
def stored(spark, tmp_path):
    """A table written and read again, so that rows keep their places."""
    def store(df, name="t"):
        path = str(tmp_path / name)
        df.write.parquet(path)
        return spark.read.parquet(path)
    return store
