"""Token totals by source, language and tokenizer version, kept by signed deltas in idempotent batches."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.tables import fresh, shipped
from fleetlens.session import remove_path

TOKENIZER_FOLDER = "/opt/tokenizers"
#: Fixed value: the public pre-tokenizer pattern these vocabularies were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

_loaded: dict = {}


def encoding(file):
    """A byte-level BPE from a file of ranks, a path or the broadcast bytes of one, made once per Python process."""
    if isinstance(file, str):
        with open(file, "rb") as ranks:
            content = ranks.read()
    else:
        content = file.value
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _loaded[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def token_deltas(tokenizers: Mapping[str, Broadcast]):
    """A mapper of (source, lang, sign, text) to deltas per source, language and tokenizer, summed up over a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[tuple, list[int]] = {}
            sources, langs, signs = (batch.column(i).to_pylist() for i in range(3))
            for version, file in tokenizers.items():
                encode = encoding(file).encode_ordinary
                for k in range(batch.num_rows):
                    text = batch.column(3)[k].as_py() or ""
                    t = totals.setdefault((sources[k], langs[k], version), [0, 0])
                    t[0] += signs[k]
                    t[1] += signs[k] * len(encode(text))
            rows = [(*key, *t) for key, t in totals.items()]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols[:3]] + [pa.array(c, pa.int64()) for c in cols[3:]],
                                  ["source", "lang", "tokenizer", "docs", "tokens"])
    return run


def deltas_of(changes: DataFrame, tokenizers: Mapping[str, str], before: str = "before", after: str = "after",
              source: str = "source", lang: str = "lang", old_source: str | None = None, old_lang: str | None = None) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) that a table of changes adds to the totals.

    A change has ``op``: 'insert' counts the text ``after``, 'delete' takes the text ``before`` away, 'revise' does both, under
    the old source and language where given.  Other ops, null too, change nothing.  A null text has no tokens but is a
    document; null sources and languages are keys of their own; every row is a change, repeated ones too (:func:`one_op_per_document`
    is for changes that are asked for by document).  Documents of a batch are summed up where they are read.
    """
    op = F.col("op")
    plus = F.when(op.isin("insert", "revise"), F.struct(
        F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.lit(1).alias("sign"), F.col(after).alias("text")))
    minus = F.when(op.isin("delete", "revise"), F.struct(
        F.col(old_source or source).cast("string").alias("source"), F.col(old_lang or lang).cast("string").alias("lang"),
        F.lit(-1).alias("sign"), F.col(before).alias("text")))
    part, = fresh(changes, "signed")
    signed = changes.select(F.explode(F.filter(F.array(plus, minus), lambda x: x.isNotNull())).alias(part)).select(f"{part}.*")
    files = {version: shipped(changes.sparkSession, path) for version, path in tokenizers.items()}
    return (signed.mapInArrow(token_deltas(files), DELTA).groupBy(*KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))


def token_count(path: str):
    """A function of a text column: its tokens by the rank file at ``path``; null for null."""
    file = shipped(SparkSession.active(), path)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoding(file).encode_ordinary
        return pa.array([None if not t.is_valid else len(encode(t.as_py())) for t in texts], pa.int64())

    return count


def deltas_of_counts(changes: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) that changes with counts add to the totals, as :func:`deltas_of` has it of texts.

    ``changes`` has op, source, lang, tokenizer and the token counts before and after (null: none), so a delete or a revision
    needs no text, only the numbers that were counted when it came.
    """
    plus, minus = F.col("op").isin("insert", "revise").cast("bigint"), F.col("op").isin("delete", "revise").cast("bigint")
    return (changes.filter(F.col("op").isin("insert", "delete", "revise")).groupBy(*KEYS).agg(
        F.sum(plus - minus).alias("docs"),
        F.sum(plus * F.coalesce(F.col(after), F.lit(0)) - minus * F.coalesce(F.col(before), F.lit(0))).alias("tokens")))


def one_op_per_document(ops: DataFrame, key: str, op: str = "op") -> DataFrame:
    """(key, op): of several changes asked for one document, a delete wins over a revision; null and other ops ask for nothing."""
    return ops.filter(F.col(op).isin("delete", "revise") & F.col(key).isNotNull()).groupBy(key).agg(F.min(op).alias("op"))


class TokenTotals:
    """A folder of committed batches, each the deltas of one batch id; their sum is the totals.

    A batch's deltas are written to a folder of their own attempt; a small file named after the batch id, which is created only
    if there is none, then names the attempt that counts.  So a batch that a retry or a second writer delivers again changes
    nothing, no folder has to be renamed, and what an interrupted writer leaves is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, text: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        path, files = self._files(f"{self.path}/commits")
        if not files.exists(path):
            return []
        return sorted(name.partition("=")[2] for name in (s.getPath().getName() for s in files.listStatus(path)) if name.startswith("batch="))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch's deltas under its id, unless it is committed; whether it was added now."""
        if not batch or any(c in batch for c in "/=\\:*?"):
            raise ValueError(f"batch id {batch!r} can't name a file")
        marker, files = self._files(f"{self.path}/commits/batch={batch}")
        if files.exists(marker):
            return False
        attempt = f"{batch}-{os.urandom(8).hex()}"
        deltas.coalesce(1).write.parquet(f"{self.path}/attempts/{attempt}")
        files.mkdirs(marker.getParent())
        try:
            out = files.create(marker, False)
        except Exception:
            # Another writer has committed the batch meanwhile; anything else is an error of its own.
            if not files.exists(marker):
                raise
            remove_path(self.spark, f"{self.path}/attempts/{attempt}")
            return False
        out.write(bytearray(attempt.encode()))
        out.close()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens), without keys whose documents and tokens are all taken away."""
        if not self.batches():
            return self.spark.createDataFrame([], DELTA)
        # One line for each batch.
        attempts = [row["value"] for row in self.spark.read.text(f"{self.path}/commits/batch=*").select("value").collect()]
        stored = self.spark.read.schema(DELTA).parquet(*[f"{self.path}/attempts/{a}" for a in attempts])
        return (stored.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .filter("docs != 0 or tokens != 0"))
