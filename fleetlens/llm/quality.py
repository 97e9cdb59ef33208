"""A quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import IS_BLANK, IS_MARK, U64, Spans, text_buffers, word_spans
from fleetlens.llm.tables import fresh, whole_text

WORD_BUCKETS = 1024
SHAPES = 6
SOURCES, LANGS, LAYOUT = 64, 16, 5
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct_per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])] if len(v) else np.zeros(0, bool)
    return np.bincount(o[new], minlength=len(first) - 1)


def text_pieces(texts: pa.Array):
    """(first row, shape features, bucket of each word, first word of each row): what the text view sees."""
    for low, _, buf, offsets in text_buffers(texts):
        start, end, first = word_spans(buf, offsets)
        lower = np.where(IS_UPPER[buf], buf + 32, buf).astype(np.uint8)
        hashes = Spans(lower)(start, end)
        words = np.maximum(np.diff(first), 1)
        size = np.maximum(np.diff(offsets), 1)
        marks = IS_MARK[buf] & ~IS_BLANK[buf]
        shapes = np.stack([
            distinct_per_row(hashes, first) / words, per_row(marks, offsets) / words, per_row(IS_UPPER[buf], offsets) / size,
            np.log1p(per_row(~IS_BLANK[buf], offsets) / words), np.log1p(np.diff(first)),
            (np.diff(first) == 0).astype(float)], axis=1)
        yield low, shapes, (hashes >> U64(54)).astype(np.int32), first


def metadata_features(texts: pa.Array, langs: list, sources: list) -> np.ndarray:
    """What the metadata view sees: source and language (hashed; null is a value), and length and layout by lines."""
    out = np.zeros((len(texts), LAYOUT + LANGS + SOURCES))
    for low, high, buf, offsets in text_buffers(texts):
        breaks = np.flatnonzero(buf == 10)
        edges = np.union1d(np.union1d(breaks, breaks + 1), offsets)
        start, end = edges[:-1], edges[1:]
        real = (end > start) & (buf[start] != 10) if len(start) else np.zeros(0, bool)
        start, end = start[real], end[real]
        first = np.searchsorted(start, offsets)
        lines = np.maximum(np.diff(first), 1)
        size = np.diff(offsets)
        out[low:high, 0] = np.log1p(size)
        out[low:high, 1] = np.log1p(np.diff(first))
        out[low:high, 2] = np.log1p(size / lines)
        out[low:high, 3] = distinct_per_row(Spans(buf)(start, end), first) / lines
        out[low:high, 4] = per_row((buf >= 48) & (buf < 58), offsets) / np.maximum(size, 1)
    for names, at, n in ((langs, LAYOUT, LANGS), (sources, LAYOUT + LANGS, SOURCES)):
        cache = {v: xxhash.xxh3_64_intdigest(repr(v)) % n for v in set(names)}
        out[np.arange(len(names)), at + np.array([cache[v] for v in names], np.int64)] = 1
    return out


def text_features(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), SHAPES + WORD_BUCKETS), np.float32)
    for low, shapes, bucket, first in text_pieces(texts):
        out[low: low + len(shapes), :SHAPES] = shapes
        owner = np.repeat(np.arange(len(shapes)), np.diff(first))
        counts = np.bincount(owner * WORD_BUCKETS + bucket, minlength=len(shapes) * WORD_BUCKETS).reshape(-1, WORD_BUCKETS)
        out[low: low + len(shapes), SHAPES:] = counts / np.maximum(np.diff(first), 1)[:, None]
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features, by full-batch Adam with weight decay."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, steps: int = 250, decay: float = 1e-4) -> "Logistic":
        mean, std = x.mean(axis=0), x.std(axis=0)
        scale = np.where(std > 1e-9, 1 / np.maximum(std, 1e-9), 0)
        z = ((x - mean) * scale).astype(np.float32)
        w, b = np.zeros(x.shape[1]), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        total = sample_weight.sum()
        for t in range(1, steps + 1):
            error = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y) * sample_weight / total
            g = np.r_[error @ z + decay * w, error.sum()]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.weights, self.bias = w * scale, float(b - (w * scale * mean).sum())
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    #: Calibration of each view, and of both together: scale and shift, and two weights and a shift.
    text_scale: tuple = (1.0, 0.0)
    meta_scale: tuple = (1.0, 0.0)
    joint: tuple = (0.5, 0.5, 0.0)
    #: Pseudo-labels each view got from the other, by round.
    exchanged: list = field(default_factory=list)

    def text_logits(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        words = self.text.weights[SHAPES:]
        for low, shapes, bucket, first in text_pieces(texts):
            sums = np.r_[0, np.cumsum(words[bucket])]
            mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
            out[low: low + len(shapes)] = shapes @ self.text.weights[:SHAPES] + mean + self.text.bias
        return out

    def score(self, texts: pa.Array, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of quality by the text view, the metadata view and both."""
        t = self.text_logits(texts) * self.text_scale[0] + self.text_scale[1]
        m = self.meta(metadata_features(texts, langs, sources)) * self.meta_scale[0] + self.meta_scale[1]
        return probability(t), probability(m), probability(self.joint[0] * t + self.joint[1] * m + self.joint[2])


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, share: float, rounds: int = 4, per_round: int = 400,
             confidence: float = 0.95, trust: float = 0.3) -> CoTrained:
    """Fit both views; ``y`` is 1, 0 or -1 (unlabelled), ``share`` the share of label 1 in the whole table.

    Every fifth labelled row calibrates.  In each round a view labels the unlabelled rows it is surest of (calibrated at
    ``confidence`` or more, ``per_round`` in the proportions of the labels) for the other view, and both are fitted anew;
    a label so given weighs ``trust`` of a real one.
    """
    known = np.flatnonzero(y >= 0)
    check = known[4::5]
    fit = np.setdiff1d(known, check)
    pool = np.flatnonzero(y < 0)
    views = {"text": xt, "meta": xm}
    given: dict[str, dict[int, float]] = {"text": {}, "meta": {}}
    goal = y[check].astype(float)
    both_labels = len(check) > 0 and 0 < goal.mean() < 1
    weight = np.where(goal > 0, share / goal.mean(), (1 - share) / (1 - goal.mean())) if both_labels else np.ones(len(check))
    models, scales, exchanged = {}, {}, []
    for turn in range(rounds + 1):
        for name, x in views.items():
            extra = np.array(sorted(given[name]), np.int64)
            at = np.r_[fit, extra]
            target = np.r_[y[fit].astype(float), [given[name][i] for i in extra.tolist()]]
            real = np.r_[np.ones(len(fit)), np.full(len(extra), trust)]
            high = (real * target).sum() / real.sum()
            balance = real * np.where(target > 0.5, 0.5 / max(high, 1e-9), 0.5 / max(1 - high, 1e-9))
            models[name] = Logistic().fit(x[at], target, balance)
            scales[name] = (1.0, 0.0)
            if both_labels:
                platt = Logistic().fit(models[name](x[check])[:, None], goal, weight, steps=400, decay=1e-3)
                scales[name] = (max(float(platt.weights[0]), 1e-3), platt.bias)
        if turn == rounds or not len(pool):
            break
        sure: dict[str, list] = {}
        for name, other in (("text", "meta"), ("meta", "text")):
            open_rows = np.array([i for i in pool.tolist() if i not in given[other]], np.int64)
            a, b = scales[name]
            p = probability(a * models[name](views[name][open_rows]) + b) if len(open_rows) else np.zeros(0)
            sure[other] = []
            for label, q, n in ((1.0, p, round(per_round * share)), (0.0, 1 - p, round(per_round * (1 - share)))):
                best = np.argsort(-q, kind="stable")[: max(1, n)]
                sure[other] += [(int(open_rows[k]), label) for k in best if q[k] >= confidence]
        for name, rows in sure.items():
            given[name].update(rows)
        exchanged.append({name: len(rows) for name, rows in sure.items()})
    out = CoTrained(models["text"], models["meta"], scales["text"], scales["meta"], exchanged=exchanged)
    if both_labels:
        logits = [models[n](views[n][check]) * scales[n][0] + scales[n][1] for n in ("text", "meta")]
        both = Logistic().fit(np.stack(logits, axis=1), goal, weight, steps=400, decay=1e-3)
        out.joint = (max(float(both.weights[0]), 0.0), max(float(both.weights[1]), 0.0), both.bias)
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, pool_rows: int = 6000, key: str = "doc_id", text: str = "text",
                label: str = "quality", lang: str = "lang", source: str = "source", **options) -> CoTrained | float:
    """Co-train on at most ``fit_rows`` labelled documents (half of each label) and ``pool_rows`` without label.

    These bounds cover the fitting sample alone; it is drawn by a hash of the key, its keys are broadcast, and its features,
    of fixed size per row, are computed where the texts lie.  Null keys and labels are left out.  Without both labels the
    result is the share of label 1 (0.5 without any).
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.min(label).cast("int").alias("y"))
    shares = {int(r[0]): r[1] for r in known.groupBy("y").count().collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    if len(shares) < 2:
        return share if shares else 0.5
    open_keys = docs.select(F.col(key).alias("k")).filter("k is not null").join(known, "k", "left_anti").distinct()
    drawn = open_keys.orderBy(F.xxhash64("k", F.lit(6)), "k").limit(pool_rows).withColumn("y", F.lit(-1))
    for y in (0, 1):
        drawn = drawn.unionByName(known.filter(F.col("y") == y).orderBy(F.xxhash64("k", F.lit(6)), "k").limit(fit_rows // 2))

    def features(batches):
        for batch in batches:
            texts = batch.column(2)
            t = text_features(texts)
            m = metadata_features(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist()).astype(np.float32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in t], pa.binary()),
                                   pa.array([v.tobytes() for v in m], pa.binary())], ["k", "y", "t", "m"])

    def column(name):
        return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")

    rows = (docs.select(F.col(key).alias("k"), whole_text(text).alias("text"), column(lang).alias("lang"), column(source).alias("source"))
            .join(F.broadcast(drawn), "k").select(F.col("k").cast("string").alias("k"), "y", "text", "lang", "source")
            .mapInArrow(features, "k string, y int, t binary, m binary").toArrow())
    keys = rows["k"].to_pylist()
    order = sorted({k: i for i, k in reversed(list(enumerate(keys)))}.items(), key=lambda x: xxhash.xxh3_64_intdigest(x[0]))
    at = pa.array([i for _, i in order], pa.int64())
    rows = rows.take(at)
    xt = np.frombuffer(b"".join(rows["t"].to_pylist()), np.float32).reshape(len(at), -1)
    xm = np.frombuffer(b"".join(rows["m"].to_pylist()), np.float32).reshape(len(at), -1)
    return co_train(xt, xm, rows["y"].to_numpy(), share, **options)


def quality_scores(model: CoTrained | float, text: str = "text", lang: str | Column = "lang", source: str | Column = "source") -> Column:
    """A struct of text_score, meta_score and score (0 to 1, high is good) of each row.

    Null texts are empty texts; null or unknown languages and sources are values of their own; equal rows score alike.
    """
    kind = "struct<text_score: double, meta_score: double, score: double>"

    @F.arrow_udf(kind)
    def score(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Array:
        if isinstance(model, float):
            parts = [np.full(len(texts), model)] * 3
        else:
            parts = model.score(texts, langs.to_pylist(), sources.to_pylist())
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()) for p in parts], ["text_score", "meta_score", "score"])

    return score(whole_text(text), lang, source)


def with_quality(docs: DataFrame, model: CoTrained | float, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """All columns of ``docs`` with text_score, meta_score and score; columns of these names are replaced."""
    names = ("text_score", "meta_score", "score")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    both, = fresh(docs, "view_scores")
    column = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in (lang, source)]
    return docs.withColumn(both, quality_scores(model, text, *column)).select(
        *docs.columns, *[F.col(both)[n].alias(n) for n in names])
