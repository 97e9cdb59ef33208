"""A convolutional text classifier for toxicity, fitted with numpy on a bounded sample of labelled rows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import IS_MARK, U64, Spans, mixed, seeded, text_buffers, word_spans
from fleetlens.llm.tables import fresh, whole_text

BUCKETS, DIMS, FILTERS = 1 << 15, 16, 8
WIDTHS = (1, 2, 3)
PARTS = 6


def word_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, word, first): hashed buckets of the different words of a piece (six per word: the word, its first
    three, four and five bytes, its last three and four), the number of each running word, and each row's first word."""
    start, end, first = word_spans(buf, offsets, IS_MARK)
    spans = Spans(buf)
    whole = spans(start, end)
    _, at, word = np.unique(whole, return_index=True, return_inverse=True)
    s, e = start[at], end[at]
    keys = [whole[at]]
    keys += [spans(s, np.minimum(s + n, e)) + U64(n) for n in (3, 4, 5)]
    keys += [spans(np.maximum(e - n, s), e) + U64(64 + n) for n in (3, 4)]
    salts = seeded(PARTS, 83)
    features = np.stack([(mixed(k + salt) % U64(BUCKETS)).astype(np.int32) for k, salt in zip(keys, salts)], axis=1)
    return features, word, first


@dataclass
class TextCNN:
    """Hashed word embeddings, filters over one, two and three words, max pooling over the whole text, one output."""

    seed: int = 7
    table: np.ndarray = field(init=False)
    filters: dict = field(init=False)
    bias: dict = field(init=False)
    top: np.ndarray = field(init=False)
    scale: tuple = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)
    threshold: float = 0.3

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.table = rng.normal(0, 0.02, (BUCKETS, DIMS)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.top = rng.normal(0, 0.3, len(WIDTHS) * FILTERS + 1).astype(np.float32)
        self.top[-1] = 0

    def activations(self, features, word, first):
        """Per width the filter values at every word; words past the end of a row count as zero vectors."""
        vectors = self.table[features].sum(axis=1)
        owner_end = np.repeat(first[1:], np.diff(first))
        for w in WIDTHS:
            value = None
            for j in range(w):
                projected = np.vstack([vectors @ self.filters[w][j], np.zeros((1, FILTERS), np.float32)])
                if j == 0:
                    value = projected[word]
                else:
                    at = np.arange(len(word)) + j
                    value += projected[np.where(at < owner_end, word[np.minimum(at, len(word) - 1)], len(vectors))]
            yield w, value + self.bias[w], vectors

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.top[-1], np.float64)
        for low, high, buf, offsets in text_buffers(texts, lower=True):
            features, word, first = word_features(buf, offsets)
            rows = np.flatnonzero(np.diff(first))
            if not len(rows):
                continue
            for k, (_, value, _) in enumerate(self.activations(features, word, first)):
                pooled = np.maximum(np.maximum.reduceat(value, first[rows], axis=0), 0)
                out[low + rows] += pooled @ self.top[k * FILTERS: (k + 1) * FILTERS]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probability of label 1, 0 to 1."""
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts) + b, -30, 30)))

    def fit(self, texts: pa.Array, labels: np.ndarray, epochs: int, rate: float = 0.1, batch: int = 48) -> None:
        """Adagrad on the logistic loss; a maximum passes its gradient to the words it came from.

        Buckets that fewer than two (of large samples, more) fitting texts have stay zero, so that names and chance
        words can neither be learnt by heart nor add noise to texts not seen.  Small samples are passed over more often.
        """
        rng = np.random.default_rng(self.seed)
        epochs = max(epochs, -(-400 // max(1, len(texts) // batch)))
        frequency = np.zeros(BUCKETS, np.int64)
        for _, _, buf, offsets in text_buffers(texts, lower=True):
            features, word, first = word_features(buf, offsets)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pairs = np.unique(owner * len(features) + word)
            cells = np.unique((pairs // max(1, len(features)))[:, None] * BUCKETS + features[pairs % max(1, len(features))])
            frequency += np.bincount(cells % BUCKETS, minlength=BUCKETS)
        known = frequency >= max(2, len(texts) // 1000)
        self.table[~known] = 0
        sums: dict = {}

        def step(name, values, gradient):
            sums[name] = sums.get(name, np.full_like(values, 1e-3)) + gradient ** 2
            values -= rate * gradient / np.sqrt(sums[name])

        seen = np.full((BUCKETS, 1), 1e-3, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                chosen = order[at: at + batch]
                part = texts.take(pa.array(chosen))
                pieces = list(text_buffers(part, lower=True, limit=1 << 62))
                _, _, buf, offsets = pieces[0]
                features, word, first = word_features(buf, offsets)
                if not len(word):
                    continue
                rows = np.flatnonzero(np.diff(first))
                pooled = np.zeros((len(chosen), len(self.top)), np.float32)
                pooled[:, -1] = 1
                best, vectors = {}, None
                for k, (w, value, vectors) in enumerate(self.activations(features, word, first)):
                    best[w] = np.zeros((len(chosen), FILTERS), np.int64)
                    for r in rows:
                        best[w][r] = value[first[r]: first[r + 1]].argmax(axis=0) + first[r]
                    pooled[rows, k * FILTERS: (k + 1) * FILTERS] = np.maximum(
                        np.take_along_axis(value, best[w][rows], axis=0), 0)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.top, -30, 30)))
                error = ((p - labels[chosen]) / len(chosen)).astype(np.float32)
                back = error[:, None] * self.top[None, :] * (pooled > 0)
                gradient = np.zeros_like(vectors)
                # Each batch has an empty text of label 0 too.
                by_top = pooled.T @ error
                by_top[-1] += 1 / (1 + np.exp(-float(self.top[-1]))) / len(chosen)
                steps = [("top", self.top, by_top)]
                for k, w in enumerate(WIDTHS):
                    g = back[rows, k * FILTERS: (k + 1) * FILTERS]
                    steps.append((f"b{w}", self.bias[w], g.sum(axis=0)))
                    change = np.zeros_like(self.filters[w])
                    for j in range(w):
                        place = best[w][rows] + j
                        inside = place < first[rows + 1][:, None]
                        unit = word[np.minimum(place, len(word) - 1)]
                        gj = np.where(inside, g, 0)
                        change[j] = np.einsum("rf,rfd->df", gj, vectors[unit])
                        np.add.at(gradient, unit, gj[:, :, None] * self.filters[w][j].T[None])
                    steps.append((f"f{w}", self.filters[w], change))
                touched = np.flatnonzero(np.abs(gradient).sum(axis=1))
                flat = features[touched].ravel()
                rows_of, inverse = np.unique(flat, return_inverse=True)
                total = np.zeros((len(rows_of), DIMS), np.float32)
                np.add.at(total, inverse, np.repeat(gradient[touched], PARTS, axis=0))
                total[~known[rows_of]] = 0
                seen[rows_of] += (total ** 2).mean(axis=1, keepdims=True)
                self.table[rows_of] -= rate * total / np.sqrt(seen[rows_of])
                for s in steps:
                    step(*s)

    def calibrate(self, texts: pa.Array, labels: np.ndarray, weights: np.ndarray, langs: list, least_rows: int = 8) -> None:
        """Platt's scale on rows the filters were not fitted on, then per language the threshold of the best F1.

        A language with fewer than ``least_rows`` rows of either label keeps the common threshold.
        """
        x = self.logits(texts)
        a, b = 1.0, 0.0
        positive, negative = (labels * weights).sum(), ((1 - labels) * weights).sum()
        goal = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((p - goal) * weights * x).sum(), ((p - goal) * weights).sum()])
            h = (p * (1 - p) * weights)
            hess = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + np.eye(2) * 1e-6
            da, db = np.linalg.solve(hess, g)
            size = max(1.0, abs(da), abs(db))
            a, b = a - da / size, b - db / size
        self.scale = (max(float(a), 1e-3), float(b))
        p = 1 / (1 + np.exp(-np.clip(self.scale[0] * x + self.scale[1], -30, 30)))
        for lang in sorted({v for v in langs if v is not None}):
            own = np.array([v == lang for v in langs])
            if min(labels[own].sum(), (1 - labels[own]).sum()) < least_rows:
                continue
            cuts = np.round(np.arange(0.05, 1, 0.05), 2)
            best = [2 * (weights[own] * labels[own] * (p[own] >= c)).sum() /
                    ((weights[own] * labels[own]).sum() + (weights[own] * (p[own] >= c)).sum()) for c in cuts]
            top = cuts[np.array(best) >= max(best) - 1e-9]
            self.thresholds[lang] = float(top[np.argmin(np.abs(top - self.threshold))])


#: A threshold that no score reaches.
NEVER = 2.0


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 5000, fit_bytes: int = 20_000, epochs: int = 6,
                 key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str | None = "lang") -> TextCNN:
    """Fit on at most ``fit_rows`` labelled documents, half of each label as far as there are, of at most ``fit_bytes``.

    The bound covers the fitting sample alone.  It is drawn by a hash of the key from the labels, whose chosen keys
    (never more than ``fit_rows``) are broadcast to the documents.  A fifth calibrates; there the labels are weighted
    back to their shares in the whole table.  Null labels and keys are left out.  Without both labels every score is
    the share of label 1, and the threshold is beyond every score.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.max(label).cast("int").alias("y"))
    shares = {int(r[0]): r[1] for r in known.groupBy("y").count().collect()}
    drawn = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("k", F.lit(5)), "k").limit(fit_rows // 2)
        drawn = part if drawn is None else drawn.unionByName(part)
    language = F.col(lang) if lang and lang in docs.columns else F.lit(None).cast("string")
    rows = (docs.select(F.col(key).alias("k"), whole_text(text).alias("text"), language.alias("lang"))
            .filter(F.octet_length("text") <= fit_bytes).join(F.broadcast(drawn), "k")
            .dropDuplicates(["k"]).withColumn("place", F.xxhash64("k", F.lit(9))).select("place", F.col("k").cast("string"), "y", "lang", "text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        sample = pa.Table.from_batches(parts) if parts else None
        model = fitted(sample, shares, epochs)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The bounded sample is fitted in one task, so that neither its texts nor the fit weigh on the driver.
    found = rows.repartition(1).sortWithinPartitions("place", "k").mapInArrow(train, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fitted(None, shares, epochs)


def fitted(sample: pa.Table | None, shares: dict[int, int], epochs: int) -> TextCNN:
    """A model of a sample (y, lang, text); ``shares`` are the rows of each label in the whole table."""
    model = TextCNN()
    y = sample["y"].to_numpy().astype(np.float32) if sample is not None else np.zeros(0, np.float32)
    if len(set(y.tolist())) < 2:
        share = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
        model.top[:] = 0
        model.scale = (1.0, float(np.log(share / (1 - share))))
        # Scores that tell no text from another reject none.
        model.threshold = NEVER
        return model
    texts, langs = sample["text"].combine_chunks(), sample["lang"].to_pylist()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    held = np.arange(len(y)) % 5 == 4
    fit_on, check_on = np.flatnonzero(~held), np.flatnonzero(held)
    model.fit(texts.take(pa.array(fit_on)), y[fit_on], epochs)
    own = {v: max(1, (y[check_on] == v).sum()) for v in (0, 1)}
    weight = np.where(y[check_on] > 0, shares.get(1, 0) / own[1], shares.get(0, 0) / own[0])
    weight *= len(check_on) / weight.sum()
    model.calibrate(texts.take(pa.array(check_on)), y[check_on], weight, [langs[i] for i in check_on])
    return model


def toxicity_score(model: TextCNN, text: str | Column = "text") -> Column:
    """Score of a whole text, 0 to 1; null is the empty text, which has the score of a text without signs."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts), pa.float64())

    return score(whole_text(text))


def toxic_threshold(model: TextCNN, lang: str | Column = "lang") -> Column:
    """The calibrated threshold of a row's language; the common one where the language is null or rare."""
    out = F.lit(model.threshold)
    for name, cut in sorted(model.thresholds.items()):
        out = F.when(F.col(lang) == name if isinstance(lang, str) else lang == name, F.lit(cut)).otherwise(out)
    return out


def with_toxicity(docs: DataFrame, model: TextCNN, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of ``docs`` with toxicity (0 to 1) and toxic (at or above its language's threshold).

    Repeated rows score alike; an empty table stays empty; columns of these names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("toxicity", "toxic")])
    cut = toxic_threshold(model, lang) if lang in docs.columns else F.lit(model.threshold)
    score, = fresh(docs, "toxicity")
    return docs.withColumn(score, toxicity_score(model, text)).withColumn("toxic", F.col(score) >= cut)
