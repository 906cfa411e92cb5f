"""A quality classifier learned from trusted positives and unlabelled web text.

Negatives are never shown.  A first scorer that tells positives from unlabelled text gives the class prior: among the best
scored, the share of unlabelled text over that of positives (each scored by what the other folds teach) bounds the prior from above, and the cut with the
lowest bound (with its sampling error) estimates it.  The classifier then minimises the non-negative unbiased risk

    prior * E_pos[loss(f, +1)] + max(0, E_unl[loss(f, -1)] - prior * E_pos[loss(f, -1)])

with the logistic loss: the bracket estimates the risk on negatives, and where a batch drives it below zero, the step goes
back along it instead of fitting the noise.  The score is the fitted probability.

A text is described by shares of its byte classes, by repetition of words, windows and lines, by lengths, and by the
frequencies of hashed byte trigrams.

Edge cases: a null text is an empty one, has all features zero and is scored like any other; whole texts are used however
long; of rows that share a doc_id one (the least text) may be learned from, and all are scored; a null doc_id is hashed as
an empty number; labels that are null, other than 1 or of no known document are not used; a document that is labelled
twice is trusted if one label is 1; without positives or unlabelled text every score is 0.5; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents learned from are hash samples of about so many trusted positives and unlabelled texts.
POSITIVES, UNLABELLED = 8_192, 16_384
#: Hashed byte trigrams.
TRIGRAMS = 512
#: Texts described together, by bytes and by number.
GROUP_BYTES, GROUP_ROWS = 4 << 20, 1_024
#: Training: steps, batch, step width, weight decay, and how far below zero the negative risk may go.
STEPS, BATCH, STEP, DECAY, SLACK = 1_000, 1_024, 0.02, 1e-4, 0.0
#: Prior: folds of the sample that are scored by what the others teach, weight decay there, and confidence of the bound.
FOLDS, TELLING_DECAY, DELTA = 3, 1e-2, 0.1
SEED = 11
CUT = 0.3

_ODD = np.uint32(0x9E3779B1)
# Byte classes: other ASCII, upper, lower, digit, blank, line end, stop marks, exclamation, symbols, brackets and quotes, non-ASCII.
_CLASSES = (b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\f\v", b"\n", b".,;:", b"!?", b"#*$%&|<>~^=_+@\\/", b"()[]{}\"'`-")
_CLASS = np.zeros(256, np.int64)
for _k, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _k
_CLASS[128:] = len(_CLASSES)
N_CLASSES = len(_CLASSES) + 1
SHARES = ("unlike_last", "distinct", "window", "line", "word_length", "words", "line_words")
DENSE = N_CLASSES + len(SHARES)
FEATURES = DENSE + TRIGRAMS


def _per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.float64)


def _distinct(rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Distinct (row, id) pairs of each row."""
    width = int(ids.max()) + 1 if len(ids) else 1
    return _per_row(np.unique(rows * width + ids) // width, n)


def describe(texts: pa.Array) -> np.ndarray:
    """Features of a group of texts, a row each."""
    n = len(texts)
    blob, ends = b"".join(t.as_py().encode() for t in texts), np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    codes = np.frombuffer(blob, np.uint8)
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, FEATURES), np.float32)
    some = np.maximum(sizes, 1)[:, None]
    out[:, :N_CLASSES] = np.bincount(owner * N_CLASSES + _CLASS[codes], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / some

    words = pc.ascii_split_whitespace(texts)
    rows, flat = np.asarray(pc.list_parent_indices(words)).astype(np.int64), pc.list_flatten(words)
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0), bool)
    rows, flat = rows[filled], flat.filter(pa.array(filled))
    ids = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
    n_words = _per_row(rows, n)
    counted = np.maximum(n_words, 1)
    together = rows[1:] == rows[:-1]
    pair = together & (ids[1:] == ids[:-1])
    windows = rows[2:][together[1:] & together[:-1]]
    keys = _mixed(ids)[together[1:] & together[:-1]] if len(ids) > 2 else np.zeros(0, np.int64)
    lines = pc.split_pattern(texts, "\n")
    line_rows, line_ids = np.asarray(pc.list_parent_indices(lines)).astype(np.int64), np.asarray(pc.list_flatten(lines).dictionary_encode().indices).astype(np.int64)
    n_lines = np.maximum(_per_row(line_rows, n), 1)
    shares = (
        _per_row(rows[1:][pair], n) / counted,
        _distinct(rows, ids, n) / counted,
        1 - _distinct(windows, np.unique(keys, return_inverse=True)[1], n) / np.maximum(_per_row(windows, n), 1),
        1 - _distinct(line_rows, line_ids, n) / n_lines,
        np.minimum(_per_row(rows, n, np.asarray(pc.utf8_length(flat)).astype(np.float64)) / counted, 50) / 10,
        np.log1p(n_words) / 10,
        np.log1p(n_words / n_lines) / 5,
    )
    out[:, N_CLASSES:DENSE] = np.stack(shares, axis=1) * (n_words > 0)[:, None]

    if len(codes) > 2:
        wide = codes.astype(np.uint32)
        hashed = ((wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * _ODD) >> np.uint32(16)
        inside = owner[:-2] == owner[2:]
        at = owner[:-2][inside] * TRIGRAMS + (hashed[inside].astype(np.int64) % TRIGRAMS)
        out[:, DENSE:] = np.sqrt(np.bincount(at, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) / some)
    return out


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A number for each three neighbours."""
    wide = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((wide[:-2] * np.uint64(0xBF58476D1CE4E5B9)) ^ (wide[1:-1] * np.uint64(0x94D049BB133111EB)) ^ (wide[2:] >> np.uint64(7))).view(np.int64)


def groups(texts: pa.Array) -> Iterator[np.ndarray]:
    """Features in slices bounded by bytes and by number; a longer text is a slice of its own."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GROUP_BYTES, "right"))
        end = min(max(end, start + 1), start + GROUP_ROWS)
        yield describe(texts.slice(start, end - start))
        start = end


@dataclass
class Model:
    """Standardisation, weights and bias, and the prior they were fitted for."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    @classmethod
    def unlearned(cls) -> Model:
        return cls(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), np.zeros(FEATURES), 0.0, 0.5)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(((features - self.centre) / self.scale) @ self.weights + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.asarray(z, np.float64) / 2))


def _descend(gradient, features: int, seed: int) -> tuple[np.ndarray, float]:
    """Adam; ``gradient(weights, bias, rng)`` gives that of one batch.  The last quarter of the steps is averaged."""
    rng = np.random.default_rng(seed)
    w = np.zeros(features + 1)
    first, second, mean, n = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), 0
    for t in range(1, STEPS + 1):
        g = gradient(w[:-1], w[-1], rng)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        if 4 * t > 3 * STEPS:
            mean, n = mean + w, n + 1
    return mean[:-1] / n, float(mean[-1] / n)


def _part(x: np.ndarray, d_loss: np.ndarray) -> np.ndarray:
    """Mean gradient of a loss whose derivative by the output is given."""
    return np.append(d_loss @ x, d_loss.sum()) / max(len(x), 1)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Upper bound of the positives' share in the unlabelled by the best cut, from scores that no scorer was fitted on."""
    cuts = np.unique(positive)[::-1]
    q_p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    q_u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    error = np.sqrt(np.log(4 / DELTA) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((q_u + 1.01 * error) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def fit(features: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The classifier of non-negative risk, from rows of features and whether each is a trusted positive, unlabelled, or both."""
    if not positive.any() or not unlabelled.any():
        return Model.unlearned()
    centre, scale = features[unlabelled].mean(axis=0), features[unlabelled].std(axis=0) + 1e-3
    scale[DENSE:] *= np.sqrt(TRIGRAMS / 16)  # all trigrams together weigh like a few shares
    x = (features - centre) / scale
    fold = np.random.default_rng(SEED).permutation(len(x)) % FOLDS

    def taken(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return x[rows[rng.integers(0, len(rows), min(BATCH, len(rows)))]]

    def telling(pos: np.ndarray, unl: np.ndarray):
        def gradient(w: np.ndarray, b: float, rng: np.random.Generator) -> np.ndarray:
            p, u = taken(pos, rng), taken(unl, rng)
            return _part(p, sigmoid(p @ w + b) - 1) + _part(u, sigmoid(u @ w + b)) + np.append(TELLING_DECAY * w, 0.0)

        return gradient

    told = np.zeros(len(x))  # by a scorer that has not seen the row in either role
    for k in range(FOLDS):
        pos, unl = (np.nonzero(kind & ((fold != k) | (kind.sum() < FOLDS)))[0] for kind in (positive, unlabelled))
        if len(pos) and len(unl):
            w, b = _descend(telling(pos, unl), x.shape[1], SEED)
            told[fold == k] = x[fold == k] @ w + b
    prior = class_prior(told[positive], told[unlabelled])
    pos, unl = np.nonzero(positive)[0], np.nonzero(unlabelled)[0]

    def risk(w: np.ndarray, b: float, rng: np.random.Generator) -> np.ndarray:
        p, u = taken(pos, rng), taken(unl, rng)
        f_p, f_u = p @ w + b, u @ w + b
        negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        down = _part(u, sigmoid(f_u)) - prior * _part(p, sigmoid(f_p))
        decay = np.append(DECAY * w, 0.0)
        if negative < -SLACK:
            return decay - down
        return prior * _part(p, sigmoid(f_p) - 1) + down + decay

    w, b = _descend(risk, x.shape[1], SEED + 1)
    return Model(centre, scale, w, b, prior)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _draw(salt: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits from ``doc_id`` and ``text`` of documents and the doc_ids of ``labels`` whose quality is 1.

    Both are taken without the documents that are held out.  The samples are bounded, so one task fits them; texts of
    other documents are not shuffled.
    """
    texts = docs.filter(~held_out()).select("doc_id", "text")
    trusted = labels.filter((F.col("quality") == 1) & ~held_out()).select("doc_id")
    n_trusted, n_texts = trusted.count(), texts.count()
    ids = trusted.filter(_draw(SEED) < POSITIVES / max(n_trusted, 1)).distinct().withColumn("positive", F.lit(True))  # about POSITIVES ids at most
    marked = texts.join(F.broadcast(ids), "doc_id", "left").withColumn("unlabelled", _draw(SEED + 1) < UNLABELLED / max(n_texts, 1))
    sample = marked.filter(F.col("positive") | F.col("unlabelled"))
    one = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.bool_or("positive").alias("positive"), F.first("unlabelled").alias("unlabelled"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [g for g in groups(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))]
            rows = pa.array([x.tobytes() for g in found for x in g], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "positive", "unlabelled")), rows], ["doc_id", "positive", "unlabelled", "features"])

    described = one.mapInArrow(features, T.StructType([*(one.schema[c] for c in ("doc_id", "positive", "unlabelled")), T.StructField("features", T.BinaryType())]))

    def fitted(table: pa.Table) -> pa.Table:
        order = np.argsort([hash_of(i) for i in table.column("doc_id").to_pylist()], kind="stable")
        table = table.take(pa.array(order))
        x = np.frombuffer(b"".join(table.column("features").to_pylist()), np.float32).reshape(-1, FEATURES)
        pos, unl = (np.asarray(pc.fill_null(table.column(c), False), bool) for c in ("positive", "unlabelled"))
        model = fit(x, pos, unl)
        kept = [model.centre, model.scale, model.weights, np.array([model.bias, model.prior])]
        return pa.table({"model": pa.array([b"".join(np.asarray(a, np.float64).tobytes() for a in kept)], pa.binary())})

    rows = described.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "model binary").collect()  # one row
    if not rows:
        return Model.unlearned()
    flat = np.frombuffer(rows[0]["model"], np.float64)
    centre, scale, weights = (flat[j * FEATURES : (j + 1) * FEATURES] for j in range(3))
    return Model(centre.astype(np.float32), scale.astype(np.float32), weights, float(flat[-2]), float(flat[-1]))


def hash_of(doc_id: int | None) -> int:
    """An order of the sample that does not depend on how rows were dealt out."""
    x = (0 if doc_id is None else doc_id) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return x ^ x >> 31


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``score`` of every whole text."""
    names = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            found = [shared.value.scores(g) for g in groups(texts)]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), scores], [*names, "score"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and scores all."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
