"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear scorer that
minimises the non-negative unbiased risk

    prior * risk(positives as 1)
      + max(0, risk(unlabelled as 0) - prior * risk(positives as 0))

with the logistic loss; where the second term would fall below zero, the step
goes against it.  The class prior is estimated as the share of good labels
among all labels of the training rows; labels of bad texts are used for
nothing else.

Features: shares of byte classes, length, and square roots of the shares of
hashed byte trigrams of the lower-cased text, with their concentration, and
the share of words that repeat the word before.

The fit takes at most ``sample`` positives and ``sample`` unlabelled rows,
chosen by a hash of their id.  Scores read every whole text.

Defined results: a null text is empty; an empty text is scored by its length
feature alone; repeated labels of a document count each; with no positives
the model is the prior; repeated rows are scored alike; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import Hashed

SAMPLE = 8_000
BUCKETS = 512
STEPS = 400
RATE = 0.02
DECAY = 1e-4
THRESHOLD = 0.3
SLICE_BYTES = 1 << 20


def _class_of(b: int) -> int:
    c = chr(b)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r",
              ".,;:", "!?", "'\"-", "|", "#$%&*", "<>{}[]()/\\=+_~^`@"]
    return next((i for i, g in enumerate(groups) if c in g), 12 if b < 128 else 13)


CLASS = np.array([_class_of(b) for b in range(256)], np.int64)
CLASSES = 14
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)
BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
WIDTH = CLASSES + 3 + BUCKETS


def features(texts: list[bytes]) -> np.ndarray:
    """A row of WIDTH numbers per text."""
    m = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts) + b"\0\0", np.uint8)
    n = int(sizes.sum())
    owner = np.repeat(np.arange(m), sizes)
    out = np.zeros((m, WIDTH), np.float32)
    shares = np.bincount(owner * CLASSES + CLASS[raw[:n]], minlength=m * CLASSES).reshape(m, CLASSES)
    out[:, :CLASSES] = shares / np.maximum(sizes, 1)[:, None]
    out[:, CLASSES] = np.log1p(sizes) / 10
    low = LOWER[raw]
    gram = (low[:n] << np.uint32(16)) | (low[1:n + 1] << np.uint32(8)) | low[2:n + 2]
    inside = np.arange(n) + 3 <= np.cumsum(sizes)[owner]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(23)).astype(np.int64) % BUCKETS
    counts = np.bincount((owner * BUCKETS + bucket)[inside], minlength=m * BUCKETS).reshape(m, BUCKETS)
    share = counts / np.maximum(counts.sum(axis=1), 1)[:, None]
    out[:, CLASSES + 1] = (share ** 2).sum(axis=1) * 10
    out[:, CLASSES + 2] = repeated_words(raw[:n], owner, m)
    out[:, CLASSES + 3:] = np.sqrt(share)
    return out


def repeated_words(raw: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """The share of each text's words that equal the word before."""
    inner = ~BLANK[raw]
    new = np.r_[True, owner[1:] != owner[:-1]] if len(raw) else np.zeros(0, bool)
    start = np.flatnonzero(inner & (new | np.r_[True, ~inner[:-1]][:len(raw)]))
    end = np.flatnonzero(inner & np.r_[new[1:] | ~inner[1:], [True] * bool(len(raw))].astype(bool)) + 1
    word, doc = Hashed(raw).of(start, end), owner[start]
    same = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][same], minlength=m) / np.maximum(np.bincount(doc, minlength=m), 1)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    texts, out, start, held = batch.column(column).cast(pa.binary()), [], 0, 0
    for i in range(batch.num_rows):
        out.append(texts[i].as_py() or b"")
        held += len(out[-1])
        if held >= SLICE_BYTES:
            yield start, out
            out, start, held = [], i + 1, 0
    if out:
        yield start, out


class Model:
    """Linear scorer over standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) * self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE,
           decay: float = DECAY) -> Model:
    """Minimise the non-negative risk by Adam on the whole sample."""
    everything = np.concatenate([positive, unlabelled])
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), np.zeros(WIDTH, np.float32),
                     float(np.log(p / (1 - p))))
    mean = everything.mean(axis=0)
    scale = (1 / (everything.std(axis=0) + 1e-3)).astype(np.float32)
    del everything
    xp, xu = (positive - mean) * scale, (unlabelled - mean) * scale
    w, b = np.zeros(WIDTH, np.float32), 0.0
    m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) for x in (xp, xu))
        # d log(1 + exp(-z)) = s - 1, d log(1 + exp(z)) = s
        risk = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        below = np.r_[xu.T @ su / len(su) - prior * (xp.T @ sp) / len(sp), su.mean() - prior * sp.mean()]
        above = np.r_[prior * (xp.T @ (sp - 1)) / len(sp), prior * (sp - 1).mean()]
        gradient = above + below if risk >= 0 else -below
        gradient[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), float(b - step[-1])
    return Model(mean, scale, w, b)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in _slices(batch, 1):
            rows = features(texts)
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), WIDTH).cast(pa.list_(pa.float32()))
            yield pa.record_batch([batch.column(0).slice(start, len(texts)), values], names=["positive", "x"])


def _sampled(rows: DataFrame, size: int, limit: int) -> DataFrame:
    """A share of the hash range of doc_id that holds about ``limit`` rows."""
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(unit < min(1.0, limit / max(size, 1)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, quality)."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality")).where(
        "doc_id is not null and quality is not null")
    own = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    good, bad = own.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") != 1)).first()
    prior = good / max(good + bad, 1) if good else 0.5
    ids = _sampled(own.where("quality = 1"), good, sample).select("doc_id")
    positives = docs.join(ids, "doc_id").select(F.lit(True).alias("positive"), "text")
    unlabelled = _sampled(docs, docs.count(), sample).select(F.lit(False).alias("positive"), "text")
    rows = positives.unionByName(unlabelled).mapInArrow(_feature_rows, "positive boolean, x array<float>").toArrow()
    if not rows.num_rows:
        return fit_pu(np.zeros((0, WIDTH), np.float32), np.zeros((0, WIDTH), np.float32), prior)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    positive = rows["positive"].combine_chunks().to_numpy(zero_copy_only=False)
    return fit_pu(x[positive], x[~positive], prior)


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        scores = [model.scores(features(texts)) for _, texts in _slices(batch, 1)]
        yield pa.record_batch([batch.column(0), pa.array(np.concatenate(scores or [np.zeros(0)]).astype(np.float64))],
                              names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _scored(it, shared),
                           f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id, folds: int = 5, fold: int = 0):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
