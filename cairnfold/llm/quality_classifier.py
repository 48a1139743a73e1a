"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, a linear hinge-loss model on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, byte_view, drop, is_long, likely, mix, save, slices, text_parts, word_hashes, words_of

#: Hashed n-gram indicators.
DIMENSIONS = 1 << 18
#: Labelled rows that the linear model is fitted on at most (smallest hashes of their ids); counts use all of them.
SAMPLE = 8_000
_CLASS = np.full(256, 3, np.uint64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 0
_SALT = [mix(np.full(1, i, np.uint64))[0] for i in range(1, 6)]


def indicators(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of the distinct n-grams of each row: words, word pairs, word endings, shapes and shape triples.

    A word's shape is the kind of its first and last byte, its length up to 15, and whether it repeats the word before.
    """
    if is_long(buf, offsets):
        held, tail = np.zeros(DIMENSIONS, bool), 0
        for _, hi in text_parts(buf):  # each part begins with the last three words before it, the first of which is only looked back at
            starts, ends, _ = words_of(buf[tail:hi], np.array([0, hi - tail]))
            held[_indicators(buf[tail:hi], starts, ends, np.zeros(len(starts), np.int32), int(tail > 0))[1]] = True
            tail += int(starts[-3]) if len(starts) >= 3 else 0
        f = np.flatnonzero(held)
        return np.zeros(len(f), np.int64), f
    rows, feats = _indicators(buf, *words_of(buf, offsets))
    if not len(rows):
        return rows, feats
    key = rows * DIMENSIONS + feats
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key // DIMENSIONS, key % DIMENSIONS


def _indicators(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every n-gram; of the first `skip` words only what comes behind them counts."""
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z
    words = word_hashes(buf, starts, ends)
    same_row = rows[1:] == rows[:-1]
    again = np.concatenate([[False], same_row & (words[1:] == words[:-1])])
    shape = (_CLASS[buf[starts]] << np.uint64(8)) | (_CLASS[buf[ends - 1]] << np.uint64(6)) | (np.minimum(ends - starts, 15).astype(np.uint64) << np.uint64(1)) | again.astype(np.uint64)
    shape = mix(shape + _SALT[0])
    tail = np.maximum(starts, ends - 3)
    feats = [words[skip:], mix(word_hashes(buf, tail, ends) + _SALT[1])[skip:], shape[skip:]]
    where = [rows[skip:], rows[skip:], rows[skip:]]
    feats.append(mix(words[:-1] * _SALT[2] + words[1:])[same_row])
    where.append(rows[1:][same_row])
    if len(rows) > 2:
        three = rows[2:] == rows[:-2]
        feats.append(mix(mix(shape[:-2] * _SALT[3] + shape[1:-1]) * _SALT[4] + shape[2:])[three][skip:])
        where.append(rows[2:][three][skip:])
    return np.concatenate(where).astype(np.int64), (np.concatenate(feats) >> np.uint64(46)).astype(np.int64)


def log_count_ratios(good: np.ndarray, bad: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = good + alpha, bad + alpha
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for L2-regularised hinge loss; y is +1/-1; row i has value values[f] at each feature f in rows[i].

    Each row is scaled to unit length, so that long texts weigh no more than short ones. The bias is a feature of 1.
    """
    w, bias = np.zeros(DIMENSIONS), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([max(float(np.sqrt((values[f] ** 2).sum())), 1e-9) for f in rows])
    counts = np.array([(y > 0).sum(), (y < 0).sum()])
    limit = np.where(y > 0, cost * len(y) / (2 * max(1, counts[0])), cost * len(y) / (2 * max(1, counts[1])))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            x = values[f] / norms[i]
            g = y[i] * (w[f] @ x + bias) - 1
            old = alpha[i]
            new = min(max(old - g / 2.0, 0.0), limit[i])  # |x| ** 2 + 1 is 2
            if new != old:
                alpha[i] = new
                step = (new - old) * y[i]
                w[f] += step * x
                bias += step
                worst = max(worst, abs(new - old))
        if worst < 1e-3:
            break
    return w, bias


def platt(margin: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of P(good) = sigmoid(a * margin + b), by Newton steps on smoothed targets."""
    n1, n0 = float((good > 0).sum()), float((good == 0).sum())
    target = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return max(float(a), 1e-3), float(b)


@dataclass
class QualityModel:
    values: np.ndarray  # log-count ratios
    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def margins(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        x = self.values[feats]
        norm = np.sqrt(np.bincount(rows, weights=x * x, minlength=n))
        return np.bincount(rows, weights=x * self.weights[feats], minlength=n) / np.maximum(norm, 1e-9) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this task's rows, how many good and bad ones hold each feature."""
    total = np.zeros((2, DIMENSIONS), np.int64)
    for batch in batches:
        label = batch.column(0).to_numpy()
        buf, offsets = byte_view(batch.column(1))
        for lo, hi in slices(offsets):
            r, f = indicators(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for c in (0, 1):
                total[c] += np.bincount(f[label[lo + r] == c], minlength=DIMENSIONS)
    at = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], ["feature", "good", "bad"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = byte_view(batch.column(2))
        for lo, hi in slices(offsets):
            r, f = indicators(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            at = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array(f, pa.int32()))], ["id", "label", "feats"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Counts over all labelled rows (1 good, 0 bad); the linear model on at most `sample`, a fifth of it first kept for calibration."""
    rated = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).cast("long").alias("id")).agg(F.min(label).cast("int").alias("label"))
    own = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    # labels grow with the corpus, so both sides are dealt by id at every size; a bitmap keeps most texts without a label back
    rated = save(rated, "rated")
    bits = bitmap(rated.select(F.xxhash64("id")))
    counts = likely(own, F.xxhash64("id"), bits).join(rated.hint("merge"), "id").select("label", "text").mapInArrow(_counts, "feature long, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    good, bad = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    if len(counts):
        at = counts["feature"].to_numpy()
        good[at], bad[at] = counts["good"].to_numpy(), counts["bad"].to_numpy()
    values = log_count_ratios(good, bad)
    some = rated.orderBy(F.xxhash64("id"), "id").limit(sample)
    table = own.join(F.broadcast(some), "id").select("id", "label", "text").mapInArrow(_rows, "id long, label int, feats array<int>").toArrow().sort_by("id")
    drop(rated, bits)
    y = np.where(table["label"].to_numpy() > 0, 1.0, -1.0) if len(table) else np.zeros(0)
    lists = table["feats"].combine_chunks()
    rows = [np.asarray(x.values) for x in lists]
    if not len(rows) or (y > 0).all() or (y < 0).all():
        share = float((y > 0).mean()) if len(rows) else 0.5
        return QualityModel(values, np.zeros(DIMENSIONS), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    margin = np.zeros(len(rows))
    held = np.arange(len(rows)) % 5 == 0
    w, bias = dual_descent([r for r, h in zip(rows, held) if not h], values, y[~held])
    part = QualityModel(values, w, bias)
    for i in np.flatnonzero(held):
        margin[i] = part.margins(np.zeros(len(rows[i]), np.int64), rows[i], 1)[0]
    a, b = platt(margin[held], (y[held] > 0).astype(int))
    w, bias = dual_descent(rows, values, y)
    return QualityModel(values, w, bias, a, b)


def _scored(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_view(batch.column(1))
            for lo, hi in slices(offsets):
                r, f = indicators(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.probability(model.margins(r, f, hi - lo)))], ["id", "score"])

    return run


def classify(docs: DataFrame, model: QualityModel, text: str = "text", id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: (id, score, predicted): the chance of good quality, and whether it reaches the threshold.

    Only the text is looked at, all of it, in one pass without a shuffle. Null and empty texts get the score of a text
    without any indicator. Null ids and repeated rows are scored like others; very long texts part by part; an empty
    table gives an empty table. Without labels of both kinds every score is the share of good labels (a half without any).
    """
    out = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_scored(model), "id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id)
