"""Toxicity as ordinal severity: cumulative-link regression on sparse features of words and their beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, drop, is_long, mix, save, slices, text_parts, whole, word_hashes, words_of

#: Bits of a feature's hash; a word counts as itself and by its first bytes.
BITS = 40
BEGINNINGS = (4, 6, 8)
#: Labelled rows that a model is fitted on at most (those with the smallest hashes of their ids).
SAMPLE = 12_000
#: Features stay if their share in toxic and other rows differs by this many standard errors.
EVIDENCE = 4.0
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[128:] = False
_NO_LETTER[48:58] = _NO_LETTER[65:91] = _NO_LETTER[97:123] = False


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hashed feature of every word and word beginning; and the number of words of each row."""
    starts, ends, rows = words_of(buf, offsets, _NO_LETTER)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    all_f, all_r = [word_hashes(buf, starts, ends, lower=True)], [rows]
    for size in BEGINNINGS:
        long = ends - starts > size
        all_f.append(mix(word_hashes(buf, starts[long], starts[long] + size, lower=True) + np.uint64(size)))
        all_r.append(rows[long])
    f = (np.concatenate(all_f) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(all_r), f, n


def counted(rows: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with their counts."""
    key, count = np.unique((rows.astype(np.int64) << BITS) | feats, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def tallied(buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with their counts (of features that may be among ids, if given), and the number of words of each row.

    A long text is looked at part by part, and only its distinct features are kept.
    """
    every = [(0, len(buf))] if not is_long(buf, offsets) else list(text_parts(buf, _NO_LETTER))
    rows, feats, counts, n, waiting = [], [], [], np.zeros(len(offsets) - 1, np.int64), 0
    for lo, hi in every:
        r, f, words = features(buf[lo:hi], offsets if len(every) == 1 else np.array([0, hi - lo]))
        n += words
        if ids is not None:
            hint = _hinted(ids, f)
            r, f = r[hint], f[hint]
        r, f, c = counted(r, f)
        rows, feats, counts, waiting = [*rows, r], [*feats, f], [*counts, c], waiting + len(f)
        if waiting > 1 << 20:
            r, f, c = _summed(rows, feats, counts)
            rows, feats, counts, waiting = [r], [f], [c], 0
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, n
    return (*(_summed(rows, feats, counts) if len(rows) > 1 else (rows[0], feats[0], counts[0])), n)


def _summed(rows: list[np.ndarray], feats: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at = np.unique((np.concatenate(rows) << BITS) | np.concatenate(feats), return_inverse=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def places(ids: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Where each feature stands in the rising ids, or -1."""
    if not len(ids):
        return np.full(len(feats), -1, np.int64)
    at = np.minimum(np.searchsorted(ids, feats), len(ids) - 1)
    return np.where(ids[at] == feats, at, -1)


def _hinted(ids: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Features that may be among the ids, by their lowest bits."""
    hint = np.zeros(1 << 16, bool)
    hint[ids & 0xFFFF] = True
    return hint[feats & 0xFFFF]


@dataclass
class Stats:
    """Of each feature, how many toxic and clean rows hold it."""

    ids: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    n1: int
    n0: int


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - theta[k]), theta rising; one w for all thresholds."""

    ids: np.ndarray  # the features that have weights, rising
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def linear(self, rows: np.ndarray, feats: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """w.x of n rows from distinct (row, feature) with counts."""
        at = places(self.ids, feats)
        known = at >= 0
        return np.bincount(rows[known], weights=self.weights[at[known]] * np.log1p(counts[known]), minlength=n)

    def above(self, linear: np.ndarray) -> np.ndarray:
        """Of each row the chances that its grade exceeds 0, 1, ..."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds[None, :], -40, 40)))

    def severity(self, linear: np.ndarray) -> np.ndarray:
        """The expected grade."""
        return self.above(linear).sum(1)


def chosen(stats: Stats) -> np.ndarray:
    """Features that tell toxic rows from others: at least EVIDENCE standard errors apart, in five rows or more."""
    share = (stats.toxic + stats.clean + 1) / (stats.n1 + stats.n0 + 2)
    n1, n0 = max(1, stats.n1), max(1, stats.n0)
    z = (stats.toxic / n1 - stats.clean / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return (np.abs(z) >= EVIDENCE) & (stats.toxic + stats.clean >= 5)


def marking(stats: Stats) -> np.ndarray:
    """Features that at least a hundredth of the toxic rows and hardly any other row holds."""
    n1, n0 = max(1, stats.n1), max(1, stats.n0)
    return (stats.toxic / n1 >= 0.01) & (stats.toxic / n1 > 15 * (stats.clean + 1) / n0)


def telling(n1: int, n0: int) -> Column:
    """chosen() or marking() of columns toxic and clean, for Spark; by a hair wider, so that rounding loses no feature."""
    toxic, clean, a, b = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(max(1, n1)), float(max(1, n0))
    share = (toxic + clean + 1) / (n1 + n0 + 2)
    z = F.abs(toxic / a - clean / b) / F.sqrt(share * (1 - share) * (1 / a + 1 / b))
    evident = (z >= EVIDENCE * (1 - 1e-9)) & (toxic + clean >= 5)
    return evident | ((toxic / a >= 0.01 * (1 - 1e-9)) & (toxic / a > 15 * (clean + 1) / b * (1 - 1e-9)))


def fit(rows: np.ndarray, feats: np.ndarray, counts: np.ndarray, grade: np.ndarray, ids: np.ndarray, steps: int = 400, ridge: float = 2e-5) -> OrdinalModel:
    """Fit thresholds and weights of the features ids[feats] by maximum likelihood (Adam on the whole sample)."""
    n, top = len(grade), int(grade.max(initial=0))
    if not n:
        return OrdinalModel(ids, np.zeros(len(ids)), np.array([40.0]))
    r, f, x = rows, feats, np.log1p(counts)
    k = max(1, top)
    w = np.zeros(len(ids))
    share = np.array([(grade > j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - share) / share)
    raw = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])  # rising thresholds
    params, m, v = np.concatenate([w, raw]), 0.0, 0.0
    for step in range(1, steps + 1):
        w, raw = params[: len(ids)], params[len(ids) :]
        gaps = np.exp(raw[1:])
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(r, weights=w[f] * x, minlength=n)
        s = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -40, 40))), np.zeros(n)])
        p = np.maximum(s[np.arange(n), grade] - s[np.arange(n), grade + 1], 1e-9)
        slope = s * (1 - s)
        g_eta = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p / n
        g_theta = np.zeros(k)
        for j in range(k):
            g_theta[j] = (-(slope[:, j + 1] / p)[grade == j].sum() + (slope[:, j + 1] / p)[grade == j + 1].sum()) / n
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(f, weights=x * g_eta[r], minlength=len(ids)) + ridge * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - 0.15 * (0.1 ** (step / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    w, raw = params[: len(ids)], params[len(ids) :]
    return OrdinalModel(ids, w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]))


def grades(hits: np.ndarray, toxic: np.ndarray, levels: int = 3) -> np.ndarray:
    """Severity grades from 0/1 labels: 0, or for toxic rows 1 to `levels` by how many marking features they hold."""
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        cuts = np.quantile(hits[toxic > 0], np.arange(1, levels) / levels)
        out[toxic > 0] = 1 + np.searchsorted(cuts, hits[toxic > 0], "right")
    return out


def calibrated(severity: np.ndarray, toxic: np.ndarray, weight: float = 2.0) -> float:
    """The expected severity at which rejecting loses least: a clean row rejected costs `weight` missed toxic rows."""
    order = np.argsort(-severity, kind="stable")
    gain = np.cumsum(np.where(toxic[order] > 0, 1.0, -weight))
    if not len(gain) or gain.max() <= 0:
        return np.inf
    best = len(gain) - 1 - int(gain[::-1].argmax())
    upper = severity[order[best]]
    lower = severity[order[best + 1]] if best + 1 < len(order) else 0.0
    return float((upper + lower) / 2)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean rows hold each feature, slice by slice."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        buf, offsets = byte_view(batch.column(2))
        for lo, hi in slices(offsets):
            r, f, *_ = tallied(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            ids, at = np.unique(f, return_inverse=True)
            bad = np.bincount(at, weights=toxic[lo + r], minlength=len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bad), pa.array(np.bincount(at, minlength=len(ids)) - bad)], ["feature", "toxic", "clean"])


def _known(ids: np.ndarray):
    """Each row's counts of the features in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_view(batch.column(2))
            for lo, hi in slices(offsets):
                r, f, c, _ = tallied(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids)
                at = places(ids, f)
                r, at, c = r[at >= 0], at[at >= 0], c[at >= 0]
                cut = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (at, c)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *lists], ["id", "toxic", "feats", "counts"])

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, levels: int = 3, folds: int = 4) -> OrdinalModel:
    """Fit on at most `sample` labelled rows (smallest id hashes). The cut is calibrated on scores of rows left out in turn.

    The driver gets the features that tell the classes apart and the sample's counts of them, never texts.
    """
    rated = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    rated = rated.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = save(docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(rated), "id").select("id", "toxic", "text"), "rated")
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    held = rows.mapInArrow(_held, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 5")
    table = held.where(telling(n1, n - n1)).orderBy("feature").toArrow()
    stats = Stats(*(table[c].to_numpy() for c in ("feature", "toxic", "clean")), n1, n - n1)
    use = chosen(stats) | marking(stats)
    ids, good, mark = stats.ids[use], chosen(stats)[use], marking(stats)[use]
    table = rows.mapInArrow(_known(ids), "id long, toxic int, feats array<int>, counts array<int>").toArrow().combine_chunks().sort_by("id")
    drop(rows)
    toxic = table["toxic"].to_numpy()
    sizes = np.array(table["feats"].combine_chunks().value_lengths()) if len(table) else np.zeros(0, np.int64)
    r = np.repeat(np.arange(len(toxic)), sizes)
    f, c = (np.asarray(table[x].combine_chunks().flatten(), np.int64) if len(table) else np.zeros(0, np.int64) for x in ("feats", "counts"))
    grade = grades(np.bincount(r[mark[f]], weights=c[mark[f]], minlength=len(toxic)), toxic, levels)
    renumber = np.cumsum(good) - 1
    r, f, c, ids = r[good[f]], renumber[f[good[f]]], c[good[f]], ids[good]
    model = fit(r, f, c, grade, ids)
    out = np.zeros(len(toxic))
    for k in range(folds if len(toxic) >= 50 else 0):
        out_of = np.arange(len(toxic)) % folds == k
        here = ~out_of[r]
        part = fit((np.cumsum(~out_of) - 1)[r[here]], f[here], c[here], grade[~out_of], ids)
        eta = np.bincount(r, weights=part.weights[f] * np.log1p(c), minlength=len(toxic))
        out[out_of] = part.severity(eta)[out_of]
    if len(toxic) < 50:
        out = model.severity(np.bincount(r, weights=model.weights[f] * np.log1p(c), minlength=len(toxic)))
    model.cut = calibrated(out, toxic)
    return model


def _scored(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_view(batch.column(1))
            for lo, hi in slices(offsets):
                r, f, c, n = tallied(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model.ids)
                eta = model.linear(r, f, c, len(n))
                above = model.above(eta)
                severity = above.sum(1)
                chances = np.concatenate([np.ones((len(eta), 1)), above, np.zeros((len(eta), 1))], axis=1)
                grade = (chances[:, :-1] - chances[:, 1:]).argmax(1)
                reject = (severity >= model.cut) & (n > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(severity), pa.array(grade, pa.int32()), pa.array(reject)], ["id", "severity", "grade", "toxic"])

    return run


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of docs: (id, severity, grade, toxic): expected grade, likeliest grade, and the verdict at the model's cut.

    Whole texts are read, one pass, no shuffle; the model is a fixed-size table of weights. Null and empty texts, and
    texts without a word, are never toxic. Null ids are scored like others, repeated rows each; equal severities have
    equal verdicts, the cut itself is toxic. A very long text is looked at part by part. An empty table gives an empty
    table; other columns are not looked at. A model fitted without labels calls nothing toxic.
    """
    out = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_scored(model), "id long, severity double, grade int, toxic boolean")
    return out.withColumnRenamed("id", id)


def without_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score() doesn't call toxic. One pass, no shuffle; nulls, repeats and empty tables as there."""
    judged, at = _scored(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(0).field(at)], ["id", "text"])
            parts = [b.column(3) for b in judged(iter([scored]))]
            if parts:
                yield batch.filter(pc.invert(pa.concat_arrays(parts)))

    rows = docs.select(whole(docs).alias("doc"))
    return rows.mapInArrow(run, rows.schema).select("doc.*")
