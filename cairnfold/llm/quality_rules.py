"""Quality rules: exact text statistics, base rules, and an isolation forest over the statistics' ratios.

Every labelled row takes part in the fit: each tree's rows are drawn from all of them, and all of them set the threshold.
Only the rows drawn, as many as the trees hold, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_BLANK, SLICE_BYTES, byte_view, hashed_words, is_long, mix, save, shingle_hashes, slices, text_parts, to_long, word_hashes

TREES = 200
#: Rows that one tree is grown on.
SUBSAMPLE = 512
#: Share of rows labelled good that the forest may reject.
LOSS = 0.005
#: Share of bad rows among those that trees are grown on: anomalies must be few there to be isolated early.
FEW = 0.005
WINDOW = 5
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LEAD = np.ones(256, np.int64)
_LEAD[0x80:0xC0] = 0  # not the bytes that continue a character
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_bytes"]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values over each row of bytes."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each line that holds a word, and its row."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, offsets[:-1]]))
    a = a[a < len(buf)]
    after = np.append(a[1:], len(buf))
    b = np.where(buf[after - 1] == 10, after - 1, after)
    row = np.searchsorted(offsets, a, "right") - 1
    with_word = np.logical_or.reduceat(~IS_BLANK[buf], a)  # a line end is blank
    a, b, row = a[with_word], b[with_word], row[with_word]
    return word_hashes(buf, a, b), row


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are in a window that begins at one of the places."""
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n] - np.bincount(starts + WINDOW, minlength=n + 1)[:n]) > 0


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row the STATISTICS, as integers."""
    if is_long(buf, offsets):
        return _of_long_text(buf)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)), np.int64)
    words, rows = hashed_words(buf, offsets)
    out[:, 0] = np.bincount(rows, minlength=n)
    if not len(buf):
        return out
    out[:, 1] = _sums(_LEAD[buf] * ~IS_BLANK[buf], offsets)
    out[:, 2], out[:, 6], out[:, 7], out[:, 8] = _sums(_SYMBOL[buf], offsets), _sums(_UPPER[buf], offsets), _sums(_MARK[buf], offsets), np.diff(offsets)
    # lines that hold a word, and those of them that equal an earlier one
    line, line_row = _lines(buf, offsets)
    if len(line):
        out[:, 5] = np.bincount(line_row, minlength=n)
        _, first = np.unique(mix(line + line_row.astype(np.uint64) * _STEP), return_index=True)
        out[:, 3] = out[:, 5] - np.bincount(line_row[first], minlength=n)
    # words in windows that the text holds twice or more
    if len(words) >= WINDOW:
        h, r = shingle_hashes(words, rows, n, WINDOW)
        full = out[r, 0] >= WINDOW
        h, r = h[full], r[full]
        if len(h):
            at = np.flatnonzero(rows[WINDOW - 1 :] == rows[: len(rows) - WINDOW + 1])
            _, inverse, count = np.unique(mix(h + r.astype(np.uint64) * _STEP), return_inverse=True, return_counts=True)
            out[:, 4] = np.bincount(rows[_covered(at[count[inverse] > 1], len(words))], minlength=n)
    return out


def _of_long_text(buf: np.ndarray) -> np.ndarray:
    """The STATISTICS of one text, looked at part by part; only hashes of its words and lines are held at once."""
    out = np.zeros(len(STATISTICS), np.int64)
    for lo in range(0, len(buf), SLICE_BYTES):
        part = buf[lo : lo + SLICE_BYTES]
        out[[1, 2, 6, 7]] += [(_LEAD[part] * ~IS_BLANK[part]).sum(), _SYMBOL[part].sum(), _UPPER[part].sum(), _MARK[part].sum()]
    lines = np.concatenate([_lines(buf[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in text_parts(buf, _LINE_END)])
    out[5], out[8] = len(lines), len(buf)
    out[3] = len(lines) - len(np.unique(lines))
    words, rows = hashed_words(buf, np.array([0, len(buf)]))
    out[0] = len(words)
    if len(words) >= WINDOW:
        h, _ = shingle_hashes(words, rows, 1, WINDOW)
        order = np.argsort(h)
        h = h[order]
        same = h[1:] == h[:-1]
        out[4] = _covered(order[np.append(same, False) | np.append(False, same)], len(words)).sum()
    return out[None, :]


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forest sees: logarithms of shares and means, which don't grow with the text."""
    words, chars, lines, size = (np.maximum(stats[:, i], 1) for i in (0, 1, 5, 8))
    shares = np.column_stack([stats[:, 1] / words, stats[:, 2] / words, stats[:, 3] / lines, stats[:, 4] / words, stats[:, 6] / chars, stats[:, 7] / words, chars / size])
    return np.log1p(100 * shares)


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 at leaves
    split: np.ndarray
    depth: np.ndarray  # path length at leaves, with what an unbuilt subtree would add
    size: int
    cut: float = math.inf
    used: np.ndarray | None = None  # trees x size: the rows each tree was grown on

    def score(self, x: np.ndarray, apart: np.ndarray | None = None, seen: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
        """Anomaly of each row: 2 ** (-mean path length / that of a random tree), 0 to 1.

        With apart, the number of each row among those that the trees were grown on (-1: none), or seen, which tells of
        a tree which rows it was grown on, only trees that did not see the row count.
        """
        if apart is not None:
            seen = lambda t: np.isin(apart, self.used[t])
        total, trees = np.zeros(len(x)), np.zeros(len(x))
        every = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(self.feature.shape[1] + 1)) - 1):
                f = self.feature[t, node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[every, np.maximum(f, 0)] >= self.split[t, node]), node)
            count = 1.0 if seen is None else ~seen(t)
            total += self.depth[t, node] * count
            trees += count
        return 2.0 ** (-total / np.maximum(trees, 1) / max(_expected(self.size), 1e-9))


def _expected(n: int) -> float:
    """The mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grown(drawn: Iterator[tuple[np.ndarray, np.random.Generator]], trees: int, size: int) -> Forest:
    """Trees of random splits, each on its own rows (at most `size`)."""
    top = max(1, math.ceil(math.log2(max(size, 2))))
    nodes = 2 ** (top + 1) - 1
    feature, split, depth = np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t, (own, rng) in enumerate(drawn):
        todo = [(0, 0, own)]
        while todo:
            node, level, rows = todo.pop()
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
            if level == top or len(rows) <= 1 or not len(spread):
                depth[t, node] = level + _expected(len(rows))
                continue
            f = int(rng.choice(spread))
            at = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[t, node], split[t, node] = f, at
            right = rows[:, f] >= at
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return Forest(feature, split, depth, size)


def grow(x: np.ndarray, trees: int = TREES, size: int = SUBSAMPLE, seed: int = 7) -> Forest:
    """Trees of random splits on random subsamples."""
    size = min(size, len(x))
    rngs = [np.random.default_rng([seed, t]) for t in range(trees if len(x) else 0)]
    used = np.zeros((trees, size), np.int64)
    for t, rng in enumerate(rngs):
        used[t] = rng.choice(len(x), size, replace=False)
    forest = _grown(((x[rows], rng) for rows, rng in zip(used, rngs)), trees, size)
    forest.used = used
    return forest


def calibrated(score: np.ndarray, good: np.ndarray, loss: float = LOSS) -> float:
    """The cut that rejects most rows labelled bad less rows labelled good, rejecting at most `loss` of the good."""
    order = np.argsort(-score, kind="stable")
    bad_hit, good_hit = np.cumsum(good[order] == 0), np.cumsum(good[order] > 0)
    gain = np.where(good_hit <= loss * max(1, int((good > 0).sum())), bad_hit - good_hit, -1)
    last = np.append(score[order][1:] < score[order][:-1], True)
    gain = np.where(last, gain, -1)
    if not len(gain) or gain.max() <= 0:
        return math.inf
    best = int(gain.argmax())
    below = score[order[best + 1]] if best + 1 < len(order) else 0.0
    return float((score[order[best]] + below) / 2)


def best_cut(scored: DataFrame, loss: float = LOSS) -> float:
    """calibrated() of a table (score, good 0 or 1) of any size: running sums within ranges of scores, carried on from range to range."""
    counts = scored.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    counts = save(counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "scores")
    parts = sorted(counts.groupBy("part").agg(F.max("score"), F.sum("good"), F.sum("bad")).collect(), key=lambda r: -r[1])
    before = [(0, 0)]
    for _, _, good, bad in parts:
        before.append((before[-1][0] + good, before[-1][1] + bad))
    if not before[-1][0]:
        return math.inf
    after = [r[1] for r in parts[1:]] + [0.0]
    starts = scored.sparkSession.createDataFrame([(r[0], *sums, x) for r, sums, x in zip(parts, before, after)], "part int, good_before long, bad_before long, after double")
    w = Window.partitionBy("part").orderBy(F.desc("score"))
    rows = counts.join(F.broadcast(starts), "part").select("score", F.coalesce(F.lead("score").over(w), "after").alias("below"), (F.sum("good").over(w) + F.col("good_before")).alias("good"), (F.sum("bad").over(w) + F.col("bad_before")).alias("bad"))
    best = rows.where(F.col("good") <= loss * before[-1][0]).agg(F.max(F.struct((F.col("bad") - F.col("good")).alias("gain"), "score", "below"))).first()[0]
    return (best["score"] + best["below"]) / 2 if best is not None and best["gain"] > 0 else math.inf


def _counted(columns: list[pa.Array]) -> np.ndarray:
    return np.column_stack([c.to_numpy() for c in columns])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = byte_view(batch.column(1))
        for lo, hi in slices(offsets):
            s = statistics(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in s.T)], ["id", *STATISTICS])


def measured(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The STATISTICS of each row of docs as a written table (id, ...): fit() and judged() read it, no text is looked at twice."""
    return save(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_measured, "id long, " + ", ".join(f"{c} long" for c in STATISTICS)), "statistics")


_FEATURES = [f"x{i}" for i in range(7)]


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, good, x0, ...) of rows that pass the base rules."""
    for batch in batches:
        s = _counted(batch.columns[2:])
        passed = ~base_failed(s)
        key = mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(to_long(key[passed])), pa.array((batch.column(1).to_numpy() > 0)[passed].astype(np.int32)), *(pa.array(c) for c in ratios(s)[passed].T)], ["key", "good", *_FEATURES])


def _lot(key: np.ndarray, number: int) -> np.ndarray:
    """A number of each row for one draw: the rows with the smallest ones are drawn."""
    return mix(key ^ mix(np.array([number + 1], np.uint64)))


def _inside(key: np.ndarray, good: np.ndarray, few: int) -> np.ndarray:
    """Which rows trees may be grown on: the good, and bad ones whose lot is up to `few`."""
    return (good > 0) | (_lot(key, TREES) <= np.uint64(few))


def _drawn(few: int, most: int):
    """(tree, lot, x0, ...) of rows that may be among those drawn for a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, x = batch.column(0).to_numpy().view(np.uint64), _counted(batch.columns[2:])
            inside = _inside(key, batch.column(1).to_numpy(), few)
            key, x = key[inside], x[inside]
            for t in range(TREES):
                lot = _lot(key, t)
                at = np.flatnonzero(lot <= np.uint64(most))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(to_long(lot[at])), *(pa.array(c) for c in x[at].T)], ["tree", "lot", *_FEATURES])

    return run


def _scored(forest: Forest, few: int, last: np.ndarray):
    """(score, good) of rows, each by the trees that it was not drawn for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, good = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            inside = _inside(key, good, few)
            score = forest.score(_counted(batch.columns[2:]), seen=lambda t: inside & (_lot(key, t) <= last[t]))
            yield pa.RecordBatch.from_arrays([pa.array(score), batch.column(1)], ["score", "good"])

    return run


def fit(stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Forest:
    """A forest from all labelled rows of measured(): each tree grown on SUBSAMPLE rows drawn from all good and a few bad ones, the threshold set by all, each scored by the trees that it was not drawn for."""
    rated = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.min(label).cast("int").alias("label"))
    rows = save(stats.join(rated, "id").select("id", "label", *STATISTICS).mapInArrow(_rated, "key long, good int, " + ", ".join(f"{x} double" for x in _FEATURES)), "rated")
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    # of the bad as many as FEW says, by their lots: about, but one at least would be drawn from a single one too
    few = min(2**64 - 1, int(2**64 * max(1, int(FEW * good)) / max(1, n - good)))
    inside = good + min(n - good, max(1, int(FEW * good)))
    most = min(2**64 - 1, int(2**64 * (1.5 * SUBSAMPLE + 64) / max(1, inside)))
    table = rows.mapInArrow(_drawn(few, most), "tree int, lot long, " + ", ".join(f"{x} double" for x in _FEATURES)).toArrow()
    tree, lot, x = table["tree"].to_numpy(), table["lot"].to_numpy().view(np.uint64), _counted([table[c] for c in _FEATURES])
    order = np.lexsort((*x.T, lot, tree))
    cuts = np.searchsorted(tree[order], np.arange(TREES + 1))
    own = [order[a:b][:SUBSAMPLE] for a, b in zip(cuts[:-1], cuts[1:])]
    size = max(map(len, own))
    forest = _grown(((x[rows_], np.random.default_rng([7, t])) for t, rows_ in enumerate(own) if size), TREES, size)
    last = np.array([lot[r[-1]] if len(r) else 0 for r in own], np.uint64)
    if good:
        forest.cut = best_cut(rows.mapInArrow(_scored(forest, few, last), "score double, good int"))
    return forest


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality") -> Forest:
    """fit() of a table with texts."""
    return fit(measured(docs, text, id), labels, id, label)


def _verdicts(ids: pa.Array, s: np.ndarray, forest: Forest | None) -> pa.RecordBatch:
    failed = base_failed(s)
    out = [ids, *(pa.array(c) for c in s[:, :5].T), pa.array(failed)]
    if forest is not None:
        anomaly = forest.score(ratios(s))
        out += [pa.array(anomaly), pa.array(~failed & (anomaly < forest.cut))]
    return pa.RecordBatch.from_arrays(out, ["id", *STATISTICS[:5], "base_failed", "anomaly", "kept"][: len(out)])


def _judged(forest: Forest | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _measured(batches):
            yield _verdicts(batch.column(0), _counted(batch.columns[1:]), forest)

    return run


def _judged_again(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _verdicts(batch.column(0), _counted(batch.columns[1:]), forest)

    return run


_BASE = "id long, " + ", ".join(f"{c} long" for c in STATISTICS[:5]) + ", base_failed boolean"


def judged(stats: DataFrame, forest: Forest, id: str = "doc_id") -> DataFrame:
    """judge() of rows that measured() has looked at."""
    return stats.mapInArrow(_judged_again(forest), _BASE + ", anomaly double, kept boolean").withColumnRenamed("id", id)


def measure(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of docs with the statistics and the base rules alone, as in judge()."""
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_judged(None), _BASE).withColumnRenamed("id", id)


def judge(docs: DataFrame, forest: Forest, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of docs: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept).

    A base rule fails below 10 words, or with more than a fifth of the words in repeated 5-word windows; then the
    forest rejects rows as anomalous as its cut (ties with the cut go). Lines and windows are compared by 64-bit hashes
    of their bytes. Null or empty text has no words and fails. Null ids and repeated rows are judged like others; an
    empty table gives an empty table; other columns are not looked at. Without labels the forest rejects nothing. One
    pass, no shuffle, whole texts; of a very long one only hashes of its words and lines are held at once.
    """
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_judged(forest), _BASE + ", anomaly double, kept boolean").withColumnRenamed("id", id)
