"""The trained operators against dense re-computation, and on rows that they were not fitted on."""

import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfold.llm import quality_classifier as nb
from cairnfold.llm import quality_rules as rules
from cairnfold.llm import toxicity as tox

DATA = "/root/testdata/sf0.01"


def view(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def test_path_lengths_by_walking_every_tree():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (300, 7)), rng.normal(4, 2, (9, 7)), np.zeros((5, 7))])
    forest = rules.grow(x, trees=30, size=64)

    def walk(t, row, node=0, depth=0):
        f = forest.feature[t, node]
        if f < 0:
            return depth, node
        return walk(t, row, 2 * node + (2 if row[f] >= forest.split[t, node] else 1), depth + 1)

    def reached(t, node):
        return sum(walk(t, x[i])[1] == node for i in forest.used[t])

    def mean_search(n):  # the average depth of a leaf in a random binary search tree of n keys
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    apart = np.arange(len(x))
    all_trees, others = [], []
    for i, row in enumerate(x):
        lengths = []
        for t in range(30):
            depth, leaf = walk(t, row)
            lengths.append((depth + mean_search(reached(t, leaf)), i in forest.used[t]))
        all_trees.append(np.mean([a for a, _ in lengths]))
        others.append(np.mean([a for a, seen in lengths if not seen]))
    assert np.allclose(forest.score(x), 2.0 ** (-np.array(all_trees) / mean_search(64)))
    assert np.allclose(forest.score(x, apart), 2.0 ** (-np.array(others) / mean_search(64)))


def test_cumulative_links_against_a_dense_likelihood():
    """The fit is where the dense penalised likelihood is least: no step along any coordinate makes it better."""
    rng = np.random.default_rng(1)
    n, k = 400, 6
    x = rng.poisson(0.7, (n, k))
    eta = np.log1p(x) @ np.array([1.5, -1.0, 0.5, 0.0, 0.8, -0.3])
    grade = np.searchsorted([0.8, 1.6, 2.4], eta + rng.logistic(0, 1, n))
    rows, feats = np.nonzero(x)
    model = tox.fit(rows, feats, x[rows, feats], grade, np.arange(k), steps=3000)

    def loss(w, theta):
        above = 1 / (1 + np.exp(-(np.log1p(x) @ w)[:, None] + theta[None, :]))
        p = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        return -np.log(p[np.arange(n), grade] - p[np.arange(n), grade + 1]).mean() + 1e-5 * (w**2).sum()

    best = loss(model.weights, model.thresholds)
    assert np.all(np.diff(model.thresholds) > 0) and len(model.thresholds) == 3
    for i in range(k):
        for step in (-0.05, 0.05):
            assert loss(model.weights + step * np.eye(k)[i], model.thresholds) > best
    for i in range(3):
        for step in (-0.05, 0.05):
            assert loss(model.weights, model.thresholds + step * np.eye(3)[i]) > best
    linear = model.linear(rows, feats, x[rows, feats], n)
    assert np.allclose(linear, np.log1p(x) @ model.weights)
    assert np.allclose(model.severity(linear), sum(1 / (1 + np.exp(t - linear)) for t in model.thresholds))


def test_ratios_and_dual_against_dense_ones():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["calm", "prose", "about", "things", "BUY", "now", "!!", "x1"], 12, p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05] if i % 2 else [0.05, 0.1, 0.1, 0.15, 0.2, 0.15, 0.15, 0.1])) for i in range(120)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(120)])
    r, f = nb.indicators(*view(texts))
    held = np.zeros((120, nb.DIMENSIONS), bool)
    held[r, f] = True
    for i in (0, 5, 77):  # each row by itself has the same indicators
        assert np.array_equal(nb.indicators(*view([texts[i]]))[1], np.flatnonzero(held[i]))
    good, bad = held[y > 0].sum(0), held[y < 0].sum(0)
    values = nb.log_count_ratios(good.astype(float), bad.astype(float))
    p, q = (good + 1) / (good + 1).sum(), (bad + 1) / (bad + 1).sum()
    assert np.allclose(values, np.log(p / q))
    use = np.flatnonzero(held.any(0))
    x = held[:, use] * values[use]
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((120, 1))])
    w, bias = nb.dual_descent([np.flatnonzero(h) for h in held], values, y, epochs=2000)
    v = np.append(w[use], bias)
    # the primal at the fit against the dual bound, from the margins' slacks
    primal = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    for _ in range(300):
        assert primal(v + rng.normal(0, 0.02, len(v))) >= primal(v) - 1e-6
    margins = nb.QualityModel(values, w, bias).margins(r, f, 120)
    assert np.allclose(margins, x @ v)


def long_text():
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(3000)]
    lines = [" ".join(rng.choice(vocab, rng.integers(1, 30))) for _ in range(9000)]
    return "\n".join([*lines, *lines[:50], "X" * 700_000, "vile " * 9, *lines[100:120]])


def test_long_texts_part_by_part(monkeypatch):
    """One text in many parts gives what it gives in one piece."""
    from cairnfold.llm import common, minhash, suffix_dedup

    text = long_text()
    buf, offsets = view([text])
    assert common.is_long(buf, offsets)

    def everything():
        import pyarrow as pa

        r, f, c, n = tox.tallied(buf, offsets)
        return [
            rules.statistics(buf, offsets), np.stack([r, f, c]), n, np.stack(nb.indicators(buf, offsets)), next(iter(minhash.shingle_sets(pa.array([text]), 5))),
            np.sort(suffix_dedup.chosen(buf, offsets, 100)[1]), common.hashed_words(buf, offsets, lower=True)[0],
        ]

    parts = everything()
    covered = lambda g: sum(int(x) for x in g["count"])
    windows = covered(suffix_dedup.regions(buf, offsets, 100))
    monkeypatch.setattr(common, "SLICE_BYTES", len(text) + 1)
    assert not common.is_long(buf, offsets)
    for a, b in zip(parts, everything()):
        assert np.array_equal(a, b)
    assert windows == covered(suffix_dedup.regions(buf, offsets, 100)) == len(buf) - 99


def test_no_structured_collisions():
    """Thue-Morse words, on which polynomial hashes modulo 2 ** 64 collide."""
    from cairnfold.llm.common import word_hashes

    for size in range(1, 13):
        a = [bin(i).count("1") % 2 for i in range(2**size)]
        x, y = "".join("ab"[i] for i in a), "".join("ba"[i] for i in a)
        buf, _ = view([x + y])
        h = word_hashes(buf, np.array([0, len(x)]), np.array([len(x), 2 * len(x)]))
        assert h[0] != h[1]
    words = [b"a" * n for n in range(1, 3000, 7)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = word_hashes(buf, ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words)
    for i in (0, 40, 200, 400):  # long and short words have the same hash wherever they stand
        assert word_hashes(np.frombuffer(words[i], np.uint8), np.array([0]), np.array([len(words[i])]))[0] == h[i]


def test_memory_of_a_long_text_is_bounded():
    """Forty megabytes of text in a worker of its own: each operator's step takes less than twelve times that."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from cairnfold.llm import minhash, quality_classifier, quality_rules, toxicity
text = (b"some ordinary words of a text that goes on and on " * 20 + b"\\n") * 40_000
buf, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
column = pa.array([text.decode()])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
quality_rules.statistics(buf, offsets); toxicity.tallied(buf, offsets); quality_classifier.indicators(buf, offsets); list(minhash.shingle_sets(column, 5))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(out.stdout.split()[-1]) < 12, out.stderr[-500:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_held_out(spark):
    """Fitted on four of five labelled rows, on the others: quality is ranked, toxic rows are found, clean ones stay."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    held = {r.doc_id: r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    model = nb.train(docs, labels.where(fold != 0))
    told = [(r.score, held[r.doc_id].quality) for r in nb.classify(docs, model).collect() if r.doc_id in held]
    pairs = [(a > b) + 0.5 * (a == b) for a, g in told if g for b, h in told if not h]
    assert np.mean(pairs) > 0.97
    toxic = tox.train(docs, labels.where(fold != 0))
    told = [(r.toxic, held[r.doc_id].toxic) for r in tox.score(docs, toxic).collect() if r.doc_id in held]
    assert sum(t for t, truth in told if not truth) <= 0.02 * sum(not truth for _, truth in told) + 1
    assert sum(t for t, truth in told if truth) >= 0.6 * sum(bool(truth) for _, truth in told)


@pytest.mark.parametrize("similarity, shared", [(0.85, 92), (0.8, 89)])
def test_recall_of_the_sketch_at_the_threshold(similarity, shared):
    """Pairs of sets of a hundred, just similar enough: every one meets in some band."""
    from cairnfold.llm import minhash

    rng, rows = np.random.default_rng(5), 6
    bands = minhash.bands_for(similarity, rows)
    seeds = minhash.seeds_for(bands * rows)
    assert shared / (200 - shared) >= similarity > (shared - 1) / (201 - shared)
    missed = 0
    for _ in range(1500):
        x = rng.integers(0, 2**63, 200 - shared, dtype=np.uint64)
        a, b = (minhash.sketch(np.sort(s), bands * rows, seeds).reshape(bands, rows) for s in (x[:100], x[100 - shared :]))
        missed += not (a == b).all(1).any()
    assert missed == 0
