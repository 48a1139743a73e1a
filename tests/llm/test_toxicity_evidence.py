"""The features that reach the driver are those that the rules choose, at any size of the sample."""

import numpy as np
import pytest

from cairnfold.llm import toxicity


@pytest.mark.parametrize("n1, n0", [(0, 0), (0, 40), (40, 0), (3, 2), (60, 300), (625, 5000), (1354, 10646), (6000, 6000)])
def test_telling_is_chosen_or_marking(spark, n1, n0):
    grid = [(t, c) for t in sorted({*range(min(n1, 60) + 1), *range(0, n1 + 1, 97)}) for c in sorted({*range(min(n0, 60) + 1), *range(0, n0 + 1, 997)}) if t + c]
    grid = grid or [(0, 0)]
    toxic, clean = (np.array(x) for x in zip(*grid))
    stats = toxicity.Stats(np.arange(len(grid)), toxic, clean, n1, n0)
    use = toxicity.chosen(stats) | (toxicity.marking(stats) & (toxic + clean >= 5))
    rows = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(grid)], "i int, toxic long, clean long")
    got = {r.i for r in rows.where("toxic + clean >= 5").where(toxicity.telling(n1, n0)).collect()}
    assert got == set(np.flatnonzero(use).tolist())


def test_rare_words_of_large_samples_get_weights(spark):
    rows = [(i, 0, f"plain words of row {i % 50}") for i in range(10_646)] + [(20_000 + i, 1, f"plain words of row {i % 50}" + (" rarevile" if i < 6 else " vile")) for i in range(1354)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    _, feats, _ = toxicity.features(np.frombuffer(b"rarevile", np.uint8), np.array([0, 8]))
    at = toxicity.places(model.ids, feats[:1])[0]
    assert at >= 0 and model.weights[at] > 0
