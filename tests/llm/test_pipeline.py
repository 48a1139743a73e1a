"""The stages on a small corpus: what each lets through, against brute force; rows are told apart, not ids."""

from collections import Counter

import pytest

import corpus_pipeline
from cairnfold.llm.queries import oracle_sql, queries

from .test_operators import BLANK, ROWS, linked, removed

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, _tie string, doc string, id string, `a.b` string, _at int, row long"
#: Rows that repeat an id with other texts, wholly repeated rows, and texts without an id.
SAME = "some words that are the same in all of these rows and go on for a while so that they count as a passage of length " * 2
MORE = [(5, SAME), (60, SAME), (60, "unique words that nobody else has in this table at all"), (200, SAME), (200, SAME), (None, SAME), (None, SAME), (None, "only here"), (None, "only here"), (201, "twice"), (201, "twice"), (202, None), (None, None), (300, "clash " * 3)]
ALL = ROWS + MORE


def rows_of(pairs):
    return [(i, t, "en", "s", len(t or ""), 7, "t", "d", "x", "y", 3, 9) for i, t in pairs]


def own(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(rows_of(ALL), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, 0) for i, _ in ALL if i is not None], "doc_id long, toxic int").write.parquet(f"file://{where}/labels.parquet")
    return f"file://{where}"


def test_toxicity_keeps_rows(spark, corpus, labels):
    out = STAGES["toxicity"](spark, corpus, labels)
    assert out.columns == corpus.columns and own(out) == Counter(rows_of(ALL))


def test_exact_copies_by_row(spark, corpus, labels):
    best = {}
    for i, t in ALL:
        k, rank = BLANK.sub("", t or ""), (i is None, -len(t or "") if i is not None else 0, i if i is not None else 0, -len(t or ""), t or "", t is not None)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, (i, t))
    out = STAGES["exact_dedup"](spark, corpus, labels)
    assert out.columns == corpus.columns and out.dtypes == corpus.dtypes
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert Counter(BLANK.sub("", t or "") for _, t in got) == Counter(best.keys())
    assert {(i, BLANK.sub("", t or "")) for i, t in got} == {(x[1][0], BLANK.sub("", x[1][1] or "")) for x in best.values()}
    assert set(own(out)) <= set(rows_of(ALL))


def test_near_copies_by_row(spark, corpus, labels):
    """One row of each component of rows; every row of a component is linked to the one that stays or reached from it."""
    numbered = [(n, t) for n, (_, t) in enumerate(ALL)]
    sets, find = linked(numbered, 5, 80, 100)
    out = STAGES["minhash"](spark, corpus, labels)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    groups = {}
    for n, (i, t) in enumerate(ALL):
        groups.setdefault(find(n), []).append((i, t))
    assert sum(got.values()) == len(groups) and out.columns == corpus.columns
    left = got.copy()
    for members in sorted(groups.values(), key=len):
        alone = Counter(i for i, _ in ALL if i is not None)
        ids = [i for i, _ in members if i is not None and alone[i] == 1]
        if ids:  # the smallest id of its own stays
            assert left[next((i, t) for i, t in members if i == min(ids))] > 0
        stays = next(x for x in members if left[x] > 0 and (not ids or x[0] == min(ids)))
        left[stays] -= 1
    assert not +left


def test_passages_by_row(spark, corpus, labels):
    out = STAGES["suffix_dedup"](spark, corpus, labels)
    assert out.columns == corpus.columns and out.count() == len(ALL)
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in ALL)
    # the texts that are left hold each passage once, whichever of the rows without an id of their own comes first
    seen, twice = set(), 0
    for r in out.collect():
        assert r.n_chars == len(r.text)
        b = r.text.encode()
        windows = {b[i : i + 100] for i in range(len(b) - 99)}
        twice += len(windows & seen)
        seen |= windows
    assert twice == 0
    everything = {b[i : i + 100] for _, t in ALL for b in [(t or "").encode()] for i in range(len(b) - 99)}
    kept = Counter(r.text for r in out.where("text like '%some words that are the same%'").collect())
    assert sum(kept.values()) == 1 and len(everything) > len(seen) > 0


def test_stages_in_a_row(spark, corpus, labels):
    """On rows with ids of their own all stages together, against brute force."""
    rows = list({i: (i, t) for i, t in ROWS if i is not None}.values())
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    columns = docs.columns
    docs = STAGES["toxicity"](spark, docs, labels)
    best = {}
    for i, t in rows:
        k = BLANK.sub("", t or "")
        best[k] = min(best.get(k, (0, 10**9)), (-len(t or ""), i))
    docs = STAGES["exact_dedup"](spark, docs, labels).persist()
    rows = [(i, t) for i, t in rows if best[BLANK.sub("", t or "")][1] == i]
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(rows)
    _, find = linked(rows, 5, 80, 100)
    docs = STAGES["minhash"](spark, docs, labels).persist()
    rows = [(i, t) for i, t in rows if find(i) == i]
    assert docs.columns == columns and Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(rows)
    gone = removed(rows, 100)
    docs = STAGES["suffix_dedup"](spark, docs, labels).persist()
    for r in docs.collect():
        text = dict(rows)[r.doc_id] or ""
        kept = bytes(b for b, g in zip(text.encode(), gone[(r.doc_id, text.encode())]) if not g)
        assert r.n_chars == len(r.text) and abs(len(r.text.encode()) - len(kept)) <= 4 * 4
        if len(text) == len(text.encode()):
            assert r.text.encode() == kept
    assert docs.columns == columns and docs.count() == len(rows)
    packed = STAGES["packing"](spark, docs, labels).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows}


def test_run_on_tables_with_nulls_and_on_an_empty_one(spark, corpus, labels, tmp_path):
    for name, docs in (("full", corpus), ("empty", corpus.limit(0))):
        where = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{where}/documents.parquet")
        spark.read.parquet(f"{labels}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/full").collect()
    assert got and {r.doc_id for r in got} <= {i for i, _ in ALL} and 300 in {r.doc_id for r in got} and 60 in {r.doc_id for r in got}


def test_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash", "suffix_dedup", "packing"]
