"""Every operator on a table with nulls, empty and very long texts, ties, repeated rows and clashing columns, against brute force."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnfold.llm import common, induced_sort, license_scan, minhash, packing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, toxicity, warc
from cairnfold.llm.exact_dedup import exact_dedup
from cairnfold.llm.queries import vocabulary

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = text(60), text(80).split()
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "x" * 5000), (8, "the " * 3000), (9, text(9000)), (None, "a b"), (None, None), (10, "z\x00z " * 60)]
    rows += [(20 + i, text(30) + " " + passage + " " + text(30)) for i in range(6)]
    rows += [(40 + i, text(50)) for i in range(10)] + [(50, "dup  text here now"), (51, "dup text\nhere now"), (52, "duptext herenow"), (53, "duptext herenow ")]
    for i in range(12):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((60 + i, " ".join(words)))
    rows += [(60, " ".join(base)), (60, " ".join(base)), (-7, text(40)), (80, passage), (81, passage), (82, "#$% ### <a> | b\n\nline one\nline one\r\n line\nline one")]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1, "w", 2) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, id long, words string, n long").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_key(rows, n=1):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x if not isinstance(x, bool) else int(x)) for x in r if not isinstance(x, list)))


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[BLANK.sub("", t or "")].append((i, t or ""))
    keep = {k: min(((-len(t), i) for i, t in v if i is not None), default=(0, None))[1] for k, v in groups.items()}
    expected = [(i, keep[k], len(groups[k]), i == keep[k], hashlib.sha256(k.encode()).hexdigest()) for i, t in ROWS for k in [BLANK.sub("", t or "")]]
    assert by_key(exact_dedup(docs).collect()) == by_key(expected)
    assert exact_dedup(empty).count() == 0


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, u in sets:
            if s and u and den * len(s & u) >= num * len(s | u):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, find


@pytest.mark.parametrize("k, num, block", [(3, 85, 512), (5, 80, 2)])
def test_near_duplicates(docs, empty, monkeypatch, k, num, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    _, find = linked(ROWS, k, num, 100)
    expected = [(i, len(shingles(t, k)), None if i is None else find(i), i is None or find(i) == i) for i, t in ROWS]
    assert by_key(minhash.near_duplicates(docs, words=k, num=num).collect()) == by_key(expected)
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_fills_and_concentrates():
    rng, t = np.random.default_rng(1), 192
    seeds = minhash.seeds_for(t)
    for n in (1, 2, 7, 300, 5000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        s = minhash.sketch(x, t, seeds)
        assert s.max() != 2**64 - 1 and np.array_equal(s, minhash.sketch(x[::-1].copy(), t, seeds))
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    agree = (minhash.sketch(a, t, seeds) == minhash.sketch(b, t, seeds)).mean()
    assert abs(agree - 900 / 1100) < 0.15


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def removed(rows, length):
    """Byte by byte, for distinct (id, text); null ids last, then by text hash."""

    def key(r):
        d = hashlib.sha256(r[1]).digest()
        a, b = (int.from_bytes(d[x : x + 8], "big", signed=True) for x in (0, 8))
        return (1, a, b) if r[0] is None else (0, r[0], a)

    seen, out = set(), {}
    for r in sorted({(i, (t or "").encode()) for i, t in rows}, key=key):
        b, gone = r[1], bytearray(len(r[1]))
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            if w in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(w)
        out[r] = gone
    return out


@pytest.mark.parametrize("shard", [1 << 19, 300])
def test_suffix_dedup(docs, empty, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    gone = removed(ROWS, 100)
    expected = []
    for i, t in ROWS:
        b = (t or "").encode()
        g = gone[(i, b)]
        kept = bytes(x for x, y in zip(b, g) if not y)
        expected.append((i, len(b), sum(g), len([x for x in bytes(g).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.cut_repeats(docs, carry=("key", "id"))
    assert by_key(got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()) == by_key(expected)
    assert got.where("carried.key <> 'k'").count() == 0
    assert suffix_dedup.cut_repeats(empty).count() == 0


def test_anchors_grow_until_windows_are_whole():
    """Regions around one common string: at every round equal windows have equal anchors, and no window is lost."""
    rng, length = random.Random(2), 100
    text = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    middle = bytes(rng.choice(b"xyz") for _ in range(32))
    lefts, rights = [text(68) for _ in range(6)], [text(68) for _ in range(6)]
    buf = b"".join(x + middle + y for x in lefts for y in rights)
    h = suffix_dedup.regions(np.frombuffer(buf, np.uint8), np.array([0, len(buf)]), length)
    pieces = [(int(to) , buf[a : a + n + length - 1], -1) for to, a, n in zip(common.to_long(np.ascontiguousarray(h["hash"])), h["start"].tolist(), h["count"].tolist())]
    windows = Counter(buf[i : i + length] for i in range(len(buf) - length + 1))
    k = 32
    while k < length:
        after, anchors = [], defaultdict(set)
        for hash_, body, at in pieces:
            for first, count, key, place in suffix_dedup.halved(body, hash_, at, length, k):
                part = body[first : first + count + length - 1]
                half = -(-(length - k) // 2)
                assert part[place : place + k + half] == key and len(key) == k + half
                after.append((key, part, place))
                for i in range(count):
                    anchors[part[i : i + length]].add(key)
        assert all(len(x) == 1 for x in anchors.values())
        assert Counter(p[i : i + length] for _, p, _ in after for i in range(len(p) - length + 1)) == windows
        pieces, k = after, k + half
    assert all(key == part for key, part, _ in pieces)


def test_names_are_sorted_recursively(monkeypatch):
    """A text of half a megabyte of ordinary words goes through several levels of induced sorting."""
    rng = random.Random(1)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choice(vocab) for _ in range(90_000)).encode()[: 1 << 19]
    depth, inner = [], induced_sort.names_array
    monkeypatch.setattr(induced_sort, "names_array", lambda s, k: depth.append((len(s), k)) or inner(s, k))
    s = np.append(np.frombuffer(text, np.uint8).astype(np.int16) + 2, 0).astype(np.int16)
    order = induced_sort.suffix_array(s, 258)
    assert len(depth) >= 3 and depth[0][0] > 100_000 and depth[0][1] > 1024 and depth[-1][0] == depth[-1][1]
    assert sorted(order.tolist()) == list(range(len(s)))
    some = rng.sample(range(len(order) - 1), 20_000)
    assert all(text[order[i] :] < text[order[i + 1] :] for i in some if i)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in range(150):
        size, k = rng.integers(1, 60), int(rng.integers(2, 6))
        s = np.append(np.tile(rng.integers(1, k, rng.integers(1, 5)), size) if n % 3 == 0 else rng.integers(1, k, size), 0)
        assert induced_sort.suffix_array(s, k).tolist() == sorted(range(len(s)), key=lambda i: list(s[i:]))
    for n in range(60):  # strings of names, with runs and periods
        size, k = int(rng.integers(2, 900)), int(rng.integers(2, 200))
        s = rng.integers(1, k, size)
        s = np.append([s, np.repeat(s, 7), np.tile(s[:5], size), np.sort(s)][n % 4], 0).astype(np.int32)
        got = induced_sort.suffix_array(s, k, induced_sort._induce_names).tolist()
        assert got == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, with_ids=True).persist()
    pieces = Counter()
    for i, t in ROWS:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        lead = len(ids) % 2048 or 2048
        for n, end in enumerate(range(lead, len(ids) + 1, 2048)):
            start = max(0, end - 2048) if n else 0
            pieces[(i, n, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == pieces
    bins = defaultdict(list)
    for r in got.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:j]) for j in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(bins) == packing.lower_bound(np.array([n for x in bins.values() for _, n in x]), 2048)
    assert {len(r.ids) for r in packing.sequences(got).collect()} == {sum(n for _, n in x) for x in bins.values()}
    assert packing.pack_documents(empty, path).count() == 0


def test_last_bins_of_blocks_are_packed_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 8)
    sizes = [random.Random(n).randint(100, 1900) for n in range(160)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    got = packing.pack(pieces, 2048).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert sorted((r.row, r.length) for r in got) == list(enumerate(sizes))
    for x in bins.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:j]) for j in range(len(x))] and sum(n for _, n in x) <= 2048
    apart = len(packing._evolved(pieces, 20, 2048).select("sequence_id").distinct().collect())
    assert len(bins) < apart


def test_genetic_packing_improves_and_keeps_items():
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(600, 1100, 300), rng.integers(300, 700, 200)])
    first, fills = np.empty(len(sizes), np.int64), []
    packing.best_fit(list(range(len(sizes))), sizes.tolist(), first, fills, 2048)
    out = packing.evolve([first, first.copy()], sizes, 2048, packing.lower_bound(sizes, 2048), 12, rng)[0]
    assert np.bincount(out, weights=sizes).max() <= 2048 and packing.fitness(out, sizes, 2048) > packing.fitness(first, sizes, 2048)


def test_encoder_special_tokens_and_long_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    slow, encode = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["", "a<|endoftext|>b  ", "   \n\n x", "é" * 1500, "1" * 3000 + " ok", "日本語 🙂", "it's we'll'dx <|endoftext|> a.b,c  d\t e " * 40, *(t or "" for _, t in ROWS)]
    want = [slow.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode(texts)] == want
    monkeypatch.setattr(packing, "LONG", 5)
    monkeypatch.setattr(packing, "CALL", 40)
    assert max(len(list(packing.parts(t))) for t in texts) > 100 and all("".join(packing.parts(t)) == t for t in texts)
    assert [x.tolist() for x in encode(texts)] == want


def test_every_character_is_cut_as_the_library_cuts_it():
    """One text for each code point, between letters, numbers and marks."""
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    slow, encode = Tokenizer.from_file(path), packing.Encoder(path)
    points = [chr(c) for c in [*range(0x3100), *range(0xA000, 0xA100), *range(0xFE00, 0x10000), *range(0x1F000, 0x1F100), *range(0x10D30, 0x10D90), 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2 !{c}?  {c}{c} {c}a\n{c} 's{c}" for c in points]
    assert [x.tolist() for x in encode(texts)] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_a_whole_table():
    """The ids of every text of the smallest table, pinned."""
    import pyarrow.parquet as pq

    table = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("needs the given tables")
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = [t or "" for t in pq.read_table(table, columns=["text"])["text"].to_pylist()]
    slow = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.Encoder(path)(texts)] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def statistics(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(grams)
    cover = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def labels_for(spark, column, value=lambda i: i % 5 > 0):
    rows = [(i, int(value(i))) for i in {i for i, _ in ROWS if i is not None}] + [(None, 1), (999, 1)]
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def test_quality_rules(spark, docs, empty):
    labels = labels_for(spark, "quality")
    forest = quality_rules.train(docs, labels)
    got = quality_rules.judge(docs, forest).collect()
    want = {(i, t): statistics(t) for i, t in ROWS}
    expected = [(i, *want[(i, t)], want[(i, t)][0] < 10 or 100 * want[(i, t)][4] > 20 * want[(i, t)][0]) for i, t in ROWS]
    assert by_key([r[:7] for r in got]) == by_key(expected)
    assert all(not r.kept or (not r.base_failed and r.anomaly < forest.cut) for r in got)
    assert quality_rules.judge(empty, quality_rules.train(empty, labels)).count() == 0
    again = quality_rules.train(docs, labels)
    assert np.array_equal(again.split, forest.split) and again.cut == forest.cut


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 7)), rng.normal(9, 1, (5, 7))])
    score = quality_rules.grow(x).score(x)
    assert score[-5:].min() > np.quantile(score[:-5], 0.99)
    assert quality_rules.calibrated(score, np.append(np.ones(500), np.zeros(5))) <= score[-5:].min()


def test_toxicity(spark, docs, empty):
    rows = [(i, f"plain words number {i} and some more text here") for i in range(300)] + [(1000 + i, f"you vile fool number {i} " + "vile " * (i % 7)) for i in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(labelled, labels)
    got = toxicity.score(labelled, model).collect()
    assert {r.doc_id for r in got if r.toxic} == set(range(1000, 1060))
    many, few = (np.mean([r.severity for r in got if r.doc_id >= 1000 and r.doc_id % 7 == k]) for k in (3, 6))
    assert np.all(np.diff(model.thresholds) > 0) and many != few
    assert toxicity.without_toxic(labelled, model).count() == 300
    assert toxicity.score(docs, model).where("toxic").count() == 0 and toxicity.score(docs, model).count() == len(ROWS)
    assert by_key(toxicity.without_toxic(docs, model).select("doc_id", "text").collect()) == by_key(ROWS)
    nothing = toxicity.train(docs, labels.where("doc_id < 0"))
    assert toxicity.score(docs, nothing).where("toxic").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0 and toxicity.without_toxic(empty, model).count() == 0


def test_quality_classifier(spark, docs, empty):
    rows = [(i, f"calm prose about topic {i % 9} goes on and on here") for i in range(200)] + [(1000 + i, f"BUY!! NOW!! {i} $$$ $$$") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows if i % 5], "doc_id long, quality int")
    model = quality_classifier.train(table, labels)
    held = [r for r in quality_classifier.classify(table, model).collect() if r.doc_id % 5 == 0]
    assert all((r.doc_id < 1000) == bool(r.predicted) for r in held)
    got = quality_classifier.classify(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    one_kind = quality_classifier.train(table, labels.where("quality = 1"))
    assert quality_classifier.classify(table, one_kind).select("score").distinct().count() == 1
    assert quality_classifier.classify(empty, quality_classifier.train(empty, labels)).count() == 0


def test_sentencepiece(docs, empty, spark):
    path = vocabulary("piece_bpe_32k.model")
    texts = ["", " ", "  a  b ", "▁x▁▁y", "<s> </s> <0x0A>", "a\nb\t\x00c", "日本語 🙂 é", "x" * 3000, "⁇", *(t for _, t in ROWS if t)]
    assert sentencepiece_codec.mismatches(path, texts) == []
    encoded = sentencepiece_codec.encode_documents(docs, path)
    got = encoded.collect()
    assert len(got) == len(ROWS) and all(r.parity and r.round_trip for r in got)
    back = sentencepiece_codec.decode_documents(encoded, path).collect()
    assert by_key(back) == by_key([(i, t or "") for i, t in ROWS])
    codec = sentencepiece_codec.Codec(path)
    ids = codec.encode(["one two", "é"])
    assert codec.library_decode([x.tolist() for x in ids]) == ["one two", "é"]
    assert sentencepiece_codec.encode_documents(empty, path).count() == 0


@pytest.mark.parametrize("segment", [1 << 18, 700])
def test_warc(spark, segment):
    html = ["<p>one</p>", "<p>é</p>" * 900, "", None, "a\r\n\r\nWARC/1.1\r\n\r\nb", "z" * 5000]
    rows = [(n, f"http://x/{n}", html[n % len(html)], "extra") for n in range(20)] + [(None, None, "<p>one</p>", ""), (None, "u\r\nv", "only here", ""), (3, "again", None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string")
    top = {}
    for i, _, h, _ in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    expected = []
    for i, _, h, _ in rows:
        b, r = (h or "").encode(), top.get(h or "")
        again = r is not None and r != i
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", r if again else None, True))
    assert by_key(warc.round_trip(pages, segment=segment).collect()) == by_key(expected)
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = common.scratch_path(spark, "warc")
    warc.write_archives(pages, path, segment=segment, archive=9000)
    chunks = warc.read_chunks(spark, path).persist()
    assert by_key(warc.read_records(chunks.repartition(3), ordered=False).collect()) == by_key(expected)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= segment
    broken = chunks.withColumn("data", F.when(F.col("page_id") == 5, F.lit(b"other")).otherwise(F.col("data")))
    assert [r.page_id for r in warc.read_records(broken).where("not intact").collect()] == ([5] if expected[5][3] == "response" else [])


def test_license_scan(spark, docs, empty):
    mit = dict(enumerate(t for n, t in license_scan.TEMPLATES if n == "MIT"))[4]
    rows = [(1, "x\nLicensed under CC BY 4.0.\ny"), (2, "Licensed under CC BY-NC-SA 4.0."), (3, "Copyright 2020 Someone\n" + mit.replace(". ", ".\n")), (4, "my driving license was lost"), (5, None), (6, "word " * 2000 + "Released under the MIT License. " + "word " * 2000), (None, "Released under the MIT License.")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license, r.confirmed) for r in license_scan.scan(table).collect()}
    assert got == {(1, "CC-BY-4.0", True), (2, "CC-BY-NC-SA-4.0", True), (3, "MIT", True), (4, None, False), (6, "MIT", True), (None, "MIT", True)}
    for r in license_scan.scan(table).collect():
        assert dict(rows)[r.doc_id][r.start : r.start + r.length] == r.notice and r.given_bytes <= r.plain_bytes
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES:  # every template confirms itself, by brute force over all templates
        v = scanner.judge(text)
        exact = {n for n, t in license_scan.TEMPLATES if license_scan.words(t) == license_scan.words(text)}
        assert v.license in exact and v.missing == 0, (name, v)
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0


def test_words_and_lines_of_sliced_columns():
    import pyarrow as pa

    column = pa.array(["skip", None, "a bc", "", "d"])[1:]
    buf, offs = common.byte_view(column)
    starts, ends, rows = common.words_of(buf, offs)
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends)] == [b"a", b"bc", b"d"] and rows.tolist() == [1, 1, 3]


@pytest.mark.parametrize("step", [1, 50])
def test_best_cut_is_that_of_the_whole_list(spark, step):
    """Running sums by ranges of scores against calibrated(), with ties, for scores that part the kinds and for some that don't."""
    rng = np.random.default_rng(step)
    good = rng.integers(0, 2, 400)
    for by in (0.0, 0.5):
        score = np.round((rng.random(400) + by * (good == 0)) * 200 / step) / 200 * step
        table = spark.createDataFrame([(float(s), int(g)) for s, g in zip(score, good)], "score double, good int").repartition(3)
        for loss in (0.005, 0.1):
            assert quality_rules.best_cut(table, loss) == quality_rules.calibrated(score, good, loss)


def test_every_labelled_row_is_fitted(spark):
    """Of 30,000 labelled rows, more than were read before, each may be drawn for trees and each has its part in the threshold."""
    n = 30_000
    stats = spark.range(n).select("id", *((F.abs(F.xxhash64("id", F.lit(c))) % (900 if c == "n_words" else 90) + (20 if c != "n_repeat_words" else 0)).cast("long").alias(c) for c in quality_rules.STATISTICS))
    stats = common.save(stats.withColumn("n_repeat_words", F.lit(0).cast("long")).withColumn("n_symbols", F.when(F.col("id") % 10 == 0, F.col("n_words") * 9).otherwise(F.col("n_symbols"))), "statistics")
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 > 0).cast("int").alias("quality"))
    forest = quality_rules.fit(stats, labels)
    assert forest.size == quality_rules.SUBSAMPLE and len(forest.feature) == quality_rules.TREES
    told = quality_rules.judged(stats, forest).select("doc_id", "kept", "anomaly").toArrow()
    bad, kept = told["doc_id"].to_numpy() % 10 == 0, told["kept"].to_numpy()
    assert 0 < (~kept[~bad]).mean() < 0.01 and (~kept[bad]).mean() > 10 * (~kept[~bad]).mean()
    fewer = quality_rules.fit(stats, labels.where("doc_id <> 4321 and doc_id % 7 <> 3 or doc_id % 10 = 0"))
    assert not np.array_equal(fewer.split, forest.split)


def test_basic_words_are_those_of_the_whole_pattern():
    """Every character of the basic plane beside a letter, a number, white space and a sign, and random texts."""
    plane = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000))]
    rng = random.Random(3)
    texts = [a + c + a for c in plane for a in "a1! "] + ["".join(rng.choices(plane[: rng.choice((400, 5000, 60_000))], k=500)) for _ in range(60)]
    assert all(packing.basic_words().findall(t) == packing.ALL_WORDS.findall(t) for t in texts)


def test_windows_of_one_shard_are_ordered_by_document_and_place():
    """Late documents after others, then id, then text, then place: of equal windows all but the first are told, as ranges."""
    body = bytes(range(60, 100))
    pdf = pd.DataFrame({"late": [1, 0, 0, 0, 0], "id": [1, 9, 2, 2, 2], "text": [0, 0, 7, -7, -7], "at": [(5 << 10) + 1, (0 << 10) + 1, (3 << 10) + 1, (900 << 10) + 1, (8 << 10) + 1], "body": [b"a" + body, body + b"b", body + b"c", b"d" + body, b"e" + body]})
    got = suffix_dedup._sorted_shard(40)(pdf)
    # the first is the one at 8 in text -7 of document 2, behind one byte
    assert sorted(map(tuple, got[["late", "id", "text", "lo", "hi"]].to_numpy().tolist())) == [(0, 2, -7, 901, 941), (0, 2, 7, 3, 43), (0, 9, 0, 0, 40), (1, 1, 0, 6, 46)]
