"""Near duplicates: fast similarity sketching, banding, exact verification on full shingle sets, components of links.

The sketch places every shingle in one of t bins per round, keeping each bin's smallest (round, hash); after t rounds
of free placement, t more rounds send all shingles to one bin each, so every coordinate fills. A set of n shingles
costs about n + t log t hashes, and the share of equal coordinates is concentrated around the Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, byte_view, components, drop, hashed_words, likely, mix, save, shingle_hashes, slices, to_long, trim

_EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64(2**32 - 1)
_32 = np.uint64(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of one set that a step of array operations works on.
_PART = 1 << 16
#: Members of a block in the exact comparison of a bucket that the leaders' links have not joined.
BLOCK = 512


def bands_for(similarity: float, rows: int, miss: float = 1e-6) -> int:
    """Bands of `rows` coordinates, so that a pair at the similarity shares none with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def seeds_for(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * _STEP)


def sketch(x: np.ndarray, t: int, seeds: np.ndarray) -> np.ndarray:
    """The t coordinates of a non-empty set of 64-bit hashes. Extra rounds never change a filled bin."""
    out = np.full(t, _EMPTY, np.uint64)
    i, n = 0, len(x)
    rounds = max(1, math.ceil(1.15 * t * (math.log(t) + 1) / n))
    while i < t:
        r = min(rounds, t - i)
        for lo in range(0, n, _PART):  # a long text's set, some of it at a time
            h = mix(x[None, lo : lo + _PART] ^ seeds[i : i + r, None])
            place = ((h >> _32) * np.uint64(t)) >> _32
            value = (h & _LOW) | (np.arange(i, i + r, dtype=np.uint64)[:, None] << _32)
            np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        i += r
        if out.max() != _EMPTY:
            return out
        rounds = max(1, math.ceil(t / n))
    for b in np.flatnonzero(out == _EMPTY):
        out[b] = (mix(x ^ seeds[t + b]) & _LOW).min() | (np.uint64(t + b) << _32)
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes (ASCII letters lowered)."""
    buf, offsets = byte_view(column)
    for lo, hi in slices(offsets):
        part, offs = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        h, r = shingle_hashes(*hashed_words(part, offs, lower=True), hi - lo, k)
        cut = np.searchsorted(r, np.arange(hi - lo + 1))
        for j in range(hi - lo):
            yield np.unique(h[cut[j] : cut[j + 1]])


def _sketches(k: int, bands: int, rows: int):
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, tag = seeds_for(t), mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, hi, lo, keys = [], [], [], []
            for x in shingle_sets(batch.column(1), k):
                n.append(len(x))
                parts = [x[at : at + _PART] for at in range(0, len(x), _PART)]
                hi.append(np.array([mix(p ^ _STEP).sum(dtype=np.uint64) for p in parts], np.uint64).sum(dtype=np.uint64))
                lo.append(np.array([mix(p + np.uint64(len(x))).sum(dtype=np.uint64) for p in parts], np.uint64).sum(dtype=np.uint64))
                if len(x):
                    grid, key = sketch(x, t, seeds).reshape(bands, rows), tag
                    for c in range(rows):
                        key = mix(key * _STEP + grid[:, c])
                    keys.append(to_long(key))
                else:
                    keys.append(None)
            values = [x for x in keys if x is not None]
            sizes = np.array([0 if x is None else bands for x in keys], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(to_long(np.array(hi, np.uint64))), pa.array(to_long(np.array(lo, np.uint64))), lists], ["id", "n", "hi", "lo", "keys"])
            trim()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [to_long(x) for x in shingle_sets(batch.column(1), k)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "words"])
            trim()

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray], tile: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    cols = []
    for values, row in sides:
        at = np.searchsorted(shared, values)
        ok = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[ok], kind="stable")
        cols.append((at[ok][order], row[ok][order]))
    for lo in range(0, len(shared), tile):
        grids = []
        for (at, row), n in zip(cols, out.shape):
            a, b = np.searchsorted(at, [lo, lo + tile])
            grid = np.zeros((n, min(tile, len(shared) - lo)), np.float32)
            grid[row[a:b], at[a:b] - lo] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def _joined(num: int, den: int):
    """The links between documents of different components in a block; of them a spanning forest."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        one = (pdf["chunk"] == key[1]).to_numpy()
        other = (pdf["chunk"] == key[2]).to_numpy()
        sets, labels = [np.asarray(x) for x in pdf["words"]], pdf["label"].to_numpy()
        sizes = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(one), np.flatnonzero(other)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        both = common_counts([sets[x] for x in a], [sets[x] for x in b])
        linked = (den * both >= num * (sizes[a][:, None] + sizes[b][None, :] - both)) & (labels[a][:, None] != labels[b][None, :])
        x, y = np.nonzero(linked)
        root: dict[int, int] = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        out = []
        for u, v in {*zip(labels[a[x]].tolist(), labels[b[y]].tolist())}:
            if find(u) != find(v):
                root[find(u)] = find(v)
                out.append((u, v))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = 5, num: int = 80, den: int = 100, rows: int = 6, bands: int | None = None) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id, kept).

    Documents whose shingle sets satisfy den * intersection >= num * union are linked; component_id is the smallest
    id reachable over links. Equal sets are one class with one sketch, however many copies there are. In each bucket
    of equal band keys, members meet the bucket's leader (first only the smallest of a document's leaders, then the
    others that its links have not reached yet); buckets whose members still belong to several components are
    compared exactly, in blocks of at most BLOCK by BLOCK members, so no bucket has a cap and none sits in one task.
    All links are confirmed on full sets. The sketch misses a pair at the threshold with probability 1e-6.

    Sets are of 64-bit hashes of words, eight bytes mixed at a time. Null or empty text: an empty set, linked with
    nothing. A null id is never linked; its component is null and it is kept. Rows that repeat an id count as one
    document. Very long texts are hashed part by part; their sets are held whole. Empty tables and extra columns are fine.
    """
    bands = bands or bands_for(num / den, rows)
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = save(own.mapInArrow(_sketches(words, bands, rows), "id long, n long, hi long, lo long, keys array<long>"), "sketch")
    sets = save(sketched.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("members")), "sets")
    copies = sets.where("members > 1").select("hi", "lo", "rep")
    lead = sketched.where("n > 0 and id is not null").join(copies, ["hi", "lo"], "left").where("rep is null or rep = id")
    spread = lead.select("id", F.explode("keys").alias("key"))
    leaders = save(spread.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z"), "leaders")
    members = save(spread.join(leaders, "key").select("key", "id", "a", "z"), "members")
    stars = save(members.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "stars")
    # full sets of the documents that share a bucket with another; texts are not moved, a bitmap says which to look at
    wanted = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct()
    wanted = save(wanted, "wanted")
    bits = bitmap(wanted.select(F.xxhash64("id")))
    some = likely(own.where("id is not null"), F.xxhash64("id"), bits)
    full = save(some.mapInArrow(_sets(words), "id long, words array<long>").join(wanted, "id", "left_semi"), "full")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(full.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").join(full.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
        both = both.withColumn("common", F.size(F.array_intersect("wa", "wb")))
        return both.where(F.col("common") * den >= (F.size("wa") + F.size("wb") - F.col("common")) * num)

    def labelled(df: DataFrame, names: list[str], labels: DataFrame) -> DataFrame:
        for x in names:
            df = df.join(labels.select(F.col("id").alias(x), F.col("component").alias(f"label_{x}")), x, "left").withColumn(f"label_{x}", F.coalesce(f"label_{x}", x))
        return df

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """The labels after these links between labels."""
        new = save(components(links), "components")
        old = labels.join(new.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
        fresh = new.join(labels.select(F.col("component").alias("id")).distinct(), "id", "left_anti")
        return save(old.unionByName(fresh), "labels")

    first = stars.groupBy("b").agg(F.min("a").alias("a"))
    labels = save(components(confirmed(first).select("a", "b")), "labels")
    rest = labelled(stars, ["a", "b"], labels).where("label_a <> label_b").join(first, ["a", "b"], "left_anti")
    labels = merged(labels, confirmed(rest).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    # buckets of three or more with several components: every pair of documents of different components, once for
    # buckets with the same documents. A component with more than BLOCK members has chunks of its own, which are not
    # compared with one another; the others share chunks.
    placed = labelled(members, ["id"], labels).select("key", "id", F.col("label_id").alias("label"))
    state = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("s2"))
    open_ = state.where("m > 2 and x <> y").groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    placed = placed.join(open_, "key")
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("size")).withColumn("own", F.when(F.col("size") > BLOCK, F.col("label").cast("string")).otherwise(""))
    owners = sizes.groupBy("key", "own").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("chunks"))
    chunks = owners.select("key", F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
    part = placed.join(sizes.select("key", "label", "own"), ["key", "label"]).join(owners, ["key", "own"])
    part = part.select("key", "id", "label", "own", F.concat_ws(":", "own", F.pmod(F.xxhash64("id"), "chunks").cast("int")).alias("chunk"))
    part = part.join(chunks, "key").where("own = '' or own <> other").withColumn("with", F.concat_ws(":", "other", "c"))
    part = part.select("key", "id", "label", "chunk", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
    blocks = part.join(full.dropDuplicates(["id"]), "id").groupBy("key", "i", "j").applyInPandas(_joined(num, den), "a long, b long")
    labels = merged(labels, blocks)
    named = sets.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").where("members > 1 or component is not null")
    named = save(named.select("hi", "lo", F.coalesce("component", "rep").alias("component")), "named")
    drop(leaders, members, stars, full, wanted, bits)
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return (
        sketched.select("id", "n", "hi", "lo")
        .join(named, ["hi", "lo"], "left")
        .select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, component).otherwise(F.col("id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
    )
