"""What the operators of this folder share: shared scratch tables, Arrow text access, vectorised hashes, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = b" \t\n\x0b\f\r"
#: Bytes of text that one vectorised step works on, so that a Python worker's memory is bounded.
SLICE_BYTES = 1 << 18


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir; only where it is unset, as in tests on one machine, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cairnfold-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there when the session's JVM ends is deleted with it."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(p.getParent())
    store.mkdirs(p)  # only what exists can be marked
    store.deleteOnExit(p)
    store.delete(p, True)
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairnfold_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_cairnfold_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- bitmaps of fixed size

#: Bits of a map over hashes, and of one row of its table: the whole table has 8 MB, whatever the corpus.
MAP_BITS = 1 << 26
_ROW_BITS = 1 << 15


def _bit(hash: Column) -> Column:
    return F.pmod(hash, F.lit(MAP_BITS))


def bitmap(hashes: DataFrame) -> DataFrame:
    """A written bitmap (part, bits) over the long column of hashes: what isn't in it is not among them."""
    bit = hashes.toDF("h").select(_bit(F.col("h")).alias("h"))
    rows = bit.withColumn("part", F.floor(F.col("h") / _ROW_BITS).cast("int")).repartition("part")
    return save(rows.groupBy("part").agg(F.bitmap_construct_agg(F.col("h") % _ROW_BITS).alias("bits")), "bitmap")


def split(df: DataFrame, hash: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose hash may be in the bitmap, and those whose hash is not. The bitmap is broadcast; no row moves."""
    at = _bit(hash)
    part = F.broadcast(bits.select(F.col("part").alias("_part"), F.col("bits").alias("_bits")))
    rows = df.withColumn("_at", at).withColumn("_part", F.floor(F.col("_at") / _ROW_BITS).cast("int")).join(part, "_part", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor((F.col("_at") % _ROW_BITS) / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return rows.where(there).select(df.columns), rows.where(~there).select(df.columns)


def likely(df: DataFrame, hash: Column, bits: DataFrame) -> DataFrame:
    """The rows of df whose hash may be in the bitmap."""
    return split(df, hash, bits)[0]


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key (a long) is not in the one column of gone. Only rows that a bitmap lets through are moved."""
    gone = save(gone.toDF("_gone").where("_gone is not null").distinct(), "gone")
    maybe, surely = split(rows, F.coalesce(F.xxhash64(key), F.lit(0)), bitmap(gone.select(F.xxhash64("_gone"))))
    return surely.unionByName(maybe.join(gone, F.col(key) == F.col("_gone"), "left_anti"))


# ---------------------------------------------------------------- rows


def whole(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs can clash with ours."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def numbered(docs: DataFrame, id: str = "doc_id") -> tuple[DataFrame, int]:
    """Rows as (doc, id, tie) and the largest id: doc holds all columns; tie tells rows apart that share an id or have none.

    tie is 0 where no other row has the id; else, and for null ids, a number > 0 of the row's own. Rows without an id of
    their own are written, so that their numbers stay; where all have one, nothing is.
    """
    rows = docs.select(whole(docs).alias("doc"), F.col(id).cast("long").alias("id"))
    shared = save(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("_id")), "shared")
    top = rows.agg(F.max("id")).first()[0] or 0
    zero = F.lit(0).cast("long").alias("tie")
    if shared.isEmpty():
        return rows.select("doc", "id", zero), top
    ids = shared.where("_id is not null")
    maybe, surely = split(rows.where("id is not null"), F.xxhash64("id"), bitmap(ids.select(F.xxhash64("_id"))))
    single = surely.unionByName(maybe.join(ids, F.col("id") == F.col("_id"), "left_anti"))
    rest = rows.where("id is null").unionByName(maybe.join(ids, F.col("id") == F.col("_id"), "left_semi"))
    rest = save(rest.withColumn("tie", F.monotonically_increasing_id() + 1), "numbered")
    return single.select("doc", "id", zero).unionByName(rest), top


# ---------------------------------------------------------------- Arrow text


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one array, and offsets (rows + 1); null counts as empty. Nothing is copied."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, for steps that make Python objects of them."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def trim() -> None:
    """Give memory that a finished step has freed back to the machine; Python workers live on, and share it with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


# ---------------------------------------------------------------- hashes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True
#: _MASKS[k] keeps the first k bytes of eight.
_MASKS = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(buf: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in the rows: start and end in buf, and the row they are in."""
    edge = np.empty(len(buf) + 1, bool)
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~blank[buf]
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    cuts = np.unique(cuts)
    both = cuts[inside[cuts] & inside[cuts - 1]]  # a word that touches the next row's word is two words
    marks = np.flatnonzero(edge)
    if len(both):
        marks = np.sort(np.concatenate([marks, both, both]))
    starts, ends = marks[::2], marks[1::2]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def text_parts(buf: np.ndarray, blank: np.ndarray = IS_BLANK, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes that cut one text where it has a blank, so that no word is in two of them."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(lo + limit, n)
        while hi < n:
            gap = np.flatnonzero(blank[buf[hi : hi + limit]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(hi + limit, n)
        yield lo, hi
        lo = hi


def is_long(buf: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether this is one text (a slice of its own) that is to be looked at part by part."""
    return len(offsets) == 2 and len(buf) > 2 * SLICE_BYTES


def _sum_of_eights(buf: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """What word_hashes sums over the eights of one word."""
    total, at = np.zeros(1, np.uint64), 0
    for a in range(lo, hi, 1 << 19):
        piece = buf[a : min(a + (1 << 19), hi)]
        eights = np.zeros(-(-len(piece) // 8) * 8, np.uint8)
        eights[: len(piece)] = piece
        x = mix(eights.view("<u8"))
        total += mix(x + np.arange(at, at + len(x), dtype=np.uint64) * _STEP).sum(dtype=np.uint64)
        at += len(x)
    return total


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lowered on demand): eight bytes at a time are mixed, then mixed with their place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lower:
        buf = _LOWER[buf]
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), "<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    total = mix(mix(eights[starts] & _MASKS[np.minimum(sizes, 8)]))
    live, j = np.flatnonzero((sizes > 8) & (sizes <= _LONG_WORD)), 1
    while len(live):
        left = sizes[live] - 8 * j
        total[live] += mix(mix(eights[starts[live] + 8 * j] & _MASKS[np.minimum(left, 8)]) + np.uint64(j * int(_STEP) % 2**64))
        live, j = live[left > 8], j + 1
    for i in np.flatnonzero(sizes > _LONG_WORD).tolist():
        total[i : i + 1] = _sum_of_eights(buf, int(starts[i]), int(ends[i]))
    return mix(total + sizes.astype(np.uint64) * _M2)


def hashed_words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = IS_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the row it is in. A long text is looked at part by part."""
    if not is_long(buf, offsets):
        starts, ends, rows = words_of(buf, offsets, blank)
        return word_hashes(buf, starts, ends, lower), rows
    out = []
    for lo, hi in text_parts(buf, blank):
        part = buf[lo:hi]
        starts, ends, _ = words_of(part, np.array([0, hi - lo]), blank)
        out.append(word_hashes(part, starts, ends, lower))
    words = np.concatenate(out)
    return words, np.zeros(len(words), np.int32)


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, some at a time."""
    out = np.empty(max(0, len(words) - k + 1), np.uint64)
    for lo in range(0, len(out), 1 << 16):
        hi = min(lo + (1 << 16), len(out))
        h = np.zeros(hi - lo, np.uint64)
        for j in range(k):
            h = mix(h * _STEP + words[lo + j : hi + j])
        out[lo:hi] = h
    return out


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of k words within a row; a row of 1 to k-1 words gives its whole sequence. Second: the rows, rising."""
    if n_rows == 1 and len(words) >= k:
        h = _runs(words, k)
        return h, np.zeros(len(h), np.int32)
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    out_h, out_r = [], []
    if len(words) >= k:
        ok = rows[k - 1 :] == rows[: len(rows) - k + 1]
        out_h.append(_runs(words, k)[ok])
        out_r.append(rows[: len(rows) - k + 1][ok])
    short = np.flatnonzero((counts > 0) & (counts < k))
    for size in np.unique(counts[short]):
        which = short[counts[short] == size]
        h = np.full(len(which), np.uint64(int(size)), np.uint64)
        for j in range(int(size)):
            h = mix(h * _STEP + words[first[which] + j])
        out_h.append(h)
        out_r.append(which)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    if len(short):
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def to_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): rows (id, component), the component being its smallest id.

    Alternating large-star and small-star rounds; each round is one written table, so nothing but a count and a
    checksum ever reaches the driver, and a hub's links are pre-aggregated before they move.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    seen = None
    while True:
        # large star: each node's larger neighbours link to the smallest of its neighbours and itself
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = save(large, "large")
        # small star: each node and its smaller neighbours link to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u")))
        small = save(small.where("v <> u").distinct(), "small")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % 1000003), F.bit_xor(F.xxhash64("v", "u"))).first()
        drop(now, large)
        now = small
        if state == seen:
            break
        seen = state
    labels = now.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return labels.unionByName(now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
