"""Repeated passages: every byte covered by a string of `length` bytes that also starts earlier in the corpus.

Equal strings of `length` bytes have equal smallest K-byte hashes, so runs of window starts with one smallest hash
("regions") are dealt by that hash to shards; each shard's distinct regions are sorted by induced sorting, and the
permuted common prefixes of window starts that are neighbours in the suffix array show which windows are equal and
which of them starts first. Hashes that the whole corpus holds once cannot belong to a repeated window.

All windows of a region hold one K-byte string, its anchor. Where too many different regions share an anchor for one
shard, equal windows agree on at least half of the bytes beside it, on its left or on its right: so each region is cut
into the windows that reach far to the left and those that reach far to the right, and both go on with the longer
anchor that they hold. After at most log2(length - K) + 1 rounds the anchor is the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, _STEP, SLICE_BYTES, bitmap, byte_view, drop, is_long, likely, mix, portions, save, slices, to_long, trim
from .induced_sort import permuted_prefixes, suffix_array

#: Bytes whose hash may stand for a window.
K = 32
#: Window starts of a region at most; longer runs (periodic text) become several regions.
RUN = 400
#: Bytes of text that one shard's suffix array is built over, about; anchors with more are made longer.
SHARD_BYTES = 1 << 19
#: Which document: rows with an id come first, in its order; others by their digest.
DOCUMENT = ["late", "id", "text"]
_REGION = np.dtype([("row", np.int64), ("hash", np.uint64), ("start", np.int64), ("count", np.int64)])


def rolling(buf: np.ndarray, k: int, step: np.uint64 = _STEP) -> np.ndarray:
    """A 64-bit hash of each k bytes of buf, by doubling."""
    cur, size, p, out, have, left = _BYTE[buf], 1, step, None, 0, k
    while True:
        if left & 1:
            if out is None:
                out, have = cur, size
            else:
                m = len(cur) - have
                out, have = out[:m] * p + cur[have:], have + size
        left >>= 1
        if not left:
            return mix(out[: max(0, len(buf) - k + 1)])
        m = max(0, len(cur) - size)
        cur, size = cur[:m] * p + cur[size : size + m], size * 2
        p = np.uint64(int(p) * int(p) % 2**64)


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    size = 1
    while size * 2 <= w:
        h, size = np.minimum(h[:-size], h[size:]), size * 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def _lows(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The K-byte hashes of buf; and of all windows of one row: row, start in it, smallest hash."""
    k = min(K, length)
    if len(buf) < length:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(0, np.uint64)
    h = rolling(buf, k)
    low = _smallest(h, length - k + 1)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(sizes.sum())) - first[row]
    return h, row, at, low[at + offsets[row]]


def regions(buf: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Runs of window starts of one row that share the smallest hash of their K-byte strings."""
    if is_long(buf, offsets):
        out = []
        for lo in range(0, len(buf) - length + 1, SLICE_BYTES):
            part = buf[lo : lo + SLICE_BYTES + length - 1]
            out.append(regions(part, np.array([0, len(part)]), length))
            out[-1]["start"] += lo
        return np.concatenate(out)
    _, row, at, low = _lows(buf, offsets, length)
    if not len(at):
        return np.zeros(0, _REGION)
    fresh = np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
    run = np.flatnonzero(fresh)
    inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    fresh |= inside % RUN == 0
    run = np.flatnonzero(fresh)
    out = np.empty(len(run), _REGION)
    out["row"], out["hash"], out["start"], out["count"] = row[run], low[run], at[run], np.diff(np.append(run, len(at)))
    return out


def chosen(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every place whose K-byte hash is the smallest of a window around it."""
    if is_long(buf, offsets):
        found = {}
        for lo in range(0, len(buf) - length + 1, SLICE_BYTES):
            part = buf[lo : lo + SLICE_BYTES + length - 1]
            at, h = _chosen(part, np.array([0, len(part)]), length)
            found |= dict(zip((at + lo).tolist(), h.tolist()))  # parts overlap
        return np.zeros(len(found), np.int64), np.array(list(found.values()), np.uint64)
    place, h = _chosen(buf, offsets, length)
    return np.searchsorted(offsets, place, "right") - 1, h


def _chosen(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    h, row, at, low = _lows(buf, offsets, length)
    w = length - min(K, length) + 1
    around = np.zeros(len(h) + w - 1, np.uint64)
    around[w - 1 + at + offsets[row]] = low
    place = np.flatnonzero((~_smallest(~around, w))[: len(h)] == h) if len(h) else np.zeros(0, np.int64)
    return place, h[place]


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    buf, offsets = byte_view(column)
    for lo, hi in slices(offsets):
        yield lo, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _marks(length: int):
    """(hash, text mark): two marks where one text holds the hash more than once."""

    def run(batches):
        for batch in batches:
            hashes, marks = [], []
            for _, buf, offs in _parts(batch.column(0)):
                row, h = chosen(buf, offs, length)
                if not len(h):
                    continue
                own = np.array([int.from_bytes(hashlib.md5(buf[a:b]).digest()[8:], "big", signed=True) for a, b in zip(offs[:-1], offs[1:])], np.int64)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
                twice = new[np.diff(np.append(new, len(h))) > 1]
                hashes += [to_long(h[new]), to_long(h[twice])]
                marks += [own[row[new]], ~own[row[twice]]]
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(marks))], ["hash", "mark"])
            trim()

    return run


def _places(length: int):
    """(hash, late, id, text, at): each region's place; at holds start and count."""

    def run(batches):
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            for lo, buf, offs in _parts(batch.column(3)):
                r = regions(buf, offs, length)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(to_long(r["hash"])), *(pa.array(x[lo + r["row"]]) for x in own), pa.array(r["start"] * 1024 + r["count"])], ["hash", *DOCUMENT, "at"])
            trim()

    return run


#: A region or a part of one: its anchor's hash, a digest of its bytes, its place, its bytes, and where in them the anchor is (-1: not yet known).
_PIECE = "hash long, body_hash binary, late int, id long, text long, at long, body binary, anchor int"


class _Pieces:
    """Pieces of one task; bytes that it has already sent are not sent again."""

    def __init__(self):
        self.seen: dict[tuple[int, bytes], bytes] = {}
        self.rows: list[tuple] = []

    def add(self, hash_: int, place: tuple, body: bytes, anchor: int) -> None:
        mark = hashlib.blake2b(body, digest_size=16).digest()
        fresh = self.seen.get((hash_, mark)) != body
        if fresh:
            self.seen[(hash_, mark)] = body
        self.rows.append((hash_, mark, *place, body if fresh else None, anchor))

    def batch(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
        names = [x.split()[0] for x in _PIECE.split(", ")]
        columns = list(zip(*self.rows)) or [()] * len(types)
        self.rows = []
        if len(self.seen) > 100_000:
            self.seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _bodies(length: int):
    """The regions' places with their bytes."""

    def run(batches):
        pieces = _Pieces()
        for batch in portions(batches):
            buf, offsets = byte_view(batch.column(3))
            for i, (late, id_, text, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(4))):
                data, v = buf[offsets[i] : offsets[i + 1]].tobytes(), places.values
                for h, at in sorted(set(zip(v.field(0).to_pylist(), v.field(1).to_pylist()))):
                    pieces.add(h, (late, id_, text, at), data[at >> 10 : (at >> 10) + (at & 1023) + length - 1], -1)
                if len(pieces.rows) > 50_000:
                    yield pieces.batch()
            yield pieces.batch()

    return run


def halved(body: bytes, hash_: int, anchor: int, length: int, k: int) -> Iterator[tuple[int, int, bytes, int]]:
    """Runs of a piece's windows with one longer anchor each: (first window, number, anchor's bytes, place of the anchor in the run).

    Windows that reach at least half of the bytes beside the anchor on its left go on with these, others with as many on its right.
    """
    half, n = -(-(length - k) // 2), len(body) - length + 1
    if anchor >= 0:
        runs = [(0, n, anchor)]
    else:  # each window's anchor is the first of its strings with the smallest hash
        at = np.flatnonzero(to_long(rolling(np.frombuffer(body, np.uint8), k)) == hash_)
        own = at[np.searchsorted(at, np.arange(n))]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        runs = [(int(a), int(b), int(own[a])) for a, b in zip(cut, [*cut[1:], n])]
    for lo, hi, p in runs:
        middle = min(max(p - half + 1, lo), hi)
        if lo < middle:
            yield lo, middle - lo, body[p - half : p + k], p - half - lo
        if middle < hi:
            yield middle, hi - middle, body[p : p + k + half], p - middle


def _halved(length: int, k: int):
    """Distinct pieces cut into runs with longer anchors."""

    def run(batches):
        pieces = _Pieces()
        for batch in portions(batches):
            for h, late, id_, text, at, body, anchor in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for first, count, key, place in halved(body, h, anchor, length, k):
                    mark = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big", signed=True)
                    pieces.add(mark, (late, id_, text, ((at >> 10) + first) * 1024 + count), body[first : first + count + length - 1], place)
            yield pieces.batch()

    return run


def _sorted_shard(length: int):
    """Of one shard's distinct regions: the runs of windows that start earlier elsewhere, as byte ranges of their first place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bodies = pdf["body"].tolist()
        sizes = np.array([len(b) for b in bodies], np.int64)
        base = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
        s = raw.astype(np.int16) + 2
        s[base + sizes] = 1
        order = suffix_array(np.append(s, np.int16(0)), 258)
        owner = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes + 1)
        offset = (np.arange(len(raw)) - base[owner]).astype(np.int32)
        order = order[order < len(raw)]
        order = order[offset[order] + length <= sizes[owner[order]]]
        common = permuted_prefixes(np.append(raw, np.zeros(length, np.uint8)), order, length)
        lates, ids, texts, begin = pdf["late"].to_numpy(), pdf["id"].to_numpy(), pdf["text"].to_numpy(), (pdf["at"].to_numpy() >> 10)
        own = owner[order]
        place = begin[own] + offset[order]
        # documents are numbered in their order, so one number tells which of two windows starts first
        by = np.lexsort((texts, ids, lates))
        fresh = (np.diff(lates[by]) != 0) | (np.diff(ids[by]) != 0) | (np.diff(texts[by]) != 0)
        number = np.empty(len(by), np.int64)
        number[by] = np.concatenate([[0], np.cumsum(fresh)])
        rank = (number[own] << 40) | place
        group = np.flatnonzero(np.concatenate([[True], common[1:] < length]))
        least = np.repeat(np.minimum.reduceat(rank, group), np.diff(np.append(group, len(order))))
        late = np.sort(order[rank != least])
        del order, common, rank, least, place, own, group, raw, s
        trim()
        if not len(late):
            return pd.DataFrame({"late": [], "id": [], "text": [], "lo": [], "hi": []}, dtype="int64")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(late) > 1]))
        first, last = late[cut], late[np.append(cut[1:], len(late)) - 1]
        o = owner[first]
        return pd.DataFrame({"late": lates[o], "id": ids[o], "text": texts[o], "lo": begin[o] + offset[first], "hi": begin[o] + offset[last] + length})

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their ends."""
    out = []
    for lo, hi in spans:
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def _cut(length: int):
    def run(batches):
        for batch in portions(batches):
            out: list[list] = [[], [], [], [], [], []]
            for id_, text, spans, copy in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = (text or "").encode("utf-8", "surrogatepass")
                cut = merged([(x["lo"], x["hi"]) for x in spans or ()])
                if copy:
                    cut = [(0, len(data))]
                kept, at = [], 0
                for lo, hi in cut:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                kept = b"".join(kept)
                clean, at = [], 0
                for lo, hi in _whole_characters(data, cut):
                    clean.append(data[at:lo])
                    at = hi
                clean.append(data[at:])
                for c, x in zip(out, (id_, len(data), len(data) - len(kept), [{"lo": a, "hi": b} for a, b in cut], hashlib.sha256(kept).hexdigest(), b"".join(clean).decode("utf-8", "replace"))):
                    c.append(x)
            spans_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], spans_type), pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), batch.column(4)], ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept_text", "carried"])

    return run


def _distinct(pieces: DataFrame) -> DataFrame:
    """Of each piece's bytes the first place. Digests only deal pieces out; the bytes behind equal ones are compared."""
    least = F.min(F.struct(*DOCUMENT, "at")).alias("least")
    one = pieces.groupBy("hash", "body_hash").agg(least, F.min("body").alias("body"), F.max("body").alias("other"), F.max("anchor").alias("anchor"))
    body = F.when(F.col("body") == F.col("other"), F.col("body")).otherwise(F.raise_error(F.lit("two texts with one 128-bit digest")).cast("binary"))
    return save(one.select("hash", "body_hash", "least.*", body.alias("body"), "anchor"), "distinct")


def _late(pieces: DataFrame, length: int) -> DataFrame:
    """The byte ranges of windows that start earlier elsewhere, from all pieces: (late, id, text, lo, hi)."""
    start, stop = F.shiftright("at", 10), F.shiftright("at", 10) + F.col("at").bitwiseAND(1023) + (length - 1)
    place, spans, k = F.struct(*DOCUMENT, "at"), [], min(K, length)
    while True:
        distinct = _distinct(pieces)
        # a piece whose bytes stand earlier is removed whole
        firsts = distinct.select("hash", "body_hash", place.alias("least"))
        later = pieces.select("hash", "body_hash", *DOCUMENT, "at").join(firsts, ["hash", "body_hash"]).where(place != F.col("least"))
        spans.append(later.select(*DOCUMENT, start.alias("lo"), stop.alias("hi")))
        # of the others, those of an anchor are sorted together
        sizes = distinct.groupBy("hash").agg(F.sum(F.octet_length("body")).alias("bytes"))
        hot = save(sizes.where(F.col("bytes") > (SHARD_BYTES if k < length else 2**62)).select("hash"), "hot")
        total = distinct.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
        shards = max(1, -(-total // SHARD_BYTES))
        cold = distinct.join(hot, "hash", "left_anti").withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)))
        found = cold.select("shard", *DOCUMENT, "at", "body").groupBy("shard").applyInPandas(_sorted_shard(length), "late int, id long, text long, lo long, hi long")
        spans.append(found)
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, spans)
        rows = distinct.join(hot, "hash", "left_semi").select("hash", *DOCUMENT, "at", "body", "anchor")
        pieces = save(rows.mapInArrow(_halved(length, k), _PIECE), "pieces")
        k += -(-(length - k) // 2)


def cut_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = 100, carry: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """One row per row of docs: (id, n_bytes, n_removed, spans, kept_sha256, kept_text), and what carry names as `carried`.

    A byte is removed when a string of `length` bytes that covers it also starts earlier: in a document with a smaller
    id, or earlier in its own; strings are judged on the input. spans are the maximal removed byte runs, kept_sha256
    is over the remaining bytes; kept_text keeps characters whole that a span cuts.

    Of equal texts (by SHA-256) only the one with the smallest id takes part, the others lose all bytes if they have
    `length`. A region that occurs often is sorted once, its other places are removed whole. Anchors that too many
    different regions share are made longer (see above), so no shard grows with a common phrase, and every window that
    is removed was found by sorting, or lies in a region whose bytes were compared.

    Null text is empty. Null ids come after all others, in the order of 128 bits of their texts' SHA-256. Rows that
    repeat an id and a text are one document; different texts of one id are ordered by 64 bits of their hash. Texts
    shorter than `length` stay whole; very long ones are looked at part by part. With `tie`, a long column that tells
    rows of one id (or of none) apart, each row is a document, in the column's order. Empty tables and extra columns
    are fine.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    digest, given = F.sha2(content, 256), F.col(id).cast("long")
    bits = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    names = (bits(1), bits(17)) if tie is None else (F.col(tie), F.col(tie))
    own = docs.select(given.alias("given"), given.isNull().cast("int").alias("late"), F.coalesce(given, names[0]).alias("id"), (F.when(given.isNull(), names[1]).otherwise(names[0])).alias("text"), content.alias("content"), digest.alias("digest"), F.struct(*(F.col(f"`{c}`") for c in carry or (id,))).alias("carried"))
    enough = F.octet_length("content") >= length
    # later copies of a whole text
    order = F.struct("late", "id") if tie is None else F.struct(*DOCUMENT)
    short = own.where(enough).select(*DOCUMENT, F.unhex("digest").alias("digest"))
    groups = save(short.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last"), "copies")
    copies = save(short.join(groups, "digest").where(order != F.col("first")).select(*DOCUMENT).distinct(), "late")
    # hashes that occur more than once
    marked = own.where(enough).select("content").mapInArrow(_marks(length), "hash long, mark long")
    repeated = save(marked.groupBy("hash").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).where("x <> y").select("hash"), "repeated")
    places = own.where(enough).select(*DOCUMENT, "content").mapInArrow(_places(length), "hash long, late int, id long, text long, at long")
    places = places.join(repeated, "hash", "left_semi").join(copies, DOCUMENT, "left_anti")
    found = save(places.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("hash", "at")).alias("places")), "places")
    held = bitmap(found.select(F.xxhash64(*DOCUMENT)))
    with_text = likely(own.where(enough).select(*DOCUMENT, "content"), F.xxhash64(*DOCUMENT), held).join(found, DOCUMENT).select(*DOCUMENT, "content", "places")
    pieces = save(with_text.mapInArrow(_bodies(length), _PIECE), "pieces")
    spans = save(_late(pieces, length).groupBy(*DOCUMENT).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    drop(groups, repeated, found, held, pieces)
    gone = spans.join(copies.withColumn("copy", F.lit(True)), DOCUMENT, "full").select(*DOCUMENT, "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    rows = own.select("given", *DOCUMENT, "content", "carried").join(gone, DOCUMENT, "left").select("given", "content", "spans", F.coalesce("copy", F.lit(False)).alias("copy"), "carried")
    schema = T.StructType.fromDDL("id long, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept_sha256 string, kept_text string")
    out = rows.mapInArrow(_cut(length), schema.add(rows.schema["carried"])).withColumnRenamed("id", id)
    return out if carry else out.drop("carried")
