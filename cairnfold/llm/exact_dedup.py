"""Exact duplicates: 128-bit content hash, byte comparison inside each hash group, one row kept. DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, likely, save, split, whole

#: Deleted before texts are compared: space and U+0009 to U+000D.
IGNORED = r"[\x20\x09-\x0D]+"


def normalised(text: Column, ignored: str = IGNORED) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ignored, "")


def _rows(docs: DataFrame, text: str, id: str, ignored: str) -> DataFrame:
    """Each row of docs as one column, with its id, code points, normalised text and its SHA-256."""
    size = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("decimal(10,0)")
    own = docs.select(whole(docs).alias("doc"), F.col(id).cast("long").alias("_id"), size.alias("_n"), normalised(F.col(text), ignored).alias("_key"))
    return own.withColumn("_sha", F.unhex(F.sha2("_key", 256)))


def _hash() -> Column:
    return F.xxhash64(F.substring("_sha", 1, 16))


def _light(docs: DataFrame, text: str, id: str, ignored: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their hashes, written as (_id, _sha); and a bitmap of the hashes whose 128 bits occur twice."""
    every = _rows(docs, text, id, ignored)
    light = save(every.select("_id", "_sha"), "hashes")
    twice = light.groupBy(F.substring("_sha", 1, 16).alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h")
    return every, light, bitmap(twice.select(F.xxhash64("_h")))


def _groups(some: DataFrame) -> DataFrame:
    """Groups of two or more rows with equal normalised texts, written: (_sha, keep_id, most, group_size). Bytes are compared."""
    shift = F.lit(Decimal(2**64)).cast("decimal(20,0)")
    # more code points first, then the smaller id, as one number, which a hash aggregate can keep in place
    best = F.max(F.col("_n") * shift - F.col("_id").cast("decimal(20,0)"))
    most = F.max(F.when(F.col("_id").isNotNull(), F.col("_n")))
    groups = some.groupBy(F.substring("_sha", 1, 16).alias("_h"), "_key").agg(best.alias("_best"), most.alias("_most"), F.max("_n").alias("most"), F.count("*").alias("group_size")).where("group_size > 1")
    keep = (F.col("_most") * shift - F.col("_best")).cast("long").alias("keep_id")
    return save(groups.select(F.unhex(F.sha2("_key", 256)).alias("_sha"), keep, F.coalesce("_most", "most").alias("most"), "group_size"), "copies")


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", ignored: str = IGNORED) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, text_sha256).

    Rows are grouped by the leading 128 bits of the normalised text's SHA-256 together with its bytes, so rows whose
    hashes collide stay apart; only texts whose hash occurs twice (a bitmap tells, in 8 MB, at worst of too many) are
    moved, and partial aggregation collapses copies before that, so a text that a third of the rows share costs one
    row per task. The row with the most code points in its original text, then with the smallest id, stays. The way
    back from groups to rows moves hashes only, and a hot hash's rows are dealt by the skew join.

    Null text is the empty text; all texts without other characters are equal. Rows with a null id count in
    group_size but stay only if their group has no id at all (keep_id is null then). Rows that repeat an id share its
    result. An empty table gives an empty table; other columns are not looked at.
    """
    every, light, bits = _light(docs, text, id, ignored)
    groups = _groups(likely(every, _hash(), bits))
    alone = F.col("group_size").isNull()
    return light.join(groups, "_sha", "left").select(
        F.col("_id").alias(id),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def distinct_rows(docs: DataFrame, text: str = "text", id: str = "doc_id", ignored: str = IGNORED) -> DataFrame:
    """Of each group of rows with equal normalised texts exactly one row of docs, with all its columns.

    It is the row that exact_dedup() keeps; where several rows have its id and as many code points (rows that repeat an
    id, or null ids in a group without any id), the least of them in the order of all columns, and wholly equal rows
    are collapsed to one. Rows with texts of their own pass without being moved. Null text is the empty text. An empty
    table gives an empty table.
    """
    every, _, bits = _light(docs, text, id, ignored)
    maybe, surely = split(every, _hash(), bits)
    maybe = save(maybe, "maybe")
    met = maybe.select("doc", "_id", "_n", "_sha").join(_groups(maybe), "_sha", "left")
    best = met.where("group_size is not null and _id <=> keep_id and _n = most").groupBy("_sha").agg(F.min("doc").alias("doc"))
    return surely.select("doc").unionByName(met.where("group_size is null").select("doc")).unionByName(best.select("doc")).select("doc.*")
