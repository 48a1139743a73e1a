"""The fold's closed form: windows and aggregates where no payloads conflict and no limit can be met.

The anchor is the last eligible clear, or the stream's start; the frontier is the end of the run of delivered cursors
from there; the view is the last operation on each key between them. Everything stays in the JVM, a hot stream's rows
are aggregated by many tasks before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import Limits

KEY = ["trace", "schedule_idx", "mode", "stream_idx"]


def distinct_cursors(deliveries: DataFrame) -> DataFrame:
    """Each delivered cursor once, with its payload and the place of its first delivery."""
    first = F.min_by(F.struct("delivery_pos", "fingerprint", "canonical_bytes", "first_clear", "ops"), "delivery_pos").alias("d")
    return deliveries.groupBy(*KEY, "cursor").agg(first, F.min("fingerprint").alias("_p"), F.max("fingerprint").alias("_q"), F.count("*").alias("deliveries")).select(*KEY, "cursor", "d.*", (F.col("_p") != F.col("_q")).alias("conflict"), "deliveries")


def qualifying(visible: DataFrame, cursors: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The streams for which the closed form holds for sure: no conflicting payloads, no limit in reach."""
    stored = F.aggregate("ops", F.lit(0).cast("long"), lambda t, o: t + F.coalesce(F.when(o["op"] == "store_run", F.size(o["keys"])), F.lit(0)))
    named = F.aggregate("ops", F.lit(0).cast("long"), lambda t, o: t + F.coalesce(F.when(o["op"] == "store_run", F.aggregate(o["sizes"], F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)))
    facts = cursors.groupBy(*KEY).agg(
        F.max("conflict").alias("conflict"), F.count("*").alias("n"), F.max("cursor").alias("top"), F.sum("canonical_bytes").alias("bytes"), F.sum(stored).alias("keys"), F.sum(named).alias("key_bytes"), F.min("cursor").alias("low")
    )
    held = visible.join(facts, KEY, "left")
    ok = (
        ~F.col("conflict")
        & (F.col("low") >= F.col("initial_cursor"))
        & (F.col("n") <= limits.max_pending_envelopes_per_stream)
        & (F.col("top") - F.col("initial_cursor") <= limits.max_gap_span_per_stream)
        & (F.col("bytes") <= limits.max_pending_canonical_bytes_per_stream)
        & (F.col("keys") <= limits.max_cache_keys_per_stream)
        & (F.col("key_bytes") <= limits.max_cache_identity_bytes_per_stream)
    )
    return held.where(F.col("n").isNull() | ok).select(*KEY, "initial_cursor", "trusted")


def anchors(streams: DataFrame, cursors: DataFrame) -> DataFrame:
    """Where each stream's view starts: its last eligible clear, else its trusted start, else its first delivery."""
    clears = F.col("first_clear").isNotNull()
    firsts = cursors.groupBy(*KEY).agg(F.min_by("cursor", "delivery_pos").alias("c0"))
    last = cursors.join(firsts, KEY).join(streams, KEY).where(clears & (F.col("trusted") | (F.col("cursor") >= F.col("c0")))).groupBy(*KEY).agg(F.max("cursor").alias("clear_at"))
    out = streams.join(firsts, KEY, "left").join(last, KEY, "left")
    return out.withColumn("anchor", F.coalesce("clear_at", F.when(F.col("trusted"), F.col("initial_cursor")), "c0"))


def islands(cursors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Delivered cursors from the anchor on, with the start of the unbroken run they belong to."""
    w = Window.partitionBy(*KEY).orderBy("cursor")
    rows = cursors.join(anchors.select(*KEY, "anchor", "clear_at", "trusted"), KEY).where("cursor >= anchor")
    return rows.withColumn("run", F.col("cursor") - F.row_number().over(w) + 1)


def frontiers(cursors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Streams with anchor and frontier (null if the anchor itself was not delivered), pending count, and certainty."""
    rows = islands(cursors, anchors)
    front = rows.where("run = anchor").groupBy(*KEY).agg(F.max("cursor").alias("frontier"))
    out = anchors.join(front, KEY, "left")
    counts = cursors.join(out.select(*KEY, "frontier"), KEY).groupBy(*KEY).agg(F.sum((F.col("frontier").isNull() | (F.col("cursor") > F.col("frontier"))).cast("int")).cast("long").alias("pending"))
    out = out.join(counts, KEY, "left").withColumn("pending", F.coalesce("pending", F.lit(0)).cast("long"))
    out = out.withColumn("authoritative", F.col("trusted") | F.col("clear_at").isNotNull())
    reasons = F.when(F.col("authoritative"), 0).otherwise(1) + F.when(F.col("pending") > 0, 8).otherwise(0)
    out = out.withColumn("reasons", reasons.cast("int"))
    return out.withColumn("certainty", F.when(F.col("reasons") == 0, "exact").otherwise("unknown"))


def operations(cursors: DataFrame) -> DataFrame:
    """Operations one by one, in order: (key columns, cursor, mut_idx, hash_idx, op, key, key_bytes); a clear has no key."""
    m = cursors.select(*KEY, "cursor", F.posexplode("ops").alias("mut_idx", "o"))
    return m.select(*KEY, "cursor", "mut_idx", F.col("o.op").alias("op"), F.posexplode_outer(F.arrays_zip(F.col("o.keys"), F.col("o.sizes"))).alias("hash_idx", "k")).select(*KEY, "cursor", "mut_idx", F.coalesce("hash_idx", F.lit(0)).alias("hash_idx"), "op", F.col("k.keys").alias("key"), F.col("k.sizes").alias("key_bytes"))


def _order() -> Column:
    return F.struct("cursor", "mut_idx", "hash_idx")


def views(cursors: DataFrame, frontiers: DataFrame) -> DataFrame:
    """The keys that each stream's view holds: last operation wins, from the last clear on."""
    span = operations(cursors).join(frontiers.select(*KEY, "anchor", "frontier"), KEY).where("cursor >= anchor and cursor <= frontier")
    wiped = span.where("op = 'clear'").groupBy(*KEY).agg(F.max(_order()).alias("wiped"))
    live = span.where("op <> 'clear'").join(wiped, KEY, "left").where(F.col("wiped").isNull() | (_order() > F.col("wiped")))
    last = live.groupBy(*KEY, "key").agg(F.max_by(F.struct("op", "key_bytes"), _order()).alias("x"))
    return last.where("x.op = 'store_run'").select(*KEY, "key", F.col("x.key_bytes").alias("key_bytes"))


def summaries(streams: DataFrame, cursors: DataFrame) -> DataFrame:
    """The closed form's summary of each qualifying stream."""
    front = frontiers(cursors, anchors(streams, cursors))
    keys = views(cursors, front).groupBy(*KEY).agg(F.count("*").alias("key_count"), F.sum("key_bytes").alias("identity_bytes"), F.sort_array(F.collect_list("key")).alias("view"))
    waiting = cursors.join(front.select(*KEY, "frontier"), KEY).where("frontier is null or cursor > frontier").groupBy(*KEY).agg(F.sum("canonical_bytes").alias("pending_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = front.join(keys, KEY, "left").join(waiting, KEY, "left")
    return out.select(*KEY, "certainty", F.col("frontier").cast("decimal(20,0)").alias("frontier"), "authoritative", zero("key_count"), zero("identity_bytes"), F.coalesce("view", F.array().cast("array<string>")).alias("view"), "pending", zero("pending_bytes"), "reasons")


def missing_removes(cursors: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Removes, up to the frontier, of keys that weren't there; an era ends at each clear. For in-order exact streams."""
    upto = operations(cursors).join(frontiers.select(*KEY, "frontier"), KEY).where("cursor <= frontier")
    w = Window.partitionBy(*KEY).orderBy("cursor", "mut_idx", "hash_idx")
    rows = upto.withColumn("era", F.sum((F.col("op") == "clear").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("op <> 'clear'")
    before = F.lag("op").over(Window.partitionBy(*KEY, "key", "era").orderBy("cursor", "mut_idx", "hash_idx"))
    return rows.withColumn("before", before).where("op = 'remove' and (before is null or before = 'remove')").groupBy(*KEY).agg(F.count("*").alias("missing_removes"))


def dispositions(deliveries: DataFrame, streams: DataFrame) -> DataFrame:
    """Dispositions of streams without clears, conflicts or limits in reach: applied, buffered, duplicate, stale_unverifiable.

    A stream whose start isn't trusted starts at its first delivery; what lies before that is too old to be judged.
    """
    firsts = deliveries.groupBy(*KEY).agg(F.min_by("cursor", "delivery_pos").alias("c0"))
    start = F.when(F.col("trusted"), F.col("initial_cursor")).otherwise(F.col("c0"))
    rows = deliveries.join(streams.select(*KEY, "initial_cursor", "trusted"), KEY).join(firsts, KEY).withColumn("start", start)
    nth = Window.partitionBy(*KEY, "cursor").orderBy("delivery_pos")
    rows = rows.withColumn("nth", F.row_number().over(nth))
    up = Window.partitionBy(*KEY).orderBy("cursor")
    first = rows.where("nth = 1 and cursor >= start").withColumn("dense", F.col("cursor") - F.col("start") + 1 == F.row_number().over(up))
    first = first.withColumn("latest", F.max("delivery_pos").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    ready = F.col("dense") & (F.col("latest") == F.col("delivery_pos"))
    told = first.select(*KEY, "delivery_pos", F.when(ready, "applied").otherwise("buffered").alias("disposition"))
    rest = F.when(F.col("cursor") < F.col("start"), "stale_unverifiable").otherwise("duplicate")
    return rows.join(told, [*KEY, "delivery_pos"], "left").select(*KEY, "delivery_pos", "source_idx", "occurrence", "cursor", F.coalesce("disposition", rest).alias("disposition"))


def recent(cursors: DataFrame, frontiers: DataFrame, window: int) -> DataFrame:
    """The prints that a stream still holds: the highest applied cursors since its anchor."""
    applied = cursors.join(frontiers.select(*KEY, "anchor", "frontier"), KEY).where("cursor >= anchor and cursor <= frontier")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("cursor")))
    return applied.withColumn("place", place).where(F.col("place") <= window).select(*KEY, "cursor", "fingerprint")


def conflicts(deliveries: DataFrame) -> DataFrame:
    """Cursors that were delivered with different payloads."""
    return deliveries.groupBy(*KEY, "cursor").agg(F.count_distinct("fingerprint").alias("prints"), F.count("*").alias("deliveries")).where("prints > 1")
