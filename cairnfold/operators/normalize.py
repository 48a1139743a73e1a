"""Tables of streams, envelopes and schedules from records, with physical ordinals, fingerprints and baseline authority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import cache_ops, first_clear

#: Decisions about a stream's baseline; they come from outside, never from the trace.
TRUST, UNKNOWN = "trust_declared_empty", "treat_as_unknown"
SCOPE = ("engine", "engine_version", "engine_instance", "publisher", "data_parallel_rank", "epoch")


def _ordinal(name: str) -> tuple[str, object]:
    """Zero-based place among the records of one kind in a trace; a trace is bounded, so is this window."""
    return name, (F.row_number().over(Window.partitionBy("trace").orderBy("record_no")) - 1).cast("int")


def routes(records: DataFrame) -> DataFrame:
    """Each record with the side of the analysis it goes to: stream, envelope, or other."""
    return records.withColumn("route", F.when(F.col("kind").isin("stream", "envelope"), F.col("kind")).otherwise("other"))


def streams(records: DataFrame) -> DataFrame:
    rows = records.where("kind = 'stream' and error is null").select("trace", "record_no", "stream.*")
    return rows.withColumn(*_ordinal("stream_idx"))


def envelopes(records: DataFrame) -> DataFrame:
    """Envelopes with the hash of their canonical mutations; transport fields and extensions don't enter it."""
    rows = records.where("kind = 'envelope' and error is null").select("trace", "record_no", "envelope.*")
    return prepared(rows.withColumn(*_ordinal("source_idx")))


def prepared(rows: DataFrame) -> DataFrame:
    """What the fold needs of (…, mutations, canonical): computed once, before deliveries multiply the rows."""
    return rows.select(
        *(c for c in rows.columns if c not in ("canonical", "extensions", "mutations")),
        "mutations",
        F.unhex(F.sha2("canonical", 256)).alias("fingerprint"),
        F.octet_length("canonical").cast("long").alias("canonical_bytes"),
        first_clear(F.col("mutations")).alias("first_clear"),
        cache_ops(F.col("mutations")).alias("ops"),
    )


def schedules(records: DataFrame) -> DataFrame:
    """Schedules with the prefix they see: the streams and envelopes that stand before them."""
    before = Window.partitionBy("trace").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda kind: F.coalesce(F.sum((F.col("kind") == kind).cast("int")).over(before), F.lit(0)).cast("int")
    rows = records.where("error is null").select("trace", "record_no", "kind", "schedule", seen("stream").alias("stream_prefix"), seen("envelope").alias("source_prefix"))
    rows = rows.where("kind = 'fault_schedule'").select("trace", "record_no", "schedule.*", "stream_prefix", "source_prefix")
    return rows.withColumn(*_ordinal("schedule_idx"))


def with_authority(streams: DataFrame, decisions: DataFrame) -> DataFrame:
    """Streams with their decision (trace, stream_id, authority), and whether it lets the fold start from an empty view."""
    out = streams.join(decisions.select("trace", "stream_id", "authority"), ["trace", "stream_id"], "left")
    trusted = (F.col("authority") == TRUST) & (F.col("baseline") == "empty_at_engine_start")
    return out.withColumn("trusted", F.coalesce(trusted, F.lit(False)))


def placed(envelopes: DataFrame, streams: DataFrame) -> DataFrame:
    """Envelopes with their stream's ordinal, initial cursor and trust."""
    return envelopes.join(streams.select("trace", "stream_id", "stream_idx", "initial_cursor", "trusted"), ["trace", "stream_id"])


def prefix(envelopes: DataFrame, schedules: DataFrame) -> DataFrame:
    """The envelopes that each schedule sees: an equality on the trace, then a range."""
    s = schedules.select("trace", "schedule_idx", "source_prefix")
    return envelopes.join(s, "trace").where("source_idx < source_prefix")


def lookup(table: DataFrame, ordinal: str, at: int) -> DataFrame:
    """The rows at an ordinal, one per trace at most."""
    return table.where(F.col(ordinal) == at)
