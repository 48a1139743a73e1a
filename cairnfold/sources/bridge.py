"""Traces from an events table: eight users make a trace, a user is a stream, an event is an envelope.

The mapping is deterministic and native. Ordinals are windows within a trace, never over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.normalize import TRUST, UNKNOWN, prepared
from ..schema import ACTION, MUTATION

#: Users of one trace.
USERS = 8


def _mutation(op: str, hashes: Column | None = None, gpu: bool = False) -> Column:
    """A mutation in the full column type."""
    fields = {"op": F.lit(op), "metadata": F.lit("{}")}
    if hashes is not None:
        fields["hashes"] = F.transform(hashes, lambda k: F.struct(F.lit("u64").alias("encoding"), k.cast("decimal(20,0)").alias("u64"), F.lit(None).cast("binary").alias("bytes")))
        fields["grp"] = F.struct(F.lit("index" if gpu else "unspecified").alias("kind"), F.lit(0 if gpu else None).cast("bigint").alias("value"))
        fields["medium"] = F.struct(F.lit("named" if gpu else "unspecified").alias("kind"), F.lit("GPU" if gpu else None).cast("string").alias("value"))
    names = ["op", "hashes", "grp", "medium", "lineage", "token_count", "token_evidence", "block_size", "block_metadata", "metadata"]
    return F.array(F.struct(*(fields.get(n, F.lit(None)).alias(n) for n in names))).cast(f"array<{MUTATION}>")


def canonical_text(mutations: Column) -> Column:
    """RFC 8785 text of mutations that have u64 hashes, empty metadata and nothing optional, as the bridge makes them."""
    kind = lambda s, quoted: F.concat(F.lit('{"kind":"'), s["kind"], F.lit('"'), F.when(s["value"].isNotNull(), F.concat(F.lit(',"value":'), F.lit('"' if quoted else ""), s["value"].cast("string"), F.lit('"' if quoted else ""))).otherwise(""), F.lit("}"))
    hashes = lambda m: F.array_join(F.transform(m["hashes"], lambda h: F.concat(F.lit('{"encoding":"u64","value":"'), h["u64"].cast("string"), F.lit('"}'))), ",")
    one = lambda m: F.when(m["op"] == "clear", F.lit('{"metadata":{},"op":"clear"}')).otherwise(F.concat(F.lit('{"group":'), kind(m["grp"], False), F.lit(',"hashes":['), hashes(m), F.lit('],"medium":'), kind(m["medium"], True), F.lit(',"metadata":{},"op":"'), m["op"], F.lit('"}')))
    return F.concat(F.lit("["), F.array_join(F.transform(mutations, one), ","), F.lit("]"))


def keyed(events: DataFrame) -> DataFrame:
    """Events with their trace, stream and the number k in their properties."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(F.concat(F.lit("t"), F.floor(F.col("user_id") / USERS)).alias("trace"), F.concat(F.lit("u"), "user_id").alias("stream_id"), "event_id", "user_id", "ts", "event_type", k.alias("k"))


def streams(events: DataFrame) -> DataFrame:
    """A stream per user; each tenth attaches to an unknown past, and the one before it isn't trusted either."""
    users = keyed(events).select("trace", "stream_id", "user_id").distinct()
    idx = (F.row_number().over(Window.partitionBy("trace").orderBy("user_id")) - 1).cast("int")
    digit = F.col("user_id") % 10
    out = users.withColumn("stream_idx", idx)
    return out.select(
        "trace",
        (F.col("stream_idx") + 1).cast("bigint").alias("record_no"),
        "stream_idx",
        "stream_id",
        F.lit("bridge").alias("engine"),
        F.lit("1").alias("engine_version"),
        F.col("trace").alias("engine_instance"),
        F.col("stream_id").alias("publisher"),
        F.lit(0).cast("bigint").alias("data_parallel_rank"),
        F.lit("0").alias("epoch"),
        F.lit(0).cast("decimal(20,0)").alias("initial_cursor"),
        F.when(digit == 9, "unknown_at_attach").otherwise("empty_at_engine_start").alias("baseline"),
        F.when(digit.isin(8, 9), UNKNOWN).otherwise(TRUST).alias("authority"),
        (~digit.isin(8, 9)).alias("trusted"),
        "user_id",
    )


def envelopes(events: DataFrame, clears: bool = True, shadow: bool = False) -> DataFrame:
    """An envelope per event; with shadow, events with event_id % 23 = 9 have a second one that contradicts them."""
    rows = keyed(events)
    cursor = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = rows.withColumn("cursor", cursor.cast("decimal(20,0)")).withColumn("twin", F.lit(0))
    if shadow:
        rows = rows.unionByName(rows.where("event_id % 23 = 9").withColumn("twin", F.lit(1)))
    k, kind = F.col("k"), F.col("event_type")
    store, gpu = _mutation("store_run", F.array(k)), _mutation("store_run", F.array(k), gpu=True)
    signup = F.when(k % 4 == 0, _mutation("clear")).otherwise(gpu) if clears else gpu
    made = (
        F.when(F.col("twin") == 1, _mutation("store_run", F.array(k + 1_000_000)))
        .when(kind == "view", store)
        .when(kind == "click", _mutation("store_run", F.array(k, k + 1)))
        .when(kind == "purchase", _mutation("remove", F.array(k)))
        .when(kind == "signup", signup)
        .otherwise(F.array().cast(f"array<{MUTATION}>"))
    )
    source = F.row_number().over(Window.partitionBy("trace").orderBy("event_id", "twin")) - 1
    rows = rows.withColumn("mutations", made).withColumn("source_idx", source.cast("int"))
    counts = streams(events).select("trace", "stream_id", "stream_idx", "initial_cursor", "trusted", F.count("*").over(Window.partitionBy("trace")).alias("_streams"))
    rows = rows.join(counts, ["trace", "stream_id"])
    out = rows.select(
        "trace",
        (F.col("source_idx") + F.col("_streams") + 1).cast("bigint").alias("record_no"),
        "source_idx",
        F.concat(F.when(F.col("twin") == 1, "s").otherwise("e"), "event_id").alias("envelope_id"),
        "stream_id",
        "stream_idx",
        "cursor",
        F.lit("live").alias("origin"),
        "initial_cursor",
        "trusted",
        "event_id",
        "mutations",
        canonical_text(F.col("mutations")).alias("canonical"),
    )
    return prepared(out)


def schedules(envelopes: DataFrame, drop: tuple[int, int] | None = (17, 3), duplicate: tuple[int, int] | None = (13, 5), swap: tuple[int, int] | None = None, twins_replace: bool = False) -> DataFrame:
    """One schedule per trace, behind all its envelopes, with an action for each event whose id has these remainders."""
    ref = lambda c: F.struct(c.alias("envelope_id"), F.lit(0).alias("occurrence"))
    none = F.lit(None)
    act = lambda name, anchor=none, copies=none: F.struct(F.lit(name).alias("action"), ref(F.col("envelope_id")).alias("target"), anchor.alias("anchor"), copies.alias("copies")).cast(ACTION)
    before = F.lag("envelope_id").over(Window.partitionBy("trace", "stream_id").orderBy("source_idx"))
    rows = envelopes.select("trace", "stream_id", "source_idx", "envelope_id", "event_id", before.alias("before"))
    kinds = []
    at = lambda m: F.col("event_id") % m[0] == m[1]
    original = F.col("envelope_id").startswith("e")
    if swap:
        kinds.append(F.when(at(swap) & F.col("before").isNotNull() & original, act("move_before", ref(F.col("before")))))
    if duplicate:
        kinds.append(F.when(at(duplicate) & original, act("duplicate", copies=F.lit(1))))
    if drop:
        kinds.append(F.when(at(drop) & original, act("drop")))
    if twins_replace:
        kinds.append(F.when((F.col("event_id") % 23 == 9) & original, act("drop")))
    each = rows.select("trace", "source_idx", F.posexplode(F.array(*kinds)).alias("n", "a")).where("a is not null")
    listed = each.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("n", "source_idx", "a"))).alias("x"))
    sizes = envelopes.groupBy("trace").agg(F.max("record_no").alias("last"), F.max("stream_idx").alias("top"), F.count("*").alias("n"))
    out = sizes.join(listed, "trace", "left")
    actions = F.coalesce(F.transform("x", lambda x: x["a"]), F.array().cast(f"array<{ACTION}>"))
    return out.select("trace", (F.col("last") + 1).alias("record_no"), F.lit(0).alias("schedule_idx"), F.lit("mixed").alias("schedule_id"), (F.col("top") + 1).cast("int").alias("stream_prefix"), F.col("n").cast("int").alias("source_prefix"), actions.alias("actions"))


def json_lines(streams: DataFrame, envelopes: DataFrame, trace_format: str) -> DataFrame:
    """The bridge's records as JSON text: (trace, record_no, value)."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    obj = lambda **kw: F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in kw.items())), F.lit("}"))
    text = lambda s: F.lit(f'"{s}"')
    header = streams.select("trace").distinct().select("trace", F.lit(0).cast("bigint").alias("record_no"), obj(kind=text("trace_header"), format=text(trace_format), trace_id=q(F.col("trace")), redaction=text("omitted"), created_by=text("bridge"), extensions=F.lit("{}")).alias("value"))
    s = streams.select("trace", "record_no", obj(kind=text("stream"), stream_id=q(F.col("stream_id")), engine=q(F.col("engine")), engine_version=q(F.col("engine_version")), engine_instance=q(F.col("engine_instance")), publisher=q(F.col("publisher")), data_parallel_rank=F.col("data_parallel_rank").cast("string"), epoch=q(F.col("epoch")), initial_cursor=q(F.col("initial_cursor").cast("string")), baseline=obj(kind=q(F.col("baseline"))), extensions=F.lit("{}")).alias("value"))
    e = envelopes.select("trace", "record_no", obj(kind=text("envelope"), envelope_id=q(F.col("envelope_id")), stream_id=q(F.col("stream_id")), cursor=q(F.col("cursor").cast("string")), origin=q(F.col("origin")), mutations=canonical_text(F.col("mutations")), extensions=F.lit("{}")).alias("value"))
    return header.unionByName(s).unionByName(e)
