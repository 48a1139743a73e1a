"""Trace-wide rules as queries of their own, the first failure of each trace, and summaries.

Each rule supposes that all earlier records were accepted. At a trace's first failing record that holds, and what the
rules say of later records is masked, so no record-by-record driver is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import Limits
from .normalize import SCOPE, TRUST

_PAIRS = {("keyed_digests", "keyed_digest"), ("unkeyed_linkable", "unkeyed_digest"), ("contains_token_ids", "token_ids")}
_AFTER_ACTIONS = 1_000_000_000
_NORMALISER = 2_000_000_000
IDENTITY = {
    "stream": ("stream_id", "engine", "engine_version", "engine_instance", "publisher", "epoch"),
    "envelope": ("envelope_id",),
    "schedule": ("schedule_id",),
}


def _row(df: DataFrame, rank, layer: str, code: str, field: Column | str | None = None, limit=None, actual: Column | None = None) -> DataFrame:
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(20,0)")
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    field = field if isinstance(field, Column) else F.lit(field)
    return df.select("trace", "record_no", rank.cast("long").alias("check_rank"), F.lit(layer).alias("layer"), F.lit(code).alias("code"), field.cast("string").alias("field"), number(limit).alias("limit_value"), number(actual).alias("actual_value"))


def _in_order(*keys: str):
    return Window.partitionBy("trace", *keys).orderBy("record_no")


def identity_bytes(records: DataFrame) -> Column:
    """Bytes of a record's own names."""
    sizes = [F.coalesce(F.octet_length(f"{kind}.{name}"), F.lit(0)) for kind, names in IDENTITY.items() for name in names]
    return reduce(lambda a, b: a + b, sizes).cast("long")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are not the first of their trace with these values."""
    return df.withColumn("_nth", F.row_number().over(_in_order(*keys))).where("_nth > 1").drop("_nth")


def undeclared(envelopes: DataFrame, streams: DataFrame) -> DataFrame:
    """Envelopes whose stream isn't declared before them."""
    s = streams.groupBy("trace", "stream_id").agg(F.min("record_no").alias("_from"))
    return envelopes.join(s, ["trace", "stream_id"], "left").where("_from is null or _from > record_no").drop("_from")


def redaction_breaches(envelopes: DataFrame, headers: DataFrame) -> DataFrame:
    """Envelopes with token evidence that the trace's redaction doesn't allow, and the first such mutation."""
    each = envelopes.select("trace", "record_no", F.posexplode("mutations").alias("mutation", "m")).where("m.token_evidence is not null").select("trace", "record_no", "mutation", F.col("m.token_evidence.kind").alias("evidence"))
    allowed = reduce(lambda a, b: a | b, [(F.col("redaction") == r) & (F.col("evidence") == e) for r, e in sorted(_PAIRS)])
    bad = each.join(headers.select("trace", "redaction"), "trace").where(~allowed)
    return bad.groupBy("trace", "record_no").agg(F.min("mutation").alias("mutation"))


def references(schedules: DataFrame, envelopes: DataFrame) -> DataFrame:
    """The deliveries that actions name, in order, with what exists when they are named.

    source_idx is null if no earlier envelope has the name; next is the first occurrence not yet created; removed
    tells that an earlier action dropped the delivery; first_occurrence is where a duplicate's copies begin.
    """
    acts = schedules.select("trace", "record_no", "schedule_idx", "source_prefix", F.posexplode("actions").alias("action_idx", "a"))
    roles = F.array(F.struct(F.lit("target").alias("role"), F.col("a.target").alias("ref")), F.struct(F.lit("anchor").alias("role"), F.col("a.anchor").alias("ref")))
    refs = acts.withColumn("r", F.explode(roles)).where("r.ref is not null")
    refs = refs.select("trace", "record_no", "schedule_idx", "source_prefix", "action_idx", F.col("a.action").alias("action"), F.coalesce(F.when(F.col("r.role") == "target", F.col("a.copies")), F.lit(0)).alias("copies"), "r.role", "r.ref.*")
    known = envelopes.groupBy("trace", "envelope_id").agg(F.min(F.struct("record_no", "source_idx")).alias("e"))
    refs = refs.join(known, ["trace", "envelope_id"], "left").withColumn("source_idx", F.when(F.col("e.record_no") < F.col("record_no"), F.col("e.source_idx"))).drop("e")
    step = F.struct("action_idx", F.when(F.col("role") == "target", 0).otherwise(1))
    before = lambda *keys: Window.partitionBy("trace", "schedule_idx", *keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    first = F.lit(1) + F.coalesce(F.sum("copies").over(before("source_idx")), F.lit(0))
    gone = F.coalesce(F.max((F.col("action") == "drop").cast("int")).over(before("source_idx", "occurrence")), F.lit(0)) > 0
    return refs.withColumn("next", first.cast("long")).withColumn("removed", gone).withColumn("first_occurrence", F.when((F.col("action") == "duplicate") & (F.col("role") == "target"), F.col("next")))


def schedule_work(schedules: DataFrame) -> DataFrame:
    """Each schedule's work: the deliveries it sees and those it makes."""
    made = F.aggregate("actions", F.lit(0).cast("long"), lambda t, a: t + F.coalesce(a["copies"], F.lit(0)))
    return schedules.withColumn("work", F.col("source_prefix") + made)


def violations(records: DataFrame, streams: DataFrame, envelopes: DataFrame, schedules: DataFrame, limits: Limits = Limits(), decisions: DataFrame | None = None) -> DataFrame:
    """Every rule's failures: (trace, record_no, check_rank, layer, code, field, limit_value, actual_value)."""
    limits = limits.checked()
    fine = records.where("error is null")
    out = [records.where("error is not null").select("trace", "record_no", F.lit(0).cast("long").alias("check_rank"), "error.*")]

    def over(df: DataFrame, rank, resource: str, limit: int, actual: Column) -> None:
        out.append(_row(df.withColumn("_n", actual).where(F.col("_n") > limit), rank, "trace", "trace_resource_limit", resource, limit, F.col("_n")))

    over(records, 10, "records", limits.max_records_per_trace, F.col("record_no") + 1)
    header = F.col("kind") == "trace_header"
    out.append(_row(fine.where(header & (F.col("record_no") > 0)), 30, "trace", "duplicate_header"))
    out.append(_row(fine.where(~header & (F.col("record_no") == 0)), 30, "trace", "header_not_first"))
    # streams
    out.append(_row(repeated(streams, "stream_id"), 40, "trace", "duplicate_stream_id"))
    out.append(_row(repeated(streams, *SCOPE), 41, "trace", "duplicate_stream_identity"))
    over(streams, 42, "streams", limits.max_streams_per_trace, F.row_number().over(_in_order()))
    # envelopes
    out.append(_row(repeated(envelopes, "envelope_id"), 40, "trace", "duplicate_envelope_id"))
    over(envelopes, 41, "envelopes", limits.max_envelopes_per_trace, F.row_number().over(_in_order()))
    out.append(_row(undeclared(envelopes, streams), 42, "trace", "undeclared_stream"))
    starts = streams.groupBy("trace", "stream_id").agg(F.min_by("initial_cursor", "record_no").alias("_initial"))
    out.append(_row(envelopes.join(starts, ["trace", "stream_id"]).where("cursor < _initial"), 43, "trace", "cursor_before_initial"))
    headers = fine.where(header & (F.col("record_no") == 0)).select("trace", "header.redaction")
    breaches = redaction_breaches(envelopes, headers)
    out.append(_row(breaches, 44, "trace", "token_evidence_redaction_mismatch", F.concat(F.lit("mutation "), F.col("mutation"))))
    # names of all kinds share one budget
    names = fine.withColumn("_bytes", identity_bytes(fine))
    rank = F.when(F.col("kind") == "envelope", 45).otherwise(43)
    over(names.where("kind <> 'trace_header'"), rank, "identity_bytes", limits.max_identity_bytes_per_trace, F.sum("_bytes").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    # schedules
    out.append(_row(repeated(schedules, "schedule_id"), 40, "trace", "duplicate_schedule_id"))
    over(schedules, 41, "fault_schedules", limits.max_fault_schedules_per_trace, F.row_number().over(_in_order()))
    running = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    over(schedules, 42, "fault_actions", limits.max_fault_actions_per_trace, F.sum(F.size("actions")).over(running))
    over(schedules, 44, "schedule_occurrences", limits.max_occurrences_per_schedule, F.col("source_prefix").cast("long"))
    refs = references(schedules, envelopes)
    at = 1000 + F.col("action_idx") * 10 + F.when(F.col("role") == "anchor", 3).otherwise(0)
    known = refs.where("source_idx is not null")
    out.append(_row(refs.where("source_idx is null"), at, "trace", "fault_envelope_not_prior", F.col("role")))
    out.append(_row(known.where("occurrence >= next"), at + 1, "trace", "fault_occurrence_not_created", F.col("role")))
    out.append(_row(known.where("occurrence < next and removed"), at + 2, "trace", "fault_occurrence_removed", F.col("role")))
    grown = known.where("action = 'duplicate' and role = 'target'")
    out.append(_row(grown.where("next + copies > 65536"), at + 6, "trace", "fault_occurrence_overflow"))
    total = Window.partitionBy("trace", "schedule_idx").orderBy("action_idx").rowsBetween(Window.unboundedPreceding, 0)
    grown = grown.withColumn("_made", F.col("source_prefix") + F.sum("copies").over(total))
    over(grown, at + 7, "schedule_occurrences", limits.max_occurrences_per_schedule, F.col("_made"))
    work = schedule_work(schedules)
    earlier = work.select("trace", "schedule_idx", F.coalesce(F.sum("work").over(_in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    over(grown.join(earlier, ["trace", "schedule_idx"]), at + 8, "schedule_work", limits.max_schedule_work_per_trace, F.col("_earlier") + F.col("_made"))
    over(work, _AFTER_ACTIONS, "schedule_work", limits.max_schedule_work_per_trace, F.sum("work").over(running))
    # the normaliser's own budgets
    hashed = envelopes.withColumn("_before", F.coalesce(F.sum("canonical_bytes").over(_in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = limits.max_fingerprint_bytes_per_trace - F.col("_before")
    by_trace = left < limits.max_line_bytes  # the tighter bound gives the failure its name
    out.append(_row(hashed.where(~by_trace & (F.col("canonical_bytes") > limits.max_line_bytes)), _NORMALISER, "state", "state_resource_limit", "envelope_fingerprint_bytes", limits.max_line_bytes, F.col("canonical_bytes")))
    out.append(_row(hashed.where(by_trace & (F.col("canonical_bytes") > left)), _NORMALISER, "state", "state_resource_limit", "trace_fingerprint_bytes", limits.max_fingerprint_bytes_per_trace, F.col("_before") + F.col("canonical_bytes")))
    if decisions is not None:
        told = streams.join(decisions.select("trace", "stream_id", "authority"), ["trace", "stream_id"], "left")
        out.append(_row(told.where("authority is null"), 5, "scenario", "baseline_authority_required"))
        out.append(_row(told.where((F.col("authority") == TRUST) & (F.col("baseline") != "empty_at_engine_start")), _NORMALISER, "state", "baseline_authority_mismatch"))
        stray = decisions.join(streams.select("trace", "stream_id"), ["trace", "stream_id"], "left_anti").withColumn("record_no", F.lit(0).cast("long"))
        out.append(_row(stray, 5, "scenario", "unexpected_baseline_authority", F.col("stream_id")))
    return reduce(DataFrame.unionByName, out)


def registrations(streams: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What registering declarations one after the other gives: (trace, record_no, stream_id, handle, code).

    The same declaration twice has the handle (first record) of the first; a changed one under a known name, or a known
    scope under another name, is refused, and so is what a budget has no room for. Once a trace has a refusal, the rest
    of it is refused as well. Names and limits are those of the normaliser, which may be used without the trace rules.
    """
    same = F.sha2(F.to_json(F.struct(*SCOPE, "initial_cursor", "baseline", "authority"), {"ignoreNullFields": "false"}), 256)
    named, scoped = _in_order("stream_id"), _in_order(*SCOPE)
    rows = streams.withColumn("_same", same)
    rows = rows.withColumn("handle", F.first("record_no").over(named)).withColumn("_changed", F.first("_same").over(named) != F.col("_same"))
    rows = rows.withColumn("_other", (F.col("handle") == F.col("record_no")) & (F.first("record_no").over(scoped) != F.col("record_no")))
    new = (F.col("handle") == F.col("record_no")).cast("long")
    own = reduce(lambda a, b: a + b, [F.octet_length(c) for c in ("stream_id", "engine", "engine_version", "engine_instance", "publisher", "epoch")])
    run = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_streams", F.sum(new).over(run)).withColumn("_bytes", F.sum(new * own).over(run))
    over = (new == 1) & ((F.col("_streams") > limits.max_streams_per_trace) | (F.col("_bytes") > limits.max_identity_bytes_per_trace))
    code = F.when(F.col("_changed"), "conflicting_stream_registration").when(F.col("_other"), "duplicate_stream_scope").when(over, "state_resource_limit")
    rows = rows.withColumn("code", code)
    failed = F.max(F.col("code").isNotNull().cast("int")).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("code", F.when(failed == 1, "normalizer_failed").otherwise(F.col("code")))
    return rows.select("trace", "record_no", "stream_id", F.when(F.col("code").isNull(), F.col("handle")).alias("handle"), "code")


def missing_headers(traces: DataFrame, records: DataFrame) -> DataFrame:
    """Traces (trace) that end without any record."""
    empty = traces.join(records.select("trace").distinct(), "trace", "left_anti").withColumn("record_no", F.lit(0).cast("long"))
    return _row(empty, 0, "trace", "missing_header")


def first_failures(violations: DataFrame) -> DataFrame:
    """Of each trace the failure that a reader of its records would have met first; traces without a row are sound."""
    order = F.struct("record_no", "check_rank")
    return violations.groupBy("trace").agg(F.min_by(F.struct("record_no", "check_rank", "layer", "code", "field", "limit_value", "actual_value"), order).alias("f")).select("trace", "f.*")


def summaries(records: DataFrame, schedules: DataFrame) -> DataFrame:
    """One row per trace: what it holds, and the work its schedules ask for."""
    fine = records.where("error is null").withColumn("_bytes", F.when(F.col("kind") != "trace_header", identity_bytes(records)).otherwise(0))
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int")).cast("long")
    base = fine.groupBy("trace").agg(
        F.count("*").alias("records"),
        count("stream").alias("streams"),
        count("envelope").alias("envelopes"),
        count("fault_schedule").alias("fault_schedules"),
        F.sum(F.when(F.col("kind") == "fault_schedule", F.size("schedule.actions")).otherwise(0)).cast("long").alias("fault_actions"),
        F.sum("_bytes").cast("long").alias("identity_bytes"),
        F.max("header.redaction").alias("redaction"),
    )
    work = schedule_work(schedules).groupBy("trace").agg(F.sum("work").cast("long").alias("schedule_work"))
    return base.join(work, "trace", "left").withColumn("schedule_work", F.coalesce("schedule_work", F.lit(0)).cast("long"))
