"""Whole analyses: fold a delivered trace, materialize schedules, compare pristine and faulted sides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import Limits
from ..operators import compare, faults, fold, normalize, relational, validate
from ..scratch import settled


@dataclass
class Trace:
    """The tables of one or many traces; the trace column keeps them apart."""

    streams: DataFrame
    envelopes: DataFrame
    schedules: DataFrame
    records: DataFrame | None = None


def assemble(records: DataFrame, decisions: DataFrame, limits: Limits = Limits(), traces: DataFrame | None = None) -> tuple[Trace, DataFrame]:
    """Tables from decoded records, without the traces that fail; and the first failure of each of those.

    traces (trace) names what was read, so that a trace without any record is a failure too, not an absence.
    """
    records = settled(records, "records")
    streams, envelopes, schedules = (settled(f(records), f.__name__) for f in (normalize.streams, normalize.envelopes, normalize.schedules))
    every = validate.violations(records, streams, envelopes, schedules, limits, decisions)
    if traces is not None:
        every = every.unionByName(validate.missing_headers(traces, records))
    found = settled(validate.first_failures(every), "failures")
    sound = lambda df: df.join(found.select("trace"), "trace", "left_anti")
    streams = normalize.with_authority(sound(streams), decisions)
    return Trace(streams, normalize.placed(sound(envelopes), streams), sound(schedules), sound(records)), found


def once(trace: Trace) -> Trace:
    """The trace's tables computed once: every step below reads them several times. Tables that are written stay as they are."""
    return Trace(settled(trace.streams, "streams"), settled(trace.envelopes, "envelopes"), settled(trace.schedules, "schedules"), trace.records)


def whole(trace: Trace) -> DataFrame:
    """A schedule without actions behind everything: the delivered trace itself."""
    n = trace.envelopes.groupBy("trace").agg(F.count("*").cast("int").alias("source_prefix"))
    s = trace.streams.groupBy("trace").agg(F.count("*").cast("int").alias("stream_prefix"))
    return s.join(n, "trace", "left").select("trace", F.lit(0).alias("schedule_idx"), F.lit("delivered").alias("schedule_id"), "stream_prefix", F.coalesce("source_prefix", F.lit(0)).alias("source_prefix"), F.array().cast("array<string>").alias("actions"))


def order(trace: Trace, faulted: bool = True, exact: bool | None = None) -> DataFrame:
    """The order in which each side of each schedule delivers, as numbers.

    Schedules that only drop and duplicate originals have an order that is one sort; the others are edited exactly
    (all of them with exact=True).
    """
    out = faults.pristine(trace.schedules)
    if faulted:
        plans = faults.plans(trace.schedules, trace.envelopes)
        edited = F.exists("actions", lambda a: (a["action"] == "move_before") | (a["target"]["occurrence"] > 0))
        hard = trace.schedules.where(edited) if exact is None else trace.schedules if exact else trace.schedules.where("false")
        easy = trace.schedules.join(hard.select("trace", "schedule_idx"), ["trace", "schedule_idx"], "left_anti")
        keys = ["trace", "schedule_idx"]
        of = lambda s: plans.join(s.select(*keys), keys, "left_semi")
        for part in (faults.materialize_relational(easy, of(easy)) if exact is not True else None, faults.materialize(hard, of(hard)) if exact is not False else None):
            if part is not None:
                out = out.unionByName(part)
    return out


def deliveries(trace: Trace, faulted: bool = True, exact: bool | None = None) -> DataFrame:
    """What each side of each schedule delivers, in order, with payloads."""
    return faults.with_payload(order(trace, faulted, exact), trace.envelopes)


def fold_delivered(trace: Trace, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Summaries and dispositions of traces as they were delivered."""
    trace = Trace(settled(trace.streams, "streams"), settled(trace.envelopes, "envelopes"), whole(trace))
    visible, rows = fold.visible_streams(trace.schedules, trace.streams, (faults.PRISTINE,)), deliveries(trace, faulted=False)
    return fold.summaries(visible, rows, limits), fold.dispositions(visible, rows, limits)


def both_sides(trace: Trace, limits: Limits = Limits(), force_exact: bool = False) -> DataFrame:
    """Summaries of both sides of every schedule: by the closed form where it holds for sure, else by the exact fold."""
    trace = once(trace)
    rows = settled(deliveries(trace), "deliveries")
    visible = settled(fold.visible_streams(trace.schedules, trace.streams, (faults.PRISTINE, faults.FAULTED)), "visible")
    if force_exact:
        return fold.summaries(visible, rows, limits)
    cursors = settled(relational.distinct_cursors(rows), "cursors")
    easy = settled(relational.qualifying(visible, cursors, limits), "qualifying")
    keys = relational.KEY
    hard = visible.join(easy.select(*keys), keys, "left_anti")
    closed = relational.summaries(easy, cursors.join(easy.select(*keys), keys, "left_semi"))
    exact = fold.summaries(hard, rows.join(hard.select(*keys), keys, "left_semi"), limits)
    return closed.unionByName(exact.select(*closed.columns, "error_code", "error_pos"), allowMissingColumns=True)


def comparison(trace: Trace, limits: Limits = Limits(), force_exact: bool = False) -> DataFrame:
    """Verdicts of every schedule and stream."""
    return compare.verdicts(both_sides(trace, limits, force_exact))
