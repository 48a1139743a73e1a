"""Traces from records to verdicts, with every trace-wide rule broken once."""

import json
from functools import reduce

import pytest
from pyspark.sql import functions as F

from cairnfold.contract import as_json, as_table
from cairnfold.__main__ import main
from cairnfold.limits import Limits
from cairnfold import queries
from cairnfold.operators import compare, faults, fold, normalize, ordered, validate
from cairnfold.operators.normalize import TRUST, UNKNOWN
from cairnfold.plans.analysis import assemble, both_sides, comparison, deliveries, fold_delivered
from cairnfold.scratch import settled
from cairnfold.sources.jsonl import from_memory

from .test_codec import HEADER, STORE, STREAM, schedule

L = Limits()


def env(name, cursor, key="7", stream="s", **more):
    store = STORE | {"hashes": [{"encoding": "u64", "value": key}]} | more
    return {"kind": "envelope", "envelope_id": name, "stream_id": stream, "cursor": str(cursor), "origin": "live", "mutations": [store], "extensions": {}}


def ref(name, occurrence=0):
    return {"envelope_id": name, "occurrence": occurrence}


def drop(name, n=0):
    return {"action": "drop", "target": ref(name, n)}


def dup(name, copies, n=0):
    return {"action": "duplicate", "target": ref(name, n), "copies": copies}


def move(name, anchor):
    return {"action": "move_before", "target": ref(name), "anchor": ref(anchor)}


def records(spark, *rows, limits=L):
    return from_memory(spark, "t", [json.dumps(r).encode() for r in rows], limits)


def decided(spark, **streams):
    return spark.createDataFrame([("t", s, a) for s, a in (streams or {"s": TRUST}).items()], "trace string, stream_id string, authority string")


def failure(spark, *rows, limits=L, decisions=None):
    r = records(spark, *rows, limits=limits)
    found = validate.first_failures(validate.violations(r, normalize.streams(r), normalize.envelopes(r), normalize.schedules(r), limits, decisions)).collect()
    return [(x.record_no, x.code) for x in found]


FINE = [HEADER, STREAM, env("a", 0), env("b", 1)]


def other(**more):
    return STREAM | {"stream_id": "s2", "publisher": "p2"} | more


CASES = [
    (FINE, {}, []),
    ([STREAM, *FINE], {}, [(0, "header_not_first")]),
    ([*FINE, HEADER], {}, [(4, "duplicate_header")]),
    ([*FINE, STREAM | {"publisher": "q"}], {}, [(4, "duplicate_stream_id")]),
    ([*FINE, STREAM | {"stream_id": "s2"}], {}, [(4, "duplicate_stream_identity")]),
    ([*FINE, other()], {"max_streams_per_trace": 1}, [(4, "trace_resource_limit")]),
    ([*FINE, env("a", 2)], {}, [(4, "duplicate_envelope_id")]),
    ([*FINE, env("c", 2)], {"max_envelopes_per_trace": 2}, [(4, "trace_resource_limit")]),
    ([HEADER, STREAM, env("c", 0, stream="s2"), other()], {}, [(2, "undeclared_stream")]),
    ([HEADER, STREAM | {"initial_cursor": "5"}, env("a", 4)], {}, [(2, "cursor_before_initial")]),
    ([*FINE, env("c", 2, token_evidence={"kind": "token_ids", "values": [1]})], {}, [(4, "token_evidence_redaction_mismatch")]),
    (FINE, {"max_identity_bytes_per_trace": 7}, [(3, "trace_resource_limit")]),
    ([*FINE, schedule(drop("z"))], {}, [(4, "fault_envelope_not_prior")]),
    ([*FINE, schedule(drop("a", 1))], {}, [(4, "fault_occurrence_not_created")]),
    ([*FINE, schedule(drop("a"), drop("a"))], {}, [(4, "fault_occurrence_removed")]),
    ([*FINE, schedule(dup("a", 1000), drop("a", 1000), drop("a", 1001))], {}, [(4, "fault_occurrence_not_created")]),
    ([*FINE, schedule(*[dup("a", 1024)] * 64)], {}, [(4, "fault_occurrence_overflow")]),
    ([*FINE, schedule(dup("a", 3))], {"max_occurrences_per_schedule": 4}, [(4, "trace_resource_limit")]),
    ([*FINE, schedule(dup("a", 3))], {"max_schedule_work_per_trace": 4}, [(4, "trace_resource_limit")]),
    ([*FINE, schedule(), schedule()], {}, [(5, "duplicate_schedule_id")]),
    ([*FINE, schedule()], {"max_fault_schedules_per_trace": 0}, [(4, "trace_resource_limit")]),
    ([*FINE, schedule(drop("a"), drop("b"))], {"max_fault_actions_per_trace": 1}, [(4, "trace_resource_limit")]),
    (FINE, {"max_fingerprint_bytes_per_trace": 200}, [(3, "state_resource_limit")]),
    ([*FINE, {"kind": "x"}, env("a", 9)], {}, [(4, "schema")]),
    ([HEADER, env("a", 0), HEADER], {}, [(1, "undeclared_stream")]),
]


def found_in(spark, cases, limits):
    """First failures of many traces at once, by trace."""
    parts = [records(spark, *rows, limits=limits).withColumn("trace", F.lit(name)) for name, rows in cases.items()]
    r = reduce(lambda a, b: a.unionByName(b), parts)
    r = settled(r, "records")
    rows = validate.first_failures(validate.violations(r, normalize.streams(r), normalize.envelopes(r), normalize.schedules(r), limits)).collect()
    return {name: [(x.record_no, x.code) for x in rows if x.trace == name] for name in cases}


def test_first_failures(spark):
    plain = {f"t{i}": c for i, c in enumerate(CASES) if not c[1]}
    assert found_in(spark, {n: c[0] for n, c in plain.items()}, L) == {n: c[2] for n, c in plain.items()}


@pytest.mark.parametrize("rows, limits, expected", [c for c in CASES if c[1]])
def test_first_failures_at_limits(spark, rows, limits, expected):
    assert found_in(spark, {"t": rows}, L.but(**limits)) == {"t": expected}


def test_authority(spark):
    unknown = STREAM | {"baseline": {"kind": "unknown_at_attach"}}
    assert failure(spark, *FINE, decisions=decided(spark, s2=TRUST)) == [(0, "unexpected_baseline_authority")]
    assert failure(spark, *FINE, other(), decisions=decided(spark, s=TRUST)) == [(4, "baseline_authority_required")]
    assert failure(spark, HEADER, unknown, decisions=decided(spark)) == [(1, "baseline_authority_mismatch")]
    assert failure(spark, HEADER, unknown, decisions=decided(spark, s=UNKNOWN)) == []


def test_summary_and_missing_header(spark):
    r = records(spark, *FINE, schedule(drop("a"), dup("b", 2)))
    got = validate.summaries(r, normalize.schedules(r)).first()
    assert (got.records, got.streams, got.envelopes, got.fault_schedules, got.fault_actions, got.schedule_work, got.identity_bytes, got.redaction) == (5, 1, 2, 1, 2, 4, 9, "omitted")
    empty = spark.createDataFrame([("u",), ("t",)], "trace string")
    assert [(x.trace, x.code) for x in validate.missing_headers(empty, r).collect()] == [("u", "missing_header")]


def test_delivered_fold(spark):
    trace, found = assemble(records(spark, HEADER, STREAM, env("e0", 0, "101"), env("e2", 2, "103"), env("e1", 1, "102")), decided(spark))
    assert found.count() == 0
    summaries, told = fold_delivered(trace)
    assert [x.disposition for x in told.orderBy("delivery_pos").collect()] == ["applied", "buffered", "applied"]
    s = summaries.first()
    assert (s.certainty, s.frontier, s.key_count, s.authoritative) == ("exact", 2, 3, True)


def test_materialized_faults_and_convergence(spark):
    rows = [HEADER, STREAM, env("e0", 0), env("e1", 1, "8"), env("e2", 2, "9"), schedule(dup("e1", 1), move("e2", "e0"))]
    trace, _ = assemble(records(spark, *rows), decided(spark))
    got = deliveries(trace).where("mode = 'faulted'").orderBy("delivery_pos").collect()
    assert [(x.envelope_id, x.occurrence) for x in got] == [("e2", 0), ("e0", 0), ("e1", 0), ("e1", 1)]
    told = fold.dispositions(fold.visible_streams(trace.schedules, trace.streams, ("faulted",)), deliveries(trace)).orderBy("delivery_pos").collect()
    assert [x.disposition for x in told] == ["buffered", "applied", "applied", "duplicate"]
    for exact in (False, True):
        v = comparison(trace, force_exact=exact).first()
        assert (v.verdict, v.ineligibility) == ("converged", 0)


def test_prefix_empty_streams_and_verdicts(spark):
    rows = [HEADER, STREAM, env("a", 0), env("b", 1), schedule(drop("a")) | {"schedule_id": "f0"}, other(), env("c", 0, stream="s2"), schedule(drop("b"), drop("c")) | {"schedule_id": "f1"}]
    trace, _ = assemble(records(spark, *rows), decided(spark, s=TRUST, s2=UNKNOWN))
    got = {(v.schedule_idx, v.stream_idx): (v.verdict, v.ineligibility) for v in comparison(trace).collect()}
    assert got == {(0, 0): ("ineligible", 6), (1, 0): ("ineligible", 4), (1, 1): ("ineligible", 7)}
    assert {(x.schedule_idx, x.stream_prefix, x.source_prefix, x.pristine_deliveries, x.faulted_deliveries) for x in compare.sizes(trace.schedules, deliveries(trace)).collect()} == {(0, 1, 2, 2, 1), (1, 2, 3, 3, 1)}


def test_divergence_and_hard_errors(spark):
    rows = [HEADER, STREAM, env("a", 0), env("twin", 0, "99"), schedule(drop("a"))]
    trace, _ = assemble(records(spark, *rows), decided(spark))
    blind = L.but(max_recent_fingerprints_per_stream=0)
    assert comparison(trace, blind).first().verdict == "diverged"
    assert comparison(trace).first().verdict == "ineligible"
    sides = both_sides(trace, L.but(max_cache_keys_per_stream=0))
    assert comparison(trace, L.but(max_cache_keys_per_stream=0)).count() == 0
    assert [(e.mode, e.error_code) for e in compare.errors(sides).collect()] == [("pristine", "state_resource_limit")]


def test_nothing_to_compare(spark):
    trace, _ = assemble(records(spark, HEADER, schedule()), decided(spark).where("false"))
    assert comparison(trace).count() == 0


def test_a_broken_trace_yields_no_summaries(spark):
    trace, found = assemble(records(spark, *FINE, env("a", 5)), decided(spark))
    assert found.count() == 1 and trace.streams.count() == 0 and trace.envelopes.count() == 0


def test_contract(spark, capsys):
    assert main(["contract", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out) == json.loads(as_json())
    assert main(["contract"]) == 0 and "[edges]" in capsys.readouterr().out
    assert as_table(spark).count() == 13


def test_groups_are_walked_through_in_order(spark):
    """Rows in any order and partition; a key without rows, rows without a key's head, a null key, a second head."""
    heads = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("d", 4), ("d", 4)], "k string, x int")
    rows = spark.createDataFrame([("a", n * 7 % 5000, str(n * 7 % 5000)) for n in range(5000)] + [(None, 1, "n"), ("c", 1, "lost"), ("d", 2, "v"), ("d", 1, "u")], "k string, at long, v string").repartition(5)

    def step(key, head, own):
        own = list(own)
        yield key[0], head[0], [v for _, v in own]

    out = ordered.in_groups(heads, rows, ["k"], "at", step, "k string, x int, v array<string>")
    assert {r.k: (r.x, r.v) for r in out.collect()} == {"a": (1, [str(n) for n in range(5000)]), "b": (2, []), None: (3, ["n"]), "d": (4, ["u", "v"])}


def test_exact_paths_do_not_call_python_for_each_group(spark):
    """A call for each stream and schedule took most of the time of whole tables."""
    trace, _ = assemble(records(spark, HEADER, STREAM, env("a", 0), env("b", 1), schedule(move("b", "a"))), decided(spark))
    shown = lambda df: df._jdf.queryExecution().toString()
    assert "Pandas" not in shown(both_sides(trace, force_exact=True)) + shown(faults.materialize(trace.schedules, faults.plans(trace.schedules, trace.envelopes)))


def test_round_trip_joins_nothing(spark):
    """The encoder's lines come along with what they are compared with; a join broadcast them, in the driver."""
    out = queries.canonical_jsonl_roundtrip(spark, "/root/testdata/sf0.001")
    assert "Join" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert rows and all(r.same for r in rows) and {r.kind for r in rows} == {"trace_header", "stream", "envelope"}
