"""Queries over the events table that exercise the trace engine, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bad_lines import CASES
from .bad_lines import LIMITS as BAD_LINES
from .contract import as_table, statements
from .functions.keys import reason_names
from .limits import Limits
from .operators import compare, faults, fold, normalize, relational, validate
from .plans.analysis import Trace, assemble, both_sides, comparison, deliveries, fold_delivered, order
from .schema import ACTION, ERROR
from .scratch import place, settled
from .sources import bridge, jsonl
from .streaming.fold_stream import fold_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BASE = """
WITH RECURSIVE base AS (
  SELECT event_id, user_id, ts, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         't' || CAST(user_id // 8 AS VARCHAR) AS trace, 'u' || CAST(user_id AS VARCHAR) AS stream_id FROM events
), st AS (
  SELECT trace, stream_id, user_id, row_number() OVER (PARTITION BY trace ORDER BY user_id) - 1 AS stream_idx,
         user_id % 10 NOT IN (8, 9) AS trusted
  FROM (SELECT DISTINCT trace, stream_id, user_id FROM base)
), env AS (
  SELECT b.*, 'e' || CAST(event_id AS VARCHAR) AS envelope_id, s.stream_idx, s.trusted,
         row_number() OVER (PARTITION BY b.user_id ORDER BY ts, event_id) - 1 AS cursor,
         row_number() OVER (PARTITION BY b.trace ORDER BY event_id) - 1 AS source_idx
  FROM base b JOIN st s USING (trace, stream_id)
), canon AS (
  SELECT *, CASE
    WHEN event_type = 'error' THEN '[]' WHEN event_type = 'signup' AND k % 4 = 0 THEN '[{"metadata":{},"op":"clear"}]'
    ELSE '[{"group":' || CASE WHEN event_type = 'signup' THEN '{"kind":"index","value":0}' ELSE '{"kind":"unspecified"}' END || ',"hashes":[{"encoding":"u64","value":"' || k || '"}'
      || CASE WHEN event_type = 'click' THEN ',{"encoding":"u64","value":"' || (k + 1) || '"}' ELSE '' END || '],"medium":'
      || CASE WHEN event_type = 'signup' THEN '{"kind":"named","value":"GPU"}' ELSE '{"kind":"unspecified"}' END || ',"metadata":{},"op":"'
      || CASE WHEN event_type = 'purchase' THEN 'remove' ELSE 'store_run' END || '"}]' END AS mutations FROM env
), ops AS (
  SELECT trace, stream_idx, trusted, cursor, source_idx, 0 AS mut_idx, 0 AS hash_idx,
         CASE WHEN event_type = 'purchase' THEN 'remove' WHEN event_type = 'signup' AND k % 4 = 0 THEN 'clear' ELSE 'store_run' END AS op,
         CASE WHEN event_type = 'signup' AND k % 4 = 0 THEN NULL
              ELSE 'u:' || CAST(k AS VARCHAR) || CASE WHEN event_type = 'signup' THEN '|g0|mGPU' ELSE '|-|-' END END AS key,
         CASE WHEN event_type = 'signup' AND k % 4 = 0 THEN NULL WHEN event_type = 'signup' THEN 15 ELSE 8 END AS key_bytes
  FROM env WHERE event_type <> 'error'
  UNION ALL
  SELECT trace, stream_idx, trusted, cursor, source_idx, 0, 1, 'store_run', 'u:' || CAST(k + 1 AS VARCHAR) || '|-|-', 8 FROM env WHERE event_type = 'click'
), clears AS (
  SELECT trace, stream_idx, cursor FROM ops WHERE op = 'clear'
), sides AS (
  SELECT trace, stream_idx, trusted, cursor, source_idx, event_id, 'pristine' AS mode FROM env
  UNION ALL
  SELECT trace, stream_idx, trusted, cursor, source_idx, event_id, 'faulted' FROM env WHERE event_id % 17 <> 3 OR event_id % 13 = 5
), firsts AS (
  SELECT mode, trace, stream_idx, arg_min(cursor, source_idx) AS c0 FROM sides GROUP BY ALL
), anchors AS (
  SELECT m.mode, s.trace, s.stream_idx, s.trusted, max(c.cursor) AS clear_at,
         coalesce(max(c.cursor), CASE WHEN s.trusted THEN 0 END, any_value(f.c0)) AS anchor
  FROM st s CROSS JOIN (SELECT unnest(['pristine', 'faulted']) AS mode) m
  LEFT JOIN firsts f ON f.mode = m.mode AND f.trace = s.trace AND f.stream_idx = s.stream_idx
  LEFT JOIN (SELECT d.mode, c.* FROM clears c JOIN sides d USING (trace, stream_idx, cursor)) c
    ON c.mode = m.mode AND c.trace = s.trace AND c.stream_idx = s.stream_idx AND (s.trusted OR c.cursor >= f.c0)
  GROUP BY 1, 2, 3, 4
), islands AS (
  SELECT d.mode, d.trace, d.stream_idx, d.cursor, a.anchor, d.cursor - row_number() OVER (PARTITION BY d.mode, d.trace, d.stream_idx ORDER BY d.cursor) + 1 AS run
  FROM sides d JOIN anchors a USING (mode, trace, stream_idx) WHERE d.cursor >= a.anchor
), fronts AS (
  SELECT a.mode, a.trace, a.stream_idx, a.trusted, a.clear_at, a.anchor, i.frontier,
         (SELECT count(*) FROM sides d WHERE d.mode = a.mode AND d.trace = a.trace AND d.stream_idx = a.stream_idx AND (i.frontier IS NULL OR d.cursor > i.frontier)) AS pending
  FROM anchors a LEFT JOIN (SELECT mode, trace, stream_idx, max(cursor) AS frontier FROM islands WHERE run = anchor GROUP BY ALL) i USING (mode, trace, stream_idx)
), judged AS (
  SELECT *, trusted OR clear_at IS NOT NULL AS authoritative,
         CASE WHEN trusted OR clear_at IS NOT NULL THEN 0 ELSE 1 END + CASE WHEN pending > 0 THEN 8 ELSE 0 END AS reasons
  FROM fronts
), span AS (
  SELECT f.mode, o.*, (o.cursor * 2 + o.hash_idx) AS place FROM ops o JOIN judged f USING (trace, stream_idx) WHERE o.cursor BETWEEN f.anchor AND f.frontier
), held AS (
  SELECT mode, trace, stream_idx, key, arg_max(op, place) AS op, arg_max(key_bytes, place) AS key_bytes
  FROM span s WHERE op <> 'clear' AND place > coalesce((SELECT max(place) FROM span w WHERE w.op = 'clear' AND w.mode = s.mode AND w.trace = s.trace AND w.stream_idx = s.stream_idx), -1)
  GROUP BY ALL HAVING arg_max(op, place) = 'store_run'
), lines AS (
  SELECT DISTINCT trace, 0 AS record_no, 'trace_header' AS kind, '{"created_by":"bridge","extensions":{},"format":"cairnfold.trace/v1","kind":"trace_header","redaction":"omitted","trace_id":"' || trace || '"}' AS line FROM st
  UNION ALL
  SELECT trace, stream_idx + 1, 'stream', '{"baseline":{"kind":"' || CASE WHEN user_id % 10 = 9 THEN 'unknown_at_attach' ELSE 'empty_at_engine_start' END || '"},"data_parallel_rank":0,"engine":"bridge","engine_instance":"' || trace
    || '","engine_version":"1","epoch":"0","extensions":{},"initial_cursor":"0","kind":"stream","publisher":"' || stream_id || '","stream_id":"' || stream_id || '"}' FROM st
  UNION ALL
  SELECT trace, source_idx + 1 + n, 'envelope', '{"cursor":"' || cursor || '","envelope_id":"' || envelope_id || '","extensions":{},"kind":"envelope","mutations":' || mutations || ',"origin":"live","stream_id":"' || stream_id || '"}'
  FROM canon JOIN (SELECT trace, count(*) AS n FROM st GROUP BY trace) USING (trace)
), del AS (
  SELECT trace, stream_idx, source_idx, 0 AS occurrence, cursor, trusted FROM env WHERE event_id % 17 <> 3
  UNION ALL SELECT trace, stream_idx, source_idx, 1, cursor, trusted FROM env WHERE event_id % 13 = 5
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY trace ORDER BY source_idx, occurrence) - 1 AS delivery_pos, row_number() OVER (PARTITION BY trace, stream_idx, cursor ORDER BY source_idx, occurrence) AS nth,
         CASE WHEN trusted THEN 0 ELSE first_value(cursor) OVER (PARTITION BY trace, stream_idx ORDER BY source_idx, occurrence) END AS start FROM del
), ups AS (
  SELECT *, row_number() OVER w AS up, max(source_idx) OVER w AS latest FROM placed WHERE nth = 1 AND cursor >= start WINDOW w AS (PARTITION BY trace, stream_idx ORDER BY cursor)
), disp AS (
  SELECT n.trace, n.stream_idx, n.source_idx, n.occurrence, n.delivery_pos, n.cursor,
         CASE WHEN n.cursor < n.start THEN 'stale_unverifiable' WHEN n.nth > 1 THEN 'duplicate' WHEN f.up = n.cursor - n.start + 1 AND f.latest = n.source_idx THEN 'applied' ELSE 'buffered' END AS disposition
  FROM placed n LEFT JOIN ups f USING (trace, stream_idx, cursor)
), eras AS (
  SELECT *, lag(op) OVER (PARTITION BY trace, stream_idx, key, era ORDER BY cursor, hash_idx) AS before FROM (
    SELECT *, sum(CASE WHEN op = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY trace, stream_idx ORDER BY cursor, hash_idx) AS era FROM ops)
), verdicts AS (
  SELECT p.trace, p.stream_idx, p.reasons > 0 AS pristine_inexact, f.reasons > 0 AS faulted_inexact, p.frontier IS DISTINCT FROM f.frontier AS frontier_mismatch
  FROM judged p JOIN judged f ON p.mode = 'pristine' AND f.mode = 'faulted' AND p.trace = f.trace AND p.stream_idx = f.stream_idx
)
"""


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _BASE + sql if "{plain}" not in sql else sql.replace("{plain}", "")
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


#: What names and places need of an envelope, and what the fold reads besides.
_NAMES = ("trace", "record_no", "source_idx", "envelope_id", "stream_id", "stream_idx", "cursor", "event_id")
_PAYLOAD = ("initial_cursor", "trusted", "fingerprint", "canonical_bytes", "first_clear", "ops")


def _trace(spark: SparkSession, sf_dir: str, clears: bool = True, shadow: bool = False, payload: bool = True, **faults_) -> Trace:
    """The written tables of the bridge's traces, without mutations, and without payloads where only places count.

    Duplicates of dropped events survive: a copy is made of the original before it goes.
    """
    events = _events(spark, sf_dir)
    envelopes = settled(bridge.envelopes(events, clears, shadow).select(*_NAMES, *(_PAYLOAD if payload else ())), "envelopes")
    return Trace(settled(bridge.streams(events), "streams"), envelopes, settled(bridge.schedules(envelopes, **faults_), "schedules"))


def _visible(trace: Trace, *modes: str) -> DataFrame:
    return fold.visible_streams(trace.schedules, trace.streams, modes or (faults.PRISTINE, faults.FAULTED))


def _cursors(trace: Trace) -> tuple[DataFrame, DataFrame]:
    return _visible(trace), relational.distinct_cursors(deliveries(trace))


def _fronts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides' cursors, written once, and their frontiers."""
    visible, cursors = _cursors(_trace(spark, sf_dir))
    cursors = settled(cursors, "cursors")
    return cursors, settled(relational.frontiers(cursors, relational.anchors(visible, cursors)), "fronts")


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- scans of what a trace holds


@_query("SELECT trace, stream_idx, stream_id, CASE WHEN user_id % 10 = 9 THEN 'unknown_at_attach' ELSE 'empty_at_engine_start' END AS baseline, trusted FROM st")
def stream_scopes(spark, sf_dir):
    s = bridge.streams(_events(spark, sf_dir))
    decisions = s.select("trace", "stream_id", "authority")
    told = normalize.with_authority(s.drop("authority", "trusted"), decisions)
    return told.select("trace", *_long("stream_idx"), "stream_id", "baseline", "trusted")


@_query("SELECT trace, source_idx, envelope_id, stream_idx, cursor FROM env")
def cursor_ordinals(spark, sf_dir):
    return bridge.envelopes(_events(spark, sf_dir)).select("trace", *_long("source_idx"), "envelope_id", *_long("stream_idx", "cursor"))


@_query("SELECT trace, stream_idx, cursor, mut_idx, hash_idx, op, key, key_bytes FROM ops")
def mutation_ops_exploded(spark, sf_dir):
    e = bridge.envelopes(_events(spark, sf_dir)).withColumn("schedule_idx", F.lit(0)).withColumn("mode", F.lit(faults.PRISTINE))
    return relational.operations(e).select("trace", *_long("stream_idx", "cursor", "mut_idx", "hash_idx"), "op", "key", *_long("key_bytes"))


@_query("SELECT envelope_id, sha256(mutations) AS fingerprint, strlen(mutations) AS canonical_bytes FROM canon")
def fingerprint_sha256(spark, sf_dir):
    return bridge.envelopes(_events(spark, sf_dir)).select("envelope_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "canonical_bytes")


@_query("SELECT envelope_id FROM env WHERE event_type = 'signup' AND k % 4 = 0")
def envelopes_with_clear(spark, sf_dir):
    return bridge.envelopes(_events(spark, sf_dir)).where("first_clear is not null").select("envelope_id")


@_query("""SELECT trace, 2 + count(DISTINCT stream_id) + count(*) AS records, count(DISTINCT stream_id) AS streams, count(*) AS envelopes, 1 AS fault_schedules,
  sum(CASE WHEN event_id % 17 = 3 THEN 1 ELSE 0 END + CASE WHEN event_id % 13 = 5 THEN 1 ELSE 0 END) AS fault_actions,
  count(*) + sum(CASE WHEN event_id % 13 = 5 THEN 1 ELSE 0 END) AS schedule_work FROM env GROUP BY trace""")
def trace_summary(spark, sf_dir):
    t = _trace(spark, sf_dir, payload=False)
    work = validate.schedule_work(t.schedules).select("trace", *_long("work"), F.size("actions").cast("long").alias("fault_actions"))
    s, e = (x.groupBy("trace").agg(F.count("*").alias(n)) for x, n in ((t.streams, "streams"), (t.envelopes, "envelopes")))
    return s.join(e, "trace").join(work, "trace").select("trace", (F.col("streams") + F.col("envelopes") + 2).alias("records"), "streams", "envelopes", F.lit(1).cast("long").alias("fault_schedules"), "fault_actions", F.col("work").alias("schedule_work"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge's records, through JSON text and the decoder."""
    events, limits = _events(spark, sf_dir), Limits()
    return settled(_decoded(bridge.json_lines(bridge.streams(events), bridge.envelopes(events), limits.trace_format), limits), "records")


@_query("SELECT trace, 'other' AS route, 1 AS records FROM env GROUP BY trace UNION ALL SELECT trace, 'stream', count(*) FROM st GROUP BY trace UNION ALL SELECT trace, 'envelope', count(*) FROM env GROUP BY trace")
def record_routes(spark, sf_dir):
    return normalize.routes(_records(spark, sf_dir)).groupBy("trace", "route").agg(F.count("*").alias("records"))


@_query("""SELECT e.trace, 1 + s.n + e.n AS records, s.n AS streams, e.n AS envelopes, s.bytes + e.bytes AS identity_bytes, 'omitted' AS redaction
  FROM (SELECT trace, count(*) AS n, sum(strlen(envelope_id)) AS bytes FROM env GROUP BY trace) e
  JOIN (SELECT trace, count(*) AS n, sum(2 * strlen(stream_id) + strlen(trace) + 8) AS bytes FROM st GROUP BY trace) s USING (trace)""")
def identity_budget(spark, sf_dir):
    r = _records(spark, sf_dir)
    return validate.summaries(r, normalize.schedules(r)).select("trace", "records", "streams", "envelopes", "identity_bytes", "redaction")


@_query("SELECT e.trace, 1 + s.n + e.n AS lines, 0 AS failures FROM (SELECT trace, count(*) AS n FROM env GROUP BY trace) e JOIN (SELECT trace, count(*) AS n FROM st GROUP BY trace) s USING (trace)")
def jsonl_sink_and_scan(spark, sf_dir):
    """Canonical lines written, a folder per trace, and scanned again under the default ceilings."""
    path = place(spark, "lines")
    jsonl.write_canonical(_records(spark, sf_dir), path)
    return jsonl.read_lines(spark, path).groupBy("trace").agg(F.sum(F.col("error").isNull().cast("long")).alias("lines"), F.sum(F.col("error").isNotNull().cast("long")).alias("failures"))


# ---- trace-wide rules


@_query("SELECT trace, envelope_id FROM env WHERE user_id % 5 = 0")
def undeclared_streams(spark, sf_dir):
    events = _events(spark, sf_dir)
    return validate.undeclared(bridge.envelopes(events), bridge.streams(events).where("user_id % 5 <> 0")).select("trace", "envelope_id")


@_query("SELECT trace, envelope_id, count(*) AS times FROM (SELECT trace, envelope_id FROM env WHERE event_id % 97 = 0) GROUP BY ALL")
def duplicate_envelope_ids(spark, sf_dir):
    e = bridge.envelopes(_events(spark, sf_dir)).select("trace", "record_no", "envelope_id", "event_id")
    twice = e.unionByName(e.where("event_id % 97 = 0").withColumn("record_no", F.col("record_no") + 1_000_000))
    return validate.repeated(twice, "envelope_id").groupBy("trace", "envelope_id").agg(F.count("*").alias("times"))


@_query("""SELECT trace, envelope_id FROM (SELECT trace, envelope_id, event_id % 4 AS e, (user_id // 8) % 4 AS r FROM env WHERE event_type IN ('view', 'click') OR event_type = 'signup' AND k % 4 <> 0)
  WHERE e > 0 AND e <> r""")
def redaction_matrix(spark, sf_dir):
    """Evidence by event_id % 4 (none, keyed, unkeyed, token ids) against the trace's redaction by number % 4."""
    events = _events(spark, sf_dir)
    kind = F.when(F.col("event_id") % 4 == 1, "keyed_digest").when(F.col("event_id") % 4 == 2, "unkeyed_digest").when(F.col("event_id") % 4 == 3, "token_ids")
    null = F.lit(None)
    evidence = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), null.cast("string").alias("algorithm"), null.cast("string").alias("key_id"), null.cast("string").alias("value"), null.cast("array<bigint>").alias("token_values")))
    e = bridge.envelopes(events).where("get(mutations, 0).op = 'store_run'")
    e = e.withColumn("mutations", F.transform("mutations", lambda m: m.withField("token_evidence", evidence)))
    number = F.substring("trace", 2, 20).cast("bigint") % 4
    redaction = F.element_at(F.array(*map(F.lit, ("omitted", "keyed_digests", "unkeyed_linkable", "contains_token_ids"))), (number + 1).cast("int"))
    headers = bridge.streams(events).select("trace").distinct().withColumn("redaction", redaction)
    return validate.redaction_breaches(e, headers).join(e, ["trace", "record_no"]).select("trace", "envelope_id")


@_query("""SELECT trace, min(record_no) AS record_no, 'undeclared_stream' AS code FROM (
  SELECT trace, user_id, source_idx + 1 + (SELECT count(*) FROM st s WHERE s.trace = env.trace AND s.user_id % 5 <> 0) AS record_no FROM env)
  WHERE user_id % 5 = 0 GROUP BY trace""")
def first_failure(spark, sf_dir):
    """Traces written as JSON lines without some declarations: read, decoded, checked."""
    events, limits = _events(spark, sf_dir), Limits()
    lines = bridge.json_lines(bridge.streams(events).where("user_id % 5 <> 0"), bridge.envelopes(events), limits.trace_format)
    records = settled(_decoded(lines, limits), "records")
    return _failures(records).select("trace", "record_no", "code")


def _decoded(lines: DataFrame, limits: Limits) -> DataFrame:
    """Records from (trace, record_no, value), renumbered without holes."""
    at = (F.row_number().over(Window.partitionBy("trace").orderBy("record_no")) - 1).cast("bigint")
    null = F.lit(None)
    raw = lines.select("trace", at.alias("record_no"), "value").select("trace", "record_no", (F.col("record_no") + 1).alias("line_no"), F.col("value").cast("binary").alias("payload"), null.cast("bigint").alias("start_byte"), null.cast("bigint").alias("end_byte"), null.cast("struct<layer:string,code:string,field:string,limit_value:decimal(20,0),actual_value:decimal(20,0)>").alias("error"))
    return jsonl.decode(raw, limits)


@_query("SELECT trace, source_idx, 1 AS first_occurrence, 1 AS copies FROM env WHERE event_id % 13 = 5")
def occurrence_allocation(spark, sf_dir):
    t = _trace(spark, sf_dir, payload=False)
    return faults.plans(t.schedules, t.envelopes).where("action = 'duplicate'").select("trace", *_long("source_idx", "first_occurrence", "copies"))


@_query("SELECT trace, source_idx, 1 AS occurrence FROM env WHERE event_id % 13 = 5")
def created_occurrences(spark, sf_dir):
    t = _trace(spark, sf_dir, payload=False)
    return faults.created(faults.plans(t.schedules, t.envelopes)).select("trace", *_long("source_idx", "occurrence"))


# ---- fault schedules


@_query("SELECT trace, 0 AS schedule_idx, count(DISTINCT stream_id) AS stream_prefix, count(*) AS source_prefix, count(*) AS pristine_deliveries, count(*) + sum(CASE WHEN event_id % 13 = 5 THEN 1 ELSE 0 END) - sum(CASE WHEN event_id % 17 = 3 THEN 1 ELSE 0 END) AS faulted_deliveries FROM env GROUP BY trace")
def schedule_prefix_counts(spark, sf_dir):
    t = _trace(spark, sf_dir, payload=False)
    return compare.sizes(t.schedules, order(t)).select("trace", *_long("schedule_idx", "stream_prefix", "source_prefix", "pristine_deliveries", "faulted_deliveries"))


@_query("""SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY source_idx, occurrence) - 1 AS delivery_pos, source_idx, occurrence FROM (
  SELECT trace, source_idx, 0 AS occurrence FROM env WHERE event_id % 17 <> 3 UNION ALL SELECT trace, source_idx, 1 FROM env WHERE event_id % 13 = 5)""")
def materialize_drop_dup(spark, sf_dir):
    t = _trace(spark, sf_dir, payload=False)
    return faults.materialize_relational(t.schedules, faults.plans(t.schedules, t.envelopes)).select("trace", "delivery_pos", "source_idx", *_long("occurrence"))


SQL["materialize_exact"] = SQL["materialize_drop_dup"]


@_query()
def materialize_exact(spark, sf_dir):
    """The same schedules edited one by one."""
    t = _trace(spark, sf_dir, payload=False)
    return faults.materialize(t.schedules, faults.plans(t.schedules, t.envelopes)).select("trace", "delivery_pos", "source_idx", *_long("occurrence"))


@_query(""", r AS (
  SELECT *, event_id % 11 = 7 AND lag(source_idx) OVER (PARTITION BY trace, stream_idx ORDER BY source_idx) IS NOT NULL AS moved FROM env
), q AS (
  SELECT *, max(CASE WHEN NOT moved THEN source_idx END) OVER (PARTITION BY trace, stream_idx ORDER BY source_idx) AS root FROM r
), d AS (
  SELECT trace, source_idx, root, 0 AS occurrence FROM q WHERE event_id % 17 <> 3 UNION ALL SELECT trace, source_idx, root, 1 FROM q WHERE event_id % 13 = 5
)
SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY root, source_idx DESC, occurrence) - 1 AS delivery_pos, source_idx, occurrence FROM d""")
def materialize_moves(spark, sf_dir):
    t = _trace(spark, sf_dir, payload=False, swap=(11, 7))
    return faults.materialize(t.schedules, faults.plans(t.schedules, t.envelopes)).select("trace", "delivery_pos", "source_idx", *_long("occurrence"))


@_query("SELECT trace, stream_idx, cursor, 2 AS deliveries FROM env WHERE event_id % 13 = 5 AND event_id % 17 <> 3")
def duplicate_deliveries(spark, sf_dir):
    _, cursors = _cursors(_trace(spark, sf_dir))
    return cursors.where("mode = 'faulted' and deliveries > 1").select("trace", *_long("stream_idx", "cursor"), "deliveries")


@_query("SELECT trace, stream_idx, cursor, 2 AS prints FROM env WHERE event_id % 23 = 9")
def equivocating_cursors(spark, sf_dir):
    t = _trace(spark, sf_dir, shadow=True)
    return relational.conflicts(deliveries(t, faulted=False)).select("trace", *_long("stream_idx", "cursor"), "prints")


# ---- the fold's closed form


@_query("SELECT mode, trace, stream_idx, anchor FROM anchors")
def anchor_by_last_clear(spark, sf_dir):
    visible, cursors = _cursors(_trace(spark, sf_dir))
    return relational.anchors(visible, settled(cursors, "cursors")).select("mode", "trace", *_long("stream_idx", "anchor"))


@_query("SELECT mode, trace, stream_idx, run, min(cursor) AS from_cursor, max(cursor) AS to_cursor FROM islands GROUP BY ALL")
def gap_islands(spark, sf_dir):
    cursors, fronts = _fronts(spark, sf_dir)
    runs = relational.islands(cursors, fronts).groupBy("mode", "trace", "stream_idx", "run").agg(F.min("cursor").alias("from_cursor"), F.max("cursor").alias("to_cursor"))
    return runs.select("mode", "trace", *_long("stream_idx", "run", "from_cursor", "to_cursor"))


@_query("SELECT mode, trace, stream_idx, frontier FROM judged")
def dense_frontier(spark, sf_dir):
    return _fronts(spark, sf_dir)[1].select("mode", "trace", *_long("stream_idx", "frontier"))


@_query("SELECT trace, stream_idx, pending FROM judged WHERE mode = 'faulted'")
def pending_after_drop(spark, sf_dir):
    return _fronts(spark, sf_dir)[1].where("mode = 'faulted'").select("trace", *_long("stream_idx", "pending"))


@_query("SELECT mode, trace, stream_idx, CASE WHEN reasons = 0 THEN 'exact' ELSE 'unknown' END AS certainty, authoritative, reasons FROM judged")
def certainty_by_stream(spark, sf_dir):
    return _fronts(spark, sf_dir)[1].select("mode", "trace", *_long("stream_idx"), "certainty", "authoritative", *_long("reasons"))


@_query("SELECT mode, trace, stream_idx, key FROM held")
def cache_view_final(spark, sf_dir):
    return relational.views(*_fronts(spark, sf_dir)).select("mode", "trace", *_long("stream_idx"), "key")


@_query("SELECT mode, trace, stream_idx, count(*) AS key_count, sum(key_bytes) AS identity_bytes FROM held GROUP BY ALL")
def cache_key_counts(spark, sf_dir):
    keys = relational.views(*_fronts(spark, sf_dir))
    return keys.groupBy("mode", "trace", "stream_idx").agg(F.count("*").alias("key_count"), F.sum("key_bytes").cast("long").alias("identity_bytes")).select("mode", "trace", *_long("stream_idx"), "key_count", "identity_bytes")


@_query("""SELECT trace, stream_idx, count(*) AS missing_removes FROM (
  SELECT *, lag(op) OVER (PARTITION BY trace, stream_idx, key, era ORDER BY cursor, hash_idx) AS before FROM (
    SELECT *, sum(CASE WHEN op = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY trace, stream_idx ORDER BY cursor, hash_idx) AS era FROM ops) WHERE op <> 'clear')
  WHERE op = 'remove' AND (before IS NULL OR before = 'remove') GROUP BY ALL""")
def missing_removes(spark, sf_dir):
    cursors, fronts = _fronts(spark, sf_dir)
    whole = fronts.where("mode = 'pristine'").withColumn("frontier", F.coalesce("frontier", F.lit(0).cast("decimal(20,0)")))
    return relational.missing_removes(cursors, whole).select("trace", *_long("stream_idx"), "missing_removes")


@_query("""SELECT mode, trace, stream_idx, cursor FROM (SELECT d.*, row_number() OVER (PARTITION BY d.mode, d.trace, d.stream_idx ORDER BY d.cursor DESC) AS place
  FROM sides d JOIN judged f USING (mode, trace, stream_idx) WHERE d.cursor BETWEEN f.anchor AND f.frontier) WHERE place <= 8""")
def recent_window_topk(spark, sf_dir):
    return relational.recent(*_fronts(spark, sf_dir), window=8).select("mode", "trace", *_long("stream_idx", "cursor"))


@_query("SELECT trace, stream_idx, source_idx, occurrence, disposition FROM disp")
def dispositions_clear_free(spark, sf_dir):
    """What becomes of each delivery where no clear interferes, of trusted and other streams, by the closed form."""
    t = _trace(spark, sf_dir, clears=False)
    rows = settled(deliveries(t).where("mode = 'faulted'"), "deliveries")
    return relational.dispositions(rows, _visible(t, faults.FAULTED)).select("trace", *_long("stream_idx", "source_idx", "occurrence"), "disposition")


SQL["dispositions_exact"] = SQL["dispositions_clear_free"]


@_query()
def dispositions_exact(spark, sf_dir):
    """The same deliveries through the sequential fold."""
    t = _trace(spark, sf_dir, clears=False)
    rows = deliveries(t).where("mode = 'faulted'")
    return fold.dispositions(_visible(t, faults.FAULTED), rows).select("trace", *_long("stream_idx", "source_idx", "occurrence"), "disposition")


@_query(""", g AS (
  SELECT p.trace, p.stream_idx, any_value(p.start) + coalesce(max(u.up), 0) AS gap FROM placed p
  LEFT JOIN ups u ON u.trace = p.trace AND u.stream_idx = p.stream_idx AND u.up = u.cursor - u.start + 1 GROUP BY ALL
), late AS (
  SELECT p.trace, p.stream_idx, p.cursor, row_number() OVER (PARTITION BY p.trace, p.stream_idx ORDER BY p.cursor) AS r, p.cursor - g.gap AS span
  FROM placed p JOIN g USING (trace, stream_idx) WHERE p.nth = 1 AND p.cursor > g.gap
), lost AS (
  SELECT trace, stream_idx, min(cursor) AS lost_from FROM late WHERE r > 2 OR span > 8 GROUP BY ALL
)
SELECT p.trace, p.stream_idx, p.source_idx, p.occurrence, CASE
  WHEN p.cursor < g.gap THEN CASE WHEN p.nth > 1 THEN 'duplicate' ELSE 'applied' END
  WHEN lost_from IS NULL OR p.cursor < lost_from THEN CASE WHEN p.nth > 1 THEN 'duplicate' ELSE 'buffered' END
  WHEN p.cursor = lost_from AND p.nth = 1 THEN CASE WHEN l.span > 8 THEN 'gap_limit' ELSE 'pending_limit' END
  ELSE 'unverifiable_gap' END AS disposition
FROM placed p JOIN g USING (trace, stream_idx) LEFT JOIN lost USING (trace, stream_idx) LEFT JOIN late l USING (trace, stream_idx, cursor)""")
def dispositions_under_limits(spark, sf_dir):
    """Two payloads may wait, eight cursors ahead at most: what finds no room, and what comes after it."""
    t = _trace(spark, sf_dir, clears=False)
    limits = Limits(max_pending_envelopes_per_stream=2, max_gap_span_per_stream=8, max_recent_fingerprints_per_stream=4)
    rows = deliveries(t).where("mode = 'faulted'")
    return fold.dispositions(_visible(t, faults.FAULTED), rows, limits).select("trace", *_long("stream_idx", "source_idx", "occurrence"), "disposition")


@_query("""SELECT d.trace, d.stream_idx, sum(CASE WHEN disposition = 'duplicate' THEN 1 ELSE 0 END) AS duplicates, sum(CASE WHEN disposition = 'stale_unverifiable' THEN 1 ELSE 0 END) AS stale_unverifiable,
  any_value(f.pending) AS pending, CASE WHEN any_value(f.pending) > 0 THEN 1 ELSE 0 END AS unclosed_gaps, 0 AS equivocations, 0 AS pending_limits
  FROM disp d JOIN (SELECT trace, stream_idx, sum(CASE WHEN up <> cursor - start + 1 THEN 1 ELSE 0 END) AS pending FROM ups GROUP BY ALL) f USING (trace, stream_idx) GROUP BY ALL""")
def diagnostic_counts(spark, sf_dir):
    t = _trace(spark, sf_dir, clears=False)
    out = fold.summaries(_visible(t, faults.FAULTED), deliveries(t).where("mode = 'faulted'"))
    return out.select("trace", *_long("stream_idx"), "duplicates", "stale_unverifiable", "pending", "unclosed_gaps", "equivocations", "pending_limits")


@_query(""", held_now AS (
  SELECT trace, stream_idx, cursor, hash_idx, op, sum(CASE WHEN op = 'store_run' AND (before IS NULL OR before = 'remove') THEN 1 WHEN op = 'remove' AND before = 'store_run' THEN -1 ELSE 0 END)
    OVER (PARTITION BY trace, stream_idx, era ORDER BY cursor, hash_idx) AS n FROM eras
), over AS (
  SELECT trace, stream_idx, min(cursor) AS cursor FROM held_now WHERE n > 5 GROUP BY ALL
)
SELECT st.trace, st.stream_idx, CASE WHEN e.source_idx IS NOT NULL THEN 'state_resource_limit' END AS error_code, e.source_idx AS error_pos
FROM st LEFT JOIN over USING (trace, stream_idx) LEFT JOIN env e ON e.trace = st.trace AND e.stream_idx = st.stream_idx AND e.cursor = over.cursor""")
def hard_errors(spark, sf_dir):
    """Five keys a stream at most: the delivery that would hold a sixth ends it, and nothing of it is applied."""
    t = _trace(spark, sf_dir)
    out = fold.summaries(_visible(t, faults.PRISTINE), deliveries(t, faulted=False), Limits(max_cache_keys_per_stream=5))
    return out.select("trace", *_long("stream_idx"), "error_code", "error_pos")


# ---- comparison


@_query("""SELECT trace, stream_idx, CASE WHEN pristine_inexact OR faulted_inexact OR frontier_mismatch THEN 'ineligible' ELSE 'converged' END AS verdict,
  CAST(pristine_inexact AS INT) + 2 * CAST(faulted_inexact AS INT) + 4 * CAST(frontier_mismatch AS INT) AS ineligibility FROM verdicts""")
def convergence_verdicts(spark, sf_dir):
    return comparison(_trace(spark, sf_dir)).select("trace", *_long("stream_idx"), "verdict", *_long("ineligibility"))


SQL["convergence_exact"] = SQL["convergence_verdicts"]


@_query()
def convergence_exact(spark, sf_dir):
    """The same verdicts from the sequential fold alone."""
    return comparison(_trace(spark, sf_dir), force_exact=True).select("trace", *_long("stream_idx"), "verdict", *_long("ineligibility"))


@_query("SELECT mode, r.reason, count(*) AS streams FROM judged, (SELECT 1 AS bit, 'baseline' AS reason UNION ALL SELECT 8, 'unclosed_gap') r WHERE (reasons & r.bit) > 0 GROUP BY ALL")
def ineligibility_reasons(spark, sf_dir):
    fronts = _fronts(spark, sf_dir)[1]
    return fronts.select("mode", F.explode(reason_names(F.col("reasons"))).alias("reason")).groupBy("mode", "reason").agg(F.count("*").alias("streams"))


@_query("""SELECT trace, stream_idx, key, 'pristine' AS only_in FROM (SELECT trace, stream_idx, key FROM held WHERE mode = 'pristine' EXCEPT SELECT trace, stream_idx, key FROM held WHERE mode = 'faulted')
  UNION ALL SELECT trace, stream_idx, key, 'faulted' FROM (SELECT trace, stream_idx, key FROM held WHERE mode = 'faulted' EXCEPT SELECT trace, stream_idx, key FROM held WHERE mode = 'pristine')""")
def view_differences(spark, sf_dir):
    views = settled(relational.views(*_fronts(spark, sf_dir)), "views")
    return compare.key_differences(views).select("trace", *_long("stream_idx"), "key", "only_in")


@_query("{plain}SELECT 0 AS different")
def exact_equals_closed(spark, sf_dir):
    """Summaries of the sequential fold against the closed form, on schedules with drops, copies and moves."""
    t = _trace(spark, sf_dir, swap=(11, 7))
    closed, exact = both_sides(t), both_sides(t, force_exact=True)
    cols = [c for c in closed.columns if c not in ("error_code", "error_pos")]
    a, b = settled(closed.select(cols), "closed"), settled(exact.select(cols), "exact")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("different"))


@_query(""", o2 AS (
  SELECT 'pristine' AS mode, trace, stream_idx, cursor, hash_idx, op, key FROM ops
  UNION ALL SELECT 'faulted', o.trace, o.stream_idx, o.cursor, o.hash_idx, o.op, o.key FROM ops o JOIN env e USING (trace, stream_idx, cursor) WHERE e.event_id % 23 <> 9
  UNION ALL SELECT 'faulted', trace, stream_idx, cursor, 0, 'store_run', 'u:' || CAST(k + 1000000 AS VARCHAR) || '|-|-' FROM env WHERE event_id % 23 = 9
), wiped AS (
  SELECT mode, trace, stream_idx, max(cursor) AS clear_at FROM o2 WHERE op = 'clear' GROUP BY ALL
), v AS (
  SELECT o.mode, o.trace, o.stream_idx, o.key FROM o2 o LEFT JOIN wiped USING (mode, trace, stream_idx)
  WHERE o.op <> 'clear' AND (clear_at IS NULL OR o.cursor > clear_at) GROUP BY ALL HAVING arg_max(o.op, o.cursor * 2 + o.hash_idx) = 'store_run'
), k2 AS (
  SELECT mode, trace, stream_idx, string_agg(key, ' ' ORDER BY key) AS keys FROM v GROUP BY ALL
), s2 AS (
  SELECT m.mode, st.trace, st.stream_idx, st.trusted OR w.clear_at IS NOT NULL AS ok, coalesce(k2.keys, '') AS keys FROM st CROSS JOIN (SELECT unnest(['pristine', 'faulted']) AS mode) m
  LEFT JOIN wiped w ON w.mode = m.mode AND w.trace = st.trace AND w.stream_idx = st.stream_idx LEFT JOIN k2 ON k2.mode = m.mode AND k2.trace = st.trace AND k2.stream_idx = st.stream_idx
)
SELECT p.trace, p.stream_idx, CASE WHEN NOT (p.ok AND f.ok) THEN 'ineligible' WHEN p.keys = f.keys THEN 'converged' ELSE 'diverged' END AS verdict, CAST(NOT p.ok AS INT) + 2 * CAST(NOT f.ok AS INT) AS ineligibility
FROM s2 p JOIN s2 f ON p.mode = 'pristine' AND f.mode = 'faulted' AND p.trace = f.trace AND p.stream_idx = f.stream_idx""")
def diverged_by_conflict(spark, sf_dir):
    """With no memory of prints, a schedule that leaves only the contradicting payload changes the view unseen."""
    t = _trace(spark, sf_dir, shadow=True, drop=None, duplicate=None, twins_replace=True)
    return comparison(t, Limits(max_recent_fingerprints_per_stream=0)).select("trace", *_long("stream_idx"), "verdict", *_long("ineligibility"))


@_query()
def exact_fold_limits(spark, sf_dir):
    """Small limits, which the closed form cannot take: pending, gap and window limits all show."""
    t = _trace(spark, sf_dir, swap=(11, 7))
    small = Limits(max_pending_envelopes_per_stream=2, max_gap_span_per_stream=8, max_recent_fingerprints_per_stream=4)
    return both_sides(t, small, force_exact=True).drop("view", "error_code", "error_pos").withColumn("frontier", F.col("frontier").cast("long"))


@_query(""", mr AS (
  SELECT trace, stream_idx, sum(CASE WHEN trusted OR era > 0 THEN 1 ELSE 0 END) AS e, sum(CASE WHEN trusted OR era > 0 THEN 0 ELSE 1 END) AS p FROM eras
  WHERE op = 'remove' AND (before IS NULL OR before = 'remove') GROUP BY ALL
)
SELECT j.trace, j.stream_idx, j.frontier, CASE WHEN reasons = 0 THEN 'exact' ELSE 'unknown' END AS certainty, coalesce(h.n, 0) AS key_count, 0 AS duplicates, coalesce(mr.e, 0) AS missing_removes_exact, coalesce(mr.p, 0) AS missing_removes_partial
FROM judged j LEFT JOIN (SELECT trace, stream_idx, count(*) AS n FROM held WHERE mode = 'pristine' GROUP BY ALL) h USING (trace, stream_idx) LEFT JOIN mr USING (trace, stream_idx) WHERE j.mode = 'pristine'""")
def delivered_fold(spark, sf_dir):
    summaries, _ = fold_delivered(_trace(spark, sf_dir))
    return summaries.select("trace", *_long("stream_idx", "frontier"), "certainty", "key_count", "duplicates", "missing_removes_exact", "missing_removes_partial")


@_query("SELECT DISTINCT trace, 0 AS streams_compared, 0 AS stream_prefix, 0 AS pristine_deliveries, 0 AS faulted_deliveries FROM st")
def nothing_to_compare(spark, sf_dir):
    """A schedule that stands before all streams: it has sizes, and no verdict."""
    t = _trace(spark, sf_dir, drop=None, duplicate=None)
    early = settled(t.schedules.withColumn("stream_prefix", F.lit(0)).withColumn("source_prefix", F.lit(0)), "schedules")
    t = Trace(t.streams, t.envelopes, early)
    compared = comparison(t).groupBy("trace").agg(F.count("*").alias("streams_compared"))
    sizes = compare.sizes(early, order(t)).join(compared, "trace", "left").fillna(0, ["streams_compared"])
    return sizes.select("trace", "streams_compared", *_long("stream_prefix", "pristine_deliveries", "faulted_deliveries"))


# ---- records, streaming, contract


@_query("SELECT trace, record_no, kind, line, true AS same FROM lines")
def canonical_jsonl_roundtrip(spark, sf_dir):
    """Every record of the bridge as a line, decoded, encoded canonically, decoded again."""
    limits, once_ = Limits(), _records(spark, sf_dir)
    lines = once_.select("trace", "record_no", "line_no", F.col("canonical_line").cast("binary").alias("payload"), "error", "kind", F.col("canonical_line").alias("line"))
    again = jsonl.decode(lines, limits, carry=("kind", "line"))
    return again.select("trace", "record_no", "carried.kind", "carried.line", (F.col("carried.line") == F.col("canonical_line")).alias("same"))


_CEILINGS = {"records": {"max_records_per_trace": 50}, "trace_bytes": {"max_trace_bytes": 5000}, "line_bytes": {"max_line_bytes": 150}}


@_query(""", upto AS (
  SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY trace ORDER BY record_no) AS bytes FROM lines
), bad AS (
  SELECT trace, 'records' AS ceiling, 50 AS most, record_no, 'record_limit' AS code FROM upto WHERE record_no >= 50
  UNION ALL SELECT trace, 'trace_bytes', 5000, record_no, 'trace_bytes' FROM upto WHERE bytes > 5000
  UNION ALL SELECT trace, 'line_bytes', 150, record_no, 'line_too_long' FROM upto WHERE strlen(line) > 150
), first_bad AS (
  SELECT trace, ceiling, any_value(most) AS limit_value, min(record_no) AS pos, any_value(code) AS code FROM bad GROUP BY ALL
)
SELECT c.ceiling, t.trace, coalesce(pos, t.n) AS lines, code, pos + 1 AS failed_line, limit_value FROM (SELECT unnest(['records', 'trace_bytes', 'line_bytes']) AS ceiling) c
CROSS JOIN (SELECT trace, count(*) AS n FROM lines GROUP BY trace) t LEFT JOIN first_bad f ON f.trace = t.trace AND f.ceiling = c.ceiling""")
def scan_ceilings(spark, sf_dir):
    """The canonical lines scanned under each ceiling: how many come through, and where it ends."""
    path = place(spark, "lines")
    jsonl.write_canonical(_records(spark, sf_dir), path)
    parts = [jsonl.read_lines(spark, path, Limits(**limit)).withColumn("ceiling", F.lit(name)) for name, limit in _CEILINGS.items()]
    bad = F.col("error").isNotNull()
    return reduce(DataFrame.unionByName, parts).groupBy("ceiling", "trace").agg(
        F.sum((~bad).cast("long")).alias("lines"), F.max("error.code").alias("code"), F.max(F.when(bad, F.col("line_no"))).alias("failed_line"), F.max("error.limit_value").cast("long").alias("limit_value")
    )


def _bad_lines_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = ", ".join(f"({n}, {', '.join(map(text, case[1:]))})" for n, case in enumerate(CASES))
    return "{plain}SELECT e.event_id, c.n AS case_no, c.kind, c.code, c.field, c.limit_value, c.actual_value FROM events e JOIN (VALUES " + rows + f") c(n, kind, code, field, limit_value, actual_value) ON e.event_id % {len(CASES)} = c.n"


@_query(_bad_lines_sql())
def bad_lines(spark, sf_dir):
    """Every case of the table of bad lines, with each event's number in it, through the decoder."""
    cases = F.broadcast(spark.createDataFrame([(n, bytearray(c.line)) for n, c in enumerate(CASES)], "n int, payload binary"))
    e = _events(spark, sf_dir).select("event_id", (F.col("event_id") % len(CASES)).cast("int").alias("n")).join(cases, "n")
    # an @ in the line becomes the event's number; bytes that are no text have none
    number = F.regexp_replace(F.hex("payload"), "^((?:..)*?)40", F.concat(F.lit("$1"), F.hex(F.col("event_id").cast("string"))))
    null = F.lit(None)
    lines = e.select(F.col("n").cast("string").alias("trace"), F.col("event_id").alias("record_no"), F.lit(1).cast("long").alias("line_no"), F.unhex(number).alias("payload"), null.cast(ERROR).alias("error"))
    got = jsonl.decode(lines, BAD_LINES)
    return got.select(F.col("record_no").alias("event_id"), F.col("trace").cast("long").alias("case_no"), "kind", "error.code", "error.field", F.col("error.limit_value").cast("long").alias("limit_value"), F.col("error.actual_value").cast("long").alias("actual_value"))


@_query("SELECT trace, envelope_id, stream_idx FROM env WHERE source_idx = 2")
def ordinal_lookup(spark, sf_dir):
    return normalize.lookup(normalize.envelopes(_records(spark, sf_dir)).join(bridge.streams(_events(spark, sf_dir)).select("trace", "stream_id", "stream_idx"), ["trace", "stream_id"]), "source_idx", 2).select("trace", "envelope_id", *_long("stream_idx"))


def _failures(records: DataFrame, limits: Limits = Limits(), schedules: DataFrame | None = None) -> DataFrame:
    plans = normalize.schedules(records) if schedules is None else schedules
    tables = (settled(x, "tables") for x in (normalize.streams(records), normalize.envelopes(records), plans))
    found = validate.violations(records, *tables, limits)
    return validate.first_failures(found)


@_query(""", f AS (
  SELECT c.trace, source_idx + 1 + n AS record_no, sum(strlen(mutations)) OVER (PARTITION BY c.trace ORDER BY source_idx) AS bytes FROM canon c JOIN (SELECT trace, count(*) AS n FROM st GROUP BY trace) USING (trace)
)
SELECT trace, min(record_no) AS record_no, 'state_resource_limit' AS code, 'trace_fingerprint_bytes' AS field, 6000 AS limit_value, arg_min(bytes, record_no) AS actual_value FROM f WHERE bytes > 6000 GROUP BY trace""")
def fingerprint_budget(spark, sf_dir):
    """Six thousand hashed bytes a trace: the envelope that goes beyond."""
    return _failures(_records(spark, sf_dir), Limits(max_fingerprint_bytes_per_trace=6000)).select("trace", "record_no", "code", "field", *_long("limit_value", "actual_value"))


@_query("""SELECT env.trace, min(source_idx + 1 + n) AS record_no, 'cursor_before_initial' AS code FROM env JOIN (SELECT trace, count(*) AS n FROM st GROUP BY trace) USING (trace) WHERE user_id % 5 = 2 AND cursor < 3 GROUP BY env.trace""")
def cursor_before_initial(spark, sf_dir):
    """Streams of each fifth user declare that they start at cursor 3; their first envelopes are older."""
    events, limits = _events(spark, sf_dir), Limits()
    later = bridge.streams(events).withColumn("initial_cursor", F.when(F.col("user_id") % 5 == 2, 3).otherwise(F.col("initial_cursor")).cast("decimal(20,0)"))
    records = settled(_decoded(bridge.json_lines(later, bridge.envelopes(events), limits.trace_format), limits), "records")
    return _failures(records).select("trace", "record_no", "code")


@_query("""SELECT trace, CASE kind WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 0 END AS record_no, CASE kind WHEN 1 THEN 'header_not_first' WHEN 2 THEN 'duplicate_header' WHEN 3 THEN 'missing_header' END AS code,
  CASE kind WHEN 0 THEN n ELSE 0 END AS envelopes FROM (SELECT trace, any_value(user_id // 8) % 4 AS kind, count(*) AS n FROM env GROUP BY trace)""")
def header_rules(spark, sf_dir):
    """Every fourth trace has its header behind a stream, a second one, or no record at all; a trace that fails yields nothing."""
    events, limits = _events(spark, sf_dir), Limits()
    kind = F.substring("trace", 2, 20).cast("long") % 4
    lines = bridge.json_lines(bridge.streams(events), bridge.envelopes(events), limits.trace_format).withColumn("record_no", F.col("record_no") * 10).withColumn("at", kind)
    headers = lines.where("record_no = 0")
    lines = lines.where("at <> 3 and (at <> 1 or record_no > 0)").unionByName(headers.where("at in (1, 2)").withColumn("record_no", F.lit(15).cast("long")))
    records = _decoded(lines.drop("at"), limits)
    every = bridge.streams(events)
    trace, found = assemble(records, every.select("trace", "stream_id", "authority"), limits, every.select("trace").distinct())
    kept = trace.envelopes.groupBy("trace").agg(F.count("*").alias("envelopes"))
    told = every.select("trace").distinct().join(found.select("trace", "record_no", "code"), "trace", "left").join(kept, "trace", "left")
    return told.fillna(0, ["envelopes"]).select("trace", "record_no", "code", "envelopes")


@_query("""SELECT trace, 1 + n + m AS record_no, CASE kind WHEN 1 THEN 'fault_envelope_not_prior' WHEN 2 THEN 'fault_occurrence_not_created' ELSE 'fault_occurrence_removed' END AS code, 'target' AS field
  FROM (SELECT trace, any_value(user_id // 8) % 4 AS kind, count(*) AS n, count(DISTINCT user_id) AS m FROM env GROUP BY trace) WHERE kind > 0""")
def reference_failures(spark, sf_dir):
    """Schedules that name an unknown envelope, an occurrence that no duplicate made, or a delivery that is already dropped; every fourth is sound."""
    records = _records(spark, sf_dir)
    envelopes = bridge.envelopes(_events(spark, sf_dir))
    ref = lambda name, n: F.struct(name.alias("envelope_id"), F.lit(n).alias("occurrence"))
    drop = lambda name, n=0: F.struct(F.lit("drop").alias("action"), ref(name, n).alias("target"), F.lit(None).alias("anchor"), F.lit(None).alias("copies")).cast(ACTION)
    first, kind = F.col("first"), F.substring("trace", 2, 20).cast("long") % 4
    acts = F.when(kind == 1, F.array(drop(F.lit("nobody")))).when(kind == 2, F.array(drop(first, 1))).when(kind == 3, F.array(drop(first), drop(first))).otherwise(F.array(drop(first)))
    names = envelopes.groupBy("trace").agg(F.min_by("envelope_id", "source_idx").alias("first"))
    plans = bridge.schedules(envelopes, drop=None, duplicate=None).join(names, "trace").withColumn("actions", acts).drop("first")
    return _failures(records, schedules=settled(plans, "schedules")).select("trace", "record_no", "code", "field")


@_query(""", r AS (
  SELECT trace, stream_idx + 1 AS record_no, stream_id, stream_idx + 1 AS handle, NULL AS code FROM st
  UNION ALL SELECT trace, stream_idx + 1001, stream_id, stream_idx + 1, NULL FROM st WHERE user_id % 3 = 0
  UNION ALL SELECT trace, stream_idx + 2001, stream_id, NULL, 'conflicting_stream_registration' FROM st WHERE user_id % 7 = 1
  UNION ALL SELECT trace, stream_idx + 3001, stream_id || 'x', NULL, 'duplicate_stream_scope' FROM st WHERE user_id % 11 = 4
), f AS (
  SELECT trace, min(record_no) AS stop FROM r WHERE code IS NOT NULL GROUP BY trace
)
SELECT r.trace, record_no, stream_id, CASE WHEN stop IS NULL OR record_no < stop THEN handle END AS handle, CASE WHEN record_no > stop THEN 'normalizer_failed' ELSE code END AS code FROM r LEFT JOIN f USING (trace)""")
def stream_registrations(spark, sf_dir):
    """Streams declared once more as they were, with another start, or under another name."""
    s = bridge.streams(_events(spark, sf_dir))
    late = lambda rows, by: rows.withColumn("record_no", F.col("record_no") + by)
    again = late(s.where("user_id % 3 = 0"), 1000)
    changed = late(s.where("user_id % 7 = 1"), 2000).withColumn("initial_cursor", F.lit(5).cast("decimal(20,0)"))
    other = late(s.where("user_id % 11 = 4"), 3000).withColumn("stream_id", F.concat("stream_id", F.lit("x")))
    return validate.registrations(s.unionByName(again).unionByName(changed).unionByName(other))


@_query("SELECT trace, stream_idx, delivery_pos, disposition FROM disp")
def streaming_fold(spark, sf_dir):
    """The stateful processor on the faulted deliveries."""
    t = _trace(spark, sf_dir, clears=False)
    rows = deliveries(t).where("mode = 'faulted'").join(t.streams.select("trace", "stream_idx", "initial_cursor", "trusted"), ["trace", "stream_idx"])
    return fold_stream(rows).select("trace", *_long("stream_idx"), "delivery_pos", "disposition")


def _contract_sql() -> str:
    rows = ", ".join("('{}', {}, '{}')".format(a, n, x.replace("'", "''")) for a, n, x in statements())
    return "{plain}SELECT * FROM (VALUES " + rows + ") t(section, place, statement)"


@_query(_contract_sql())
def contract(spark, sf_dir):
    return as_table(spark)
