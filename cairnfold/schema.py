"""The tables that records become."""

from __future__ import annotations

from pyspark.sql import types as T

HASH = "struct<encoding:string,u64:decimal(20,0),bytes:binary>"
GROUP = "struct<kind:string,value:bigint>"
MEDIUM = "struct<kind:string,value:string>"
LINEAGE = f"struct<kind:string,parent:{HASH}>"
EVIDENCE = "struct<kind:string,algorithm:string,key_id:string,value:string,token_values:array<bigint>>"
MUTATION = f"struct<op:string,hashes:array<{HASH}>,grp:{GROUP},medium:{MEDIUM},lineage:{LINEAGE},token_count:bigint,token_evidence:{EVIDENCE},block_size:bigint,block_metadata:array<string>,metadata:string>"
REF = "struct<envelope_id:string,occurrence:int>"
ACTION = f"struct<action:string,target:{REF},anchor:{REF},copies:int>"

HEADER_BODY = "struct<format:string,trace_id:string,redaction:string,created_by:string,extensions:string>"
STREAM_BODY = "struct<stream_id:string,engine:string,engine_version:string,engine_instance:string,publisher:string,data_parallel_rank:bigint,epoch:string,initial_cursor:decimal(20,0),baseline:string,worker_metadata:array<string>,extensions:string>"
ENVELOPE_BODY = f"struct<envelope_id:string,stream_id:string,cursor:decimal(20,0),origin:string,mutations:array<{MUTATION}>,extensions:string,canonical:string>"
SCHEDULE_BODY = f"struct<schedule_id:string,actions:array<{ACTION}>,extensions:string>"
ERROR = "struct<layer:string,code:string,field:string,limit_value:decimal(20,0),actual_value:decimal(20,0)>"

LINES = "trace string, record_no bigint, line_no bigint, payload binary, start_byte bigint, end_byte bigint, error " + ERROR
RECORDS = f"trace string, record_no bigint, line_no bigint, kind string, header {HEADER_BODY}, stream {STREAM_BODY}, envelope {ENVELOPE_BODY}, schedule {SCHEDULE_BODY}, canonical_line string, error {ERROR}"
VIOLATIONS = "trace string, record_no bigint, check_rank bigint, layer string, code string, field string, limit_value decimal(20,0), actual_value decimal(20,0)"

DELIVERIES = "trace string, schedule_idx int, mode string, delivery_pos bigint, source_idx bigint, occurrence int"
DISPOSITIONS = "trace string, schedule_idx int, mode string, stream_idx int, delivery_pos bigint, source_idx bigint, occurrence int, disposition string"
COUNTERS = ("duplicates", "equivocations", "stale_unverifiable", "stale_barriers", "missing_removes_exact", "missing_removes_partial", "pending_limits", "gap_limits", "unverifiable_gaps", "unclosed_gaps")
SUMMARIES = (
    "trace string, schedule_idx int, mode string, stream_idx int, certainty string, frontier decimal(20,0), authoritative boolean, key_count bigint, identity_bytes bigint, view array<string>, "
    "pending bigint, pending_bytes bigint, recent bigint, reasons int, " + ", ".join(f"{c} bigint" for c in COUNTERS) + ", truncated boolean, error_code string, error_pos bigint"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
