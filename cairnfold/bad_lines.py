"""Lines with what the decoder must say of them: a table of cases, under small limits, for queries and tests."""

from __future__ import annotations

import json
from typing import NamedTuple

from .limits import Limits

LIMITS = Limits(
    max_line_bytes=1200, max_depth=8, max_values=60, max_string_bytes=64, max_total_string_bytes=500, max_array_items=20, max_object_members=12, max_identity_bytes=32,
    max_mutations_per_envelope=3, max_hashes_per_mutation=4, max_hashes_per_envelope=6, max_opaque_hash_bytes=8, max_token_ids_per_mutation=5, max_token_count=1000,
    max_block_size=64, max_worker_metadata=2, max_fault_actions=3, max_duplicate_copies=4,
)


class Case(NamedTuple):
    """A line (an @ stands for a number), and its kind, or the code, field, limit and actual value of its rejection."""

    line: bytes
    kind: str | None = None
    code: str | None = None
    field: str | None = None
    limit: int | None = None
    actual: int | None = None


def _text(record) -> bytes:
    return json.dumps(record, separators=(",", ":")).encode()


def _header(**more) -> bytes:
    return _text({"kind": "trace_header", "format": LIMITS.trace_format, "trace_id": "t@", "redaction": "omitted", "created_by": "c", "extensions": {}} | more)


def _stream(**more) -> bytes:
    own = {"kind": "stream", "stream_id": "s@", "engine": "x", "engine_version": "1", "engine_instance": "i", "publisher": "p", "data_parallel_rank": 0, "epoch": "e"}
    return _text(own | {"initial_cursor": "0", "baseline": {"kind": "unknown_at_attach"}, "extensions": {}} | more)


def _envelope(*mutations, **more) -> bytes:
    return _text({"kind": "envelope", "envelope_id": "e@", "stream_id": "s", "cursor": "7", "origin": "replay", "mutations": list(mutations), "extensions": {}} | more)


def _store(*hashes, **more):
    hashes = hashes or ({"encoding": "u64", "value": "7"},)
    return {"op": "store_run", "hashes": list(hashes), "group": {"kind": "unspecified"}, "medium": {"kind": "unspecified"}, "metadata": {}} | more


def _schedule(*actions, **more) -> bytes:
    return _text({"kind": "fault_schedule", "schedule_id": "f@", "actions": list(actions), "extensions": {}} | more)


def _act(action: str, **more):
    return {"action": action, "target": {"envelope_id": "e", "occurrence": 0}} | more


_U = {"encoding": "u64", "value": "7"}
_B = lambda text: {"encoding": "bytes", "value": text}
_HEX = "0123456789abcdef" * 4

CASES = [
    # what is accepted
    Case(_header(), "trace_header"),
    Case(_stream(worker_metadata=["a", "b"]), "stream"),
    Case(_stream(worker_metadata=[]), "stream"),
    Case(_envelope(_store(_U, _B("AAEC"), group={"kind": "index", "value": 3}, medium={"kind": "named", "value": "GPU"}, lineage={"kind": "chain", "parent_of_first": _U}, token_count=2, block_size=64, block_metadata=[{}, {"a": 1}])), "envelope"),
    Case(_envelope(_store(token_evidence={"kind": "token_ids", "values": [1, 2]}, token_count=2), {"op": "clear", "metadata": {"b": [True, None, "x"], "a": -5}}), "envelope"),
    Case(_envelope(_store(token_evidence={"kind": "keyed_digest", "algorithm": "h", "key_id": "k", "value": _HEX}), _store(token_evidence={"kind": "unkeyed_digest", "algorithm": "h", "value": _HEX})), "envelope"),
    Case(_schedule(_act("drop"), _act("duplicate", copies=4), _act("move_before", anchor={"envelope_id": "f", "occurrence": 0})), "fault_schedule"),
    Case(b" " + _envelope() + b"\r\n", "envelope"),
    # framing and encoding
    Case(b"", code="empty_line"),
    Case(b" \t ", code="empty_line"),
    Case(b"{}\r{}", code="invalid_framing"),
    Case(b"{}\n\n", code="invalid_framing"),
    Case(b"x" * 1201, code="resource_limit", field="line_bytes", limit=1200, actual=1201),
    Case(b'"ab\xff"', code="invalid_utf8", field="valid_up_to", actual=3),
    Case(b'"\xc3"', code="invalid_utf8", field="valid_up_to", actual=1),
    # numbers, wherever they stand, before anything is parsed
    Case(b'{"a":1.5}', code="non_integer_number"),
    Case(b'{"a":1e3,"a":}', code="non_integer_number"),
    Case(b"[-9007199254740992]", code="unsafe_integer"),
    Case(b"[9007199254740991,12345678901234567890]", code="unsafe_integer"),
    # bounded parsing
    Case(b"{", code="json_syntax"),
    Case(b"[01]", code="json_syntax"),
    Case(b"{} {}", code="json_syntax"),
    Case(b'["\\ud800"]', code="json_syntax"),
    Case(b'{"a":1,"\\u0061":2}', code="duplicate_key"),
    Case(b"[[[[[[[[[1]]]]]]]]]", code="resource_limit", field="json_depth", limit=8, actual=9),
    Case(b"[" + b",".join([b"[1,2,3,4,5,6,7,8,9]"] * 6) + b"]", code="resource_limit", field="json_values", limit=60, actual=61),
    Case(b'["' + b"x" * 65 + b'"]', code="resource_limit", field="string_bytes", limit=64, actual=65),
    Case(b"[" + b",".join([b'"' + b"y" * 64 + b'"'] * 8) + b"]", code="resource_limit", field="total_string_bytes", limit=500, actual=512),
    Case(b"[" + b",".join([b"1"] * 21) + b"]", code="resource_limit", field="array_items", limit=20, actual=21),
    Case(b"{" + b",".join(b'"%d":1' % i for i in range(13)) + b"}", code="resource_limit", field="object_members", limit=12, actual=13),
    # the closed schema
    Case(b"[]", code="schema"),
    Case(b'{"kind":"other"}', code="schema"),
    Case(_header(extra=1), code="schema"),
    Case(_header(redaction="none"), code="schema"),
    Case(_stream(initial_cursor="01"), code="schema"),
    Case(_stream(initial_cursor="18446744073709551616"), code="schema"),
    Case(_stream(data_parallel_rank=True), code="schema"),
    Case(_stream(baseline={"kind": "unknown_at_attach", "x": 1}), code="schema"),
    Case(_envelope(_store(lineage=None)), code="schema"),
    Case(_envelope(_store(_B("AAE"))), code="schema"),
    Case(_envelope(_store(token_evidence={"kind": "unkeyed_digest", "algorithm": "h", "value": _HEX.upper()})), code="schema"),
    Case(_envelope({"op": "clear", "metadata": {}, "hashes": []}), code="schema"),
    Case(_schedule(_act("drop", copies=1)), code="schema"),
    # what one record may hold
    Case(_header(format="another/v1"), code="unsupported_format"),
    Case(_header(trace_id=""), code="empty_field", field="trace_id"),
    Case(_header(created_by="c" * 33), code="field_too_long", field="created_by", limit=32, actual=33),
    Case(_stream(publisher=""), code="empty_field", field="publisher"),
    Case(_stream(worker_metadata=["a", "b", "c"]), code="too_many_items", field="worker_metadata", limit=2, actual=3),
    Case(_stream(worker_metadata=[""]), code="empty_field", field="worker_metadata"),
    Case(_envelope(*[{"op": "clear", "metadata": {}}] * 4), code="too_many_items", field="mutations", limit=3, actual=4),
    Case(_envelope(_store() | {"hashes": []}), code="empty_hashes", field="store_run"),
    Case(_envelope({"op": "remove", "hashes": [], "group": {"kind": "unspecified"}, "medium": {"kind": "unspecified"}, "metadata": {}}), code="empty_hashes", field="remove"),
    Case(_envelope(_store(*[_U] * 5)), code="too_many_items", field="hashes", limit=4, actual=5),
    Case(_envelope(_store(*[_U] * 4), _store(*[_U] * 3)), code="too_many_envelope_hashes", field="hashes", limit=6, actual=7),
    Case(_envelope(_store(_B(""))), code="invalid_opaque_hash_length", field="hashes", limit=8, actual=0),
    Case(_envelope(_store(_B("AAAAAAAAAAAA"))), code="invalid_opaque_hash_length", field="hashes", limit=8, actual=9),
    Case(_envelope(_store(token_count=1001)), code="token_count_exceeded", field="token_count", limit=1000, actual=1001),
    Case(_envelope(_store(token_count=3, token_evidence={"kind": "token_ids", "values": [1]})), code="token_count_mismatch", field="token_count", limit=3, actual=1),
    Case(_envelope(_store(token_evidence={"kind": "token_ids", "values": [1] * 6})), code="too_many_items", field="token_ids", limit=5, actual=6),
    Case(_envelope(_store(token_evidence={"kind": "keyed_digest", "algorithm": "h", "key_id": "", "value": _HEX})), code="empty_field", field="key_id"),
    Case(_envelope(_store(block_size=65)), code="invalid_block_size", field="block_size", limit=64, actual=65),
    Case(_envelope(_store(medium={"kind": "named", "value": ""})), code="empty_field", field="medium"),
    Case(_envelope(_store(block_metadata=[])), code="block_metadata_length", field="block_metadata", limit=1, actual=0),
    Case(_schedule(schedule_id=""), code="empty_field", field="schedule_id"),
    Case(_schedule(*[_act("drop")] * 4), code="too_many_items", field="fault_actions", limit=3, actual=4),
    Case(_schedule(_act("duplicate", copies=0)), code="invalid_duplicate_copies", field="copies", limit=4, actual=0),
    Case(_schedule(_act("duplicate", copies=5)), code="invalid_duplicate_copies", field="copies", limit=4, actual=5),
    Case(_schedule(_act("move_before", anchor={"envelope_id": "e", "occurrence": 0})), code="same_move_target_and_anchor"),
]
