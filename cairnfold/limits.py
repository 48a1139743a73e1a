"""Limits are part of the semantics: exceeding one is a result, never a Spark failure. All maxima are inclusive."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

#: Deepest nesting that a configuration may allow.
HARD_DEPTH = 64


class ConfigurationError(ValueError):
    """Limits that no analysis can run with."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Limits:
    # line and trace
    max_line_bytes: int = 1 << 20
    max_trace_bytes: int = 64 << 20
    max_records_per_trace: int = 100_000
    max_streams_per_trace: int = 4_096
    max_envelopes_per_trace: int = 65_536
    max_fault_schedules_per_trace: int = 1_024
    max_fault_actions_per_trace: int = 65_536
    max_identity_bytes_per_trace: int = 16 << 20
    max_occurrences_per_schedule: int = 131_072
    max_schedule_work_per_trace: int = 1_000_000
    max_fingerprint_bytes_per_trace: int = 64 << 20
    # one stream's state
    max_recent_fingerprints_per_stream: int = 4_096
    max_pending_envelopes_per_stream: int = 1_024
    max_pending_canonical_bytes_per_stream: int = 16 << 20
    max_gap_span_per_stream: int = 65_536
    max_cache_keys_per_stream: int = 262_144
    max_cache_identity_bytes_per_stream: int = 64 << 20
    max_diagnostic_count: int = 1_000_000
    # one record
    max_depth: int = 32
    max_values: int = 65_536
    max_string_bytes: int = 16 << 10
    max_identity_bytes: int = 1_024
    max_total_string_bytes: int = 512 << 10
    max_array_items: int = 16_384
    max_object_members: int = 256
    max_mutations_per_envelope: int = 1_024
    max_hashes_per_mutation: int = 4_096
    max_hashes_per_envelope: int = 8_192
    max_opaque_hash_bytes: int = 256
    max_token_ids_per_mutation: int = 16_384
    max_token_count: int = 1_048_576
    max_block_size: int = 1_048_576
    max_worker_metadata: int = 256
    max_fault_actions: int = 4_096
    max_duplicate_copies: int = 1_024
    #: The wire format's name in trace headers; set it to read traces that another tool wrote.
    trace_format: str = "cairnfold.trace/v1"

    def checked(self) -> Limits:
        """These limits, if an analysis can run with them; the codec's name for the failure is invalid_limits."""
        if self.max_depth > HARD_DEPTH:
            raise ConfigurationError("unsupported_depth_limit", f"max_depth is over {HARD_DEPTH}")
        return self

    def but(self, **changes) -> Limits:
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)
