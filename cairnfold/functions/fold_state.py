"""One stream's consumer state: deliveries go in one by one, each gets a disposition, the end gives a summary.

This sequential form is the authority. It needs the deliveries of one stream in order and nothing else, so it runs
inside a grouped map and inside a streaming processor alike.
"""

from __future__ import annotations

from collections.abc import MutableMapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from ..limits import Limits
from ..schema import COUNTERS

LAST = 2**64 - 1
BASELINE, EQUIVOCATION, UNAVAILABLE, UNCLOSED = 1, 2, 4, 8

#: One operation on the cache: what (store_run, remove, clear), which keys, and each key's identity bytes.
Op = tuple[str, Sequence[str], Sequence[int]]


class HardError(Exception):
    """Ends a stream's fold; nothing of the delivery that caused it is applied."""

    def __init__(self, code: str, resource: str | None = None):
        super().__init__(code)
        self.code, self.resource = code, resource


class Delivery(NamedTuple):
    cursor: int
    print: bytes
    size: int
    ops: Sequence[Op]
    first_clear: int | None


@dataclass
class Slot:
    """What is known at a cursor: one payload, or the first two prints of conflicting ones."""

    prints: list[bytes]
    delivery: Delivery | None = None

    @property
    def size(self) -> int:
        return self.delivery.size if self.delivery else 0

    def meets(self, p: bytes) -> str:
        if p in self.prints:
            return "same"
        if len(self.prints) == 1:
            self.prints.append(p)
            return "first conflict"
        return "another conflict"


class _Overlay:
    """Changes to a view that are committed together or not at all."""

    def __init__(self, view: MutableMapping[str, int], held: int, limits: Limits):
        self.view, self.limits = view, limits
        self.change: dict[str, int | None] = {}
        self.wiped = False
        self.keys, self.bytes, self.missing = len(view), held, 0

    def has(self, key: str) -> bool:
        if key in self.change:
            return self.change[key] is not None
        return not self.wiped and key in self.view

    def run(self, ops: Sequence[Op]) -> None:
        for op, keys, sizes in ops:
            if op == "clear":
                self.change, self.wiped, self.keys, self.bytes = {}, True, 0, 0
                continue
            for key, size in zip(keys, sizes):
                there = self.has(key)
                if op == "remove":
                    if there:
                        self.change[key] = None
                        self.keys, self.bytes = self.keys - 1, self.bytes - size
                    else:
                        self.missing += 1
                elif not there:
                    if self.keys + 1 > self.limits.max_cache_keys_per_stream:
                        raise HardError("state_resource_limit", "cache_keys")
                    if self.bytes + size > self.limits.max_cache_identity_bytes_per_stream:
                        raise HardError("state_resource_limit", "cache_identity_bytes")
                    self.change[key] = size
                    self.keys, self.bytes = self.keys + 1, self.bytes + size

    def commit(self) -> None:
        if self.wiped:
            self.view.clear()
        for key, size in self.change.items():
            if size is None:
                self.view.pop(key, None)
            else:
                self.view[key] = size


@dataclass
class StreamFold:
    limits: Limits
    initial: int
    trusted: bool
    certainty: str = ""
    frontier: int | None = None
    authoritative: bool = False
    baseline_unknown: bool = True
    conflict_to: int | None = None  # the highest cursor with conflicting payloads
    lost_from: int | None = None  # the range of cursors that could not be kept
    lost_to: int | None = None
    view: MutableMapping[str, int] = field(default_factory=dict)
    view_bytes: int = 0
    pending: MutableMapping[int, Slot] = field(default_factory=dict)
    pending_bytes: int = 0
    recent: MutableMapping[int, Slot] = field(default_factory=dict)  # an unbroken range of cursors that ends at the frontier
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    truncated: bool = False
    failed: str | None = None

    def __post_init__(self):
        self.authoritative = self.trusted
        self.baseline_unknown = not self.trusted
        self.certainty = "exact" if self.trusted else "unknown"

    # ---- admission

    def admit(self, d: Delivery) -> str:
        if self.failed:
            raise HardError("state_failed")
        try:
            out = self._admit(d)
        except HardError as e:
            self.failed = e.code
            raise
        return out

    def _admit(self, d: Delivery) -> str:
        c = d.cursor
        if c < self.initial:
            raise HardError("cursor_before_initial")
        if c in self.pending:
            return self._again(self.pending[c], d, past=False)
        if self.frontier is not None and c <= self.frontier:
            return self._past(d)
        if self.lost_from is not None and c >= self.lost_from and (d.first_clear is None or c <= self.lost_to):
            return self._lost(c, "unverifiable_gaps", "unverifiable_gap")
        expected = self.expected
        if d.first_clear is not None and (self.certainty != "exact" or (expected is not None and c > expected)):
            return self._apply(d, barrier=True)
        if (self.baseline_unknown and self.frontier is None) or c == expected:
            return self._apply(d, barrier=False)
        if expected is None:
            return self._past(d)
        if c - expected > self.limits.max_gap_span_per_stream:
            return self._lost(c, "gap_limits", "gap_limit")
        if len(self.pending) >= self.limits.max_pending_envelopes_per_stream or self.pending_bytes + d.size > self.limits.max_pending_canonical_bytes_per_stream:
            return self._lost(c, "pending_limits", "pending_limit")
        self.pending[c] = Slot([d.print], d)
        self.pending_bytes += d.size
        self._settle()
        return "buffered"

    @property
    def expected(self) -> int | None:
        if self.frontier is None:
            return self.initial
        return None if self.frontier == LAST else self.frontier + 1

    def _past(self, d: Delivery) -> str:
        if d.cursor in self.recent:
            return self._again(self.recent[d.cursor], d, past=True)
        kind = "stale_unverifiable" if d.first_clear is None else "stale_barriers"
        self._count(kind)
        return "stale_unverifiable" if d.first_clear is None else "stale_barrier"

    def _again(self, slot: Slot, d: Delivery, past: bool) -> str:
        met = slot.meets(d.print)
        if met == "same":
            self._count("duplicates")
            return "duplicate"
        self.pending_bytes -= slot.size if not past else 0
        slot.delivery = None  # a conflicting payload is not kept
        self._count("equivocations")
        self.conflict_to = max(d.cursor, self.conflict_to if self.conflict_to is not None else 0)
        self.authoritative = self.authoritative and not past
        self._settle()
        return "equivocation"

    def _lost(self, c: int, counter: str, disposition: str) -> str:
        self._count(counter)
        self.lost_from = c if self.lost_from is None else min(c, self.lost_from)
        self.lost_to = c if self.lost_to is None else max(c, self.lost_to)
        self._settle()
        return disposition

    def _apply(self, d: Delivery, barrier: bool) -> str:
        cache = _Overlay(self.view, self.view_bytes, self.limits)
        cache.run(d.ops[d.first_clear :] if barrier else d.ops)
        past_loss = barrier and self.lost_to is not None and d.cursor > self.lost_to
        applied, c = [(d.cursor, d.print)], d.cursor
        while c < LAST and (past_loss or self.lost_from is None or c + 1 < self.lost_from):
            slot = self.pending.get(c + 1)
            if slot is None or slot.delivery is None:
                break
            cache.run(slot.delivery.ops)
            c += 1
            applied.append((c, slot.delivery.print))
        # nothing can fail from here on
        if barrier:
            for old in [x for x in self.pending if x <= d.cursor]:
                self.pending_bytes -= self.pending.pop(old).size
            self.recent.clear()
            self.baseline_unknown, self.authoritative = False, True
            if self.conflict_to is not None and self.conflict_to < d.cursor:
                self.conflict_to = None
            if self.lost_to is not None and self.lost_to < d.cursor:
                self.lost_from = self.lost_to = None
        cache.commit()
        self.view_bytes = cache.bytes
        for cursor, p in applied:
            if cursor != d.cursor:
                self.pending_bytes -= self.pending.pop(cursor).size
            self._remember(cursor, p)
        self.frontier = c
        self._count("missing_removes_exact" if self.authoritative else "missing_removes_partial", cache.missing)
        self._settle()
        return "barrier_applied" if barrier else "applied"

    def _remember(self, cursor: int, p: bytes) -> None:
        self.recent[cursor] = Slot([p])
        if len(self.recent) > self.limits.max_recent_fingerprints_per_stream:
            del self.recent[cursor - len(self.recent) + 1]

    def _count(self, name: str, added: int = 1) -> None:
        total = self.counts[name] + added
        self.truncated |= total > self.limits.max_diagnostic_count
        self.counts[name] = min(total, self.limits.max_diagnostic_count)

    def _settle(self) -> None:
        poisoned = self.baseline_unknown or self.conflict_to is not None or self.lost_to is not None
        self.certainty = "unknown" if poisoned else "recovering" if self.pending else "exact"

    # ---- the end

    @property
    def reasons(self) -> int:
        return BASELINE * self.baseline_unknown | EQUIVOCATION * (self.conflict_to is not None) | UNAVAILABLE * (self.lost_to is not None)

    def finish(self) -> dict:
        """The stream's summary, as columns. Payloads still waiting mean that the end leaves a gap."""
        open_gap = bool(self.pending)
        if open_gap:
            self._count("unclosed_gaps")
            self.certainty = "unknown"
        return {
            "certainty": self.certainty,
            "frontier": self.frontier,
            "authoritative": self.authoritative,
            "key_count": len(self.view),
            "identity_bytes": self.view_bytes,
            "view": sorted(self.view),
            "pending": len(self.pending),
            "pending_bytes": self.pending_bytes,
            "recent": len(self.recent),
            "reasons": self.reasons | UNCLOSED * open_gap,
            **self.counts,
            "truncated": self.truncated,
        }
