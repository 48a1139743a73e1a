"""The decision table of the fold, its closed form on random traces, and the delivery order against a plain list."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnfold.functions.fold_state import LAST, Delivery, HardError, StreamFold
from cairnfold.limits import Limits
from cairnfold.operators.faults import DeliveryOrder


def d(cursor, *ops):
    full = [(op, () if op == "clear" else (key,), () if op == "clear" else (8,)) for op, key in ops]
    clear = next((i for i, (op, _) in enumerate(ops) if op == "clear"), None)
    text = repr(ops).encode()
    return Delivery(cursor, hashlib.sha256(text).digest(), len(text), full, clear)


def put(cursor, key="a"):
    return d(cursor, ("store_run", key))


CLEAR = ("clear", None)


def fold(trusted=True, initial=0, **limits):
    return StreamFold(Limits(**limits), initial, trusted)


def run(f, *deliveries):
    return [f.admit(x) for x in deliveries]


def test_in_order_and_gap_and_drain():
    f = fold()
    assert run(f, put(0, "a"), put(2, "c"), put(1, "b")) == ["applied", "buffered", "applied"]
    end = f.finish()
    assert (end["certainty"], end["frontier"], end["key_count"], end["reasons"]) == ("exact", 2, 3, 0)


def test_duplicates_and_conflicts():
    f = fold()
    assert run(f, put(0), put(0), put(0, "x"), put(0, "x"), put(0, "y")) == ["applied", "duplicate", "equivocation", "duplicate", "equivocation"]
    assert not f.authoritative and f.certainty == "unknown" and f.reasons == 2
    g = fold()
    assert run(g, put(1), put(1), put(1, "x"), put(0)) == ["buffered", "duplicate", "equivocation", "applied"]
    assert g.authoritative and g.frontier == 0 and g.pending_bytes == 0 and g.finish()["reasons"] == 2 | 8


def test_past_the_window_is_stale():
    f = fold(max_recent_fingerprints_per_stream=0)
    assert run(f, put(0), put(0), d(0, CLEAR)) == ["applied", "stale_unverifiable", "stale_barrier"]


def test_barriers():
    f = fold()
    assert run(f, put(0), put(3, "q"), d(2, ("store_run", "old"), CLEAR, ("store_run", "new"))) == ["applied", "buffered", "barrier_applied"]
    assert f.frontier == 3 and sorted(f.view) == ["new", "q"] and f.certainty == "exact"
    g = fold(trusted=False)
    assert run(g, put(5), put(6, "b")) == ["applied", "applied"] and g.certainty == "unknown" and g.reasons == 1
    assert run(g, d(9, CLEAR)) == ["barrier_applied"] and g.certainty == "exact"
    h = fold()
    assert run(h, d(0, ("store_run", "a"), CLEAR)) == ["applied"]  # in order it is an ordinary envelope


def test_limits_make_horizons():
    f = fold(max_gap_span_per_stream=2)
    assert run(f, put(0), put(4), put(3), put(5), put(1, "b"), put(2, "c")) == ["applied", "gap_limit", "buffered", "unverifiable_gap", "applied", "applied"]
    assert f.frontier == 3 and f.certainty == "unknown"
    assert run(f, d(5, CLEAR), d(6, CLEAR)) == ["unverifiable_gap", "barrier_applied"] and f.certainty == "exact"
    g = fold(max_pending_envelopes_per_stream=1)
    assert run(g, put(2), put(3), put(0)) == ["buffered", "pending_limit", "applied"]
    b = fold(max_pending_canonical_bytes_per_stream=10)
    assert run(b, put(2)) == ["pending_limit"]


def test_hard_errors_change_nothing_and_stick():
    f = fold(max_cache_keys_per_stream=1)
    f.admit(put(0, "a"))
    with pytest.raises(HardError) as e:
        f.admit(d(1, ("store_run", "b")))
    assert e.value.code == "state_resource_limit" and sorted(f.view) == ["a"] and f.frontier == 0
    with pytest.raises(HardError) as e:
        f.admit(put(1, "a"))
    assert e.value.code == "state_failed"
    with pytest.raises(HardError) as e:
        fold(initial=5).admit(put(4))
    assert e.value.code == "cursor_before_initial"
    g = fold(max_cache_identity_bytes_per_stream=8)
    g.admit(d(0, ("store_run", "a"), ("remove", "a"), ("store_run", "b")))
    assert g.view_bytes == 8


def test_removes_and_counters():
    f = fold(max_diagnostic_count=1)
    run(f, d(0, ("remove", "x"), ("remove", "x")), put(0), put(0))
    end = f.finish()
    assert end["missing_removes_exact"] == 1 and end["truncated"]
    g = fold(trusted=False)
    run(g, d(3, ("remove", "x")))
    assert g.counts["missing_removes_partial"] == 1


def test_the_last_cursor_is_terminal():
    f = fold(initial=LAST)
    assert run(f, put(LAST)) == ["applied"] and f.expected is None and run(f, put(LAST)) == ["duplicate"]


@st.composite
def traces(draw):
    n = draw(st.integers(0, 8))
    payload = [[draw(st.sampled_from([("store_run", "a"), ("store_run", "b"), ("remove", "a"), CLEAR])) for _ in range(draw(st.integers(0, 2)))] for _ in range(n)]
    order = draw(st.lists(st.integers(0, max(0, n - 1)), max_size=14)) if n else []
    return [d(c, *payload[c]) for c in order], draw(st.booleans())


def closed(deliveries, trusted):
    """The closed form in a few lines, for streams without conflicts or limits."""
    by = {x.cursor: x for x in deliveries}
    if not by:
        return ("exact" if trusted else "unknown"), None, set(), 0
    c0 = deliveries[0].cursor
    clears = [c for c, x in by.items() if x.first_clear is not None and (trusted or c >= c0)]
    anchor = max(clears) if clears else 0 if trusted else c0
    front = anchor - 1
    while front + 1 in by:
        front += 1
    view = set()
    for c in range(anchor, front + 1):
        for op, keys, _ in by[c].ops:
            view = set() if op == "clear" else view | {*keys} if op == "store_run" else view - {*keys}
    pending = sum(c > front for c in by) if front >= anchor else len(by)
    sure = trusted or bool(clears)
    return ("exact" if sure and not pending else "unknown"), (front if front >= anchor else None), view, pending


@settings(max_examples=10_000, deadline=None)
@given(traces())
def test_fold_equals_closed_form(case):
    deliveries, trusted = case
    f = fold(trusted)
    run(f, *deliveries)
    end = f.finish()
    assert (end["certainty"], end["frontier"], set(end["view"]), end["pending"]) == closed(deliveries, trusted)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 1)), max_size=60), st.booleans())
def test_fold_is_deterministic_and_bounded(events, trusted):
    small = {"max_pending_envelopes_per_stream": 3, "max_recent_fingerprints_per_stream": 2, "max_gap_span_per_stream": 5}
    f, g = fold(trusted, **small), fold(trusted, **small)
    deliveries = [put(c, f"k{v}") for c, v in events]
    assert run(f, *deliveries) == run(g, *deliveries) and f.finish() == g.finish()
    assert len(f.pending) <= 3 and len(f.recent) <= 2 and f.pending_bytes == sum(s.size for s in f.pending.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["drop", "dup", "move"]), st.integers(0, 50), st.integers(0, 50), st.integers(1, 3)), max_size=60))
def test_delivery_order_equals_a_list(steps):
    order, plain, next_ = DeliveryOrder(range(4)), [(s, 0) for s in range(4)], dict.fromkeys(range(4), 1)
    for what, i, j, copies in steps:
        if not plain:
            break
        x, y = plain[i % len(plain)], plain[j % len(plain)]
        if what == "drop":
            order.drop(x)
            plain.remove(x)
        elif what == "dup":
            order.duplicate(x, next_[x[0]], copies)
            at = plain.index(x) + 1
            plain[at:at] = [(x[0], next_[x[0]] + n) for n in range(copies)]
            next_[x[0]] += copies
        elif x != y:
            order.move_before(x, y)
            plain.remove(x)
            plain.insert(plain.index(y), x)
        assert list(order) == plain


def test_newest_copies_stand_next_to_the_original():
    order = DeliveryOrder([0])
    order.duplicate((0, 0), 1, 4)
    order.drop((0, 1))
    order.duplicate((0, 0), 5, 1)
    assert [o for _, o in order] == [0, 5, 2, 3, 4]
