"""The fold over a stream of deliveries: one StatefulProcessor for streaming and batch frames.

Each key is one stream of one schedule's side. Within a micro-batch deliveries are put in order; across batches the
source must keep each stream's order, as there is no event time. An end marker row (source_idx null) closes a stream.

What grows with a stream (view, waiting payloads, recent prints) is kept in map states, of which a batch reads and
writes the entries that its deliveries touch; the rest is one row of plain columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, MutableMapping
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.fold_state import Delivery, HardError, Slot, StreamFold
from ..limits import Limits
from ..operators.fold import KEY, delivery_of, slim
from ..schema import COUNTERS

OUTPUT = "trace string, schedule_idx int, mode string, stream_idx int, delivery_pos bigint, disposition string, certainty string, frontier decimal(20,0), key_count bigint, pending bigint"
_NUMBERS = ("initial", "frontier", "conflict_to", "lost_from", "lost_to")  # u64 or null, as text
_PLAIN = "certainty string, failed string, trusted boolean, authoritative boolean, baseline_unknown boolean, truncated boolean, view_bytes bigint, pending_bytes bigint, keys bigint, waiting bigint, held bigint"
SCALARS = ", ".join([_PLAIN, *(f"{n} string" for n in _NUMBERS), *(f"{c} bigint" for c in COUNTERS)])
_NAMES = [x.split()[0] for x in SCALARS.split(", ")]
SLOT = "prints array<binary>, size bigint, ops string, first_clear int"


class Kept(MutableMapping):
    """A map state as a dictionary: entries are fetched when asked for, and touched ones are written back by flush()."""

    def __init__(self, state, size: int, write: Callable, read: Callable, key: Callable = str):
        self.state, self.size, self.write, self.read, self.key = state, size, write, read, key
        self.met: dict = {}  # what is known of the state: None stands for no entry
        self.wiped = False

    def _get(self, key):
        if key not in self.met:
            there = not self.wiped and self.size > 0 and self.state.containsKey((str(key),))
            self.met[key] = self.read(key, self.state.getValue((str(key),))) if there else None
        return self.met[key]

    def __contains__(self, key) -> bool:
        return self._get(key) is not None

    def __getitem__(self, key):
        value = self._get(key)
        if value is None:
            raise KeyError(key)
        return value

    def __setitem__(self, key, value) -> None:
        self.size += self._get(key) is None
        self.met[key] = value

    def __delitem__(self, key) -> None:
        self[key]
        self.size -= 1
        self.met[key] = None

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        stored = [] if self.wiped or not self.size else [self.key(k[0]) for k in self.state.keys()]
        return iter([k for k in dict.fromkeys([*stored, *self.met]) if self._get(k) is not None])

    def clear(self) -> None:
        self.met, self.size, self.wiped = {}, 0, True

    def flush(self) -> int:
        """Write what was touched; how many entries that were."""
        if self.wiped:
            self.state.clear()
        for key, value in self.met.items():
            if value is not None:
                self.state.updateValue((str(key),), self.write(value))
            elif not self.wiped and self.state.containsKey((str(key),)):
                self.state.removeKey((str(key),))
        return len(self.met)


def _slot_row(slot: Slot) -> tuple:
    d = slot.delivery
    ops = None if d is None else json.dumps([{"op": o, "keys": list(k), "sizes": list(s)} for o, k, s in d.ops])
    return (list(slot.prints), None if d is None else d.size, ops, None if d is None else d.first_clear)


def _slot_of(cursor: int, row) -> Slot:
    prints = [bytes(p) for p in row[0]]
    if row[2] is None:
        return Slot(prints)
    ops = [(o["op"], o.get("keys", ()), o.get("sizes", ())) for o in json.loads(row[2])]
    return Slot(prints, Delivery(cursor, prints[0], int(row[1]), ops, None if row[3] is None else int(row[3])))


class FoldProcessor(StatefulProcessor):
    """Follows one StreamFold per key, whose size the limits on keys, pending payloads and recent prints bound. An ended stream leaves nothing behind."""

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.plain = handle.getValueState("plain", SCALARS)
        self.view = handle.getMapState("view", "key string", "size bigint")
        self.pending = handle.getMapState("pending", "cursor string", SLOT)
        self.recent = handle.getMapState("recent", "cursor string", SLOT)

    def _opened(self, row) -> StreamFold:
        old = dict(zip(_NAMES, self.plain.get())) if self.plain.exists() else None
        sizes = (old["keys"], old["waiting"], old["held"]) if old else (0, 0, 0)
        maps = {
            "view": Kept(self.view, sizes[0], lambda v: (v,), lambda _, r: int(r[0])),
            "pending": Kept(self.pending, sizes[1], _slot_row, _slot_of, int),
            "recent": Kept(self.recent, sizes[2], _slot_row, _slot_of, int),
        }
        if old is None:
            return StreamFold(self.limits, int(row.initial_cursor), bool(row.trusted), **maps)
        number = {n: None if old[n] is None else int(old[n]) for n in _NUMBERS}
        fold = StreamFold(self.limits, number.pop("initial"), bool(old["trusted"]), **maps, **number)
        for name in ("certainty", "failed", "authoritative", "baseline_unknown", "truncated", "view_bytes", "pending_bytes"):
            setattr(fold, name, old[name])
        fold.counts = {c: int(old[c]) for c in COUNTERS}
        return fold

    def _closed(self, fold: StreamFold) -> None:
        for kept in (fold.view, fold.pending, fold.recent):
            kept.flush()
        sizes = {"keys": len(fold.view), "waiting": len(fold.pending), "held": len(fold.recent)}
        told = sizes | fold.counts | {n: None if getattr(fold, n) is None else str(getattr(fold, n)) for n in _NUMBERS}
        self.plain.update(tuple(told[n] if n in told else getattr(fold, n) for n in _NAMES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("delivery_pos")
        fold, out, ended = None, [], False
        for row in batch.itertuples():
            fold = fold or self._opened(row)
            if pd.isna(row.source_idx):
                if fold.failed:  # as in batches, a failed stream has no summary
                    out.append((*key, row.delivery_pos, "error:state_failed", None, None, None, None))
                else:
                    end = fold.finish()
                    out.append((*key, row.delivery_pos, "finished", end["certainty"], end["frontier"], end["key_count"], end["pending"]))
                ended = True
                break
            if fold.failed:  # nothing follows a failure
                continue
            try:
                told = fold.admit(delivery_of(row))
            except HardError as e:
                told = f"error:{e.code}"
            out.append((*key, row.delivery_pos, told, fold.certainty, fold.frontier, len(fold.view), len(fold.pending)))
        if ended:
            for state in (self.plain, self.view, self.pending, self.recent):
                state.clear()
        elif fold is not None:
            self._closed(fold)
        names = [x.split()[0] for x in OUTPUT.split(", ")]
        frame = pd.DataFrame(out, columns=names).astype(object)
        frame["frontier"] = [None if pd.isna(x) else Decimal(int(x)) for x in frame["frontier"]]
        yield frame

    def close(self) -> None:
        pass


def fold_stream(deliveries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Dispositions with the state after each, from deliveries with payload, initial_cursor and trusted."""
    deliveries.sparkSession.streams.active  # noqa: B018  starts what keeps state stores, also for a batch frame
    rows = slim(deliveries, "initial_cursor", "trusted")
    return rows.groupBy(*KEY).transformWithStateInPandas(FoldProcessor(limits.checked()), OUTPUT, "append", "none")
