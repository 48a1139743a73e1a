"""The exact fold of each stream: a task follows its streams' deliveries in order, one stream after the other."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold_state import Delivery, HardError, StreamFold
from ..limits import Limits
from ..schema import DISPOSITIONS, SUMMARIES
from .faults import fresh
from .ordered import in_groups

KEY = ["trace", "schedule_idx", "mode", "stream_idx"]
_SUMMARY = [x.split()[0] for x in SUMMARIES.split(", ")]


def delivery_of(row) -> Delivery:
    """A delivery from a row whose ops are JSON text: nested columns cost far more on their way to Python."""
    return Delivery(int(row.cursor), bytes(row.fingerprint), int(row.canonical_bytes), _parsed(row.ops), None if pd.isna(row.first_clear) else int(row.first_clear))


def slim(deliveries: DataFrame, *more: str) -> DataFrame:
    """What delivery_of reads, and the places."""
    return deliveries.select(*KEY, "delivery_pos", F.col("source_idx").cast("long"), F.col("occurrence").cast("int"), "cursor", "fingerprint", "canonical_bytes", "first_clear", F.to_json("ops").alias("ops"), *more)


@lru_cache(1 << 14)
def _short_ops(text: str) -> list:
    return _parsed(text)


def _parsed(text: str) -> list:
    return [(o["op"], o.get("keys", ()), o.get("sizes", ())) for o in json.loads(text)]


def _followed(limits: Limits, head: tuple, rows: Iterator[tuple]) -> tuple[StreamFold, Iterator[tuple]]:
    """A stream's fold, and (delivery_pos, source_idx, occurrence, disposition or HardError) of its deliveries, as they are asked for; an error is the last."""
    fold = StreamFold(limits, int(head[0]), head[1])

    def told() -> Iterator[tuple]:
        for pos, source, occurrence, cursor, print_, size, clear, ops in rows:
            try:
                yield pos, source, occurrence, fold.admit(Delivery(int(cursor), print_, size, _short_ops(ops) if len(ops) < 512 else _parsed(ops), clear))
            except HardError as e:
                yield pos, source, occurrence, e
                return

    return fold, told()


def _dispositions(limits: Limits):
    def step(key: tuple, head: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for *place, what in _followed(limits, head, rows)[1]:
            yield *key, *place, f"error:{what.code}" if isinstance(what, HardError) else what

    return step


def _summary(limits: Limits):
    def step(key: tuple, head: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        fold, told = _followed(limits, head, rows)
        last = None
        for last in told:
            pass
        failed = last is not None and isinstance(last[3], HardError)
        row = dict(zip(KEY, key)) | ({"error_code": last[3].code, "error_pos": last[0]} if failed else fold.finish())
        if row.get("frontier") is not None:
            row["frontier"] = Decimal(row["frontier"])
        yield tuple(map(row.get, _SUMMARY))

    return step


def visible_streams(schedules: DataFrame, streams: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """The streams that each schedule sees, for each side; also those without any delivery."""
    seen = streams.select("trace", "stream_idx", "initial_cursor", "trusted").join(schedules.select("trace", "schedule_idx", "stream_prefix"), "trace").where("stream_idx < stream_prefix")
    return seen.drop("stream_prefix").withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def _grouped(visible: DataFrame, deliveries: DataFrame, step: Callable, schema: str) -> DataFrame:
    return in_groups(visible.select(*KEY, "initial_cursor", "trusted"), fresh(slim(deliveries)), KEY, "delivery_pos", step, schema)


def summaries(visible: DataFrame, deliveries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One summary per stream and side, or its hard error."""
    return _grouped(visible, deliveries, _summary(limits.checked()), SUMMARIES)


def dispositions(visible: DataFrame, deliveries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What became of each delivery; a hard error ends its stream's rows."""
    return _grouped(visible, deliveries, _dispositions(limits.checked()), DISPOSITIONS)
