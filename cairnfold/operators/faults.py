"""Fault schedules: numeric plans, and the delivery order that drops, duplicates and moves lead to."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_groups
from .validate import references

PRISTINE, FAULTED = "pristine", "faulted"
_ORDER = "trace string, schedule_idx int, delivery_pos bigint, source_idx bigint, occurrence int"


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that a table can meet one that it was derived from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _places(n: str) -> Column:
    """0 to n - 1."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long")), lambda x: x < F.col(n))


def plans(schedules: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Actions by numbers: (trace, schedule_idx, action_idx, action, source_idx, occurrence, anchor_source, anchor_occurrence, first_occurrence, copies)."""
    refs = references(schedules, envelopes)
    own = refs.where("role = 'target'").select("trace", "schedule_idx", "action_idx", "action", "source_idx", "occurrence", "first_occurrence", "copies")
    other = refs.where("role = 'anchor'").select("trace", "schedule_idx", "action_idx", F.col("source_idx").alias("anchor_source"), F.col("occurrence").alias("anchor_occurrence"))
    return own.join(other, ["trace", "schedule_idx", "action_idx"], "left")


def created(plans: DataFrame) -> DataFrame:
    """The occurrences that duplicates create, one row each."""
    made = plans.where("action = 'duplicate'")
    return made.select("trace", "schedule_idx", "action_idx", "source_idx", F.explode(F.sequence("first_occurrence", F.col("first_occurrence") + F.col("copies") - 1)).alias("occurrence")).withColumn("occurrence", F.col("occurrence").cast("int"))


class DeliveryOrder:
    """A linked list of deliveries with an index, so that each edit takes constant time."""

    def __init__(self, sources: Iterable[int]):
        self.after: dict = {}
        self.before: dict = {}
        last = None
        for s in sources:
            self._link(last, (s, 0), None)
            last = (s, 0)

    def _link(self, left, key, right) -> None:
        self.before[key], self.after[key] = left, right
        self.after[left] = key
        self.before[right] = key

    def drop(self, key) -> None:
        left, right = self.before.pop(key), self.after.pop(key)
        self.after[left], self.before[right] = right, left

    def duplicate(self, key, first: int, copies: int) -> None:
        for n in range(first, first + copies):
            self._link(key, (key[0], n), self.after[key])
            key = (key[0], n)

    def move_before(self, key, anchor) -> None:
        if self.after[key] != anchor:
            self.drop(key)
            self._link(self.before[anchor], key, anchor)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        key = self.after.get(None)
        while key is not None:
            yield key
            key = self.after[key]


def _materialized(key: tuple, head: tuple, actions: Iterator[tuple]) -> Iterator[tuple]:
    order = DeliveryOrder(range(head[0]))
    for _, action, source, occurrence, anchor_source, anchor_occurrence, first, copies in actions:
        target = (source, occurrence)
        if action == "drop":
            order.drop(target)
        elif action == "duplicate":
            order.duplicate(target, first, copies)
        else:
            order.move_before(target, (anchor_source, anchor_occurrence))
    return ((*key, n, *place) for n, place in enumerate(order))


def materialize(schedules: DataFrame, plans: DataFrame) -> DataFrame:
    """Any schedule's faulted order; each schedule is edited by itself, and only numbers enter Python."""
    keys = ["trace", "schedule_idx"]
    actions = fresh(plans).select(*keys, "action_idx", "action", "source_idx", "occurrence", "anchor_source", "anchor_occurrence", "first_occurrence", "copies")
    return in_groups(schedules.select(*keys, "source_prefix"), actions, keys, "action_idx", _materialized, _ORDER).withColumn("mode", F.lit(FAULTED))


def materialize_relational(schedules: DataFrame, plans: DataFrame) -> DataFrame:
    """The same order as one sort key, for schedules that drop and duplicate original deliveries only.

    Copies follow their original at once, newer blocks before older ones, each block rising.
    """
    originals = schedules.select("trace", "schedule_idx", F.explode(_places("source_prefix")).alias("source_idx"))
    originals = originals.select("*", F.lit(0).alias("occurrence"), F.lit(0).alias("age"))
    drops = plans.where("action = 'drop'").select("trace", "schedule_idx", "source_idx", F.col("occurrence").cast("int"))
    copies = created(plans).select("trace", "schedule_idx", "source_idx", "occurrence", (-F.col("action_idx") - 1).alias("age"))
    rows = originals.unionByName(copies.withColumn("source_idx", F.col("source_idx").cast("long"))).join(drops, ["trace", "schedule_idx", "source_idx", "occurrence"], "left_anti")
    # age 0 is the original; among copies a later action stands first
    order = Window.partitionBy("trace", "schedule_idx").orderBy("source_idx", (F.col("age") != 0).cast("int"), "age", "occurrence")
    return rows.select("trace", "schedule_idx", (F.row_number().over(order) - 1).cast("long").alias("delivery_pos"), "source_idx", "occurrence", F.lit(FAULTED).alias("mode"))


def pristine(schedules: DataFrame) -> DataFrame:
    """The order without faults: every visible envelope once, as it stands."""
    rows = schedules.select("trace", "schedule_idx", F.explode(_places("source_prefix")).alias("source_idx"))
    return rows.select("trace", "schedule_idx", F.col("source_idx").alias("delivery_pos"), "source_idx", F.lit(0).alias("occurrence"), F.lit(PRISTINE).alias("mode"))


def with_payload(order: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Deliveries with what the fold reads of their envelopes; duplicates share the work done once per envelope."""
    e = envelopes.select("trace", F.col("source_idx").cast("long").alias("source_idx"), "envelope_id", "stream_idx", "cursor", "fingerprint", "canonical_bytes", "first_clear", "ops")
    return order.join(e, ["trace", "source_idx"])
