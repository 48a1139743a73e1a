"""Sequential steps over groups of rows: each task walks through sorted rows, so a group costs nothing but its rows and is never held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import struct


def in_groups(heads: DataFrame, rows: DataFrame, keys: list[str], order: str, step: Callable[[tuple, tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """step(key, head, rows) of each key that has a head, its rows by rising `order`; what it yields are rows of the schema.

    Heads and rows come without their keys: a head as its other columns stand, a row as its others do, order first. Of
    several heads of one key the first counts; rows whose key has no head are passed over.
    """
    mine, theirs = [c for c in heads.columns if c not in keys], [order, *(c for c in rows.columns if c not in (*keys, order))]
    made, n, h = to_arrow_schema(struct(schema)), len(keys), len(mine)
    column = lambda c, place: F.col(c).alias(f"{place}_{c}")
    both = heads.select(*keys, *(column(c, "h") for c in mine)).unionByName(rows.select(*keys, *(column(c, "r") for c in theirs)), allowMissingColumns=True)
    both = both.select(*keys, *(f"h_{c}" for c in mine), *(f"r_{c}" for c in theirs))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for key, own in groupby(every, lambda row: row[:n]):
            first = next(own)
            if first[n + h] is None:  # a head has no place in the order, so it comes first
                yield from step(key, first[n : n + h], (row[n + h :] for row in own if row[n + h] is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batched(told(batches), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), made)], schema=made)

    return both.repartition(*keys).sortWithinPartitions(*keys, F.col(f"r_{order}").asc_nulls_first()).mapInArrow(run, schema)
