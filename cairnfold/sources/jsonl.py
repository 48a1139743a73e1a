"""Bounded JSON Lines: a trace is a file, a record is a line, and every failure is a row.

read_lines() goes through Spark's own readers, so it opens whatever store Spark can. Files within max_trace_bytes are
scanned from memory, which that ceiling bounds; larger ones, which must fail, are read line by line, however large they
are, until they do. JsonlSource is the same scan as a Python data source for files that Python can open.
"""

from __future__ import annotations

import glob
import io
import json
import os
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codec import Rejected, decode_line
from ..limits import Limits
from ..schema import ERROR, LINES, RECORDS, struct


def scan(stream: BinaryIO, limits: Limits) -> Iterator[dict]:
    """The lines of a stream with 1-based numbers and byte ranges; after the first failure, one row that says so, and no more.

    LF or CRLF ends a line, the last may lack it; a lone CR is payload. Line bytes don't count the terminator, trace
    bytes do. A record beyond the last allowed one fails only if a byte of it exists.
    """
    number = at = 0
    while True:
        if number >= limits.max_records_per_trace:
            if stream.read(1):
                yield _failed(number, at, "record_limit", "records", limits.max_records_per_trace, number + 1)
            return
        room = limits.max_trace_bytes - at
        line = stream.readline(min(limits.max_line_bytes + 2, room + 1))
        if not line:
            return
        ended = line.endswith(b"\n")
        size = len(line) - (2 if line.endswith(b"\r\n") else 1 if ended else 0)
        # of two ceilings, the one that an earlier byte meets counts
        if len(line) > room and room <= limits.max_line_bytes + (len(line) - size):
            yield _failed(number, at, "trace_bytes", "trace_bytes", limits.max_trace_bytes, limits.max_trace_bytes + 1)
            return
        if size > limits.max_line_bytes:
            yield _failed(number, at, "line_too_long", "line_bytes", limits.max_line_bytes, limits.max_line_bytes + 1)
            return
        yield {"record_no": number, "line_no": number + 1, "payload": line[:size], "start_byte": at, "end_byte": at + len(line), "error": None}
        at += len(line)
        number += 1


def _failed(number: int, at: int, code: str, field: str, limit: int, actual: int) -> dict:
    return {"record_no": number, "line_no": number + 1, "payload": None, "start_byte": at, "end_byte": at, "error": Rejected(code, field, limit, actual, layer="reader").row}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def trace_name(path: str) -> str:
    """A trace is named by its file, or by the folder that write_canonical made for it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    parent = os.path.basename(folder)
    return parent.removeprefix("trace=") if parent.startswith("trace=") else name.removesuffix(".jsonl")


def _named(path: Column) -> Column:
    """trace_name() as an expression."""
    steps = F.split(path, "/")
    folder, name = F.element_at(steps, -2), F.element_at(steps, -1)
    return F.when(folder.startswith("trace="), F.substring(folder, 7, 10_000)).otherwise(F.regexp_replace(name, r"\.jsonl$", ""))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """The traces (trace) under a path, also those whose file is empty: scans pass over empty files, the listing that Spark's driver has anyway names them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(_named(F.col("path")).alias("trace")).distinct()


def _small(limits: Limits):
    schema = to_arrow_schema(struct(LINES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for row in scan(io.BytesIO(content.as_py()), limits):
                    rows.append({"trace": trace_name(name.as_py())} | row)
                    if len(rows) == 4096:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return run


def _large(lines: DataFrame, limits: Limits) -> DataFrame:
    """scan() of files over the ceiling, from their lines (path, block, size, value): up to the first failure, which there is."""
    order = Window.partitionBy("path").orderBy("block", "place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("place", F.monotonically_increasing_id()).where(F.col("block") <= limits.max_trace_bytes)
    rows = rows.withColumn("end_byte", F.least(F.sum(F.octet_length("value").cast("long") + 1).over(upto), F.col("size")))
    rows = rows.withColumn("record_no", F.row_number().over(order).cast("long") - 1).withColumn("start_byte", F.coalesce(F.lag("end_byte").over(order), F.lit(0).cast("long")))
    full, room, longest = F.col("end_byte") - F.col("start_byte"), F.lit(limits.max_trace_bytes) - F.col("start_byte"), limits.max_line_bytes
    read = F.least(full, F.lit(longest + 2), room + 1)
    ends = F.when(F.substring("value", -1, 1) == F.lit(b"\r"), 2).otherwise(1)
    term = F.when(read == full, full - F.octet_length("value") + ends - 1).otherwise(0)
    number = F.col("record_no")
    error = lambda code, limit, actual: F.struct(F.lit("reader").alias("layer"), F.lit(code[0]).alias("code"), F.lit(code[1]).alias("field"), F.lit(limit).cast("decimal(20,0)").alias("limit_value"), actual.cast("decimal(20,0)").alias("actual_value"))
    failed = (
        F.when(number >= limits.max_records_per_trace, error(("record_limit", "records"), limits.max_records_per_trace, number + 1))
        .when((read > room) & (room <= longest + term), error(("trace_bytes", "trace_bytes"), limits.max_trace_bytes, F.lit(limits.max_trace_bytes + 1)))
        .when(read - term > longest, error(("line_too_long", "line_bytes"), longest, F.lit(longest + 1)))
    )
    rows = rows.withColumn("error", failed).withColumn("stop", F.min(F.when(F.col("error").isNotNull(), number)).over(Window.partitionBy("path"))).where("record_no <= stop")
    bad = F.col("error").isNotNull()
    payload = F.when(~bad, F.expr("substring(value, 1, octet_length(value) - CASE WHEN substring(value, -1, 1) = X'0D' THEN 1 ELSE 0 END)"))
    return rows.select(_named(F.col("path")).alias("trace"), "record_no", (number + 1).alias("line_no"), payload.alias("payload"), "start_byte", F.when(bad, F.col("start_byte")).otherwise(F.col("end_byte")).alias("end_byte"), F.col("error").cast(ERROR).alias("error"))


def read_lines(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """The lines of every file under a path: one row per line, and one for each file that ends in a failure. An empty file has no row (see traces)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= limits.max_trace_bytes).select("path", "content").mapInArrow(_small(limits), LINES)
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    return small.unionByName(_large(lines.where(F.col("size") > limits.max_trace_bytes), limits))


class JsonlSource(DataSource):
    """spark.read.format("cairnfold_jsonl").option("limits", json).load(path): the lines of local or shared files."""

    @classmethod
    def name(cls) -> str:
        return "cairnfold_jsonl"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.limits = Limits(**json.loads(options.get("limits", "{}")))

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.jsonl")) if os.path.isdir(path) else glob.glob(path))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            for row in scan(f, self.limits):
                e = row["error"]
                error = None if e is None else (e["layer"], e["code"], e["field"], e["limit_value"], e["actual_value"])
                yield (trace_name(partition.value), row["record_no"], row["line_no"], row["payload"], row["start_byte"], row["end_byte"], error)


_BODY = {"trace_header": "header", "stream": "stream", "envelope": "envelope", "fault_schedule": "schedule"}


def decode(lines: DataFrame, limits: Limits = Limits(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Records from lines: typed columns by kind, the canonical line, or an error. A line that failed to be read keeps its error.

    What carry names comes along as `carried`, so that nobody has to join a record with what it was made of.
    """
    limits = limits.checked()
    schema = to_arrow_schema(struct(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for trace, number, line_no, payload, error in zip(*(batch.column(i).to_pylist() for i in range(5))):
                row = {"trace": trace, "record_no": number, "line_no": line_no, "kind": None, "header": None, "stream": None, "envelope": None, "schedule": None, "canonical_line": None, "error": error}
                if error is None:
                    try:
                        kind, body, text = decode_line(payload, limits)
                        row |= {"kind": kind, _BODY[kind]: body, "canonical_line": text}
                    except Rejected as e:
                        row["error"] = e.row
                out.append(row)
            made = _batch(out, schema)
            yield pa.RecordBatch.from_arrays([*made.columns, batch.column(5)], [*made.schema.names, "carried"]) if carry else made

    told = lines.select("trace", "record_no", "line_no", "payload", "error", *([F.struct(*carry).alias("carried")] if carry else []))
    return told.mapInArrow(run, struct(RECORDS).add(told.schema["carried"]) if carry else RECORDS)


def write_canonical(records: DataFrame, path: str) -> None:
    """Canonical lines, one LF each, in record order within each trace; a folder per trace."""
    rows = records.where("error is null").select("trace", "record_no", F.col("canonical_line").alias("value"))
    rows.repartition("trace").sortWithinPartitions("trace", "record_no").select("trace", "value").write.partitionBy("trace").text(path)


def from_memory(spark: SparkSession, trace: str, lines: list[bytes], limits: Limits = Limits()) -> DataFrame:
    """Decoded records of a trace that is in the driver's memory."""
    rows = [(trace,) + tuple(r.values())[:5] + (None if r["error"] is None else tuple(r["error"].values()),) for r in scan(io.BytesIO(b"\n".join(lines) + b"\n"), limits)]
    return decode(spark.createDataFrame(rows, LINES), limits)
