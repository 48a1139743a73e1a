"""WARC archives as a chunked record table: payloads are written and read in segments, digests are carried over chunks.

Each row that Spark's text writer gets is one WARC record of bounded size (an oversized payload becomes a first record
and continuation records, as the format has it) and the line separator is the blank line that ends records, so the
writer's own commit protocol covers archives: a lost executor's files are never seen, and any store Spark writes to
will do. Spark's text reader gives the archives back in pieces between blank lines, as it unpacks them; a piece is no
longer than a segment, and pieces joined by the separator are the archive's bytes again. Reading gives a table of
(record, chunk number, bytes); neither writing nor reading ever assembles a whole payload or a whole archive. An archive
is one gzip member: that is how Spark writes compressed text.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, drop, save, scratch_path, split

#: Bytes of payload in one segment at most.
SEGMENT = 1 << 18
#: Bytes of an archive, uncompressed, about.
ARCHIVE = 32 << 20
#: Bytes of chunks that go to Spark in one batch, about.
BATCH = 8 << 20
_NAMESPACE = uuid.UUID("5b0f0f0e-6d1c-4f3a-9a53-0d6f8a1f7c11")
_CHUNKS = "row long, chunk int, last boolean, page_id long, record_type string, refers_to long, stated_bytes long, stated_digest string, data binary"


def record_uri(page: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page {page}' if page is not None else f'row {row}')}>"


def _segments(data: memoryview, size: int) -> Iterator[bytes]:
    """Pieces of at most `size` bytes that cut no character; one empty piece of nothing."""
    at = 0
    while True:
        end = min(at + size, len(data))
        while at < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield bytes(data[at:end])
        at = end
        if at >= len(data):
            return


_LINES = "archive int, place long, record binary"


def _records(segment: int, archive: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, place, written, number = TaskContext.get().partitionId() << 40, 0, 0, 0
        out: list[tuple] = []
        pending = 0

        def lines() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], ["archive", "place", "record"])

        for batch in batches:
            for page, url, sha1, response, html in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                data = memoryview(html.as_buffer() or b"")
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                revisit = response is not None and page != response
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
                at = n = 0
                for piece in [b""] if revisit else _segments(data, segment):
                    at += len(piece)
                    last = revisit or at == len(data)
                    head = [
                        "WARC/1.1",
                        f"WARC-Type: {'revisit' if revisit else 'response' if n == 0 else 'continuation'}",
                        f"WARC-Record-ID: {record_uri(page, row) if n == 0 else record_uri(None, (row << 20) + n)}",
                        f"WARC-Target-URI: {target}",
                        f"WARC-Date: {date}",
                        f"WARC-Row: {row}",
                    ]
                    if page is not None:
                        head.append(f"WARC-Page: {page}")
                    if n == 0:
                        head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
                    if revisit:
                        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(response, 0)}", f"WARC-Refers-To-Page: {response}"]
                    if n or not last:
                        head.append(f"WARC-Segment-Number: {n + 1}")
                        if n:
                            head.append(f"WARC-Segment-Origin-ID: {record_uri(page, row)}")
                        if last:
                            head.append(f"WARC-Segment-Total-Length: {len(http) + len(data)}")
                    block = (http if n == 0 else b"") + piece
                    head.append(f"Content-Length: {len(block)}")
                    out.append((number, place, "\r\n".join(head).encode() + b"\r\n\r\n" + block))
                    written, pending, place, n = written + len(out[-1][2]), pending + len(out[-1][2]), place + 1, n + 1
                    if pending > BATCH:
                        yield lines()
                        out, pending = [], 0
                if written > archive:
                    written, number = 0, number + 1
                row += 1
        if out:
            yield lines()

    return run


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, archive: int = ARCHIVE, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each page, payload the html in UTF-8; of equal payloads (by SHA-256) the largest id's is the response.

    Null html is the empty payload. A null id is never a response that others revisit; it revisits the one there is.
    Pages that repeat an id and a payload are responses all. A hot payload is counted with partial aggregates, and
    its rows are dealt by the skew join; payloads that occur once (a bitmap tells, in 8 MB) are written where they are.
    An oversized payload's records stand one after the other in one archive. An empty table gives no archive.
    """
    own = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.unhex(F.sha2("html", 256)))
    roles = own.groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("sha", "response")
    roles = save(roles, "roles")
    bits = bitmap(roles.select(F.xxhash64("sha")))
    maybe, surely = split(own, F.xxhash64("sha"), bits)
    rows = maybe.join(roles, "sha", "left").unionByName(surely.withColumn("response", F.lit(None).cast("long")))
    lines = rows.select("page_id", "url", F.sha1("html").alias("sha1"), "response", "html").mapInArrow(_records(segment, archive, date), _LINES)
    ordered = lines.sortWithinPartitions("archive", "place").select("archive", F.col("record").cast("string").alias("value"))
    ordered.write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    drop(roles, bits)


class _Stream:
    """The bytes of pieces that stood between blank lines; a piece is asked for when its bytes are."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.have = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.have += piece
            self.have += b"\r\n\r\n"
        return piece is not None

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while True:
            i = self.have.find(mark, seen)
            if i >= 0:
                out = bytes(self.have[:i])
                del self.have[: i + len(mark)]
                return out
            seen = max(0, len(self.have) - len(mark))
            if not self._more():
                return None

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self._more():
            pass
        if len(self.have) < n:
            raise ValueError("an archive is cut off")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    stream, rows, pending = _Stream(x.as_py() for batch in batches for x in batch.column(0)), [], 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().lstrip("\r\n").split("\r\n")[1:])
        block = stream.take(int(fields["Content-Length"]))
        stream.take(4)
        kind, number = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1)) - 1
        stated = None
        if kind != "continuation":
            http, _, block = block.partition(b"\r\n\r\n")
            stated = int(http.rpartition(b"Content-Length: ")[2])
        page, refers = fields.get("WARC-Page"), fields.get("WARC-Refers-To-Page")
        last = "WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields
        rows.append((int(fields["WARC-Row"]), number, last, page and int(page), None if kind == "continuation" else kind, refers and int(refers), stated, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, block))
        pending += len(block) + 200
        if pending > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows, pending = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives under a path as a table of chunks: a record's row number, chunk number, what its header says, and bytes.

    Within a partition the chunks of a record follow one another in order.
    """
    pieces = spark.read.option("lineSep", "\r\n\r\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt.gz").text(path)
    return pieces.select(F.col("value").cast("binary")).mapInArrow(_parsed, _CHUNKS)


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from chunks in order; size and digest are carried from chunk to chunk, and over batches."""
    row, state, size, first = None, None, 0, None
    for batch in batches:
        out = []
        for r, _, last, page, kind, refers, stated, digest, data in zip(*(batch.column(i) for i in range(9))):
            if r.as_py() != row:
                row, state, size, first = r.as_py(), hashlib.sha1(), 0, None
            if kind.is_valid:
                first = (page.as_py(), kind.as_py(), refers.as_py(), stated.as_py(), digest.as_py())
            piece = data.as_buffer()
            state.update(piece)
            size += len(piece)
            if last.as_py():
                page_id, type_, refers_to, bytes_, digest_ = first
                whole = base64.b32encode(state.digest()).decode()
                revisit = type_ == "revisit"
                out.append((page_id, bytes_ if revisit else size, digest_ if revisit else whole, type_, refers_to, revisit or (whole == digest_ and size == bytes_)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], [x.split()[0] for x in _RECORD.split(", ")])


def read_records(chunks: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per record: (page_id, payload_bytes, payload_digest, record_type, refers_to, intact).

    Size and digest of a response are those of its chunks, carried from one to the next; a revisit's are stated.
    Chunks as read_chunks() gives them are in order; others (ordered=False) are dealt by record and sorted first.
    intact tells whether a response's bytes have the stated size and digest.
    """
    if not ordered:
        chunks = chunks.repartition("row").sortWithinPartitions("row", "chunk")
    return chunks.mapInArrow(_digested, _RECORD)


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Write pages to archives (under the shared scratch folder unless a path is given) and read the records back: one row per row of pages.

    A payload whose bytes are not the stated ones ends the job. Null html is the empty payload, a null id a record
    without one, repeated rows are records each; payloads of any length pass in segments. An empty table gives an empty
    table; columns besides id, url and html are not looked at.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, id, url, html, segment)
    out = read_records(read_chunks(spark, path))
    lost = F.raise_error(F.concat(F.lit("the payload has changed of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))).cast("string")
    return out.withColumn("payload_digest", F.when(F.col("intact"), F.col("payload_digest")).otherwise(lost)).withColumnRenamed("page_id", id)
