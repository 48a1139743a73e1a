import io

import pytest

from cairnfold.limits import Limits
from cairnfold.sources.jsonl import JsonlSource, decode, from_memory, read_lines, scan, traces, write_canonical

from .test_codec import HEADER, STORE, STREAM, envelope
import json

L = Limits()


def lines(data, **limits):
    return [(r["payload"], r["error"] and r["error"]["code"], r["start_byte"], r["end_byte"]) for r in scan(io.BytesIO(data), L.but(**limits))]


def test_framing():
    assert lines(b"") == []
    assert [x[0] for x in lines(b"a\nb\r\n\nc\rd")] == [b"a", b"b", b"", b"c\rd"]
    assert lines(b"a\r\nb") == [(b"a", None, 0, 3), (b"b", None, 3, 4)]


def test_ceilings():
    assert [x[:2] for x in lines(b"abc\r\nabcd\nx", max_line_bytes=3)] == [(b"abc", None), (None, "line_too_long")]
    assert [x[:2] for x in lines(b"a\nb\n", max_records_per_trace=2)] == [(b"a", None), (b"b", None)]
    assert [x[1] for x in lines(b"a\nb\nc", max_records_per_trace=2)] == [None, None, "record_limit"]
    assert [x[1] for x in lines(b"a\nb\n", max_trace_bytes=4)] == [None, None]
    assert [x[1] for x in lines(b"a\nb\n", max_trace_bytes=3)] == [None, "trace_bytes"]
    assert [x[1] for x in lines(b"abcdef", max_trace_bytes=4, max_line_bytes=2)] == ["line_too_long"]
    assert [x[1] for x in lines(b"abcdef", max_trace_bytes=2, max_line_bytes=4)] == ["trace_bytes"]


@pytest.fixture
def trace_file(tmp_path):
    rows = [HEADER, STREAM, envelope(STORE), {"kind": "nonsense"}]
    (tmp_path / "one.jsonl").write_bytes(b"\r\n".join(json.dumps(r).encode() for r in rows))
    return tmp_path


def test_read_decode_write(spark, trace_file, tmp_path_factory):
    got = decode(read_lines(spark, str(trace_file / "*.jsonl"))).orderBy("record_no").collect()
    assert [r.kind for r in got] == ["trace_header", "stream", "envelope", None] and got[3].error.code == "schema"
    assert got[2].envelope.mutations[0].hashes[0].u64 == 7 and got[2].trace == "one"
    out = str(tmp_path_factory.mktemp("out") / "canonical")
    write_canonical(decode(read_lines(spark, str(trace_file / "*.jsonl"))), out)
    assert [r.value for r in spark.read.text(out).orderBy("value").collect()] == sorted(r.canonical_line for r in got[:3])
    spark.dataSource.register(JsonlSource)
    again = spark.read.format("cairnfold_jsonl").load(str(trace_file)).orderBy("record_no").collect()
    assert [bytes(r.payload) for r in again] == [bytes(r.payload) for r in read_lines(spark, str(trace_file / "*.jsonl")).orderBy("record_no").collect()]
    assert [r.kind for r in from_memory(spark, "m", [json.dumps(HEADER).encode()]).collect()] == ["trace_header"]


def test_files_over_the_ceiling_are_read_line_by_line(spark, tmp_path):
    """The same rows as scan() gives, for files that no ceiling lets through; and the names of empty files."""
    texts = {
        "short": b"a\nb\n", "empty": b"", "long": b"abc\r\nabcd\nx\n" * 9, "wide": b"abcdefghijklmnopqrstuvwxyz" * 4, "crlf": b"ab\r\n" * 12,
        "edge": b"abcdefgh\n" * 5 + b"x", "late": b"\n" * 45, "cr": b"a\rb\n" * 20, "open": b"aaaaaaaaaa\n" * 3 + b"aaaaaaaaa\r",
    }
    for name, data in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(data)
    for limits in (L.but(max_trace_bytes=40), L.but(max_trace_bytes=40, max_line_bytes=9), L.but(max_trace_bytes=40, max_line_bytes=8), L.but(max_trace_bytes=41, max_line_bytes=3), L.but(max_trace_bytes=40, max_records_per_trace=4)):
        plain = lambda r: (r["record_no"], r["line_no"], None if r["payload"] is None else bytes(r["payload"]), r["start_byte"], r["end_byte"], None if r["error"] is None else tuple(r["error"].values()))
        want = sorted((n, *plain(r)) for n, d in texts.items() for r in scan(io.BytesIO(d), limits))
        rows = [r.asDict(recursive=True) for r in read_lines(spark, str(tmp_path), limits).collect()]
        assert sorted((r["trace"], *plain(r)) for r in rows) == want
    assert {r.trace for r in traces(spark, str(tmp_path)).collect()} == set(texts)
