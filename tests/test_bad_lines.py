"""Every case, decoded by itself; and the limits of open data, which the parser meets first when both are the same."""

import pytest

from cairnfold.bad_lines import CASES, LIMITS
from cairnfold.functions.codec import RecordCheck, Rejected, decode_line


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_case(case):
    try:
        got = (decode_line(case.line.replace(b"@", b"12"), LIMITS)[0], None, None, None, None)
    except Rejected as e:
        got = (None, *(e.row[x] for x in ("code", "field", "limit_value", "actual_value")))
    assert got == case[1:]


@pytest.mark.parametrize(
    "value, code, field, actual",
    [
        ({"a": [[[[[[[[1]]]]]]]]}, "json_limit_exceeded", "json_depth", 9),
        ({"a": [[1] * 12] * 5}, "json_limit_exceeded", "json_values", 61),
        ({"a": "x" * 65}, "json_limit_exceeded", "string_bytes", 65),
        ({"a": ["x" * 64] * 8}, "json_limit_exceeded", "total_string_bytes", 513),
        ({"a": [1] * 21}, "too_many_items", "array_items", 21),
        ({str(i): 1 for i in range(13)}, "too_many_items", "object_members", 13),
        ({"a": 2**53}, "unsafe_json_integer", None, None),
    ],
)
def test_open_data(value, code, field, actual):
    with pytest.raises(Rejected) as e:
        RecordCheck(LIMITS).inert(value, 1)
    assert (e.value.code, e.value.row["field"], e.value.row["actual_value"]) == (code, field, actual)
