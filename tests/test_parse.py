"""Golden rows for framing and line parsing."""

import pytest

from logsift.functions.parse import decode_utf8, frame_lines, parse_lines

BS = "\\"
CASES = [
    ("<134>Jun 25 10:00:00 gw1 kernel: hello", ("gw1", 16, 6, "kernel: hello")),
    ("<13>Jun  5 01:02:03 h m", ("h", 1, 5, "m")),
    ("<165>1 2025-06-25T10:00:00Z host1 app 123 ID47 - msg", ("host1", 20, 5, "app 123 ID47 - msg")),
    ("<13>1 2025-06-25T10:00:00Z - app - - - m", (None, 1, 5, "app - - - m")),
    ("no header here", (None, None, None, "no header here")),
    ("<13>plain", (None, 1, 5, "plain")),
    ("<14>", None),
    ("  <14>   ", None),
    ("<999>x", (None, 124, 7, "x")),
    ("<1234>x", (None, None, None, "<1234>x")),
    ("<13>jun 25 10:00:00 h m", (None, 1, 5, "jun 25 10:00:00 h m")),
    ("<13>Jun 25 10:00:00 h", (None, 1, 5, "Jun 25 10:00:00 h")),
    ("1 error in module x", ("in", None, None, "module x")),
    ("<14>Jun 25 10:00:00 gw1 CEF:0|V|P|9|400|Threat|9|src=1.2.3.4",
     ("gw1", 1, 2, "CEF:0|V|P|9|400|Threat|9|src=1.2.3.4")),
    ("CEF:0|a|b|c|d|e|5", (None, None, 4, "CEF:0|a|b|c|d|e|5")),
    ("<14>CEF:0|a|b|c|d|e", (None, 1, 6, "CEF:0|a|b|c|d|e")),
    ("<14>CEF:0|a|b|c|d|e|7|", (None, 1, 3, "CEF:0|a|b|c|d|e|7|")),
    ("<14>CEF:0|a|b|c|d|e|6.9|", (None, 1, 4, "CEF:0|a|b|c|d|e|6.9|")),
    ("<14>CEF:0|a|b|c|d|e|3|", (None, 1, 6, "CEF:0|a|b|c|d|e|3|")),
    ("<14>CEF:0|a|b|c|d|e|-1|", (None, 1, 6, "CEF:0|a|b|c|d|e|-1|")),
    ("<14>CEF:0|a|b|c|d|e|10|", (None, 1, 2, "CEF:0|a|b|c|d|e|10|")),
    ("<14>CEF:0|a|b|c|d|e| 8 |", (None, 1, 3, "CEF:0|a|b|c|d|e| 8 |")),
    ("<14>CEF:0|a|b|c|d|e|High|", (None, 1, 6, "CEF:0|a|b|c|d|e|High|")),
    ("<11>CEF:|z CEF:0|a|b|c|d|e|9|x", (None, 1, 3, "CEF:|z CEF:0|a|b|c|d|e|9|x")),
    ("<11>CEF:0|a|b" + BS + "|c|1|2|n|9|", (None, 1, 3, "CEF:0|a|b" + BS + "|c|1|2|n|9|")),
    ("<14>CEF:0|a|b|c|d|e|inf|", (None, 1, 6, "CEF:0|a|b|c|d|e|inf|")),
    ("<14>CEF:0|a|b|c|d|e|1e999|", (None, 1, 6, "CEF:0|a|b|c|d|e|1e999|")),
    ("<14>CEF:0|a|b|c|d|e|9e0|", (None, 1, 2, "CEF:0|a|b|c|d|e|9e0|")),
    ("<14>CEF:0|a|b|c|d|e|5d|", (None, 1, 6, "CEF:0|a|b|c|d|e|5d|")),
    (" <13>Jun 25 10:00:00 h  m 　", ("h", 1, 5, "m")),
    ("<13>Jun 25 10:00:00 h\x1cm", ("h", 1, 5, "m")),
    ("<13>Jun 25 10:00:00 h \x1cm", ("h", 1, 5, "m")),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, raw) for i, (raw, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, raw string")
    out = parse_lines(df, "raw", keep=["id"]).collect()
    return {r["id"]: (r["host"], r["facility"], r["severity"], r["message"]) for r in out}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parse_golden(parsed, i):
    raw, expected = CASES[i]
    assert parsed.get(i) == expected, raw


def test_framing(spark):
    df = spark.createDataFrame([(1, "a\rb\r\nc\n \nd")], "id long, text string")
    out = [r["line"] for r in frame_lines(df, "text", keep=["id"]).orderBy("pos").collect()]
    assert out == ["a", "b", "c", "d"]


def test_lossy_decode(spark):
    cases = [b"ab\xffcd", b"\xe2\x82", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"ok"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(cases)], "id int, b binary")
    got = {r["id"]: r["s"] for r in df.select("id", decode_utf8("b").alias("s")).collect()}
    for i, b in enumerate(cases):
        assert got[i] == b.decode("utf-8", "replace"), b


def test_parse_plan_is_native(spark):
    df = spark.createDataFrame([(1, "<13>x")], "id long, raw string")
    plan = parse_lines(df, "raw", keep=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
