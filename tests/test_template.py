"""Golden masking rows and a brute-force check against Python ``re``."""

import re

import pytest
from pyspark.sql import functions as F

from logsift.functions.template import MASKS, templatize

GOLDEN = [
    ("SRC=10.0.0.1 DPT=443", "SRC=<IP> DPT=<N>"),
    ("10.0.0.1:443", "<IP>:<N>"),
    ("1.2.3.4.5", "<IP>.<N>"),
    ("aa:bb:cc:dd:ee:ff", "<MAC>"),
    ("aa:bb:cc:dd:ee:ff:00:11", "<MAC>:<N>:<N>"),
    ("2001:db8:0:0:0:0:0:1", "<IPV6>"),
    ("fe80::1", "fe80::<N>"),
    ("2001:db8::1", "<N>:db8::<N>"),
    ("bad:cafe:dead", "<IPV6>"),
    ("Jun 25 10:00:00", "Jun <N> <IPV6>"),
    ("2025-06-25T10:00:00Z", "<TS>"),
    ("2025-06-25T10:00:00+00:00, x", "<TS> x"),
    ("2025-06-25 10:00:00", "<N>-<N>-<N> <IPV6>"),
    ("2025-06-25 10:00:00.123", "<N>-<N>-<N> <IPV6>.<N>"),
    ("2025-06-25 10:00:00Z", "<TS>"),
    ("0xDEADBEEF deadbeefcafe deadbeef", "<HEX> <HEX> deadbeef"),
    ("123456789012", "<HEX>"),
    ("eth0 up 5s 3.14 -7 v2", "eth0 up 5s <N>.<N> -<N> v2"),
    ("  a \t b ", "a b"),
    ("ä5 5", "ä5 <N>"),
    ("x\x1c\x1dy 7  8", "x y <N> <N>"),
    ("t=٣٤ ok", "t=<N> ok"),
    ("²5 5", "²5 <N>"),                    # "²" (No) is a word character for Python
    ("e\u03015", "e\u0301<N>"),           # a combining mark is not
    ("\U0001d4005 x 5", "\U0001d4005 x <N>"),  # a letter above U+FFFF before a digit
    ("\U0002000012 0x1f\U00020000", "\U0002000012 0x1f\U00020000"),
    ("\U0001f6005", "\U0001f600<N>"),         # no letter
]


def py_templatize(message):
    out = message
    for pattern, repl in MASKS:
        out = re.sub(pattern, repl, out)
    return re.sub(r"\s+", " ", out).strip()


def test_golden(spark):
    df = spark.createDataFrame(list(enumerate(m for m, _ in GOLDEN)), "i int, m string")
    got = {r["i"]: r["t"] for r in df.select("i", templatize("m").alias("t")).collect()}
    for i, (m, want) in enumerate(GOLDEN):
        assert want == py_templatize(m), m
        assert got[i] == want, m


@pytest.mark.parametrize("table,col", [("documents", "text"), ("conversations", "text"),
                                       ("pages", "html")])
def test_whole_texts_match_python_re(spark, table, col):
    """Every row of the sf0.01 text tables, whole texts, against Python re."""
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    rows = df.select(F.col(col).alias("m"), templatize(col).alias("t")).collect()
    assert rows
    bad = [r["m"][:80] for r in rows if r["m"] is not None and r["t"] != py_templatize(r["m"])]
    assert not bad, bad[:3]
