"""Property tests (hypothesis): masking parity with Python ``re``, digest invariants, skew."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.functions.template import MASKS, templatize
from logsift.operators import digest as D

# Alphabet biased towards what the masks look at: digits, hex letters, separators,
# Unicode letters / digits next to them, and Python whitespace (incl. U+001C, NBSP).
ALPHABET = st.sampled_from(list("0123456789abcdefABCDEFxX:.-T Z+,/=_") +
                           ["\t", "\n", "\x1c", "\xa0", "　", "é", "ß", "٣", "Ж", "²"])
TOKENS = st.sampled_from(["10.0.0.1", "aa:bb:cc:dd:ee:ff", "2001:db8:0:0:0:0:0:1", "fe80::1",
                          "2025-06-25T10:00:00Z", "2025-06-25 10:00:00", "10:00:00", "0xDEAD",
                          "deadbeefcafe", "123456789012", "eth0", "v2", "3.14", "-7", "ä5"])
PIECE = st.one_of(st.text(ALPHABET, max_size=12), TOKENS)
MESSAGE = st.lists(PIECE, max_size=8).map(lambda parts: " ".join(parts))


def py_templatize(message):
    out = message
    for pattern, repl in MASKS:
        out = re.sub(pattern, repl, out)
    return re.sub(r"\s+", " ", out).strip()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(MESSAGE, min_size=20, max_size=60))
def test_templatize_equals_python_re(spark, messages):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string")
    got = {r["i"]: r["t"] for r in df.select("i", templatize("m").alias("t")).collect()}
    for i, m in enumerate(messages):
        assert got[i] == py_templatize(m), repr(m)


LINE = st.tuples(st.integers(0, 7200), st.sampled_from(["h1", "h2", "", None]),
                 st.one_of(st.none(), st.integers(0, 7)),
                 st.sampled_from(["link up eth0 1", "fail 10.0.0.1", "idle", "x 5", "x 6"]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINE, min_size=1, max_size=80))
def test_digest_invariants(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, t0 + dt.timedelta(seconds=s), h, sev, m) for i, (s, h, sev, m) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, ts timestamp, host string, severity int, message string")
    counts = D.template_counts(df)
    stats = {r["period_start"]: r for r in D.digest_stats(counts).collect()}
    per_hour = {}
    for _, ts, _, sev, _ in data:
        k = ts.replace(minute=0, second=0)
        per_hour.setdefault(k, [0, 0])
        per_hour[k][0] += 1
        per_hour[k][1] += sev is not None and sev <= 4
    assert {k: (v["total_lines"], v["elevated_count"]) for k, v in stats.items()} == \
        {k: tuple(v) for k, v in per_hour.items()}
    sample = D.elevated_sample(df, k=3).collect()
    elevated_ids = {i for i, _, _, sev, _ in data if sev is not None and sev <= 4}
    assert {r["id"] for r in sample} <= elevated_ids
    one = D.build_digests(df.coalesce(1)).orderBy("period_start").collect()
    many = D.build_digests(df.repartition(7)).orderBy("period_start").collect()
    assert [r["digest_text"] for r in one] == [r["digest_text"] for r in many]


def test_hot_key_holds_most_rows(spark):
    """One host and one template carry ~90% of the rows: results stay exact and whole."""
    n = 30000
    df = (spark.range(n).select(
        F.col("id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 3600).alias("ts"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("h"), (F.col("id") % 7).cast("string")))
         .otherwise(F.lit("hot")).alias("host"),
        F.when(F.col("id") % 3 == 0, F.lit(3)).otherwise(F.lit(6)).alias("severity"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("rare "), F.col("id").cast("string"), F.lit("x")))
         .otherwise(F.concat(F.lit("fail "), F.col("id").cast("string"))).alias("message"))
        .repartition(16))
    d = D.build_digests(df, k_templates=5, k_samples=4).collect()
    assert len(d) == 1
    r = d[0]
    assert r["total_lines"] == n
    assert r["top_hosts"][0]["host"] == "hot" and r["top_hosts"][0]["count"] == n - n // 10
    assert r["templates"][0]["template"] == "fail <N>" and r["templates"][0]["count"] == n - n // 10
    assert r["distinct_patterns"] == 1 + n // 10
    assert "4 of 10000" in r["digest_text"]
