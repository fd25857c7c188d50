"""Golden digest (FIXTURES §7), caps, tie order, multi-site keys, plan shape."""

import datetime as dt

from pyspark.sql import functions as F

from logsift.operators import digest as D

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
ROWS = [
    (1, T0 + dt.timedelta(seconds=1), "h1", 6, "link up eth0 1"),
    (2, T0 + dt.timedelta(seconds=2), "h1", 3, "fail 10.0.0.1"),
    (3, T0 + dt.timedelta(seconds=3), None, None, "link up eth0 2"),
    (4, T0 + dt.timedelta(seconds=4), "h2", 4, "fail 10.0.0.2"),
    (5, T0 + dt.timedelta(seconds=5), "", 7, "idle"),
]
SCHEMA = "id long, ts timestamp, host string, severity int, message string"
GOLDEN = """Total syslog lines this period: 5
Distinct message patterns: 3
Source hosts: h1 (2), h2 (1)

=== Top message patterns (pattern × count; volatile values masked) ===
[     2×] link up eth0 <N>
[     2×] fail <IP>

=== Elevated-severity sample (warning or worse), 2 of 2 ===
(err) h1: fail 10.0.0.1
(warning) h2: fail 10.0.0.2"""


def test_golden_digest(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = D.build_digests(df, k_templates=2).collect()
    assert len(r) == 1
    assert r[0]["digest_text"] == GOLDEN
    assert (r[0]["total_lines"], r[0]["distinct_patterns"], r[0]["elevated_count"]) == (5, 3, 2)
    assert [(h["host"], h["count"]) for h in r[0]["top_hosts"]] == [("h1", 2), ("h2", 1)]


def test_tie_order_is_first_sighting_not_alphabetical(spark):
    rows = [(1, T0, "h", 6, "zeta"), (2, T0 + dt.timedelta(seconds=1), "h", 6, "alpha"),
            (3, T0 + dt.timedelta(seconds=2), "h", 6, "zeta"), (4, T0 + dt.timedelta(seconds=3), "h", 6, "alpha")]
    top = D.top_templates(D.template_counts(spark.createDataFrame(rows, SCHEMA)), k=1).collect()
    assert [t["template"] for t in top] == ["zeta"]


def test_tie_on_ts_broken_by_id(spark):
    rows = [(9, T0, "h", 6, "b"), (3, T0, "h", 6, "a")]
    top = D.top_templates(D.template_counts(spark.createDataFrame(rows, SCHEMA)), k=1).collect()
    assert top[0]["template"] == "a" and top[0]["first_id"] == 3


def test_truncation_marker_after_cut(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    text = D.build_digests(df, k_templates=2, max_chars=10).collect()[0]["digest_text"]
    assert text == GOLDEN[:10] + "\n…[digest truncated]"


def test_sample_cap_and_count(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), "h", 3, f"boom {i}") for i in range(10)]
    r = D.build_digests(spark.createDataFrame(rows, SCHEMA), k_samples=3).collect()[0]
    assert "3 of 10" in r["digest_text"]
    assert r["digest_text"].endswith("(err) h: boom 2")


def test_no_hosts_line_when_no_host(spark):
    rows = [(1, T0, None, 6, "x"), (2, T0, "", 6, "y")]
    r = D.build_digests(spark.createDataFrame(rows, SCHEMA)).collect()[0]
    assert "Source hosts" not in r["digest_text"]
    assert "0 of 0 ===" in r["digest_text"]


def test_sites_are_independent(spark):
    a = spark.createDataFrame(ROWS, SCHEMA).withColumn("site", F.lit("a"))
    b = spark.createDataFrame(ROWS[:2], SCHEMA).withColumn("site", F.lit("b"))
    r = {x["site"]: x for x in D.build_digests(a.unionByName(b), keys=["site"], k_templates=2).collect()}
    assert r["a"]["digest_text"] == GOLDEN
    assert r["b"]["total_lines"] == 2


def test_invariant_to_partitioning(spark):
    df = spark.createDataFrame(ROWS * 1, SCHEMA)
    one = D.build_digests(df.coalesce(1), k_templates=2).collect()[0]["digest_text"]
    many = D.build_digests(df.repartition(5), k_templates=2).collect()[0]["digest_text"]
    assert one == many == GOLDEN


def test_plan_hash_aggregate_and_group_limit(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    counts = D.template_counts(df)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    top = D.top_templates(counts, k=2)
    top._jdf.queryExecution().executedPlan()  # force planning
    optimized = top._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in optimized
    assert "Python" not in D.build_digests(df)._jdf.queryExecution().executedPlan().toString()


def test_periods_that_do_not_divide_a_day(spark):
    """Hours start anew at midnight; minutes that don't divide an hour are plain intervals from a start."""
    import datetime as dt
    at = [dt.datetime(2024, 1, 2, 0, 3), dt.datetime(2024, 1, 2, 4, 59), dt.datetime(2024, 1, 2, 23, 58)]
    df = spark.createDataFrame([(i, t, "h", 3, "m") for i, t in enumerate(at)], "id long, ts timestamp, host string, severity int, message string")
    hours = [(r["period_start"].hour, r["period_end"].hour) for r in D.with_period(df, "5 hours").orderBy("id").collect()]
    assert hours == [(0, 5), (0, 5), (20, 0)]
    for m, start in ((7, None), (45, None), (50, dt.datetime(2024, 1, 2, 3, 1)), (90, dt.datetime(2024, 1, 1))):
        origin, step = start or dt.datetime(1970, 1, 1), dt.timedelta(minutes=m)
        got = [(r["period_start"], r["period_end"]) for r in D.with_period(df, f"{m} minutes", start=start).orderBy("id").collect()]
        want = [origin + (t - origin) // step * step for t in at]
        assert got == [(w, w + step) for w in want]
    local = [r["period_start"] for r in D.with_period(df, "5 hours", "America/Chicago").orderBy("id").collect()]
    assert local[0] == dt.datetime(2024, 1, 1, 21)  # 15:00 in Chicago



def test_periods_align_to_local_clock(spark):
    # Asia/Kolkata is UTC+05:30: hourly periods start at hh:30 UTC (local :00).
    rows = [(1, dt.datetime(2024, 1, 1, 4, 40), "h", 6, "x"), (2, dt.datetime(2024, 1, 1, 5, 20), "h", 6, "y"),
            (3, dt.datetime(2024, 1, 1, 5, 35), "h", 6, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r["period_start"]), str(r["period_end"]), r["total_lines"])
                 for r in D.build_digests(df, tz="Asia/Kolkata").collect())
    assert got == [("2024-01-01 04:30:00", "2024-01-01 05:30:00", 2), ("2024-01-01 05:30:00", "2024-01-01 06:30:00", 1)]
