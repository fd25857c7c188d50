"""Batch consumption: a crash at any step neither loses nor repeats a line."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from logsift.operators import assess as A
from logsift.operators import consume as CO

DAY = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(day, hour=0):
    return DAY + dt.timedelta(days=day, hours=hour)


def buffer(spark, path, sites=("a", "b")):
    rows = [(k, at(d, h), site, "h", 3 if h % 3 == 0 else 6, f"fail {h}") for k, (d, h, site) in enumerate((d, h, s) for d in range(4) for h in range(0, 24, 3) for s in sites)]
    CO.buffer_lines(spark.createDataFrame(rows, "id long, ts timestamp, site string, host string, severity int, message string"), path)
    return rows


@pytest.fixture()
def paths():
    root = tempfile.mkdtemp(prefix="logsift-consume-")
    return f"{root}/buffer", f"{root}/findings", f"{root}/state"


class Lost(Exception):
    pass


@pytest.mark.parametrize("where", ["advanced", "staged", "appended", "committed", "dropped"])
def test_crash_at_any_step(spark, paths, where):
    rows = buffer(spark, paths[0], sites=("a",))

    def stop(name):
        if name == where:
            raise Lost

    CO.consume(spark, *paths, at(0, 12))
    with pytest.raises(Lost):
        CO.consume(spark, *paths, at(2, 1), step=stop)
    # the next run has a later cutoff: what the lost run stored is not evaluated again
    got = CO.consume(spark, *paths, at(9))
    f = spark.read.parquet(paths[1]).select("log_count", "period_start", "ts").collect()
    assert sum(r.log_count for r in f) == len(rows)
    assert len(f) == (2 if where == "advanced" else 3)
    assert got["finished_earlier"] == (where in ("staged", "appended"))
    periods = sorted((r.period_start, r.ts) for r in f)
    assert all(a[1] < b[0] for a, b in zip(periods, periods[1:], strict=False))
    assert CO.consume(spark, *paths, at(9)) == {"findings": 0, "finished_earlier": False}


def test_days_behind_the_mark_go(spark, paths):
    buffer(spark, paths[0], sites=("a",))
    CO.consume(spark, *paths, at(2, 9))
    days = sorted(x for x in os.listdir(paths[0]) if x.startswith("log_date="))
    assert days == ["log_date=2024-03-03", "log_date=2024-03-04"]
    left = CO.unconsumed(spark.read.parquet(paths[0]), CO.marks(spark, paths[2]))
    assert left.agg(F.min("ts")).first()[0].hour == 12 and left.count() == 4 + 8
    plan = left._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "GreaterThan(ts" in plan


def fails_on(bad):
    """A client that is down while a digest has ``bad`` lines (a local class, which tasks get by value)."""
    class FailsOn(A.ElevatedCountAssessor):
        def assess(self, digest_text, stats):
            if stats["total_lines"] == bad:
                raise RuntimeError("down")
            return super().assess(digest_text, stats)
    return FailsOn


def test_failed_source_keeps_its_lines(spark, paths):
    rows = buffer(spark, paths[0], sites=("a", "b", None))
    extra = spark.createDataFrame([(1000, at(0, 1), "b", "h", 6, "more")], "id long, ts timestamp, site string, host string, severity int, message string")
    CO.buffer_lines(extra, paths[0])
    got = CO.consume(spark, *paths, at(1, 12), ["site"], CO.by_plugin(fails_on(14)))  # b has 14 lines, the others 13
    assert got["findings"] == 2
    known = {r.site: r.until for r in CO.marks(spark, paths[2]).collect()}
    assert set(known) == {"a", None}
    assert len([x for x in os.listdir(paths[0]) if x.startswith("log_date=")]) == 4  # b needs the first day
    CO.consume(spark, *paths, at(9), ["site"], CO.by_plugin(fails_on(0)))
    f = spark.read.parquet(paths[1]).groupBy("site").agg(F.sum("log_count").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    assert {r.site: (r.n, r.k) for r in f} == {"a": (32, 2), None: (32, 2), "b": (33, 1)} and len(rows) == 96


def test_failed_single_source_and_empty_buffer(spark, paths):
    buffer(spark, paths[0], sites=("a",))
    assert CO.consume(spark, *paths, at(0, -1)) == {"findings": 0, "finished_earlier": False}
    assert CO.consume(spark, *paths, at(9), evaluate=CO.by_plugin(fails_on(32)))["findings"] == 0
    assert CO.unconsumed(spark.read.parquet(paths[0]), CO.marks(spark, paths[2])).count() == 32
    assert CO.consume(spark, *paths, at(9))["findings"] == 1


def test_bounds_keep_lines_where_they_are(spark):
    """Bounds of few sources are joined without shuffling the lines, which would give each source one task."""
    lines = spark.range(0, 1000, 1, 6).select("id", (F.col("id") % 2).cast("int").alias("site"), F.timestamp_seconds(F.col("id")).alias("ts"))
    out = CO.with_bounds(lines, ["site"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and out.rdd.getNumPartitions() == 6
    assert {(r.site, r.a, r.b, r.n) for r in out.groupBy("site").agg(F.unix_seconds(F.min("period_start")).alias("a"), F.unix_seconds(F.max("period_end")).alias("b"), F.count("*").alias("n")).collect()} == {(0, 0, 998, 500), (1, 1, 999, 500)}
