"""Plan shape: pushdown, pruning, bounded top-k, no Python in the hot path."""

import datetime as dt

from logsift.functions.parse import parse_lines
from logsift.operators import digest as D
from logsift.sources.tables import materialize

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def _lines(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), f"h{i % 3}", i % 8, f"msg {i} from 10.0.0.{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, host string, severity int, message string")
    return materialize(df, "plan_test_lines")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_elevated_sample_pushes_severity_and_limits_per_task(spark):
    plan = _plan(D.elevated_sample(_lines(spark), k=3))
    assert "LessThanOrEqual(severity,4)" in plan and "IsNotNull(severity)" in plan
    assert plan.count("WindowGroupLimit") >= 2  # partial (before exchange) and final


def test_host_counts_prune_columns(spark):
    plan = _plan(D.host_counts(D.with_period(_lines(spark))))
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "message" not in scan and "severity" not in scan


def test_template_counts_single_scan_and_hash_aggregate(spark):
    plan = _plan(D.template_counts(D.with_period(_lines(spark))))
    assert plan.count("FileScan parquet") == 1
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_digest_has_no_python_and_no_cross_join(spark):
    plan = _plan(D.build_digests(_lines(spark)))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_parse_is_one_narrow_stage(spark):
    df = spark.createDataFrame([(1, "<13>Jun 25 10:00:00 h m")], "id long, raw string")
    plan = _plan(parse_lines(df, "raw", keep=["id"]))
    assert "Exchange" not in plan and "Python" not in plan


def test_logs_until_prunes_partitions(spark):
    from logsift.operators import findings as FS
    rows = [(i, T0 + dt.timedelta(days=i), "h", 3, "m") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, host string, severity int, message string")
    stored = materialize(FS.with_log_date(df), "plan_test_partitioned", partition_by=["log_date"])
    out = FS.logs_until(stored, "2024-01-02 12:00:00")
    plan = _plan(out)
    assert "PartitionFilters: [isnotnull(log_date" in plan and "LessThanOrEqual(ts," in plan
    assert sorted(r["id"] for r in out.collect()) == [0, 1]
    between = FS.lines_between(stored, "2024-01-03 00:00:00", "2024-01-04 00:00:00")
    assert [r["id"] for r in between.collect()] == [2]
    assert "PartitionFilters" in _plan(between)
