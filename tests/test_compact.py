"""Compaction of continuous counts: same counts, few files, safe against replays."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from logsift.operators import digest as D
from logsift.streaming import compact as K
from logsift.streaming import ingest as I

DAY = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, ts timestamp, host string, severity int, message string"


def batch(spark, path, n, source="s"):
    rows = [(n * 10 + i, DAY + dt.timedelta(hours=(n * 3 + i * 7) % 72), "h", 3 + i % 4, f"m {'abc'[i % 3]}") for i in range(10)]
    lines = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    (D.template_counts(lines).withColumn("source_id", F.lit(source)).withColumn("batch_id", F.lit(n).cast("long")).coalesce(1)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "batch_id").parquet(path))
    return rows


def state(spark, path):
    return sorted(map(str, K.counts(spark, path).collect()))


def files(root):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(root) for f in names)


def test_merges_keep_the_counts(spark):
    root = tempfile.mkdtemp(prefix="logsift-compact-")
    path, rows = f"{root}/counts", []
    for n in range(12):
        rows += batch(spark, path, n)
        rows += batch(spark, path, n, "other") if n % 2 else []
        if n % 3 == 2:
            before = state(spark, path)
            assert K.compact(spark, path) > 0
            assert state(spark, path) == before
    want = D.template_counts(spark.createDataFrame(rows, SCHEMA))
    assert {(str(r.period_start), r.template, r["count"], r.elevated) for r in K.counts(spark, path).collect()} == {
        (str(r.period_start), r.template, r["count"], r.elevated) for r in want.collect()}
    assert files(root) <= 3 + 2 + 2 + 2  # days, manifests, last batches of two sources
    assert K.compact(spark, path) == 0
    # a merged batch that comes again, and a merge that is lost before its manifest
    before = state(spark, path)
    batch(spark, path, 4)
    assert state(spark, path) == before
    rows = batch(spark, path, 12)
    before = state(spark, path)
    n, _, _ = K._manifest(spark, f"{path}-merged")
    spark.createDataFrame([("x",)], "x string").write.parquet(f"{path}-merged/m={n + 1}/day=2024-03-01")
    assert state(spark, path) == before
    assert K.compact(spark, path) >= 1 and state(spark, path) == before


def test_stream_with_compaction(spark):
    root = tempfile.mkdtemp(prefix="logsift-compact-")
    rows = []
    for n in range(8):
        part = [(n * 5 + i, DAY + dt.timedelta(hours=n * 2 + i), "h", 3, f"m {i}") for i in range(5)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        rows += part
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    I.run_continuous_counts(stream, f"{root}/counts", f"{root}/ckpt", compact_every=3)
    assert sum(len(b) for b in K._batches(spark, f"{root}/counts").values()) <= 3
    got = {(str(r.period_start), r.template, r["count"]) for r in I.continuous_counts(spark, f"{root}/counts").collect()}
    assert got == {(str(r.period_start), r.template, r["count"]) for r in D.template_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
