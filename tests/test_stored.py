"""Newest rows by a walk over days, counts from footers, the ledger of periods."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from logsift.operators import assess as A
from logsift.operators import findings as FS
from logsift.operators import ledger as L
from logsift.operators import stored as ST

DAY = dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc)


def three_years(spark):
    path = tempfile.mkdtemp(prefix="logsift-stored-") + "/findings"
    f = spark.range(3 * 365 * 4).select((F.lit(DAY).cast("timestamp") + F.make_interval(hours=F.col("id").cast("int") * 6)).alias("ts"), F.col("id").alias("n"))
    f = f.withColumn("period_start", F.col("ts") - F.expr("INTERVAL 1 HOUR")).filter("n % 40 > 3")  # days without rows, too
    f.withColumn("period_date", F.to_date("ts")).repartition("period_date").write.partitionBy("period_date").parquet(path)
    return path, f


def test_walk_reads_few_days(spark):
    path, f = three_years(spark)
    days = {d for d, _ in ST.day_folders(spark, path)}
    assert len(days) > 900
    for limit, most in ((1, 1), (10, 4), (200, 64)):
        got = ST.history_stored(spark, path, limit)
        assert len(got.inputFiles()) <= most
        assert [r.n for r in got.collect()] == [r.n for r in f.orderBy(F.desc("ts")).limit(limit).collect()]
    assert ST.history_stored(spark, path, -1).count() == f.count() == ST.history_stored(spark, path, 10**6).count()
    assert ST.latest_stored(spark, path).first().n == f.agg(F.max("n")).first()[0]


def test_counts_from_footers(spark):
    path, f = three_years(spark)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    snap = ST.monitor_stored(spark, path, path)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    plan = snap._jdf.queryExecution().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") >= 2
    assert tuple(snap.first()) == (f.count(), f.count(), f.agg(F.max("ts")).first()[0])
    assert tuple(ST.monitor_stored(spark, path + "/none", path + "/none").first()) == (0, 0, None)


def fails_on(bad):
    class Fails(A.ElevatedCountAssessor):
        def assess(self, digest_text, stats):
            if stats["total_lines"] in bad:
                raise RuntimeError("down")
            return super().assess(digest_text, stats)
    return Fails


def test_ledger(spark):
    root = tempfile.mkdtemp(prefix="logsift-ledger-")
    rows = [(k, DAY + dt.timedelta(hours=h, minutes=m), s, "h", 3, "fail") for k, (h, m, s) in
            enumerate((h, m, s) for h in range(4) for s in ("a", None) for m in range(1 + h + (s == "a")))]
    lines = spark.createDataFrame(rows, "id long, ts timestamp, site string, host string, severity int, message string")

    def run(bad, hours, **kw):
        book = L.run(lines, f"{root}/f", f"{root}/l", fails_on(bad), DAY + dt.timedelta(hours=hours), ["site"], **kw)
        return {(r.site, r.period_start.hour): (r.state, r.attempts) for r in book.collect()}

    assert run({1, 3}, 2) == {("a", 0): ("done", 1), (None, 0): ("pending", 1), ("a", 1): ("pending", 1), (None, 1): ("done", 1)}
    assert run({3}, 3, max_attempts=2) == {("a", 0): ("done", 1), (None, 0): ("done", 2), ("a", 1): ("given_up", 2), (None, 1): ("done", 1),
                                           ("a", 2): ("done", 1), (None, 2): ("pending", 1)}
    # a run lost after its append: the ledger goes back a version, the findings stay as they are
    n = spark.read.parquet(f"{root}/f").count()
    L._versions(spark, f"{root}/l")
    after = run(set(), 4)
    assert after[(None, 2)] == ("done", 2) and after[("a", 1)] == ("given_up", 2) and after[("a", 3)] == ("done", 1)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/l/v2/_SUCCESS")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)
    assert run(set(), 4) == after
    f = spark.read.parquet(f"{root}/f")
    assert f.count() == n + 3 == f.select("site", "period_start").distinct().count()
    assert FS.latest(f).count() == 1
