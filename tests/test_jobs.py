"""End to end on the driver tables: hourly evaluation -> store -> alerts -> review -> purge,
for two sites at once (the README usage)."""

from pyspark.sql import functions as F

from logsift.operators import alerts as AL
from logsift.operators import assess as A
from logsift.operators import digest as D
from logsift.operators import findings as FS
from logsift.operators import review as R
from logsift.plans import catalog as C
from logsift.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_jobs_for_two_sites(spark):
    base = C.stored_lines(spark, SF)
    raw = base.withColumn("site", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    run = scratch_path(spark, "test", "jobs", str(id(raw)))
    fpath, wpath = f"{run}/findings", f"{run}/weekly"
    for day in ("2024-01-05", "2024-01-06"):
        period = FS.lines_between(raw, f"{day} 00:00:00", f"{day} 23:59:59")
        findings = A.assess_rules(D.digest_parts(period, keys=["site"]), keys=["site"])
        FS.append_new(findings, fpath, keys=["site"])
        FS.append_new(findings, fpath, keys=["site"])  # replay stores nothing new
        assert set(AL.alerts(findings, "info", keys=["site"]).columns) >= {"site", "subject", "body"}
    stored = spark.read.parquet(fpath)
    per_site = {r["site"]: r["n"] for r in stored.groupBy("site").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines_in_days = raw.filter(F.to_date("ts").isin("2024-01-05", "2024-01-06"))
    assert sum(r["log_count"] for r in stored.collect()) == lines_in_days.count()
    assert set(per_site) == {"even", "odd"}
    weekly = R.build_reviews(stored, keys=["site"])
    FS.append_new(weekly, wpath, keys=["site"], period_col="ts")
    w = spark.read.parquet(wpath)
    assert w.count() == weekly.count() > 0
    assert {r["site"] for r in w.collect()} == {"even", "odd"}
    n_stored = stored.count()  # before the purge deletes files under this listing
    counts = FS.purge(spark, fpath, "2024-01-07 12:00:00", 1)
    assert counts["kept"] + counts["removed"] == n_stored
    assert spark.read.parquet(fpath).count() == counts["kept"]


def test_parsing_is_dealt_to_all_cores(spark, monkeypatch):
    """A table of one file is one task; its lines are parsed by many, and behind the shuffle."""
    from logsift.sources import testdata as TD
    assert TD.events(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(C, "_stored", lambda s, sf, name, build, by=None: build(s, sf))
    lines = C.stored_lines(spark, SF)
    plan = lines._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" in plan and "repartition" not in plan  # neither the parser nor its filters run before the shuffle
    assert not any("events.parquet" in f for f in lines.inputFiles())


def test_arrivals_are_written_by_many_tasks(spark, tmp_path):
    """Each arrival is added as a whole, in order, by as many tasks as read it."""
    import pathlib

    from logsift.streaming import queries as Q
    seen, files = [], []
    for stream in Q.arrivals(spark, SF, f"{tmp_path}/in"):
        new = sorted(str(p) for p in pathlib.Path(f"{tmp_path}/in").glob("*.parquet") if str(p) not in {f for fs in files for f in fs})
        files.append(new)
        seen.append(spark.read.parquet(*new).select("id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("d")).collect())
        assert stream.isStreaming
    assert max(map(len, files)) > 1 and len(files) > 3
    for n, rows in enumerate(seen):
        assert all(r.d // Q.ARRIVAL_DAYS == n - (r.id % Q.LATE_EVERY == 0) for r in rows)
    ids = sorted(r.id for rows in seen for r in rows)
    assert ids == sorted(r.id for r in C.stored_lines(spark, SF).select("id").collect())
