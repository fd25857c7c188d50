"""Event-time closing: each period once, corrections for late lines, state that goes."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from logsift.streaming import periods as P

DAY = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, ts timestamp, site string, host string, severity int, message string"


def line(i, hours, message="fail 1", site="a", severity=3):
    return (i, DAY + dt.timedelta(hours=hours), site, "h", severity, message)


def test_close_correct_and_drop(spark):
    root = tempfile.mkdtemp(prefix="logsift-periods-")
    files = [
        [line(1, 0.1), line(2, 0.2, "up 2", severity=6), line(3, 1.5), line(4, 2.2, site=None)],  # closes hour 0
        [line(5, 0.3), line(6, 0.4, "new 7"), line(7, 1.1), line(8, 4.0)],  # late for hour 0, in time for 1; closes 1 and 2
        [line(9, 30.0)],  # closes hour 4; the watermark passes hours 0 to 4
        [line(10, 0.5), line(11, 30.1)],  # beyond the horizon: dropped and told
        [line(12, 29.5), line(13, 60.0)],
    ]
    progress = []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        q = P.close_periods(stream, f"{root}/out", f"{root}/checkpoint", ["site"], horizon="24 hours")
        progress += q.recentProgress
        closed = P.closed_counts(spark, f"{root}/out", ["site"])
        if n == 0:
            assert {(r.period_start.hour, r.template, r["count"]) for r in closed.collect()} == {(0, "fail <N>", 1), (0, "up <N>", 1)}
    got = {(r.site, r.period_start.day, r.period_start.hour, r.template): (r["count"], r.elevated, r.count_at_close, r.corrections) for r in closed.collect()}
    assert got == {("a", 1, 0, "fail <N>"): (2, 2, 1, 1), ("a", 1, 0, "up <N>"): (1, 0, 1, 0), ("a", 1, 0, "new <N>"): (1, 1, None, 1),
                   ("a", 1, 1, "fail <N>"): (2, 2, 2, 0), (None, 1, 2, "fail <N>"): (1, 1, 1, 0), ("a", 1, 4, "fail <N>"): (1, 1, 1, 0),
                   ("a", 2, 5, "fail <N>"): (1, 1, 1, 0), ("a", 2, 6, "fail <N>"): (2, 2, 2, 0)}
    once = P.emitted(spark, f"{root}/out").filter("not correction").groupBy("site", "period_start", "template").count()
    assert once.filter("count > 1").isEmpty()
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    assert sum(s["numRowsRemoved"] for s in state) >= 6 and state[-1]["numRowsTotal"] <= 1  # hour 60 only


def test_replay_writes_the_same(spark):
    """A batch that wrote its rows but not its mark is written again, without repeating rows."""
    root = tempfile.mkdtemp(prefix="logsift-periods-")
    spark.createDataFrame([line(1, 0.1), line(2, 5.0)], SCHEMA).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
    P.close_periods(stream, f"{root}/out", f"{root}/one", ["site"])
    before = P.closed_counts(spark, f"{root}/out", ["site"]).collect()
    P._delete(spark, f"{root}/out/batch_id=0/mark")
    P.close_periods(stream, f"{root}/out", f"{root}/two", ["site"])  # a new checkpoint starts with batch 0 again
    assert P.closed_counts(spark, f"{root}/out", ["site"]).collect() == before
    assert P.closed_counts(spark, f"{root}/out", ["site"]).select(F.sum("count")).first()[0] == 1
