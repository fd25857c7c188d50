"""Rolling recurrence from partials equals the review table that copies issues to their reviews."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from logsift.operators import recurrence as RC
from logsift.operators import review as R

COLS = ["site", "review_ts", "rank", "title", "severity", "category", "days", "hours", "occurrences", "first_half", "second_half", "direction"]


def findings(spark, days=40, start=dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc), seed=1):
    rnd = random.Random(seed)
    rows = []
    for h in range(0, days * 24, 5):
        ts = start + dt.timedelta(hours=h, seconds=rnd.choice([0, 0, 1, 1800]))
        issues = [(rnd.choice(["info", "error", None]), rnd.choice(["c1", "c2"]), t, rnd.choice([1, 2, None])) for t in rnd.sample(["a", "b", "c", "d", None], rnd.randint(0, 4))]
        rows.append((rnd.choice(["x", "y", None]), ts - dt.timedelta(hours=1), ts, [(s, c, t, "d", "e", o, "r") for s, c, t, o in issues + issues[:1]]))
    return spark.createDataFrame(rows, "site string, period_start timestamp, ts timestamp, f array<struct<severity:string,category:string,title:string,detail:string,"
                                 "evidence:string,occurrences:long,recommendation:string>>").select("site", "period_start", "ts", F.struct(F.col("f").alias("findings")).alias("payload"))


def rows(df):
    return sorted(map(str, df.select(COLS).collect()))


@pytest.mark.parametrize("window,hour,tz", [(7, 6, "UTC"), (1, 0, "UTC"), (30, 23, "UTC"), (7, 6, "America/Chicago"), (2, 2, "Europe/Berlin"), (3, 5, "Asia/Kolkata")])
def test_equals_review_table(spark, window, hour, tz):
    """March holds a change of the clock in Chicago and Berlin (and Berlin's 2 o'clock doesn't exist on one day)."""
    f = findings(spark)
    want = R.review_table(f, ["site"], window, hour, tz)
    got = RC.rolling(RC.partials(f, ["site"], window, hour, tz), ["site"], hour, tz)
    assert rows(got) == rows(want) and got.count() > 30


def test_appends_and_replays_add_up(spark):
    path = tempfile.mkdtemp(prefix="logsift-partials-") + "/p"
    f = findings(spark, seed=2)
    for run, cond in ((0, "dayofmonth(ts) < 9"), (1, "dayofmonth(ts) >= 9"), (1, "dayofmonth(ts) >= 9")):
        RC.store_partials(RC.partials(f.filter(cond), ["site"]), path, "s", run)
    stored = RC.stored_partials(spark, path, ["site"])
    assert rows(RC.rolling(stored, ["site"])) == rows(R.review_table(f, ["site"]))
    one = RC.stored_partials(spark, path, ["site"], review="2024-03-20")
    at = F.col("review_ts") == F.lit("2024-03-20 06:00:00").cast("timestamp")
    assert rows(RC.rolling(one, ["site"]).filter(at)) == rows(R.review_table(f, ["site"]).filter(at))


def test_changes_do_not_grow_with_the_window(spark):
    f = findings(spark, seed=3)
    n = [RC._changes(RC.partials(f, ["site"], d), ["site", "title"]).count() for d in (60, 365)]
    assert n[1] <= 1.1 * n[0]
    assert RC.rolling(RC.partials(f.limit(0))).collect() == []


def test_appends_without_issues(spark):
    """Findings without issues are stored as no partials, and read as none, with keys and without."""
    f = findings(spark, days=2).withColumn("payload", F.struct(F.filter("payload.findings", lambda _: F.lit(False)).alias("findings")))
    for keys in ([], ["site"]):
        path = tempfile.mkdtemp() + "/p"
        for run in (0, 1, 1):
            RC.store_partials(RC.partials(f, keys), path, "a", run)
        assert RC.rolling(RC.stored_partials(spark, path, keys), keys).collect() == []
        assert RC.stored_partials(spark, path, keys, review="2024-03-02").collect() == []
        full = RC.partials(findings(spark, days=2), keys)
        RC.store_partials(full, path, "a", 2)
        assert RC.stored_partials(spark, path, keys).count() == full.count() > 0
