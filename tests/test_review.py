"""Golden recurrence (FIXTURES §8), time zones, rolling windows, review payload."""

import datetime as dt

from pyspark.sql import functions as F

from logsift import schemas
from logsift.operators import findings as FS
from logsift.operators import review as R


def _issue(title, sev, cat, occ):
    return {"title": title, "severity": sev, "category": cat, "occurrences": occ}


def golden_findings(spark):
    rows = [
        ("2024-01-01 10:00:00", "error", [_issue("VPN", "error", "vpn", 3), _issue("VPN", "warning", "vpn2", 2)]),
        ("2024-01-02 10:00:00", "ok", []),
        ("2024-01-02 11:00:00", "warning", [_issue("DNS", "warning", "dns", None),
                                            {"occurrences": "4"}]),
    ]
    import json
    data = [(r[0], r[1], json.dumps({"overall_status": r[1], "summary": "s", "findings": r[2]})) for r in rows]
    df = spark.createDataFrame(data, "ts string, overall_status string, js string")
    return df.select(F.col("ts").cast("timestamp").alias("period_start"), F.col("ts").cast("timestamp").alias("ts"),
                     "overall_status", F.lit("s").alias("summary"), F.lit(1).cast("long").alias("log_count"),
                     FS.payload_from_json("js", schemas.FINDING_PAYLOAD).alias("payload"))


def test_golden_recurrence(spark):
    f = golden_findings(spark)
    rec = R.rank_recurrence(R.recurrence(R.explode_issues(f)))
    got = [(r["rank"], r["title"], r["severity"], r["category"], r["days"], r["hours"], r["occurrences"])
           for r in rec.orderBy("rank").collect()]
    assert got == [(1, "VPN", "error", "vpn", 1, 2, 5), (2, "DNS", "warning", "dns", 1, 1, 0),
                   (3, "(untitled)", "info", "", 1, 1, 4)]
    sc = R.status_counts(f).collect()[0]
    assert (sc["ok"], sc["warning"], sc["error"]) == (1, 1, 1)


def test_local_day_in_zone(spark):
    df = spark.createDataFrame([("2024-01-02 05:00:00",)], "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    from logsift.functions.text import local_day
    assert df.select(local_day("ts", "America/Chicago")).first()[0] == "2024-01-01"
    assert df.select(local_day("ts", "UTC")).first()[0] == "2024-01-02"


def test_review_window_half_open(spark):
    # Review instants at 06:00; window [R - 7 days, R).
    rows = [("2024-01-08 06:00:00",), ("2024-01-01 06:00:00",), ("2024-01-05 12:00:00",)]
    f = spark.createDataFrame(rows, "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    a = R.assign_reviews(f, window_days=7, review_hour=6)
    got = {(str(r["ts"]), str(r["review_ts"])) for r in a.collect()}
    # 2024-01-08 06:00 is excluded from the review at exactly that instant
    assert ("2024-01-08 06:00:00", "2024-01-08 06:00:00") not in got
    assert ("2024-01-01 06:00:00", "2024-01-08 06:00:00") in got  # start boundary included
    reviews_of_mid = sorted(r for t, r in got if t == "2024-01-05 12:00:00")
    assert reviews_of_mid[0] == "2024-01-06 06:00:00" and reviews_of_mid[-1] == "2024-01-12 06:00:00"
    assert len(reviews_of_mid) == 7


def test_review_payload_rules(spark):
    f = golden_findings(spark)
    w = R.build_reviews(f, window_days=7, review_hour=6).orderBy("ts").collect()
    assert str(w[0]["ts"]) == "2024-01-02 06:00:00"  # first instant after the first finding
    # the review at 2024-01-03 06:00 covers [2023-12-27 06:00, 2024-01-03 06:00): all three findings
    last = [r for r in w if str(r["ts"]) == "2024-01-03 06:00:00"][0]
    assert last["finding_count"] == 3
    p = last["payload"]
    assert p["period_status"] == "action"  # VPN recurs (2 hours) and is an error
    assert [i["title"] for i in p["recurring_issues"]] == ["VPN"]
    assert last["digest_text"].startswith("Hourly evaluations reviewed: 3 (from 2024-01-01 10:00 to 2024-01-02 11:00)")
    assert "Status distribution: ok=1, warning=1, error=1" in last["digest_text"]


def test_trend_directions(spark):
    rows = []
    base = dt.datetime(2024, 1, 1, 7)
    for h in range(3):  # first half only -> resolved
        rows.append((base + dt.timedelta(hours=h), "old"))
    for h in range(3):  # second half only -> new
        rows.append((base + dt.timedelta(days=5, hours=h), "fresh"))
    rows += [(base + dt.timedelta(hours=1), "up"), (base + dt.timedelta(days=5), "up"),
             (base + dt.timedelta(days=5, hours=1), "up")]
    df = spark.createDataFrame(rows, "ts timestamp, title string").withColumn(
        "review_ts", F.lit("2024-01-08 06:00:00").cast("timestamp"))
    got = {r["title"]: r["direction"] for r in R.trends(df, ["review_ts"], 7).collect()}
    assert got == {"old": "resolved", "fresh": "new", "up": "increasing"}
