"""Findings reads, retention boundary, alerts, codec coercion, validation, idempotent append."""

import json

from pyspark.sql import functions as F

from logsift import schemas
from logsift.functions.severity import severity_name, severity_rank
from logsift.operators import alerts as AL
from logsift.operators import findings as FS
from logsift.session import scratch_path


def test_severity_name_and_rank(spark):
    df = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 4, 5, 6, 7, -1, 8, None]], "s int")
    names = [r[0] for r in df.select(severity_name("s")).collect()]
    assert names == ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug",
                     "unknown", "unknown", "unknown"]
    df = spark.createDataFrame([(x,) for x in ["info", "Warning", "error", "critical", None, "", "bogus"]], "s string")
    assert [r[0] for r in df.select(severity_rank("s")).collect()] == [0, 1, 2, 3, 0, 0, 0]


def test_retention_boundary(spark):
    now = "2024-02-01 00:00:00"
    df = spark.createDataFrame([("2024-01-02 00:00:00",), ("2024-01-01 23:59:59.999999",)], "ts string") \
        .select(F.col("ts").cast("timestamp").alias("ts"))
    kept = [str(r["ts"]) for r in FS.retention_keep(df, now, 30).collect()]
    assert kept == ["2024-01-02 00:00:00"]
    c = FS.retention_counts(df, now, 30).first()
    assert (c["kept"], c["removed"]) == (1, 1)


def _findings(spark, severities):
    payload = {"overall_status": "error", "summary": "x" * 100,
               "findings": [{"severity": s, "category": "c", "title": f"t{i}", "detail": "d",
                             "evidence": "e", "occurrences": i, "recommendation": "r"}
                            for i, s in enumerate(severities)]}
    df = spark.createDataFrame([("2024-01-01 00:00:00", json.dumps(payload))], "ts string, js string")
    return df.select(F.col("ts").cast("timestamp").alias("period_start"), F.col("ts").cast("timestamp").alias("ts"),
                     FS.payload_from_json("js").alias("payload"))


def test_alert_thresholds(spark):
    f = _findings(spark, ["info", "ERROR", "critical", "bogus"])
    sel = AL.select_alerts(f, "error").first()["selected"]
    assert [i["severity"] for i in sel] == ["ERROR", "critical"]
    assert len(AL.select_alerts(f, "bogus").first()["selected"]) == 4
    assert AL.select_alerts(_findings(spark, ["info"]), "error").count() == 0
    a = AL.alerts(f, "error").first()
    assert a["subject"] == "[logsift] ERROR: " + "x" * 80
    assert a["body"].splitlines()[:4] == ["Overall status: ERROR", "Summary: " + "x" * 100, "", "Findings:"]
    assert "  [ERROR] t1 (c, x1)" in a["body"] and "t0" not in a["body"]


def test_json_coercion(spark):
    js = json.dumps({"overall_status": "ok", "summary": "", "findings": [
        {"occurrences": "7"}, {"occurrences": 1.9}, {"occurrences": -2.5}, {"occurrences": None}, {}]})
    df = spark.createDataFrame([(js,)], "js string")
    occ = [i["occurrences"] for i in df.select(FS.payload_from_json("js").alias("p")).first()["p"]["findings"]]
    assert occ == [7, 1, -2, None, None]


def test_validation(spark):
    good = {"overall_status": "ok", "summary": "", "findings": [
        {"severity": "info", "category": "", "title": "", "detail": "", "evidence": "", "occurrences": 1,
         "recommendation": ""}]}
    bad_status = dict(good, overall_status="fine")
    extra = dict(good, extra=1)
    missing = {"overall_status": "ok", "findings": []}
    bad_issue = dict(good, findings=[{"severity": "huge", "occurrences": 1.5}])
    rows = [(json.dumps(x),) for x in [good, bad_status, extra, missing, bad_issue]] + [("not json",)]
    v = spark.createDataFrame(rows, "payload_json string") \
        .select(FS.validate_finding_json("payload_json").alias("v")).collect()
    got = [r["v"] for r in v]
    assert got[0] == []
    assert "bad overall_status" in got[1]
    assert "unexpected key" in got[2]
    assert "missing summary" in got[3]
    assert {"findings item missing key", "findings item bad severity", "findings item bad occurrences"} <= set(got[4])
    assert got[5] == ["not a JSON object"]


def test_history_negative_limit_and_latest(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "i int").withColumn(
        "ts", F.timestamp_seconds(F.col("i") * 60))
    assert FS.history(df, -1).count() == 5
    assert [r["i"] for r in FS.history(df, 2).collect()] == [4, 3]
    assert FS.latest(df).first()["i"] == 4
    assert FS.latest(df.filter("i < 0")).count() == 0


def test_append_is_idempotent(spark):
    path = scratch_path(spark, "test", "append_idempotent", str(id(spark)) + "x")
    df = spark.createDataFrame([("2024-01-01 00:00:00", "ok")], "ts string, overall_status string") \
        .select(F.col("ts").cast("timestamp").alias("period_start"), F.col("ts").cast("timestamp").alias("ts"),
                "overall_status")
    FS.append_new(df, path)
    FS.append_new(df, path)
    assert spark.read.parquet(path).count() == 1


def test_payload_roundtrip(spark):
    f = _findings(spark, ["info", "error"])
    back = f.select(FS.payload_from_json(FS.payload_to_json("payload"), schemas.FINDING_PAYLOAD).alias("p"),
                    "payload").first()
    assert back["p"] == back["payload"]


def test_purge_drops_old_days_and_trims_boundary(spark):
    path = scratch_path(spark, "test", "purge", str(id(spark)) + "p")
    ts = ["2024-01-01 00:00:00", "2024-01-02 05:00:00", "2024-01-02 07:00:00", "2024-01-03 00:00:00"]
    df = spark.createDataFrame([(t,) for t in ts], "ts string").select(
        F.col("ts").cast("timestamp").alias("period_start"), F.col("ts").cast("timestamp").alias("ts"))
    FS.append_new(df, path)
    FS.append_new(df, path)  # idempotent
    c = FS.purge(spark, path, "2024-01-03 06:00:00", 1)  # cutoff 2024-01-02 06:00
    assert (c["kept"], c["removed"]) == (2, 2)
    left = sorted(str(r["ts"]) for r in spark.read.parquet(path).collect())
    assert left == ["2024-01-02 07:00:00", "2024-01-03 00:00:00"]


def test_latest_per_key(spark):
    rows = [("a", 1), ("a", 5), ("b", 3)]
    df = spark.createDataFrame(rows, "site string, i int").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    got = {r["site"]: r["i"] for r in FS.latest(df, ["site"]).collect()}
    assert got == {"a": 5, "b": 3}


def test_purge_empties_boundary_day(spark):
    path = scratch_path(spark, "test", "purge2", str(id(spark)) + "q")
    ts = ["2024-01-01 01:00:00", "2024-01-02 01:00:00", "2024-01-03 01:00:00"]
    df = spark.createDataFrame([(t,) for t in ts], "ts string").select(
        F.col("ts").cast("timestamp").alias("period_start"), F.col("ts").cast("timestamp").alias("ts"))
    FS.append_new(df, path)
    c = FS.purge(spark, path, "2024-01-03 06:00:00", 1)  # cutoff 2024-01-02 06:00: nothing kept that day
    assert (c["kept"], c["removed"]) == (1, 2)
    assert [str(r["ts"]) for r in spark.read.parquet(path).collect()] == ["2024-01-03 01:00:00"]


def test_split_valid(spark):
    good = {"overall_status": "warning", "summary": "s", "findings": [
        {"severity": "warning", "category": "c", "title": "t", "detail": "d", "evidence": "e",
         "occurrences": "3", "recommendation": "r"}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, '{"overall_status": "bad"}')],
                               "id int, payload_json string")
    ok, bad = FS.split_valid(df)
    ok_rows, bad_rows = ok.collect(), bad.collect()
    assert [r["id"] for r in ok_rows] == [1] and ok_rows[0]["payload"]["findings"][0]["occurrences"] == 3
    assert [r["id"] for r in bad_rows] == [2] and "bad overall_status" in bad_rows[0]["violations"]
