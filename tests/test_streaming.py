"""Streaming: consume-once across runs, failing assessor keeps its input, continuous mode."""

import datetime as dt
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from logsift.streaming import ingest as I


def _write_lines(folder, name, lines):
    with open(os.path.join(folder, name), "w") as fh:
        fh.write("\n".join(lines) + "\n")


@pytest.fixture()
def dirs():
    base = tempfile.mkdtemp(prefix="logsift-stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    return src, os.path.join(base, "findings"), os.path.join(base, "ckpt")


def test_text_stream_parse(spark, dirs):
    src, _, _ = dirs
    _write_lines(src, "a.log", ["<13>Jun 25 10:00:00 h1 fail 10.0.0.1", "", "<14>", "plain"])
    q = (I.lines_stream(spark, src).writeStream.format("memory").queryName("parsed_" + uuid.uuid4().hex[:8])
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql(f"select host, severity, message from {q.name}").collect()
    got = {(r["host"], r["severity"], r["message"]) for r in rows}
    assert got == {("h1", 5, "fail 10.0.0.1"), (None, None, "plain")}


def test_consume_once_and_replay_on_failure(spark, dirs):
    src, out, ckpt = dirs
    _write_lines(src, "1.log", [f"<11>Jun 25 10:00:0{i} h fail 10.0.0.{i}" for i in range(5)])
    stream = I.lines_stream(spark, src)

    def boom(batch, batch_id):
        raise RuntimeError("assessment unavailable")

    with pytest.raises(Exception):
        I.consume_once(stream, out, ckpt, assess=boom)
    assert not os.path.exists(out)  # nothing stored, lines not consumed

    I.consume_once(I.lines_stream(spark, src), out, ckpt)
    f = spark.read.parquet(out)
    assert f.count() == 1 and f.first()["log_count"] == 5

    I.consume_once(I.lines_stream(spark, src), out, ckpt)  # nothing new: nothing stored
    assert spark.read.parquet(out).count() == 1

    _write_lines(src, "2.log", ["<11>Jun 25 11:00:00 h fail 10.0.0.9"])
    I.consume_once(I.lines_stream(spark, src), out, ckpt)  # only the new line
    counts = sorted(r["log_count"] for r in spark.read.parquet(out).collect())
    assert counts == [1, 5]


def test_continuous_counts_match_batch(spark, dirs):
    from logsift.operators import digest as D
    from logsift.sources import testdata as TD
    sf = "/root/testdata/sf0.001"
    schema = TD.table(spark, sf, "events").schema
    ev = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
          .withColumn("ts", F.col("ts").cast("timestamp")))
    lines = I.parse_payloads(TD.syslog_view(ev), "raw")
    _, out, ckpt = dirs
    I.run_continuous_counts(lines, out, ckpt)
    got = {(str(r["period_start"]), r["rank"], r["template"], r["count"])
           for r in D.top_templates(I.continuous_counts(spark, out), k=2).collect()}
    batch_lines = I.parse_payloads(TD.syslog_view(TD.events(spark, sf)), "raw")
    want = {(str(r["period_start"]), r["rank"], r["template"], r["count"])
            for r in D.top_templates(D.template_counts(batch_lines), k=2).collect()}
    assert got == want  # the still-open last hour included


def test_payload_lines_from_kafka_shaped_records(spark):
    recs = [(0, 7, dt.datetime(2024, 1, 1), bytearray(b"<13>Jun 25 10:00:00 h1 a 1\r\n\n<11>b\xff 2")),
            (1, 3, dt.datetime(2024, 1, 1), bytearray(b"<14>"))]
    df = spark.createDataFrame(recs, "partition int, offset long, timestamp timestamp, value binary")
    lines = I.payload_lines(df, ts_col="timestamp")
    rows = sorted(lines.collect(), key=lambda r: (r["partition"], r["offset"], r["pos"]))
    assert [(r["partition"], r["offset"], r["pos"], r["host"], r["severity"], r["message"]) for r in rows] == [
        (0, 7, 0, "h1", 5, "a 1"),
        (0, 7, 3, None, 3, "b\ufffd 2"),  # "\r\n\n" gives two empty pieces
    ]
    assert {str(r["ts"]) for r in rows} == {"2024-01-01 00:00:00"}


def test_numbered_lines_are_unique_and_in_order(spark):
    """Two partitions with equal offsets, records of more than 4,096 lines."""
    recs = [(p, o, bytearray("\n".join(f"m{p}{o} {i}" for i in range(5000)).encode())) for p in (0, 1) for o in (3, 4)]
    df = spark.createDataFrame(recs, "partition int, offset long, value binary")
    rows = I.numbered(I.payload_lines(df)).collect()
    assert sorted(r["id"] for r in rows) == list(range(20_000))
    assert [(r["partition"], r["offset"], r["pos"]) for r in sorted(rows, key=lambda r: r["id"])] == [(p, o, i) for p in (0, 1) for o in (3, 4) for i in range(5000)]
    assert len({r["ts"] for r in rows}) == 1


def test_true_occurrences_at_defaults(spark, dirs):
    src, out, ckpt = dirs
    _write_lines(src, "a.log", ["<11>Jun 25 10:00:00 h fail x"] * 5 + ["<11>Jun 25 10:00:00 h boom y"] * 3)
    I.consume_once(I.lines_stream(spark, src), out, ckpt)
    issues = {i["title"]: (i["occurrences"], i["evidence"]) for i in spark.read.parquet(out).first()["payload"]["findings"]}
    assert issues == {"fail x": (5, "fail x"), "boom y": (3, "boom y")}


def test_other_source_with_equal_batch_id_is_stored(spark, dirs):
    src, out, ckpt = dirs
    _write_lines(src, "a.log", ["<11>Jun 25 10:00:00 h fail x"] * 2)
    I.consume_once(I.lines_stream(spark, src), out, ckpt + "1")
    I.consume_once(I.lines_stream(spark, src), out, ckpt + "2")
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 2 and len({r["source_id"] for r in rows}) == 2 and {r["batch_id"] for r in rows} == {0}


def test_late_lines_correct_their_period(spark, dirs):
    src, out, ckpt = dirs
    schema = "id long, ts timestamp, host string, severity int, message string"

    def more(*rows):
        spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h, m), "h", 5, msg) for i, h, m, msg in rows], schema).coalesce(1).write.mode("append").parquet(src)
        I.run_continuous_counts(spark.readStream.schema(schema).parquet(src), out, ckpt)

    more((1, 10, 0, "a"), (2, 12, 0, "b"))
    more((3, 10, 30, "a"), (4, 14, 0, "c"))  # 10:30 comes after 12:00; 14:00 is the open period
    got = {(r["period_start"].hour, r["template"]): r["count"] for r in I.continuous_counts(spark, out).collect()}
    assert got == {(10, "a"): 2, (12, "b"): 1, (14, "c"): 1}


def test_evaluate_all_bounds_per_key(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 1), "h", 3, "x", "a"), (2, dt.datetime(2024, 1, 1, 2), "h", 3, "x", "a"), (3, dt.datetime(2024, 1, 1, 9), "h", 3, "x", None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, host string, severity int, message string, site string")
    got = {r["site"]: (r["period_start"].hour, r["ts"].hour, r["log_count"]) for r in I.evaluate_all(df, ["site"]).collect()}
    assert got == {"a": (1, 2, 2), None: (9, 9, 1)}
