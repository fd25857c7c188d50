"""Registered streaming / plug-in queries (rows-only checks: no SQL equivalent)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assess as A
from ..operators import consume as CO
from ..operators import digest as D
from ..operators import findings as FS
from ..operators import ledger as L
from ..operators import review as R
from ..operators import stored as ST
from ..operators.calls import CallPolicy
from ..plans.catalog import hard_payloads, ntz, stored_findings, stored_lines
from ..session import scratch_path
from ..sources import testdata as TD
from . import ingest as I
from . import periods as P


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a file stream (the whole table, one micro-batch)."""
    schema = TD.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
    return stream.repartition(TD.shares(spark, f"{sf.rstrip('/')}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))


def q_ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Stream the syslog view through framing + parsing into a Parquet sink."""
    run = uuid.uuid4().hex
    out = scratch_path(spark, "ingest", run, "raw_logs")
    lines = I.parse_payloads(TD.syslog_view(_events_stream(spark, sf)), "raw")
    q = (lines.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ingest", run, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return ntz(spark.read.parquet(out).select("id", "ts", "host", "facility", "severity", "message"))


def q_payload_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Payload records (key, value, partition, offset, timestamp) as a stream of several micro-batches:
    decoded, framed, parsed and named by partition, offset and place."""
    root = scratch_path(spark, "payloads", uuid.uuid4().hex)
    hard_payloads(spark, sf).repartition(3, "offset").write.parquet(f"{root}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = (I.payload_lines(src, ts_col="timestamp").writeStream.format("parquet").option("path", f"{root}/lines")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/lines").select("offset", F.col("pos").cast("int").alias("pos"), "host", "severity", "message")


def q_consume_once(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluate all buffered lines once (availableNow + foreachBatch), store findings."""
    run = uuid.uuid4().hex
    out = scratch_path(spark, "consume", run, "findings")
    lines = I.parse_payloads(TD.syslog_view(_events_stream(spark, sf)), "raw")
    I.consume_once(lines, out, scratch_path(spark, "consume", run, "checkpoint"), k_templates=60)
    f = spark.read.parquet(out)
    issue = F.explode_outer("payload.findings").alias("i")
    return ntz(f.select("batch_id", "period_start", "ts", "overall_status", "summary", "log_count",
                        F.size("payload.findings").alias("n_issues"), issue)
               .select("*", "i.title", "i.occurrences", "i.evidence").drop("i"))


def q_stream_top_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Per-hour template counts kept by a stream, top 3 of every hour."""
    run = uuid.uuid4().hex
    out = scratch_path(spark, "continuous", run, "counts")
    lines = I.parse_payloads(TD.syslog_view(_events_stream(spark, sf)), "raw")
    I.run_continuous_counts(lines, out, scratch_path(spark, "continuous", run, "checkpoint"))
    return ntz(D.top_templates(I.continuous_counts(spark, out), k=3).select("period_start", "rank", "template", "count"))


def q_assess_plugin(spark: SparkSession, sf: str) -> DataFrame:
    """Plug-in assessor over hourly digests via mapInPandas (offline stand-in client)."""
    d = D.build_digests(stored_lines(spark, sf))
    out = A.assess_with(d, A.ElevatedCountAssessor)
    return ntz(out.select("period_start", "period_end", "payload_json", "error"))


class _FailsOnOddHours(A.ElevatedCountAssessor):
    """Stand-in for a client that is down, or answers badly, at times."""

    def assess(self, digest_text: str, stats: dict) -> dict:
        kind = stats["total_lines"] % 3
        if kind == 1:
            raise RuntimeError("no answer")
        payload = super().assess(digest_text, stats)
        return {"findings": payload["findings"]} if kind == 2 else payload


class _AnswersTheSecondTime(A.ElevatedCountAssessor):
    """Stand-in for a busy client: some digests are refused once, some always."""

    def __init__(self) -> None:
        self.asked: set[str] = set()

    def assess(self, digest_text: str, stats: dict) -> dict:
        again = digest_text in self.asked
        self.asked.add(digest_text)
        if stats["total_lines"] % 3 == 2 or stats["total_lines"] % 3 == 1 and not again:
            raise RuntimeError("busy")
        return super().assess(digest_text, stats)


def q_plugin_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Plug-in calls, four at a time and two attempts each: what is refused twice stays an error."""
    d = D.build_digests(stored_lines(spark, sf))
    out = A.assess_with(d, _AnswersTheSecondTime, policy=CallPolicy(width=4, attempts=2, backoff=0.001))
    return ntz(out.select("period_start", "total_lines", "error", F.get_json_object("payload_json", "$.summary").alias("summary")))


def _plugin_results(spark: SparkSession, sf: str):
    d = D.build_digests(stored_lines(spark, sf))
    return FS.findings_from_payloads(A.assess_with(d, _FailsOnOddHours))


def q_plugin_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Plug-in results as findings rows: defaults for missing fields, failures left out."""
    f, _ = _plugin_results(spark, sf)
    return ntz(f.select("period_start", "ts", "overall_status", "summary", "log_count", F.size("payload.findings").alias("n_issues")))


def q_plugin_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Periods that are kept back for the next run, with their error."""
    _, back = _plugin_results(spark, sf)
    return ntz(back.select("period_start", "period_end", "total_lines", "error"))


class ReviewCountAssessor(A.Assessor):
    """Offline stand-in for a review client."""

    def assess(self, digest_text: str, stats: dict) -> dict:
        errors = stats["status_counts"].get("error", 0)
        return {"period_status": "action" if errors else "ok", "overall_assessment": f"{errors} of {stats['finding_count']}",
                "recurring_issues": [], "trends": [], "watchlist": [digest_text.splitlines()[1]]}


def q_review_plugin(spark: SparkSession, sf: str) -> DataFrame:
    """Plug-in assessor over daily reviews."""
    out = A.assess_reviews_with(R.build_reviews(stored_findings(spark, sf)), ReviewCountAssessor)
    return ntz(out.select("ts", "finding_count", "distinct_findings", "payload_json", "error", F.size(FS.validate_weekly_json("payload_json")).alias("n_violations")))


def q_append_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Findings appended twice, half of them by another source too, read back."""
    out = scratch_path(spark, "append", uuid.uuid4().hex)
    f = stored_findings(spark, sf).withColumn("batch_id", F.lit(0).cast("long"))
    FS.append_new(f.withColumn("source_id", F.lit("a")), out, source=["source_id", "batch_id"])
    FS.append_new(f.withColumn("source_id", F.lit("a")), out, source=["source_id", "batch_id"])
    again = f.filter(F.hour("period_start") % 2 == 0).withColumn("source_id", F.lit("b"))
    FS.append_new(again, out, source=["source_id", "batch_id"])
    return ntz(spark.read.parquet(out).select("source_id", "batch_id", "period_start", "ts", "overall_status", "log_count"))


def q_templatize_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Masking over whole conversation texts (checked against Python re in tests)."""
    from ..functions.template import templatize
    c = TD.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", templatize("text").alias("template"))


#: Cutoffs of the batch consumer's runs; the second run stops after it stored its finding.
CONSUME_CUTOFFS = ["2024-01-08 03:30:00", "2024-01-16 12:00:00", "2024-02-15 00:00:00"]


class _Stopped(Exception):
    pass


def q_consume_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs over the stored buffer, two sources; the second run is lost after its append and
    finished by the third, which then evaluates what came later."""
    root = scratch_path(spark, "consume_batch", uuid.uuid4().hex)
    lines = stored_lines(spark, sf).drop("log_date").withColumn("site", (F.col("id") % 2).cast("int"))
    CO.buffer_lines(lines, f"{root}/buffer")

    def stop(name: str) -> None:
        if name == "appended":
            raise _Stopped

    for k, cutoff in enumerate(CONSUME_CUTOFFS):
        try:
            CO.consume(spark, f"{root}/buffer", f"{root}/findings", f"{root}/state", cutoff, ["site"], step=stop if k == 1 else lambda name: None)
        except _Stopped:
            pass
    f = spark.read.parquet(f"{root}/findings")
    return ntz(f.select("run", "site", "period_start", "ts", "log_count"))


#: Cutoffs of the ledger's runs; run r fails on hours with more than r lines modulo 4.
LEDGER_CUTOFFS = ["2024-01-10 00:00:00", "2024-01-20 06:30:00", "2024-01-25 00:00:00"]


def _fails_above(r: int):
    class Fails(A.ElevatedCountAssessor):
        def assess(self, digest_text: str, stats: dict) -> dict:
            if stats["total_lines"] % 4 > r:
                raise RuntimeError(f"no answer in run {r}")
            return super().assess(digest_text, stats)
    return Fails


def q_ledger_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs with failures: hours that are done, hours still pending, and their findings."""
    root = scratch_path(spark, "ledger", uuid.uuid4().hex)
    for r, cutoff in enumerate(LEDGER_CUTOFFS):
        book = L.run(stored_lines(spark, sf), f"{root}/findings", f"{root}/ledger", _fails_above(r), cutoff)
    f = spark.read.parquet(f"{root}/findings").select(F.col("period_start").alias("_p"), "log_count")
    return ntz(book.join(f, F.col("_p") == F.col("period_start"), "left").select("period_start", "period_end", "state", "attempts", "last_error", "log_count"))


def q_monitor_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The monitoring row from stored tables: counts from footers, the newest day for the last time."""
    root = scratch_path(spark, "monitor", uuid.uuid4().hex)
    CO.buffer_lines(stored_lines(spark, sf).drop("log_date"), f"{root}/raw_logs")
    FS.append_new(stored_findings(spark, sf), f"{root}/findings")
    return ntz(ST.monitor_stored(spark, f"{root}/raw_logs", f"{root}/findings"))


def q_history_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 100 findings of a stored table, read from its newest days."""
    path = scratch_path(spark, "history", uuid.uuid4().hex)
    FS.append_new(stored_findings(spark, sf), path)
    return ntz(ST.history_stored(spark, path, 100).select("period_start", "ts", "overall_status"))


#: Days of one arriving file, and the share of lines that come a file late.
ARRIVAL_DAYS, LATE_EVERY = 5, 50


def arrivals(spark: SparkSession, sf: str, root: str) -> Iterator[DataFrame]:
    """Parsed lines of ``events`` in the order they arrive; every ``LATE_EVERY``-th line comes with the next
    arrival. Each step adds the files of one arrival to ``root``, as many as there are tasks, and gives the stream
    over ``root``: run until nothing is left, it takes the arrival as one micro-batch."""
    lines = stored_lines(spark, sf)
    first = F.lit("2024-01-01").cast("date")
    arrival = F.floor(F.datediff(F.to_date("ts"), first) / ARRIVAL_DAYS).cast("int") + F.when(F.col("id") % LATE_EVERY == 0, 1).otherwise(0)
    lines = lines.withColumn("arrival", arrival)
    schema = lines.drop("arrival", "log_date").schema
    for n in [r[0] for r in lines.filter("arrival is not null").select("arrival").distinct().orderBy("arrival").collect()]:
        day = F.datediff("log_date", first)  # only the folders of the arrival's days are read
        days = lines.filter((day >= (n - 1) * ARRIVAL_DAYS) & (day < (n + 1) * ARRIVAL_DAYS))
        days.filter(F.col("arrival") == n).drop("arrival", "log_date").write.mode("append").parquet(root)
        yield spark.readStream.schema(schema).parquet(root)


def q_closed_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly template counts emitted as hours close, corrected by late lines, read back."""
    root = scratch_path(spark, "periods", uuid.uuid4().hex)
    for stream in arrivals(spark, sf, f"{root}/in"):
        P.close_periods(stream, f"{root}/out", f"{root}/checkpoint", horizon="12 days")
    c = P.closed_counts(spark, f"{root}/out")
    return ntz(c.select("period_start", "period_end", "template", "count", "elevated", "worst_severity", "count_at_close", "corrections"))


def q_stream_counts_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Per-hour template counts of a stream in several micro-batches, merged by day on the way."""
    root = scratch_path(spark, "compacted", uuid.uuid4().hex)
    for stream in arrivals(spark, sf, f"{root}/in"):
        I.run_continuous_counts(stream, f"{root}/counts", f"{root}/checkpoint", compact_every=3)
    return ntz(D.top_templates(I.continuous_counts(spark, f"{root}/counts"), k=3).select("period_start", "rank", "template", "count"))


STREAM_QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_")}
