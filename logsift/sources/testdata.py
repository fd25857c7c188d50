"""Views over the driver tables used as inputs by queries and tests.

* :func:`syslog_view` turns ``events`` into raw syslog lines mixing RFC 3164,
  RFC 5424, CEF and header-less lines (one line per event, ``id = event_id``).
* :func:`findings_view` turns ``events`` into one stored finding per
  non-empty hour, the input of the review / recurrence operators.

Both are ordinary projections and aggregations of ``events``, so their work
grows with the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


#: Setting that asks for a round-robin shuffle of each input table to so many partitions.
SPREAD = "logsift.input.partitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin a table to ``partitions`` (default: the setting ``logsift.input.partitions``;
    unset: as the scan splits it).

    Parsing and masking are CPU-bound per row, and the driver's tables are files
    with one row group, which is one task. Tables in many files need no shuffle.
    """
    n = partitions or int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(n) if n else df


#: Compressed bytes of a table that one task parses.
SHARE = 4 << 20


def shares(spark: SparkSession, path: str) -> int:
    """Partitions that keep all cores busy with the table at ``path``: two a core, more if it is large."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / SHARE))


def events(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``events`` with ``ts`` as an instant (the file stores wall-clock UTC). A table of few files, whose row
    groups may be fewer than the cores, is dealt to :func:`shares` partitions; not so without ``dealt``, where
    the caller shuffles the rows before the work on them."""
    ev, n = table(spark, sf_dir, "events"), shares(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    if dealt and not int(spark.conf.get(SPREAD, "0")) and len(ev.inputFiles()) < n:
        ev = spread(ev, n)
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))


# Fixed values of the view: syslog severity per event type.
EVENT_SEVERITY = {"error": 3, "signup": 4, "purchase": 5, "click": 6, "view": 7}


def _s(c: Column) -> Column:
    return c.cast("string")


def syslog_view(ev: DataFrame) -> DataFrame:
    """``(id, ts, raw)``: one syslog line per event."""
    et, uid, eid = F.col("event_type"), F.col("user_id"), F.col("event_id")
    sev = F.coalesce(*[F.when(et == k, F.lit(v)) for k, v in EVENT_SEVERITY.items()])
    pri = F.concat(F.lit("<"), _s((uid % 24) * 8 + sev), F.lit(">"))
    host = F.when(uid % 10 == 0, F.lit("-")).otherwise(F.concat(F.lit("host-"), _s(uid % 10)))
    msg = F.concat(et, F.lit(" user="), _s(uid), F.lit(" src=10."), _s(uid % 256), F.lit(".0."),
                   _s(eid % 256), F.lit(" amount="), _s(F.col("value").cast("decimal(12,2)")))
    cef_sev = F.when(uid % 12 == 11, F.lit("High")).otherwise(_s(uid % 12))
    cef = F.concat(F.lit("CEF:0|Acme|Gateway|1.0|"), _s(eid % 500), F.lit("|"), et, F.lit("|"),
                   cef_sev, F.lit("|"), msg)
    bsd = F.date_format("ts", "MMM dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = eid % 4
    raw = (F.when(kind == 0, F.concat(pri, bsd, F.lit(" "), host, F.lit(" app: "), msg))
           .when(kind == 1, F.concat(pri, F.lit("1 "), iso, F.lit(" "), host, F.lit(" app "),
                                     _s(eid), F.lit(" - - "), msg))
           .when(kind == 2, F.concat(pri, bsd, F.lit(" "), host, F.lit(" "), cef))
           .otherwise(msg))
    return ev.select(eid.alias("id"), F.col("ts"), raw.alias("raw"))


# Fixed values of the findings view.
FINDING_ISSUE_SEVERITY = {"error": "error", "signup": "warning"}
FINDING_MIN_COUNT = 4


def findings_view(ev: DataFrame, period: str = "60 minutes") -> DataFrame:
    """One finding per non-empty period of ``events`` (``ts`` = period end).

    Issue per (period, event_type) with at least 4 events: title = event_type,
    category ``event``, occurrences = count; severity error -> error,
    signup -> warning, else info. Status is the worst issue's. Issues are
    ordered by title.
    """
    w = F.window("ts", period)
    per_type = (ev.groupBy(w.start.alias("period_start"), w.end.alias("ts"), "event_type")
                  .agg(F.count(F.lit(1)).alias("n")))
    et = F.col("event_type")
    sev = F.coalesce(*[F.when(et == k, F.lit(v)) for k, v in FINDING_ISSUE_SEVERITY.items()],
                     F.lit("info"))
    issue = F.struct(
        sev.alias("severity"),
        F.lit("event").alias("category"),
        et.alias("title"),
        F.concat(_s(F.col("n")), F.lit(" "), et, F.lit(" events in the period")).alias("detail"),
        F.concat(F.lit("event_type="), et).alias("evidence"),
        F.col("n").alias("occurrences"),
        F.lit("review the event source").alias("recommendation"),
    )
    grouped = (per_type.groupBy("period_start", "ts")
               .agg(F.sum("n").alias("log_count"),
                    F.sort_array(F.collect_list(
                        F.when(F.col("n") >= FINDING_MIN_COUNT, F.struct(et.alias("k"), issue.alias("v")))
                    )).alias("_issues")))
    issues = F.transform("_issues", lambda x: x["v"])
    sevs = F.transform(issues, lambda i: i["severity"])
    status = (F.when(F.array_contains(sevs, "error"), "error")
              .when(F.array_contains(sevs, "warning"), "warning").otherwise("ok"))
    summary = F.concat(_s(F.size(issues)), F.lit(" issues"))
    out = grouped.select(
        "period_start", "ts", status.alias("overall_status"), summary.alias("summary"),
        F.col("log_count").cast("long").alias("log_count"),
        F.struct(status.alias("overall_status"), summary.alias("summary"),
                 issues.alias("findings")).alias("payload"))
    return out.select([F.col(f.name).cast(f.dataType) for f in schemas.FINDINGS.fields])
