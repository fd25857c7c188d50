"""Named queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads whole tables (``events``, ``pages``, ``documents``) or data
Spark derives from them, and returns flat columns; timestamps are reported
as UTC wall clock (``timestamp_ntz``) so they compare equal across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import cef_severity, frame_lines, header_kind, parse_lines, pri_parts
from ..functions.severity import severity_name, severity_rank
from ..functions.template import templatize
from ..functions.text import local_label
from ..operators import alerts as AL
from ..operators import assess as A
from ..operators import digest as D
from ..operators import findings as FS
from ..operators import recurrence as RC
from ..operators import review as R
from ..operators import sketches as SK
from ..session import scratch_path
from ..sources import testdata as TD
from ..sources.tables import materialize, write_table

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
CUTOFF = "2024-01-15 00:00:00"
SINCE = "2024-01-24 06:00:00"
NOW = "2024-01-31 00:00:00"
AS_OF = "2024-01-20 12:34:56"
RETENTION_DAYS = 10
SMALL_K = 3
SAMPLE_K = 5
ALERT_THRESHOLD = "warning"
LABEL_TZ = "America/Chicago"
TUMBLING_PERIOD = "180 minutes"


def ntz(df: DataFrame) -> DataFrame:
    """Report timestamps as UTC wall clock."""
    return df.select([F.col(f.name).cast("timestamp_ntz").alias(f.name)
                      if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
                      for f in df.schema.fields])


def syslog(spark: SparkSession, sf: str) -> DataFrame:
    return TD.syslog_view(TD.events(spark, sf))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """raw_logs rows parsed from the syslog view."""
    return parse_lines(syslog(spark, sf), "raw", keep=["id", "ts"])


_WRITTEN: dict[tuple, str] = {}


def _state(spark: SparkSession, sf: str) -> tuple:
    """Files of ``events`` with their sizes and times: a changed input is another table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/events.parquet")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))


def _stored(spark: SparkSession, sf: str, name: str, build, partition_by=None) -> DataFrame:
    """A table written once per session and state of the input, then read by every query."""
    key = (spark.sparkContext.applicationId, name, _state(spark, sf))
    path = _WRITTEN.get(key)
    if path is None or not FS.path_exists(spark, path):
        path = _WRITTEN[key] = write_table(build(spark, sf), name, partition_by)
    return spark.read.parquet(path)


def stored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The parsed lines as a written raw_logs table (what evaluations read),
    written once like ingest would, partitioned by ``log_date``.

    Rows are range-partitioned by ``ts``, as a time-ordered
    ingest would lay them out: each task writes one or two days (few files)
    and Parquet row groups get tight ``ts`` min/max statistics for pushdown.
    The raw rows are shuffled and parsed afterwards: bounds are sampled without
    parsing, and the input's row groups don't limit how many tasks parse. They are
    written in between, as the parser's filters would go through the shuffle to the scan.
    The number of ranges is ``spark.sql.shuffle.partitions``, which a cluster
    sizes to its data volume.
    """
    def build(s: SparkSession, d: str) -> DataFrame:
        ordered = materialize(TD.events(s, d, dealt=False).repartitionByRange("ts"), "raw_events")
        return FS.with_log_date(parse_lines(TD.syslog_view(ordered), "raw", keep=["id", "ts"]))
    return _stored(spark, sf, "raw_logs", build, ["log_date"])


def stored_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The findings view as a written findings table (what reviews read)."""
    return _stored(spark, sf, "findings", findings)


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return TD.findings_view(TD.events(spark, sf))


def parts(spark: SparkSession, sf: str, **kw) -> dict[str, DataFrame]:
    return D.digest_parts(stored_lines(spark, sf), **kw)


# ── sources, parsing, masking ───────────────────────────────────────────────

def q_frame_lines(spark, sf):
    return frame_lines(TD.table(spark, sf, "pages"), "html", keep=["page_id"])


def q_parse_pri(spark, sf):
    v = syslog(spark, sf)
    p = pri_parts("raw")
    return v.select("id", p["pri"].alias("pri"), p["facility"].alias("facility"),
                    p["severity"].alias("pri_severity"))


def q_parse_header(spark, sf):
    v = syslog(spark, sf).select("id", pri_parts("raw")["body"].alias("body"))
    return v.select("id", header_kind("body").alias("header"))


def q_cef_severity(spark, sf):
    return lines(spark, sf).select("id", cef_severity("message").alias("cef_severity"))


def q_parse_line(spark, sf):
    return lines(spark, sf).select("id", "host", "facility", "severity", "message")


def q_severity_name(spark, sf):
    return lines(spark, sf).select("id", "severity", severity_name("severity").alias("severity_name"))


def q_templatize(spark, sf):
    return lines(spark, sf).select("id", templatize("message").alias("template"))


def q_mask_tokens(spark, sf):
    return syslog(spark, sf).select("id", templatize("raw").alias("masked"))


def q_templatize_documents(spark, sf):
    return TD.table(spark, sf, "documents").select("doc_id", templatize("text").alias("template"))


def hard_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payload records of ``events`` with what the syslog view lacks: MAC and IPv6 addresses,
    hexadecimal numbers, invalid UTF-8, several lines in a record, lines without a message."""
    ev = TD.events(spark, sf)
    eid = F.col("event_id").cast("string")
    text = (F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("<13>Jun 25 10:00:00 gw link aa:bb:cc:dd:ee:ff up "), eid))
            .when(F.col("event_id") % 6 == 1, F.lit("<14>"))
            .when(F.col("event_id") % 6 == 2, F.concat(F.lit("<11>Jun 25 10:00:00 h2 at 0xDEAD"), eid, F.lit(" run deadbeefcafe"), eid, F.lit(" ")))
            .when(F.col("event_id") % 6 == 3, F.concat(F.lit("seq "), eid, F.lit("\r\n\ntail "), eid))
            .when(F.col("event_id") % 6 == 4, F.concat(F.lit("<15>Jun 25 10:00:00 h4 from 2001:db8:0:0:0:0:0:1 to 10.0.0."), (F.col("event_id") % 256).cast("string")))
            .otherwise(F.lit("  \t ")))
    bad = F.when(F.col("event_id") % 6 == 2, F.unhex(F.lit("FF2078"))).otherwise(F.unhex(F.lit("")))
    return ev.select(F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"),
                     F.concat(F.encode(text, "UTF-8"), bad).alias("value"))


def q_hard_lines(spark, sf):
    from ..streaming.ingest import payload_lines
    x = payload_lines(hard_payloads(spark, sf), ts_col="timestamp")
    return x.select("offset", F.col("pos").cast("int").alias("pos"), "host", "severity", "message", templatize("message").alias("template"))


def q_receive_time(spark, sf):
    """Lines without a time get the instant at which they were received: one for the table."""
    from ..streaming.ingest import payload_lines
    x = payload_lines(hard_payloads(spark, sf).drop("timestamp"))
    return x.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("stamped"), F.count_distinct("ts").alias("instants"))


# ── filters and reads over raw lines ────────────────────────────────────────

def q_logs_until(spark, sf):
    return ntz(FS.logs_until(stored_lines(spark, sf), CUTOFF).select("id", "ts", "host", "severity", "message"))


def q_elevated_filter(spark, sf):
    return ntz(FS.elevated(stored_lines(spark, sf)).select("id", "ts", "severity", "message"))


# ── digest ──────────────────────────────────────────────────────────────────

def q_template_counts(spark, sf):
    return ntz(parts(spark, sf)["counts"].select(
        "period_start", "period_end", "template", "count", "first_ts", "first_id", "elevated",
        "worst_severity"))


def q_host_counts(spark, sf):
    base = D.with_period(stored_lines(spark, sf))
    return ntz(D.host_counts(base).select("period_start", "host", "count", "first_ts", "first_id"))


def q_top_hosts(spark, sf):
    base = D.with_period(stored_lines(spark, sf))
    return ntz(D.top_hosts(D.host_counts(base), k=SMALL_K).select("period_start", "rank", "host", "count"))


def q_top_templates(spark, sf):
    return ntz(D.top_templates(parts(spark, sf)["counts"], k=SMALL_K)
               .select("period_start", "rank", "template", "count"))


def noisy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of ``events``: a few frequent templates, and every third line unlike all others; on two days in
    five all lines are."""
    e = F.col("event_id")
    digits = F.translate(e.cast("string"), "0123456789", "klmnopqrst")
    unique = (e % 3 == 0) | (F.dayofmonth("ts") % 5 < 2)
    message = F.when(unique, F.concat(F.lit("lone "), digits)).otherwise(F.concat(F.lit("often "), F.chr(97 + F.least(e % 64, F.lit(7) + e % 2))))
    return TD.events(spark, sf).select(e.alias("id"), "ts", F.lit(None).cast("string").alias("host"), F.lit(6).alias("severity"), message.alias("message"))


#: Templates that the sketches of the query below track: few, so that days with unlike lines don't settle.
FEW_TRACKED = 96


def q_top_templates_two_pass(spark, sf):
    """Top templates of each day by sketch, recount, and full counts where the sketch can't settle."""
    t = SK.top_templates_two_pass(noisy_lines(spark, sf), k=SMALL_K, period="1 day", tracked=FEW_TRACKED)
    return ntz(t.select("period_start", "rank", "template", "count"))


def q_distinct_sketches(spark, sf):
    """Distinct templates of each day and of all days from stored sketches: within the stated error?"""
    lines = noisy_lines(spark, sf)
    sketches = write_table(SK.distinct_sketches(lines, period="1 day"), "sketches")
    sketches = spark.read.parquet(sketches)
    exact = D.digest_stats(D.template_counts(lines, period="1 day")).select("period_start", F.col("distinct_patterns").alias("exact"))
    every = lines.select(templatize("message").alias("t")).agg(F.count_distinct("t").alias("exact")).withColumn("period_start", F.lit(None).cast("timestamp"))
    est = SK.distinct_templates(sketches, ["period_start"]).unionByName(SK.distinct_templates(sketches).withColumn("period_start", F.lit(None).cast("timestamp")))
    both = est.withColumnRenamed("period_start", "_p").join(exact.unionByName(every), F.col("period_start").eqNullSafe(F.col("_p")))
    within = F.abs(F.col("distinct_patterns") - F.col("exact")) <= F.lit(SK.distinct_error()) * F.col("exact") + 0.5
    return ntz(both.select("period_start", "exact", within.alias("within_error")))


def q_elevated_sample(spark, sf):
    return ntz(D.elevated_sample(stored_lines(spark, sf), k=SAMPLE_K)
               .select("period_start", "rank", "id", "host", "severity", "message"))


def q_digest_stats(spark, sf):
    return ntz(parts(spark, sf)["stats"].select("period_start", "total_lines", "distinct_patterns",
                                                "elevated_count"))


def q_render_digest(spark, sf):
    return ntz(D.build_digests(stored_lines(spark, sf)).select("period_start", "period_end", "digest_text"))


def q_tumbling_digest(spark, sf):
    d = D.build_digests(stored_lines(spark, sf), period=TUMBLING_PERIOD)
    return ntz(d.select("period_start", "period_end", "total_lines", "distinct_patterns",
                        "elevated_count", F.col("templates")[0]["template"].alias("top_template")))


#: Lengths that don't divide a day or an hour, and where the plain intervals start.
ODD_PERIODS, ODD_START = ["7 minutes", "50 minutes", "300 minutes"], "2024-01-01 00:03:00"


def q_odd_periods(spark, sf):
    base = stored_lines(spark, sf)
    start = F.lit(ODD_START).cast("timestamp")
    each = [D.digest_stats(D.template_counts(D.with_period(base, p, start=start))).withColumn("period", F.lit(p)) for p in ODD_PERIODS]
    return ntz(each[0].unionByName(each[1]).unionByName(each[2]))


# ── assessment and findings ─────────────────────────────────────────────────

def assessed(spark, sf) -> DataFrame:
    return A.assess_rules(parts(spark, sf))


def q_assess_rules(spark, sf):
    f = assessed(spark, sf)
    x = f.select("period_start", F.posexplode("payload.findings").alias("pos", "i"))
    return ntz(x.select("period_start", "pos", "i.title", "i.severity", "i.category", "i.occurrences",
                        "i.evidence"))


def q_issue_rows(spark, sf):
    """Findings without payloads and their issues as rows: the same as the payloads hold."""
    p = parts(spark, sf)
    issues = A.issue_rows(p)
    f = A.finding_rows(p["stats"], issues)
    place = Window.partitionBy("period_start").orderBy("order")
    x = issues.select("period_start", (F.row_number().over(place) - 1).alias("pos"), "title", "occurrences", "detail")
    return ntz(f.join(x, "period_start", "left").select("period_start", "ts", "overall_status", "summary", "log_count", "n_issues", "pos", "title", "occurrences", "detail"))


def q_issue_recurrence(spark, sf):
    """Daily reviews of the issues that the rules found, from rows and partials, no payload."""
    t = RC.rolling(RC.partials(None, issues=A.issue_rows(parts(spark, sf))))
    return ntz(t.select("review_ts", "title", "severity", "days", "hours", "occurrences", "direction"))


def rare_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of ``events`` with 90 noisy templates a day and a few single severe lines."""
    e = F.col("event_id")
    letters = F.concat(F.chr(97 + e % 9), F.chr(107 + F.floor(e / 9) % 10))
    message = (F.when(e % 997 == 0, F.concat(F.lit("kernel: hardware error in bank "), (e % 8).cast("string")))
               .when(e % 991 == 1, F.concat(F.lit("daemon "), letters, F.lit(" gave up")))
               .otherwise(F.concat(F.lit("worker "), letters, F.lit(" done in "), (e % 50).cast("string"))))
    severity = F.when(e % 997 == 0, 2).when(e % 991 == 1, 1).otherwise(5)
    return TD.events(spark, sf).select(e.alias("id"), "ts", F.lit(None).cast("string").alias("host"), severity.alias("severity"), message.alias("message"))


def q_rare_severe(spark, sf):
    """Single severe lines behind more templates than the digest shows."""
    f = A.assess_rules(D.digest_parts(rare_lines(spark, sf), period="1 day"))
    x = f.select("period_start", F.posexplode("payload.findings").alias("pos", "i"))
    return ntz(x.select("period_start", "pos", "i.title", "i.severity", "i.category", "i.occurrences", "i.evidence"))


def customer_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule per customer, for one of four sites or (nation 4, 9, ..) for all; every pattern needs other literals."""
    k = F.col("c_custkey")
    pair = F.concat(F.chr(97 + k % 9), F.chr(107 + F.floor(k / 9) % 10))
    other = F.concat(F.chr(97 + F.floor(k / 5) % 9), F.chr(107 + k % 10))
    pattern = (F.when(k % 5 == 0, F.concat(F.lit("(?i)WORKER "), pair, F.lit(" done")))
               .when(k % 5 == 1, F.concat(F.lit("daemon ("), pair, F.lit("|"), other, F.lit(") gave")))
               .when(k % 5 == 2, F.concat(F.lit("er "), other, F.lit(".* in <N>$")))
               .when(k % 5 == 3, F.concat(F.lit("bank +<N>|nothing like customer "), k.cast("string")))
               .otherwise(F.concat(F.lit("^w\\w+ "), pair, F.lit(" "))))
    site = F.col("c_nationkey") % 5
    return TD.table(spark, sf, "customer").select(
        F.when(site < 4, site).cast("int").alias("site"), (k % 97).cast("int").alias("position"),
        F.when(k % 3 == 0, "benign").otherwise("escalate").alias("kind"), pattern.alias("pattern"), F.concat(F.lit("rule "), (k % 11).cast("string")).alias("title"),
        F.lit("customer").alias("category"), F.when(k % 2 == 0, "warning").otherwise("error").alias("severity"), (k % 4).cast("int").alias("min_count"),
        F.concat(F.lit("ask "), F.col("c_name")).alias("recommendation"))


def q_assess_rule_table(spark, sf):
    """Daily findings of four sites, judged by a table of rules."""
    lines = rare_lines(spark, sf).withColumn("site", (F.col("id") % 4).cast("int"))
    f = A.assess_rules(D.digest_parts(lines, ["site"], period="1 day"), ["site"], rules=customer_rules(spark, sf))
    x = f.select("site", "period_start", F.posexplode("payload.findings").alias("pos", "i"))
    return ntz(x.select("site", "period_start", "pos", "i.title", "i.severity", "i.category", "i.occurrences", "i.recommendation"))


def q_findings_build(spark, sf):
    f = assessed(spark, sf)
    return ntz(f.select("period_start", "ts", "overall_status", "summary", "log_count",
                        F.size("payload.findings").alias("n_issues"),
                        FS.payload_to_json("payload").alias("payload_json")))


def q_payload_roundtrip(spark, sf):
    f = findings(spark, sf).withColumn("payload_json", FS.payload_to_json("payload"))
    back = FS.payload_from_json("payload_json")
    return ntz(f.select("period_start", "payload_json",
                        (FS.payload_to_json(back) == F.col("payload_json")).alias("roundtrip_equal")))


def q_validate_payload(spark, sf):
    """Contract check of stored finding payloads (valid) and of ``events.props``
    (JSON objects of another shape: the reject path)."""
    f = findings(spark, sf).select(
        "period_start", F.lit(None).cast("long").alias("event_id"),
        FS.payload_to_json("payload").alias("js"))
    e = TD.events(spark, sf).select(
        F.lit(None).cast("timestamp").alias("period_start"), "event_id", F.col("props").alias("js"))
    v = FS.validate_finding_json("js")
    return ntz(f.unionByName(e).select("period_start", "event_id", F.size(v).alias("n_violations"),
                                       (F.size(v) == 0).alias("is_valid")))


def q_validate_weekly(spark, sf):
    """Contract check of review payloads (valid) and of ``events.props`` (rejected)."""
    w = weekly(spark, sf).select("ts", F.lit(None).cast("long").alias("event_id"), FS.payload_to_json("payload").alias("js"))
    e = TD.events(spark, sf).select(F.lit(None).cast("timestamp").alias("ts"), "event_id", F.col("props").alias("js"))
    return ntz(w.unionByName(e).select("ts", "event_id", F.size(FS.validate_weekly_json("js")).alias("n_violations")))


def q_findings_since(spark, sf):
    return ntz(FS.since(findings(spark, sf), SINCE).select("period_start", "ts", "overall_status", "log_count"))


def q_retention_keep(spark, sf):
    return ntz(FS.retention_keep(findings(spark, sf), NOW, RETENTION_DAYS)
               .select("period_start", "ts", "overall_status"))


def q_retention_counts(spark, sf):
    return FS.retention_counts(findings(spark, sf), NOW, RETENTION_DAYS)


def q_latest_finding(spark, sf):
    return ntz(FS.latest(findings(spark, sf)).select("period_start", "ts", "overall_status", "summary",
                                                     "log_count"))


def q_finding_history(spark, sf):
    return ntz(FS.history(findings(spark, sf), 200).select("period_start", "ts", "overall_status"))


def q_monitor_snapshot(spark, sf):
    return ntz(FS.monitor_snapshot(lines(spark, sf), findings(spark, sf)))


def q_local_day(spark, sf):
    f = findings(spark, sf)
    return ntz(f.select("period_start", "ts",
                        local_label("ts", "yyyy-MM-dd", LABEL_TZ).alias("day"),
                        local_label("ts", "yyyy-MM-dd HH:mm", LABEL_TZ).alias("minute"),
                        local_label("ts", "MM-dd HH:mm", LABEL_TZ).alias("short")))


# ── review ──────────────────────────────────────────────────────────────────

def q_explode_issues(spark, sf):
    return ntz(R.explode_issues(findings(spark, sf)).select(
        "period_start", "ts", "pos", "title", "severity", "category", "occurrences"))


def q_severity_rank(spark, sf):
    return ntz(R.explode_issues(findings(spark, sf)).select(
        "period_start", "pos", "severity", severity_rank("severity").alias("severity_rank")))


def q_status_distribution(spark, sf):
    return R.status_counts(findings(spark, sf)).select("ok", "warning", "error")


def q_recurrence(spark, sf):
    return R.recurrence(R.explode_issues(findings(spark, sf))).select(
        "title", "severity", "category", "days", "hours", "occurrences")


def q_recurrence_ranked(spark, sf):
    rec = R.rank_recurrence(R.recurrence(R.explode_issues(findings(spark, sf))))
    return rec.select("rank", "title", "days", "hours")


def q_weekly_stats(spark, sf):
    f = findings(spark, sf)
    rec = R.recurrence(R.explode_issues(f))
    a = f.agg(F.count(F.lit(1)).alias("finding_count"), F.min("ts").alias("period_start"),
              F.max("ts").alias("period_end"))
    b = rec.agg(F.count(F.lit(1)).alias("distinct_findings"))
    u = (a.select("finding_count", "period_start", "period_end",
                  F.lit(None).cast("long").alias("distinct_findings"))
         .unionByName(b.select(F.lit(None).cast("long").alias("finding_count"),
                               F.lit(None).cast("timestamp").alias("period_start"),
                               F.lit(None).cast("timestamp").alias("period_end"), "distinct_findings")))
    return ntz(u.agg(*[F.max(c).alias(c) for c in
                       ["finding_count", "distinct_findings", "period_start", "period_end"]]))


def q_weekly_sample(spark, sf):
    f = findings(spark, sf)
    return ntz(FS.history(f, R.MAX_SUMMARIES).orderBy("ts").select("ts", "overall_status", "summary"))


def q_rolling_recurrence(spark, sf):
    t = R.review_table(stored_findings(spark, sf))
    return ntz(t.select("review_ts", "rank", "title", "severity", "category", "days", "hours",
                        "occurrences"))


def q_rolling_year(spark, sf):
    """Daily reviews of the last 365 days, from partials of two appends, one of them replayed."""
    path = scratch_path(spark, "partials", uuid.uuid4().hex)
    f = stored_findings(spark, sf)
    for run in (0, 1, 1):
        RC.store_partials(RC.partials(f.filter(F.dayofmonth("ts") % 2 == run), window_days=365), path, "a", run)
    t = RC.rolling(RC.stored_partials(spark, path))
    return ntz(t.select("review_ts", "rank", "title", "severity", "category", "days", "hours", "occurrences", "first_half", "second_half", "direction"))


def q_trend_direction(spark, sf):
    t = R.review_table(stored_findings(spark, sf))
    return ntz(t.select("review_ts", "title", "first_half", "second_half", "direction"))


def weekly(spark, sf) -> DataFrame:
    return R.build_reviews(stored_findings(spark, sf))


def q_review_rules(spark, sf):
    w = weekly(spark, sf)
    return ntz(w.select("ts", F.col("payload.period_status").alias("period_status"),
                        F.size("payload.recurring_issues").alias("n_recurring"),
                        F.array_join("payload.watchlist", "|").alias("watchlist")))


def q_render_weekly(spark, sf):
    return ntz(weekly(spark, sf).select("ts", "digest_text"))


def q_weekly_build(spark, sf):
    w = weekly(spark, sf)
    return ntz(w.select("ts", "period_start", "period_end", "window_days", "finding_count",
                        "distinct_findings", FS.payload_to_json("payload").alias("payload_json")))


def q_review_as_of(spark, sf):
    """Review now: the window that ends at a given instant."""
    w = R.build_reviews(stored_findings(spark, sf), as_of=AS_OF)
    return ntz(w.select("ts", "period_start", "period_end", "finding_count", "distinct_findings"))


def q_latest_weekly(spark, sf):
    return ntz(FS.latest(weekly(spark, sf)).select("ts", "period_start", "period_end", "finding_count"))


def q_weekly_history(spark, sf):
    return ntz(FS.history(weekly(spark, sf), 30).select("ts", "finding_count"))


# ── alerts ──────────────────────────────────────────────────────────────────

def q_alert_select(spark, sf):
    s = AL.select_alerts(findings(spark, sf), ALERT_THRESHOLD)
    return ntz(s.select("period_start", "ts", F.size("selected").alias("n_selected")))


def q_alert_render(spark, sf):
    return ntz(AL.alerts(findings(spark, sf), ALERT_THRESHOLD).select("period_start", "subject", "body"))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
