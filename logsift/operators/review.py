"""Multi-day review of stored findings: recurrence, trends, weekly roll-up.

* :func:`explode_issues` unnests ``payload.findings`` with its position;
* :func:`recurrence` is the per-title table (hours = issue rows, summed
  occurrences, distinct local days, severity / category of the first
  sighting) and :func:`rank_recurrence` orders it by (days, hours) desc,
  ties in first-sighting order, no cap;
* :func:`assign_reviews` maps each finding to the daily review instants whose
  window ``[R - days*86400 s, R)`` contains it: an equi-key explode, no range
  join, so every review of a 30-day history is one grouped job;
* :func:`build_reviews` renders the roll-up text and the deterministic
  review payload (recurring issues, trends, watchlist, period status).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import seen_key
from ..functions.text import local_label, local_ts

# Review defaults and the summaries cap of the roll-up text.
WINDOW_DAYS = 7
REVIEW_HOUR = 6
MAX_SUMMARIES = 200
RECURRING_MIN_HOURS = 2


def explode_issues(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per issue: keys, period_start, ts, pos, title, severity, category, occurrences.

    Missing title -> ``(untitled)``, severity -> ``info``, category -> ``""``,
    occurrences -> 0.
    """
    keys = list(keys)
    x = findings.select(*keys, "period_start", "ts", F.posexplode("payload.findings").alias("pos", "i"))
    i = F.col("i")
    return x.select(
        *keys, "period_start", "ts", "pos",
        F.coalesce(i["title"], F.lit("(untitled)")).alias("title"),
        F.coalesce(i["severity"], F.lit("info")).alias("severity"),
        F.coalesce(i["category"], F.lit("")).alias("category"),
        F.coalesce(i["occurrences"], F.lit(0)).cast("long").alias("occurrences"),
    )


def plain_issues(issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Issue rows as :func:`explode_issues` gives them. A title is there once per period, so the
    place among the period's issues doesn't matter."""
    return issues.select(*keys, "period_start", "ts", F.lit(0).alias("pos"), F.coalesce("title", F.lit("(untitled)")).alias("title"),
                         F.coalesce("severity", F.lit("info")).alias("severity"), F.coalesce("category", F.lit("")).alias("category"),
                         F.coalesce("occurrences", F.lit(0)).cast("long").alias("occurrences"))


def recurrence(issues: DataFrame, keys: Sequence[str] = (), tz: str = "UTC",
               split_at: Column | None = None) -> DataFrame:
    """Per (keys, title): hours, occurrences, days, first-sighting severity / category.

    With ``split_at`` the same aggregation also counts issue rows before and
    from that instant (``first_half`` / ``second_half``) for the trend.
    """
    # All issue rows go through a hash aggregation on fixed-width buffers; what
    # needs texts as values sees a row per title, kind and day.
    first = [F.count(F.lit(1)).alias("hours"), F.sum("occurrences").cast("long").alias("occurrences"),
             F.min(seen_key("ts", "pos")).alias("first_key")]
    halves = [] if split_at is None else ["first_half", "second_half"]
    if halves:
        first += [F.count_if(F.col("ts") < split_at).alias("first_half"), F.count_if(F.col("ts") >= split_at).alias("second_half")]
    daily = (issues.withColumn("_day", local_label("ts", "yyyy-MM-dd", tz))
             .groupBy(*keys, "title", "severity", "category", "_day").agg(*first))
    return daily.groupBy(*keys, "title").agg(
        F.sum("hours").cast("long").alias("hours"), F.sum("occurrences").cast("long").alias("occurrences"),
        F.size(F.collect_set("_day")).cast("long").alias("days"),
        F.min_by("severity", "first_key").alias("severity"), F.min_by("category", "first_key").alias("category"),
        *[F.sum(h).cast("long").alias(h) for h in halves], F.min("first_key").alias("first_key"))


def rank_recurrence(rec: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("days"), F.desc("hours"), F.asc("first_key"))
    return rec.withColumn("rank", F.row_number().over(w))


def status_counts(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Findings per status: zero-filled ok / warning / error plus the full map."""
    per = findings.groupBy(*keys, "overall_status").agg(F.count(F.lit(1)).alias("n"))
    s = F.col("overall_status")
    return per.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(s == "ok", F.col("n"))), F.lit(0)).cast("long").alias("ok"),
        F.coalesce(F.sum(F.when(s == "warning", F.col("n"))), F.lit(0)).cast("long").alias("warning"),
        F.coalesce(F.sum(F.when(s == "error", F.col("n"))), F.lit(0)).cast("long").alias("error"),
        F.map_from_entries(F.collect_list(F.struct(F.coalesce(s, F.lit("null")), F.col("n"))))
         .alias("status_counts"))


def assign_reviews(findings: DataFrame, window_days: int = WINDOW_DAYS,
                   review_hour: int = REVIEW_HOUR, tz: str = "UTC") -> DataFrame:
    """Add ``review_ts``: one row per (finding, daily review whose window holds it).

    Review instants are ``review_hour`` o'clock local time each day; a window
    is the absolute ``window_days * 86400`` seconds before it, start included,
    end excluded.
    """
    day = F.to_date(local_ts("ts", tz))
    cand = F.sequence(F.date_sub(day, 1), F.date_add(day, window_days + 1))
    x = findings.withColumn("_d", F.explode(cand))
    local_r = F.timestamp_add("HOUR", F.lit(review_hour), F.col("_d").cast("timestamp"))
    r = local_r if tz.upper() == "UTC" else F.to_utc_timestamp(local_r, tz)
    x = x.withColumn("review_ts", r).drop("_d")
    lo = F.timestamp_add("SECOND", F.lit(-window_days * 86400), F.col("review_ts"))
    return x.filter((F.col("ts") < F.col("review_ts")) & (F.col("ts") >= lo))


def reviewed_as_of(findings: DataFrame, as_of, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Rows of the window that ends at ``as_of`` (excluded), with ``review_ts`` = ``as_of``. On a
    stored table the day bounds prune partitions."""
    end = F.lit(as_of).cast("timestamp")
    start = F.timestamp_add("SECOND", F.lit(-window_days * 86400), end)
    if "period_date" in findings.columns:
        findings = findings.filter((F.col("period_date") >= F.to_date(start)) & (F.col("period_date") <= F.to_date(end)))
    return findings.filter((F.col("ts") >= start) & (F.col("ts") < end)).withColumn("review_ts", end)


def midpoint(window_days: int = WINDOW_DAYS) -> Column:
    """Middle of the review window ending at ``review_ts``."""
    return F.timestamp_add("SECOND", F.lit(-(window_days * 86400) // 2), F.col("review_ts"))


def direction(first_half: Column | str = "first_half", second_half: Column | str = "second_half") -> Column:
    """new / resolved / increasing / decreasing / steady from the two half counts."""
    a = F.col(first_half) if isinstance(first_half, str) else first_half
    b = F.col(second_half) if isinstance(second_half, str) else second_half
    return (F.when(a == 0, "new").when(b == 0, "resolved")
            .when(b >= a * 1.5, "increasing").when(b * 1.5 <= a, "decreasing")
            .otherwise("steady"))


def trends(issues: DataFrame, keys: Sequence[str], window_days: int = WINDOW_DAYS) -> DataFrame:
    """First-half vs second-half issue rows per (keys incl. review_ts, title) -> direction."""
    mid = midpoint(window_days)
    t = issues.groupBy(*keys, "title").agg(
        F.count_if(F.col("ts") < mid).alias("first_half"),
        F.count_if(F.col("ts") >= mid).alias("second_half"))
    return t.withColumn("direction", direction())


def review_table(findings: DataFrame | None, keys: Sequence[str] = (), window_days: int = WINDOW_DAYS,
                 review_hour: int = REVIEW_HOUR, tz: str = "UTC", as_of=None, issues: DataFrame | None = None) -> DataFrame:
    """Ranked recurrence per (keys, review_ts) with trend direction, of the issues in ``findings`` or of
    a table of ``issues`` (:func:`assess.issue_rows`)."""
    rk = list(keys) + ["review_ts"]
    # issues are unnested first: narrow rows, not payloads, are copied to their reviews
    iss = explode_issues(findings, keys) if issues is None else plain_issues(issues, keys)
    iss = (assign_reviews(iss, window_days, review_hour, tz) if as_of is None else reviewed_as_of(iss, as_of, window_days))
    # One aggregation gives the recurrence and the trend halves (no second
    # shuffle, no join back).
    rec = recurrence(iss, rk, tz, split_at=midpoint(window_days))
    return rank_recurrence(rec, rk).withColumn("direction", direction())


def _finding_lines(assigned: DataFrame, rk: list[str], tz: str, max_summaries: int = MAX_SUMMARIES) -> DataFrame:
    """Per (keys, review_ts): count, bounds, status counts, last summaries (ties: later
    period, then status and text; a null text is empty)."""
    assigned = assigned.select(*rk, "ts", "period_start", F.coalesce("overall_status", F.lit("")).alias("overall_status"),
                               F.coalesce("summary", F.lit("")).alias("summary"))
    order = ["ts", "period_start", "overall_status", "summary"]
    w = Window.partitionBy(*rk).orderBy(*[F.desc(c) for c in order])
    last = (assigned.withColumn("_back", F.row_number().over(w))
            .filter(F.col("_back") <= max_summaries)
            .groupBy(*rk).agg(F.sort_array(F.collect_list(F.struct(
                *order, F.concat(local_label("ts", "MM-dd HH:mm", tz), F.lit(" ["),
                                 F.col("overall_status"), F.lit("] "), F.col("summary")).alias("line")
            ))).alias("_summaries")))
    s = F.col("overall_status")
    stats = assigned.groupBy(*rk).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.min("ts").alias("period_start"), F.max("ts").alias("period_end"),
        F.count_if(s == "ok").alias("n_ok"), F.count_if(s == "warning").alias("n_warning"),
        F.count_if(s == "error").alias("n_error"))
    return stats.join(last, on=rk, how="inner")


def build_reviews(findings: DataFrame, keys: Sequence[str] = (), window_days: int = WINDOW_DAYS,
                  review_hour: int = REVIEW_HOUR, tz: str = "UTC", max_summaries: int = MAX_SUMMARIES,
                  as_of=None) -> DataFrame:
    """One weekly_summaries row per (keys, review instant) with any finding.

    ``as_of``: review only the window that ends at this instant ("review now").

    Columns: keys, ts (review instant), period_start / period_end (first /
    last finding), window_days, finding_count, distinct_findings,
    status_counts (map), digest_text, payload (deterministic review).
    """
    rk = list(keys) + ["review_ts"]
    narrow = findings.drop("payload")
    assigned = assign_reviews(narrow, window_days, review_hour, tz) if as_of is None else reviewed_as_of(narrow, as_of, window_days)
    table = review_table(findings, keys, window_days, review_hour, tz, as_of)
    rec = table.groupBy(*rk).agg(
        F.count(F.lit(1)).alias("distinct_findings"),
        F.sort_array(F.collect_list(F.struct(
            "rank", "title", "category", "severity", "days", "hours", "occurrences",
            "direction"))).alias("_rec"))
    fl = _finding_lines(assigned, rk, tz, max_summaries)
    j = fl.join(rec, on=rk, how="left")
    rec_list = F.coalesce(F.col("_rec"), F.array().cast(
        "array<struct<rank:int,title:string,category:string,severity:string,days:bigint,"
        "hours:bigint,occurrences:bigint,direction:string>>"))
    text = F.array_join(F.concat(
        F.array(
            F.format_string("Hourly evaluations reviewed: %d (from %s to %s)", F.col("finding_count"),
                            local_label("period_start", "yyyy-MM-dd HH:mm", tz),
                            local_label("period_end", "yyyy-MM-dd HH:mm", tz)),
            F.format_string("Status distribution: ok=%d, warning=%d, error=%d",
                            F.col("n_ok"), F.col("n_warning"), F.col("n_error")),
            F.lit(""),
            F.lit("=== Recurring findings across the period "
                  "(title — days seen / hours seen / total occurrences) ===")),
        F.transform(rec_list, lambda r: F.format_string(
            "[%s] %s (%s) — %d day(s) / %d hour(s) / %d occurrences",
            r["severity"], r["title"], r["category"], r["days"], r["hours"], r["occurrences"])),
        F.array(F.lit(""), F.format_string("=== Hourly summaries (%d of %d) ===",
                                           F.size("_summaries"), F.col("finding_count"))),
        F.transform("_summaries", lambda s: s["line"])), "\n")
    payload = review_payload(rec_list, F.col("finding_count"))
    return j.select(
        *keys, F.col("review_ts").alias("ts"), "period_start", "period_end",
        F.lit(window_days).alias("window_days"), F.col("finding_count").cast("long").alias("finding_count"),
        F.coalesce(F.col("distinct_findings"), F.lit(0)).cast("long").alias("distinct_findings"),
        F.create_map(F.lit("ok"), "n_ok", F.lit("warning"), "n_warning", F.lit("error"), "n_error").alias("status_counts"),
        text.alias("digest_text"), payload.alias("payload"))


def review_payload(rec_list: Column, finding_count: Column) -> Column:
    """Deterministic review of a ranked recurrence list (see README, U5)."""
    recurring = F.filter(rec_list, lambda r: r["hours"] >= RECURRING_MIN_HOURS)
    issues = F.transform(recurring, lambda r: F.struct(
        r["title"].alias("title"), r["category"].alias("category"), r["severity"].alias("severity"),
        r["days"].alias("days_seen"),
        F.format_string("%d day(s), %d hour(s)", r["days"], r["hours"]).alias("frequency"),
        F.format_string("%d occurrences in %d hourly evaluations", r["occurrences"], r["hours"])
         .alias("detail"),
        F.lit("Investigate the recurring cause").alias("recommendation")))
    trend_items = F.transform(recurring, lambda r: F.struct(
        r["title"].alias("title"), r["direction"].alias("direction"),
        F.format_string("%s over the review window", r["direction"]).alias("detail")))
    watch = F.transform(F.filter(recurring, lambda r: r["direction"].isin("new", "increasing")),
                        lambda r: r["title"])
    severe = F.exists(recurring, lambda r: F.lower(r["severity"]).isin("error", "critical"))
    status = F.when(severe, "action").when(F.size(recurring) > 0, "watch").otherwise("ok")
    assessment = F.format_string("%d evaluations reviewed; %d recurring issue(s); status %s.",
                                 finding_count, F.size(recurring), status)
    return F.struct(status.alias("period_status"), assessment.alias("overall_assessment"),
                    issues.alias("recurring_issues"), trend_items.alias("trends"),
                    watch.alias("watchlist"))

