"""Recurrence over rolling reviews from partials that are kept as findings are stored.

An issue at ``t`` is in the daily reviews R with ``t < R <= t + window``. So it enters with
the first review after t, moves from the window's second half to its first with the first
review after t + window / 2, and leaves with the first review after t + window. All three are
dates, so the issues of a title and local day fall into very few kinds: a **partial** is a count
per (keys, title, severity, category, day, the three dates) with the sum of occurrences and the
first sighting. Partials add up, so they are stored with each append and never
recomputed.

:func:`rolling` turns partials into changes (what a title's counts gain or lose at a date),
at most four rows a partial whatever the window's length, shuffles them by title once, and
sums them up in date order. The values hold until the title's next change and are written out
for the reviews between, which is the size of the result. A distinct day counts from its
first issue's entry to its last issue's leaving. The first sighting in a window is that of
the next partial to leave, as entries and leavings follow each other in the order of time.

Dates follow the local clock (``tz``) while windows are absolute seconds, so a change of the
clock is exact as in :func:`review.review_table`, whose result this equals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import seen_key
from ..functions.text import local_label, local_ts
from .review import REVIEW_HOUR, WINDOW_DAYS, direction, explode_issues, plain_issues, rank_recurrence

DATES = ["enters", "halves", "leaves"]
COUNTS = ["hours", "occurrences", "first_half", "second_half", "days"]
#: Columns of a partial behind its keys.
STORED = ("title string, severity string, category string, day string, enters date, halves date, leaves date, hours long, "
          "occurrences long, first_key decimal(38,0)")


def review_at(day: Column, review_hour: int = REVIEW_HOUR, tz: str = "UTC") -> Column:
    """Instant of the review of a local date."""
    local = F.timestamp_add("HOUR", F.lit(review_hour), day.cast("timestamp"))
    return local if tz.upper() == "UTC" else F.to_utc_timestamp(local, tz)


def first_review_after(ts: Column, review_hour: int = REVIEW_HOUR, tz: str = "UTC") -> Column:
    """Date of the first review later than ``ts``."""
    day = F.to_date(local_ts(ts, tz))
    near = F.sequence(F.date_sub(day, 1), F.date_add(day, 2))
    return F.filter(near, lambda d: review_at(d, review_hour, tz) > ts)[0]


def partials(findings: DataFrame | None, keys: Sequence[str] = (), window_days: int = WINDOW_DAYS, review_hour: int = REVIEW_HOUR, tz: str = "UTC",
             issues: DataFrame | None = None) -> DataFrame:
    """Partials of some findings, or of a table of issues (:func:`assess.issue_rows`): keys, title, severity, category, day, ``DATES``, hours, occurrences, first_key."""
    def later(seconds: int) -> Column:
        return first_review_after(F.timestamp_add("SECOND", F.lit(seconds), F.col("ts")), review_hour, tz)

    issues = explode_issues(findings, keys) if issues is None else plain_issues(issues, keys)
    rows = issues.select(*keys, "title", "severity", "category", local_label("ts", "yyyy-MM-dd", tz).alias("day"),
                         later(0).alias("enters"), later(window_days * 43200).alias("halves"), later(window_days * 86400).alias("leaves"),
                         "occurrences", seen_key("ts", "pos").alias("first_key"))
    return _summed(rows.withColumn("hours", F.lit(1).cast("long")), keys)


def _summed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "title", "severity", "category", "day", *DATES).agg(
        F.sum("hours").cast("long").alias("hours"), F.sum("occurrences").cast("long").alias("occurrences"), F.min("first_key").alias("first_key"))


def store_partials(rows: DataFrame, path: str, source: str, run: int) -> None:
    """Keep the partials of one append. ``source`` and ``run`` name the append: a replay replaces its rows."""
    (rows.withColumn("source", F.lit(source)).withColumn("run", F.lit(run).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("source", "run").parquet(path))


def stored_partials(spark: SparkSession, path: str, keys: Sequence[str] = (), review=None) -> DataFrame:
    """Partials of all appends; with ``review`` (a date), of those that are in that review's window. Appends without
    any issue leave a folder without a schema, which holds no partials (``keys`` are strings then)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and not any(s.getPath().getName().startswith("source=") for s in fs.listStatus(p)):
        rows = spark.createDataFrame([], ", ".join([*[f"`{k}` string" for k in keys], STORED]))
    else:
        rows = spark.read.parquet(path)
    if review is not None:
        at = F.lit(review).cast("date")
        rows = rows.filter((F.col("enters") <= at) & (F.col("leaves") > at))
    return _summed(rows, keys)


def _changes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per (keys, title, date): what the counts change by, and the first sighting of the partials that leave."""
    zero = F.lit(0).cast("long")
    hours, occurrences = F.col("hours"), F.col("occurrences")
    first = F.struct(F.col("first_key"), F.col("severity"), F.col("category"))
    none = F.lit(None).cast("struct<first_key:decimal(38,0),severity:string,category:string>")

    def change(at: str, *values: Column) -> Column:
        return F.struct(F.col(at).alias("at"), *[v.cast("long").alias(c) for c, v in zip(COUNTS, values, strict=True)],
                        (first if at == "leaves" else none).alias("leaving"))

    moves = rows.select(*by, F.explode(F.array(
        change("enters", hours, occurrences, zero, hours, zero),
        change("halves", zero, zero, hours, -hours, zero),
        change("leaves", -hours, -occurrences, -hours, zero, zero))).alias("c")).select(*by, "c.*")
    spans = rows.groupBy(*by, "day").agg(F.min("enters").alias("enters"), F.max("leaves").alias("until"))
    days = spans.select(*by, F.explode(F.array(F.struct(F.col("enters").alias("at"), F.lit(1).cast("long").alias("days")),
                                               F.struct(F.col("until").alias("at"), F.lit(-1).cast("long").alias("days")))).alias("c"))
    days = days.select(*by, "c.at", *[zero.alias(c) for c in COUNTS[:-1]], F.col("c.days").alias("days"), none.alias("leaving"))
    return moves.unionByName(days).groupBy(*by, "at").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("leaving").alias("leaving"))


def rolling(rows: DataFrame, keys: Sequence[str] = (), review_hour: int = REVIEW_HOUR, tz: str = "UTC") -> DataFrame:
    """Ranked recurrence per (keys, review_ts, title) with the trend, from partials; columns as
    :func:`review.review_table`."""
    by = [*keys, "title"]
    up = Window.partitionBy(*by).orderBy("at")
    down = Window.partitionBy(*by).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    held = _changes(rows, by).select(*by, "at", *[F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in COUNTS],
                                     F.lead("at").over(up).alias("next"), F.min("leaving").over(down).alias("first"))
    at = held.filter(F.col("hours") > 0).withColumn("review", F.explode(F.sequence(F.col("at"), F.date_sub(F.col("next"), 1))))
    table = at.select(*keys, review_at(F.col("review"), review_hour, tz).alias("review_ts"), "title", "hours", "occurrences", "days",
                      F.col("first.severity").alias("severity"), F.col("first.category").alias("category"), "first_half", "second_half",
                      F.col("first.first_key").alias("first_key"))
    return rank_recurrence(table, [*keys, "review_ts"]).withColumn("direction", direction())
