"""Typed schemas of the three tables and the two nested payloads."""

from pyspark.sql import types as T

RAW_LOGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("host", T.StringType()),
    T.StructField("facility", T.IntegerType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("message", T.StringType()),
])

# One issue of an evaluated period (all fields required in a valid payload).
ISSUE = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("occurrences", T.LongType()),
    T.StructField("recommendation", T.StringType()),
])

FINDING_PAYLOAD = T.StructType([
    T.StructField("overall_status", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("findings", T.ArrayType(ISSUE)),
])

RECURRING_ISSUE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("days_seen", T.LongType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("recommendation", T.StringType()),
])

TREND = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("detail", T.StringType()),
])

WEEKLY_PAYLOAD = T.StructType([
    T.StructField("period_status", T.StringType()),
    T.StructField("overall_assessment", T.StringType()),
    T.StructField("recurring_issues", T.ArrayType(RECURRING_ISSUE)),
    T.StructField("trends", T.ArrayType(TREND)),
    T.StructField("watchlist", T.ArrayType(T.StringType())),
])

FINDINGS = T.StructType([
    T.StructField("period_start", T.TimestampType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("overall_status", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("log_count", T.LongType()),
    T.StructField("payload", FINDING_PAYLOAD),
])

WEEKLY_SUMMARIES = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("period_start", T.TimestampType()),
    T.StructField("period_end", T.TimestampType()),
    T.StructField("window_days", T.IntegerType()),
    T.StructField("finding_count", T.LongType()),
    T.StructField("payload", WEEKLY_PAYLOAD),
])

# Enumerations of the payload contracts (fixed values).
FINDING_STATUSES = ["ok", "warning", "error"]
ISSUE_SEVERITIES = ["info", "warning", "error", "critical"]
PERIOD_STATUSES = ["ok", "watch", "action"]
TREND_DIRECTIONS = ["new", "increasing", "steady", "decreasing", "resolved"]
