"""Alert selection and rendering (the delivery itself is left to the caller).

A finding alerts when any of its issues ranks at or above the threshold on
the severity ladder (issue severity only, never the overall status); the
body lists only those issues. An unknown threshold name ranks 0, so then
every issue alerts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import severity_rank

DEFAULT_THRESHOLD = "error"
DEFAULT_PREFIX = "[logsift]"
SUBJECT_SUMMARY_CHARS = 80


def select_alerts(findings: DataFrame, threshold: str = DEFAULT_THRESHOLD,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Findings with at least one issue at/above ``threshold``; ``selected`` holds those issues."""
    t = severity_rank(F.lit(threshold))
    sel = F.filter("payload.findings",
                   lambda i: severity_rank(F.coalesce(i["severity"], F.lit("info"))) >= t)
    return (findings.withColumn("selected", sel)
                    .filter(F.exists("payload.findings",
                                     lambda i: severity_rank(F.coalesce(i["severity"], F.lit("info"))) >= t)))


def render_alerts(selected: DataFrame, prefix: str = DEFAULT_PREFIX, keys: Sequence[str] = ()) -> DataFrame:
    """Subject and body per selected finding."""
    status = F.upper(F.coalesce(F.col("payload.overall_status"), F.lit("alert")))
    summary = F.coalesce(F.col("payload.summary"), F.lit(""))
    subject = F.concat(F.lit(prefix + " "), status, F.lit(": "), F.substring(summary, 1, SUBJECT_SUMMARY_CHARS))

    def issue_lines(i):
        return F.array(
            F.concat(F.lit("  ["), F.upper(F.coalesce(i["severity"], F.lit("?"))), F.lit("] "),
                     F.coalesce(i["title"], F.lit("")), F.lit(" ("), F.coalesce(i["category"], F.lit("")),
                     F.lit(", x"), F.coalesce(i["occurrences"], F.lit(0)).cast("string"), F.lit(")")),
            F.concat(F.lit("    "), F.coalesce(i["detail"], F.lit(""))),
            F.concat(F.lit("    Evidence: "), F.coalesce(i["evidence"], F.lit(""))),
            F.concat(F.lit("    Recommendation: "), F.coalesce(i["recommendation"], F.lit(""))),
            F.lit(""))

    head = F.array(
        F.concat(F.lit("Overall status: "), F.upper(F.coalesce(F.col("payload.overall_status"), F.lit("?")))),
        F.concat(F.lit("Summary: "), summary), F.lit(""), F.lit("Findings:"))
    body = F.array_join(F.concat(head, F.flatten(F.transform("selected", issue_lines))), "\n")
    return selected.select(*keys, "period_start", "ts", F.size("selected").alias("n_selected"),
                           subject.alias("subject"), body.alias("body"))


def alerts(findings: DataFrame, threshold: str = DEFAULT_THRESHOLD, prefix: str = DEFAULT_PREFIX,
           keys: Sequence[str] = ()) -> DataFrame:
    return render_alerts(select_alerts(findings, threshold, keys), prefix, keys)
