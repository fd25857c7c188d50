"""Severity names and the issue-severity ladder."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Syslog severity names 0..7 and the issue severity ladder.
SYSLOG_SEVERITY_NAMES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
SEVERITY_LADDER = ["info", "warning", "error", "critical"]

# Syslog severity <= 4 (warning or worse) is "elevated".
ELEVATED_MAX_SEVERITY = 4


def severity_name(sev: Column | str) -> Column:
    """0..7 -> emerg..debug; null or out of range -> ``unknown``."""
    sev = F.col(sev) if isinstance(sev, str) else sev
    names = F.array(*[F.lit(n) for n in SYSLOG_SEVERITY_NAMES])
    return F.coalesce(F.when((sev >= 0) & (sev <= 7), F.get(names, sev)), F.lit("unknown"))


def severity_rank(sev: Column | str) -> Column:
    """Ladder index, case-insensitive; null / empty / unknown -> 0."""
    sev = F.col(sev) if isinstance(sev, str) else sev
    ladder = F.create_map(*chain.from_iterable(
        (F.lit(n), F.lit(i)) for i, n in enumerate(SEVERITY_LADDER)))
    return F.coalesce(F.try_element_at(ladder, F.lower(sev)), F.lit(0))


def ladder_name(rank: Column | str) -> Column:
    """Inverse of :func:`severity_rank` for ranks 0..3."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.get(F.array(*[F.lit(n) for n in SEVERITY_LADDER]), rank)


def is_elevated(sev: Column | str) -> Column:
    """Severity present and <= 4; null is never elevated.

    Written as two plain comparisons so that Parquet scans receive it as
    pushed filters (``IsNotNull``, ``LessThanOrEqual``).
    """
    sev = F.col(sev) if isinstance(sev, str) else sev
    return sev.isNotNull() & (sev <= ELEVATED_MAX_SEVERITY)
