"""Period digests: counts, exact distinct templates, top-k, capped samples, text.

Every operator groups by ``keys + [period_start, period_end]`` (``P``), so
one job digests any number of sources at once; ``keys=[]`` is one source.

Scale notes
* Per-template and per-host counts are hash aggregations with a partial
  (map-side) phase, so a hot template or host costs one row per task.
* Top-k cuts use ``row_number() <= k``, which Spark plans as
  ``WindowGroupLimit`` on both sides of the exchange: each task forwards at
  most k rows per period, however hot the period.
* Text is assembled only after the cuts, in one bounded aggregation over a
  union of the cut parts (no joins, no unbounded ``collect_list``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import key_id, key_ts, seen_key
from ..functions.severity import is_elevated, severity_name
from ..functions.template import templatize
from ..functions.text import local_ts, truncate_with_marker

PERIOD = ["period_start", "period_end"]

# Default caps.
K_TEMPLATES = 60
K_SAMPLES = 200
K_HOSTS = 10
MAX_CHARS = 24000
TRUNCATION_MARKER = "\n…[digest truncated]"


def pkeys(keys: Sequence[str] = ()) -> list[str]:
    return list(keys) + PERIOD


_UNIT_MINUTES = {"minute": 1, "minutes": 1, "hour": 60, "hours": 60, "day": 1440, "days": 1440}


def period_minutes(period: str) -> int | None:
    """Length of a simple ``"<n> minutes|hours|days"`` period, else None."""
    parts = period.strip().lower().split()
    if len(parts) == 2 and parts[0].isdigit() and parts[1] in _UNIT_MINUTES:
        return int(parts[0]) * _UNIT_MINUTES[parts[1]]
    return None


def with_period(lines: DataFrame, period: str = "60 minutes", tz: str = "UTC", start=None) -> DataFrame:
    """Tumbling period columns.

    * Whole hours align on the wall clock of ``tz`` and start anew at midnight (5 hours: 0, 5,
      10, 15, 20; the last is shorter), as a schedule of every N hours does.
    * Minutes that divide an hour (5, 15, 30, ...) align on the marks of each hour.
    * Other minutes (7, 45, 50, 90, ...) can't align: they are plain intervals from ``start``
      (an instant; default 1970-01-01 UTC). So are lengths of more than a day.
    """
    m = period_minutes(period)
    if m is not None and m <= 0:
        raise ValueError(f"period {period!r} must be positive")
    if m is not None and m % 60 and 60 % m:
        return _plain_period(lines, m * 60, start)
    if m is not None and 1440 % m and m < 1440:
        return _restarting_period(lines, m, tz)
    if tz.upper() == "UTC":
        w = F.window("ts", period)
        return lines.withColumn("period_start", w.start).withColumn("period_end", w.end)
    w = F.window(local_ts("ts", tz), period)
    return (lines.withColumn("period_start", F.to_utc_timestamp(w.start, tz))
                 .withColumn("period_end", F.to_utc_timestamp(w.end, tz)))


def _plain_period(lines: DataFrame, seconds: int, start) -> DataFrame:
    """Periods of ``seconds`` counted from ``start``, before it too."""
    length = F.lit(seconds * 1_000_000)
    origin = F.lit(0) if start is None else F.unix_micros(F.lit(start).cast("timestamp"))
    at = F.unix_micros("ts")
    begin = at - F.pmod(at - origin, length)
    return lines.withColumn("period_start", F.timestamp_micros(begin)).withColumn("period_end", F.timestamp_micros(begin + length))


def _restarting_period(lines: DataFrame, minutes: int, tz: str) -> DataFrame:
    """Periods of whole hours that start anew at midnight."""
    at = F.col("ts") if tz.upper() == "UTC" else local_ts("ts", tz)
    mark, step = F.date_trunc("day", at), minutes * 60
    k = F.floor((F.unix_seconds(at) - F.unix_seconds(mark)) / step).cast("long") * step
    start, end = (F.timestamp_add("SECOND", x, mark) for x in (k, F.least(k + step, F.lit(86400))))
    if tz.upper() != "UTC":
        start, end = F.to_utc_timestamp(start, tz), F.to_utc_timestamp(end, tz)
    return lines.withColumn("period_start", start).withColumn("period_end", end)


def _first(c: str = "first_key") -> list[Column]:
    return [F.col(c), key_ts(c).alias("first_ts"), key_id(c).alias("first_id")]


def template_counts(lines: DataFrame, keys: Sequence[str] = (), period: str = "60 minutes",
                    tz: str = "UTC", with_template: bool = False) -> DataFrame:
    """Count per (P, template) with first sighting, elevated count, worst severity.

    ``first_elevated_key`` is the (ts, id) key of the template's first
    elevated line: the assessor finds its evidence line in the elevated
    sample by this key, without masking the sample again.
    """
    base = lines if with_template else lines.withColumn("template", templatize("message"))
    if "period_start" not in base.columns:
        base = with_period(base, period, tz)
    P = pkeys(keys)
    return (base.groupBy(*P, "template")
                .agg(F.count(F.lit(1)).alias("count"),
                     F.min(seen_key()).alias("first_key"),
                     F.count_if(is_elevated("severity")).alias("elevated"),
                     F.min("severity").alias("worst_severity"),
                     F.min(F.when(is_elevated("severity"), seen_key())).alias("first_elevated_key"))
                .select(*P, "template", "count", *_first(), "elevated", "worst_severity",
                        "first_elevated_key"))


def top_k(df: DataFrame, keys: Sequence[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per (P) by ``order`` (WindowGroupLimit-planned)."""
    w = Window.partitionBy(*pkeys(keys)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def top_templates(counts: DataFrame, keys: Sequence[str] = (), k: int = K_TEMPLATES) -> DataFrame:
    """Most frequent templates; ties go to the earlier first sighting."""
    return top_k(counts, keys, [F.desc("count"), F.asc("first_key"), F.asc("template")], k)


def host_counts(lines: DataFrame, keys: Sequence[str] = (), period: str = "60 minutes",
                tz: str = "UTC") -> DataFrame:
    """Count per (P, host) for rows with a non-empty host, with first sighting."""
    base = lines if "period_start" in lines.columns else with_period(lines, period, tz)
    P = pkeys(keys)
    return (base.filter(F.col("host").isNotNull() & (F.col("host") != ""))
                .groupBy(*P, "host")
                .agg(F.count(F.lit(1)).alias("count"), F.min(seen_key()).alias("first_key"))
                .select(*P, "host", "count", *_first()))


def top_hosts(hosts: DataFrame, keys: Sequence[str] = (), k: int = K_HOSTS) -> DataFrame:
    return top_k(hosts, keys, [F.desc("count"), F.asc("first_key"), F.asc("host")], k)


def elevated_sample(lines: DataFrame, keys: Sequence[str] = (), period: str = "60 minutes",
                    tz: str = "UTC", k: int = K_SAMPLES) -> DataFrame:
    """First k elevated rows of each period in (ts, id) order, raw message kept."""
    base = lines if "period_start" in lines.columns else with_period(lines, period, tz)
    return top_k(base.filter(is_elevated("severity"))
                     .select(*pkeys(keys), "ts", "id", "host", "severity", "message",
                             seen_key().alias("seen_key")),
                 keys, [F.asc("ts"), F.asc("id")], k)


def digest_stats(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """total_lines, distinct_patterns, elevated_count per (P), from template counts."""
    return (counts.groupBy(*pkeys(keys))
                  .agg(F.sum("count").cast("long").alias("total_lines"),
                       F.count(F.lit(1)).alias("distinct_patterns"),
                       F.sum("elevated").cast("long").alias("elevated_count")))


def digest_parts(lines: DataFrame, keys: Sequence[str] = (), period: str = "60 minutes",
                 tz: str = "UTC", k_templates: int = K_TEMPLATES, k_hosts: int = K_HOSTS,
                 k_samples: int = K_SAMPLES, share_counts: bool = True) -> dict[str, DataFrame]:
    """The bounded pieces a digest is made of.

    The template counts feed both the stats and the top-k. Catalyst prunes
    the two uses differently, so they would not share an exchange and the
    scan + masking would run twice; ``share_counts`` cuts the lineage after
    the aggregation with a reliable checkpoint (the shared checkpoint folder),
    so the lines are masked once and an executor loss restarts from there.
    """
    base = lines if "period_start" in lines.columns else with_period(lines, period, tz)
    counts = template_counts(base, keys)
    if share_counts and not counts.isStreaming:
        counts = counts.checkpoint(eager=True)
    return {
        "counts": counts,
        "stats": digest_stats(counts, keys),
        "templates": top_templates(counts, keys, k_templates),
        "hosts": top_hosts(host_counts(base, keys), keys, k_hosts),
        "sample": elevated_sample(base, keys, k=k_samples),
    }


def assemble(parts: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (P): stats plus the ranked lists, via one bounded aggregation."""
    P = pkeys(keys)
    long0, str0, int0 = F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df: DataFrame, part: str, rank, n1, n2, n3, s1, s2, sev) -> DataFrame:
        return df.select(*P, F.lit(part).alias("part"), rank.cast("int").alias("rank"),
                         n1.cast("long").alias("n1"), n2.cast("long").alias("n2"),
                         n3.cast("long").alias("n3"), s1.cast("string").alias("s1"),
                         s2.cast("string").alias("s2"), sev.cast("int").alias("sev"))

    c = F.col
    u = (rows(parts["stats"], "stats", int0, c("total_lines"), c("distinct_patterns"),
              c("elevated_count"), str0, str0, int0)
         .unionByName(rows(parts["templates"], "tmpl", c("rank"), c("count"), long0, long0,
                           c("template"), str0, int0))
         .unionByName(rows(parts["hosts"], "host", c("rank"), c("count"), long0, long0,
                           c("host"), str0, int0))
         .unionByName(rows(parts["sample"], "sample", c("rank"), long0, long0, long0,
                           c("host"), c("message"), c("severity"))))

    def listof(part: str, *fields: str) -> Column:
        item = F.struct(*[c(f) for f in fields])
        return F.sort_array(F.collect_list(F.when(c("part") == part, item)))

    return (u.groupBy(*P).agg(
        F.max(F.when(c("part") == "stats", c("n1"))).alias("total_lines"),
        F.max(F.when(c("part") == "stats", c("n2"))).alias("distinct_patterns"),
        F.max(F.when(c("part") == "stats", c("n3"))).alias("elevated_count"),
        listof("tmpl", "rank", "n1", "s1").alias("templates"),
        listof("host", "rank", "n1", "s1").alias("hosts"),
        listof("sample", "rank", "sev", "s1", "s2").alias("sample")))


def render_text(assembled: DataFrame, max_chars: int = MAX_CHARS) -> Column:
    """The digest text of one assembled row."""
    c = F.col
    hosts = c("hosts")
    host_line = F.when(F.size(hosts) > 0, F.concat(
        F.lit("Source hosts: "),
        F.array_join(F.transform(hosts, lambda h: F.format_string("%s (%d)", h["s1"], h["n1"])),
                     ", ")))
    head = F.array_compact(F.array(
        F.format_string("Total syslog lines this period: %d", c("total_lines")),
        F.format_string("Distinct message patterns: %d", c("distinct_patterns")),
        host_line,
        F.lit(""),
        F.lit("=== Top message patterns (pattern × count; volatile values masked) ===")))
    tmpl_lines = F.transform(c("templates"), lambda t: F.format_string("[%6d×] %s", t["n1"], t["s1"]))
    sample_head = F.array(F.lit(""), F.format_string(
        "=== Elevated-severity sample (warning or worse), %d of %d ===",
        F.size(c("sample")), c("elevated_count")))
    sample_lines = F.transform(c("sample"), lambda s: F.concat(
        F.lit("("), severity_name(s["sev"]), F.lit(") "), F.coalesce(F.nullif(s["s1"], F.lit("")), F.lit("?")),
        F.lit(": "), s["s2"]))
    text = F.array_join(F.concat(head, tmpl_lines, sample_head, sample_lines), "\n")
    return truncate_with_marker(text, max_chars, TRUNCATION_MARKER)


def build_digests(lines: DataFrame, keys: Sequence[str] = (), period: str = "60 minutes",
                  tz: str = "UTC", k_templates: int = K_TEMPLATES, k_hosts: int = K_HOSTS,
                  k_samples: int = K_SAMPLES, max_chars: int = MAX_CHARS) -> DataFrame:
    """raw_logs rows -> one digest row per (keys, period).

    Columns: keys, period_start, period_end, total_lines, distinct_patterns,
    elevated_count, top_hosts (array<struct<host,count>>), templates
    (array<struct<rank,count,template>>), digest_text.
    """
    parts = digest_parts(lines, keys, period, tz, k_templates, k_hosts, k_samples)
    a = assemble(parts, keys)
    return a.select(
        *pkeys(keys), "total_lines", "distinct_patterns", "elevated_count",
        F.transform("hosts", lambda h: F.struct(h["s1"].alias("host"), h["n1"].alias("count")))
         .alias("top_hosts"),
        F.transform("templates", lambda t: F.struct(t["rank"].alias("rank"), t["n1"].alias("count"),
                                                    t["s1"].alias("template"))).alias("templates"),
        render_text(a, max_chars).alias("digest_text"))
