"""Assessment of period digests into findings.

Two surfaces:

* :func:`assess_rules`, a deterministic rules assessor: rules are matched
  against all templates of a period (masked text, so numbers read
  ``<N>``), benign noise is dropped, escalation rules and a default rule
  (elevated templates) become issues. The built-in rules are one
  ``coalesce(when(rlike ...))`` chain, no join; a table of rules is matched
  through an index of literals (:mod:`.rules`).
* :func:`assess_with`, a plug-in point: any object with
  ``assess(digest_text, stats) -> dict`` runs once per digest row inside
  ``mapInPandas`` (one client per task), e.g. a model client.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.severity import ladder_name, severity_name, severity_rank
from .calls import Caller, CallPolicy
from .digest import pkeys
from .rules import COLUMNS, first_rules

# Fixed values [DESIGN]: the rules table. kind, pattern (Java and RE2 syntax,
# matched on masked templates), category, title, severity, min_count,
# recommendation. First matching rule wins; benign rules come first.
RULES = [
    ("benign", r"Got notification message from PID", "noise", "systemd PID notification", "info", 1, ""),
    ("benign", r"recvfrom header: No such file or directory", "noise", "mca IPC churn", "info", 1, ""),
    ("benign", r"Got no response within <N> seconds", "noise", "mca IPC churn", "info", 1, ""),
    ("benign", r"service_json event fail, retry", "noise", "mca IPC churn", "info", 1, ""),
    ("benign", r"(?i)pcap dumping rate exceeded|DPI.*skip", "noise", "DPI load", "info", 1, ""),
    ("benign", r"(?i)StaTXRetryBurst|tx.?retry|burst_ratio|rssi", "noise", "wireless telemetry", "info", 1, ""),
    ("benign", r"Netlink error response: Resource busy", "noise", "client-state churn", "info", 1, ""),
    ("benign", r"ARP table does not have IP for", "noise", "client-state churn", "info", 1, ""),
    ("benign", r"peer in L-state", "noise", "client-state churn", "info", 1, ""),
    ("benign", r"(?i)(procd|logread).*(SIGTERM|SIGKILL)", "noise", "log rotation", "info", 1, ""),
    ("escalate", r"(?i)ntpd.*timed out waiting", "time", "NTP time sync failing", "warning", 6,
     "Check upstream NTP reachability"),
    ("escalate", r"(?i)(openvpn|vpn|tunnel|ipsec|wireguard).*(auth|cert|tls|handshake).*(fail|error)",
     "vpn", "VPN authentication failures", "error", 1, "Check the VPN certificate and credentials"),
    ("escalate", r"(?i)(wan|uplink).*(down|lost|disconnect)", "wan", "WAN / uplink down", "error", 1,
     "Check the ISP link and modem"),
    ("escalate", r"(?i)(failed password|authentication failure|invalid user|login failed)", "auth",
     "Failed logins", "warning", 3, "Review admin access and source addresses"),
    ("escalate", r"(?i)(intrusion (detected|attempt)|ips alert|(threat|attack) (detected|blocked|event))", "security", "Intrusion signatures",
     "error", 1, "Review the threat events and block the sources"),
    ("escalate", r"(?i)(segfault|core dumped|crash|respawning too fast)", "service", "Service crash",
     "error", 1, "Check the crashing service and its logs"),
    ("escalate", r"(?i)(no space left|out of memory|oom-killer)", "resources", "Resource exhaustion",
     "critical", 1, "Free disk space or memory"),
    ("escalate", r"(?i)(hardware error|i/o error|fan fail|overheat)", "hardware", "Hardware fault",
     "critical", 1, "Inspect the device hardware"),
]
# Default rule: an elevated template with at least this many lines, and from this
# syslog severity on (err and worse) a single one.
DEFAULT_MIN_COUNT = 2
SEVERE = 3
DEFAULT_CATEGORY = "syslog"
DEFAULT_RECOMMENDATION = "Review the source of these messages"


def rule_index(template: Column) -> Column:
    """Index of the first matching rule, or null."""
    return F.coalesce(*[F.when(template.rlike(r[1]), F.lit(i)) for i, r in enumerate(RULES)],
                      F.lit(None).cast("int"))


def _rule_attr(idx: Column, pos: int, cast: str = "string") -> Column:
    return F.get(F.array(*[F.lit(r[pos]).cast(cast) for r in RULES]), idx)


def default_severity(worst_syslog: Column) -> Column:
    """Ladder name of the worst syslog severity: 0-2 critical, 3 error, 4 warning."""
    return (F.when(worst_syslog <= 2, "critical").when(worst_syslog == 3, "error")
            .when(worst_syslog == 4, "warning"))


def rules_table(spark) -> DataFrame:
    """The built-in rules as a table for ``rules`` of :func:`assess_rules`, to be added to."""
    rows = [(i, kind, pattern, title, category, severity, n, advice) for i, (kind, pattern, category, title, severity, n, advice) in enumerate(RULES)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def with_rule(templates: DataFrame, keys: Sequence[str] = (), rules: DataFrame | None = None) -> DataFrame:
    """``templates`` with ``rule``, a struct of the first matching rule's columns or null."""
    if rules is None:
        i = F.col("_i")
        at = {"position": i, "kind": _rule_attr(i, 0), "pattern": _rule_attr(i, 1), "title": _rule_attr(i, 3), "category": _rule_attr(i, 2),
              "severity": _rule_attr(i, 4), "min_count": _rule_attr(i, 5, "int"), "recommendation": _rule_attr(i, 6)}
        # The rule index is computed once; rows a rule does not keep contribute
        # nulls instead of being filtered, so no predicate on the regex-derived
        # columns exists to be pushed below (and re-evaluated under) this step.
        t = templates.withColumn("_i", rule_index(F.col("template")))
        return t.withColumn("rule", F.when(i.isNotNull(), F.struct(*[v.alias(k) for k, v in at.items()]))).drop("_i")
    own = [k for k in keys if k in rules.columns]
    found = first_rules(templates, rules, keys).select(*[F.col(k).alias("_" + k) for k in [*own, "template"]], F.col("_rule").alias("rule"))
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in [*own, "template"]]
    return templates.join(found, on=same, how="left").drop(*["_" + k for k in [*own, "template"]])


def issue_candidates(templates: DataFrame, sample: DataFrame, keys: Sequence[str] = (),
                     min_count: int = DEFAULT_MIN_COUNT, rules: DataFrame | None = None) -> DataFrame:
    """Issue rows per (P, title) from all template counts of a period.

    ``templates``: P, template, count, first_key, elevated, worst_severity,
    first_elevated_key. ``sample``: P, seen_key, message (elevated sample).
    The earliest sample line of a template is its evidence, else the
    template itself. The sample is the period's first elevated lines in
    (ts, id) order, so a template has a sample line exactly when its first
    elevated line is in the sample, and that line is its earliest one: an
    equi-join on the (ts, id) key finds it without masking the sample.
    """
    P = pkeys(keys)
    # one line per key: were a key not unique, the join would count lines twice
    ev = sample.groupBy(*P, F.col("seen_key").alias("first_elevated_key")).agg(F.min("message").alias("evidence"))
    # templates in the order of the digest: most lines, then earliest first sighting
    templates = templates.withColumn("rank", F.struct((-F.col("count")).alias("c"), F.col("first_key").alias("k"), F.col("template").alias("t")))
    t = templates.join(ev, on=P + ["first_elevated_key"], how="left")
    t = with_rule(t, keys, rules)
    rule, is_rule = F.col("rule"), F.col("rule").isNotNull()
    keep = F.when(is_rule, rule["kind"] != "benign").otherwise(F.col("elevated") > 0)
    title = F.when(is_rule, rule["title"]).otherwise(F.col("template"))
    sev = F.when(is_rule, rule["severity"]).otherwise(default_severity(F.col("worst_severity")))
    t = t.select(
        *P, F.when(keep, title).alias("title"), F.col("rank"),
        F.when(keep, F.col("count")).alias("count"), F.col("worst_severity"),
        F.when(is_rule, rule["category"]).otherwise(F.lit(DEFAULT_CATEGORY)).alias("category"),
        sev.alias("severity"),
        F.when(is_rule, rule["min_count"])
         .otherwise(F.when(F.col("worst_severity") <= SEVERE, F.least(F.lit(1), F.lit(min_count))).otherwise(F.lit(min_count))).alias("min_count"),
        F.when(is_rule, rule["recommendation"]).otherwise(F.lit(DEFAULT_RECOMMENDATION))
         .alias("recommendation"),
        F.coalesce(F.col("evidence"), F.col("template")).alias("evidence"))
    g = t.groupBy(*P, "title").agg(
        F.sum("count").cast("long").alias("occurrences"),
        F.count(F.lit(1)).alias("patterns"),
        F.min("rank").alias("first_rank"),
        F.max(severity_rank("severity")).alias("sev_rank"),
        F.min("worst_severity").alias("worst_syslog"),
        F.min_by("category", "rank").alias("category"),
        F.min_by("recommendation", "rank").alias("recommendation"),
        F.min_by("evidence", "rank").alias("evidence"),
        F.min("min_count").alias("min_count"))
    g = g.filter(F.col("occurrences") >= F.col("min_count"))
    sev_name = ladder_name("sev_rank")
    detail = F.format_string("%d lines in %d pattern(s); worst syslog severity %s",
                             F.col("occurrences"), F.col("patterns"), severity_name(F.col("worst_syslog")))
    return g.select(*P, "title", "first_rank", "sev_rank", sev_name.alias("severity"), "category",
                    detail.alias("detail"), "evidence", "occurrences", "recommendation")


def assess_rules(parts: dict[str, DataFrame], keys: Sequence[str] = (),
                 min_count: int = DEFAULT_MIN_COUNT, rules: DataFrame | None = None) -> DataFrame:
    """Digest parts -> findings rows (one per period, also when it has no issue).

    ``rules``: a table of rules (:mod:`.rules`) instead of the built-in ones, for all sources or per
    source if it has key columns. The payload holds all issues of a period in one row; where that may
    be too many, use :func:`issue_rows` and :func:`finding_rows`."""
    P = pkeys(keys)
    iss = issue_candidates(parts["counts"], parts["sample"], keys, min_count, rules)
    issue = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.ISSUE.fields])
    # Order: severity desc, occurrences desc, first template rank.
    ordered = F.struct((-F.col("sev_rank")).alias("a"), (-F.col("occurrences")).alias("b"),
                       F.col("first_rank").alias("c"), F.col("title").alias("d"), issue.alias("v"))
    u = (parts["stats"].select(*P, F.col("total_lines"), F.lit(None).cast(ordered_type()).alias("item"))
         .unionByName(iss.select(*P, F.lit(None).cast("long").alias("total_lines"), ordered.alias("item"))))
    g = u.groupBy(*P).agg(F.max("total_lines").alias("log_count"),
                          F.sort_array(F.collect_list("item")).alias("_items"))
    issues = F.transform("_items", lambda x: x["v"])
    worst = F.array_max(F.transform(issues, lambda i: severity_rank(i["severity"])))
    status, summary = _status(worst), _summary(F.size(issues), F.col("log_count"))
    return g.select(*keys, "period_start", F.col("period_end").alias("ts"),
                    status.alias("overall_status"), summary.alias("summary"),
                    F.col("log_count").cast("long").alias("log_count"),
                    F.struct(status.alias("overall_status"), summary.alias("summary"),
                             issues.alias("findings")).alias("payload"))


def issue_rows(parts: dict[str, DataFrame], keys: Sequence[str] = (), min_count: int = DEFAULT_MIN_COUNT,
               rules: DataFrame | None = None) -> DataFrame:
    """The issues of all periods as a table of rows (keys, period_start, ts, the issue's fields, and
    ``order``, by which a payload lists them).

    A period may have any number of issues (masking that fails makes an issue of every elevated
    line), so no row holds a period's issues together. :func:`finding_rows` gives the findings
    that belong to them, :func:`review.review_table` and :func:`recurrence.partials` take them as ``issues``.
    """
    iss = issue_candidates(parts["counts"], parts["sample"], keys, min_count, rules)
    order = F.struct((-F.col("sev_rank")).alias("severity"), (-F.col("occurrences")).alias("occurrences"), F.col("first_rank").alias("rank"), F.col("title").alias("title"))
    return iss.select(*keys, "period_start", F.col("period_end").alias("ts"), *[F.col(f.name).cast(f.dataType) for f in schemas.ISSUE.fields], order.alias("order"))


def finding_rows(stats: DataFrame, issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One finding per period without its issues: status, summary, line and issue counts."""
    per = issues.groupBy(*keys, "period_start", "ts").agg(F.count(F.lit(1)).alias("n_issues"), F.max(severity_rank("severity")).alias("worst"))
    u = (stats.select(*keys, "period_start", F.col("period_end").alias("ts"), F.col("total_lines").alias("log_count"), F.lit(None).cast("long").alias("n_issues"), F.lit(None).cast("int").alias("worst"))
         .unionByName(per.select(*keys, "period_start", "ts", F.lit(None).cast("long").alias("log_count"), "n_issues", F.col("worst").cast("int").alias("worst"))))
    g = u.groupBy(*keys, "period_start", "ts").agg(F.max("log_count").alias("log_count"), F.coalesce(F.max("n_issues"), F.lit(0)).cast("long").alias("n_issues"), F.max("worst").alias("worst"))
    status, summary = _status(F.col("worst")), _summary(F.col("n_issues"), F.col("log_count"))
    return g.select(*keys, "period_start", "ts", status.alias("overall_status"), summary.alias("summary"), F.col("log_count").cast("long").alias("log_count"), "n_issues")


def _status(worst: Column) -> Column:
    return F.when(worst >= 2, "error").when(worst == 1, "warning").otherwise("ok")


def _summary(n: Column, log_count: Column) -> Column:
    return F.when(n == 0, F.format_string("No issues in %d lines", log_count)).otherwise(F.format_string("%d issue(s) in %d lines", n, log_count))


def ordered_type() -> str:
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schemas.ISSUE.fields)
    return f"struct<a:int,b:bigint,c:struct<c:bigint,k:decimal(38,0),t:string>,d:string,v:struct<{fields}>>"


#: One call after another, no retry and no limits.
ONE_BY_ONE = CallPolicy()

# ── plug-in assessors ────────────────────────────────────────────────────────

class Assessor:
    """Plug-in interface: turn one digest into a finding payload dict."""

    def assess(self, digest_text: str, stats: dict) -> dict:  # pragma: no cover - interface
        raise NotImplementedError


class ElevatedCountAssessor(Assessor):
    """Offline stand-in for a model client: status from the elevated share."""

    def assess(self, digest_text: str, stats: dict) -> dict:
        total, elevated = stats["total_lines"], stats["elevated_count"]
        share = elevated / total if total else 0.0
        status = "error" if share >= 0.5 else "warning" if elevated else "ok"
        findings = []
        if elevated:
            findings.append({"severity": "warning" if status == "warning" else "error",
                             "category": "syslog", "title": "Elevated-severity lines",
                             "detail": f"{elevated} of {total} lines at warning or worse",
                             "evidence": digest_text.splitlines()[0],
                             "occurrences": int(elevated), "recommendation": "Review the sample"})
        return {"overall_status": status, "summary": f"{elevated} elevated of {total}",
                "findings": findings}


def assess_with(digests: DataFrame, assessor_factory, keys: Sequence[str] = (), policy: CallPolicy = ONE_BY_ONE) -> DataFrame:
    """Run a plug-in assessor over digest rows with ``mapInPandas``; ``policy`` says how many calls a
    task has in flight, and sets retries, a time limit and a rate.

    ``assessor_factory()`` is called once per task (one client per task).
    A digest whose assessment raises gets ``error`` set and no payload, so a
    caller can keep its input for the next run instead of storing a finding.
    """
    return _assess(digests, assessor_factory, pkeys(keys) + ["total_lines"],
                   ["total_lines", "distinct_patterns", "elevated_count"], policy)


def assess_reviews_with(reviews: DataFrame, assessor_factory, keys: Sequence[str] = (), policy: CallPolicy = ONE_BY_ONE) -> DataFrame:
    """Run a plug-in assessor over review rows (:func:`review.build_reviews`).

    Its stats are ``finding_count``, ``distinct_findings`` and ``status_counts`` (a
    dict); failures are marked as in :func:`assess_with`.
    """
    kept = [*keys, "ts", "period_start", "period_end", "window_days", "finding_count", "distinct_findings"]
    return _assess(reviews, assessor_factory, kept, ["finding_count", "distinct_findings", "status_counts"], policy)


def _assess(digests: DataFrame, assessor_factory, kept: list[str], stat_cols: list[str], policy: CallPolicy) -> DataFrame:
    cols = list(dict.fromkeys([*kept, *stat_cols, "digest_text"]))
    out_schema = (", ".join(f"`{c}` {t}" for c, t in _types(digests, kept))
                  + ", payload_json string, error string")

    def plain(value):
        if isinstance(value, (dict, list)):  # a map arrives as a dict or as pairs
            return {k: int(v) for k, v in dict(value).items()}
        return int(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        assessor = assessor_factory()
        # an answer that isn't JSON is the call's failure, too
        caller = Caller(lambda text, stats: json.dumps(assessor.assess(text, stats)), policy)
        for pdf in batches:
            answers = caller.all((row.digest_text, {c: plain(getattr(row, c)) for c in stat_cols}) for row in pdf.itertuples(index=False))
            payloads, errors = [a for a, _ in answers], [e for _, e in answers]  # a failed row is kept and marked
            out = pdf[kept].copy()
            out["payload_json"] = payloads
            out["error"] = errors
            yield out

    return digests.select(*cols).mapInPandas(run, out_schema)


def _types(df: DataFrame, cols: list[str]) -> list[tuple[str, str]]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(c, types[c]) for c in cols]
