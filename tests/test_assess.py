"""Rules assessor: benign drop, escalation merge, thresholds, default rule, status."""

import datetime as dt
from decimal import Decimal

from logsift.operators import assess as A
from logsift.operators import digest as D

P0 = dt.datetime(2024, 1, 1, 10)
P1 = P0 + dt.timedelta(hours=1)


def _parts(spark, templates, sample, total):
    t = spark.createDataFrame(
        [(P0, P1, tmpl, count, Decimal(rank), elev, worst, None if key is None else Decimal(key))
         for tmpl, count, rank, elev, worst, key in templates],
        "period_start timestamp, period_end timestamp, template string, count long, first_key decimal(38,0), "
        "elevated long, worst_severity int, first_elevated_key decimal(38,0)")
    s = spark.createDataFrame(
        [(P0, P1, Decimal(key), msg) for key, msg in sample],
        "period_start timestamp, period_end timestamp, seen_key decimal(38,0), message string")
    st = spark.createDataFrame([(P0, P1, total, len(templates), sum(x[3] for x in templates))],
                               "period_start timestamp, period_end timestamp, total_lines long, "
                               "distinct_patterns long, elevated_count long")
    return {"counts": t, "sample": s, "stats": st}


def test_rules_assessor(spark):
    templates = [
        # template, count, first key, elevated, worst syslog severity, first elevated key
        ("svc-daemon Got notification message from PID <N>, but reception only permitted", 50, 1, 50, 3, 11),
        ("openvpn client: TLS handshake failed with <IP>", 3, 2, 3, 3, 12),
        ("openvpn peer auth error for <IP>", 2, 3, 0, 6, None),
        ("kernel: link up eth<N>", 9, 4, 0, 6, None),
        ("dhcpd: lease conflict for <IP>", 4, 5, 4, 4, 13),
        ("sshd: Failed password for root from <IP>", 2, 6, 2, 4, 14),
        ("disk almost full", 1, 7, 1, 2, 15),
    ]
    sample = [(12, "openvpn client: TLS handshake failed with 1.2.3.4"),
              (13, "dhcpd: lease conflict for 10.0.0.7")]
    f = A.assess_rules(_parts(spark, templates, sample, 100)).collect()
    assert len(f) == 1
    p = f[0]["payload"]
    issues = [(i["title"], i["severity"], i["category"], i["occurrences"], i["evidence"]) for i in p["findings"]]
    assert issues == [
        # default rule: a single line of syslog severity 2 is an issue of its own
        ("disk almost full", "critical", "syslog", 1, "disk almost full"),
        # escalation rule, both VPN templates merged, evidence = earliest sampled line
        ("VPN authentication failures", "error", "vpn", 5, "openvpn client: TLS handshake failed with 1.2.3.4"),
        # default rule: elevated template, worst severity 4 -> warning, evidence from the sample
        ("dhcpd: lease conflict for <IP>", "warning", "syslog", 4, "dhcpd: lease conflict for 10.0.0.7"),
    ]
    # benign systemd noise dropped; failed logins below their min_count 3; the link-up line is not
    # elevated
    assert f[0]["overall_status"] == "error" and p["overall_status"] == "error"
    assert f[0]["summary"] == "3 issue(s) in 100 lines" and f[0]["log_count"] == 100


def test_period_without_issues_is_ok(spark):
    f = A.assess_rules(_parts(spark, [("kernel: link up eth<N>", 9, 1, 0, 6, None)], [], 9)).collect()
    assert f[0]["overall_status"] == "ok" and f[0]["payload"]["findings"] == []
    assert f[0]["summary"] == "No issues in 9 lines"


def test_end_to_end_from_lines(spark):
    t0 = P0
    rows = [(i, t0 + dt.timedelta(seconds=i), "gw", 3, f"openvpn[{100 + i}]: TLS Error: TLS handshake failed 10.0.0.{i}")
            for i in range(4)]
    rows += [(10 + i, t0 + dt.timedelta(seconds=10 + i), "gw", 4,
              "systemd[1]: Got notification message from PID 42, but reception only permitted for main PID 1")
             for i in range(6)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, host string, severity int, message string")
    f = A.assess_rules(D.digest_parts(df)).collect()[0]
    assert [(i["title"], i["occurrences"]) for i in f["payload"]["findings"]] == [("VPN authentication failures", 4)]
    assert f["payload"]["findings"][0]["evidence"].startswith("openvpn[100]: TLS Error")


def test_plugin_failure_marks_row_and_keeps_going(spark):
    class _Flaky(A.Assessor):  # defined here so the worker receives it by value
        def assess(self, digest_text, stats):
            if stats["total_lines"] > 3:
                raise RuntimeError("model unavailable")
            return {"overall_status": "ok", "summary": "fine", "findings": []}

    rows = [(i, P0 + dt.timedelta(minutes=i * 30), "h", 6, f"m {i}") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, host string, severity int, message string")
    digests = D.build_digests(df, period="60 minutes")
    out = {r["period_start"]: r for r in A.assess_with(digests, _Flaky).collect()}
    assert len(out) == 3 and all(r["error"] is None and r["payload_json"] for r in out.values())
    many = D.build_digests(df, period="1 day").collect()[0]
    assert many["total_lines"] == 6
    bad = A.assess_with(D.build_digests(df, period="1 day"), _Flaky).collect()[0]
    assert bad["payload_json"] is None and bad["error"].startswith("RuntimeError: model unavailable")


def test_rare_severe_line_behind_many_templates(spark):
    """More templates than the digest shows: the rare severe ones are still assessed."""
    def word(i):
        return "abcdefghij"[i // 10] + "klmnopqrst"[i % 10]
    rows = [(3 * i + k, P0 + dt.timedelta(seconds=i), "gw", 5, f"noise {word(i)}") for i in range(70) for k in range(3)]
    rows += [(900, P0, "gw", 2, "kernel: hardware error"), (901, P0, "gw", 4, "No space left on device"), (902, P0, "gw", 4, "No space left on device")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, host string, severity int, message string")
    f = A.assess_rules(D.digest_parts(df)).collect()[0]
    assert [(i["title"], i["occurrences"]) for i in f["payload"]["findings"]] == [("Resource exhaustion", 2), ("Hardware fault", 1)]


def test_repeated_ids_do_not_multiply_lines(spark):
    rows = [(0, P0, "h", 3, "fail x")] * 5 + [(0, P0, "h", 3, "boom y")] * 3
    df = spark.createDataFrame(rows, "id long, ts timestamp, host string, severity int, message string")
    f = A.assess_rules(D.digest_parts(df)).collect()[0]
    assert {i["title"]: i["occurrences"] for i in f["payload"]["findings"]} == {"fail x": 5, "boom y": 3}


def test_plugin_results_to_findings(spark):
    from logsift.operators import findings as FS
    good = '{"overall_status": "warning", "summary": "s", "findings": []}'
    rows = [(P0, P1, 4, good, None), (P0, P1, 5, '{"findings": []}', None), (P0, P1, 6, None, "RuntimeError: down"),
            (P0, P1, 7, '{"overall_status": "odd", "findings": 3}', None), (P0, P1, 8, "not json", None),
            (P0, P1, 9, '{"overall_status": "ok", "summary": null, "findings": [{"title": null, "category": 5}]}', None)]
    df = spark.createDataFrame(rows, "period_start timestamp, period_end timestamp, total_lines long, payload_json string, error string")
    stored, back = FS.findings_from_payloads(df)
    assert sorted((r.log_count, r.overall_status, r.summary) for r in stored.collect()) == [(4, "warning", "s"), (5, "ok", "")]
    errors = {r.total_lines: r.error for r in back.collect()}
    assert set(errors) == {6, 7, 8, 9} and errors[6] == "RuntimeError: down" and "not a JSON object" in errors[8]
    assert "item bad category" in errors[9] and "item bad title" in errors[9]
