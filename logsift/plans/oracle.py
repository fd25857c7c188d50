"""DuckDB SQL for the registered queries (the correctness oracle).

Written independently of the Spark plans, over the same driver tables. The
syslog view is ASCII, where RE2 (DuckDB) and Java regex agree; whole texts are
masked with the word boundaries written out.
"""

from __future__ import annotations

from . import catalog as C

# The eight masks in their order, written out here so that a change of the
# implementation's own list shows.
MASKS = [
    (r"\b[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}\b", "<MAC>"),
    (r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b", "<IPV6>"),
    (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<IP>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*", "<TS>"),
    (r"\b\d{2}:\d{2}:\d{2}\b", "<TIME>"),
    (r"\b0x[0-9A-Fa-f]+\b", "<HEX>"),
    (r"\b[0-9A-Fa-f]{12,}\b", "<HEX>"),
    (r"\b\d+\b", "<N>"),
]

# Python's whitespace set, spelled out for RE2.
PYWS = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PYWS}+|{PYWS}+$', '', 'g')"


def templ(x: str) -> str:
    for pattern, repl in MASKS:
        x = f"regexp_replace({x}, '{pattern}', '{repl}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def templ_unicode(x: str) -> str:
    """Masks with Unicode word boundaries: RE2 has no lookaround, so the neighbours are matched and
    put back, twice, as matches that share a neighbour are found in turns."""
    word = r"[^\p{L}\p{N}_]"
    for pattern, repl in MASKS:
        core = pattern.replace(r"\d", r"\p{Nd}").replace(r"\S", "[^" + PYWS[1:])
        ends = core.endswith(r"\b")
        core = core.removeprefix(r"\b").removesuffix(r"\b").replace("(\\.", "(?:\\.").replace("(:[", "(?::[")
        tail = rf"($|{word})" if ends else "()"
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|{word})(?:{core}){tail}', '\1{repl}\2', 'g')"
    return f"trim(regexp_replace({x}, '{PYWS}+', ' ', 'g'))"


def ts(v: str) -> str:
    return f"TIMESTAMP '{v}'"


SYSLOG = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
    CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5
      WHEN 'click' THEN 6 WHEN 'view' THEN 7 END AS sev
  FROM events),
ev2 AS (
  SELECT event_id, ts, event_type,
    '<' || CAST((user_id % 24) * 8 + sev AS VARCHAR) || '>' AS pri,
    CASE WHEN user_id % 10 = 0 THEN '-' ELSE 'host-' || CAST(user_id % 10 AS VARCHAR) END AS host,
    event_type || ' user=' || CAST(user_id AS VARCHAR) || ' src=10.' || CAST(user_id % 256 AS VARCHAR)
      || '.0.' || CAST(event_id % 256 AS VARCHAR) || ' amount='
      || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS msg,
    CASE WHEN user_id % 12 = 11 THEN 'High' ELSE CAST(user_id % 12 AS VARCHAR) END AS csev,
    strftime(ts, '%b %d %H:%M:%S') AS bsd,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso
  FROM ev),
syslog AS (
  SELECT event_id AS id, ts,
    CASE event_id % 4
      WHEN 0 THEN pri || bsd || ' ' || host || ' app: ' || msg
      WHEN 1 THEN pri || '1 ' || iso || ' ' || host || ' app ' || CAST(event_id AS VARCHAR) || ' - - ' || msg
      WHEN 2 THEN pri || bsd || ' ' || host || ' CEF:0|Acme|Gateway|1.0|' || CAST(event_id % 500 AS VARCHAR)
        || '|' || event_type || '|' || csev || '|' || msg
      ELSE msg END AS raw
  FROM ev2)"""

HDR = (r"(?s)^(?:1\s+\S+|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$")
NUM = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

PARSED = SYSLOG + f""",
l1 AS (
  SELECT id, ts, raw, {strip('raw')} AS line FROM syslog
  WHERE NOT regexp_matches(raw, '(?s)^\\s*(?:<[0-9]{{1,3}}>\\s*)?$')),
l2 AS (SELECT id, ts, raw, line, regexp_extract(line, '^<([0-9]{{1,3}})>', 1) AS digits FROM l1),
l3 AS (
  SELECT id, ts, raw, digits,
    CASE WHEN digits <> '' THEN {strip("substr(line, length(digits) + 3)")} ELSE line END AS body0
  FROM l2),
l4 AS (
  SELECT *, regexp_extract(body0, '{HDR}', 1) AS h, regexp_extract(body0, '{HDR}', 2) AS rest FROM l3),
l5 AS (
  SELECT id, ts, raw, digits, body0, h,
    CASE WHEN h NOT IN ('-', '') THEN h END AS host,
    CASE WHEN h <> '' THEN {strip('rest')} ELSE body0 END AS message
  FROM l4),
l6 AS (
  SELECT *, CASE WHEN digits <> '' THEN CAST(digits AS INTEGER) END AS pri,
    regexp_matches(message, 'CEF:\\d+\\|') AS is_cef,
    {strip("string_split(substr(message, greatest(instr(message, 'CEF:'), 1)), '|')[7]")} AS cef_field
  FROM l5),
l7 AS (
  SELECT *, CASE WHEN is_cef AND regexp_matches(cef_field, '{NUM}')
    THEN TRY_CAST(cef_field AS DOUBLE) END AS cef_v FROM l6),
l8 AS (
  SELECT *, CASE WHEN cef_v IS NOT NULL AND isfinite(cef_v) THEN
    CASE WHEN cef_v >= 9 THEN 2 WHEN cef_v >= 7 THEN 3 WHEN cef_v >= 4 THEN 4 ELSE 6 END END AS cef_sev
  FROM l7),
lines AS (
  SELECT id, ts, host, pri // 8 AS facility, CAST(coalesce(cef_sev, pri % 8) AS INTEGER) AS severity, message
  FROM l8)"""


def with_period(minutes: int = 60, whole: bool = False, lines: str | None = None) -> str:
    """``whole``: one period spanning all lines, bounded by their min / max ts."""
    if whole:
        start, end = "(SELECT min(ts) FROM lines)", "(SELECT max(ts) FROM lines)"
    else:
        start = ("date_trunc('hour', ts)" if minutes == 60 else
                 f"time_bucket(INTERVAL '{minutes} minutes', ts, TIMESTAMP '1970-01-01')")
        end = f"{start} + INTERVAL '{minutes} minutes'"
    return (lines or PARSED) + f""",
t AS (
  SELECT *, {start} AS period_start, {end} AS period_end,
    {templ('message')} AS template
  FROM lines),
tc AS (
  SELECT period_start, period_end, template, count(*) AS count,
    min({{'t': ts, 'i': id}}) AS first, count(*) FILTER (WHERE severity <= 4) AS elevated,
    min(severity) AS worst_severity
  FROM t GROUP BY period_start, period_end, template),
stats AS (
  SELECT period_start, period_end, CAST(sum(count) AS BIGINT) AS total_lines,
    count(*) AS distinct_patterns, CAST(sum(elevated) AS BIGINT) AS elevated_count
  FROM tc GROUP BY period_start, period_end),
tr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY period_start ORDER BY count DESC, first) AS INTEGER) AS rank
  FROM tc),
hc AS (
  SELECT period_start, host, count(*) AS count, min({{'t': ts, 'i': id}}) AS first
  FROM t WHERE host IS NOT NULL AND host <> '' GROUP BY period_start, host),
hr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY period_start ORDER BY count DESC, first) AS INTEGER) AS rank
  FROM hc),
er AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY period_start ORDER BY ts, id) AS INTEGER) AS rank
  FROM t WHERE severity <= 4)"""


SEVNAME = ("CASE {0} WHEN 0 THEN 'emerg' WHEN 1 THEN 'alert' WHEN 2 THEN 'crit' WHEN 3 THEN 'err' "
           "WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' WHEN 7 THEN 'debug' "
           "ELSE 'unknown' END")
LADDER = ("CASE lower({0}) WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 "
          "WHEN 'critical' THEN 3 ELSE 0 END")


def digest_text(minutes: int = 60, k_t: int = 60, k_h: int = 10, k_s: int = 200,
                max_chars: int = 24000) -> str:
    return with_period(minutes) + f""",
tt AS (SELECT period_start, string_agg(printf('[%6d×] %s', count, template), chr(10) ORDER BY rank) AS tl
       FROM tr WHERE rank <= {k_t} GROUP BY period_start),
ht AS (SELECT period_start, string_agg(host || ' (' || CAST(count AS VARCHAR) || ')', ', ' ORDER BY rank) AS hl
       FROM hr WHERE rank <= {k_h} GROUP BY period_start),
es AS (SELECT period_start, count(*) AS ns,
         string_agg('(' || {SEVNAME.format('severity')} || ') ' || coalesce(nullif(host, ''), '?') || ': ' || message,
                    chr(10) ORDER BY rank) AS sl
       FROM er WHERE rank <= {k_s} GROUP BY period_start),
txt AS (
  SELECT s.period_start, s.period_end,
    'Total syslog lines this period: ' || s.total_lines || chr(10)
    || 'Distinct message patterns: ' || s.distinct_patterns
    || CASE WHEN ht.hl IS NOT NULL THEN chr(10) || 'Source hosts: ' || ht.hl ELSE '' END
    || chr(10) || chr(10) || '=== Top message patterns (pattern × count; volatile values masked) ==='
    || chr(10) || tt.tl || chr(10) || chr(10)
    || '=== Elevated-severity sample (warning or worse), ' || coalesce(es.ns, 0) || ' of '
    || s.elevated_count || ' ==='
    || CASE WHEN es.sl IS NOT NULL THEN chr(10) || es.sl ELSE '' END AS text
  FROM stats s LEFT JOIN tt USING (period_start) LEFT JOIN ht USING (period_start)
  LEFT JOIN es USING (period_start)),
digest AS (
  SELECT period_start, period_end,
    CASE WHEN length(text) > {max_chars} THEN left(text, {max_chars}) || chr(10) || '…[digest truncated]'
      ELSE text END AS digest_text
  FROM txt)"""


# ── rules assessor ───────────────────────────────────────────────────────────

# The rules, written out: pattern, category, title, severity, min_count, recommendation; benign
# ones have no title.
RULES = [
    ("Got notification message from PID", "", "", "info", 1, ""),
    ("recvfrom header: No such file or directory", "", "", "info", 1, ""),
    ("Got no response within <N> seconds", "", "", "info", 1, ""),
    ("service_json event fail, retry", "", "", "info", 1, ""),
    ("(?i)pcap dumping rate exceeded|DPI.*skip", "", "", "info", 1, ""),
    ("(?i)StaTXRetryBurst|tx.?retry|burst_ratio|rssi", "", "", "info", 1, ""),
    ("Netlink error response: Resource busy", "", "", "info", 1, ""),
    ("ARP table does not have IP for", "", "", "info", 1, ""),
    ("peer in L-state", "", "", "info", 1, ""),
    ("(?i)(procd|logread).*(SIGTERM|SIGKILL)", "", "", "info", 1, ""),
    ("(?i)ntpd.*timed out waiting", "time", "NTP time sync failing", "warning", 6, "Check upstream NTP reachability"),
    ("(?i)(openvpn|vpn|tunnel|ipsec|wireguard).*(auth|cert|tls|handshake).*(fail|error)", "vpn", "VPN authentication failures", "error", 1,
     "Check the VPN certificate and credentials"),
    ("(?i)(wan|uplink).*(down|lost|disconnect)", "wan", "WAN / uplink down", "error", 1, "Check the ISP link and modem"),
    ("(?i)(failed password|authentication failure|invalid user|login failed)", "auth", "Failed logins", "warning", 3,
     "Review admin access and source addresses"),
    ("(?i)(intrusion (detected|attempt)|ips alert|(threat|attack) (detected|blocked|event))", "security", "Intrusion signatures", "error", 1,
     "Review the threat events and block the sources"),
    ("(?i)(segfault|core dumped|crash|respawning too fast)", "service", "Service crash", "error", 1, "Check the crashing service and its logs"),
    ("(?i)(no space left|out of memory|oom-killer)", "resources", "Resource exhaustion", "critical", 1, "Free disk space or memory"),
    ("(?i)(hardware error|i/o error|fan fail|overheat)", "hardware", "Hardware fault", "critical", 1, "Inspect the device hardware"),
]


def _arr(i: int, quote: bool = True) -> str:
    vals = [r[i] for r in RULES]
    if quote:
        return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in vals) + "]"
    return "[" + ", ".join(str(v) for v in vals) + "]"


def assessed(whole: bool = False, minutes: int = 60, lines: str | None = None) -> str:
    rule_case = "CASE " + " ".join(
        f"WHEN regexp_matches(template, '{r[0]}') THEN {i}" for i, r in enumerate(RULES)) + " END"
    return with_period(minutes, whole, lines) + f""",
top AS (SELECT * FROM tr),
samp AS (SELECT * FROM er WHERE rank <= {C.D.K_SAMPLES}),
evid AS (SELECT period_start, {templ('message')} AS template, arg_min(message, rank) AS evidence
         FROM samp GROUP BY 1, 2),
ruled AS (SELECT *, {rule_case} AS rule FROM top),
cand AS (
  SELECT r.*, e.evidence AS ev FROM ruled r LEFT JOIN evid e USING (period_start, template)
  WHERE (rule IS NULL OR {_arr(2)}[rule + 1] <> '') AND (rule IS NOT NULL OR elevated > 0)),
iss AS (
  SELECT period_start, period_end, rank, count, worst_severity,
    CASE WHEN rule IS NOT NULL THEN {_arr(2)}[rule + 1] ELSE template END AS title,
    CASE WHEN rule IS NOT NULL THEN {_arr(1)}[rule + 1] ELSE 'syslog' END AS category,
    CASE WHEN rule IS NOT NULL THEN {_arr(3)}[rule + 1] ELSE
      CASE WHEN worst_severity <= 2 THEN 'critical' WHEN worst_severity = 3 THEN 'error'
           WHEN worst_severity = 4 THEN 'warning' END END AS severity,
    CASE WHEN rule IS NOT NULL THEN {_arr(4, False)}[rule + 1] WHEN worst_severity <= 3 THEN 1 ELSE 2 END AS min_count,
    CASE WHEN rule IS NOT NULL THEN {_arr(5)}[rule + 1] ELSE 'Review the source of these messages' END AS recommendation,
    coalesce(ev, template) AS evidence
  FROM cand),
g AS (
  SELECT period_start, period_end, title, CAST(sum(count) AS BIGINT) AS occurrences, count(*) AS patterns,
    min(rank) AS first_rank, max({LADDER.format('severity')}) AS sev_rank,
    min(worst_severity) AS worst_syslog, arg_min(category, rank) AS category,
    arg_min(recommendation, rank) AS recommendation, arg_min(evidence, rank) AS evidence,
    min(min_count) AS min_count
  FROM iss GROUP BY period_start, period_end, title
  HAVING sum(count) >= min(min_count)),
gi AS (
  SELECT *, ['info', 'warning', 'error', 'critical'][sev_rank + 1] AS sev_name,
    printf('%d lines in %d pattern(s); worst syslog severity %s', occurrences, patterns,
           {SEVNAME.format('worst_syslog')}) AS detail,
    CAST(row_number() OVER (PARTITION BY period_start
         ORDER BY sev_rank DESC, occurrences DESC, first_rank, title) - 1 AS INTEGER) AS pos
  FROM g),
per AS (
  SELECT s.period_start, s.period_end, s.total_lines,
    (SELECT max(sev_rank) FROM gi WHERE gi.period_start = s.period_start) AS worst,
    (SELECT count(*) FROM gi WHERE gi.period_start = s.period_start) AS n_issues
  FROM stats s),
fb AS (
  SELECT period_start, period_end AS ts,
    CASE WHEN worst >= 2 THEN 'error' WHEN worst = 1 THEN 'warning' ELSE 'ok' END AS overall_status,
    CASE WHEN n_issues = 0 THEN printf('No issues in %d lines', total_lines)
      ELSE printf('%d issue(s) in %d lines', n_issues, total_lines) END AS summary,
    total_lines AS log_count, n_issues
  FROM per)"""


# ── findings view ───────────────────────────────────────────────────────────

FINDINGS = """
pt AS (
  SELECT date_trunc('hour', ts) AS period_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts,
    event_type, count(*) AS n
  FROM events GROUP BY 1, 2, 3),
iss AS (
  SELECT period_start, ts, event_type AS title,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity,
    'event' AS category, n AS occurrences,
    CAST(n AS VARCHAR) || ' ' || event_type || ' events in the period' AS detail,
    'event_type=' || event_type AS evidence, 'review the event source' AS recommendation,
    CAST(row_number() OVER (PARTITION BY period_start ORDER BY event_type) - 1 AS INTEGER) AS pos
  FROM pt WHERE n >= 4),
fagg AS (
  SELECT period_start, count(*) AS n_issues,
    max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst,
    list({'severity': severity, 'category': category, 'title': title, 'detail': detail,
          'evidence': evidence, 'occurrences': CAST(occurrences AS BIGINT),
          'recommendation': recommendation} ORDER BY pos) AS items
  FROM iss GROUP BY period_start),
fnd AS (
  SELECT p.period_start, p.ts,
    CASE WHEN f.worst = 2 THEN 'error' WHEN f.worst = 1 THEN 'warning' ELSE 'ok' END AS overall_status,
    CAST(coalesce(f.n_issues, 0) AS VARCHAR) || ' issues' AS summary,
    CAST(p.log_count AS BIGINT) AS log_count, coalesce(f.n_issues, 0) AS n_issues, f.items
  FROM (SELECT period_start, ts, sum(n) AS log_count FROM pt GROUP BY 1, 2) p
  LEFT JOIN fagg f USING (period_start)),
fjson AS (
  SELECT period_start, ts, overall_status, summary, log_count,
    to_json({'overall_status': overall_status, 'summary': summary,
             'findings': coalesce(items, [])}) AS payload_json
  FROM fnd)"""

ISSUE_KEYS = "['severity', 'category', 'title', 'detail', 'evidence', 'occurrences', 'recommendation']"
TOP_KEYS = "['overall_status', 'summary', 'findings']"
VALIDATE = f"""
js_in AS (
  SELECT period_start, CAST(NULL AS BIGINT) AS event_id, payload_json AS js FROM fjson
  UNION ALL
  SELECT CAST(NULL AS TIMESTAMP), event_id, props FROM events),
parsed_js AS (
  SELECT *, CASE WHEN json_valid(js) AND json_type(js) = 'OBJECT' THEN json_keys(js) END AS keys,
    CASE WHEN json_valid(js) AND json_type(js) = 'OBJECT' AND json_type(js, '$.findings') = 'ARRAY'
      THEN json_extract(js, '$.findings[*]') END AS items
  FROM js_in),
checked AS (
  SELECT period_start, event_id, CAST(
      (CASE WHEN keys IS NULL THEN 1 ELSE 0 END)
    + (CASE WHEN keys IS NOT NULL AND NOT list_contains(keys, 'overall_status') THEN 1 ELSE 0 END)
    + (CASE WHEN keys IS NOT NULL AND NOT list_contains(keys, 'summary') THEN 1 ELSE 0 END)
    + (CASE WHEN keys IS NOT NULL AND NOT list_contains(keys, 'findings') THEN 1 ELSE 0 END)
    + (CASE WHEN len(list_filter(keys, lambda x: NOT list_contains({TOP_KEYS}, x))) > 0 THEN 1 ELSE 0 END)
    + (CASE WHEN keys IS NOT NULL AND NOT coalesce(json_extract_string(js, '$.overall_status')
              IN ('ok', 'warning', 'error'), FALSE) THEN 1 ELSE 0 END)
    + (CASE WHEN keys IS NOT NULL AND NOT coalesce(json_type(js, '$.summary') = 'VARCHAR', FALSE) THEN 1 ELSE 0 END)
    + (CASE WHEN list_contains(keys, 'findings') AND items IS NULL THEN 1 ELSE 0 END)
    + len(list_filter(['category', 'title', 'detail', 'evidence', 'recommendation'], lambda k: len(list_filter(items,
              lambda i: json_type(i) = 'OBJECT' AND NOT coalesce(json_type(i, '$.' || k) = 'VARCHAR', FALSE))) > 0))
    + (CASE WHEN len(list_filter(items, lambda i: json_type(i) <> 'OBJECT')) > 0 THEN 1 ELSE 0 END)
    + (CASE WHEN len(list_filter(items, lambda i: json_type(i) = 'OBJECT'
              AND len(list_filter({ISSUE_KEYS}, lambda k: NOT list_contains(json_keys(i), k))) > 0)) > 0
            THEN 1 ELSE 0 END)
    + (CASE WHEN len(list_filter(items, lambda i: json_type(i) = 'OBJECT'
              AND len(list_filter(json_keys(i), lambda k: NOT list_contains({ISSUE_KEYS}, k))) > 0)) > 0
            THEN 1 ELSE 0 END)
    + (CASE WHEN len(list_filter(items, lambda i: NOT coalesce(json_extract_string(i, '$.severity')
              IN ('info', 'warning', 'error', 'critical'), FALSE))) > 0 THEN 1 ELSE 0 END)
    + (CASE WHEN len(list_filter(items, lambda i: NOT coalesce(regexp_matches(
              json_extract_string(i, '$.occurrences'), '^-?[0-9]+$'), FALSE))) > 0 THEN 1 ELSE 0 END)
    AS INTEGER) AS n_violations
  FROM parsed_js)"""

REC = """
rec AS (
  SELECT title, count(*) AS hours, CAST(sum(occurrences) AS BIGINT) AS occurrences,
    count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days,
    arg_min(severity, {'t': ts, 'p': pos}) AS severity, arg_min(category, {'t': ts, 'p': pos}) AS category,
    min({'t': ts, 'p': pos}) AS first
  FROM iss GROUP BY title),
recr AS (
  SELECT *, CAST(row_number() OVER (ORDER BY days DESC, hours DESC, first) AS INTEGER) AS rank FROM rec)"""

WD = 7
RH = 6
def review(WD: int) -> str:
    return FINDINGS + f""",
fr AS (
  SELECT f.*, d + INTERVAL {RH} HOUR AS review_ts
  FROM fnd f, unnest(generate_series(CAST(CAST(f.ts AS DATE) - 1 AS TIMESTAMP),
                                    CAST(CAST(f.ts AS DATE) + {WD + 1} AS TIMESTAMP), INTERVAL 1 DAY)) AS g(d)
  WHERE f.ts < d + INTERVAL {RH} HOUR AND f.ts >= d + INTERVAL {RH} HOUR - INTERVAL {WD * 86400} SECOND),
ir AS (
  SELECT i.*, fr.review_ts FROM iss i JOIN fr USING (period_start)),
rrec AS (
  SELECT review_ts, title, count(*) AS hours, CAST(sum(occurrences) AS BIGINT) AS occurrences,
    count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days,
    arg_min(severity, {{'t': ts, 'p': pos}}) AS severity, arg_min(category, {{'t': ts, 'p': pos}}) AS category,
    min({{'t': ts, 'p': pos}}) AS first,
    count(*) FILTER (WHERE ts < review_ts - INTERVAL {WD * 86400 // 2} SECOND) AS first_half,
    count(*) FILTER (WHERE ts >= review_ts - INTERVAL {WD * 86400 // 2} SECOND) AS second_half
  FROM ir GROUP BY review_ts, title),
rt AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY review_ts ORDER BY days DESC, hours DESC, first) AS INTEGER) AS rank,
    CASE WHEN first_half = 0 THEN 'new' WHEN second_half = 0 THEN 'resolved'
      WHEN second_half >= first_half * 1.5 THEN 'increasing'
      WHEN second_half * 1.5 <= first_half THEN 'decreasing' ELSE 'steady' END AS direction
  FROM rrec),
rstat AS (
  SELECT review_ts, count(*) AS finding_count, min(ts) AS period_start, max(ts) AS period_end,
    count(*) FILTER (WHERE overall_status = 'ok') AS n_ok,
    count(*) FILTER (WHERE overall_status = 'warning') AS n_warning,
    count(*) FILTER (WHERE overall_status = 'error') AS n_error
  FROM fr GROUP BY review_ts),
rsum AS (
  SELECT review_ts, count(*) AS ns,
    string_agg(strftime(ts, '%m-%d %H:%M') || ' [' || overall_status || '] ' || summary, chr(10) ORDER BY ts) AS sl
  FROM (SELECT *, row_number() OVER (PARTITION BY review_ts ORDER BY ts DESC) AS back FROM fr)
  WHERE back <= 200 GROUP BY review_ts),
rlines AS (
  SELECT review_ts, count(*) AS distinct_findings,
    string_agg(printf('[%s] %s (%s) — %d day(s) / %d hour(s) / %d occurrences',
                      severity, title, category, days, hours, occurrences), chr(10) ORDER BY rank) AS rl,
    count(*) FILTER (WHERE hours >= 2) AS n_recurring,
    max(CASE WHEN hours >= 2 AND lower(severity) IN ('error', 'critical') THEN 1 ELSE 0 END) AS severe,
    coalesce(string_agg(title, '|' ORDER BY rank) FILTER (WHERE hours >= 2 AND direction IN ('new', 'increasing')), '') AS watch,
    list({{'title': title, 'category': category, 'severity': severity, 'days_seen': CAST(days AS BIGINT),
          'frequency': printf('%d day(s), %d hour(s)', days, hours),
          'detail': printf('%d occurrences in %d hourly evaluations', occurrences, hours),
          'recommendation': 'Investigate the recurring cause'}} ORDER BY rank) FILTER (WHERE hours >= 2) AS ri,
    list({{'title': title, 'direction': direction, 'detail': direction || ' over the review window'}}
         ORDER BY rank) FILTER (WHERE hours >= 2) AS tr,
    list(title ORDER BY rank) FILTER (WHERE hours >= 2 AND direction IN ('new', 'increasing')) AS wl
  FROM rt GROUP BY review_ts),
wk AS (
  SELECT s.review_ts AS ts, s.period_start, s.period_end, {WD} AS window_days,
    CAST(s.finding_count AS BIGINT) AS finding_count,
    CAST(coalesce(l.distinct_findings, 0) AS BIGINT) AS distinct_findings,
    CASE WHEN coalesce(l.severe, 0) = 1 THEN 'action' WHEN coalesce(l.n_recurring, 0) > 0 THEN 'watch'
      ELSE 'ok' END AS period_status,
    CAST(coalesce(l.n_recurring, 0) AS INTEGER) AS n_recurring, coalesce(l.watch, '') AS watchlist,
    'Hourly evaluations reviewed: ' || s.finding_count || ' (from ' || strftime(s.period_start, '%Y-%m-%d %H:%M')
    || ' to ' || strftime(s.period_end, '%Y-%m-%d %H:%M') || ')' || chr(10)
    || 'Status distribution: ok=' || s.n_ok || ', warning=' || s.n_warning || ', error=' || s.n_error
    || chr(10) || chr(10)
    || '=== Recurring findings across the period (title — days seen / hours seen / total occurrences) ==='
    || CASE WHEN l.rl IS NOT NULL THEN chr(10) || l.rl ELSE '' END
    || chr(10) || chr(10) || '=== Hourly summaries (' || m.ns || ' of ' || s.finding_count || ') ==='
    || chr(10) || m.sl AS digest_text,
    l.ri, l.tr, l.wl
  FROM rstat s LEFT JOIN rlines l USING (review_ts) JOIN rsum m USING (review_ts))"""


REVIEW = review(WD)


def _q(cte: str, select: str) -> str:
    return "WITH " + cte.strip() + "\n" + select


def oracle_sql() -> dict[str, str]:
    sev_sel = "WHERE severity <= 4"
    q = {}
    q["frame_lines"] = f"""
SELECT page_id, pos, line FROM (
  SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS line
  FROM (SELECT page_id, string_split(replace(html, chr(13), chr(10)), chr(10)) AS parts FROM pages))
WHERE length({strip('line')}) > 0"""
    q["parse_pri"] = _q(SYSLOG + f""",
pp AS (SELECT id, regexp_extract({strip('raw')}, '^<([0-9]{{1,3}})>', 1) AS digits FROM syslog)""",
                        "SELECT id, CASE WHEN digits <> '' THEN CAST(digits AS INTEGER) END AS pri, "
                        "CASE WHEN digits <> '' THEN CAST(digits AS INTEGER) // 8 END AS facility, "
                        "CASE WHEN digits <> '' THEN CAST(digits AS INTEGER) % 8 END AS pri_severity FROM pp")
    q["parse_header"] = _q(PARSED.split(",\nl5 AS")[0],
                           "SELECT id, CASE WHEN h <> '' THEN CASE WHEN body0 LIKE '1%' THEN 'rfc5424' "
                           "ELSE 'rfc3164' END END AS header FROM l4 UNION ALL SELECT id, NULL FROM syslog "
                           f"WHERE regexp_matches(raw, '(?s)^\\s*(?:<[0-9]{{1,3}}>\\s*)?$')")
    q["cef_severity"] = _q(PARSED, "SELECT id, cef_sev AS cef_severity FROM l8")
    q["parse_line"] = _q(PARSED, "SELECT id, host, facility, severity, message FROM lines")
    q["severity_name"] = _q(PARSED, f"SELECT id, severity, {SEVNAME.format('severity')} AS severity_name FROM lines")
    q["templatize"] = _q(PARSED, f"SELECT id, {templ('message')} AS template FROM lines")
    q["mask_tokens"] = _q(SYSLOG, f"SELECT id, {templ('raw')} AS masked FROM syslog")
    q["logs_until"] = _q(PARSED, "SELECT id, ts, host, severity, message FROM lines "
                                 f"WHERE ts <= {ts(C.CUTOFF)}")
    q["elevated_filter"] = _q(PARSED, f"SELECT id, ts, severity, message FROM lines {sev_sel}")
    q["template_counts"] = _q(with_period(), "SELECT period_start, period_end, template, count, "
                                             "first.t AS first_ts, first.i AS first_id, elevated, worst_severity FROM tc")
    q["host_counts"] = _q(with_period(), "SELECT period_start, host, count, first.t AS first_ts, "
                                         "first.i AS first_id FROM hc")
    q["top_hosts"] = _q(with_period(), f"SELECT period_start, rank, host, count FROM hr WHERE rank <= {C.SMALL_K}")
    q["top_templates"] = _q(with_period(), f"SELECT period_start, rank, template, count FROM tr "
                                           f"WHERE rank <= {C.SMALL_K}")
    q["elevated_sample"] = _q(with_period(), f"SELECT period_start, rank, id, host, severity, message FROM er "
                                             f"WHERE rank <= {C.SAMPLE_K}")
    q["digest_stats"] = _q(with_period(), "SELECT period_start, total_lines, distinct_patterns, elevated_count "
                                          "FROM stats")
    q["render_digest"] = _q(digest_text(), "SELECT period_start, period_end, digest_text FROM digest")
    q["tumbling_digest"] = _q(with_period(180),
                              "SELECT s.period_start, s.period_end, total_lines, distinct_patterns, elevated_count, "
                              "tr.template AS top_template FROM stats s JOIN tr ON tr.period_start = s.period_start "
                              "AND tr.rank = 1")
    q["assess_rules"] = _q(assessed(), "SELECT period_start, pos, title, sev_name AS severity, category, "
                                       "occurrences, evidence FROM gi")
    q["findings_build"] = _q(assessed(), """
SELECT fb.period_start, fb.ts, fb.overall_status, fb.summary, fb.log_count, CAST(fb.n_issues AS INTEGER) AS n_issues,
  to_json({'overall_status': fb.overall_status, 'summary': fb.summary, 'findings': coalesce(
    (SELECT list({'severity': sev_name, 'category': category, 'title': title, 'detail': detail,
                  'evidence': evidence, 'occurrences': occurrences, 'recommendation': recommendation}
                 ORDER BY pos) FROM gi WHERE gi.period_start = fb.period_start), [])}) AS payload_json
FROM fb""")
    # findings family
    q["payload_roundtrip"] = _q(FINDINGS, "SELECT period_start, payload_json, TRUE AS roundtrip_equal FROM fjson")
    q["validate_payload"] = _q(FINDINGS + ",\n" + VALIDATE, """
SELECT period_start, event_id, n_violations, n_violations = 0 AS is_valid FROM checked""")
    q["findings_since"] = _q(FINDINGS, f"SELECT period_start, ts, overall_status, log_count FROM fnd "
                                       f"WHERE ts >= {ts(C.SINCE)}")
    cutoff = f"{ts(C.NOW)} - INTERVAL {C.RETENTION_DAYS * 86400} SECOND"
    q["retention_keep"] = _q(FINDINGS, f"SELECT period_start, ts, overall_status FROM fnd WHERE ts >= {cutoff}")
    q["retention_counts"] = _q(FINDINGS, f"SELECT count(*) FILTER (WHERE ts >= {cutoff}) AS kept, "
                                         f"count(*) FILTER (WHERE ts < {cutoff}) AS removed FROM fnd")
    q["latest_finding"] = _q(FINDINGS, "SELECT period_start, ts, overall_status, summary, log_count FROM fnd "
                                       "ORDER BY ts DESC LIMIT 1")
    q["finding_history"] = _q(FINDINGS, "SELECT period_start, ts, overall_status FROM fnd ORDER BY ts DESC LIMIT 200")
    q["monitor_snapshot"] = _q(PARSED + "," + FINDINGS,
                               "SELECT (SELECT count(*) FROM lines) AS buffered_logs, "
                               "(SELECT count(*) FROM fnd) AS findings_stored, "
                               "(SELECT max(ts) FROM fnd) AS last_evaluation_ts")
    tz = C.LABEL_TZ
    loc = f"timezone('{tz}', ts AT TIME ZONE 'UTC')"
    q["local_day"] = _q(FINDINGS, f"SELECT period_start, ts, strftime({loc}, '%Y-%m-%d') AS day, "
                                  f"strftime({loc}, '%Y-%m-%d %H:%M') AS minute, "
                                  f"strftime({loc}, '%m-%d %H:%M') AS short FROM fnd")
    q["explode_issues"] = _q(FINDINGS, "SELECT period_start, ts, pos, title, severity, category, occurrences FROM iss")
    q["severity_rank"] = _q(FINDINGS, f"SELECT period_start, pos, severity, {LADDER.format('severity')} AS severity_rank "
                                      "FROM iss")
    q["status_distribution"] = _q(FINDINGS, "SELECT count(*) FILTER (WHERE overall_status = 'ok') AS ok, "
                                            "count(*) FILTER (WHERE overall_status = 'warning') AS warning, "
                                            "count(*) FILTER (WHERE overall_status = 'error') AS error FROM fnd")
    q["recurrence"] = _q(FINDINGS + "," + REC, "SELECT title, severity, category, days, hours, occurrences FROM rec")
    q["recurrence_ranked"] = _q(FINDINGS + "," + REC, "SELECT rank, title, days, hours FROM recr")
    q["weekly_stats"] = _q(FINDINGS + "," + REC, "SELECT (SELECT count(*) FROM fnd) AS finding_count, "
                                                 "(SELECT count(*) FROM rec) AS distinct_findings, "
                                                 "(SELECT min(ts) FROM fnd) AS period_start, "
                                                 "(SELECT max(ts) FROM fnd) AS period_end")
    q["weekly_sample"] = _q(FINDINGS, "SELECT ts, overall_status, summary FROM fnd ORDER BY ts DESC LIMIT 200")
    q["rolling_recurrence"] = _q(REVIEW, "SELECT review_ts, rank, title, severity, category, days, hours, "
                                         "occurrences FROM rt")
    q["trend_direction"] = _q(REVIEW, "SELECT review_ts, title, first_half, second_half, direction FROM rt")
    q["review_rules"] = _q(REVIEW, "SELECT ts, period_status, n_recurring, watchlist FROM wk")
    q["render_weekly"] = _q(REVIEW, "SELECT ts, digest_text FROM wk")
    q["weekly_build"] = _q(REVIEW, """
SELECT ts, period_start, period_end, window_days, finding_count, distinct_findings,
  to_json({'period_status': period_status,
           'overall_assessment': printf('%d evaluations reviewed; %d recurring issue(s); status %s.',
                                        finding_count, n_recurring, period_status),
           'recurring_issues': coalesce(ri, []), 'trends': coalesce(tr, []),
           'watchlist': coalesce(wl, [])}) AS payload_json
FROM wk""")
    q["latest_weekly"] = _q(REVIEW, "SELECT ts, period_start, period_end, finding_count FROM wk ORDER BY ts DESC LIMIT 1")
    q["weekly_history"] = _q(REVIEW, "SELECT ts, finding_count FROM wk ORDER BY ts DESC LIMIT 30")
    thr = 1  # rank of C.ALERT_THRESHOLD ('warning')
    q["alert_select"] = _q(FINDINGS, f"""
SELECT f.period_start, f.ts, CAST(count(*) AS INTEGER) AS n_selected
FROM fnd f JOIN iss i USING (period_start)
WHERE {LADDER.format('i.severity')} >= {thr} GROUP BY f.period_start, f.ts""")
    q["alert_render"] = _q(FINDINGS, f"""
SELECT f.period_start,
  '[logsift] ' || upper(f.overall_status) || ': ' || left(f.summary, 80) AS subject,
  'Overall status: ' || upper(f.overall_status) || chr(10) || 'Summary: ' || f.summary || chr(10) || chr(10)
  || 'Findings:' || chr(10) || string_agg(
    '  [' || upper(i.severity) || '] ' || i.title || ' (' || i.category || ', x' || CAST(i.occurrences AS VARCHAR)
    || ')' || chr(10) || '    ' || i.detail || chr(10) || '    Evidence: ' || i.evidence || chr(10)
    || '    Recommendation: ' || i.recommendation || chr(10), chr(10) ORDER BY i.pos) AS body
FROM fnd f JOIN iss i USING (period_start)
WHERE {LADDER.format('i.severity')} >= {thr} GROUP BY f.period_start, f.overall_status, f.summary""")
    # streaming and plug-in queries
    q["ingest_stream"] = _q(PARSED, "SELECT id, ts, host, facility, severity, message FROM lines")
    q["stream_top_templates"] = _q(with_period(), "SELECT period_start, rank, template, count FROM tr "
                                                  "WHERE rank <= 3")
    q["consume_once"] = _q(assessed(whole=True),
                           "SELECT CAST(0 AS BIGINT) AS batch_id, fb.period_start, ts, overall_status, summary, "
                           "log_count, CAST(n_issues AS INTEGER) AS n_issues, title, occurrences, evidence "
                           "FROM fb LEFT JOIN gi ON gi.period_start = fb.period_start")
    q["assess_plugin"] = _q(with_period(), """
SELECT period_start, period_end,
  '{"overall_status": "' || st || '", "summary": "' || elevated_count || ' elevated of ' || total_lines
  || '", "findings": ' || CASE WHEN elevated_count > 0 THEN
    '[{"severity": "' || CASE WHEN st = 'warning' THEN 'warning' ELSE 'error' END
    || '", "category": "syslog", "title": "Elevated-severity lines", "detail": "' || elevated_count || ' of '
    || total_lines || ' lines at warning or worse", "evidence": "Total syslog lines this period: ' || total_lines
    || '", "occurrences": ' || elevated_count || ', "recommendation": "Review the sample"}]'
    ELSE '[]' END || '}' AS payload_json,
  CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, CASE WHEN 2 * elevated_count >= total_lines AND total_lines > 0 THEN 'error'
                     WHEN elevated_count > 0 THEN 'warning' ELSE 'ok' END AS st FROM stats)""")
    q["plugin_findings"] = _q(with_period(), """
SELECT period_start, period_end AS ts, CASE WHEN total_lines % 3 = 2 THEN 'ok' WHEN 2 * elevated_count >= total_lines THEN 'error'
    WHEN elevated_count > 0 THEN 'warning' ELSE 'ok' END AS overall_status,
  CASE WHEN total_lines % 3 = 2 THEN '' ELSE elevated_count || ' elevated of ' || total_lines END AS summary,
  total_lines AS log_count, CAST(elevated_count > 0 AS INTEGER) AS n_issues
FROM stats WHERE total_lines % 3 <> 1""")
    q["plugin_errors"] = _q(with_period(), "SELECT period_start, period_end, total_lines, 'RuntimeError: no answer' AS error "
                                           "FROM stats WHERE total_lines % 3 = 1")
    q["review_plugin"] = _q(REVIEW, """
SELECT w.ts, w.finding_count, w.distinct_findings,
  printf('{"period_status": "%s", "overall_assessment": "%d of %d", "recurring_issues": [], "trends": [], '
         || '"watchlist": ["Status distribution: ok=%d, warning=%d, error=%d"]}',
         CASE WHEN n_error > 0 THEN 'action' ELSE 'ok' END, n_error, s.finding_count, n_ok, n_warning, n_error) AS payload_json,
  CAST(NULL AS VARCHAR) AS error, CAST(0 AS INTEGER) AS n_violations
FROM wk w JOIN rstat s ON s.review_ts = w.ts""")
    q["append_replay"] = _q(FINDINGS, """
SELECT 'a' AS source_id, CAST(0 AS BIGINT) AS batch_id, period_start, ts, overall_status, log_count FROM fnd
UNION ALL SELECT 'b', 0, period_start, ts, overall_status, log_count FROM fnd WHERE hour(period_start) % 2 = 0""")
    q["rare_severe"] = _q(assessed(minutes=1440, lines="""
lines AS (
  SELECT event_id AS id, ts, CAST(NULL AS VARCHAR) AS host, CASE WHEN event_id % 997 = 0 THEN 2 WHEN event_id % 991 = 1 THEN 1 ELSE 5 END AS severity,
    CASE WHEN event_id % 997 = 0 THEN 'kernel: hardware error in bank ' || (event_id % 8)
         WHEN event_id % 991 = 1 THEN 'daemon ' || chr((97 + event_id % 9)::INT) || chr((107 + (event_id // 9) % 10)::INT) || ' gave up'
         ELSE 'worker ' || chr((97 + event_id % 9)::INT) || chr((107 + (event_id // 9) % 10)::INT) || ' done in ' || (event_id % 50) END AS message
  FROM events)"""), "SELECT period_start, pos, title, sev_name AS severity, category, occurrences, evidence FROM gi")
    q["review_as_of"] = _q(FINDINGS, f"""
SELECT {ts(C.AS_OF)} AS ts, min(f.ts) AS period_start, max(f.ts) AS period_end, count(*) AS finding_count,
  (SELECT count(DISTINCT title) FROM iss i WHERE i.ts >= {ts(C.AS_OF)} - INTERVAL {WD * 86400} SECOND AND i.ts < {ts(C.AS_OF)}) AS distinct_findings
FROM fnd f WHERE f.ts >= {ts(C.AS_OF)} - INTERVAL {WD * 86400} SECOND AND f.ts < {ts(C.AS_OF)} HAVING count(*) > 0""")
    q["validate_weekly"] = _q(REVIEW + """,
weekly_keys AS (SELECT ['period_status', 'overall_assessment', 'recurring_issues', 'trends', 'watchlist'] AS want),
props AS (SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN json_keys(props) END AS keys FROM events)""", """
SELECT ts, CAST(NULL AS BIGINT) AS event_id, 0 AS n_violations FROM wk
UNION ALL
SELECT CAST(NULL AS TIMESTAMP), event_id, CAST(CASE WHEN keys IS NULL THEN 1 ELSE len(list_filter(want, lambda k: NOT list_contains(keys, k)))
  + (CASE WHEN len(list_filter(keys, lambda k: NOT list_contains(want, k))) > 0 THEN 1 ELSE 0 END) + 2 END AS INTEGER)
FROM props, weekly_keys""")
    for name, table, cols, text in (("templatize_documents", "documents", "doc_id", "text"), ("templatize_conversations", "conversations", "conv_id, turn", "text")):
        q[name] = f"SELECT {cols}, {templ_unicode(text)} AS template FROM {table}"
    q["hard_lines"] = """
SELECT event_id AS "offset", 0 AS pos, 'gw' AS host, 5 AS severity, 'link aa:bb:cc:dd:ee:ff up ' || event_id AS message, 'link <MAC> up <N>' AS template
FROM events WHERE event_id % 6 = 0
UNION ALL SELECT event_id, 0, 'h2', 3, 'at 0xDEAD' || event_id || ' run deadbeefcafe' || event_id || ' ' || chr(65533) || ' x', 'at <HEX> run <HEX> ' || chr(65533) || ' x'
FROM events WHERE event_id % 6 = 2
UNION ALL SELECT event_id, p, NULL, NULL, w || ' ' || event_id, w || ' <N>' FROM events, (VALUES (0, 'seq'), (3, 'tail')) v(p, w) WHERE event_id % 6 = 3
UNION ALL SELECT event_id, 0, 'h4', 7, 'from 2001:db8:0:0:0:0:0:1 to 10.0.0.' || (event_id % 256), 'from <IPV6> to <IP>' FROM events WHERE event_id % 6 = 4"""
    q["receive_time"] = """
SELECT severity, count(*) AS n, count(*) AS stamped, CAST(1 AS BIGINT) AS instants FROM (
  SELECT CASE event_id % 6 WHEN 0 THEN 5 WHEN 2 THEN 3 WHEN 4 THEN 7 END AS severity FROM events WHERE event_id % 6 IN (0, 2, 3, 4)
  UNION ALL SELECT NULL FROM events WHERE event_id % 6 = 3) GROUP BY severity"""
    q["consume_batch"] = _q(PARSED, """
SELECT CAST(CASE WHEN ts <= TIMESTAMP '2024-01-08 03:30:00' THEN 0 WHEN ts <= TIMESTAMP '2024-01-16 12:00:00' THEN 1 ELSE 2 END AS BIGINT) AS run,
  CAST(id % 2 AS INTEGER) AS site, min(ts) AS period_start, max(ts) AS ts, count(*) AS log_count
FROM lines WHERE ts <= TIMESTAMP '2024-02-15 00:00:00' GROUP BY 1, 2""")
    q["closed_periods"] = _q(with_period() + """,
arrived AS (
  SELECT period_start, period_end, template, severity, ts,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS file FROM t),
batches AS (
  SELECT file, row_number() OVER (ORDER BY file) AS batch, max(max(ts)) OVER (ORDER BY file) AS newest FROM arrived GROUP BY file),
closing AS (
  SELECT p.period_start, min(b.batch) AS batch FROM (SELECT DISTINCT period_start, period_end FROM arrived) p
  JOIN batches b ON p.period_end + INTERVAL 1 HOUR <= b.newest GROUP BY p.period_start)""", """
SELECT a.period_start, a.period_end, a.template, count(*) AS count, count(*) FILTER (WHERE severity <= 4) AS elevated,
  min(severity) AS worst_severity, nullif(count(*) FILTER (WHERE b.batch <= c.batch), 0) AS count_at_close,
  count(DISTINCT CASE WHEN b.batch > c.batch THEN b.batch END) AS corrections
FROM arrived a JOIN batches b ON b.file = a.file JOIN closing c ON c.period_start = a.period_start
GROUP BY a.period_start, a.period_end, a.template""")
    q["assess_rule_table"] = f"""
WITH lines AS (
  SELECT event_id AS id, ts, CAST(event_id % 4 AS INTEGER) AS site, CASE WHEN event_id % 997 = 0 THEN 2 WHEN event_id % 991 = 1 THEN 1 ELSE 5 END AS severity,
    CASE WHEN event_id % 997 = 0 THEN 'kernel: hardware error in bank ' || (event_id % 8)
         WHEN event_id % 991 = 1 THEN 'daemon ' || chr((97 + event_id % 9)::INT) || chr((107 + (event_id // 9) % 10)::INT) || ' gave up'
         ELSE 'worker ' || chr((97 + event_id % 9)::INT) || chr((107 + (event_id // 9) % 10)::INT) || ' done in ' || (event_id % 50) END AS message
  FROM events),
counted AS (
  SELECT site, date_trunc('day', ts) AS period_start, {templ('message')} AS template, count(*) AS count, min({{'t': ts, 'i': id}}) AS first,
    count(*) FILTER (WHERE severity <= 4) AS elevated, min(severity) AS worst
  FROM lines GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, period_start ORDER BY count DESC, first, template) AS rank FROM counted),
keyed AS (
  SELECT c_custkey AS k, c_name, c_nationkey % 5 AS nation, chr((97 + c_custkey % 9)::INT) || chr((107 + (c_custkey // 9) % 10)::INT) AS pair,
    chr((97 + (c_custkey // 5) % 9)::INT) || chr((107 + c_custkey % 10)::INT) AS other FROM customer),
rules AS (
  SELECT CASE WHEN nation < 4 THEN nation END AS site, k % 97 AS position, CASE WHEN k % 3 = 0 THEN 'benign' ELSE 'escalate' END AS kind,
    CASE k % 5 WHEN 0 THEN '(?i)WORKER ' || pair || ' done' WHEN 1 THEN 'daemon (' || pair || '|' || other || ') gave'
      WHEN 2 THEN 'er ' || other || '.* in <N>$' WHEN 3 THEN 'bank +<N>|nothing like customer ' || k ELSE '^w\\w+ ' || pair || ' ' END AS pattern,
    'rule ' || (k % 11) AS title, CASE WHEN k % 2 = 0 THEN 'warning' ELSE 'error' END AS severity, k % 4 AS min_count, 'ask ' || c_name AS recommendation
  FROM keyed),
texts AS (SELECT DISTINCT site, template FROM counted),
matched AS (
  SELECT t.site, t.template, r.* EXCLUDE (site) FROM texts t JOIN rules r
    ON (r.site IS NULL OR r.site = t.site) AND regexp_matches(t.template, r.pattern)
  QUALIFY row_number() OVER (PARTITION BY t.site, t.template ORDER BY position, pattern, title, kind, severity, min_count, recommendation) = 1),
kept AS (
  SELECT r.site, r.period_start, rank, count, worst, coalesce(m.title, r.template) AS title,
    CASE WHEN m.title IS NOT NULL THEN 'customer' ELSE 'syslog' END AS category,
    coalesce(m.severity, CASE WHEN worst <= 2 THEN 'critical' WHEN worst = 3 THEN 'error' ELSE 'warning' END) AS severity,
    coalesce(m.min_count, CASE WHEN worst <= 3 THEN 1 ELSE 2 END) AS min_count,
    coalesce(m.recommendation, 'Review the source of these messages') AS recommendation
  FROM ranked r LEFT JOIN matched m ON m.site = r.site AND m.template = r.template
  WHERE CASE WHEN m.title IS NOT NULL THEN m.kind <> 'benign' ELSE elevated > 0 END),
issues AS (
  SELECT site, period_start, title, CAST(sum(count) AS BIGINT) AS occurrences, min(rank) AS first_rank, max({LADDER.format('severity')}) AS sev,
    arg_min(category, rank) AS category, arg_min(recommendation, rank) AS recommendation
  FROM kept GROUP BY site, period_start, title HAVING sum(count) >= min(min_count))
SELECT site, period_start, CAST(row_number() OVER (PARTITION BY site, period_start ORDER BY sev DESC, occurrences DESC, first_rank, title) - 1 AS INTEGER) AS pos,
  title, ['info', 'warning', 'error', 'critical'][sev + 1] AS severity, category, occurrences, recommendation
FROM issues"""
    q["rolling_year"] = _q(review(365).split(",\nrstat AS")[0],
                           "SELECT review_ts, rank, title, severity, category, days, hours, occurrences, first_half, second_half, direction FROM rt")
    noisy = """
WITH lines AS (
  SELECT event_id AS id, ts, date_trunc('day', ts) AS period_start,
    CASE WHEN event_id % 3 = 0 OR day(ts) % 5 < 2 THEN 'lone ' || translate(CAST(event_id AS VARCHAR), '0123456789', 'klmnopqrst')
         ELSE 'often ' || chr(CAST(97 + least(event_id % 64, 7 + event_id % 2) AS INTEGER)) END AS template FROM events)"""
    q["top_templates_two_pass"] = noisy + """
SELECT period_start, rank, template, count FROM (
  SELECT period_start, template, count(*) AS count,
    CAST(row_number() OVER (PARTITION BY period_start ORDER BY count(*) DESC, min({'t': ts, 'i': id}), template) AS INTEGER) AS rank
  FROM lines GROUP BY period_start, template) WHERE rank <= 3"""
    q["distinct_sketches"] = noisy + """
SELECT period_start, count(DISTINCT template) AS exact, TRUE AS within_error FROM lines GROUP BY period_start
UNION ALL SELECT NULL, count(DISTINCT template), TRUE FROM lines"""
    odd = [("7 minutes", "time_bucket(INTERVAL '7 minutes', ts, TIMESTAMP '2024-01-01 00:03:00')", "s + INTERVAL 7 MINUTE"),
           ("50 minutes", "time_bucket(INTERVAL '50 minutes', ts, TIMESTAMP '2024-01-01 00:03:00')", "s + INTERVAL 50 MINUTE"),
           ("300 minutes", "date_trunc('day', ts) + INTERVAL 5 HOUR * (hour(ts) // 5)", "least(s + INTERVAL 5 HOUR, date_trunc('day', s) + INTERVAL 1 DAY)")]
    q["odd_periods"] = _q(PARSED, " UNION ALL ".join(
        f"SELECT s AS period_start, {end} AS period_end, count(*) AS total_lines, count(DISTINCT template) AS distinct_patterns, "
        f"count(*) FILTER (WHERE severity <= 4) AS elevated_count, '{name}' AS period FROM (SELECT {start} AS s, {templ('message')} AS template, severity FROM lines) GROUP BY s"
        for name, start, end in odd))
    q["issue_rows"] = _q(assessed(), """
SELECT fb.period_start, fb.ts, fb.overall_status, fb.summary, CAST(fb.log_count AS BIGINT) AS log_count, CAST(fb.n_issues AS BIGINT) AS n_issues,
  gi.pos, gi.title, gi.occurrences, gi.detail
FROM fb LEFT JOIN gi ON gi.period_start = fb.period_start""")
    q["issue_recurrence"] = _q(assessed() + """,
seen AS (
  SELECT g.title, g.sev_name AS severity, g.occurrences, g.period_end AS ts, d + INTERVAL 6 HOUR AS review_ts
  FROM gi g, unnest(generate_series(CAST(CAST(g.period_end AS DATE) - 1 AS TIMESTAMP), CAST(CAST(g.period_end AS DATE) + 8 AS TIMESTAMP), INTERVAL 1 DAY)) AS x(d)
  WHERE g.period_end < d + INTERVAL 6 HOUR AND g.period_end >= d + INTERVAL 6 HOUR - INTERVAL 7 DAY),
halves AS (
  SELECT review_ts, title, arg_min(severity, ts) AS severity, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS hours, CAST(sum(occurrences) AS BIGINT) AS occurrences,
    count(*) FILTER (WHERE ts < review_ts - INTERVAL 84 HOUR) AS a, count(*) FILTER (WHERE ts >= review_ts - INTERVAL 84 HOUR) AS b
  FROM seen GROUP BY review_ts, title)""", """
SELECT review_ts, title, severity, days, hours, occurrences,
  CASE WHEN a = 0 THEN 'new' WHEN b = 0 THEN 'resolved' WHEN b >= a * 1.5 THEN 'increasing' WHEN b * 1.5 <= a THEN 'decreasing' ELSE 'steady' END AS direction
FROM halves""")
    q["ledger_runs"] = _q(with_period() + """,
runs AS (
  SELECT period_start, period_end, total_lines, total_lines % 4 AS k,
    CASE WHEN period_end <= TIMESTAMP '2024-01-10 00:00:00' THEN 0 WHEN period_end <= TIMESTAMP '2024-01-20 06:30:00' THEN 1
         WHEN period_end <= TIMESTAMP '2024-01-25 00:00:00' THEN 2 END AS r FROM stats)""", """
SELECT period_start, period_end, CASE WHEN k <= 2 THEN 'done' ELSE 'pending' END AS state,
  CAST(CASE WHEN k <= 2 THEN greatest(r, k) - r + 1 ELSE 3 - r END AS INTEGER) AS attempts,
  CASE WHEN k > 2 THEN 'RuntimeError: no answer in run 2' END AS last_error, CASE WHEN k <= 2 THEN total_lines END AS log_count
FROM runs WHERE r IS NOT NULL""")
    q["monitor_stored"] = q["monitor_snapshot"]
    q["history_stored"] = _q(FINDINGS, "SELECT period_start, ts, overall_status FROM fnd ORDER BY ts DESC LIMIT 100")
    q["plugin_retries"] = _q(with_period(), """
SELECT period_start, total_lines, CASE WHEN total_lines % 3 = 2 THEN 'RuntimeError: busy' END AS error,
  CASE WHEN total_lines % 3 <> 2 THEN elevated_count || ' elevated of ' || total_lines END AS summary FROM stats""")
    q["stream_counts_compacted"] = q["stream_top_templates"]
    q["payload_stream"] = f'SELECT "offset", pos, host, severity, message FROM ({q["hard_lines"]})'
    return {k: v.strip() for k, v in q.items()}
