"""Rules as a table: required literals, the index against trying every rule, per-site rules, the plan."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.operators import assess as A
from logsift.operators import rules as R

COLS = "site string, " + ", ".join(f"{c} {t}" for c, t in R.COLUMNS.items())


@pytest.mark.parametrize("pattern,want", [
    ("(?i)(wan|uplink).*(down|lost|disconnect)", ["disconnect", "down", "lost"]),
    ("Got notification message from PID", ["got notification message from pid"]),
    ("(?i)tx.?retry|rssi", ["retry", "rssi"]), ("ab|cdef", None), ("a.c", None), ("(abc)?x", None), ("(abcd)+x", ["abcd"]),
    ("abc{2,3}de", None), ("abcd{2}", ["abc"]), (r"\Qabc\E", None), ("[a-z&&[^b]]cdef", None), ("(", None), ("", None), ("élan vital", None), ("(?iu)kelvin", None),
    ("(?=abcd)xyz", ["xyz"]), ("(?:foo|bar baz) qux", [" qux"]), (r"x\vabcd", None), ("(?x) a b c d", None)])
def test_required(pattern, want):
    assert R.required(pattern) == want


@settings(max_examples=300, deadline=None)
@given(st.text("abAB|().*+?[]{}2^$ ", max_size=14), st.lists(st.text("abAB ", max_size=12), max_size=8))
def test_required_is_needed(pattern, texts):
    """A text that matches holds one of the literals."""
    lits = R.required(pattern, 2)
    if lits:
        for t in texts:
            for flags in (0, re.I):
                assert not re.compile(pattern, flags).search(t) or any(x in t.lower() for x in lits)


def test_built_in_rules_all_have_literals():
    assert all(R.required(r[1]) for r in A.RULES)


def test_first_rules(spark):
    rnd = random.Random(1)
    words = ["link", "down", "wan", "up", "fail", "auth", "eth<N>", "disk", "full", "ok", "Ω", "<IP>"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 6))) for _ in range(300)] + ["", "x"]
    counts = spark.createDataFrame([(s, t) for t in texts for s in ("a", "b", None)], "site string, template string")
    pats = [f"{a}.*{b}" for a in words for b in words] + ["^$", "o.$", "(?i)WAN (up|down)", "k{1}$", "l{2}", "nothing at all", "(?i)FULL|DISK"]
    rules = [(rnd.choice(["a", "b", None, "c"]), rnd.randint(0, 40), "escalate", p, f"t{i % 7}", "c", "error", 1, "r") for i, p in enumerate(pats)]
    got = R.first_rules(counts, spark.createDataFrame(rules, COLS), ["site"])
    have = {(r.site, r.template): tuple(r._rule) for r in got.collect()}
    want = {}
    for t in texts:
        for s in ("a", "b", None):
            fit = sorted((r[1], r[3], r[4], *r[1:]) for r in rules if (r[0] is None or r[0] == s) and re.search(r[3], t))
            if fit:
                want[s, t] = fit[0][3:]
    assert have == want and len(want) > 400


def test_no_nested_loop(spark):
    counts = spark.createDataFrame([("a", "wan down")], "site string, template string")
    rules = spark.createDataFrame([(None, 1, "escalate", "wan.*down", "t", "c", "error", 1, "r")], COLS)
    plan = R.first_rules(counts, rules, ["site"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_rule_without_sorting_pairs(spark):
    """The first rule is found by hash aggregations of numbers: memory doesn't follow the pairs that met."""
    counts = spark.createDataFrame([("a", "wan down")], "site string, template string")
    rules = spark.createDataFrame([(s, p, "escalate", "wan.*down", f"t{p}", "c", "error", 1, "r") for s in (None, "a", "b") for p in (3, 1, 2)], COLS)
    found = R.first_rules(counts, rules, ["site"])
    plan = found._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert [(r.site, r._rule.position, r._rule.title) for r in found.collect()] == [("a", 1, "t1")]


def test_no_rules_and_no_templates(spark):
    rules = spark.createDataFrame([], COLS)
    counts = spark.createDataFrame([("a", "wan down")], "site string, template string")
    assert R.first_rules(counts, rules).collect() == [] and R.first_rules(counts.limit(0), A.rules_table(spark)).collect() == []


def test_built_in_rules_as_a_table(spark):
    """The table path gives what the built-in chain gives."""
    texts = ["openvpn tls handshake failed", "procd got SIGTERM", "wan is down", "segfault at <N>", "nothing", "DPI will skip", "Failed password for x"]
    counts = spark.createDataFrame([(t,) for t in texts], "template string")
    a = {r.template: r.rule and tuple(r.rule) for r in A.with_rule(counts).collect()}
    b = {r.template: r.rule and tuple(r.rule) for r in A.with_rule(counts, rules=A.rules_table(spark)).collect()}
    assert a == b and sum(v is not None for v in a.values()) == 6 and F is not None
