"""Assessment rules as a table: matching by an inverted index of required literals.

A rule table has the columns ``position`` (the first matching rule wins), ``kind``
(``benign`` or ``escalate``), ``pattern`` (Java regex on masked templates), ``title``,
``category``, ``severity``, ``min_count``, ``recommendation``, and any of the digest's key
columns: a rule applies where its keys equal the template's, a null key applies everywhere.

Most patterns can only match a text that holds certain literals: one of ``wan`` and
``uplink``, say. :func:`required` derives such a set from a pattern, and the index names
each literal by one of its runs of ``GRAM`` letters, the one that the fewest templates
have. Templates are cut into the same runs, so rules and templates meet by an equi-join
on runs; the regex only verifies the pairs that met. Rules without such literals are kept
under the empty run, which every template has, and so are tried on all templates: there
should be few of them.

Each distinct template is matched once, whatever the number of its periods and keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

GRAM = 3
#: What the two parsers read differently, or what folds case beyond ASCII.
DIFFERENT = re.compile(r"\\[QEpPRhHvVXkGzN0cex]|&&|\(\?<|\(\?[a-zA-Z]*[xuU]")
#: Columns of a rule table besides its keys.
COLUMNS = {"position": "int", "kind": "string", "pattern": "string", "title": "string", "category": "string", "severity": "string",
           "min_count": "int", "recommendation": "string"}


def required(pattern: str, gram: int = GRAM) -> list[str] | None:
    """Lower-case literals of which any matching text holds one at least (in any case), or None.

    Among the sets that the pattern's parts give, the one whose shortest literal is longest is
    taken, then the smallest. Only ASCII runs of at least ``gram`` characters count. A pattern
    that Python's parser doesn't read in the same way as Java's gives None.
    """
    import re._constants as C
    import re._parser as P

    if not pattern.isascii() or DIFFERENT.search(pattern):
        return None
    try:
        tree = P.parse(pattern)
    except Exception:
        return None
    if tree.state.flags & 64:  # verbose: blanks in the pattern don't count
        return None

    def better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
        if a is None or b is None:
            return a if b is None else b
        return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))

    def of(items) -> list[str] | None:
        best, run = None, ""
        for op, arg in [*items, (None, None)]:
            if op is C.LITERAL:
                run += chr(arg).lower()
                continue
            if len(run) >= gram:
                best = better(best, [run])
            run = ""
            if op is C.SUBPATTERN:
                best = better(best, of(arg[-1]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                best = better(best, of(arg[2]))
            elif op is C.ATOMIC_GROUP:
                best = better(best, of(arg))
            elif op is C.BRANCH:
                each = [of(x) for x in arg[1]]
                if all(each):
                    best = better(best, sorted({lit for x in each for lit in x}))
        return best

    return of(tree)


def grams(text: str, gram: int = GRAM) -> list[str]:
    return sorted({text[i:i + gram] for i in range(len(text) - gram + 1)})


def index(rules: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(rule, literal, gram)``: the runs of each literal of each rule (``rule``: its number in
    ``rules``); one row with empty ``literal`` and ``gram`` for a rule that can't be indexed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rule, pattern in zip(b["rule"], b["pattern"], strict=True):
                lits = required(pattern, gram)
                rows += [(rule, lit, g) for lit in lits for g in grams(lit, gram)] if lits else [(rule, "", "")]
            yield pd.DataFrame(rows, columns=["rule", "literal", "gram"])
    return rules.select("rule", "pattern").mapInPandas(run, "rule long, literal string, gram string")


def template_grams(templates: DataFrame, gram: int = GRAM) -> DataFrame:
    """``templates`` (``number``, ``template``) once for each distinct run of their lower-case text, and for the empty run."""
    low = F.lower("template")
    places = F.sequence(F.lit(1), F.greatest(F.char_length(low) - (gram - 1), F.lit(1)))
    runs = F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(gram))))
    return templates.select("number", F.explode(F.array_union(runs, F.array(F.lit("")))).alias("gram"))


def _code(gram: Column) -> Column:
    """An ASCII run as a number that keeps its order; the empty run is 0."""
    return sum((F.ascii(F.substring(gram, i + 1, 1)).cast("long") * (1 << 7 * (GRAM - 1 - i)) for i in range(GRAM)), F.lit(0).cast("long"))


def _decode(code: Column) -> Column:
    return F.when(code == 0, "").otherwise(F.concat(*[F.chr(F.shiftright(code, 7 * (GRAM - 1 - i)).bitwiseAND(F.lit(127))) for i in range(GRAM)]))


def lookups(cut: DataFrame, rules: DataFrame) -> DataFrame:
    """``(rule, gram)``: each rule under the run of each of its literals that the fewest templates have."""
    wanted = materialize(index(rules), "rule_index")
    # how many templates have each run that a rule could be named by
    held = cut.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    # number of templates and run as one number: its minimum is a hash aggregation, where a struct's would sort all runs of all rules
    runs = 1 << 7 * GRAM
    named = (wanted.join(held, "gram", "left").withColumn("at", F.coalesce("held", F.lit(0)) * F.lit(runs) + _code(F.col("gram")))
             .groupBy("rule", "literal").agg(F.min("at").alias("at")))
    return named.select("rule", _decode(F.pmod("at", F.lit(runs))).alias("gram")).distinct()


def first_rules(counts: DataFrame, rules: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, template, rule columns)`` for each distinct (keys of the rules, template) of ``counts`` that a
    rule matches: the matching rule of the smallest position (then pattern, then title).

    Rules are numbered in that order, so the first is the least number: a hash aggregation of longs, whose
    memory follows the templates and not the pairs that met. Pairs that met twice are tried twice."""
    own = [k for k in keys if k in rules.columns]
    theirs = ["_r_" + k for k in own]
    order = ["position", "pattern", "title", *[c for c in COLUMNS if c not in ("position", "pattern", "title")]]
    rules = materialize(rules.select(*[F.col(k).alias("_r_" + k) for k in own], *[F.col(c).cast(t) for c, t in COLUMNS.items()])
                        .orderBy(*order).withColumn("rule", F.monotonically_increasing_id()), "rules")
    # of rules with equal keys and pattern only the first can win
    tried = materialize(rules.groupBy(*theirs, "pattern").agg(F.min("rule").alias("rule")), "tried")
    where = counts.select(*own, "template").distinct()
    templates = materialize(where.select("template").distinct().withColumn("number", F.monotonically_increasing_id()), "templates")
    cut = template_grams(templates)
    met = cut.join(lookups(cut, tried).join(tried, "rule"), "gram")
    matched = met.join(templates, "number").filter(F.expr("template rlike pattern"))
    first = matched.groupBy(*theirs, "number").agg(F.min("rule").alias("rule"))
    if own:
        here = where.join(templates.withColumnRenamed("template", "_t"), F.col("template").eqNullSafe(F.col("_t"))).select(*own, F.col("number").alias("_n"))
        fits: Column = F.col("number") == F.col("_n")
        for k in own:
            fits = fits & (F.col("_r_" + k).isNull() | (F.col("_r_" + k) == F.col(k)))
        first = first.join(here, fits).groupBy(*own, "number").agg(F.min("rule").alias("rule"))
    best = rules.select("rule", F.struct(*COLUMNS).alias("_rule"))
    return first.join(best, "rule").join(templates, "number").select(*own, "template", "_rule")
