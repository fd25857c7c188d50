"""URL filter: allow and block rules, and a tree of path templates per host for the rest.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: then up to ``?``, ``#`` or the end. URLs that are null or have no ``://`` have
an empty host and path. A rule ``host/path`` fits its host and all subdomains
if the path starts with the rule's; the longest rule wins.

URLs under no rule are judged by templates. A path's segments are generalised
(runs of digits and long hexadecimal runs become ``*``), and the distinct generalised paths
of each host, with their numbers of rows and of labelled rows, form a tree.
Level by level, children whose labels differ significantly from those of their
siblings (two-proportion z test) stay on their own, however few rows they hold.
Of the others, those with under ``SMALL_SHARE`` of their node's rows
become ``*``, and the rest are merged into one branch ``~``. The tree grows while a node holds
several paths; a path that is alone in its node keeps its further segments as they are.
A template's purity is its share of good labels, smoothed
by its parent's purity with the weight of ``SMOOTH`` labels, from the share over
all hosts down. Templates under ``PURITY`` are rejected.

Labels are the rules' own verdicts on the rows that they fit, unless labelled
URLs are given. Without any label the share over all hosts is 1: nothing is
rejected. Repeated rows count as often as they occur and get equal verdicts;
null ids pass through. Only DataFrame and SQL functions run on the data; tree
tables hold distinct generalised paths, summed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import written

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SMALL_SHARE = 0.05
Z = 1.96
SMOOTH, PURITY = 10.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the URL is null or holds no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, parts, 1), _UPPER, _LOWER), F.regexp_extract(known, parts, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments(path: Column) -> Column:
    """Generalised segments of a path; what ends in ``/`` ends in an empty segment."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)\b(?=[a-f]*\d)[0-9a-f-]{8,}\b", "*"), r"\d+", "*"))


def template_tree(paths: DataFrame) -> DataFrame:
    """``paths``: (host, segments, n, good, bad), one row each. Returns (host, segments,
    template, purity)."""
    good, bad = paths.agg(F.sum("good"), F.sum("bad")).first()
    prior = (good / (good + bad)) if (good or 0) + (bad or 0) else 1.0
    tree = paths.withColumn("template", F.lit(""))
    whole = tree.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    whole = whole.select("host", ((F.col("g") + SMOOTH * prior) / (F.col("g") + F.col("b") + SMOOTH)).alias("purity"))
    tree = tree.join(whole, "host")
    kept = ["host", "segments", "template", "purity"]
    done, level = [], 0
    while True:
        tree = written(tree.withColumn("segment", F.get("segments", F.lit(level))), "tree")
        # paths that end here, or are alone in their node, have their template
        node = tree.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("paths"), F.count_distinct("segment").alias("children"), F.sum(F.when(F.col("segment").isNotNull(), F.col("n"))).alias("all_n"),
            F.sum(F.when(F.col("segment").isNotNull(), F.col("good"))).alias("all_g"), F.sum(F.when(F.col("segment").isNotNull(), F.col("bad"))).alias("all_b"))
        at_end = F.col("segment").isNull() | (F.col("paths") == 1)
        here = tree.join(node, ["host", "template"])
        rest_of = F.concat_ws("", F.transform(F.slice("segments", level + 1, 1 << 30), lambda s: F.concat(F.lit("/"), s)))
        done.append(here.where(at_end).withColumn("template", F.concat("template", rest_of)).select(*kept))
        here = here.where(~at_end)
        if here.isEmpty():
            break
        child = here.groupBy("host", "template", "segment").agg(
            F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("purity").alias("parent"),
            *[F.min(c).alias(c) for c in ("children", "all_n", "all_g", "all_b")])
        mine, rest = F.col("g") + F.col("b"), F.col("all_g") + F.col("all_b") - F.col("g") - F.col("b")
        share = F.col("all_g") / (F.col("all_g") + F.col("all_b"))
        apart = F.abs(F.col("g") / mine - (F.col("all_g") - F.col("g")) / rest) / F.sqrt(share * (1 - share) * (1 / mine + 1 / rest))
        differs = F.when((mine > 0) & (rest > 0) & (share > 0) & (share < 1), apart > Z).otherwise(False)
        name = (F.when(F.col("segment") == "", F.col("segment"))
                .when((F.col("n") < SMALL_SHARE * F.col("all_n")) & ~differs, "*")
                .when((F.col("children") > 1) & ~differs & (F.col("segment") != "*"), "~").otherwise(F.col("segment")))
        child = child.withColumn("branch", name)
        branch = child.groupBy("host", "template", "branch").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("parent").alias("parent"))
        branch = branch.select("host", "template", "branch", ((F.col("g") + SMOOTH * F.col("parent")) / (F.col("g") + F.col("b") + SMOOTH)).alias("below"))
        named = child.select("host", "template", "segment", "branch").join(branch, ["host", "template", "branch"])
        tree = here.join(named, ["host", "template", "segment"]).select(
            "host", "segments", "n", "good", "bad", F.concat("template", F.lit("/"), "branch").alias("template"), F.col("below").alias("purity"))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None,
          purity: float = PURITY) -> DataFrame:
    """The rows of ``pages``, their columns named ``_c0``, ``_c1``, .. in order, with ``host``, ``path``,
    ``rule``, ``verdict``, ``template`` and ``purity``. ``labelled``: (url, good boolean)."""
    own = [f"_c{i}" for i in range(len(pages.columns))]

    def parsed(df: DataFrame, address: str) -> DataFrame:
        host, path = host_and_path(F.col(address))
        df = df.withColumn("host", host).withColumn("path", path)
        return df.withColumn("segments", segments(F.col("path"))).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))

    rows = parsed(pages.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(pages.columns, own, strict=True)]), own[pages.columns.index(url)])
    counted = rows.select("host", "segments", F.lit(1).alias("n"), (F.col("fit.verdict") == "allow").alias("good"))
    if labelled is not None:
        given = parsed(labelled.select(F.col("url").alias("u"), F.col("good").cast("boolean").alias("is_good")), "u")
        counted = counted.withColumn("good", F.lit(None).cast("boolean")).union(given.select("host", "segments", F.lit(0), "is_good"))
    paths = written(counted.groupBy("host", "segments").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.sum((~F.col("good")).cast("int")), F.lit(0)).alias("bad")), "paths")
    judged = written(template_tree(paths), "templates")
    verdict = F.coalesce("fit.verdict", F.when(F.col("purity") < purity, "block").otherwise("allow"))
    return rows.join(judged, ["host", "segments"], "left").select(
        *own, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select(F.col("_c0").alias("page_id"), "host", "path", "rule", "verdict", "template", "purity")
