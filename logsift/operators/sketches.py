"""Sketches per period: exact top templates in two passes, and distinct counts that merge.

**Top templates.** The first pass builds a frequent-items sketch per period (merged from the
tasks' sketches, so the shuffle holds sketches and no templates beyond those tracked).
It names candidates and bounds what it doesn't name: a template that the estimate leaves out
has at most :func:`missed_bound` lines. The second pass counts the candidates exactly,
with a broadcast of the candidates on the map side. A period is settled if its k-th exact count is
above the bound, as no other template can then be among the first k. Periods that are
not settled (all-unique lines, say) are counted in full by
:func:`digest.template_counts`, and so is everything if the candidates are too large to be
broadcast. The result equals :func:`digest.top_templates` on all data.

**Distinct templates.** A HyperLogLog sketch per (keys, period) is stored; any range of periods
is a union of sketches, without another look at the lines.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import seen_key
from ..functions.template import templatize
from ..sources.tables import materialize
from .digest import K_TEMPLATES, pkeys, template_counts, top_templates, with_period

#: Templates tracked by a period's sketch.
TRACKED = 10_000
#: Candidates are broadcast up to so many bytes in all.
BROADCAST_BYTES = 64 << 20
#: HyperLogLog: 2**LG_K registers.
LG_K = 12


def map_size(tracked: int) -> int:
    """Counters of a sketch that tracks so many items: a power of two that is three quarters full."""
    return 1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))


def missed_bound(n, tracked: int):
    """Most lines of a template that the estimate of a sketch over ``n`` lines leaves out. A counter is
    at most 3.5 n / size too low, and the estimate names all whose counter is above that error."""
    return n * (2 * 3.5 / map_size(tracked))


def masked(lines: DataFrame, keys: Sequence[str] = (), period: str = "60 minutes", tz: str = "UTC") -> DataFrame:
    """Lines with period and template, written: both passes read them, masking runs once."""
    base = lines if "period_start" in lines.columns else with_period(lines, period, tz)
    base = base if "template" in base.columns else base.withColumn("template", templatize("message"))
    return materialize(base.select(*pkeys(keys), "template", "ts", "id", "severity"), "masked")


def candidate_templates(base: DataFrame, keys: Sequence[str], k: int, tracked: int) -> DataFrame:
    """``(P, template, bound)``: templates of a period that can be among its first k as far as the sketch
    can tell, with the bound of those that it can't name."""
    P = pkeys(keys)
    sketch = base.groupBy(*P).agg(F.expr(f"approx_top_k_accumulate(template, {tracked})").alias("s"), F.count(F.lit(1)).alias("n"))
    items = F.expr(f"approx_top_k_estimate(s, {tracked})")
    bound = missed_bound(F.col("n"), tracked)
    # the k-th best estimate is at most the bound too high; what is lower by more than twice that is out
    x = sketch.select(*P, bound.alias("bound"), items.alias("items"))
    kth = F.when(F.size("items") >= k, F.col("items")[k - 1]["count"] - 2 * F.col("bound")).otherwise(F.lit(0.0))
    x = x.select(*P, "bound", F.explode(F.filter("items", lambda i: i["count"] >= kth)).alias("i"))
    return x.select(*P, F.col("i.item").alias("template"), "bound")


def top_templates_two_pass(lines: DataFrame, keys: Sequence[str] = (), k: int = K_TEMPLATES, period: str = "60 minutes", tz: str = "UTC",
                           tracked: int = TRACKED) -> DataFrame:
    """The k most frequent templates of each period, as :func:`digest.top_templates`, with ``settled``:
    whether the sketch and the recount settled the period."""
    P = pkeys(keys)
    base = masked(lines, keys, period, tz)
    named = materialize(candidate_templates(base, keys, k, tracked), "candidates")
    size = named.agg(F.coalesce(F.sum(F.octet_length("template") + 64), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return top_templates(template_counts(base, keys, with_template=True), keys, k).withColumn("settled", F.lit(False))
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in [*P, "template"]]
    held = base.join(F.broadcast(named.select(*[F.col(c).alias("_" + c) for c in [*P, "template"]], "bound")), on=same)
    counts = held.groupBy(*P, "template").agg(F.count(F.lit(1)).alias("count"), F.min(seen_key()).alias("first_key"), F.first("bound").alias("bound"))
    top = materialize(top_templates(counts, keys, k), "top")
    settled = materialize(top.filter((F.col("rank") == k) & (F.col("count") > F.col("bound"))).select(*[F.col(c).alias("_" + c) for c in P]), "settled")
    in_period = [F.col(c).eqNullSafe(F.col("_" + c)) for c in P]
    rest = template_counts(base.join(settled, on=in_period, how="left_anti"), keys, with_template=True)
    out = [*P, "rank", "template", "count", "first_key"]
    return (top.join(settled, on=in_period, how="left_semi").select(*out, F.lit(True).alias("settled"))
            .unionByName(top_templates(rest, keys, k).select(*out, F.lit(False).alias("settled"))))


def distinct_sketches(lines: DataFrame, keys: Sequence[str] = (), period: str = "60 minutes", tz: str = "UTC", lg_k: int = LG_K) -> DataFrame:
    """``(P, sketch)``: a HyperLogLog sketch of the templates of each period, to be stored."""
    base = lines if "period_start" in lines.columns else with_period(lines, period, tz)
    base = base if "template" in base.columns else base.withColumn("template", templatize("message"))
    return base.groupBy(*pkeys(keys)).agg(F.hll_sketch_agg("template", F.lit(lg_k)).alias("sketch"))


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative error that an estimate keeps within at three standard deviations (1.04 / sqrt(registers) each)."""
    return 3 * 1.04 / math.sqrt(1 << lg_k)


def distinct_templates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct templates of all given sketches per ``by`` (no columns: one row)."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_patterns"))
