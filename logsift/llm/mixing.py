"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words (``[^\\x20\\x09-\\x0D]+``). Sources, in code point order with null
last, weigh 5, 2, 1, repeating, and share all words; a target stops at
``CAP`` times its source's size and what it leaves is shared again by weight.

A source's documents are dealt by a hash into blocks of about ``BLOCK_WORDS``
words, so the blocks' numbers are a random order. The source's quota is whole
passes over its blocks and then the first blocks of one more pass, up to its
target; only the block that holds the target's end is taken in part, document
by document, and at most one document of a source is cut.

The quotas of all sources form the root of a binary tree over the output
shards. Each node gives its left half an exact multivariate-hypergeometric
draw of its blocks (source after source by inverting the hypergeometric
distribution function) and its right half the rest. A leaf's quotas are its
shard's; it takes the next blocks of each source's permuted list, so that
shards hold disjoint blocks, and its rows are ordered by a hash.

Everything is a function of the rows and ``seed``, so reruns agree. Null texts
have size 0 and are never taken. Null sources form one source. Equal rows
share a block and are counted as often as they occur; rows with null ids are
rows like others. An empty table gives an empty result. Only DataFrame and
SQL functions run on the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import written

WEIGHTS, CAP = (5, 2, 1), 3
BLOCK_WORDS = 4096
SHARD_WORDS = 1 << 22
MIN_SHARDS = 8
#: Sources up to here are sent to all tasks (some 40 bytes each); beyond, they are joined.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
_GROUP = 1024
_STEP = 2147483647  # a prime above any number of blocks of one source


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes``: (source, size). Adds ``number``, ``weight`` and ``target``. The windows hold a
    row per source."""
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    s = sizes.withColumn("number", F.row_number().over(by_code)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int")).cast("double"))
    # with sources in order of the share at which they are full, the full ones come first
    before = Window.orderBy(cap * F.col("size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_all", F.sum("size").over(every)).withColumn("_weights", F.sum("weight").over(every))
    share = (F.col("_all") - F.coalesce(F.sum(cap * F.col("size")).over(before), F.lit(0))) / (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_full", cap * F.col("size") < share * F.col("weight"))
    rest = F.col("_all") - F.sum(F.when(F.col("_full"), cap * F.col("size")).otherwise(0)).over(every)
    open_ = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(every)
    s = s.withColumn("_share", F.when(open_ > 0, rest / open_))
    target = F.when(F.col("_full"), cap * F.col("size")).otherwise(F.least(cap * F.col("size"), F.col("_share") * F.col("weight")))
    return s.withColumn("target", F.coalesce(target, F.lit(0)).cast("double")).drop("_all", "_weights", "_full", "_share")


#: One hypergeometric number: of ``n`` blocks drawn from ``total``, how many are of a kind
#: that has ``k``; ``u`` is uniform. The sums run over 12 standard deviations about the mode.
_DRAW = """
transform(array(named_struct('k', cast({k} as bigint), 'n', cast({n} as bigint), 'total', cast({total} as bigint))), g ->
 transform(array(named_struct(
   'a', greatest(0, g.n - (g.total - g.k), cast(floor((g.n + 1) * ((g.k + 1) / (g.total + 2.0D))) as bigint) - {w}),
   'b', least(g.n, g.k, cast(floor((g.n + 1) * ((g.k + 1) / (g.total + 2.0D))) as bigint) + {w}))), r ->
  transform(array(aggregate(sequence(r.a, r.b), named_struct('p', 1.0D, 's', 0.0D),
    (acc, x) -> named_struct('p', acc.p * ((g.k - x) * 1.0D * (g.n - x)) / ((x + 1.0D) * (g.total - g.k - g.n + x + 1)), 's', acc.s + acc.p)).s), whole ->
   aggregate(sequence(r.a, r.b), named_struct('p', 1.0D, 's', 0.0D, 'out', cast(-1 as bigint)),
    (acc, x) -> named_struct('p', acc.p * ((g.k - x) * 1.0D * (g.n - x)) / ((x + 1.0D) * (g.total - g.k - g.n + x + 1)),
      's', acc.s + acc.p, 'out', if(acc.out < 0 and (acc.s + acc.p >= {u} * whole or x = r.b), x, acc.out))).out
  )[0])[0])[0]
"""


def split(tree: DataFrame, depth: int, seed: int) -> DataFrame:
    """``depth`` levels of the tree: (node, quotas array<bigint>) to its leaves."""
    left = """
    aggregate(sequence(1, size(quotas)),
      named_struct('total', aggregate(quotas, 0L, (a, x) -> a + x), 'n', aggregate(quotas, 0L, (a, x) -> a + x) div 2, 'out', cast(array() as array<bigint>)),
      (acc, i) -> transform(array(DRAW), d ->
        named_struct('total', acc.total - element_at(quotas, i), 'n', acc.n - d, 'out', concat(acc.out, array(d))))[0]).out
    """.replace("DRAW", _DRAW.format(
        k="element_at(quotas, i)", n="acc.n", total="acc.total", u=f"((xxhash64({seed}, node, i) & 9007199254740991) / 9007199254740992.0D)",
        w="(12 + cast(ceil(12 * sqrt(g.n * (g.k / (g.total + 1.0D)) * ((g.total - g.k) / (g.total + 1.0D)) * ((g.total - g.n) / (g.total + 1.0D)))) as bigint))"))
    for level in range(depth):
        if level == depth // 2:
            tree = tree.repartition("node")
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
                         F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(quotas, left, (x, y) -> x - y)").alias("quotas")))
        tree = tree.withColumn("left", F.expr(left)).select(F.explode(halves).alias("h")).select("h.*")
    return tree


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
             cap: int = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, their columns named ``_c0``, ``_c1``, .. in order (so no name clashes),
    with ``size``, ``source_size``, ``target``, ``copies`` and ``h``. ``copies`` is an array of (copy,
    shard, words) with the words that each pass takes of the document, from its start."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)], F.col(source).cast("string").alias("source"),
                       n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("h"))
    narrow = written(rows.select("source", "size", "h"), "sizes")
    sources = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("size", F.col("source_size")), weights, cap).drop("size")
    sources = written(sources.withColumn("n", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("long"))
                      .withColumn("want", F.round("target").cast("long"))
                      .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(0))
                      .withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size")), "sources")
    count, words = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("want"), F.lit(0))).first()

    def numbered(df: DataFrame) -> DataFrame:
        side = sources.withColumnRenamed("source", "_s")
        side = F.broadcast(side) if count <= BROADCAST_SOURCES else side
        return df.join(side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("block", F.pmod("h", "n"))

    # words before each block of its source: groups of blocks first, then blocks in a group
    sums = numbered(narrow).groupBy("number", "block").agg(F.sum("size").alias("words")).withColumn("group", F.expr(f"block div {_GROUP}"))
    earlier = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("number", "group").agg(F.sum("words").alias("w")).select("number", "group", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy("number", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("start", F.coalesce(F.sum("words").over(inner), F.lit(0))).join(groups, ["number", "group"])
              .select("number", "block", (F.col("start") + F.col("base")).alias("start")))
    starts = written(starts.join(F.broadcast(sources.select("number", "rest")) if count <= BROADCAST_SOURCES else sources.select("number", "rest"), "number")
                     .select("number", "block", F.greatest(F.col("rest") - F.col("start"), F.lit(0)).alias("left")), "starts")

    # quotas in blocks, the tree, and each shard's blocks
    more = starts.where("left > 0").groupBy("number").agg((F.max("block") + 1).alias("more"))
    quotas = (sources.join(more, "number", "left").select("number", "n", "whole", (F.col("whole") * F.col("n") + F.coalesce("more", F.lit(0))).alias("quota")))
    depth = max(int(math.log2(MIN_SHARDS)), math.ceil(math.log2(max(1, words / shard_words))))
    root = quotas.agg(F.expr("transform(array_sort(collect_list(struct(number, quota))), x -> x.quota)").alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    leaves = split(root, depth, seed).select(F.col("node").alias("shard"), F.posexplode("quotas").alias("at", "take"))
    upto = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    leaves = leaves.select("shard", (F.col("at") + 1).alias("number"), "take").withColumn("end", F.sum("take").over(upto))
    units = (leaves.where("take > 0").join(quotas, "number")
             .select("number", "shard", "n", "quota", F.explode(F.expr("sequence(end - take, end - 1)")).alias("i"))
             .withColumn("unit", F.pmod(F.col("i") * _STEP + F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(1 << 30)), F.col("quota"))))
    taken = (units.select("number", F.expr("unit % n").alias("block"), F.struct(F.expr("unit div n").alias("copy"), "shard").alias("c"))
             .groupBy("number", "block").agg(F.array_sort(F.collect_list("c")).alias("c")))
    plan = starts.join(taken, ["number", "block"], "left")

    ahead = Window.partitionBy("number", "block").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = numbered(rows).join(plan, ["number", "block"])
    joined = joined.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    copies = F.expr("""filter(transform(coalesce(c, array()), x -> named_struct('copy', x.copy, 'shard', x.shard, 'words',
        if(x.copy < whole, size, greatest(0L, least(size, left - ahead))))), x -> x.words > 0)""")
    return joined.select(*own, "size", "source_size", "target", copies.alias("copies"), "h")


def mixture(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed rows: the columns of ``docs``, the text cut to the words taken where a copy
    takes a part (words joined by one space), in shards and in a random order inside each."""
    own = {c: F.col(f"_c{i}") for i, c in enumerate(docs.columns)}
    plan = mix_plan(docs, text, **options).withColumn("c", F.explode("copies"))
    part = F.array_join(F.slice(F.regexp_extract_all(own[text], F.lit(WORD), F.lit(0)), F.lit(1), F.col("c.words").cast("int")), " ")
    shuffled = (plan.withColumn("cut", F.when(F.col("c.words") < F.col("size"), part).otherwise(own[text]))
                .repartition(F.col("c.shard")).sortWithinPartitions("c.shard", F.xxhash64("c.shard", "c.copy", "h")))
    return shuffled.select(*[(F.col("cut") if c == text else own[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select(F.col("_c0").alias("doc_id"), "size", "source_size", "target",
                                 F.expr("aggregate(copies, 0L, (a, x) -> a + x.words)").alias("taken"), F.expr("transform(copies, x -> x.shard)").alias("shards"))
