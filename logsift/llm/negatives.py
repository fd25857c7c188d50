"""Hard negatives for labelled vectors, by a multiway hyperplane tree with distance ranges.

A node has up to ``FAN`` split points; a vector belongs to the subtree of its
nearest one. For each pair of split point i and subtree j, the node stores the
least and the greatest distance from point i to the vectors of j, and the
least and greatest length of these vectors. A search wants scores (inner
products) within a window; with the lengths, a window is an annulus of distances
around the anchor. By the triangle inequality, the stored ranges bound the
distance of the anchor to all of a subtree; a subtree whose interval doesn't
meet the annulus is left out. Leaves are compared in full with exact integers.
The window narrows as good rows are found, so later siblings are left out sooner.

The root is made over the whole table: its split points come from a sample of
at most ``SAMPLE`` rows (``SAMPLE_BYTES``), every row is assigned in tasks, and the
ranges are merged by aggregation (``FAN`` x ``FAN`` rows reach the driver). Rows of
a root's subtree are cut by hash into parts that fit a task; a task grows the
lower levels over its part. Anchors go only to subtrees of the root that their
windows can meet; the sample's own scores give each window a first bound.

First the positives are found: no window, same label. Each positive gives a
window of scores, and a second search looks there among other labels. Both are
exact: the tree leaves out only what can't be in the result.

Nulls, repeated rows and vectors of unequal length: see ``intvecs.integers``;
rows without a label take no part. An anchor without positives or without
negatives in range gives no rows; so does a positive with a score below 0 (its
window is empty). An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import small_batches, written
from .intvecs import best, dense, integers, largest, lists, n_blocks

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
FAN, LEAF = 32, 256
SAMPLE, SAMPLE_BYTES = 2048, 8 << 20
#: Rows of a part: at most, and at least where a subtree is small. Anchors of a task at most.
PART, LEAST, ANCHORS = 32768, 1024, 8192
#: Windows looked at together in a leaf.
CHUNK = 2048
NONE, TOP = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Vectors:
    """Rows of integers as a matrix, with products that are exact (modulo 2**64)."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.f = x, x.astype(np.float64)
        self.norm2 = (self.f * self.f).sum(1)
        self.most = largest(x)

    def dots(self, rows, other: Vectors, at) -> np.ndarray:
        """Inner products of some rows with some of another's. Sums below 2**53 are exact in doubles."""
        if self.most * other.most * max(self.x.shape[1], 1) < 2**53:
            return (self.f[rows] @ other.f[at].T).astype(np.int64)
        return self.x[rows] @ other.x[at].T

    def far(self, rows, other: Vectors, at) -> np.ndarray:
        """Distances of some rows to some of another's."""
        d = self.norm2[rows][:, None] + other.norm2[at][None] - 2 * (self.f[rows] @ other.f[at].T)
        return np.sqrt(np.maximum(d, 0))


def split_points(v: Vectors, of: np.ndarray) -> np.ndarray:
    """Up to ``FAN`` of the rows ``of``, each far from those before it (chosen from evenly spaced ones)."""
    of = of[np.linspace(0, len(of) - 1, min(len(of), 3 * FAN)).astype(int)]
    chosen = [0]
    near = v.far(of, v, of[:1])[:, 0]
    while len(chosen) < min(FAN, len(of)):
        k = int(near.argmax())
        if near[k] <= 0:
            break
        chosen.append(k)
        near = np.minimum(near, v.far(of, v, of[k:k + 1])[:, 0])
    return of[chosen]


class Ranges:
    """What a node knows about its subtrees. ``low``/``high`` [i, j]: distances from split point i to
    the vectors of subtree j; ``short``/``long`` [j]: their squared lengths."""

    def __init__(self, low, high, short, long) -> None:
        self.low, self.high, self.short, self.long = low, high, short, long

    @staticmethod
    def of(far: np.ndarray, cell: np.ndarray, norm2: np.ndarray) -> Ranges:
        k = far.shape[1]
        low, high, short, long = np.full((k, k), np.inf), np.zeros((k, k)), np.full(k, np.inf), np.zeros(k)
        for j in np.unique(cell):
            own = cell == j
            low[:, j], high[:, j] = far[own].min(0), far[own].max(0)
            short[j], long[j] = norm2[own].min(), norm2[own].max()
        return Ranges(low, high, short, long)

    def scores(self, far: np.ndarray, norm2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a vector of each subtree can have, for anchors at distances
        ``far`` from the split points. Slack covers the rounding of doubles; empty subtrees have no scores."""
        n, k = far.shape
        near, away = np.zeros((n, k)), np.full((n, k), np.inf)
        for i in range(len(self.low)):
            d = far[:, i:i + 1]
            near = np.maximum(near, np.maximum(d - self.high[i], self.low[i] - d))
            away = np.minimum(away, d + self.high[i])
        some = np.isfinite(self.short)
        short = np.where(some, self.short, 0)
        slack = 1 + 1e-9 * (norm2[:, None] + self.long)
        least = (norm2[:, None] + short - away ** 2) / 2 - slack
        most = (norm2[:, None] + self.long - np.where(some, near, 0) ** 2) / 2 + slack
        return np.where(some, least, np.inf), np.where(some, most, -np.inf)


class Tree:
    """The lower levels of the tree over one part, and a search with many windows at once."""

    def __init__(self, v: Vectors, label: np.ndarray, row: np.ndarray) -> None:
        self.v, self.label, self.row = v, label, row
        self.root = self.grow(np.arange(len(row)))

    def grow(self, of: np.ndarray):
        if len(of) <= LEAF:
            return of
        points = split_points(self.v, of)
        far = self.v.far(of, self.v, points)
        cell = far.argmin(1)
        if np.bincount(cell).max() == len(of):  # all equal: one leaf
            return of
        children = [self.grow(of[cell == j]) for j in range(len(points))]
        return points, Ranges.of(far, cell, self.v.norm2[of]), children

    def search(self, s: Search) -> None:
        self._visit(self.root, s, np.arange(len(s.low)))

    def _visit(self, node, s: Search, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for i in range(0, len(active) if len(node) else 0, CHUNK):
                s.leaf(self, node, active[i:i + CHUNK])
            return
        points, ranges, children = node
        asking, back = np.unique(s.anchor[active], return_inverse=True)
        least, most = ranges.scores(s.v.far(asking, self.v, points), s.v.norm2[asking])
        for j in np.argsort(-most.mean(0)):
            meets = (most[back, j] >= s.low[active]) & (least[back, j] <= s.high[active])
            self._visit(children[j], s, active[meets])


class Search:
    """Windows of scores of anchors, each with its ``k`` best rows so far."""

    def __init__(self, v: Vectors, label, row, anchor, low, high, k: int, same: bool) -> None:
        self.v, self.label, self.row, self.anchor, self.k, self.same = v, label, row, anchor, k, same
        self.low, self.high = low.astype(np.int64).copy(), high.astype(np.int64)
        self.score = np.full((len(low), k), NONE)
        self.at = np.full((len(low), k), TOP)

    def fits(self, asking: np.ndarray, label: np.ndarray, row: np.ndarray) -> np.ndarray:
        equal = self.label[asking][:, None] == label[None]
        return (equal if self.same else ~equal) & (self.row[asking][:, None] != row[None])

    def leaf(self, tree: Tree, of: np.ndarray, active: np.ndarray) -> None:
        asking, back = np.unique(self.anchor[active], return_inverse=True)
        fits = self.fits(asking, tree.label[of], tree.row[of])
        some = np.flatnonzero(fits.any(0))
        if not len(some):
            return
        of, fits = of[some], fits[:, some]
        dots = self.v.dots(asking, tree.v, of)[back]
        ok = fits[back] & (dots >= self.low[active][:, None]) & (dots <= self.high[active][:, None])
        hit = np.flatnonzero(ok.any(1))
        if not len(hit):
            return
        active = active[hit]
        at = np.concatenate([self.at[active], np.broadcast_to(of, (len(hit), len(of)))], 1)
        score = np.concatenate([self.score[active], np.where(ok[hit], dots[hit], NONE)], 1)
        order = np.argsort(at, axis=1, kind="stable")  # ties go to the smaller place, which is the smaller id
        at, score = np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)
        i, j, found = best(score, self.k, NONE)
        n = np.arange(len(i)) - np.searchsorted(i, i)
        self.score[active], self.at[active] = NONE, TOP
        self.score[active[i], n], self.at[active[i], n] = found, at[i, j]
        self.low[active] = np.maximum(self.low[active], self.score[active, -1])


def _windows(table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, number, low, high)``: one per window of the rows ``at`` of ``table``."""
    low, n = lists(table.column("low").take(pa.array(at)))
    high, _ = lists(table.column("high").take(pa.array(at)))
    return np.repeat(np.arange(len(at)), n), np.arange(len(low)) - np.repeat(np.cumsum(n) - n, n), low, high


def _matrix(column, more: int = 0) -> np.ndarray:
    values, lengths = lists(column)
    return dense(values, lengths, max(int(lengths.max()) if len(lengths) else 0, more))


def _wider(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def _find(k: int, same: bool):
    """The ``k`` best rows of a part for each window of the anchors that came to it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        asks = table.column("asks").to_numpy()
        label, row, vec_id = (table.column(c).to_numpy() for c in ("label", "row", "vec_id"))
        at, of = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(at) or not len(of):
            return pa.table({c: np.zeros(0, np.int64) for c in ("anchor", "number", "row", "vec_id", "score")})
        x = _matrix(table.column("v"))
        tree, v = Tree(Vectors(x[at]), label[at], row[at]), Vectors(x[of])
        anchor, number, low, high = _windows(table, of)
        s = Search(v, label[of], row[of], anchor, low, high, k, same)
        tree.search(s)
        w, n = np.nonzero(s.score != NONE)
        found = at[s.at[w, n]]
        return pa.table({"anchor": row[of][anchor[w]], "number": number[w], "row": row[found], "vec_id": vec_id[found], "score": s.score[w, n]})
    return run


class Root:
    """The tree's root: the sample, split points among it, and the ranges of all rows."""

    def __init__(self, rows: DataFrame) -> None:
        widest = rows.agg(F.max(F.size("v"))).first()[0] or 0
        n = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(widest, 1))))
        sample = rows.orderBy(F.xxhash64("row"), "row").limit(n).toArrow()
        self.x, self.label, self.row = _matrix(sample.column("v"), 1), sample.column("label").to_numpy(), sample.column("row").to_numpy()
        v = Vectors(self.x)
        self.points = self.x[split_points(v, np.arange(len(self.x)))]
        self.ranges: Ranges | None = None

    def _far(self, x: np.ndarray) -> tuple[Vectors, np.ndarray]:
        width = max(x.shape[1], self.points.shape[1])
        v, p = Vectors(_wider(x, width)), Vectors(_wider(self.points, width))
        return v, v.far(np.arange(len(x)), p, np.arange(len(self.points)))

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``cell``, the nearest split point; learns the ranges."""
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, far = self._far(_matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far.argmin(1), pa.int32())], [*b.schema.names, "cell"])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, far = self._far(_matrix(b.column("v")))
                cell = b.column("cell").to_numpy()
                r = Ranges.of(far, cell, v.norm2)
                i, j = (x.ravel() for x in np.meshgrid(np.arange(far.shape[1]), np.unique(cell), indexing="ij"))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, (r.low[i, j], r.high[i, j], r.short[j], r.long[j]))],
                                                 ["point", "cell", "low", "high", "short", "long"])

        members = written(rows.mapInArrow(cells, "row long, vec_id long, label long, v array<bigint>, cell int"), "members")
        known = (members.mapInArrow(ranges, "point int, cell int, low double, high double, short double, long double")
                 .groupBy("point", "cell").agg(F.min("low"), F.max("high"), F.min("short"), F.max("long")).collect())
        k = len(self.points)
        self.ranges = Ranges(np.full((k, k), np.inf), np.zeros((k, k)), np.full(k, np.inf), np.zeros(k))
        for i, j, low, high, short, long in known:
            self.ranges.low[i, j], self.ranges.high[i, j], self.ranges.short[j], self.ranges.long[j] = low, high, short, long
        return members

    def route(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """``anchors`` with ``cells``, the subtrees that their windows can meet, and windows from
        the ``k``-th best score within the sample upwards."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v, far = self._far(_matrix(b.column("v")))
                label, row = b.column("label").to_numpy(), b.column("row").to_numpy()
                anchor, _, low, high = _windows(b, np.arange(b.num_rows))
                sample = Tree(Vectors(_wider(self.x, v.x.shape[1])), self.label, self.row)
                s = Search(Vectors(_wider(v.x, sample.v.x.shape[1])), label, row, anchor, low, high, k, same)
                sample.search(s)
                least, most = self.ranges.scores(far, v.norm2)
                meets = (most[anchor] >= s.low[:, None]) & (least[anchor] <= s.high[:, None])
                cells: list[list[int]] = [[] for _ in range(b.num_rows)]
                for a, j in np.unique(np.stack([anchor[np.nonzero(meets)[0]], np.nonzero(meets)[1]], 1), axis=0).tolist():
                    cells[a].append(j)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(anchor, minlength=b.num_rows))]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "vec_id", "label", "v")), pa.ListArray.from_arrays(offsets, pa.array(s.low)),
                                                  pa.ListArray.from_arrays(offsets, pa.array(s.high)), pa.array(cells, pa.list_(pa.int32()))],
                                                 ["row", "vec_id", "label", "v", "low", "high", "cells"])
        return anchors.select("row", "vec_id", "label", "v", "low", "high").mapInArrow(
            run, "row long, vec_id long, label long, v array<bigint>, low array<bigint>, high array<bigint>, cells array<int>")


def _numbers(values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)


def _search(root: Root, members: DataFrame, parts: list[int], anchors: DataFrame, n: int, k: int, same: bool) -> DataFrame:
    """``(anchor, number, row, vec_id, score, rank)``: the ``k`` best rows of each window."""
    asked = max(1, -(-n // ANCHORS))
    part = F.pmod(F.xxhash64("row"), _numbers(parts)).cast("int")
    routed = (root.route(anchors, k, same).withColumn("cell", F.explode("cells")).drop("cells")
              .withColumn("part", F.explode(F.sequence(F.lit(0), _numbers(parts) - 1))))
    if same:  # only parts that hold the label
        routed = routed.join(members.select("label", "cell", part.alias("part")).distinct(), ["label", "cell", "part"], "left_semi")
    data = ["row", "vec_id", "label", "v", "low", "high", "cell", "part", "batch", "asks"]
    routed = routed.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(asked)).cast("int")).withColumn("asks", F.lit(True)).select(*data)
    rows = (members.withColumn("part", part).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(asked - 1)))).withColumn("asks", F.lit(False))
            .withColumn("low", F.lit(None).cast("array<bigint>")).withColumn("high", F.lit(None).cast("array<bigint>")).select(*data))
    found = rows.unionByName(routed).groupBy("cell", "part", "batch").applyInArrow(
        _find(k, same), "anchor long, number long, row long, vec_id long, score long")
    order = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows
    of ``rows`` (see ``intvecs.integers``) that ``anchors`` selects."""
    spark = rows.sparkSession
    small_batches(spark)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if rows.isEmpty():
        return spark.createDataFrame([], result)
    root = Root(rows)
    members = root.assign(rows)
    sizes = {r[0]: (r[1], r[2]) for r in members.groupBy("cell").agg(F.count(F.lit(1)), F.sum(F.size("v"))).collect()}
    parts = [n_blocks(spark, *sizes[j], PART, LEAST) if j in sizes else 1 for j in range(len(root.points))]
    asking = members.where(anchors)
    n = asking.count()

    def whole(x: int) -> Column:
        return F.array(F.lit(int(x)).cast("long"))

    found = _search(root, members, parts, asking.withColumn("low", whole(NONE + 1)).withColumn("high", whole(TOP)), n, positives, True)
    found = written(found.where("score >= 0").select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank")
                    .withColumn("low", F.expr(f"({low} * positive_score + 99) div 100")).withColumn("high", F.expr(f"{high} * positive_score div 100"))
                    .withColumn("number", F.row_number().over(Window.partitionBy("anchor").orderBy("rank")) - 1), "positives")
    windows = found.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("number", "low", "high"))).alias("w"))
    windows = asking.join(windows, "row").withColumn("low", F.col("w.low")).withColumn("high", F.col("w.high"))
    mined = _search(root, members, parts, windows, n, negatives, False)
    named = found.join(members.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", "number", "anchor_id", "positive_id", "positive_score")
    return mined.join(named, ["anchor", "number"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(label: str = "label", vec_id: str = "vec_id") -> Column:
    """Every seventh id gets the next of ten labels: wrong labels that the search has to live with."""
    return F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)).cast("long")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null")
    return hard_negatives(integers(vectors, "vec_id", "embedding", SCALE, relabelled()), F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_dot_product(a.e, x.e)::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""
