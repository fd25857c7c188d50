"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

A term is a position of the vectors. A task holds one block of candidates and
one block of queries. The candidates become postings: per term, the candidates
with a weight other than 0. Queries are sparse rows; term by term, a
query's weight times the postings' weights is added to a dense array of scores,
one score per candidate. Postings that hold a quarter of the candidates or more
are kept as a whole column, which adds the same numbers without indices. The
best ``k`` of each array are selected by partition, and a window merges the
selections of all candidate blocks.

Every query meets every candidate once, so the work is their product, as asked;
each row is copied once for each block of the other side. Blocks are dealt by a
hash of the row, so no block is larger than the others. Scores are exact
integers (sums beyond 64 bits wrap around, as Spark's do).

Nulls, repeated rows and vectors of unequal length: see ``intvecs.integers``. An
empty vector scores 0 everywhere. A row is no candidate of itself; other rows
with the same id are. An empty table or one without queries gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import small_batches
from .intvecs import best, integers, largest, lists, n_blocks

SCALE, EVERY, K = 64, 20, 20
#: Rows of a block: at most, and at least where the table is small.
CANDIDATES, QUERIES, LEAST = 65536, 16384, 512
#: Scores held at once in a task: queries by candidates.
TILE = (64, 4096)


def _postings(values: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(term, rows, weights)`` for each term that has a weight other than 0."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = np.flatnonzero(values)
    some = some[np.argsort(term[some], kind="stable")]
    row, term, weight = row[some], term[some], values[some]
    ends = np.flatnonzero(np.diff(term, append=-1)) + 1
    return [(int(term[i]), row[i:j], weight[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)] if len(some) else []


def _accumulate(queries: list, n_queries: int, candidates: dict, n_candidates: int, kind: type) -> np.ndarray:
    """Dense scores of some queries against some candidates, one term after the other."""
    scores = np.zeros((n_queries, n_candidates), kind)
    for term, asking, weights in queries:
        rows, posted = candidates.get(term, (None, None))
        if posted is None:
            continue
        if rows is None:
            scores[asking] += weights.astype(kind)[:, None] * posted
        else:
            scores[asking[:, None], rows] += weights.astype(kind)[:, None] * posted
    return scores


def _parts(values: np.ndarray, lengths: np.ndarray, size: int):
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for i in range(0, len(lengths), size):
        j = min(i + size, len(lengths))
        yield i, j, values[ends[i]:ends[j]], lengths[i:j]


def _select(k: int):
    """The ``k`` best candidates of this task for each of its queries."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        asks = table.column("asks").to_numpy()
        at, of = np.flatnonzero(~asks), np.flatnonzero(asks)
        found: list[tuple] = []
        row, vec_id = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
        if len(at) and len(of):
            c_values, c_lengths = lists(table.column("v").take(pa.array(at)))
            q_values, q_lengths = lists(table.column("v").take(pa.array(of)))
            bound = largest(c_values) * largest(q_values) * max(int(c_lengths.max()), 1)
            kind = np.int32 if bound < 2**31 else np.int64
            for c0, c1, values, lengths in _parts(c_values, c_lengths, TILE[1]):
                candidates = {}
                for term, rows, weights in _postings(values, lengths):
                    if 4 * len(rows) >= c1 - c0:
                        column = np.zeros(c1 - c0, kind)
                        column[rows] = weights
                        candidates[term] = (None, column)
                    else:
                        candidates[term] = (rows, weights.astype(kind))
                for q0, q1, values_, lengths_ in _parts(q_values, q_lengths, TILE[0]):
                    scores = _accumulate(_postings(values_, lengths_), q1 - q0, candidates, c1 - c0, kind)
                    i, j, s = best(scores, k + 1)  # one may be the query's own row
                    i, j = of[q0 + i], at[c0 + j]
                    other = row[i] != row[j]
                    found.append((i[other], j[other], s[other]))
        i, j, s = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(3))
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, s = i[keep], j[keep], s[keep]
        return pa.table({"query": row[i], "query_id": vec_id[i], "vec_id": vec_id[j], "row": row[j], "score": s})
    return run


def top_k(rows: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``rows`` (see ``intvecs.integers``) that
    ``queries`` selects, the ``k`` other rows with the highest inner products, ties to smaller ids."""
    spark = rows.sparkSession
    small_batches(spark)
    sizes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0)), F.count_if(queries), F.coalesce(F.sum(F.when(queries, F.size("v"))), F.lit(0))).first()
    blocks = n_blocks(spark, sizes[0], sizes[1], CANDIDATES, LEAST)
    asked = max(1, -(-sizes[2] // QUERIES), -(-sizes[3] // (4 << 20)))
    rows = rows.select("row", "vec_id", "v")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    tasks = (rows.withColumn("asks", F.lit(False)).withColumn("block", one(blocks)).withColumn("part", every(asked))
             .unionByName(rows.where(queries).withColumn("asks", F.lit(True)).withColumn("block", every(blocks)).withColumn("part", one(asked))))
    found = tasks.groupBy("block", "part").applyInArrow(_select(k), "query long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", SCALE)
    return top_k(rows, F.col("vec_id") % EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""
