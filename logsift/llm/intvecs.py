"""Vectors of integers: preparing them, dealing them to blocks, and reading them in tasks.

``integers`` gives each usable vector as ``array<bigint>`` under a row number that
stays (the rows are written). Blocks are sized from the table, so that a block of
rows or of queries fits one task, however many rows there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import written


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int, label: Column | None = None) -> DataFrame:
    """``(row, vec_id, label, v)``, written. Rows take part if their id is not null and their vector
    is not null and holds finite components only; each component becomes ``floor(scale * x)`` in
    double precision, held within the range of ``bigint``. Shorter vectors count as filled up with
    zeros. Repeated rows stay and are rows of their own. All other columns of ``vectors`` are left out."""
    x = F.col(embedding).cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return written(vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & usable)
                   .select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
                           (F.lit(None).cast("long") if label is None else label).alias("label"), v.alias("v")), "integers")


def n_blocks(spark: SparkSession, rows: int, components: int, most: int, least: int, most_components: int = 4 << 20) -> int:
    """Blocks of ``most`` rows and ``most_components`` components at most, and for small tables as
    many as the session has shuffle partitions if ``least`` rows are left in each."""
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / least))
    return max(1, math.ceil(rows / most), math.ceil(components / most_components), spread)


def lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(values, lengths)`` of a column of lists of bigint without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)


def dense(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The lists as rows of a matrix, filled up with zeros."""
    out = np.zeros((len(lengths), width), np.int64)
    if len(values):
        out[np.arange(width) < np.asarray(lengths)[:, None]] = values
    return out


def largest(values: np.ndarray) -> float:
    return float(np.abs(values.astype(np.float64)).max()) if values.size else 0.0


def best(scores: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, score)`` of the ``k`` highest scores of each row, ties to the smaller column,
    best first. Scores equal to ``floor`` are no entries. Selection by partition, then a sort of what is left."""
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        mask = scores >= kth[:, None]
    else:
        mask = np.ones(scores.shape, bool)
    if floor is not None:
        mask &= scores != floor
    i, j = np.nonzero(mask)
    s = scores[i, j].astype(np.int64)
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    first = np.searchsorted(i, np.arange(len(scores)))
    keep = np.arange(len(i)) - first[i] < k if len(i) else np.zeros(0, bool)
    return i[keep], j[keep], s[keep]
