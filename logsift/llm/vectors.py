"""Near-duplicate embeddings by comparing all shards that an exact bound can't tell apart.

Vectors of equal label and length are compared by cosine. Equal vectors form
a class, and one row per class goes on. Per label, centroids are fitted on a
bounded sample (at most ``FIT`` classes, ``ROUNDS`` rounds); each class lives in the
shard of its nearest centroid c and visits each later shard, of centroid d, that
can hold a partner. A partner y there has (c - d)y <= 0, so a class x with
(c - d)x over |c - d| times the chord of the threshold has none. Where data has no
clusters, the bound rules nothing out and all shards of a label are compared.

Shards are cut into parts by hash, of at most ``PART`` classes and ``PART_BYTES``. A
task compares two parts in full by matrix products, and pairs in range are
verified in double precision. Each pair meets in one task, so a task gives
counts per class, and only those links that join components.

Vectors that are null, empty, zero, or hold null or non-finite components, and
rows without a label, link with nothing. Repeated rows are one class; every
further row counts as a link of the others. Null ids belong to their class but
name no component. Copies scaled by a factor are different classes that link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import small_batches, written
from .components import components

COSINE = 0.93
FIT, ROUNDS, SHARD = 4096, 8, 8192
PART, PART_BYTES = 16384, 8 << 20
CHUNK = 256
#: Centroids up to this many bytes in all are sent to all tasks; beyond, they are joined.
BROADCAST_BYTES = 32 << 20
SLACK = 1e-6


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, vectors, dims = [], [], []
        labels = b.column("label").to_pylist()
        for label, v in zip(labels, b.column("v"), strict=True):
            x = v.values
            x = np.zeros(0) if label is None or x is None or x.null_count else x.to_numpy(zero_copy_only=False).astype(np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                raw = x.tobytes()
                keys.append(hashlib.blake2b(f"{label} ".encode() + raw, digest_size=16).digest())
                vectors.append(raw)
                dims.append(len(x))
            else:
                keys.append(None)
                vectors.append(None)
                dims.append(None)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary()),
                                          pa.array(dims, pa.int32())], ["id", "label", "key", "v", "dim"])


def _units(raw) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _centroids(sample: pd.DataFrame) -> pd.DataFrame:
    """k-means on the sphere, started from evenly spaced rows of the (hashed) order."""
    sample = sample.sort_values("key")
    x = _units(sample["v"].tolist())
    k = int(max(1, min(len(x), -(-int(sample["n"].iloc[0]) // SHARD), FIT // 8)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        for i in range(k):
            if (near == i).any():
                m = x[near == i].mean(0)
                if m.any():
                    c[i] = _unit(m[None])[0]
    return pd.DataFrame({"label": sample["label"].iloc[:1].to_numpy(), "dim": sample["dim"].iloc[:1].to_numpy(), "c": [c.tobytes()]})


def _assign(reach: float):
    """Each class's shard, and the later shards that can hold a vector in range of it."""
    chord = np.sqrt(max(0.0, 2 - 2 * reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, visits = [], []
            for raw, c, dim in zip(b.column("v").to_pylist(), b.column("c").to_pylist(), b.column("dim").to_pylist(), strict=True):
                c = np.frombuffer(c, np.float64).reshape(-1, dim)
                s = c @ _units([raw])[0]
                at = int(s.argmax())
                apart = np.sqrt(((c[at + 1:] - c[at]) ** 2).sum(1))
                home.append(at)
                visits.append((np.flatnonzero(s[at] - s[at + 1:] <= chord * apart + SLACK) + at + 1).tolist())
            cols = [b.column(k) for k in ("label", "dim", "key", "m", "v")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(home, pa.int32()), pa.array(visits, pa.list_(pa.int32()))],
                                             ["label", "dim", "key", "m", "v", "shard", "visits"])
    return run


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Components after the links (i, j), as the root of each row, and the links that made them."""
    links: list[tuple[int, int]] = []
    first = np.unique(np.concatenate([np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]]))
    for some in (first, slice(None)):  # one link of each row first: after it few others join anything
        a, b = i[some], j[some]
        open_ = root[a] != root[b]
        up = root.tolist()

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
            g, h = find(x), find(y)
            if g != h:
                up[g] = h
                links.append((x, y))
        root = np.array(up)
        while (root[root] != root).any():
            root = root[root]
    return root, links


def _find(reach: float):
    """Counts (a, others) and joining links (a, b) of the rows of two parts, or of one with itself."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side, keys = rows["side"].to_numpy(), rows["key"].to_numpy(object)
        index, query = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(index) or not len(query):
            return pd.DataFrame({"a": [], "b": [], "others": []})
        x, m = _units(rows["v"].tolist()), rows["m"].to_numpy(np.float64)
        single = x.astype(np.float32)
        right = np.ascontiguousarray(single[index].T)
        least = reach - (x.shape[1] + 8) * 1.2e-7  # what rounding can take from a product in single precision
        others, root, links = np.zeros(len(x)), np.arange(len(x)), []
        for k in range(0, len(query), CHUNK):
            i, j = np.nonzero(single[query[k:k + CHUNK]] @ right >= least)
            i, j = query[k + i], index[j]
            if side[0] == 2:
                i, j = i[i < j], j[i < j]
            ok = np.concatenate([(x[i[n:n + 65536]] * x[j[n:n + 65536]]).sum(1) >= reach for n in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
            i, j = i[ok], j[ok]
            others += np.bincount(i, m[j], len(x)) + np.bincount(j, m[i], len(x))
            root, more = _join(root, i, j)
            links += more
        some = np.flatnonzero(others)
        return pd.DataFrame({"a": [*keys[some], *(keys[a] for a, _ in links)], "b": [*[None] * len(some), *(keys[b] for _, b in links)],
                             "others": [*others[some].astype(int).tolist(), *[0] * len(links)]})
    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    small_batches(vectors.sparkSession)
    rows = written(vectors.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v"))
                   .mapInArrow(_classes, f"id {vectors.schema[vec_id].dataType.simpleString()}, label string, key binary, v binary, dim int"), "vectors")
    classes = written(rows.where("key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("m"), F.max("label").alias("label"), F.max("dim").alias("dim"), F.max("v").alias("v")), "classes")

    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    by_hash = Window.partitionBy("label", "dim").orderBy("key")
    sample = classes.select("label", "dim", "key", "v").withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= FIT).drop("r")
    centroids = written(sample.join(sizes, ["label", "dim"]).groupBy("label", "dim").applyInPandas(_centroids, "label string, dim int, c binary"), "centroids")
    total = centroids.agg(F.coalesce(F.sum(F.length("c")), F.lit(0))).first()[0]
    side = F.broadcast(centroids) if total <= BROADCAST_BYTES else centroids
    members = classes.join(side, ["label", "dim"]).select("label", "dim", "key", "m", "v", "c").mapInArrow(
        _assign(cosine), "label string, dim int, key binary, m long, v binary, shard int, visits array<int>")
    members = written(members, "members")
    shard, data = ["label", "dim", "shard"], ["key", "m", "v"]
    limit = F.least(F.lit(PART), F.greatest(F.lit(1), F.floor(F.lit(PART_BYTES) / (8 * F.col("dim")))))
    parts = written(members.groupBy(*shard).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / limit).cast("int")).drop("n"), "parts")
    members = members.join(F.broadcast(parts), shard).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))

    # a task: the index's shard and part, the queries' shard and part
    task = [*shard, "part", "from_shard", "from_part"]
    visitors = (members.select("label", "dim", *data, F.col("shard").alias("from_shard"), F.col("part").alias("from_part"), F.explode("visits").alias("shard"))
                .join(F.broadcast(parts), shard).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    visited = members.select(*shard, "part", *data).join(visitors.select(*task).distinct(), [*shard, "part"])
    own = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select("label", "dim", "shard", F.greatest("part", "other").alias("part"), F.col("shard").alias("from_shard"), F.least("part", "other").alias("from_part"),
                     *data, F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 1).otherwise(0).alias("side"))
    tasks = (own.unionByName(visitors.select(*task, *data, F.lit(1).alias("side"))).unionByName(visited.select(*task, *data, F.lit(0).alias("side"))))
    found = written(tasks.groupBy(*task).applyInPandas(_find(cosine), "a binary, b binary, others long"), "found")

    linked = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("others").alias("others"))
    pairs = found.where("b is not null").select("a", "b")
    named = (classes.select("key", "id", "m").join(components(pairs).toDF("key", "component"), "key", "left")
             .withColumn("component", F.coalesce("component", "key")).join(linked, "key", "left"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("key", "component_id", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.select("id", "key").join(named, "key", "left")
    component_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.cast("long").alias("component_id"),
                      F.col("id").eqNullSafe(component_id).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
