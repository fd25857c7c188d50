"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct ``SHINGLE``-word shingles (words of
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer words: the whole sequence as
one). Documents with equal sets form a class, and one row per class goes on.

``TREES`` independent trees branch the classes: at depth d of a tree a class
follows the token of its set that is least under that depth's hash, so two
sets stay together with a probability of their similarity per step. A node
with at most ``LEAF`` classes is compared exhaustively and branches no more.
The least tokens of all trees also estimate the similarity of a pair; pairs
far below the threshold are not confirmed. The others are confirmed on the
full sets. Nodes that stay large after ``DEPTH`` steps hold large groups of
near copies: each class is compared with the node's first one, and then classes outside the
node's largest component are compared with all on full sets, chunk by chunk. A
chunk is bounded by rows and by bytes, so long texts make more chunks.

Classes that were in a node of more than ``LEAF`` after two steps or later go
through ``MORE`` further trees in the same way, where only nodes and pairs of
different components count.

Recall: a pair at similarity 0.75 is missed by one tree with probability 0.25
if its nodes are small after one step, and 0.58 after three; by all 16 with
2e-10 and 2e-4. If its nodes are still large after two steps, both go through
all 48 trees (but for 2e-6), and the pair is together after four, five or six steps
in none of them with 1e-8, 2e-6 or 8e-5. The estimate loses a pair at the threshold
with 1e-8.

Null and empty texts have an empty set and link with nothing. Repeated rows
fall into one class. Rows with a null id belong to their class but name no
component; a class of null ids only has a null one and its rows stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import written
from .components import components
from .words import LOWER, buffers, inside, mix, slices, windows, words

SHINGLE, PERCENT = 5, 75
TREES, DEPTH, LEAF = 16, 6, 12
MORE = 32
#: Of TREES * DEPTH least tokens, so many must agree before the full sets are compared.
AGREE = TREES * DEPTH // 2
#: Rows of a chunk, and bytes that a task holds of them (sets and compressed texts): what is reached first bounds it.
CHUNK, CHUNK_BYTES = 256, 4 << 20
#: Bytes of texts that are split into words together.
TEXTS = 2 << 20
#: Two classes of a small node are a pair if so many of the lowest bits of their SKETCH first least tokens agree:
#: those of similarity 0.75 fall below with 2e-9, unrelated ones nearly always.
SKETCH, SAME = 96, 62
#: Classes of a subtree that one task branches in memory, and rows that it looks at together.
GROUP, HELD = 200_000, 32_000

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_MORE_FACTORS = _rng.integers(0, 1 << 63, MORE * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = words(data, offsets, lower=True)
    at = inside(w.first, size)
    h = windows(w.hash, size)[at]
    cut = np.searchsorted(at, w.first).tolist()
    out, n_words = [], np.diff(w.first).tolist()
    for d, n in enumerate(n_words):
        if n >= size:
            out.append(np.unique(h[cut[d]:cut[d + 1]]))
        elif n:
            out.append(windows(mix(w.hash[w.first[d]:w.first[d + 1]] + np.uint64(n)), n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(texts: Iterable[bytes], size: int = SHINGLE, limit: int = TEXTS) -> list[np.ndarray]:
    """``shingle_sets`` of texts that come one by one: about ``limit`` bytes of them are held, one text at least."""
    out, held, n = [], [], 0

    def done() -> None:
        out.extend(shingle_sets(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), size))
        held.clear()

    for x in texts:
        if held and n + len(x) > limit:
            done()
            n = 0
        held.append(x)
        n += len(x)
    if held:
        done()
    return out


def least_tokens(s: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """The least token under each hash (TREES * DEPTH of them), as 32 bits."""
    best = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(best, (s[i:i + 2048] * factors[:, None]).min(1), out=best)
    return (mix(best) >> np.uint64(32)).astype(np.uint32)


def _describe(text: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        z = zstandard.ZstdCompressor(3)
        for b in slices(batches, text):
            data, offsets = buffers(b.column(text))
            sets = shingle_sets(data, offsets, size)
            raw = LOWER[data].tobytes()
            keys, tokens, blobs = [], [], []
            for d, s in enumerate(sets):
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tokens.append(least_tokens(s).tobytes() if len(s) else None)
                blobs.append(z.compress(raw[offsets[d]:offsets[d + 1]]) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary()), pa.array(blobs, pa.binary())],
                ["id", "n", "key", "tokens", "z"])
    return run


def _more_tokens(size: int):
    """The least tokens of the further trees, for few classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unz = zstandard.ZstdDecompressor()
        for b in batches:
            tokens = []
            for z in b.column("z"):
                x = unz.decompress(z.as_py(), max_output_size=1 << 31)
                tokens.append(least_tokens(shingle_sets(np.frombuffer(x, np.uint8), np.array([0, len(x)]), size)[0], _MORE_FACTORS).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("c"), pa.array(tokens, pa.binary())], ["key", "c", "tokens"])
    return run


def _step(node: np.ndarray, token: np.ndarray, depth: int) -> np.ndarray:
    return mix(node * np.uint64(0x9E3779B97F4A7C15) + token.astype(np.uint64) + np.uint64(depth + 1))


def _first(first: int, trees: int):
    """A row per class and tree: the root's child that the class goes to, and its tokens for further steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint32).reshape(-1, trees, DEPTH)
            root = np.arange(first, first + trees, dtype=np.uint64) << np.uint64(40)
            n, own = len(t) * trees, [c for c in b.schema.names if c != "tokens"]
            at, width = pa.array(np.repeat(np.arange(len(t)), trees)), 4 * (DEPTH - 1)
            rest = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(t[:, :, 1:]).tobytes())])
            bits = np.packbits((t.reshape(len(t), -1)[:, :SKETCH] & 1).astype(np.uint8), axis=1)
            sketch = pa.array([x.tobytes() for x in bits], pa.binary()).take(at)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in own), pa.array(_step(root, t[:, :, 0], 0).view(np.int64).ravel()), rest, sketch], [*own, "first", "rest", "sketch"])
    return run


def _near_pairs(node: np.ndarray, sketch: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of different components) in one node whose sketches agree enough; nodes hold at most LEAF rows."""
    order = np.argsort(node, kind="stable")
    node, sketch = node[order], sketch[order]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, LEAF):
        i = np.flatnonzero(node[k:] == node[:-k])
        if not len(i):
            break
        if c is not None:
            i = i[c[order[i]] != c[order[i + k]]]
        i = i[np.bitwise_count(sketch[i] ^ sketch[i + k]).sum(1, dtype=np.int64) <= SKETCH - SAME]
        left.append(order[i])
        right.append(order[i + k])
    return np.concatenate(left), np.concatenate(right)


def _ends(node: np.ndarray, tokens: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The node in which each class ends, its size, whether it holds several classes (components), and
    whether the class was in a large node after two steps or later. All classes of ``node`` are here."""
    n = len(node)
    end, size = node.copy(), np.ones(n, np.int64)
    several, crowded, open_ = np.zeros(n, bool), np.zeros(n, bool), np.arange(n)
    for d in range(DEPTH):
        here, back, count = np.unique(node[open_], return_inverse=True, return_counts=True)
        if c is None:
            many = count > 1
        else:
            lo, hi = np.full(len(here), np.iinfo(np.int64).max), np.full(len(here), np.iinfo(np.int64).min)
            np.minimum.at(lo, back, c[open_])
            np.maximum.at(hi, back, c[open_])
            many = lo != hi
        end[open_], size[open_], several[open_] = node[open_], count[back], many[back]
        if d:
            crowded[open_] |= count[back] > LEAF
        open_ = open_[(many & (count > LEAF))[back]]
        if not len(open_) or d + 1 == DEPTH:
            break
        node[open_] = _step(node[open_], tokens[open_, d], d + 1)
    return end, size, several, crowded


def _subtrees(own: list[str]):
    """Branch the subtree of each child of the root over its classes, which come in the order of ``first``.
    A child with more than ``GROUP`` classes is left to further shuffles: its rows leave with their tokens."""
    names = [*own, "node", "size", "several", "crowded", "first", "rest", "other"]

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        first = t.column("first").to_numpy()
        _, back, count = np.unique(first, return_inverse=True, return_counts=True)
        alone, far = count[back] == 1, count[back] > GROUP
        near = np.flatnonzero(~alone & ~far)
        if len(near):
            x = t.take(pa.array(near))
            tokens = np.frombuffer(b"".join(x.column("rest").to_pylist()), np.uint32).reshape(-1, DEPTH - 1)
            c = x.column("c").to_numpy() if "c" in own else None
            node, size, several, crowded = _ends(x.column("first").to_numpy().view(np.uint64).copy(), tokens, c)
            small = np.flatnonzero(several & (size <= LEAF))
            sketch = np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.uint8).reshape(len(x), -1)[small]
            i, j = _near_pairs(node[small], sketch, None if c is None else c[small])
            keys = x.column("key").take(pa.array(small)).to_pylist()
            met = sorted({(min(keys[a], keys[b]), max(keys[a], keys[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)})
            n = len(met)
            if n:
                blank = [pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary())]
                yield from _batches(pa.table([pa.array([a for a, _ in met], pa.binary()), *[pa.nulls(n, x.schema.field(o).type) for o in own[1:]]], names=own),
                                    [*blank, pa.array([b for _, b in met], pa.binary())])
            keep = np.flatnonzero((several & (size > LEAF)) | crowded)
            yield from _batches(x.select(own).take(pa.array(keep)), [pa.array(node.view(np.int64)[keep]), pa.array(size[keep]), pa.array((several & (size > LEAF))[keep]), pa.array(crowded[keep]),
                                                                     pa.nulls(len(keep), pa.int64()), pa.nulls(len(keep), pa.binary()), pa.nulls(len(keep), pa.binary())])
        if far.any():
            yield from left(t.take(pa.array(np.flatnonzero(far))))

    def left(x: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of a child that is too large for a task."""
        none = [pa.nulls(len(x), k) for k in (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())]
        yield from _batches(x.select(own), [*none, x.column("first").combine_chunks(), x.column("rest").combine_chunks(), pa.nulls(len(x), pa.binary())])

    def _batches(x: pa.Table, more: list) -> Iterator[pa.RecordBatch]:
        yield from pa.table([*x.columns, *more], names=names).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, leaving = 0, None  # leaving: a child known to be too large, whose rows needn't be held
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < HELD:
                continue
            t = pa.Table.from_batches(held)
            first = t.column("first").to_numpy()
            cut = int(np.searchsorted(first, first[-1])) if first[-1] != leaving else 0  # rows of the last child may go on
            if first[0] == leaving:
                end = int(np.searchsorted(first, leaving, "right"))
                yield from left(t.slice(0, end))
                t, cut = t.slice(end), max(cut - end, 0)
            if cut:
                yield from done(t.slice(0, cut))
            t = t.slice(cut)
            if len(t) > GROUP:
                leaving = t.column("first")[0].as_py()
                yield from done(t)
                t = t.slice(len(t))
            held, rows = t.combine_chunks().to_batches(), len(t)
        if rows:
            t = pa.Table.from_batches(held)
            first = t.column("first").to_numpy()
            end = int(np.searchsorted(first, leaving, "right")) if leaving is not None and first[0] == leaving else 0
            if end:
                yield from left(t.slice(0, end))
            if len(t) > end:
                yield from done(t.slice(end))
    return run


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes that a class passes in a tree."""
    for b in batches:
        t = np.frombuffer(b"".join(b.column("rest").to_pylist()), np.uint32).reshape(-1, DEPTH - 1)
        path = np.empty((len(t), DEPTH), np.uint64)
        path[:, 0] = b.column("first").to_numpy().view(np.uint64)
        for d in range(1, DEPTH):
            path[:, d] = _step(path[:, d - 1], t[:, d - 1], d)
        own = b.select([c for c in b.schema.names if c != "rest"])
        yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * DEPTH), pa.array(path.view(np.int64).ravel()))],
                                         [*own.schema.names, "path"])


def _nodes(classes: DataFrame, first: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """``classes``: (key, tokens), or (key, c, tokens) with a number ``c`` of the component.

    Returns the rows of classes whose node in a tree stays large (``several``: and holds several classes
    or components) or was large after two steps or later (``crowded``), and the pairs (a, b) of
    classes that meet in a small node.

    Classes are shuffled once, by the root's child that they go to; a task branches the whole
    subtree. Children of more than ``GROUP`` classes are branched by joins on their nodes."""
    own = [c for c in classes.columns if c != "tokens"]
    kinds = ", ".join(f"{c} {classes.schema[c].dataType.simpleString()}" for c in own)
    children = classes.mapInArrow(_first(first, trees), f"{kinds}, first long, rest binary, sketch binary")
    sorted_ = children.repartition("first").sortWithinPartitions("first")
    branched = written(sorted_.mapInArrow(_subtrees(own), f"{kinds}, node long, size long, several boolean, crowded boolean, first long, rest binary, other binary"), "nodes")
    ended = branched.where("node is not null").select(*own, "node", "size", "several", "crowded")
    pairs = branched.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
    far = branched.where("first is not null").select(*own, "first", "rest")
    if far.isEmpty():
        return ended, pairs
    several = (F.min("c") != F.max("c")) if "c" in own else F.count(F.lit(1)) > 1
    steps = far.mapInArrow(_paths, f"{kinds}, first long, path array<long>").select(*own, "first", F.posexplode("path").alias("depth", "node"))
    sizes = steps.groupBy("node").agg(F.count(F.lit(1)).alias("size"), several.alias("several"))
    last = F.struct("depth", "node", "size", "several")
    ends = steps.join(sizes, "node").groupBy(*own, "first").agg(
        F.coalesce(F.min(F.when((F.col("size") <= LEAF) | ~F.col("several"), last)), F.max(last)).alias("l"),
        F.max((F.col("depth") >= 1) & (F.col("size") > LEAF)).alias("crowded"))
    ends = written(ends.where("l.several or crowded").select(*own, "l.node", "l.size", "l.several", "crowded"), "ends")
    member = F.struct("key", "c") if "c" in own else F.struct("key", F.lit(None).alias("c"))
    small = ends.where("several").where(F.col("size") <= LEAF).groupBy("node").agg(F.sort_array(F.collect_list(member)).alias("k"))
    met = small.select(F.explode(F.expr("flatten(transform(k, (x, i) -> transform(filter(slice(k, i + 2, size(k)), y -> not coalesce(y.c = x.c, false)), "
                                        "y -> named_struct('a', x.key, 'b', y.key))))")).alias("p")).select("p.*")
    large = ends.withColumn("several", F.col("several") & (F.col("size") > LEAF)).where("several or crowded")
    return ended.unionByName(large), pairs.union(met)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, TREES * DEPTH) for c in ("ta", "tb"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE))


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unz = zstandard.ZstdDecompressor()
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            za, zb = b.column("za"), b.column("zb")
            for i in range(b.num_rows):
                x, y = (unz.decompress(c[i].as_py(), max_output_size=1 << 31) for c in (za, zb))
                s, t = shingle_sets(np.frombuffer(x + y, np.uint8), np.array([0, len(x), len(x) + len(y)]), size)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield b.select(["a", "b"]).filter(pa.array(ok))
    return run


def _apart(size: int, percent: int):
    """Links between classes of different components in two chunks of a node, by full sets; of
    these only as many as join the components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard
        if not ((rows["side"] != 0).any() and (rows["side"] != 1).any()):  # no row fell into one of the chunks
            return pd.DataFrame([], columns=["a", "b"])
        unz = zstandard.ZstdDecompressor()
        sets = sets_of((unz.decompress(z, max_output_size=1 << 31) for z in rows["z"]), size)
        keys, side = rows["key"].tolist(), rows["side"].to_numpy()
        names = {c: k for k, c in enumerate(dict.fromkeys(rows["component"]))}
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        group = [names[c] for c in rows["component"]]
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        first, n = np.cumsum([0, *map(len, sets)]), np.array([len(t) for t in sets])
        right = np.flatnonzero(side != 0)
        place, start = np.concatenate([np.arange(first[r], first[r + 1]) for r in right]), np.r_[0, np.cumsum(n[right])[:-1]]
        tokens, has, out = ids[place], np.zeros(len(ids) + 1, np.int64), []
        for x in np.flatnonzero(side != 1):
            own = ids[first[x]:first[x + 1]]
            has[own] = 1
            both = np.add.reduceat(has[tokens], start)
            has[own] = 0
            for y in right[100 * both >= percent * (n[x] + n[right] - both)].tolist():
                g, h = find(group[x]), find(group[y])
                if g != h:
                    root[g] = h
                    out.append((keys[x], keys[y]))
        return pd.DataFrame(out, columns=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id
    of the documents linked with it, itself included), ``kept``."""
    rows = written(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
                   .mapInArrow(_describe("text", size), f"id {docs.schema[doc_id].dataType.simpleString()}, n long, key binary, tokens binary, z binary"), "sets")
    classes = written(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("tokens").alias("tokens")), "classes")

    nodes, pairs = _nodes(classes.select("key", "tokens"), 0, TREES)
    crowded = nodes.where("crowded").select("key").distinct()
    large = nodes.where("several").select("key", "node", "size")
    head = large.groupBy("node").agg(F.min("key").alias("a"))
    pairs = pairs.union(large.join(head, "node").select("a", F.col("key").alias("b")).where("a != b")).distinct()

    def likely(pairs: DataFrame) -> DataFrame:
        t = classes.select("key", "tokens")
        return written(pairs.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b").mapInArrow(_agree, "a binary, b binary"), "likely")

    def confirmed(pairs: DataFrame) -> DataFrame:
        z = texts.select("key", "z")
        return written(pairs.join(z.toDF("a", "za"), "a").join(z.toDF("b", "zb"), "b").mapInArrow(_confirm(size, percent), "a binary, b binary"), "links")

    met = likely(pairs)
    # all texts that are read again: of pairs, and of crowded classes, among which all further pairs are. Shuffled once.
    needed = met.select(F.col("a").alias("key")).union(met.select(F.col("b").alias("key"))).union(crowded).distinct()
    texts = written(rows.select("key", "z", "n").join(needed, "key", "left_semi").groupBy("key").agg(F.max("z").alias("z"), F.max("n").alias("n"))
                    .select("key", "z", (8 * F.col("n") + F.length("z")).alias("held")), "texts")
    found = confirmed(met)
    grouped = components(found)
    if not crowded.isEmpty():
        tokens = (texts.join(crowded, "key", "left_semi").join(grouped.toDF("key", "component"), "key", "left").select("key", F.xxhash64(F.coalesce("component", "key")).alias("c"), "z")
                  .mapInArrow(_more_tokens(size), "key binary, c long, tokens binary"))
        nodes, pairs = _nodes(written(tokens, "tokens"), TREES, MORE)
        more = nodes.where("several")
        head = more.groupBy("node").agg(F.min(F.struct("key", "c")).alias("h"))
        pairs = pairs.union(more.join(head, "node").where("h.c != c").select("h.key", "key")).distinct()
        found = found.union(confirmed(likely(pairs)))
        grouped = components(found)
        large = large.union(more.select("key", "node", "size"))
    member = large.join(grouped.toDF("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # nodes of equal classes in several trees are compared once
    open_ = (member.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"),
                                        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"))
             .where("lo != hi").groupBy("n", "s", "x").agg(F.min("node").alias("node")).select("node"))
    open_ = written(member.join(open_, "node").join(texts.select("key", "held"), "key"), "open")
    if not open_.isEmpty():
        # a node's largest component against the classes outside it, and these among themselves
        def chunks(n, held):
            return F.greatest(F.ceil(n / CHUNK), F.ceil(held / CHUNK_BYTES)).cast("int")

        parts = open_.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"))
        main = parts.groupBy("node").agg(F.max(F.struct("n", "component", "held")).alias("m"), F.sum("n").alias("n"), F.sum("held").alias("held")).select(
            "node", F.col("m.component").alias("main"), chunks(F.col("m.n"), F.col("m.held")).alias("nm"), chunks(F.col("n") - F.col("m.n"), F.col("held") - F.col("m.held")).alias("ns"))
        inside_ = F.col("component") == F.col("main")
        chunk = open_.join(main, "node").join(texts.select("key", "z"), "key").withColumn("c", F.pmod(F.xxhash64("key"), F.when(inside_, F.col("nm")).otherwise(F.col("ns"))).cast("int"))

        def against(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("d")

        data = ["node", "key", "component", "z"]
        inner = chunk.where(inside_).select(*data, "c", against("ns")).select(*data, F.lit(0).alias("kind"), F.col("c").alias("i"), F.col("d").alias("j"), F.lit(1).alias("side"))
        outer = chunk.where(~inside_).select(*data, "c", against("nm")).select(*data, F.lit(0).alias("kind"), F.col("d").alias("i"), F.col("c").alias("j"), F.lit(0).alias("side"))
        among = chunk.where(~inside_).select(*data, "c", against("ns")).select(
            *data, F.lit(1).alias("kind"), F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), F.when(F.col("c") == F.col("d"), 2).when(F.col("c") < F.col("d"), 0).otherwise(1).alias("side"))
        more = inner.unionByName(outer).unionByName(among).groupBy("node", "kind", "i", "j").applyInPandas(_apart(size, percent), "a binary, b binary")
        grouped = components(written(found.union(more), "links"))

    named = classes.select("key", "id").join(grouped.toDF("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = named.join(least, "component").select("key", "component_id")
    out = rows.select("id", "n", "key").join(by_class, "key", "left")
    component_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
