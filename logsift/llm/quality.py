"""Quality rules: hashed word and character n-grams with logistic regression.

Texts are hashed in Arrow batches: single words, pairs of neighbouring words
and runs of 4 bytes (over the whole text) each fall into one of ``SLOTS``
weights; a family's counts are scaled by their sum, so long texts weigh like
short ones. The weights are fitted on the driver on a bounded sample of at
most ``SAMPLE`` labelled documents per class (lowest hash of the id first); a
fifth of the sample is set aside to calibrate scores to probabilities (Platt
scaling). A document is kept if it passes the base rules and its probability
of good quality reaches ``KEEP``.

Base columns, over whole texts: ``n_words``, ``word_chars`` (code points in
words), ``n_symbols`` (characters of ``#*$%&|<>``), ``n_dup_lines`` (lines with a
word that equal an earlier line), ``n_repeat_words`` (words in windows of 3
words that the text holds twice or more). ``base_failed``: under ``MIN_WORDS``
words, or over ``MAX_REPEAT`` percent of words repeated.

Null and empty texts have no words and fail. Without labels of both classes
the base rules alone decide. Labels that are null, of documents that are
missing, or that contradict each other are not learned from. Repeated rows
are judged alike; rows with null ids are judged but never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import buffers, inside, mix, slices, windows, words

SLOTS = 1 << 16          # per family
FAMILIES = 3
GRAM = 4                 # bytes
SAMPLE = 1000            # labelled documents per class
MIN_WORDS, MAX_REPEAT = 50, 50
KEEP = 0.5

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _slots(w, data: np.ndarray, offsets: np.ndarray):
    """``(document, slot)`` of every feature, a family at a time."""
    doc = w.doc()
    yield doc, (w.hash & _U(SLOTS - 1)).astype(np.int64)
    at = inside(w.first, 2)
    yield doc[at], (windows(w.hash, 2)[at] & _U(SLOTS - 1)).astype(np.int64) + SLOTS
    at = inside(offsets, GRAM)
    if len(at):
        code = data.astype(np.uint32)
        gram = (code[:-3] | code[1:-2] << 8 | code[2:-1] << 16 | code[3:] << 24)[at]
        gram = (gram * np.uint32(2654435761)) >> np.uint32(16)
        size = np.maximum(np.diff(offsets) - GRAM + 1, 0)
        yield np.repeat(np.arange(len(size)), size), gram.astype(np.int64) + 2 * SLOTS


def _repeated(h: np.ndarray, n: int) -> int:
    """Words (of ``n``) in windows of 3 words whose hash occurs twice or more among ``h``."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(s), bool)
    hit[1:] |= same
    hit[:-1] |= same
    edge = np.zeros(n + 1, np.int32)
    at = order[hit]
    edge[at] += 1
    edge[at + 3] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def _repeated_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += bool(line.split())
        else:
            seen.add(line)
    return n


def base(w, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base columns of a run of texts."""
    n_docs = len(offsets) - 1
    n_words = np.diff(w.first)
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points up to each byte
    in_words = np.r_[0, np.cumsum(point[w.end] - point[w.start])]
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    at = inside(w.first, 3)
    h, cut = windows(w.hash, 3)[at], np.searchsorted(at, w.first).tolist()
    raw, o = data.tobytes(), offsets.tolist()
    return {"n_words": n_words, "word_chars": np.diff(in_words[w.first]), "n_symbols": np.diff(symbols[offsets]),
            "n_dup_lines": np.array([_repeated_lines(raw[o[d]:o[d + 1]]) for d in range(n_docs)], np.int64),
            "n_repeat_words": np.array([_repeated(h[cut[d]:cut[d + 1]], int(n_words[d])) if cut[d + 1] > cut[d] + 1 else 0 for d in range(n_docs)], np.int64)}


def scores(weights: np.ndarray, w, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Uncalibrated log-odds (``weights`` ends with the intercept)."""
    n = len(offsets) - 1
    out = np.full(n, weights[-1], np.float64)
    for doc, slot in _slots(w, data, offsets):
        out += np.bincount(doc, weights[slot], n) / np.maximum(np.bincount(doc, minlength=n), 1)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots of each text and their shares of the text's features of the same family."""
    n = len(offsets) - 1
    slots, values = [[] for _ in range(n)], [[] for _ in range(n)]
    for doc, slot in _slots(words(data, offsets), data, offsets):
        cut = np.searchsorted(doc, np.arange(n + 1))
        for d in range(n):
            cell, count = np.unique(slot[cut[d]:cut[d + 1]], return_counts=True)
            slots[d].append(cell.astype(np.int32))
            values[d].append((count / max(1, count.sum())).astype(np.float32))
    return [(np.concatenate(x) if x else np.zeros(0, np.int32), np.concatenate(v) if v else np.zeros(0, np.float32)) for x, v in zip(slots, values, strict=True)]


def fit(sample: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 120, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float, float]:
    """Weights and the two numbers of the calibration, from the features of labelled texts in
    random order."""
    n = len(y)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x, _ in sample])
    col, value = (np.concatenate(c) for c in zip(*sample, strict=True))
    aside = np.arange(n) % 5 == 4
    used = ~aside[row]
    r, v = row[used], value[used]
    seen = np.zeros(FAMILIES * SLOTS, bool)
    seen[col[used]] = True
    names = np.flatnonzero(seen)
    c = (np.cumsum(seen) - 1).astype(np.int32)[col[used]]
    weight_of = np.where(y == 1, 0.5 / max(1, (y[~aside] == 1).sum()), 0.5 / max(1, (y[~aside] == 0).sum())) * ~aside
    # features differ widely in how often they occur: each gets a step of its own
    w, b, sq, sb = np.zeros(len(names)), 0.0, np.full(len(names), 1e-12), 1e-12
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, v * w[c], n) + b, -30, 30)))
        e = (p - y) * weight_of
        g = np.bincount(c, v * e[r], len(names)) + decay * w
        sq += g * g
        sb += e.sum() ** 2
        w -= rate * g / np.sqrt(sq)
        b -= rate * e.sum() / np.sqrt(sb)
    weights = np.zeros(FAMILIES * SLOTS + 1)
    weights[names], weights[-1] = w, b
    s = np.bincount(row, value * weights[col], n) + b
    s, t = s[aside], y[aside]
    # Platt scaling with its smoothed targets, by Newton's method
    pos, neg = (t == 1).sum(), (t == 0).sum()
    t = np.where(t == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, k = np.stack([s, np.ones_like(s)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(k @ x, -30, 30)))
        k = k - np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-4 * np.eye(2), x @ (p - t) + 1e-4 * (k - [1, 0]))
    return weights, float(k[0]), float(k[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[list, np.ndarray]:
    """Features of at most ``per_class`` labelled texts of each quality, in an order set by hashes.
    They are made in tasks; the driver gets some 20 KB of them a text."""
    known = (labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other"))
    order = Window.partitionBy("quality").orderBy("h", "doc_id")
    chosen = (known.withColumn("h", F.xxhash64("doc_id", F.lit(5))).withColumn("n", F.row_number().over(order))
              .where(F.col("n") <= per_class).select("doc_id", "quality", "h"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            x = features(*buffers(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("doc_id"), b.column("quality"), pa.array([s.tobytes() for s, _ in x], pa.binary()), pa.array([v.tobytes() for _, v in x], pa.binary())],
                ["h", "doc_id", "quality", "slots", "shares"])

    # a bounded side: per_class rows for each of two classes; repeated documents count once
    found = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
             .groupBy("h", "doc_id", "quality").agg(F.max("text").alias("text"))
             .select("h", "doc_id", F.col("quality").cast("int"), "text")
             .mapInArrow(described, f"h long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, slots binary, shares binary").toPandas())
    found = found.sort_values(["h", "doc_id"])
    sample = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for s, v in zip(found["slots"], found["shares"], strict=True)]
    return sample, found["quality"].to_numpy(np.float64)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", keep: float = KEEP, per_class: int = SAMPLE,
          doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, the base columns, ``base_failed``, ``probability`` of good quality (null where
    not both qualities are labelled: then there is no model) and ``kept``, a row per row of ``docs``."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample, y = labelled_sample(given, labels, per_class)
    model = fit(sample, y) if len(set(y.tolist())) == 2 else None
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in slices(batches, "text", 1 << 20):
            data, offsets = buffers(b.column("text"))
            w = words(data, offsets)
            cols = base(w, data, offsets)
            if m:
                probability = 1 / (1 + np.exp(-np.clip(m[1] * scores(m[0], w, data, offsets) + m[2], -30, 30)))
            else:
                probability = np.full(b.num_rows, np.nan)
            failed = (cols["n_words"] < MIN_WORDS) | (100 * cols["n_repeat_words"] > MAX_REPEAT * cols["n_words"])
            kept = ~failed & ((probability >= keep) | np.isnan(probability))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(cols[k], pa.int64()) for k in names), pa.array(failed),
                 pa.array(probability, mask=np.isnan(probability)), pa.array(kept)],
                ["doc_id", *names, "base_failed", "probability", "kept"])

    return given.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, " + "".join(f"{k} long, " for k in names)
                            + "base_failed boolean, probability double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
