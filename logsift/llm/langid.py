"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in runs of ``SPAN`` bytes in both directions,
labels every position with a probability per language, and a document's
probabilities are the means over all its positions. Whole texts are read.
Cells have one gate with a hard sigmoid and a hard tanh candidate:

    f = clip(Wf[x] + Uf h, 0, 1);  c = clip(Wc[x] + f * (Uc h), -1, 1);  h += f * (c - h)

It is trained on the driver in numpy by backpropagation through time, on runs
of bytes cut from a bounded sample: at most ``PER_LANGUAGE`` documents of each
language, lowest hash of the id first, ``RUNS`` runs from each. Nothing but the
text is ever an input of a prediction.

Null texts and texts without a letter get ``und`` and score 0, and so does
every text if no labelled document exists. A text shorter than a run is read
over and over, but each of its positions counts once. Repeated rows get equal
predictions. Rows with a null id are predicted but never learned from and
count as held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import buffers, slices

UNKNOWN = "und"
SPAN = 128           # bytes that are read without a new start
HIDDEN = 8
PER_LANGUAGE = 400   # documents to learn from, per language
RUNS = 4             # runs of TRAIN_SPAN bytes from each
TRAIN_SPAN = 64
STEPS, BATCH, RATE = 260, 192, 0.02


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


# ---------------------------------------------------------------- the network

def _fresh(n_lang: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["W" + d] = rng.normal(0, 0.3, (2 * HIDDEN, 256))
        p["W" + d][:HIDDEN] += 0.4
        p["U" + d] = rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN))
        p["V" + d] = rng.normal(0, 0.3, (n_lang, HIDDEN))
    p["c"] = np.zeros((n_lang, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(w: np.ndarray, u: np.ndarray, x: np.ndarray):
    """All states of one direction over ``x`` (time, run), and what the way back needs."""
    t, n = x.shape
    h = np.zeros((t + 1, HIDDEN, n), np.float32)
    f, q, a, g = (np.empty((t, HIDDEN, n), np.float32) for _ in range(4))
    for s in range(t):
        z, e = u @ h[s], w[:, x[s]]
        a[s] = z[:HIDDEN] + e[:HIDDEN]
        f[s] = np.clip(a[s], 0, 1)
        q[s] = z[HIDDEN:]
        g[s] = f[s] * q[s] + e[HIDDEN:]
        h[s + 1] = h[s] + f[s] * (np.clip(g[s], -1, 1) - h[s])
    return h, f, q, a, g


def _backward(u: np.ndarray, x: np.ndarray, kept, dh_out: np.ndarray):
    """Gradients of W and U by backpropagation through time."""
    h, f, q, a, g = kept
    t, n = x.shape
    dz, de = np.empty((t, 2 * HIDDEN, n), np.float32), np.empty((t, 2 * HIDDEN, n), np.float32)
    dh = np.zeros((HIDDEN, n), np.float32)
    for s in range(t - 1, -1, -1):
        dh = dh + dh_out[s]
        dc = dh * f[s] * (np.abs(g[s]) < 1)
        df = dh * (np.clip(g[s], -1, 1) - h[s]) + dc * q[s]
        da = df * ((a[s] > 0) & (a[s] < 1))
        dz[s, :HIDDEN], dz[s, HIDDEN:] = da, dc * f[s]
        de[s, :HIDDEN], de[s, HIDDEN:] = da, dc
        dh = dh * (1 - f[s]) + u.T @ dz[s]
    du = np.einsum("tin,tjn->ij", dz, h[:-1], optimize=True)
    flat = x.ravel()
    dw = np.stack([np.bincount(flat, de[:, i].ravel(), 256) for i in range(2 * HIDDEN)])
    return dw, du


def train(x: np.ndarray, y: np.ndarray, n_lang: int, seed: int = 7, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Fit to runs of bytes ``x`` (run, time) with language numbers ``y``; Adam, cross entropy at
    every position."""
    rng = np.random.default_rng(seed)
    p = _fresh(n_lang, rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    by_lang = [np.flatnonzero(y == k) for k in range(n_lang)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(i, max(1, BATCH // n_lang)) for i in by_lang])
        xt, target = np.ascontiguousarray(x[pick].T), y[pick]
        t, n = xt.shape
        kf, kb = _forward(p["Wf"], p["Uf"], xt), _forward(p["Wb"], p["Ub"], xt[::-1])
        hf, hb = kf[0][1:], kb[0][1:][::-1]
        logits = p["Vf"] @ hf + p["Vb"] @ hb + p["c"]
        logits -= logits.max(1, keepdims=True)
        d = np.exp(logits)
        d /= d.sum(1, keepdims=True)
        d[:, target, np.arange(n)] -= 1
        d /= t * n
        g = {"c": d.sum((0, 2))[:, None], "Vf": np.einsum("tln,thn->lh", d, hf, optimize=True),
             "Vb": np.einsum("tln,thn->lh", d, hb, optimize=True)}
        g["Wf"], g["Uf"] = _backward(p["Uf"], xt, kf, p["Vf"].T @ d)
        g["Wb"], g["Ub"] = _backward(p["Ub"], xt[::-1], kb, (p["Vb"].T @ d)[::-1])
        rate = RATE * min(1, 3 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        for k, q in g.items():
            q = q * min(1, 1 / max(norm, 1e-9))
            m[k] += 0.1 * (q - m[k])
            v2[k] += 0.01 * (q * q - v2[k])
            p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return p


def _steps(w: np.ndarray, u: np.ndarray, x: np.ndarray):
    """States of one direction, one position at a time (the array is used again)."""
    n = x.shape[1]
    h, z, e = np.zeros((HIDDEN, n), np.float32), np.empty((2 * HIDDEN, n), np.float32), np.empty((2 * HIDDEN, n), np.float32)
    f, c = z[:HIDDEN], z[HIDDEN:]
    for row in x:
        np.matmul(u, h, out=z)
        np.take(w, row, axis=1, out=e, mode="clip")
        f += e[:HIDDEN]
        np.clip(f, 0, 1, out=f)
        c *= f
        c += e[HIDDEN:]
        np.clip(c, -1, 1, out=c)
        c -= h
        c *= f
        h += c
        yield h


def document_probabilities(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability of each language over all positions of each text (0 for empty ones)."""
    size = np.diff(offsets)
    n_lang = len(p["c"])
    runs = -(-size // SPAN)
    doc = np.repeat(np.arange(len(size)), runs)
    if not len(doc):
        return np.zeros((len(size), n_lang))
    k = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(runs)[:-1]], runs)
    # a last run that isn't full starts earlier and counts only what no run before it has read
    start = np.maximum(np.minimum(k * SPAN, size[doc] - SPAN), 0)
    lo, hi = k * SPAN - start, np.minimum(size[doc], SPAN)
    t = np.arange(SPAN)[:, None]
    x = data[offsets[doc] + (start + t) % size[doc]].astype(np.intp)
    ahead = np.empty((SPAN, n_lang, len(doc)), np.float32)
    for s, h in enumerate(_steps(p["Wf"], p["Uf"], x)):
        np.matmul(p["Vf"], h, out=ahead[s])
    total = np.zeros((n_lang, len(doc)), np.float32)
    for s, h in zip(range(SPAN - 1, -1, -1), _steps(p["Wb"], p["Ub"], x[::-1]), strict=True):
        q = ahead[s]
        q += p["Vb"] @ h
        q += p["c"]
        np.clip(q, -30, 30, out=q)
        np.exp(q, out=q)
        q *= ((s >= lo) & (s < hi)) / q.sum(0)
        total += q
    sums = np.stack([np.bincount(doc, row, len(size)) for row in total], 1)
    return sums / np.maximum(size, 1)[:, None]


# ---------------------------------------------------------------- Spark

def training_runs(docs: DataFrame, text: str, lang: str, doc_id: str, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The bounded sample: runs of bytes, language numbers, languages. Only the sampled
    documents' runs come to the driver; rows that repeat an id and language count as one."""
    d = (docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
         .where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = d.select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column("text"))
            for i, (name, id_) in enumerate(zip(b.column("lang").to_pylist(), b.column("id").to_pylist(), strict=True)):
                raw = data[offsets[i]:offsets[i + 1]]
                rng = np.random.default_rng(abs(int(id_)))
                at = rng.integers(0, max(1, len(raw) - TRAIN_SPAN + 1), RUNS)
                runs = [np.resize(raw[a:a + TRAIN_SPAN], TRAIN_SPAN).tobytes() for a in at]
                yield pa.RecordBatch.from_arrays([pa.array([name] * RUNS), pa.array([id_] * RUNS, pa.int64()), pa.array(runs, pa.binary())], ["lang", "id", "run"])

    # at most per_language rows a language: a bounded side
    found = (d.withColumn("id", F.col("id").cast("long"))
             .join(F.broadcast(chosen.withColumn("id", F.col("id").cast("long")).distinct()), ["id", "lang"])
             .groupBy("lang", "id").agg(F.max("text").alias("text"))  # repeated rows count once
             .mapInArrow(cut, "lang string, id long, run binary").toPandas())
    found = found.sort_values(["lang", "id", "run"], kind="stable")
    names = sorted(found["lang"].unique())
    x = np.frombuffer(b"".join(map(bytes, found["run"])), np.uint8).reshape(-1, TRAIN_SPAN)
    return x, np.searchsorted(names, found["lang"]) if names else np.zeros(0, int), names


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
             per_language: int = PER_LANGUAGE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and the predicted language and its probability. Learns from the
    same rows (see the module's text); the integer ``doc_id`` only picks them. A column of
    ``docs`` with one of the new names is replaced."""
    docs = docs.drop(*set(names) - {text})
    x, y, langs = training_runs(docs, text, lang, doc_id, per_language)
    p = train(x, y, len(langs)) if langs else None
    columns, letter = docs.columns, "_has_letter"
    while letter in columns:
        letter += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*langs, UNKNOWN], object)
        for b in slices(batches, text, 1 << 20):
            has = b.column(letter).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(b.num_rows, len(langs)), np.zeros(b.num_rows)
            if p is not None and has.any():
                prob = document_probabilities(p, *buffers(b.column(text)))
                best[has], score[has] = prob[has].argmax(1), np.clip(prob[has].max(1), 0, 1)
            cols = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n != letter]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(known[best], pa.string()), pa.array(score)], [*columns, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{names[0]}` string", f"`{names[1]}` double"])
    return docs.withColumn(letter, F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
