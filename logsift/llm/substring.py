"""Substring dedup: remove every word covered by a window that also starts elsewhere.

The operator packs the rows into blocks, and each block asks about the hashes
of its distinct windows. The hash space is cut into buckets; the task of a
bucket sees which hashes at least two blocks ask about and answers with one
bit per hash. A block adds the windows that it holds twice itself. A window
shared by any number of texts is asked about once per block, so no passage,
however frequent, gathers in one task, and nothing is dropped or capped.

Definitions: words are maximal runs of other than ``\\x20\\x09-\\x0D``,
unchanged. A window is ``size`` consecutive words of one text. Null and empty
texts have no words; texts with fewer words than a window lose nothing.
Repeated rows are separate texts, so each loses what it shares with the
other. Null ids and all other columns pass through. Windows are told apart by
64-bit hashes of 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, buckets, release, unpack
from .words import buffers, inside, windows, words

WINDOW = 35


def _windows(batch: pa.RecordBatch, text: str, size: int):
    """Words, window starts and window hashes of a block."""
    w = words(*buffers(batch.column(text)))
    at = inside(w.first, size)
    return w, at, windows(w.hash, size)[at]


def _requests(text: str, size: int, n_buckets: int):
    shift = np.uint64(64 - n_buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, blob in zip(b.column("block").to_pylist(), b.column("blob"), strict=True):
                h = np.unique(_windows(unpack(blob.as_py()), text, size)[2])
                release()
                if not len(h):
                    continue
                bucket = h >> shift
                cut = np.flatnonzero(np.diff(bucket)) + 1
                parts = np.split(h, cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[np.r_[0, cut]].astype(np.int32)), pa.array([name] * len(parts)),
                     pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "block", "asked"])
    return run


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """One bit per asked hash: does another block ask about it too?"""
    parts = [np.frombuffer(x, np.uint64) for x in asked["asked"]]
    every = np.concatenate(parts)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])

    def bits(p: np.ndarray) -> bytes:
        if not len(twice):
            return np.packbits(np.zeros(len(p), bool)).tobytes()
        at = np.minimum(np.searchsorted(twice, p), len(twice) - 1)
        return np.packbits(twice[at] == p).tobytes()

    return pd.DataFrame({"block": asked["block"], "bucket": asked["bucket"],
                         "n": [len(p) for p in parts], "bits": [bits(p) for p in parts]})


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Words (of ``n``) inside any window that starts at one of ``at``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:n]) > 0


def _remove(text: str, size: int, names: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(blob: bytes, answers: list[dict]) -> pa.RecordBatch:
            part = unpack(blob)
            w, at, h = _windows(part, text, size)
            gone = np.zeros(len(w.hash), bool)
            if len(at):
                distinct, back, count = np.unique(h, return_inverse=True, return_counts=True)
                known = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool)
                         for a in sorted(answers, key=lambda a: a["bucket"])]
                hit = np.concatenate(known) | (count > 1)
                assert len(hit) == len(distinct)
                gone = covered(len(w.hash), at[hit[back]], size)
            return _rows(part, w, gone, names)

        for b in batches:
            for blob, answers in zip(b.column("blob"), b.column("answers"), strict=True):
                yield one(blob.as_py(), answers.as_py())
                release()
    return run


def _rows(part: pa.RecordBatch, w, gone: np.ndarray, names: tuple[str, str, str]) -> pa.RecordBatch:
    """The rows with their kept words joined by one space."""
    raw, kept, lost = w.data.tobytes(), [], np.zeros(len(w.first) - 1, np.int64)
    start, end = w.start.tolist(), w.end.tolist()
    keep = (~gone).tolist()
    for d, (a, z) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        kept.append(b" ".join([raw[s:e] for s, e, k in zip(start[a:z], end[a:z], keep[a:z], strict=True) if k]))
    if len(gone):
        lost = np.diff(np.r_[0, np.cumsum(gone)][w.first])
    cols = [*part.columns, pa.array(np.diff(w.first), pa.int64()), pa.array(lost, pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(cols, [*part.schema.names, *names])


def substring_dedup(docs: DataFrame, text: str = "text", size: int = WINDOW,
                    names: tuple[str, str, str] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """All columns of ``docs`` and three more (``names``): words, words removed, kept words
    joined by one space. A column of ``docs`` with one of these names is replaced."""
    docs = docs.drop(*set(names) - {text})
    table = blocks(docs, text)
    n = buckets(docs.sparkSession)
    asked = table.mapInArrow(_requests(text, size, n), "bucket int, block string, asked binary")
    answers = (asked.groupBy("bucket").applyInPandas(_answer, "block string, bucket int, n int, bits binary")
               .groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + [f"`{names[0]}` long", f"`{names[1]}` long", f"`{names[2]}` string"])
    return (table.join(answers, "block", "left")
            .select("blob", F.coalesce("answers", F.expr("cast(array() as array<struct<bucket:int,n:int,bits:binary>>)")).alias("answers"))
            .mapInArrow(_remove(text, size, names), schema))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
