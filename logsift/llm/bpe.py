"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space. Each block of rows sends its distinct
words to hash buckets; a bucket encodes each distinct word once with the
tokenizers library and answers every block with the ids of the words it sent,
in its order. The block joins them back by position. Decoding joins each id
with its piece: the vocabulary is a fixed table of the tokenizer, so it goes
to the tasks whole.

This equals encoding whole texts for tokenizers whose normalizer and
pre-tokenizer never join characters across white space and drop white space
itself (``splits_at_space`` checks that on the tokenizer's own description).
A frequent word is sent once per block, so no word gathers in one task.

Null and empty texts have no ids and decode to the empty text. Long words are
words like others. Repeated rows and null ids of rows pass through, as do all
other columns.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, buckets, release, unpack
from .words import buffers, words

#: Larger blocks repeat fewer words and take more of a worker's memory.
BLOCK_BYTES = 4 << 20
_tokenizers = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(text: str):
    """The tokenizer of a description, once per worker; unused padding and truncation are off."""
    key = hash(text)
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = _tokenizers[key] = Tokenizer.from_str(text)
        t.no_padding()
        t.no_truncation()
    return _tokenizers[key]


def splits_at_space(text: str) -> bool:
    """White space is replaced by blanks and then left out, added tokens don't reach over it,
    and no decoder or prefix depends on a token's neighbours."""
    d = json.loads(text)
    steps = json.dumps(d["pre_tokenizer"])
    return ('"add_prefix_space": true' not in steps and "Metaspace" not in steps and d["decoder"] is None
            and '\\\\s+' in json.dumps(d["normalizer"]) and '[^\\\\s' in steps
            and not any(any(c.isspace() for c in a["content"]) or a["single_word"] for a in d["added_tokens"]))


def _distinct(batch: pa.RecordBatch, text: str):
    """Words of a block, the first place of each distinct word in the order of its hash, and each
    word's number in it. Words of one hash are compared by their bytes."""
    w = words(*buffers(batch.column(text)))
    h, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    if not _equal(w, at[back]):
        raw = w.data.tobytes()
        keys = [(x, raw[s:e]) for x, s, e in zip(w.hash.tolist(), w.start.tolist(), w.end.tolist(), strict=True)]
        first = {k: i for i, k in reversed(list(enumerate(keys)))}
        order = sorted(first)
        number = {k: i for i, k in enumerate(order)}
        h = np.array([k[0] for k in order], np.uint64)
        at, back = np.array([first[k] for k in order]), np.array([number[k] for k in keys])
    return w, h, at, back


def _equal(w, other: np.ndarray, run: int = 1 << 15) -> bool:
    """Has every word the bytes of the word ``other`` (a place for each word)?"""
    size = w.end - w.start
    if (size != size[other]).any():
        return False
    for i in range(0, len(size), run):  # the indices of a run take 16 bytes a byte
        n, o = size[i:i + run], other[i:i + run]
        if (w.data[_ranges(w.start[i:i + run], n)] != w.data[_ranges(w.start[o], n)]).any():
            return False
    return True


def _shipped(raw: bytes, w, at: np.ndarray, bucket: np.ndarray):
    """Distinct words bucket by bucket, in byte order inside each (which compresses well):
    ``(bucket, words, their numbers)``."""
    start, end = w.start[at].tolist(), w.end[at].tolist()
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(at)] if len(at) else []
    for i, j in zip(cut, cut[1:], strict=False):
        part = sorted((raw[start[k]:end[k]], k) for k in range(i, j))
        yield int(bucket[i]), [x for x, _ in part], [k for _, k in part]


def _requests(text: str, n_buckets: int):
    shift = np.uint64(64 - n_buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        z = zstandard.ZstdCompressor(3)

        def ask(name: str, blob: bytes) -> pa.RecordBatch:
            w, h, at, _ = _distinct(unpack(blob), text)
            asked = [(k, z.compress(b"\n".join(x))) for k, x, _ in _shipped(w.data.tobytes(), w, at, h >> shift)]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in asked], pa.int32()), pa.array([name] * len(asked), pa.string()), pa.array([x for _, x in asked], pa.binary())],
                ["bucket", "block", "sent"])

        for b in batches:
            for name, blob in zip(b.column("block"), b.column("blob"), strict=True):
                yield ask(name.as_py(), blob.as_py())
                release()
    return run


def _encode(description: str, id_type):
    def run(sent: pd.DataFrame) -> pd.DataFrame:
        import zstandard
        z, unz = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        asked = [unz.decompress(x, max_output_size=1 << 31).split(b"\n") for x in sent["sent"]]
        number: dict[bytes, int] = {}
        numbers = [np.fromiter((number.setdefault(x, len(number)) for x in a), np.int64, len(a)) for a in asked]
        every, t = list(number), tokenizer(description)
        ids: list[np.ndarray] = []
        for i in range(0, len(every), 4096):
            ids += [np.array(e.ids, np.int32) for e in t.encode_batch_fast([x.decode() for x in every[i:i + 4096]], add_special_tokens=False)]
        size = np.array([len(x) for x in ids], np.int32)
        flat, first = np.concatenate(ids), np.r_[0, np.cumsum(size)]
        out = []
        for k in numbers:
            n = size[k]
            out.append(z.compress(n.tobytes() + flat[_ranges(first[k], n)].astype(id_type).tobytes()))
        return pd.DataFrame({"block": sent["block"], "bucket": sent["bucket"], "ids": out})
    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ..`` (``size[i]`` of them) for each i in turn."""
    total = int(size.sum())
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total) if total else np.zeros(0, np.int64)


def _join(text: str, n_buckets: int, id_type, pieces_of, names: tuple[str, str]):
    shift = np.uint64(64 - n_buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unz, pieces = zstandard.ZstdDecompressor(), np.array(pieces_of.value, object)

        def joined(blob: bytes, answered: list[dict]) -> pa.RecordBatch:
            part = unpack(blob)
            w, h, at, back = _distinct(part, text)
            answers = {a["bucket"]: a["ids"] for a in answered}
            sizes, flats, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
            for bucket, sent, numbers in _shipped(w.data.tobytes(), w, at, h >> shift):
                raw = unz.decompress(answers[bucket], max_output_size=1 << 31)
                sizes.append(np.frombuffer(raw, np.int32, len(sent)))
                flats.append(np.frombuffer(raw, id_type, offset=4 * len(sent)).astype(np.int32))
                order += numbers
            size, flat, place = np.concatenate(sizes), np.concatenate(flats), np.empty(len(h), np.int64)
            place[order] = np.arange(len(h))
            back = place[back]  # from here on, words count in the order they were sent
            first = np.r_[0, np.cumsum(size)]
            n = size[back]
            ids = flat[_ranges(first[:-1][back], n)]
            edge = np.r_[0, np.cumsum(n)][w.first]
            # each distinct word is decoded once; a word without ids leaves nothing
            named = pieces[flat]
            said = np.array([" ".join(named[a:z].tolist()) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], object)
            decoded = []
            for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                decoded.append(" ".join(said[back[a:z][n[a:z] > 0]].tolist()))
            cols = [*part.columns, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays(cols, [*part.schema.names, *names])

        for b in batches:
            for blob, answered in zip(b.column("blob"), b.column("answers"), strict=True):
                yield joined(blob.as_py(), answered.as_py())
                release()
    return run


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None,
                  names: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """All columns of ``docs`` and two more: the ids of the whole text (array<int>, no special
    tokens added) and the text decoded from them (special tokens kept). ``path``: the
    tokenizer's description, read on the driver. A column of ``docs`` with one of the new names
    is replaced."""
    docs = docs.drop(*set(names) - {text})
    with open(path or default_path(), encoding="utf-8") as f:
        description = f.read()
    if not splits_at_space(description):
        raise ValueError("this tokenizer does not split at white space")
    vocabulary = tokenizer(description).get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece
    id_type = np.uint16 if len(pieces) <= 1 << 16 else np.int32
    spark = docs.sparkSession
    table = blocks(docs, text, BLOCK_BYTES)
    n = buckets(docs.sparkSession)
    sent = table.mapInArrow(_requests(text, n), "bucket int, block string, sent binary")
    answers = (sent.groupBy("bucket").applyInPandas(_encode(description, id_type), "block string, bucket int, ids binary")
               .groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("answers")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + [f"`{names[0]}` array<int>", f"`{names[1]}` string"])
    return (table.join(answers, "block", "left")
            .select("blob", F.coalesce("answers", F.expr("cast(array() as array<struct<bucket:int,ids:binary>>)")).alias("answers"))
            .mapInArrow(_join(text, n, id_type, spark.sparkContext.broadcast(pieces), names), schema))


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``more``, and what is told about ids and decoded texts."""
    return coded.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
