"""Words of whole texts as numpy arrays.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. In
UTF-8 these six bytes never occur inside another character, so splitting the
bytes equals splitting the characters. All functions work on the value and
offset buffers of an Arrow string column, without a Python object per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** (0..n)`` modulo 2**64; kept per worker and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        full = np.full(size, _U(base), _U)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=_U)
    return have


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (a bijection), so that nearby values become unrelated."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def as_strings(column: pa.Array) -> pa.Array:
    """The column as ``string`` (32-bit offsets are not assumed), nulls as empty."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; offsets start at 0."""
    column = as_strings(column)
    wide = pa.types.is_large_string(column.type)
    _, off, val = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(val, np.uint8) if val is not None and val.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a run of texts: text ``d`` has words ``first[d]:first[d + 1]``."""
    data: np.ndarray     # bytes of all texts
    start: np.ndarray    # byte where each word starts
    end: np.ndarray      # byte after each word
    first: np.ndarray    # len(texts) + 1
    hash: np.ndarray     # 64 bits per word

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Words up to this many bytes are hashed eight bytes a round, all words at once; longer ones singly.
SHORT = 64


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word. A round mixes the next eight bytes into the word's state by a bijection, so
    equal-length words up to eight bytes never collide, and words that share structure but not bytes
    (such as a word over two letters and its complement) collide no more often than any others."""
    size = end - start
    h = mix(size.astype(_U) + _U(0x9E3779B97F4A7C15))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    open_ = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        open_ = open_[size[open_] > at]
        if not len(open_):
            break
        left = np.minimum(size[open_] - at, 8).astype(_U)
        chunk = eight[start[open_] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
        h[open_] = mix((h[open_] ^ chunk) + _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]], digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Split texts into words and hash each word."""
    n = len(data)
    if lower:
        data = LOWER[data]
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(offsets), np.int64), np.zeros(0, _U))
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = np.zeros(n + 1, bool)
    ends[1:n] = solid[:-1] & ~solid[1:]
    ends[n] = solid[-1]
    edge = offsets[(offsets > 0) & (offsets < n)]  # a text ends a word even without white space
    begins[edge] = solid[edge]
    ends[edge] |= solid[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(data, start, end, np.searchsorted(start, offsets), _hashes(data, start, end))


def windows(w: np.ndarray, size: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (``len(w) - size + 1`` of them)."""
    n = len(w)
    if n < size:
        return np.zeros(0, _U)
    total = np.zeros(n + 1, _U)
    np.cumsum(w * powers(base, n)[:n], out=total[1:])
    m = n - size + 1
    return mix((total[size:] - total[:m]) * powers(inverse(base), n)[:m])


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Positions (into all words) where a window of ``size`` words of one text starts."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, np.maximum(first[1:] - size + 1, first[:-1]), -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding about ``limit`` bytes of text, one row at least. Rows are never cut."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i)
            i = j
