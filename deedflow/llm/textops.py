"""Vectorised word, shingle and token work on Arrow string columns, for use inside tasks.

All functions take whole texts. A batch is walked in chunks of a few MB, so
that the working arrays stay small whatever the batch holds; a longer text is a
chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix constants); the input array is not changed."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seed(i: int) -> np.uint64:
    return mix(np.array([(i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]


def as_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and n + 1 offsets. Nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of rows of about ``size`` bytes together, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a run of texts: byte place, length, hash; ``first[d]`` is the first word of text d (n + 1 entries)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end, each with a 64-bit hash of its bytes."""
    n = len(offsets) - 1
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64))
    ink = (data != 32) & ((data < 9) | (data > 13))
    head = ink.copy()
    head[1:] &= ~ink[:-1]
    tail = ink.copy()
    tail[:-1] &= ~ink[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    head[inner] = ink[inner]
    tail[inner - 1] = ink[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64))
    return Words(data, start, end, run_hashes(data, start, end), np.searchsorted(start, offsets).astype(np.int64))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes [start, end); runs are in order and not empty."""
    length = end - start
    heads = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(heads, length)
    powers = np.full(int(length.max()), _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    value = (data[place + np.repeat(start, length)].astype(np.uint64) + U64(1)) * powers[place]
    return mix(np.add.reduceat(value, heads) + length.astype(np.uint64) * _GOLD)


@dataclass
class Shingles:
    """Hashes of runs of k words; ``first[d]`` is the first of text d. A text of 1 to k - 1 words has one of them all."""

    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def shingles(w: Words, k: int = 5) -> Shingles:
    n = len(w.hash)
    counts = w.counts
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    if n == 0:
        return Shingles(np.zeros(0, np.uint64), first)
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    total = np.zeros(n, np.uint64)
    ends = np.repeat(w.first[1:], counts)
    at = np.arange(n)
    for j in range(k):
        part = padded[j : j + n] * (seed(j) | U64(1))
        part[at + j >= ends] = 0
        total += part
    good = (at + k <= ends) | (at == np.repeat(w.first[:-1], counts))
    return Shingles(mix(total[good]), first)


def occurrence(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each value stood before in its own text (0 for the first time)."""
    if len(values) == 0:
        return np.zeros(0, np.int64)
    key = mix(values ^ mix(doc.astype(np.uint64) * _GOLD))
    order = np.argsort(key, kind="stable")
    run = key[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(run)) - begin
    return out


def labelled(s: Shingles) -> np.ndarray:
    """Occurrence-labelled shingle hashes: equal only for the same shingle at the same repetition."""
    occ = occurrence(s.hash, s.doc)
    return np.where(occ == 0, s.hash, mix(s.hash + occ.astype(np.uint64) * _GOLD))
