"""Vectorised hashes over the bytes of many texts at once.

Texts of an Arrow batch are read as one byte array. Prefix sums of a polynomial hash modulo 2**64
give the hash of any substring in constant time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_KEPT, _SHORT = 1 << 21, 64
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, below ``n``; only short tables are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    found = []
    for b in (BASE, _INVERSE):
        p = np.full(max(n, 1 << 16), b, dtype=np.uint64)
        p[0] = 1
        found.append(np.cumprod(p))
    if n <= _KEPT:
        _powers[:] = found
    return found[0][:n], found[1][:n]


def prefix_hashes(data: np.ndarray, salt: int = 0) -> np.ndarray:
    """Prefix sums; ``substring_hash`` reads them. Another salt gives an independent hash."""
    values = mix(_table + U(salt))[data] * powers(len(data) + 1)[0][: len(data)]
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo..hi`` of the batch whose texts (null: empty) have about ``most`` bytes, with their bytes and offsets; a longer text comes alone."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word (a run of bytes other than space and tab to carriage return; words end with their row).

    Words of over ``_SHORT`` bytes have a digest, as prefix sums are weak on long strings of a certain form. Hashes are
    taken in blocks of words, so that a long text needs no more memory than its words.
    """
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[True], gap])
    start = np.flatnonzero(~gap & (before[:-1] | edge[:-1]))
    after = np.concatenate([gap[1:], [True]]) if len(gap) else gap
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    out = np.empty(len(start), dtype=np.uint64)
    short = end - start <= _SHORT
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + block)))
        at, use = start[lo], short[lo:hi]
        if use.any():
            prefix = prefix_hashes(data[at : end[lo:hi][use][-1]])
            out[lo:hi][use] = substring_hash(prefix, start[lo:hi][use] - at, end[lo:hi][use] - at)
        lo = hi
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``width`` words; a text of fewer words has one run, of all; none without words."""
    words, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    if len(words) >= width:
        runs = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for k in range(width):
            runs = mix(runs + words[k : k + len(runs)])
    else:
        runs = np.empty(0, dtype=np.uint64)
    out = []
    for i in range(n):
        if count[i] >= width:
            out.append(np.unique(runs[first[i] : first[i + 1] - width + 1]))
        elif count[i]:
            h = U(count[i])
            for w in words[first[i] : first[i + 1]]:
                h = mix(np.atleast_1d(h) + w)[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
