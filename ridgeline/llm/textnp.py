"""Vectorised text helpers for tasks that receive Arrow batches.

Texts are handled as one UTF-8 byte buffer with row offsets, cut into chunks of
a bounded number of bytes (one row at least), so that memory does not depend on
the batch or the table. Words never cross a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_A = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, every other byte unchanged.
LOWER = np.where((_A >= 65) & (_A <= 90), _A + 32, _A).astype(np.uint8)
#: The six ASCII white-space bytes: blank, tab, line feed, VT, FF, CR.
SPACE = (_A == 0x20) | ((_A >= 0x09) & (_A <= 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for hashes built by sums and products."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9FB21C651E98DF25  # odd, so it has an inverse modulo 2**64
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64 (kept and grown)."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive row ranges."""
    data, offsets = utf8(texts)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word k is data[starts[k]:ends[k]]; row i has the words first[i]:first[i+1]."""
    word = ~sep[data]
    start, last = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]  # rows that are not empty begin here
    start[rows] = word[rows]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = word[ends]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: equal ranges have equal hashes wherever they stand."""
    power, inverse = _base_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _place(j: int) -> np.uint64:
    """An odd constant for the j-th word of a window."""
    return np.uint64(2 * (0x5851F42D4C957F2D * (j + 1) % (1 << 62)) + 1)


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of each window of k consecutive words of a row."""
    acc = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        acc += words[j:len(words) - k + 1 + j] * _place(j) if len(acc) else acc
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(acc)]
    at = np.flatnonzero(np.arange(len(acc)) + k <= first[1:][row])
    return mix(acc[at]), row[at], at


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each k-word shingle; a row with 1 to k-1 words has its whole sequence as one."""
    hashes, rows, _ = windows(words, first, k)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = n[short].astype(np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            whole[has] += words[first[short][has] + j] * _place(j)
        hashes = np.concatenate([hashes, mix(whole)])
        rows = np.concatenate([rows, short])
    return hashes, rows


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the lines of each row, split at line feeds."""
    feeds = np.flatnonzero(data == 10)
    n = np.diff(np.searchsorted(feeds, offsets)) + 1
    return (np.sort(np.concatenate([offsets[:-1], feeds + 1])), np.sort(np.concatenate([feeds, offsets[1:]])),
            np.repeat(np.arange(len(n)), n))


def running(mask: np.ndarray) -> np.ndarray:
    """Counts of true values before each position, and in all at the end."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs in order of row and hash, and how often each occurs."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))
