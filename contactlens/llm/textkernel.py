"""Vectorised word hashing over whole Arrow string columns (numpy inside tasks).

A column's UTF-8 bytes are treated as one array. Words are runs of bytes that
are not separators, cut at document borders; a word's 64-bit hash is a
polynomial over its bytes taken from one running sum, so the cost does not
depend on word lengths. Texts are handled in slices of some megabytes to keep
memory bounded; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: bytes 0x09-0x0D and 0x20 end a word
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0], _POW[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` for runs of rows of about ``limit`` bytes; null texts are empty."""
    col = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray, lower: bool = True
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and per text the index of its first word (n + 1 entries)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    b = _LOWER[data] if lower else data
    inside = ~separator[b]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    power, inverse = _powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts])
    return starts, ends, h, np.searchsorted(starts, off)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within one text, and per text the index of its first run."""
    step = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    m = len(h) - n + 1
    counts = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=begin[1:])
    if m <= 0 or begin[-1] == 0:
        return np.zeros(0, np.uint64), begin
    g = h[:m] * step[0]
    for j in range(1, n):
        g += h[j:j + m] * step[j]
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    return mix(g[at]), begin


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``n``-word shingles.

    A text of fewer words has its whole word sequence as its one shingle; a
    text without words has none. Words are runs of non-space bytes, A-Z lower-cased.
    """
    _, _, h, first = words(data, off, SPACE)
    g, begin = ngrams(h, first, n)
    for k in range(len(off) - 1):
        if begin[k + 1] > begin[k]:
            yield np.unique(g[begin[k]:begin[k + 1]])
        elif first[k + 1] > first[k]:
            w = h[first[k]:first[k + 1]]
            step = mix(np.arange(1, len(w) + 1, dtype=np.uint64) + np.uint64(1000 * len(w))) | np.uint64(1)
            yield mix(np.array([(w * step).sum(dtype=np.uint64)]))
        else:
            yield np.zeros(0, np.uint64)
