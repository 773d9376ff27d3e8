"""Words and hashes of whole Arrow text columns, a few array passes for each batch.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. Spark
partitions the rows; what is here works on one batch inside a task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is worked on alone.
SLICE_BYTES = 1 << 19

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser in place: each input bit moves about half of the output's."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def release() -> None:
    """Give freed memory back to the system, as a worker is kept for later tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _byte_values(fold: bool) -> np.ndarray:
    x = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        upper = np.arange(ord("A"), ord("Z") + 1)
        x[upper] = x[upper + 32]
    return x


#: A pseudorandom number for each byte; in the first, A-Z have those of a-z.
FOLDED, EXACT = _byte_values(True), _byte_values(False)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) that hold about ``size`` bytes each."""
    _, bounds = text_bytes(column)
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield a, b
        a = b


def scan(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of words in order; text i's words are first[i]:first[i + 1]."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[raw], out=inside[1 : n + 1])
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut) & (np.arange(n + 1) < n)) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut)) if n else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, bounds)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of every byte range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(12, (len(raw) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(h)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all words of a slice of texts."""
    raw, bounds = text_bytes(column)
    starts, ends, first = scan(raw, bounds)
    return range_hashes(raw, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of every run of ``k`` words; a text with fewer words, but some, has the whole run as its only one."""
    counts = np.diff(first)
    h = words.copy()
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[: max(n - j, 0)] = words[j:]
        rolled = rolled * np.uint64(_BASE) + part
    h = mix(rolled)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - first[:-1][text] if n else np.zeros(0, np.int64)
    whole = place <= counts[text] - k
    short = np.flatnonzero((counts > 0) & (counts < k))
    for i in short:
        v = np.uint64(counts[i])
        for w in words[first[i] : first[i + 1]]:
            v = np.uint64((int(v) * _BASE + int(w)) & 0xFFFFFFFFFFFFFFFF)
        h[first[i]] = mix(np.array([v], np.uint64))[0]
    keep = whole | ((place == 0) & (counts[text] < k))
    return h[keep], text[keep]
