"""Words and bytes of Arrow string columns as numpy arrays, many documents at a time.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``, lower-cased A-Z only. Word
hashes are 64-bit polynomials over the bytes, read off one prefix sum for the whole
block, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Parts words at anything but ASCII letters, digits and non-ASCII bytes.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 18  # bytes handled at once; a longer document is a block of its own

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, BLOCK) + 1
        base = BASE if kind == "up" else pow(BASE, -1, 1 << 64)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _powers[kind] = np.cumprod(p)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``size`` bytes: first, last, bytes, offsets."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, parting: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, hash) of every word of a block; starts and ends are byte places in it."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    space = parting[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = ~space
    stop = start.copy()
    start[1:] &= space[:-1] | first[1:n]
    stop[:-1] &= space[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("up", n)[:n], out=total[1:])
    h = mix((total[e] - total[s]) * _power("down", n)[s])
    return np.searchsorted(off, s, "right") - 1, s, e, h


def word_counts(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each document's words begin: n + 1 places."""
    return np.searchsorted(doc, np.arange(n + 1))


def shingles(h: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, document by document, and where each document's begin.

    A document with fewer words has one: its whole sequence; with no words, none.
    """
    count = np.diff(at)
    n_out = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(n_out)])
    out = np.zeros(out_at[-1], np.uint64)
    if not len(out):
        return out, out_at
    src = np.arange(out_at[-1]) + np.repeat(at[:-1] - out_at[:-1], n_out)
    m = np.uint64(0xD6E8FEB86659FD93)
    whole = np.repeat(count, n_out)
    for k in range(width):
        inside = np.minimum(src + k, len(h) - 1)
        part = np.where(k < whole, h[inside], np.uint64(0))
        out = out * m + part
    out ^= np.minimum(whole, width).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return mix(out), out_at
