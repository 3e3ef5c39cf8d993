"""Vectorised text kernels on the bytes of an Arrow column: words, polynomial span hashes, sliding minima.

Hashes are 64-bit polynomials over a random byte table, finished with a bit mixer. Equal spans have equal hashes; different
spans collide with a chance of about 2^-64 per compared pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Characters that separate words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TABLE = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:8] for i in range(256)), np.uint64).copy()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

CHUNK_BYTES = 2 << 20
KEPT_POWERS = 1 << 22  # longer tables serve one very long text and are not kept


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    made = _powers[base]
    if len(made) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        made = np.cumprod(steps, dtype=np.uint64)
        if n <= KEPT_POWERS:
            _powers[base] = made
    return made[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial of 64-bit values; `span_hash` takes differences of it."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), equal wherever the span stands."""
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start])


def rolling_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """`span_hash` of every window of `width` values."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:n]) * _power(_INVERSE, n))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values, by block-wise running minima from both sides."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    if width == 1:
        return x
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another and the offsets of each; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes of text (a longer text stands alone): first row, end row, bytes, offsets."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text (one entry more than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text starts here; the last entry is the end
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of [start, start + length), one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + shift


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; touching spans become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])]
