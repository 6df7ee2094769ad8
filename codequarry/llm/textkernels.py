"""Array kernels over Arrow string buffers: tokens and shingles without Python strings.

All functions take the flat UTF-8 bytes of a batch and its offsets, so a batch of
texts of any length is processed by a fixed number of array passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: ASCII letters, digits and underscore, as p1 defines a token.
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return b, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        n = max(n, 1 << 20)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            x = np.full(n, base, U64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["i"]


def tokens(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, number of tokens before each text plus the total).

    A token never crosses a text's end. The hash is a polynomial over the whole
    token, made from differences of one running sum, then mixed.
    """
    n = len(b)
    if not n:
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    t = TOKEN[b]
    first = np.zeros(n + 1, bool)
    first[off] = True
    first = first[:n]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = t[:-1]
    start = np.flatnonzero(t & (~prev | first))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = t[1:] & ~first[1:]
    end = np.flatnonzero(t & ~nxt) + 1
    p, inv = _powers(n)
    s = np.zeros(n + 1, U64)
    np.cumsum((LOWER[b].astype(U64) + U64(1)) * p[:n], out=s[1:])
    h = mix64((s[end] - s[start]) * inv[start])
    return h, np.searchsorted(start, off)


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` tokens of one text, with their bounds by text."""
    n = len(h) - width + 1
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out[1:])
    if n <= 0:
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    x = np.zeros(n, U64)
    for k in range(width):
        x = x * U64(0xD6E8FEB86659FD93) + h[k : k + n]
        x = x ^ (x >> U64(32))
    ok = np.zeros(len(h) + 1, np.int64)
    has = counts > 0
    np.add.at(ok, bounds[:-1][has], 1)
    np.add.at(ok, bounds[:-1][has] + counts[has], -1)
    return mix64(x)[np.cumsum(ok)[:n] > 0], out
