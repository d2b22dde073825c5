"""Vectorised text kernels over Arrow string columns: bytes, words, shingles.

Everything works on whole batches with numpy; nothing loops over words.  Hashes are
polynomials modulo 2**64 with an odd base, taken from prefix sums, then mixed.  Equal byte
strings always get equal hashes, in any batch and on any executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters only: A-Z lower-cased, every other ASCII byte a space.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], dtype=np.uint8)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown as needed and kept."""
    t = _tables.get(base)
    if t is None or len(t) < n:
        size = 1 << max(16, (n - 1).bit_length())
        t = np.ones(size, dtype=np.uint64)
        t[1:] = np.uint64(base)
        np.multiply.accumulate(t, out=t)
        _tables[base] = t
    return t[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def parts(column: pa.Array, most: int = 1 << 22):
    """(first row, data bytes, row offsets) of runs of rows with up to ``most`` bytes; a
    longer text is a run by itself.  Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, independent of position."""
    n = len(values)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=s[1:])
    inv = _INV if base == BASE else pow(base, -1, 1 << 64)
    return (s[end] - s[start]) * powers(inv, n + 1)[start]


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = LOWER):
    """(word hashes, first byte, end byte, word offsets of each row); ``table`` folds bytes."""
    b = table[data]
    n = len(b)
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    solid = ~SPACE[b]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    h = mix(span_hash(b, start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, start, end, np.searchsorted(start, off)


def shingles(h: np.ndarray, woff: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a row of fewer words has its whole
    sequence as one shingle, a row without words has none."""
    n_rows = len(woff) - 1
    count = np.diff(woff)
    row = np.repeat(np.arange(n_rows), count)
    ok = np.flatnonzero(np.arange(len(h)) + size <= woff[1:][row]) if len(h) else np.zeros(0, np.int64)
    key = np.zeros(len(ok), dtype=np.uint64)
    for k in range(size):
        key = (key + h[ok + k]) * np.uint64(BASE)
    short = np.flatnonzero((count > 0) & (count < size))
    extra = np.zeros(len(short), dtype=np.uint64)
    for k in range(size - 1):
        has = count[short] > k
        at = np.minimum(woff[short] + k, max(len(h) - 1, 0))
        extra = np.where(has, (extra + (h[at] if len(h) else np.uint64(0))) * np.uint64(BASE), extra)
    extra += count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return np.concatenate([mix(key), mix(extra)]), np.concatenate([row[ok], short])


def shingle_sets(column: pa.Array, size: int = 5):
    """Sorted distinct shingle hashes of each row, one array after another."""
    for _, data, off in parts(column):
        h, _, _, woff = words(data, off)
        key, row = shingles(h, woff, size)
        order = np.argsort(row, kind="stable")
        key, cut = key[order], np.searchsorted(row[order], np.arange(len(off)))
        for i in range(len(off) - 1):
            s = np.sort(key[cut[i] : cut[i + 1]])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
