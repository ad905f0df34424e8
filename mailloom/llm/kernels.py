"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

Every function works on whole texts.  A null text is read as an empty one; callers that treat nulls
differently look at the column's validity themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_tables: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the constants of SplitMix64) over an array of uint64."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows, the first 0) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse, modulo 2**64."""
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["pow"][:n], _tables["inv"][:n]


def word_bytes() -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and all of other characters."""
    if "word" not in _tables:
        t = np.zeros(256, bool)
        for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
            t[a:b] = True
        _tables["word"] = t
    return _tables["word"]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (uint64) and row of each word, in text order.

    A word is a longest run of ASCII letters, ASCII digits and non-ASCII characters in one row.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = word_bytes()[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | first[1:n]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(head), np.flatnonzero(tail)
    up, down = _powers(n)
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    before = total[start - 1]
    before[start == 0] = 0
    h = (total[end] - before) * down[start]
    return mix64(h), np.searchsorted(off, start, "right") - 1


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, ordered by row; two pairs are told apart by 64 bits."""
    if len(h) == 0:
        return h, row
    key = h ^ mix64(row.astype(np.uint64), 7)
    _, at = np.unique(key, return_index=True)
    at.sort()
    return h[at], row[at]


def shingles(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of width words; a row of fewer words (but one at least) has one shingle of all of them."""
    if len(h) == 0 or width == 1:
        return h, row
    n = len(h)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[start, n])
    acc = h.copy()
    at = np.arange(n) - np.repeat(start, size)
    left = np.repeat(size, size) - at
    for k in range(1, width):
        more = left > k
        acc[:-k] = np.where(more[:-k], acc[:-k] * _MUL + h[k:], acc[:-k])
    use = (left >= width) | ((at == 0) & (left < width))
    return mix64(acc[use], 3), row[use]


def codepoints(data: np.ndarray, off: np.ndarray, pad: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) and their offsets by row; pad: with a blank before and after each row."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = data[at].astype(np.uint32)
    cp = b.copy()
    if len(b) and b.max() >= 0x80:
        ext = np.r_[data, np.zeros(3, np.uint8)]
        for low, high, take, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            sel = np.flatnonzero((b >= low) & (b < high))
            if len(sel):
                x = b[sel] & take
                for k in range(1, more + 1):
                    x = (x << np.uint32(6)) | (ext[at[sel] + k].astype(np.uint32) & 0x3F)
                cp[sel] = x
    out = np.searchsorted(at, off).astype(np.int64)
    if not pad:
        return cp, out
    rows = len(off) - 1
    full = np.full(len(cp) + 2 * rows, 0x20, np.uint32)
    row = np.repeat(np.arange(rows), np.diff(out))
    full[np.arange(len(cp)) + 2 * row + 1] = cp
    return full, out + 2 * np.arange(rows + 1)


def letters() -> np.ndarray:
    """Which code points are letters."""
    if "letter" not in _tables:
        t = np.zeros(0x110000, bool)
        t[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _tables["letter"] = t
    return _tables["letter"]


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The sum of values by row, for rows in order; 0 where a row has none."""
    out = np.zeros((rows, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    if len(values):
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[start]] = np.add.reduceat(values, start, axis=0, dtype=out.dtype)
    return out
