"""The matching blocks of two sequences as difflib.SequenceMatcher finds them, by arrays."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Pairs of equal elements that are held as arrays at most; where there are more, difflib does the work, with the same result.
MOST = 8_000_000


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places in a and b of equal elements that aren't popular in b, by diagonals and in order on each."""
    count = np.bincount(b, minlength=int(max(a.max(), b.max())) + 1)
    if len(b) >= 200:
        usable = np.where(count > len(b) // 100 + 1, 0, count)
    else:
        usable = count
    each = usable[a]
    total = int(each.sum())
    if total > MOST:
        return None
    i = np.repeat(np.arange(len(a)), each)
    by = np.argsort(b, kind="stable")
    start = (np.cumsum(count) - count)[a]
    j = by[np.repeat(start - (np.cumsum(each) - each), each) + np.arange(total)]
    order = np.argsort((j - i) * (len(a) + 1) + i, kind="stable")
    return i[order], j[order]


def blocks(x: list, y: list) -> list[tuple[int, int, int]]:
    """Place in x, place in y and length of each block, in order, the last of length 0: SequenceMatcher(None, x, y).get_matching_blocks()."""
    if x == y:
        return [(0, 0, len(x)), (len(x), len(x), 0)] if x else [(0, 0, 0)]
    numbers: dict = {}
    a, b = ([numbers.setdefault(t, len(numbers)) for t in s] for s in (x, y))
    found = _pairs(np.array(a), np.array(b)) if a and b else (np.zeros(0, np.int64),) * 2
    if found is None:
        return [tuple(m) for m in SequenceMatcher(None, x, y).get_matching_blocks()]
    out, open_ = [], [(0, len(a), 0, len(b), *found)]
    while open_:
        alo, ahi, blo, bhi, i, j = open_.pop()
        p, q, size = alo, blo, 0
        if len(i):
            # Runs on a diagonal; the longest one, of those the first in a, then in b.
            begin = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)])
            length = np.diff(np.r_[begin, len(i)])
            size = int(length.max())
            top = begin[length == size]
            first = top[i[top] == i[top].min()]
            k = first[j[first].argmin()]
            p, q = int(i[k]), int(j[k])
        while p > alo and q > blo and a[p - 1] == b[q - 1]:
            p, q, size = p - 1, q - 1, size + 1
        while p + size < ahi and q + size < bhi and a[p + size] == b[q + size]:
            size += 1
        if size:
            out.append((p, q, size))
            if alo < p and blo < q:
                low = (i < p) & (j < q)
                open_.append((alo, p, blo, q, i[low], j[low]))
            if p + size < ahi and q + size < bhi:
                high = (i >= p + size) & (j >= q + size)
                open_.append((p + size, ahi, q + size, bhi, i[high], j[high]))
    out.sort()
    joined: list[tuple[int, int, int]] = []
    for p, q, size in out:
        if joined and joined[-1][0] + joined[-1][2] == p and joined[-1][1] + joined[-1][2] == q:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + size)
        else:
            joined.append((p, q, size))
    return [*joined, (len(a), len(b), 0)]


def ratio(x: list, y: list) -> float:
    """SequenceMatcher(None, x, y).ratio()."""
    return 2.0 * sum(size for _, _, size in blocks(x, y)) / (len(x) + len(y)) if x or y else 1.0
