"""Banded bit-parallel edit distance over many pairs of byte strings at once."""

from __future__ import annotations

import numpy as np


def padded(data: np.ndarray, start: np.ndarray, end: np.ndarray, left: int, right: int) -> np.ndarray:
    """Strings as rows of uint16, 256 where there is no byte."""
    length = end - start
    width = left + int(length.max(initial=0)) + right
    out = np.full((len(start), width), 256, np.uint16)
    row = np.repeat(np.arange(len(start)), length)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[row, left + within] = data[np.repeat(start, length) + within]
    return out


def within(data: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """Whether data[a] and data[b] (start, end arrays) are at most ``limit`` edits apart.

    One 64-bit word holds the column of a band of 2 * limit + 1 diagonals
    (limit at most 30); every step moves all pairs one column on.
    """
    swap = (a[1] - a[0]) < (b[1] - b[0])
    long = (np.where(swap, b[0], a[0]), np.where(swap, b[1], a[1]))
    short = (np.where(swap, a[0], b[0]), np.where(swap, a[1], b[1]))
    m, n = long[1] - long[0], short[1] - short[0]
    out = m - n <= limit
    work = np.flatnonzero(out & (m > limit))  # shorter ones are within the limit anyway
    for part in np.array_split(work[np.argsort(m[work], kind="stable")], max(1, int(m[work].sum() * 2 // (32 << 20)) + 1)):
        if len(part):
            out[part] = _band(data, (long[0][part], long[1][part]), (short[0][part], short[1][part]), limit)
    return out


def _band(data, long, short, limit: int) -> np.ndarray:
    m, n = long[1] - long[0], short[1] - short[0]
    x = np.ascontiguousarray(padded(data, *long, limit, limit + 1).T)
    y = np.ascontiguousarray(padded(data, *short, 0, 1).T)
    one = np.uint64(1)
    vp = np.full(len(m), (0xFFFFFFFFFFFFFFFF << (63 - limit)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    vn = np.zeros(len(m), np.uint64)
    top = np.uint64(1 << 63)
    side = np.full(len(m), 1 << 62, np.uint64)
    distance = np.full(len(m), limit, np.int64)
    low = 63 - 2 * limit
    for i in range(int(n.max(initial=0))):
        same = np.zeros(len(m), np.uint64)
        for t in range(2 * limit + 1):
            if i + t < len(x):
                same |= (x[i + t] == y[i]).astype(np.uint64) << np.uint64(low + t)
        d0 = (((same & vp) + vp) ^ vp) | same | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        along = i < m - limit  # still on the band's diagonal; then along the last row
        last = ~along & (i < n)
        distance += along & ((d0 & top) == 0)
        distance += last & ((hp & side) != 0)
        distance -= last & ((hn & side) != 0)
        side = np.where(last, side >> one, side)
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
        if i % 16 == 15 and not ((distance <= 2 * limit + 1) & (i < n)).any():
            break
    return distance <= limit


def sequences_within(a: list, b: list, limit: int) -> bool:
    """Whether two lists are at most ``limit`` edits of items apart; any length and limit (bit vectors are Python integers)."""
    if abs(len(a) - len(b)) > limit:
        return False
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if not a or not b:
        return len(a) + len(b) <= limit
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    vp, vn, distance = every, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        d0 = ((((same & vp) + vp) ^ vp) | same | vn) & every
        hp, hn = vn | (every & ~(d0 | vp)), d0 & vp
        distance += bool(hp & last) - bool(hn & last)
        hp, hn = hp << 1 | 1, hn << 1
        vp, vn = (hn | ~(d0 | hp)) & every, hp & d0 & every
    return distance <= limit
