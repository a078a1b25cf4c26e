"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor.
The leftmost-smaller (LMS) substrings are sorted by inducing L suffixes from
left to right and S suffixes from right to left; equal ones get one name; the
string of names is sorted recursively, and its order induces that of all
suffixes. Over bytes a whole bucket is induced at once in numpy; the strings
of names have an alphabet of their own and are induced element by element.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket in numpy.
_SMALL = 512


def _smaller(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last code is smaller than all others."""
    change = np.flatnonzero(s[1:] != s[:-1])
    out = np.empty(len(s), bool)
    out[:-1] = np.repeat(s[change] < s[change + 1], np.diff(change, prepend=-1))
    out[-1] = True
    return out


def _grouped(p: np.ndarray, codes: np.ndarray, sigma: int):
    """``p`` in stable order of its codes, those codes, ranks within a code, and counts by code."""
    order = np.argsort(codes, kind="stable")  # 16-bit codes: a radix sort
    codes = codes[order]
    counts = np.bincount(codes, minlength=sigma)
    first = np.cumsum(counts) - counts
    return p[order], codes, np.arange(len(p)) - first[codes], counts


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The order that the LMS positions ``seeds`` (ordered within each first code) induce."""
    size = np.bincount(s, minlength=sigma)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(len(s), -1, np.int32)
    p, codes, rank, n_seeds = _grouped(seeds, s[seeds], sigma)
    sa[end[codes] - n_seeds[codes] + rank] = p

    head = start.copy()

    def left(found: np.ndarray) -> None:
        p = found[found > 0] - 1
        p = p[~small[p]]
        if len(p):
            p, codes, rank, counts = _grouped(p, s[p], sigma)
            sa[head[codes] + rank] = p
            head[:] += counts

    for c in np.flatnonzero(size).tolist():
        done = start[c]
        while done < head[c]:  # what a bucket induces into itself comes in later rounds
            stop = int(head[c])
            left(sa[done:stop])
            done = stop
        if n_seeds[c]:
            left(sa[end[c] - n_seeds[c]:end[c]])

    tail = end.copy()

    def right(found: np.ndarray) -> None:
        p = found[found > 0] - 1
        p = p[small[p]]
        if len(p):
            p, codes, rank, counts = _grouped(p, s[p], sigma)
            sa[tail[codes] - 1 - rank] = p
            tail[:] -= counts

    for c in np.flatnonzero(size)[::-1].tolist():
        done = end[c]
        while tail[c] < done:
            stop = int(tail[c])
            right(sa[stop:done][::-1])
            done = stop
        right(sa[start[c]:head[c]][::-1])
    sa[0] = len(s) - 1  # the last code's suffix is induced by none
    return sa


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order: equal substrings share one. ``ordered``: the LMS positions, sorted."""
    length = np.zeros(len(s), np.int32)
    length[lms] = np.diff(lms, append=len(s) - 1) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    j = 0
    while len(live):
        differ = s[a[live] + j] != s[b[live] + j]
        same[live[differ]] = False
        j += 1
        live = live[~differ & (length[a[live]] > j)]
    name = np.empty(len(s), np.int32)
    name[ordered] = np.concatenate(([0], np.cumsum(~same)))
    return name[lms]


def _induced_list(s: list[int], sigma: int) -> list[int]:
    """Induced sorting element by element, for large alphabets. The last code is the unique smallest."""
    n = len(s)
    if n == 1:
        return [0]
    small = bytearray(n)
    small[n - 1] = 1
    for i in range(n - 2, -1, -1):
        if s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1]):
            small[i] = 1
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    size = np.bincount(np.array(s), minlength=sigma)
    ends = np.cumsum(size)
    starts, ends = (ends - size).tolist(), ends.tolist()

    def induce(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        tail = ends.copy()
        for i in reversed(seeds):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = starts.copy()
        for i in sa:  # entries are written ahead of the walk
            if i > 0 and not small[i - 1]:
                c = s[i - 1]
                sa[head[c]] = i - 1
                head[c] += 1
        tail = ends.copy()
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if i > 0 and small[i - 1]:
                c = s[i - 1]
                tail[c] -= 1
                sa[tail[c]] = i - 1
        return sa

    sa = np.array(induce(lms), np.int32)
    codes, places = np.array(s, np.int32), np.array(lms, np.int32)
    mark = np.zeros(n, bool)
    mark[places] = True
    sa[0] = n - 1
    name = _names(codes, places, sa[mark[sa]])
    if int(name.max()) + 1 == len(lms):
        order = np.argsort(name)
    else:
        order = np.array(_induced_list(name.tolist(), int(name.max()) + 1))
    out = induce(places[order].tolist())
    out[0] = n - 1
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``s`` (codes 0..). Its last code has to be the unique smallest, 0."""
    if len(s) == 1:
        return np.zeros(1, np.int32)
    sigma = int(s.max()) + 1
    if sigma > _SMALL:
        return np.array(_induced_list(s.tolist(), sigma), np.int32)
    s = s.astype(np.uint16)
    small = _smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    sa = _induce(s, small, lms, sigma)
    mark = np.zeros(len(s), bool)
    mark[lms] = True
    name = _names(s, lms, sa[mark[sa]])
    if int(name.max()) + 1 == len(lms):
        order = np.argsort(name)
    else:
        order = suffix_array(name)
    return _induce(s, small, lms[order], sigma)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each position of ``order`` in text order: whether its first ``limit`` codes equal its predecessor's in ``order``.

    The permuted array of common prefixes, cut at ``limit``. All positions
    have ``limit`` codes at least.
    """
    before = np.full(len(s), -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0).astype(np.int32)  # text order
    other = before[at]
    s = s.astype(np.uint8)
    packed = np.zeros(max(0, len(s) - 7), np.uint64)   # eight codes at each position
    for j in range(8):
        packed |= s[j:len(packed) + j].astype(np.uint64) << np.uint64(8 * j)
    equal = np.zeros(len(s), bool)
    live = np.arange(len(at))
    for j in [*range(0, limit - 7, 8), limit - 8]:
        live = live[packed[at[live] + j] == packed[other[live] + j]]
    equal[at[live]] = True
    return equal
