"""Suffix arrays by induced sorting, with the induction done bucket by bucket in numpy.

Suffixes are classed as S or L; the leftmost S suffixes (LMS) are sorted by inducing from their
unsorted places, the LMS substrings are named and, unless the names are unique, the string of names
is sorted recursively; then the whole array is induced from the sorted LMS suffixes. Within a
bucket the scan only appends to the same or to later buckets, so each bucket is handled in a few
vector steps. The string of names may have a large alphabet: then each name is written as two
digits, which keeps the order of suffixes, and the recursion has few buckets again. Deep in the
recursion, where strings are short and many levels would follow, they are sorted by doubling prefixes.
"""

from __future__ import annotations

import numpy as np

from .common import ranges

#: Alphabets over _SMALL are written as two digits; strings of at most _SHORT symbols end the recursion.
_SMALL, _SHORT = 256, 1 << 17


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    """Suffix array of the symbols t (0 <= t < k); a suffix that is a prefix of another sorts first."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    if n <= _SHORT:
        return _short(t)
    k = int(t.max()) + 1 if k is None else k
    t = t.astype(np.uint8 if k <= 1 << 8 else np.uint16 if k <= 1 << 16 else np.int64)  # short ones sort by radix
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    m = len(lms)
    buckets = _Buckets(t, is_s, k)
    if m:
        sa = buckets.induce(lms[np.argsort(t[lms], kind="stable")], first=True)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        lms_sorted = sa[is_lms[sa]]
        names, count = _names(t, lms, lms_sorted)
        if count < m:
            order = suffix_array(names, count) if count <= _SMALL else wide_suffix_array(names, count)
        else:
            order = np.empty(m, np.int64)
            order[names] = np.arange(m)
        lms = lms[order]
    return buckets.induce(lms, first=False)


def _short(t: np.ndarray) -> np.ndarray:
    """Suffix array of a short string: ranks of prefixes of doubling length."""
    n, size = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:-size] += rank[size:] + 1
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank[order] = new
        size *= 2
        if new[-1] == n - 1:
            return order
        if size >= n:
            raise AssertionError("suffixes are distinct")


def wide_suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array over a large alphabet: each symbol as two digits, of which only the first starts a suffix."""
    base = max(2, int(np.ceil(np.sqrt(k))))
    digits = np.empty(2 * len(t), np.int64)
    digits[0::2], digits[1::2] = t // base, t % base
    order = suffix_array(digits, base)
    return order[order % 2 == 0] // 2


def _types(t: np.ndarray) -> np.ndarray:
    """Is each suffix S (smaller than the next one)? The last one is L: the end sorts before all."""
    n = len(t)
    less = np.zeros(n, bool)
    less[:-1] = t[:-1] < t[1:]
    settled = np.ones(n, bool)
    settled[:-1] = t[:-1] != t[1:]
    at = np.where(settled, np.arange(n), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _names(t: np.ndarray, lms: np.ndarray, lms_sorted: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order; equal substrings have equal names."""
    n, m = len(t), len(lms)
    length = np.empty(m, np.int64)
    length[:-1] = lms[1:] - lms[:-1] + 1
    length[-1] = n - lms[-1] + 1  # reaches past the end, so it equals no other
    size = np.zeros(n, np.int64)
    size[lms] = length
    a, b = lms_sorted[:-1], lms_sorted[1:]
    same = (size[a] == size[b]) & (a + size[a] <= n) & (b + size[b] <= n)
    at = np.flatnonzero(same)
    for lo in range(0, len(at), 1 << 16):  # bounded memory
        i = at[lo : lo + (1 << 16)]
        z = size[a[i]]
        eq = t[ranges(a[i], z)] == t[ranges(b[i], z)]
        same[i] = np.logical_and.reduceat(eq, np.concatenate([[0], np.cumsum(z)[:-1]]))
    rank = np.concatenate([[0], np.cumsum(~same)])
    name = size  # reuse
    name[lms_sorted] = rank
    return name[lms], int(rank[-1]) + 1


class _Buckets:
    def __init__(self, t: np.ndarray, is_s: np.ndarray, k: int):
        self.t, self.is_s, self.k = t, is_s, k
        total = np.bincount(t, minlength=k)
        self.start = np.concatenate([[0], np.cumsum(total)])
        self.n_l = np.bincount(t[~is_s], minlength=k)
        self.used = np.flatnonzero(total)

    def induce(self, lms: np.ndarray, first: bool) -> np.ndarray:
        """Place the L suffixes from the given LMS suffixes, then the S suffixes from those. With
        first, the given ones are sorted by their first symbol only."""
        t, is_s, n = self.t, self.is_s, len(self.t)
        sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
        head = self.start[:-1].copy()
        seeds = np.searchsorted(t[lms], np.arange(self.k + 1))
        last = n - 1  # the suffix before the end; it is L and comes first in its bucket
        sa[head[t[last]]] = last
        head[t[last]] += 1
        for c in self.used:
            lo = self.start[c]
            while True:  # suffixes of this bucket that induce others of it
                hi = head[c]
                if lo == hi:
                    break
                p = sa[lo:hi] - 1
                p = p[p >= 0]
                p = p[(t[p] == c) & ~is_s[p]]
                lo = hi
                sa[hi : hi + len(p)] = p
                head[c] = hi + len(p)
            p = np.concatenate([sa[self.start[c] : head[c]], lms[seeds[c] : seeds[c + 1]]]) - 1
            p = p[p >= 0]
            x = t[p]
            keep = (x > c) & ~is_s[p]
            p, x = p[keep], x[keep]
            if len(p):
                order = np.argsort(x, kind="stable")
                p, x = p[order], x[order]
                cut = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
                size = np.diff(np.append(cut, len(x)))
                chars = x[cut]
                sa[ranges(head[chars], size)] = p
                head[chars] += size
        tail = self.start[1:].copy()
        for c in self.used[::-1]:
            hi = self.start[c + 1]
            while True:
                lo = tail[c]
                if lo == hi:
                    break
                p = sa[lo:hi][::-1] - 1  # right to left
                p = p[p >= 0]
                p = p[(t[p] == c) & is_s[p]]
                hi = lo
                sa[lo - len(p) : lo] = p[::-1]
                tail[c] = lo - len(p)
            p = np.concatenate([sa[tail[c] : self.start[c + 1]][::-1], sa[self.start[c] : self.start[c] + self.n_l[c]][::-1]]) - 1
            p = p[p >= 0]
            x = t[p]
            keep = (x < c) & is_s[p]
            p, x = p[keep], x[keep]
            if len(p):
                order = np.argsort(x, kind="stable")
                p, x = p[order], x[order]
                cut = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
                size = np.diff(np.append(cut, len(x)))
                chars = x[cut]
                # the first of a run is placed highest
                sa[np.repeat(tail[chars] - 1, size) - (np.arange(len(x)) - np.repeat(cut, size))] = p
                tail[chars] -= size
        return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, limit: int, breaks: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each place i, the length that suffix i shares with the one before it in
    sa, at most limit. Only irreducible places, and those in breaks, are compared; after
    another place the value is one less than the last one's.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    red = (i > 0) & (phi > 0)
    red[red] = t[i[red] - 1] == t[phi[red] - 1]
    red[breaks] = False
    if n > 1:
        red[1:] &= phi[:-1] >= 0
    at = np.flatnonzero(~red)
    value = np.zeros(len(at), np.int64)
    padded = np.concatenate([t.astype(np.int32), np.full(limit + 64, -1, np.int32)])
    live = np.flatnonzero(phi[at] >= 0)
    step, done = 8, 0
    while len(live) and done < limit:
        a, b = at[live] + done, phi[at[live]] + done
        more = []
        for lo in range(0, len(live), 1 << 17):
            s = slice(lo, lo + (1 << 17))
            col = np.arange(step)
            x, y = padded[np.minimum(a[s], n)[:, None] + col], padded[np.minimum(b[s], n)[:, None] + col]
            eq = (x == y) & (x >= 0)
            run = np.where(eq.all(1), step, eq.argmin(1))
            value[live[s]] += run
            more.append(live[s][run == step])
        live = np.concatenate(more)
        done += step
        step = min(64, step * 2)
    value = np.minimum(value, limit)
    which = np.cumsum(~red) - 1
    return np.maximum(value[which] - (i - at[which]), 0)
