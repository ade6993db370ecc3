"""Suffix arrays by induced sorting (Nong, Zhang and Chan, 2009) and permuted common prefixes.

The text level has few symbols and many suffixes a bucket, so it is induced bucket by bucket with numpy: all of a
bucket's suffixes hand their predecessors on at once, in order. Recursion levels have many symbols and small
buckets, and are induced suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, a unique smallest symbol, is."""
    n = len(t)
    less = np.zeros(n, np.int8)  # 1 smaller, -1 larger, 0 as the next
    less[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    less[-1] = 1
    at = np.where(less != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return less[nxt] > 0


def _hand_on(sa: np.ndarray, t: np.ndarray, of: np.ndarray, wanted: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Puts the predecessors of suffixes ``of`` that are ``wanted`` at the free edges of their buckets, in order."""
    j = of[of > 0] - 1
    j = j[wanted[j]]
    if not len(j):
        return
    sym = t[j]
    order = np.argsort(sym, kind="stable")
    sym, j = sym[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    count = np.diff(np.concatenate([new, [len(j)]]))
    rank = np.arange(len(j)) - np.repeat(new, count)
    sa[edge[sym] + step * rank] = j
    edge[sym[new]] += step * count


def _induce(t: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array, given the leftmost-smaller suffixes in order (or in any order, for their substrings)."""
    n, sigma = len(t), len(heads)
    sa = np.full(n, -1, np.int64)
    sym = t[lms]
    count = np.bincount(sym, minlength=sigma)
    # Leftmost-smaller suffixes at the tails of their buckets.
    by = np.argsort(sym, kind="stable")
    start = np.concatenate([[0], np.cumsum(count)])
    sa[np.repeat(tails - count, count) + np.arange(len(lms)) - np.repeat(start[:-1], count)] = lms[by]
    held = [lms[by[start[c] : start[c + 1]]] for c in range(sigma)]
    large, edge = ~small, heads.copy()
    for c in np.flatnonzero(tails > heads):
        done = heads[c]
        while done < edge[c]:
            stop = edge[c]
            _hand_on(sa, t, sa[done:stop], large, edge, 1)
            done = stop
        _hand_on(sa, t, held[c], large, edge, 1)
    after_large, edge = edge, tails - 1
    for c in np.flatnonzero(tails > heads)[::-1]:
        done = tails[c] - 1
        while done > edge[c]:
            stop = edge[c]
            _hand_on(sa, t, sa[stop + 1 : done + 1][::-1], small, edge, -1)
            done = stop
        _hand_on(sa, t, sa[heads[c] : after_large[c]][::-1], small, edge, -1)
    sa[0] = n - 1
    return sa


def _induce_one_by_one(t: list[int], small: list[bool], heads: list[int], tails: list[int], lms: list[int]) -> list[int]:
    n = len(t)
    sa = [-1] * n
    edge = tails.copy()
    for i in reversed(lms):
        c = t[i]
        edge[c] -= 1
        sa[edge[c]] = i
    edge = heads.copy()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = t[j]
            sa[edge[c]] = j
            edge[c] += 1
    edge = tails.copy()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = t[j]
            edge[c] -= 1
            sa[edge[c]] = j
    return sa


def suffix_array(t: np.ndarray, sigma: int, level: int = 0) -> np.ndarray:
    """The suffix array of ``t``, whose last symbol is 0 and stands there only; symbols are below ``sigma``."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(t, minlength=sigma)
    tails = np.cumsum(size)
    heads = tails - size
    if level == 0:
        induce = lambda first: _induce(t, small, heads, tails, first)
    else:
        lists = t.tolist(), small.tolist(), heads.tolist(), tails.tolist()
        induce = lambda first: np.array(_induce_one_by_one(*lists, first.tolist()), np.int64)
    sa = induce(lms)
    if len(lms) > 1:
        # Names: leftmost-smaller substrings in order, equal ones alike.
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        stop = np.full(n, n - 1)
        stop[lms[:-1]] = lms[1:]
        names = np.cumsum(_differ(t, ordered, stop[ordered]))
        name_of = np.zeros(n, np.int64)
        name_of[ordered] = names
        reduced = name_of[lms]
        if names[-1] + 1 < len(lms):
            first = lms[suffix_array(reduced, int(names[-1]) + 1, level + 1)]
        else:
            first = ordered
        sa = induce(first)
    return sa


def _differ(t: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each substring ``t[at:stop + 1]`` differs from the one before it; False for the first."""
    length = stop - at
    out = np.zeros(len(at), bool)
    out[1:] = length[1:] != length[:-1]
    open_ = np.flatnonzero(~out[1:]) + 1
    k = 0
    while len(open_):
        unequal = t[at[open_] + k] != t[at[open_ - 1] + k]
        out[open_[unequal]] = True
        open_ = open_[~unequal]
        open_ = open_[length[open_] > k]
        k += 1
    return out


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text position the suffix before it in order, and the length of their common prefix.

    Only irreducible values are compared, eight symbols at a time (symbols are below 2**16); each of the others is
    its left neighbour's less one.
    """
    n = len(t)
    before = np.zeros(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.flatnonzero(before >= 0)
    prev = before[at]
    same_left = (at > 0) & (prev > 0)
    same_left[same_left] = t[at[same_left] - 1] == t[prev[same_left] - 1]
    at = at[~same_left]
    padded = np.concatenate([t.astype(np.uint16), np.zeros(8, np.uint16)])
    four = np.lib.stride_tricks.as_strided(padded, (n + 4, 4), (2, 2))
    words = np.ascontiguousarray(four).view(np.uint64).reshape(-1)
    common = np.zeros(n, np.int64)
    a, b, who = at.copy(), before[at], at
    while len(who):
        x = words[a] ^ words[b]
        equal = x == 0
        if not equal.all():
            rest = x[~equal]
            low = (rest & np.uint64(0xFFFF)) == 0
            common[who[~equal]] += low.astype(np.int64) + (low & ((rest & np.uint64(0xFFFFFFFF)) == 0)) + (low & ((rest & np.uint64(0xFFFFFFFFFFFF)) == 0))
        common[who[equal]] += 4
        a, b, who = a[equal] + 4, b[equal] + 4, who[equal]
        inside = np.maximum(a, b) < n
        a, b, who = a[inside], b[inside], who[inside]
    reach = np.zeros(n, np.int64)
    reach[at] = common[at] + at
    return before, np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)
