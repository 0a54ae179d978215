"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

Induced sorting is sequential by nature, but within one bucket (suffixes of one first symbol) every step only needs
what was placed before; so whole buckets are induced at once, and runs of one symbol take one round per repeat.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is a unique smallest sentinel."""
    n = len(s)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    # a run of equal symbols has the type of its last one
    place = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def _spread(sa: np.ndarray, free: np.ndarray, found: np.ndarray, symbol: np.ndarray, way: int) -> None:
    """Put suffixes at the free ends of their buckets, in order; ``way`` is 1 for heads and -1 for tails."""
    order = np.argsort(symbol, kind="stable")
    sorted_symbols = symbol[order]
    first = np.flatnonzero(np.r_[True, sorted_symbols[1:] != sorted_symbols[:-1]])
    size = np.diff(np.r_[first, len(order)])
    rank = np.arange(len(order)) - np.repeat(first, size)
    keys = sorted_symbols[first]
    sa[np.repeat(free[keys], size) + way * rank] = found[order]
    free[keys] += way * size


def _induce(s: np.ndarray, lms: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order from the order of the leftmost-smaller suffixes ``lms``."""
    sa = np.full(len(s), -1, dtype=np.int32)
    tail = ends - 1
    _spread(sa, tail, lms[::-1], s[lms[::-1]], -1)
    lead = tail + 1  # where each bucket's leftmost-smaller suffixes begin
    head = heads.copy()
    used = np.flatnonzero(ends > heads)
    for c in used.tolist():  # larger suffixes, from the smallest bucket on
        done = heads[c]
        while head[c] > done:
            wave = sa[done : head[c]] - 1
            done = head[c]
            wave = wave[wave >= 0]
            symbol = s[wave]
            take = symbol >= c
            if take.any():
                _spread(sa, head, wave[take], symbol[take], 1)
        rest = sa[lead[c] : ends[c]] - 1
        rest = rest[rest >= 0]
        if len(rest):
            _spread(sa, head, rest, s[rest], 1)
    tail = ends - 1
    last = head  # end of the larger suffixes of each bucket
    for c in used[::-1].tolist():  # smaller suffixes, from the largest bucket down
        done = ends[c] - 1
        while tail[c] < done:
            wave = sa[tail[c] + 1 : done + 1][::-1] - 1
            done = tail[c]
            wave = wave[wave >= 0]
            symbol = s[wave]
            take = symbol <= c
            if take.any():
                _spread(sa, tail, wave[take], symbol[take], -1)
        rest = sa[heads[c] : last[c]][::-1] - 1
        rest = rest[rest >= 0]
        symbol = s[rest]
        take = symbol < c
        if take.any():
            _spread(sa, tail, rest[take], symbol[take], -1)
        if c == 0:
            sa[0] = len(s) - 1
    return sa


def _induce_singly(s: np.ndarray, lms: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same order place by place, for small buckets, where arrays gain nothing.

    The symbol before each place stands in a list, -1 where the place before is of the other type (or none): so a step
    looks up one symbol and compares nothing. The last entry serves free places, which hold -1.
    """
    n = len(s)
    small = _types(s)
    larger, smaller = np.full((2, n + 1), -1, dtype=np.int64)
    larger[1:n] = np.where(small[:-1], -1, s[:-1])
    smaller[1:n] = np.where(small[:-1], s[:-1], -1)
    head, tail = heads.tolist(), (ends - 1).tolist()
    sa = [-1] * n
    for p, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        sa[tail[c]] = p
        tail[c] -= 1
    before = larger.tolist()
    for p in sa:  # larger suffixes; the loop meets what it has put ahead
        c = before[p]
        if c >= 0:
            k = head[c]
            sa[k] = p - 1
            head[c] = k + 1
    tail, before = (ends - 1).tolist(), smaller.tolist()
    for p in reversed(sa):  # smaller suffixes
        c = before[p]
        if c >= 0:
            k = tail[c]
            sa[k] = p - 1
            tail[c] = k - 1
    sa[0] = n - 1
    return np.array(sa, dtype=np.int32)


def _order_short(s: np.ndarray, small: np.ndarray, lms: np.ndarray, longest: int) -> np.ndarray:
    """Leftmost-smaller places by their substrings, symbol after symbol; groups already single are left alone.

    A symbol counts twice, plus one for a smaller suffix: so no substring is a proper prefix of another.
    """
    key = 2 * s.astype(np.int64) + small
    order = lms[np.argsort(key[lms], kind="stable")]
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    ends = np.zeros(len(s), dtype=bool)
    ends[lms] = True
    live = order != len(s) - 1
    for k in range(1, longest):
        at = np.flatnonzero(live & ~(new & np.r_[new[1:], True]))
        if not len(at):
            break
        group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[at]
        ahead = key[order[at] + k]
        by = np.lexsort((ahead, group))
        order[at], ahead = order[at][by], ahead[by]
        live[at] = ~ends[order[at] + k]  # substrings that end and still share a group are equal
        new[at] |= np.r_[True, (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])]
    return order


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes of ``s`` (symbols below ``size``; the last one is 0 and occurs once).

    Leftmost-smaller substrings are sorted (by one induction, or symbol by symbol where they are short and buckets
    are small), named, and their string of names is sorted by recursion until all names differ.
    """
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable").astype(np.int32)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(s, minlength=size))
    heads = np.r_[0, ends[:-1]]
    # place of each substring's last symbol
    until = np.full(n, n - 1, dtype=np.int64)
    until[lms[:-1]] = lms[1:]
    longest = int((until[lms] - lms).max()) + 1
    induce = _induce if n >= 64 * np.count_nonzero(ends > heads) else _induce_singly
    if induce is _induce_singly and longest <= 64:
        sorted_lms = _order_short(s, small, lms, longest)
    else:
        sa = induce(s, lms, heads, ends)
        mark = np.zeros(n, dtype=bool)
        mark[lms] = True
        sorted_lms = sa[mark[sa]]
    # equal neighbours: same length and same symbols up to the next leftmost-smaller place
    length = until[sorted_lms] - sorted_lms + 1
    even = np.flatnonzero(length[1:] == length[:-1])
    same = np.zeros(len(sorted_lms), dtype=bool)
    if len(even):
        k = length[even]
        base = np.cumsum(k) - k
        step = np.arange(k.sum()) - np.repeat(base, k)
        equal = s[np.repeat(sorted_lms[even], k) + step] == s[np.repeat(sorted_lms[even + 1], k) + step]
        same[even + 1] = np.logical_and.reduceat(equal, base)
    name = np.cumsum(~same) - 1
    if name[-1] + 1 < len(lms):
        names = np.empty(n, dtype=np.int32)
        names[sorted_lms] = name
        inner, kinds = names[lms], int(name[-1]) + 1
        sorted_lms = lms[suffix_array(inner, kinds)]
    return induce(s, sorted_lms.astype(np.int32), heads, ends)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, by text place.

    Where the symbols before both suffixes are equal, the value is one less than that of the place before, so only
    the other (irreducible) places are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    order = sa[sa < n].astype(np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    fixed = (before <= 0) | (place == 0)
    inner = ~fixed
    fixed[inner] = data[place[inner] - 1] != data[before[inner] - 1]
    at = np.flatnonzero(fixed)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(shape=(n + 9,), dtype="<u8", buffer=padded.data, strides=(1,))
    value = np.zeros(n, dtype=np.int64)
    live, a, b = at[before[at] >= 0], None, None
    a, b, done = live, before[live], np.zeros(len(live), dtype=np.int64)
    while len(live):
        end = n - np.maximum(a, b)  # symbols left in the shorter suffix
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        bits = np.where(x == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64)))
        match = np.minimum((bits // 8).astype(np.int64), np.maximum(end, 0))
        done += match
        more = match == 8
        value[live[~more]] = done[~more]
        live, a, b, done = live[more], a[more] + 8, b[more] + 8, done[more]
    # carry irreducible values forward, one less per place
    carried = np.maximum.accumulate(np.where(fixed, place + value, 0))
    return np.maximum(carried - place, 0)
