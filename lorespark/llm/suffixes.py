"""Suffix arrays by induced sorting and permuted common prefixes, in numpy, one bucket of suffixes at a time."""

from __future__ import annotations

import numpy as np

#: Names above BASE are written as two digits, so that there are few buckets to go through; texts of up to SHORT letters are
#: sorted by doubling, as going through the buckets of each would take longer.
BASE, SHORT = 512, 4096


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S); equal neighbours are of one type, the last is S."""
    n = len(t)
    step = np.flatnonzero(t[1:] != t[:-1])
    grows = t[step + 1] > t[step]
    out = np.ones(n, bool)
    if len(step):
        next_step = np.searchsorted(step, np.arange(n - 1))
        inside = next_step < len(step)
        out[:-1][inside] = grows[next_step[inside]]
    return out


def induce(t: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that the order of the leftmost smaller suffixes ``lms`` gives.

    Buckets are gone through upwards for the larger suffixes and downwards for the smaller ones.  Within a bucket, runs of
    one letter are added in waves; all that a bucket induces in others is dealt out at once.
    """
    n = len(t)
    count = np.bincount(t, minlength=k)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int32)
    letter = t[lms]
    order = np.argsort(letter, kind="stable")
    n_lms = np.bincount(letter, minlength=k)
    letter, counting = letter[order], np.arange(n)
    sa[(end - n_lms)[letter] + np.arange(len(lms)) - (np.cumsum(n_lms) - n_lms)[letter]] = lms[order]

    def deal(p: np.ndarray, c: np.ndarray, free: np.ndarray, way: int) -> None:
        by = np.argsort(c, kind="stable")
        p, c = p[by], c[by].astype(np.int64)
        new = np.empty(len(c), bool)
        new[0] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        first = new.nonzero()[0]
        many = np.empty(len(first), np.int64)
        many[:-1], many[-1] = first[1:] - first[:-1], len(c) - first[-1]
        letters = c[first]
        at = np.repeat(free[letters] - way * first, many) if way > 0 else np.repeat(free[letters] - 1 + first, many)
        sa[at + counting[: len(c)] if way > 0 else at - counting[: len(c)]] = p
        free[letters] += way * many

    head, low, high, first_lms = start.copy(), start.tolist(), end.tolist(), (end - n_lms).tolist()
    used = np.flatnonzero(count).tolist()
    for c in used:
        done, hi = low[c], int(head[c])
        while done < hi:
            p = sa[done:hi] - 1
            done = hi
            p = p[p >= 0]
            p = p[t[p] == c]
            sa[hi : hi + len(p)] = p
            hi += len(p)
        head[c] = hi
        p = np.concatenate([sa[low[c] : hi], sa[first_lms[c] : high[c]]]) - 1
        p = p[p >= 0]
        q = t[p]
        up = q > c
        if up.any():
            deal(p[up], q[up], head, 1)
    tail, top = end.copy(), head.tolist()
    for c in reversed(used):
        lo, done = int(tail[c]), high[c]
        while lo < done:
            p = sa[lo:done][::-1] - 1
            done = lo
            p = p[p >= 0]
            p = p[t[p] == c]
            sa[lo - len(p) : lo] = p[::-1]
            lo -= len(p)
        tail[c] = lo
        p = np.concatenate([sa[lo : high[c]][::-1], sa[low[c] : top[c]][::-1]]) - 1
        p = p[p >= 0]
        q = t[p]
        down = q < c
        if down.any():
            deal(p[down], q[down], tail, -1)
    return sa


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether t[a:a+length] == t[b:b+length], four letters at a time."""
    w = np.zeros(len(t) + 4, np.uint64)
    w[: len(t)] = t
    words = w[:-3] | w[1:-2] << np.uint64(16) | w[2:-1] << np.uint64(32) | w[3:] << np.uint64(48)
    same, left = np.ones(len(a), bool), np.arange(len(a))
    at = 0
    while len(left):
        rest = np.minimum(length[left] - at, 4)
        mask = ~np.uint64(0) >> (64 - 16 * rest).astype(np.uint64)
        ok = (words[a[left] + at] ^ words[b[left] + at]) & mask == 0
        same[left[~ok]] = False
        left, at = left[ok], at + 4
        left = left[length[left] > at]
    return same


def doubled(t: np.ndarray) -> np.ndarray:
    """The suffix array of a short text, by ranks of prefixes of twice the length each time."""
    n = len(t)
    rank, width = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        new = key[order][1:] != key[order][:-1]
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        if new.all():
            return order.astype(np.int32)
        width = min(2 * width, n)


def suffix_array(t: np.ndarray, k: int, short: int = SHORT) -> np.ndarray:
    """Of letters below ``k`` (at most 65536) that end with the only 0.

    The leftmost smaller substrings are sorted by inducing and named; names that repeat are sorted by the same method, as
    one letter each or, where they are many, as two digits of a fixed width, which sort alike.
    """
    t = t.astype(np.uint16)
    n = len(t)
    if n <= short:
        return doubled(t)
    small = types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    sorted_substrings = induce(t, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by = sorted_substrings[is_lms[sorted_substrings]]
    length = np.ones(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    new = length[by[1:]] != length[by[:-1]]
    alike = np.flatnonzero(~new)
    new[alike] = ~_same(t, by[alike], by[alike + 1], length[by[alike]].astype(np.int64))
    names = np.empty(n, np.int32)
    names[by] = np.r_[0, np.cumsum(new)]
    text, many = names[lms], int(new.sum()) + 1
    if many < len(lms):
        if many <= BASE:
            order = suffix_array(text, many, short)
        else:
            base = int(np.ceil(np.sqrt(many)))
            digits = np.zeros(2 * len(text) + 1, np.int32)
            digits[:-1:2], digits[1:-1:2] = text // base + 1, text % base + 1
            order = suffix_array(digits, base + 1, short)
            order = order[(order % 2 == 0) & (order < 2 * len(text))] // 2
        by = lms[order]
    return induce(t, by, k)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """plcp[i]: letters that suffix i shares with the one before it in ``sa``, counted up to ``most``.

    A suffix shares at least one letter less than the one that begins a place earlier, so every 64th is compared from its
    beginning, and the others, at ever smaller steps, from where an earlier one says.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    w = np.zeros(n + most + 8, np.uint64)
    w[:n] = t
    words = w[:-3] | w[1:-2] << np.uint64(16) | w[2:-1] << np.uint64(32) | w[3:] << np.uint64(48)
    out = np.zeros(n, np.int64)
    step = 64
    while step:
        i = np.arange(0, n, 64) if step == 64 else np.arange(step, n, 2 * step)
        at = np.zeros(len(i), np.int64) if step == 64 else np.maximum(out[i - step] - step, 0)
        j = before[i]
        live = np.flatnonzero((j >= 0) & (at < most))
        while len(live):
            x = words[i[live] + at[live]] ^ words[j[live] + at[live]]
            equal = x == 0
            stop = live[~equal]
            y = x[~equal]
            at[stop] += (y & np.uint64(0xFFFF) == 0).astype(np.int64) + (y & np.uint64(0xFFFFFFFF) == 0) + (y & np.uint64(0xFFFFFFFFFFFF) == 0)
            live = live[equal]
            at[live] += 4
            live = live[at[live] < most]
        at[j < 0] = 0
        out[i] = np.minimum(at, most)
        step = 32 if step == 64 else step // 2
    return out


def repeated(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text, the places where a string of ``width`` bytes begins that begins elsewhere in ``texts`` too."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.uint16) + np.uint16(2)
    end = np.cumsum(size + 1) - 1  # where a mark stands behind each text
    flat[end] = 1
    flat[-1] = 0
    sa = suffix_array(flat, 258)
    shared = common_prefixes(flat, sa, width + 64)
    rest = np.append(np.repeat(end, size + 1) - np.arange(len(flat) - 1), 0)
    long = np.minimum(shared, rest) >= width
    found = long.copy()
    found[sa[:-1][long[sa[1:]]]] = True  # the one before shares as much
    found &= rest >= width
    return [np.flatnonzero(found[e - n : e]) for e, n in zip(end.tolist(), size.tolist(), strict=True)]
