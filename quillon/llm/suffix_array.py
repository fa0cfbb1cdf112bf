"""Suffix arrays by induced sorting, in array steps, and permuted common prefixes.

Suffixes are smaller (S) or larger (L) than their right neighbours; leftmost S
suffixes (LMS) are the seeds. Sorted seeds induce the L suffixes, bucket by bucket
upward, and these the S suffixes downward. Seeds get sorted by inducing from their
unsorted order, which sorts the substrings between them; equal substrings get one
name, and the names' string is sorted by the same routine. A name is written as
two digits, so that the alphabet, by which the buckets go, stays small.
"""

from __future__ import annotations

import numpy as np

#: Strings below this length are sorted by doubling, the recursion's end.
SMALL = 512


def doubled(text: np.ndarray) -> np.ndarray:
    n = len(text)
    order = np.argsort(text, kind="stable")
    s = text[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    step = 1
    while step < n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        step *= 2
    return order


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the empty suffix is the smallest."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.where(text[1:] > text[:-1], 1, np.where(text[1:] < text[:-1], -1, 0))
    step[n - 1] = -1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in the order that the LMS suffixes ``seeds``, in their order, induce."""
    count = np.bincount(text, minlength=alphabet)
    ends = np.cumsum(count)
    starts = ends - count
    middle = starts + np.bincount(text[~small], minlength=alphabet)
    out = np.zeros(len(text), np.int32)
    used = np.flatnonzero(count).tolist()
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    seed_end = np.cumsum(np.bincount(text[seeds], minlength=alphabet)).tolist()
    free = starts.copy()

    def deal(before: np.ndarray, up: bool) -> None:
        """Puts suffixes into the free places of their symbols, in order."""
        if not len(before):
            return
        symbols = text[before]
        order = np.argsort(symbols, kind="stable")
        s = symbols[order]
        n = np.bincount(s, minlength=alphabet)
        rank = np.arange(len(s)) - (np.cumsum(n) - n)[s]
        out[free[s] + rank if up else free[s] - 1 - rank] = before[order]
        np.add(free, n if up else -n, out=free)

    def left_of(wave: np.ndarray, kind: bool) -> np.ndarray:
        before = wave[wave > 0] - 1
        return before[small[before] == kind]

    deal(np.array([len(text) - 1], np.int32), True)
    for c in used:
        a = int(starts[c])
        while a < free[c]:
            a, wave = int(free[c]), out[a : int(free[c])]
            deal(left_of(wave, False), True)
        deal(left_of(seeds[seed_end[c - 1] if c else 0 : seed_end[c]], False), True)
    free = ends.copy()
    for c in reversed(used):
        b = int(ends[c])
        while b > free[c]:
            b, wave = int(free[c]), out[int(free[c]) : b][::-1]
            deal(left_of(wave, True), False)
        deal(left_of(out[int(starts[c]) : int(middle[c])][::-1], True), False)
    return out


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether text[a:a + length] equals text[b:b + length], for each."""
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    i = 0
    while len(live):
        live = live[length[live] > i]
        equal = text[a[live] + i] == text[b[live] + i]
        out[live[~equal]] = False
        live = live[equal]
        i += 1
    return out


def suffix_array(text: np.ndarray, alphabet: int = 256) -> np.ndarray:
    """The order of the suffixes of ``text``, whose symbols are below ``alphabet``; a prefix comes before the longer one."""
    n = len(text)
    if n < SMALL:
        return doubled(text.astype(np.int64)).astype(np.int32) if n else np.zeros(0, np.int32)
    small = classify(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = induce(text, small, lms, alphabet)
        order = order[is_lms[order]]
        size = np.zeros(n, np.int32)
        size[lms[:-1]] = np.diff(lms) + 1
        size[lms[-1]] = n - lms[-1]
        a, b = order[:-1], order[1:]
        alike = (size[a] == size[b]) & (a != lms[-1]) & (b != lms[-1])
        alike[alike] = _same(text, a[alike], b[alike], size[a[alike]])
        name = np.zeros(n, np.int32)
        name[order] = np.cumsum(np.concatenate([[0], ~alike]))
        names = name[lms]
        top = int(names.max()) + 1
        if top < len(lms):
            base = int(np.ceil(np.sqrt(top)))
            digits = np.empty(2 * len(lms), np.uint16 if base > 256 else np.uint8)
            digits[::2], digits[1::2] = names // base, names % base
            inner = suffix_array(digits, base + 1)
            order = lms[inner[inner % 2 == 0] // 2]
    else:
        order = lms
    return induce(text, small, order, alphabet)


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text position the suffix before it in the order (-1: none), and their common prefix's length.

    One position further right the length falls by one at most. Where the two
    left neighbours are equal it falls by exactly one, so only the other
    positions are compared, and these lengths add up to n log n at most.
    """
    n = len(text)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    left = np.flatnonzero(phi > 0)
    left = left[left > 0]
    free = np.ones(n, bool)
    free[left] = text[left - 1] != text[phi[left] - 1]
    at = np.flatnonzero(free)
    have = phi[at] >= 0
    length = np.zeros(len(at), np.int32)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):
        eight |= wide[k : k + n + 1].astype(np.uint64) << np.uint64(8 * k)
    live = np.flatnonzero(have)
    a, b = at[live].astype(np.int64), phi[at[live]].astype(np.int64)
    while len(live):
        x = eight[np.minimum(a, n)] ^ eight[np.minimum(b, n)]
        zero = np.where(x == 0, 8, 0)
        some = x != 0
        if some.any():
            lowest = x[some] & (~x[some] + np.uint64(1))
            zero[some] = (np.bitwise_count(lowest - np.uint64(1)) // 8).astype(np.int64)
        length[live] += np.minimum(zero, np.maximum(n - np.maximum(a, b), 0)).astype(np.int32)
        on = (zero == 8) & (np.maximum(a, b) + 8 < n)
        live, a, b = live[on], a[on] + 8, b[on] + 8
    which = np.cumsum(free) - 1
    return phi, length[which] - (np.arange(n, dtype=np.int32) - at[which].astype(np.int32))
