"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as S or L; the leftmost S ones (LMS) are sorted by their substrings with two inducing scans,
named, and the string of names is sorted by the same routine, recursively, until all names differ; two more scans
induce the whole array from it. Every level is linear. On bytes a scan handles one bucket at a time: everything that a
bucket induces is one array operation, and what it induces into itself takes one more operation for each repeated
symbol. Names have small buckets, so their scans go over stretches of the array instead, each as far as nothing in it
is induced by the stretch itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last is S."""
    ends = np.flatnonzero(s[1:] != s[:-1])
    ends = np.append(ends, len(s) - 1)
    kind = np.append(s[ends[:-1]] < s[ends[:-1] + 1], True)
    return np.repeat(kind, np.diff(ends, prepend=-1))


def _deal(queue: list[list[np.ndarray]], s: np.ndarray, p: np.ndarray) -> None:
    """Append suffixes to the queues of their first symbols, keeping their order."""
    if len(p) == 0:
        return
    c = s[p]
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    lo = 0
    for hi in [*cuts.tolist(), len(p)]:
        queue[c[lo]].append(p[lo:hi])
        lo = hi


def _cat(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffixes in order, as far as the order of the LMS suffixes given says."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(seeds, s, lms)
    left: list[np.ndarray] = [None] * k  # type: ignore[list-item]
    queue: list[list[np.ndarray]] = [[] for _ in range(k)]
    for c in range(k):
        work, parts = _cat(queue[c]), []
        while len(work):
            parts.append(work)
            p = work - 1
            p = p[p >= 0]
            p = p[~is_s[p]]
            here = s[p] == c
            _deal(queue, s, p[~here])
            work = p[here]
        left[c] = _cat(parts)
        if seeds[c]:
            _deal(queue, s, _cat(seeds[c]) - 1)
    out: list[np.ndarray] = []
    queue = [[] for _ in range(k)]
    for c in range(k - 1, -1, -1):
        work, parts = _cat(queue[c]), []
        while len(work):
            parts.append(work)
            p = work - 1
            p = p[p >= 0]
            p = p[is_s[p]]
            here = s[p] == c
            _deal(queue, s, p[~here])
            work = p[here]
        if parts:
            out.append(_cat(parts)[::-1])
        if len(left[c]):
            out.append(left[c])
            p = left[c][::-1] - 1
            p = p[p >= 0]
            _deal(queue, s, p[is_s[p]])
    out.append(np.array([len(s) - 1], np.int32))
    return np.concatenate(out[::-1])


def _ranks(c: np.ndarray) -> np.ndarray:
    """How many equal entries stand before each."""
    order = np.argsort(c, kind="stable")
    v = c[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    out = np.empty(len(c), np.int64)
    out[order] = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    return out


def _scan(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, free: np.ndarray) -> None:
    """One inducing scan along sa (a reversed view for the second one): suffixes before those that stand in it, if wanted, go to the next free places of their buckets."""
    n, i = len(sa), 0
    stretch = int(n**0.5) + 64
    while i < n:
        stop = min(i + stretch, n)
        p = sa[i:stop] - 1
        at = np.flatnonzero(p >= 0)
        at = at[wanted[p[at]]]
        if len(at):
            q = p[at]
            c = s[q]
            to = free[c] + _ranks(c)
            if (low := int(to.min())) < stop:  # from here on the stretch has to be read again
                stop = low
                here = at < stop - i
                q, c, to = q[here], c[here], to[here]
            sa[to] = q
            free[c] = to + 1  # places rise, so the last of a bucket counts
        slow, i = stop - i < 16, stop
        if slow:  # repeated names induce one another: step by step for a while
            for x in range(i, min(i + 256, n)):
                p = int(sa[x]) - 1
                if p >= 0 and wanted[p]:
                    c = s[p]
                    sa[free[c]] = p
                    free[c] += 1
            i = min(i + 256, n)


def _induce_names(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """What _induce() does, for many symbols."""
    sizes = np.bincount(s, minlength=k)
    ends = np.cumsum(sizes)
    sa = np.full(len(s), -1, np.int32)
    c = s[lms]
    sa[ends[c] - np.bincount(c, minlength=k)[c] + _ranks(c)] = lms
    _scan(sa, s, ~is_s, ends - sizes)
    _scan(sa[::-1], s, is_s, len(s) - ends)
    return sa


def names_array(names: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of names 0 to k - 1, of which the last, 0, occurs once; recursive while names repeat."""
    if k == len(names):  # all names differ: their order is that of the suffixes
        return np.argsort(names)
    return suffix_array(names, k, _induce_names)


def suffix_array(s: np.ndarray, k: int, induce: Callable = _induce) -> np.ndarray:
    """The suffix array of symbols 0 to k - 1, of which the last, 0, occurs once."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    is_s = _types(s)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)  # places take 32 bits: shards are small
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_ = induce(s, is_s, lms, k)
    sorted_ = sorted_[is_lms[sorted_]]
    size = np.empty(n, np.int32)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    a, b = sorted_[:-1], sorted_[1:]
    differs = size[a] != size[b]
    live = np.flatnonzero(~differs)
    j = 0
    while len(live):
        live = live[j < size[a[live]]]
        unequal = s[a[live] + j] != s[b[live] + j]
        differs[live[unequal]] = True
        live = live[~unequal]
        j += 1
    names_at = np.empty(n, np.int32)
    names_at[sorted_] = np.concatenate([[0], np.cumsum(differs)])
    names = names_at[lms]
    count = int(names.max()) + 1
    return induce(s, is_s, lms[names_array(names, count)], k)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each entry of order its common prefix with the entry before it, up to limit; found in text order.

    `text` is bytes, with at least limit bytes after each start in order.
    """
    before = np.full(len(text), -1, np.int32)
    before[order[1:]] = order[:-1]
    p = np.sort(order)
    q = before[p]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), dtype="<u8", buffer=padded, strides=(1,))
    common = np.zeros(len(text), np.int32)
    live = np.flatnonzero(q >= 0)
    done = 0
    while len(live) and done < limit:
        x = words[p[live] + done] ^ words[q[live] + done]
        stop = x != 0
        low = x[stop] & (~x[stop] + np.uint64(1))
        common[p[live[stop]]] = np.minimum(done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3), limit)
        live = live[~stop]
        done += 8
    common[p[live]] = limit
    return common[order]
