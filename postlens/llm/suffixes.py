"""Suffix order and common prefixes of one shard by external induced sorting.

The suffixes that are smaller than their right and larger than their left
neighbour (S*) are sorted first, by recursion on the names of the stretches
between them; the order of all others is induced from theirs.  A suffix is
queued under its first letter by the suffix behind it.  Since letters come up
in order, the priority queue is one region per letter of a file: what is pushed
under a letter comes out in the order of arrival.  Tuples (suffix, common prefix
with the one before) are pushed in batches; the common prefix is one more than
the smallest value between the two sources, for which each letter carries the
smallest since its last push.

Text, queue and prefix values are files in a folder of the task, mapped into
memory; what stays in memory is a batch.  On deep levels of the recursion, where
a letter has hardly more than one suffix, rank doubling finishes the order.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

BATCH = 1 << 18
#: Below so many suffixes per letter the recursion ends in rank doubling.
FEW = 200
#: One in so many S* suffixes is compared with its neighbour from its first letter on.
EVERY = 8


class Folder:
    """Arrays in files of a temporary folder, which goes with the object."""

    def __init__(self):
        self.path, self.made = tempfile.mkdtemp(prefix="suffixes-"), 0

    def array(self, n: int, kind) -> np.ndarray:
        self.made += 1
        return np.memmap(os.path.join(self.path, str(self.made)), kind, "w+", shape=(max(n, 1),))[:n]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        shutil.rmtree(self.path, ignore_errors=True)


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the last one counts as smaller."""
    ends = np.flatnonzero(t[:-1] != t[1:])  # the last place of each run of equal letters
    rising = t[ends] < t[ends + 1]
    lengths = np.diff(np.concatenate([[-1], ends]))
    return np.concatenate([np.repeat(rising, lengths), np.ones(len(t) - int(lengths.sum()), bool)])


def refined(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Give ``live`` places new ranks by (rank, key) and return those that still share one.

    A rank is the place of the first of its group in the order, and all of a
    group are live together; ``key`` holds the old rank in its upper bits.
    """
    order = np.argsort(key)
    sorted_key, old = key[order], rank[live[order]]
    count = np.arange(len(live))
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    start = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), count, 0))
    first = np.maximum.accumulate(np.where(fresh, count, 0))
    rank[live[order]] = old + first - start
    return live[order[~(fresh & np.append(fresh[1:], True))]]


def doubled(t: np.ndarray) -> np.ndarray:
    """Suffix order by rank doubling, going on with unsettled suffixes only; the last letter must be unique."""
    n = len(t)
    rank = np.zeros(n, np.int64)
    live = refined(rank, np.arange(n), t.astype(np.int64))
    step = 1
    while len(live):
        behind = np.minimum(live + step, n - 1)
        follow = np.where(live + step < n, rank[behind] + 1, 0)
        live = refined(rank, live, rank[live] * (n + 1) + follow)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def names(t: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Order-keeping names of the stretches from each S* place to the next, both included."""
    m, sigma = len(stars), int(t.max()) + 2
    sizes = np.append(np.diff(stars) + 1, 1)
    bits = sigma.bit_length()
    width = max(1, (62 - m.bit_length()) // bits)
    name = np.zeros(m, np.int64)
    live, at = np.arange(m), 0
    while len(live):
        key = name[live]
        for k in range(at, at + width):
            inside = k < sizes[live]
            letter = np.where(inside, t[np.minimum(stars[live] + k, len(t) - 1)], sigma - 1)  # the shorter is larger
            key = (key << bits) | letter
        at += width
        live = refined(name, live, key)
        live = live[sizes[live] >= at]  # its end counts, too
    return np.unique(name, return_inverse=True)[1]


def shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, least: np.ndarray | None = None, step: int = 16) -> np.ndarray:
    """Letters that the suffixes at ``a`` and ``b`` have in common, up to ``cap``; ``least`` of them are known."""
    out = np.zeros(len(a), np.int32)
    known = out.copy() if least is None else least.astype(np.int32)
    a, b = a + known, b + known
    live, at, last, reach = np.arange(len(a)), 0, len(t) - 1, np.arange(step)
    while len(live) and at < cap:
        rest = []
        for k in range(0, len(live), max(1, BATCH >> 4)):
            part = live[k : k + max(1, BATCH >> 4)]
            x = np.minimum(a[part, None] + (at + reach), last)
            y = np.minimum(b[part, None] + (at + reach), last)
            same = t[x] == t[y]
            whole = same.all(axis=1)
            out[part] = at + np.where(whole, step, same.argmin(axis=1))
            rest.append(part[whole])
        live, at = np.concatenate(rest) if rest else live[:0], at + step
        live = live[known[live] + at < cap]
    return np.minimum(out + known, cap)


def star_prefixes(t: np.ndarray, stars: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """What each S* suffix shares with the one before it in ``order``, up to ``cap``, in that order; ``stars`` are in text order.

    Each ``EVERY``-th of the text is compared from its start.  Where one shares n
    letters, a suffix d letters behind it shares n - d at least with some S*
    suffix before it, if the n letters reach to the next S* place, which settles
    its type; it is compared from there on.
    """
    before = np.empty(len(stars), np.int64)
    before[order[1:]] = stars[order[:-1]]
    before[order[0]] = len(t) - 1  # the end stands nowhere else
    out = np.zeros(len(stars), np.int32)
    out[::EVERY] = shared(t, stars[::EVERY], before[::EVERY], cap)
    rest = np.flatnonzero(np.arange(len(stars)) % EVERY)
    near = rest - rest % EVERY
    behind = stars[rest] - stars[near]
    next_one = np.append(stars, len(t))[rest + 1]
    least = np.where(stars[near] + out[near] > next_one, out[near] - behind, 0)
    out[rest] = shared(t, stars[rest], before[rest], cap, least)
    out[order[0]] = 0
    return out[order]


class Smallest:
    """Minima of ranges of one batch."""

    def __init__(self, values: np.ndarray):
        self.levels, size = [values], 1
        while 2 * size <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-size], low[size:]))
            size *= 2

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over lo..hi, both included; lo <= hi."""
        level = np.log2(hi - lo + 1).astype(np.int64)
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level):
            at = level == k
            table = self.levels[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        return out


class Induction:
    """Sorts all suffixes of ``t`` from its sorted S* suffixes; with ``cap`` > 0, common prefixes too."""

    def __init__(self, t: np.ndarray, is_s: np.ndarray, folder: Folder, cap: int):
        n = len(t)
        self.t, self.is_s, self.cap = t, is_s, cap
        self.sa = folder.array(n, np.int32 if n < 1 << 31 else np.int64)
        self.lcp = folder.array(n + 1 if cap else 1, np.int16)
        if cap:
            self.lcp[:] = 0
        count = np.bincount(t)
        self.start = np.concatenate([[0], np.cumsum(count)])
        self.middle = self.start[:-1] + np.bincount(t[~is_s], minlength=len(count))
        self.letters = np.flatnonzero(count)

    def push(self, source: np.ndarray, lcp: np.ndarray | None, small: bool, free: np.ndarray, way: int) -> None:
        """Queue the suffixes in front of ``source`` that are of the wanted type, under their first letters."""
        for k in range(0, len(source), BATCH):
            src = np.asarray(source[k : k + BATCH], np.int64)
            front = src - 1
            wanted = np.flatnonzero((src > 0) & (self.is_s[front] == small))
            letter = self.t[front[wanted]]
            order = np.argsort(letter, kind="stable")
            place, letter = wanted[order], letter[order]
            new = np.concatenate([[True], letter[1:] != letter[:-1]]) if len(letter) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            used, sizes = letter[first], np.diff(np.append(first, len(letter)))
            nth = np.arange(len(letter)) - np.repeat(first, sizes)
            to = free[letter] + nth if way > 0 else free[letter] - 1 - nth
            self.sa[to] = front[place]
            free[used] += way * sizes
            if self.cap:
                low = np.asarray(lcp[k : k + BATCH], np.int32)
                if len(place):
                    lo = np.where(new, 0, np.concatenate([[0], place[:-1] + 1]))
                    value = Smallest(low).between(lo, place)
                    value = np.where(new, np.minimum(value, self.carry[letter]), value) + 1
                    self.lcp[to if way > 0 else to + 1] = np.minimum(value, self.cap)
                np.minimum(self.carry, low.min(), out=self.carry)
                after = np.append(np.minimum.accumulate(low[::-1])[::-1], self.cap)
                self.carry[used] = after[place[first + sizes - 1] + 1] if len(place) else self.carry[used]

    def _seam(self, a: int, b: int) -> int:
        return int(shared(self.t, np.array([a]), np.array([b]), self.cap)[0])

    def run(self, stars: np.ndarray, star_lcp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        sa, lcp, start, middle, cap = self.sa, self.lcp, self.start, self.middle, self.cap
        bound = np.concatenate([[0], np.cumsum(np.bincount(self.t[stars], minlength=len(middle)))])
        free = start[:-1].copy()
        self.carry = np.full(len(middle), -1, np.int32)
        for c in self.letters:  # the larger ones, upwards
            lo = start[c]
            while lo < free[c]:
                hi = free[c]
                self.push(sa[lo:hi].copy(), lcp[lo:hi].copy() if cap else None, False, free, 1)
                lo = hi
            a, b = bound[c], bound[c + 1]
            if a < b:
                low = None
                if cap:
                    low = star_lcp[a:b].copy()
                    low[0] = self._seam(sa[lo - 1], stars[a]) if lo > start[c] else 0
                self.push(stars[a:b], low, False, free, 1)
        free = start[1:].copy()
        self.carry[:] = -1
        sa[0] = len(self.t) - 1
        for c in self.letters[::-1]:  # the smaller ones, downwards
            hi = start[c + 1]
            if c == self.t[-1]:
                free[c] -= 1
            while hi > free[c]:
                lo = free[c]
                self.push(sa[lo:hi][::-1].copy(), lcp[lo + 1 : hi + 1][::-1].copy() if cap else None, True, free, -1)
                hi = lo
            if cap:
                lcp[hi] = self._seam(sa[hi - 1], sa[hi]) if start[c] < hi < start[c + 1] else lcp[hi]
                if hi == start[c]:
                    lcp[hi] = 0
            if hi > start[c]:
                self.push(sa[start[c] : hi][::-1].copy(), lcp[start[c] + 1 : hi + 1][::-1].copy() if cap else None, True, free, -1)
            if cap:
                lcp[start[c]] = 0
        return sa, lcp


def suffix_order(t: np.ndarray, folder: Folder, cap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``t`` and, with ``cap``, what each suffix shares with the one before it, up to ``cap``.

    The last letter must be 0 and stand nowhere else.
    """
    if len(t) < 3:
        order = np.argsort(t, kind="stable")
        return order, np.zeros(len(t) + 1, np.int16)
    is_s = types(t)
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    name = names(t, stars)
    different = int(name.max()) + 1
    if different == len(stars):
        order = np.argsort(name)
    elif different * FEW > len(stars):
        order = doubled(name)
    else:
        order = suffix_order(name, folder)[0]
    star_lcp = star_prefixes(t, stars, order, cap) if cap else None
    return Induction(t, is_s, folder, cap).run(stars[order], star_lcp)


def repeated(text: np.ndarray, length: int, folder: Folder) -> np.ndarray:
    """Where in ``text`` (bytes + 2; 1 between strings; 0 at the end) a string of ``length`` starts that starts elsewhere too."""
    found = np.zeros(len(text), bool)
    sa, lcp = suffix_order(text, folder, length)
    for k in range(0, len(sa), BATCH):
        same = np.flatnonzero(lcp[k : min(k + BATCH, len(sa))] >= length) + k
        found[sa[same]] = True
        found[sa[same - 1]] = True
    return found
