"""Suffix arrays by induced sorting, and permuted common prefixes, on whole numpy arrays.

Suffixes are typed (smaller or larger than their successor), the leftmost smaller ones are sorted by
their substrings and, where these repeat, recursively; one pass up and one pass down the buckets then
induces all others. Each pass handles a bucket's entries at once, so the work stays linear while numpy
does the inner loops. A recursion level whose names exceed ``WIDEST`` writes each name as two digits:
suffixes that begin at a first digit keep their order.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that a level takes as it is: a pass costs some calls for every letter.
WIDEST = 128


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the end of the text is smaller than any value."""
    n = len(text)
    smaller = np.zeros(n, bool)
    if n > 1:
        step = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
        # an equal neighbour passes on the type of the next place that differs
        place = np.where(step != 0, np.arange(n - 1), n)
        place = np.minimum.accumulate(place[::-1])[::-1]
        smaller[:-1] = np.where(place < n, step[np.minimum(place, n - 2)] > 0, False)
    return smaller


class _Induction:
    """Sorts all suffixes from the order of the leftmost smaller ones."""

    def __init__(self, text: np.ndarray, letters: int) -> None:
        self.text, self.letters = text, letters
        self.smaller = _types(text)
        self.least = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1
        self.totals = np.bincount(text, minlength=letters)
        self.ends = np.cumsum(self.totals)
        self.starts = self.ends - self.totals
        self.kind = np.uint16 if letters > 256 else np.uint8

    def _put(self, order: np.ndarray, found: np.ndarray, at: np.ndarray, sign: int) -> None:
        """Append ``found`` to the buckets of their values, upward from or downward to ``at``."""
        if not len(found):
            return
        values = self.text[found].astype(self.kind)
        by = np.argsort(values, kind="stable")
        values, found = values[by], found[by]
        if values[0] == values[-1]:  # one bucket
            value, n = int(values[0]), len(found)
            to = int(at[value])
            if sign > 0:
                order[to:to + n] = found
            else:
                order[to - n:to] = found[::-1]
            at[value] += sign * n
            return
        first = np.concatenate([[0], (values[1:] != values[:-1]).nonzero()[0] + 1, [len(values)]])
        counts = first[1:] - first[:-1]
        begin = at[values[first[:-1]]]
        rank = np.arange(len(values))
        order[(begin - first[:-1]).repeat(counts) + rank if sign > 0 else (begin - 1 + first[:-1]).repeat(counts) - rank] = found
        at[values[first[:-1]]] += sign * counts

    def sort(self, least: np.ndarray) -> np.ndarray:
        n, text, smaller = len(self.text), self.text, self.smaller
        order = np.full(n, -1, np.int32)
        tails = self.ends.copy()
        self._put(order, least[::-1], tails, -1)
        placed = tails.copy()  # where the given suffixes of each bucket begin
        heads = self.starts.copy()
        self._put(order, np.array([n - 1], np.int32), heads, 1)  # before the end of the text
        for letter in np.flatnonzero(self.totals).tolist():
            begin = int(self.starts[letter])
            while begin < heads[letter]:
                chunk = order[begin:heads[letter]] - 1
                begin = int(heads[letter])
                chunk = chunk[chunk >= 0]
                self._put(order, chunk[~smaller[chunk]], heads, 1)
            if placed[letter] < self.ends[letter]:
                self._put(order, order[placed[letter]:self.ends[letter]] - 1, heads, 1)
        tails = self.ends.copy()
        for letter in np.flatnonzero(self.totals)[::-1].tolist():
            end = int(self.ends[letter])
            while end > tails[letter]:
                chunk = order[tails[letter]:end][::-1] - 1
                end = int(tails[letter])
                chunk = chunk[chunk >= 0]
                self._put(order, chunk[smaller[chunk]], tails, -1)
            if self.starts[letter] < heads[letter]:
                chunk = order[self.starts[letter]:heads[letter]][::-1] - 1
                chunk = chunk[chunk >= 0]
                self._put(order, chunk[smaller[chunk]], tails, -1)
        return order

    def names(self, sorted_least: np.ndarray) -> tuple[np.ndarray, int]:
        """For each leftmost smaller suffix in text order the rank of its substring, and how many there are."""
        text, least = self.text, self.least
        size = np.zeros(len(text), np.int32)
        size[least[:-1]] = np.diff(least) + 1
        a, b = sorted_least[:-1], sorted_least[1:]
        same = (size[a] == size[b]) & (size[a] > 0)  # the last substring reaches the end and equals no other
        live = np.flatnonzero(same)
        offset = 0
        while len(live):
            differ = text[a[live] + offset] != text[b[live] + offset]
            same[live[differ]] = False
            offset += 1
            live = live[~differ]
            live = live[size[a[live]] > offset]
        rank = np.concatenate([[0], np.cumsum(~same)]).astype(np.int32)
        named = np.empty(len(text), np.int32)
        named[sorted_least] = rank
        return named[least], int(rank[-1]) + 1


def suffix_array(text: np.ndarray, letters: int = 256) -> np.ndarray:
    """The start of every suffix of ``text`` (values below ``letters``) in ascending order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    induction = _Induction(text, letters)
    least = induction.least.astype(np.int32)
    if len(least) > 1:
        order = induction.sort(least)
        is_least = np.zeros(n, bool)
        is_least[least] = True
        names, count = induction.names(order[is_least[order]])
        if count == len(least):
            ranked = np.argsort(names)
        elif count <= WIDEST:
            ranked = suffix_array(names, count)
        else:
            base = int(np.ceil(np.sqrt(count)))
            digits = np.empty(2 * len(names), np.uint16 if base <= 1 << 16 else np.int32)
            digits[0::2], digits[1::2] = names // base, names % base
            ranked = suffix_array(digits, base)
            ranked = ranked[ranked % 2 == 0] // 2
        least = least[ranked]
    return induction.sort(least)


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of a text of bytes, how long a prefix its suffix shares with the one before it in ``order``.

    Only places whose preceding byte differs from their neighbour's are compared, eight bytes at a
    time; elsewhere a value is one less than that of the place before.
    """
    n = len(text)
    found = np.zeros(n, np.int32)
    if n < 2:
        return found
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    preceding = np.concatenate([[-1], text[:-1].astype(np.int32)])
    derived = (before > 0) & (here > 0) & (preceding == preceding[np.maximum(before, 0)])
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    words = sum(padded[k:k + n].astype(np.uint64) << np.uint64(8 * (7 - k)) for k in range(8))
    live = np.flatnonzero(~derived & (before >= 0))
    other, done = before[live], 0
    while len(live):
        room = np.minimum(n - done - live, n - done - other)
        inside = room > 0
        x = words[np.minimum(live + done, n - 1)] ^ words[np.minimum(other + done, n - 1)]
        lead = np.full(len(live), 8, np.int64)
        for k in range(7, -1, -1):
            lead[x >> np.uint64(8 * (7 - k)) & np.uint64(255) != 0] = k
        lead = np.where(inside, np.minimum(lead, np.maximum(room, 0)), 0)
        found[live] += lead.astype(np.int32)
        on = (lead == 8) & (room > 8)
        live, other = live[on], other[on]
        done += 8
    source = np.maximum.accumulate(np.where(derived, 0, here))
    return np.where(derived, found[source] - (here - source), found).astype(np.int32)
