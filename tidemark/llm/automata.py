"""Weighted acyclic automata: counts of word sequences of one length, as minimal transducers.

A transducer reads a sequence word by word and gives its count. States of a level are told apart by
their arcs alone, so equal endings exist once. It is built from sorted sequences: as soon as a block of
them has passed, every state off the last path is final and is looked up among the states known. States
are numbered by level; arcs of a level lie in one array, by state, then label; the last level's arcs carry
the counts. Labels are places in a sorted word list that goes with the transducer.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<BIII")


def _narrow(values: np.ndarray) -> bytes:
    """The values behind their count and width, in as few bytes each as the largest needs."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return struct.pack("<BI", width, len(values)) + values.astype(f"<u{width}").tobytes()


class Transducer:
    """``words`` (sorted bytes), and by level: first arc of each state, labels, and targets or counts."""

    def __init__(self, words: list[bytes], firsts: list[np.ndarray], labels: list[np.ndarray], targets: list[np.ndarray]) -> None:
        self.words, self.firsts, self.labels, self.targets = words, firsts, labels, targets

    @property
    def order(self) -> int:
        return len(self.labels)

    def to_bytes(self) -> bytes:
        joined = b"".join(self.words)
        parts = [HEAD.pack(self.order, len(self.words), len(joined), 0), _narrow(np.array([len(word) for word in self.words], np.int64)), joined]
        for level in range(self.order):
            parts += [_narrow(np.diff(self.firsts[level])), _narrow(self.labels[level]), _narrow(self.targets[level])]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, payload: bytes) -> "Transducer":
        order, n_words, size, _ = HEAD.unpack_from(payload)
        at = HEAD.size

        def take() -> np.ndarray:
            nonlocal at
            width, count = struct.unpack_from("<BI", payload, at)
            values = np.frombuffer(payload, f"<u{width}", count, at + 5)
            at += 5 + values.nbytes
            return values.astype(np.int64)

        ends = np.cumsum(take())
        words = [payload[at + a:at + b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())] if n_words else []
        at += size
        firsts, labels, targets = [], [], []
        for _ in range(order):
            firsts.append(np.concatenate([[0], np.cumsum(take())]).astype(np.int64))
            labels.append(take())
            targets.append(take())
        return cls(words, firsts, labels, targets)

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All sequences in ascending order, a column of labels for each place, and their counts."""
        columns: list[np.ndarray] = []
        states = np.zeros(1, np.int64)
        for level in range(self.order):
            begin, end = self.firsts[level][states], self.firsts[level][states + 1]
            row = np.repeat(np.arange(len(states)), end - begin)
            arc = np.arange(len(row)) + np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin)
            columns = [column[row] for column in columns] + [self.labels[level][arc]]
            states = self.targets[level][arc]
        return columns, states

    def compose(self, asked: "Transducer") -> tuple[list[np.ndarray], np.ndarray]:
        """Counts of the sequences that ``asked`` accepts: its paths and the count here, 0 where there is none.

        Both are walked at once, level by level; a pair of states goes on by the labels that both have.
        """
        place = {word: n for n, word in enumerate(self.words)}
        here = np.array([place.get(word, -1) for word in asked.words] or [-1], np.int64)
        columns: list[np.ndarray] = []
        states, mine = np.zeros(1, np.int64), np.zeros(1, np.int64)
        wide = len(self.words) + 1
        for level in range(self.order):
            begin, end = asked.firsts[level][states], asked.firsts[level][states + 1]
            row = np.repeat(np.arange(len(states)), end - begin)
            arc = np.arange(len(row)) + np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin)
            label = asked.labels[level][arc]
            columns = [column[row] for column in columns] + [label]
            states = asked.targets[level][arc]
            # arcs are ordered by state and label, so both together are found by bisection
            known = np.repeat(np.arange(len(self.firsts[level]) - 1), np.diff(self.firsts[level])) * wide + self.labels[level]
            wanted = mine[row] * wide + here[label]
            at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
            fits = (mine[row] >= 0) & (here[label] >= 0) & (known[at] == wanted if len(known) else False)
            last = level == self.order - 1
            mine = np.where(fits, self.targets[level][at] if len(known) else 0, 0 if last else -1)
        return columns, mine


class Builder:
    """Takes sorted blocks of different sequences and gives their minimal transducer."""

    def __init__(self, words: list[bytes], order: int) -> None:
        self.words, self.order = words, order
        self.labels: list[list[np.ndarray]] = [[] for _ in range(order)]
        self.targets: list[list[np.ndarray]] = [[] for _ in range(order)]
        self.sizes: list[list[np.ndarray]] = [[] for _ in range(order)]
        self.count = [0] * order
        self.known: list[dict[bytes, int]] = [{} for _ in range(order)]
        self.open: tuple[list[np.ndarray], np.ndarray] | None = None
        self.root: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> None:
        """The next block; what begins with its last first word stays open."""
        if self.open is not None:
            columns = [np.concatenate(pair) for pair in zip(self.open[0], columns)]
            counts = np.concatenate([self.open[1], counts])
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(counts) else 0
        self._freeze([column[:cut] for column in columns], counts[:cut])
        self.open = [column[cut:] for column in columns], counts[cut:]

    def _freeze(self, columns: list[np.ndarray], counts: np.ndarray) -> None:
        if not len(counts):
            return
        change = np.ones(len(counts), bool)
        news = []  # where a new state of each level begins
        for level in range(1, self.order):
            if level == 1:
                change = np.concatenate([[True], columns[0][1:] != columns[0][:-1]])
            else:
                change = change | np.concatenate([[True], columns[level - 1][1:] != columns[level - 1][:-1]])
            news.append(np.flatnonzero(change))
        labels, targets = columns[-1], counts
        for level in range(self.order - 1, 0, -1):
            begin = news[level - 1]
            if level < self.order - 1:  # one arc for each state of the level below
                inner = news[level]
                labels = columns[level][inner]
                begin = np.searchsorted(inner, begin)
            targets = self._states(level, labels, targets, begin)
            labels = columns[level - 1][news[level - 1]]
        self.root[0].append(labels)
        self.root[1].append(targets)

    def _states(self, level: int, labels: np.ndarray, targets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A state number for each group of arcs; groups with equal arcs share one."""
        sizes = np.diff(np.append(begin, len(labels)))
        ids = np.empty(len(begin), np.int64)
        # single arcs, by far the most, are told apart as pairs of numbers; others by their bytes
        single = np.flatnonzero(sizes == 1)
        pairs = np.stack([labels[begin[single]], targets[begin[single]]], 1).astype(np.int64)
        width = int(pairs[:, 1].max()) + 1 if len(pairs) else 1
        packed = pairs[:, 0] * width + pairs[:, 1] if width < 1 << 40 else None
        if packed is not None:
            _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
        else:
            _, first, inverse = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        known = self.known[level]
        new_labels, new_targets, new_sizes = [], [], []

        def number(name: bytes, at: int, size: int) -> int:
            found = known.get(name)
            if found is None:
                found = known[name] = self.count[level]
                self.count[level] += 1
                new_labels.append(labels[at:at + size])
                new_targets.append(targets[at:at + size])
                new_sizes.append(size)
            return found

        singles = np.array([number(struct.pack("<qq", a, b), at, 1) for (a, b), at in
                            zip(pairs[first].tolist(), begin[single][first].tolist())], np.int64)
        ids[single] = singles[inverse.ravel()] if len(single) else singles
        both = np.stack([labels, targets], 1).astype(np.int64)
        for group in np.flatnonzero(sizes > 1).tolist():
            at, size = int(begin[group]), int(sizes[group])
            ids[group] = number(both[at:at + size].tobytes(), at, size)
        if new_sizes:
            self.labels[level].append(np.concatenate(new_labels))
            self.targets[level].append(np.concatenate(new_targets))
            self.sizes[level].append(np.array(new_sizes))
        return ids

    def finish(self) -> Transducer:
        if self.open is not None:
            self._freeze(*self.open)
            self.open = None
        none = np.zeros(0, np.int64)
        self.labels[0], self.targets[0] = self.root
        self.sizes[0] = [np.array([sum(map(len, self.root[0]))])]
        firsts = [np.concatenate([[0], np.cumsum(np.concatenate(sizes or [none]))]).astype(np.int64) for sizes in self.sizes]
        return Transducer(self.words, firsts, *([np.concatenate(level or [none]).astype(np.int64) for level in side]
                                                for side in (self.labels, self.targets)))


def build(words: list[bytes], columns: list[np.ndarray], counts: np.ndarray, block: int = 1 << 18) -> Transducer:
    """The transducer of sorted, different sequences of places in ``words``, which are sorted; unused words are left out."""
    used = np.zeros(len(words), bool)
    for column in columns:
        used[column] = True
    rank = np.cumsum(used) - 1
    builder = Builder([words[n] for n in np.flatnonzero(used).tolist()], len(columns))
    for at in range(0, len(counts), block):
        builder.add([rank[column[at:at + block]] for column in columns], counts[at:at + block])
    return builder.finish()


def sorted_sums(columns: list[np.ndarray], counts: np.ndarray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different sequences in ascending order, counts of equal ones added."""
    if not len(counts):
        return columns, counts
    key = columns[0].astype(np.int64)
    for column in columns[1:-1]:
        _, key = np.unique(key * words + column, return_inverse=True)
        key = key.ravel()
    if len(columns) > 1:
        key = key * words + columns[-1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [column[order[begin]] for column in columns], np.add.reduceat(counts[order], begin)


def union(parts: list[Transducer], least: int = 0) -> Transducer:
    """One transducer of all sequences of the parts, counts of equal ones added; those under ``least`` go."""
    words = sorted(set().union(*(part.words for part in parts)))
    place = {word: n for n, word in enumerate(words)}
    columns: list[list[np.ndarray]] = [[] for _ in range(parts[0].order)]
    counts = []
    for part in parts:
        mine = np.array([place[word] for word in part.words] or [0], np.int64)
        found, sums = part.paths()
        for column, more in zip(columns, found):
            column.append(mine[more])
        counts.append(sums)
    joined, sums = sorted_sums([np.concatenate(column) for column in columns], np.concatenate(counts), len(words) or 1)
    keep = sums >= least
    return build(words, [column[keep] for column in joined], sums[keep])
