"""Distinct byte strings as a trie in arrays, and tables that find which vocabulary entries end at a node.

The trie is built a level at a time from the sorted strings, so that a prefix which many strings
share is one node and whatever is computed for it is computed once. A polynomial hash of every
prefix gives the hash of any string that ends at a node from two prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
#: Longer strings are walked alone, since a level of a trie with one node gains nothing from arrays.
LONGEST = 96


class Vocabulary:
    """Byte strings with numbers, found by length and hash."""

    def __init__(self, entries: dict[bytes, int]):
        self.exact = entries
        self.lengths = sorted({len(b) for b in entries})
        self.power = [pow(_BASE, n, 1 << 64) for n in range(self.lengths[-1] + 1)]
        keys = np.array([self._key(b) for b in entries], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(entries.values(), np.int64, len(entries))[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two entries share a hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys * np.uint64(_MIX)) >> np.uint64(44)] = True

    @staticmethod
    def _key(b: bytes) -> int:
        h = 0
        for x in b:
            h = (h * _BASE + x + 1) & _MASK
        return h

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are entries, and their numbers."""
        at = np.flatnonzero(self.maybe[(keys * np.uint64(_MIX)) >> np.uint64(44)])
        some = keys[at]
        place = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[place] == some
        return at[hit], self.ids[place[hit]]


class Trie:
    """Nodes by level; node 0 is the root. ends[i] is the node of the i-th of the sorted strings."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        deep = int(size.max(initial=0))
        grid = np.zeros((n, deep), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        grid[np.repeat(np.arange(n), size), col] = flat
        # Bytes in common with the string before, at most its length.
        shared = np.zeros(n, np.int64)
        if n > 1 and deep:
            differ = grid[1:] != grid[:-1]
            shared[1:] = np.where(differ.any(1), differ.argmax(1), deep)
            shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
        total = 1 + int((size - shared).sum())
        self.parent = np.zeros(total, np.int64)
        self.hash = np.zeros(total, np.uint64)
        self.ends = np.zeros(n, np.int64)
        self.levels: list[tuple[int, int]] = [(0, 1)]
        rows, at, base = np.arange(n), np.zeros(n, np.int64), 1
        for depth in range(1, deep + 1):
            keep = size[rows] >= depth
            rows, at = rows[keep], at[keep]
            new = shared[rows] < depth
            made = int(new.sum())
            self.parent[base : base + made] = at[new]
            self.hash[base : base + made] = self.hash[at[new]] * np.uint64(_BASE) + grid[rows[new], depth - 1].astype(np.uint64) + np.uint64(1)
            at = base - 1 + np.cumsum(new)
            ended = size[rows] == depth
            self.ends[rows[ended]] = at[ended]
            self.levels.append((base, base + made))
            base += made

    def suffixes(self, vocabulary: Vocabulary) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
        """For each level from 1 on: (first node, matches), a match (places in the level, ancestors, entry numbers) for each length, short ones first."""
        for depth in range(1, len(self.levels)):
            yield self.levels[depth][0], self._matches(depth, vocabulary)

    def _matches(self, depth: int, vocabulary: Vocabulary):
        lo, hi = self.levels[depth]
        own, up, gone = self.hash[lo:hi], np.arange(lo, hi), 0
        for n in vocabulary.lengths:
            if n > depth:
                return
            while gone < n:
                up, gone = self.parent[up], gone + 1
            at, ids = vocabulary.find(own - self.hash[up] * np.uint64(vocabulary.power[n]))
            if len(at):
                yield at, up[at], ids


class Cache(dict):
    """Results by string for one task. Beyond limit only those in use at the time are kept: it saves work and decides nothing."""

    def __init__(self, compute: Callable[[list], Iterable], limit: int = 300_000):
        self.compute, self.limit = compute, limit

    def fill(self, strings: set) -> None:
        missing = list(filterfalse(self.__contains__, strings))
        if len(self) + len(missing) > self.limit:
            used = {w: self[w] for w in strings if w in self}
            self.clear()
            self.update(used)
        self.update(zip(missing, self.compute(missing), strict=True))
