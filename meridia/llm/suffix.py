"""Word-level suffix arrays of a shard and binary search of many suffixes at once.

Words are integers: 1..vocab are the words that a query can hold, 0 is any
other word or the gap between two documents, so no match runs through a 0.
"""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """The suffixes of `ids` that begin with a known word, sorted by their first `depth` words."""

    def __init__(self, ids: np.ndarray, vocab: int, depth: int):
        self.bits = int(vocab + 1).bit_length()
        self.width = 62 // self.bits
        self.ids = ids.astype(np.int64)
        n = len(ids)
        self.keys = self._packed(self.ids, n)
        at = np.flatnonzero(self.ids)
        at = at[np.argsort(self.keys[at], kind="stable")]
        # rank: 0 for suffixes that begin with 0, else 1 + the first slot of the equal ones
        rank = np.zeros(n + 1, dtype=np.int64)
        first = self._heads(self.keys[at])
        rank[at] = 1 + first
        done = self.width
        while done < depth and len(at):
            tied = np.flatnonzero(self._tied(first))
            if not len(tied):
                break
            place = at[tied]
            after = np.minimum(place + done, n)
            pair = rank[place] * (n + 2) + rank[after]
            order = np.argsort(pair, kind="stable")
            at[tied] = place[order]
            pair = pair[order]
            new = np.ones(len(tied), dtype=bool)
            new[1:] = pair[1:] != pair[:-1]
            first[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
            rank[at[tied]] = 1 + first[tied]
            done *= 2
        self.order = at

    def _packed(self, ids: np.ndarray, n: int) -> np.ndarray:
        """At each place, the next `width` words in one integer."""
        keys = np.zeros(n, dtype=np.int64)
        for j in range(self.width):
            keys[: n - j] |= ids[j:] << (self.bits * (self.width - 1 - j)) if j < n else 0
        return keys

    @staticmethod
    def _heads(sorted_keys: np.ndarray) -> np.ndarray:
        if not len(sorted_keys):
            return np.zeros(0, dtype=np.int64)
        new = np.ones(len(sorted_keys), dtype=bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))

    @staticmethod
    def _tied(first: np.ndarray) -> np.ndarray:
        same = first[1:] == first[:-1]
        tied = np.zeros(len(first), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        return tied

    def _bound(self, lo: np.ndarray, hi: np.ndarray, skip: int, key: np.ndarray) -> np.ndarray:
        """For each query the first slot in [lo, hi) whose words from `skip` on are >= key."""
        lo, hi, n = lo.copy(), hi.copy(), len(self.ids)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            place = self.order[mid] + skip
            value = np.where(place < n, self.keys[np.minimum(place, n - 1)], 0)
            less = value < key[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)

    def _words(self, queries: np.ndarray, starts: np.ndarray, skip: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least key of the `used` words from `skip` on, and the least key beyond all that begin so."""
        key = np.zeros(len(starts), dtype=np.int64)
        for j in range(self.width):
            word = queries[np.minimum(starts + skip + j, len(queries) - 1)].astype(np.int64)
            key |= np.where(j < used, word, 0) << (self.bits * (self.width - 1 - j))
        return key, key + (np.int64(1) << (self.bits * (self.width - used)))

    def find(self, queries: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots [lo, hi) of the suffixes that begin with all `lengths` words of each query.

        A query is `lengths[i]` words of `queries` from `starts[i]` on.
        """
        size, lo, hi = self.longest(queries, starts, lengths)
        return lo, np.where(size == lengths, hi, lo)

    def longest(self, queries: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's longest prefix that occurs here, and the slots [lo, hi) where it does; an empty prefix has none.

        All queries are bisected together, `width` words a round; one that no
        slot continues gives up a word at a time until a slot does, and is done.
        """
        n = len(starts)
        size, lo, hi = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, len(self.order), dtype=np.int64)
        live, skip = np.flatnonzero(lengths > 0), 0
        while len(live):
            used = np.minimum(lengths[live] - skip, self.width)
            whole, open_ = used.copy(), np.arange(len(live))
            while len(open_):
                at = live[open_]
                key, above = self._words(queries, starts[at], skip, used[open_])
                low = self._bound(lo[at], hi[at], skip, key)
                high = self._bound(low, hi[at], skip, above)
                some = high > low
                lo[at[some]], hi[at[some]] = low[some], high[some]
                open_ = open_[~some]
                used[open_] -= 1
                open_ = open_[used[open_] > 0]
            size[live] += used
            live = live[(used == whole) & (size[live] < lengths[live])]
            skip += self.width
        hi[size == 0] = 0
        return size, lo, hi
