"""Encodings of distinct byte strings, kept between batches: each string is encoded once while it stays in the arena."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Arena:
    """Ids by 64-bit hash of a string, in flat arrays. It starts anew beyond `limit` strings, so its memory is bounded."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.offs, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def expanded(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings data[starts:ends], one after the other, and how many each has."""
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > self.limit:
            self._clear()
        place = np.searchsorted(self.known, unique)
        fresh = np.flatnonzero(self.known[np.minimum(place, max(len(self.known) - 1, 0))] != unique) if len(self.known) else np.arange(len(unique))
        if len(fresh):
            found = self.encode([data[starts[i] : ends[i]] for i in at[fresh].tolist()])
            lens = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((x for f in found for x in f), np.uint32, int(lens.sum()))
            slots = np.arange(len(self.offs) - 1, len(self.offs) - 1 + len(fresh))
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(lens)])
            self.ids = np.concatenate([self.ids, flat])
            into = np.searchsorted(self.known, unique[fresh])
            self.known, self.slot = np.insert(self.known, into, unique[fresh]), np.insert(self.slot, into, slots)
            place = np.searchsorted(self.known, unique)
        slot = self.slot[place][inverse] if len(unique) else np.empty(0, np.int64)
        lens = self.offs[slot + 1] - self.offs[slot]
        begin = np.cumsum(lens) - lens
        return self.ids[np.arange(int(lens.sum())) + np.repeat(self.offs[slot] - begin, lens)], lens
