"""Cuckoo filters over 64-bit keys: membership with few bits a key, and deletion.

A filter holds a 16-bit fingerprint per stored copy in one of two buckets of four slots; the second bucket follows
from the first and the fingerprint, so a slot can move without its key. The same fingerprint may be stored several
times: ``copies`` tells how many are there, which is never fewer than were stored for a key. All calls take arrays.
"""

from __future__ import annotations

import numpy as np

from sitegrain.llm.words import mix

BUCKETS, SLOTS = 1 << 16, 4
CAPACITY = BUCKETS * SLOTS * 8 // 10  # copies that a filter takes before its table is to be dealt to more shards
_KICKS = 200  # rounds of eviction; what has no place then is kept in the stash


class Cuckoo:
    def __init__(self, stored: bytes | None = None) -> None:
        size = BUCKETS * SLOTS
        values = np.frombuffer(stored, np.uint16) if stored else np.zeros(size, np.uint16)
        self.slots = values[:size].reshape(BUCKETS, SLOTS).copy()
        self.stash = values[size:].astype(np.uint16).reshape(-1, 2).copy()  # fingerprint and first bucket of what found no place
        self.rng = np.random.default_rng(7)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes() + self.stash.tobytes()

    @staticmethod
    def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0, which marks a free slot) and first bucket of every key."""
        x = mix(keys.astype(np.uint64))
        return np.maximum(x >> np.uint64(48), np.uint64(1)).astype(np.uint16), (x & np.uint64(BUCKETS - 1)).astype(np.int64)

    @staticmethod
    def _other(prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint; of the second one, the first."""
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)

    def copies(self, keys: np.ndarray) -> np.ndarray:
        """Stored copies that look like each key."""
        prints, first = self._places(keys)
        second = self._other(prints, first)
        found = (self.slots[first] == prints[:, None]).sum(axis=1)
        found += np.where(second != first, (self.slots[second] == prints[:, None]).sum(axis=1), 0)
        for value, bucket in self.stash:
            found += (prints == value) & ((first == bucket) | (second == bucket))
        return found

    def add(self, keys: np.ndarray) -> None:
        """Store one copy of every element of ``keys``."""
        prints, bucket = self._places(keys)
        for _ in range(_KICKS):
            for _ in range(2):
                prints, bucket = self._settle(prints, bucket)
                bucket = self._other(prints, bucket)
            if not len(prints):
                return
            # One of each crowded bucket takes a slot there; its former owner moves to its other bucket.
            rows, turn = np.unique(bucket, return_index=True)
            slot = self.rng.integers(0, SLOTS, len(rows))
            moved = self.slots[rows, slot]
            self.slots[rows, slot] = prints[turn]
            prints, bucket = prints.copy(), bucket.copy()
            prints[turn], bucket[turn] = moved, self._other(moved, rows)
        self.stash = np.concatenate([self.stash, np.stack([prints, bucket.astype(np.uint16)], axis=1)])

    def _settle(self, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fill free slots; what is left over."""
        for slot in range(SLOTS):
            free = np.flatnonzero(self.slots[bucket, slot] == 0)
            rows, turn = np.unique(bucket[free], return_index=True)
            self.slots[rows, slot] = prints[free[turn]]
            left = np.ones(len(prints), bool)
            left[free[turn]] = False
            prints, bucket = prints[left], bucket[left]
        return prints, bucket

    def discard(self, keys: np.ndarray) -> None:
        """Remove one copy of every element of ``keys``; each must have been stored."""
        prints, bucket = self._places(keys)
        for _ in range(2):
            for slot in range(SLOTS):
                # Of several removals that meet one slot, one takes it; the others go on.
                hit = np.flatnonzero(self.slots[bucket, slot] == prints)
                rows, turn = np.unique(bucket[hit], return_index=True)
                self.slots[rows, slot] = 0
                left = np.ones(len(prints), bool)
                left[hit[turn]] = False
                prints, bucket = prints[left], bucket[left]
            bucket = self._other(prints, bucket)
        for value, at in zip(prints, bucket):
            same = np.flatnonzero((self.stash[:, 0] == value) & np.isin(self.stash[:, 1], [at, self._other(np.array([value]), np.array([at]))[0]]))
            self.stash = np.delete(self.stash, same[:1], axis=0)
