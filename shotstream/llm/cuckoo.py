"""A cuckoo filter over pairs of 64-bit hashes, filled and probed in bulk.

A key leaves a 16-bit fingerprint in one of two buckets of four slots; either bucket follows from the
other and the fingerprint, so a fingerprint can be moved, and deleted, without its key. What finds no
place after many moves goes to a further level of the same geometry: nothing is refused. A key that was
put in is always found; one that was not is found with a chance of about 1e-4 a level.
"""

from __future__ import annotations

import numpy as np

from shotstream.llm.common import mix

SLOTS = 4
MOVES = 60


class CuckooFilter:
    def __init__(self, buckets: int, slots: bytes | None = None):
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.buckets = buckets
        self.levels = [np.zeros((buckets, SLOTS), np.uint16)]
        if slots:
            self.levels = list(np.frombuffer(slots, np.uint16).reshape(-1, buckets, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return np.stack(self.levels).tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (k2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (k1.view(np.uint64) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        prints, bucket = self._places(k1, k2)
        other, found = self._other(prints, bucket), np.zeros(len(k1), bool)
        for level in self.levels:
            found |= (level[bucket] == prints[:, None]).any(1) | (level[other] == prints[:, None]).any(1)
        return found

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Put in every key, also those that are there already; each ``remove`` takes one out again."""
        prints, bucket = self._places(k1, k2)
        number = 0
        while len(prints):
            if number == len(self.levels):
                self.levels.append(np.zeros((self.buckets, SLOTS), np.uint16))
            prints, bucket = self._settle(self.levels[number], prints, bucket, np.random.default_rng(number))
            number += 1

    def _settle(self, level, prints, bucket, draw) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, with one of their buckets, that have no place in this level after all moves."""
        for _ in range(MOVES):
            for _ in range(2):
                left = self._fill(level, prints, bucket)
                prints, bucket = prints[left], self._other(prints[left], bucket[left])
            if not len(prints):
                break
            # One newcomer a bucket takes a slot there; the fingerprint that lay in it goes on.
            heads = np.unique(bucket, return_index=True)[1]
            at, slot = bucket[heads], draw.integers(0, SLOTS, len(heads))
            evicted = level[at, slot]
            level[at, slot] = prints[heads]
            prints[heads], bucket[heads] = evicted, self._other(evicted, at)
        return prints, bucket

    @staticmethod
    def _rank(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order by the keys, and the number of equals before each row in it."""
        order = np.lexsort(keys)
        change = np.ones(len(order), bool)
        if len(order):
            change[1:] = np.any([np.diff(key[order].astype(np.int64)) != 0 for key in keys], axis=0)
        starts = np.flatnonzero(change)
        return order, np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))

    def _fill(self, level, prints, bucket) -> np.ndarray:
        """Put fingerprints into free slots of their bucket; the positions of those left over."""
        order, rank = self._rank(bucket)
        free = level[bucket[order]] == 0
        slot = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
        fits = slot.any(1)
        done = order[fits]
        level[bucket[done], slot[fits].argmax(1)] = prints[done]
        return order[~fits]

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take one fingerprint of each key out. The keys must have been put in."""
        prints, bucket = self._places(k1, k2)
        for level in self.levels:
            for _ in range(2):
                order, rank = self._rank(prints, bucket)
                same = level[bucket[order]] == prints[order][:, None]
                slot = same & (np.cumsum(same, axis=1) == rank[:, None] + 1)
                found = slot.any(1)
                level[bucket[order[found]], slot[found].argmax(1)] = 0
                left = order[~found]
                prints, bucket = prints[left], self._other(prints[left], bucket[left])
