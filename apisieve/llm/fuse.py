"""Static binary fuse filters (three hashes, 8-bit fingerprints) over 64-bit keys, built and probed in numpy."""

from __future__ import annotations

import math

import numpy as np

from .common import mix64


class BinaryFuse:
    """An immutable set of 64-bit keys: no false negatives, about 1/256 false positives, 9 to 10 bits a key."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """A filter over keys; repeated keys count once, and no keys give a filter that holds nothing."""
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8))
        segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        count = max(1, -(-int(n * factor + 8) // segment) - 2)
        for seed in range(1, 200):
            made = cls(seed, segment, count, np.zeros(segment * (count + 2), np.uint8))
            if made._fill(keys):
                return made
            if seed % 20 == 0:  # very unlucky keys: a little more room
                count += 1
        raise RuntimeError("no binary fuse filter could be built")

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(keys + np.uint64(self.seed * 0x9E3779B97F4A7C15 % 2**64))
        first = ((h >> np.uint64(32)) * np.uint64(self.count) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(self.segment - 1)
        low = mix64(h)
        parts = [(low >> np.uint64(s) & mask).astype(np.int64) for s in (0, 18, 36)]
        return np.stack([parts[j] + (first + j) * self.segment for j in range(3)]), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        slots, prints = self._slots(keys)
        size = len(self.table)
        left = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # xor of the indexes of a slot's keys
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(len(keys)))
        order, ready, done = [], np.flatnonzero(left == 1), 0
        while len(ready):
            who, at = np.unique(held[ready], return_index=True)
            own, theirs = ready[at], slots[:, who]
            order.append((who, own))
            done += len(who)
            np.subtract.at(left, theirs.ravel(), 1)
            np.bitwise_xor.at(held, theirs.ravel(), np.tile(who, 3))
            near = np.unique(theirs)
            ready = near[left[near] == 1]
        if done < len(keys):
            return False
        for who, own in reversed(order):  # keys peeled in one round own slots that no other of the round touches
            theirs = slots[:, who]
            self.table[own] = 0
            self.table[own] = prints[who] ^ np.bitwise_xor.reduce(self.table[theirs], axis=0)
        return True

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        if not len(self.table):
            return np.zeros(len(keys), bool)
        slots, prints = self._slots(keys)
        return np.bitwise_xor.reduce(self.table[slots], axis=0) == prints

    def to_row(self) -> tuple[int, int, int, bytes]:
        return self.seed, self.segment, self.count, self.table.tobytes()

    @classmethod
    def from_row(cls, seed: int, segment: int, count: int, table: bytes) -> BinaryFuse:
        return cls(int(seed), int(segment), int(count), np.frombuffer(table, np.uint8))
