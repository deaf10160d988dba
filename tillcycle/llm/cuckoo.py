"""A cuckoo filter over 128-bit keys, held in numpy: 4 slots a bucket, 16-bit tags.

Bulk insertion places keys bucket by bucket, in their first or second bucket; what is left
moves others one by one.  Each key is added once and may be deleted once; several keys with
the same tag and bucket take a slot each, so deleting one leaves the others in place.
"""

from __future__ import annotations

import numpy as np

SLOTS, MAX_KICKS, LOAD = 4, 500, 0.8
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, SLOTS) uint16, 0: free
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(1, int(keys / (SLOTS * LOAD)) + 1)
        return cls(np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16))

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray):
        a, b = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        tag = (b & np.uint64(0xFFFF)).astype(np.uint16)
        tag[tag == 0] = 1
        first = a & self.mask
        return tag, first.astype(np.int64), self._other(first, tag)

    def _other(self, bucket, tag):
        step = (tag.astype(np.uint64) * _MIX) >> np.uint64(20)
        return ((bucket.astype(np.uint64) ^ step) & self.mask).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        tag, x, y = self._places(k1, k2)
        return (self.slots[x] == tag[:, None]).any(1) | (self.slots[y] == tag[:, None]).any(1)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if some key found no place: the filter is then too small."""
        tag, x, y = self._places(k1, k2)
        left = np.arange(len(tag))
        for bucket in (x, y):
            if not len(left):
                return True
            order = left[np.argsort(bucket[left], kind="stable")]
            b = bucket[order]
            rank = np.arange(len(b)) - np.searchsorted(b, b)
            used = self.slots[b] != 0
            fits = rank < SLOTS - used.sum(1)
            slot = np.argsort(used, axis=1, kind="stable")[np.arange(len(b)), np.minimum(rank, SLOTS - 1)]
            self.slots[b[fits], slot[fits]] = tag[order][fits]
            left = order[~fits]
        return all(self._kick(int(y[i]), tag[i]) for i in left)

    def _kick(self, bucket: int, tag) -> bool:
        for turn in range(MAX_KICKS):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = tag
                return True
            at = turn % SLOTS
            tag, self.slots[bucket, at] = self.slots[bucket, at].copy(), tag
            bucket = int(self._other(np.array([bucket]), np.array([tag], np.uint16))[0])
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        tag, x, y = self._places(k1, k2)
        for t, *buckets in zip(tag, x, y, strict=True):
            for b in buckets:
                hit = np.flatnonzero(self.slots[b] == t)
                if len(hit):
                    self.slots[b, hit[0]] = 0
                    break

    @classmethod
    def built(cls, k1: np.ndarray, k2: np.ndarray, keys: int = 0) -> CuckooFilter:
        """A filter holding these keys, with room for ``keys``; doubled until all fit."""
        size = max(keys, len(k1))
        while True:
            out = cls.sized(size)
            if out.add(k1, k2):
                return out
            size = 2 * max(size, SLOTS)
