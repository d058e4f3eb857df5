"""Cuckoo filters of 128-bit digests, worked on by whole arrays: sets that can be asked, added to and taken from.

A shard is a table of buckets of four 16-bit fingerprints. A digest (hi, lo) lies in the shard that hi's first bits
name, in one of two buckets, each of which follows from the other and the fingerprint. What finds no place even after
many moves goes to the shard's stash, so that nothing that was added is ever missed.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Buckets of a shard, a power of two, and how many digests a shard should hold on average (two thirds of its slots).
BUCKETS, SHARD_KEYS = 1 << 15, 87_000
SHARD_BYTES = BUCKETS * SLOTS * 2
#: Rounds in which what found no place pushes out something else.
ROUNDS = 200


def shard_bits(keys: int, shard_keys: int = SHARD_KEYS) -> int:
    """How many first bits name the shard, for so many digests."""
    return max(0, (-(-keys // shard_keys) - 1).bit_length())


def prints(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint from 1 on, first bucket) of digests in unsigned 64-bit halves."""
    return (hi % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (lo & np.uint64(BUCKETS - 1)).astype(np.int64)


def other(fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return bucket ^ ((fp.astype(np.int64) * 0x5BD1E995 >> 7) & (BUCKETS - 1))


def _named(fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """One number for a fingerprint and its two buckets."""
    return (np.minimum(bucket, other(fp, bucket)) << 16) | fp


class Shard:
    def __init__(self, table: bytes | None = None, stash: bytes | None = None):
        self.table = np.frombuffer(table, np.uint16).reshape(BUCKETS, SLOTS).copy() if table else np.zeros((BUCKETS, SLOTS), np.uint16)
        self.stash = np.frombuffer(stash or b"", np.int64).copy()

    def _place(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts fingerprints where their bucket is free; which of them were left."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rank = np.arange(len(b)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(b)]])))
        taken = self.table[b] != 0
        fits = rank < SLOTS - taken.sum(axis=1)
        slot = np.argsort(taken, axis=1, kind="stable")[fits, rank[fits]]
        self.table[b[fits], slot] = fp[order[fits]]
        left = np.ones(len(fp), dtype=bool)
        left[order[fits]] = False
        return left

    def add(self, fp: np.ndarray, bucket: np.ndarray) -> None:
        choose = np.random.default_rng(len(fp))
        for _ in range(ROUNDS):
            for _ in range(2):
                if not len(fp):
                    return
                left = self._place(fp, bucket)
                fp, bucket = fp[left], other(fp[left], bucket[left])
            # One of those that want a bucket takes the place of something in it.
            b, first = np.unique(bucket, return_index=True)
            slot = choose.integers(0, SLOTS, len(b))
            out = self.table[b, slot].copy()
            self.table[b, slot] = fp[first]
            rest = np.ones(len(fp), dtype=bool)
            rest[first] = False
            real = out > 0
            fp, bucket = np.concatenate([fp[rest], out[real]]), np.concatenate([bucket[rest], other(out[real], b[real])])
        self.stash = np.concatenate([self.stash, _named(fp, bucket)])

    def take(self, fp: np.ndarray, bucket: np.ndarray) -> None:
        """Takes out one copy for each; all were added before."""
        while len(fp):
            _, first = np.unique(_named(fp, bucket), return_index=True)
            f, b = fp[first], bucket[first]
            done = np.zeros(len(f), dtype=bool)
            for side in (b, other(f, b)):
                hit = self.table[side] == f[:, None]
                now = hit.any(axis=1) & ~done
                self.table[side[now], hit[now].argmax(axis=1)] = 0
                done |= now
            for name in _named(f[~done], b[~done]):
                at = np.flatnonzero(self.stash == name)
                if not len(at):
                    raise ValueError("a line is taken out that was never put in")
                self.stash = np.delete(self.stash, at[0])
            rest = np.ones(len(fp), dtype=bool)
            rest[first] = False
            fp, bucket = fp[rest], bucket[rest]


class Filter:
    """All shards, to be asked."""

    def __init__(self, bits: int, shards: list[tuple[int, bytes, bytes]]):
        self.bits = bits
        self.table = np.zeros((BUCKETS << bits, SLOTS), np.uint16)
        stashes = [np.zeros(0, np.int64)]
        for shard, table, stash in shards:
            self.table[shard * BUCKETS : (shard + 1) * BUCKETS] = np.frombuffer(table, np.uint16).reshape(BUCKETS, SLOTS)
            # Asked for in all shards: a stash is small, and a match only a suspicion.
            stashes.append(np.frombuffer(stash, np.int64))
        self.stash = np.unique(np.concatenate(stashes))

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, bucket = prints(hi, lo)
        base = (hi >> np.uint64(64 - self.bits)).astype(np.int64) * BUCKETS if self.bits else 0
        found = np.zeros(len(hi), dtype=bool)
        for b in (bucket, other(fp, bucket)):
            rows = self.table[base + b]
            for s in range(SLOTS):
                found |= rows[:, s] == fp
        return found | np.isin(_named(fp, bucket), self.stash) if len(self.stash) else found
