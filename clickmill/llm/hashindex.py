"""Minimal perfect hash of a set of 64-bit keys, in numpy."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"MPHIDX1\0"
#: Bits per key that is still to be placed, and the most levels.
GAMMA, LEVELS = 2.0, 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; another seed gives another hash."""
    h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1000) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots 0 .. n - 1 of n distinct keys.

    Level by level, every key left hashes to a bit of an array of ``GAMMA`` bits per key; keys alone on their bit stay
    there, the others go on. A key's slot is the number of set bits before its own. Looking up takes a hash per level (1.6 on
    average) and one count from a table of running totals, whatever the number of keys.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, placed, start = keys.astype(np.uint64), [], [], 0
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(GAMMA * len(left)))
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            placed.append(at[alone] + start)
            left = left[~alone]
            sizes.append(size)
            start += size
        bits = np.zeros(-(-start // 64) * 64, np.uint8)
        if placed:
            bits[np.concatenate(placed)] = 1
        return cls(np.array(sizes, "<u8"), np.packbits(bits, bitorder="little").view("<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any slot, or -1, for keys that were not in the set."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = mix(keys[left], level) % np.uint64(size) + self.starts[level]
            word = (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<II", len(self.sizes), len(self.words)) + self.sizes.astype("<u8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash and the number of bytes that it took."""
        levels, words = struct.unpack_from("<II", data)
        end = 8 + 8 * levels
        return cls(np.frombuffer(data, "<u8", levels, 8), np.frombuffer(data, "<u8", words, end)), end + 8 * words


#: What a slot holds.
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def pack(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """An index file: magic, number of keys, the hash, the slots with fingerprints."""
    found = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = found.slots(keys)
    for name, values in (("print", fingerprints(keys)), ("shard", shard), ("offset", offset), ("length", length)):
        slots[name][at] = values
    return MAGIC + struct.pack("<Q", len(keys)) + found.to_bytes() + slots.tobytes()


def look_up(data: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of ``keys`` in an index file, and which of the keys it has by their fingerprints."""
    if data[:8] != MAGIC:
        raise ValueError("not an index file")
    (n,) = struct.unpack_from("<Q", data, 8)
    found, used = PerfectHash.from_bytes(data[16:])
    slots = np.frombuffer(data, SLOT, n, 16 + used)
    at = found.slots(keys)
    ok = (at >= 0) & (at < n)
    got = slots[np.where(ok, at, 0)] if n else np.zeros(len(keys), SLOT)
    return got, ok & (got["print"] == fingerprints(keys)) if n else np.zeros(len(keys), bool)
