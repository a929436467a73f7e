"""Sets of whole numbers in containers of 65,536, with ``select`` by cumulative cardinality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Numbers that share their bits from here on are in one container; so many values make a bitmap shorter than an array.
BITS, ARRAY_MOST = 16, 4096
#: Bits that are set in each byte.
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


@dataclass
class ArrayContainer:
    """Sorted low halves."""

    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass
class BitmapContainer:
    """One bit per low half, and how many are set before each byte."""

    bits: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        byte = int(np.searchsorted(self.before, k, "right")) - 1
        at = np.flatnonzero(np.unpackbits(self.bits[byte : byte + 1], bitorder="little"))
        return byte * 8 + int(at[k - self.before[byte]])


@dataclass
class RunContainer:
    """First low half of each run, and how many values are before it."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


Container = ArrayContainer | BitmapContainer | RunContainer


def container(low: np.ndarray) -> Container:
    """The smallest form: runs take four bytes each, arrays two per value, bitmaps 8,192 bytes."""
    first = np.ones(len(low), bool)
    first[1:] = low[1:] != low[:-1] + 1
    runs = int(np.count_nonzero(first))
    if 4 * runs < min(2 * len(low), 2 * ARRAY_MOST):
        at = np.flatnonzero(first)
        return RunContainer(low[at].astype(np.uint16), at.astype(np.int32))
    if len(low) <= ARRAY_MOST:
        return ArrayContainer(low.astype(np.uint16))
    flags = np.zeros(1 << BITS, bool)
    flags[low] = True
    bits = np.packbits(flags, bitorder="little")
    ones = _ONES[bits]
    return BitmapContainer(bits, (np.cumsum(ones) - ones).astype(np.int32))


class BoundarySet:
    """An ordered set of numbers that is built block by block and answers which one is the ``k``-th."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.containers: list[Container] = []
        self.cumulative = [0]

    def add_block(self, key: int, low: np.ndarray) -> None:
        """Add the numbers ``key * 65536 + low``; keys come in ascending order, ``low`` is sorted."""
        if len(low):
            self.keys.append(key)
            self.containers.append(container(low))
            self.cumulative.append(self.cumulative[-1] + len(low))

    def __len__(self) -> int:
        return self.cumulative[-1]

    def select(self, k: int) -> int:
        """The number that has ``k`` smaller ones in the set: container search, then local select."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.cumulative, k, "right")) - 1
        return (self.keys[at] << BITS) + self.containers[at].select(k - self.cumulative[at])
