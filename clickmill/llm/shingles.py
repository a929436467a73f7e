"""Word shingles of whole texts as sorted arrays of 64-bit hashes, and bounds on their overlap."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_WORDS_KEPT = 150_000
#: Fewest and most hash ranges of a histogram.
LEAST_PARTS, MOST_PARTS = 16, 1 << 14


class WordHashes(dict):
    """Hash of a word's bytes, remembered; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


#: The words that a worker has seen.
seen_words = WordHashes()


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1 + word
    return (h ^ (h >> np.uint64(29))) * _M2


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles of a UTF-8 text.

    ASCII letters count in lower case, words are runs without ASCII white space. A text with fewer words is one
    shingle, one without words (or null) has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen_words.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    mixed = np.full(n, span, np.uint64)
    for k in range(span):
        mixed = _mix(mixed, h[k : k + n])
    return np.unique((mixed ^ (mixed >> np.uint64(32))) * _M3)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(shingles.tobytes())


def parts_of(n: int) -> int:
    """Number of hash ranges of a histogram, a power of two with 8 to 16 shingles each."""
    return min(MOST_PARTS, max(LEAST_PARTS, 1 << (n // 16).bit_length()))


def histogram(shingles: np.ndarray) -> np.ndarray:
    """How many hashes are in each of ``parts_of`` equal hash ranges, 255 standing for more."""
    parts = parts_of(len(shingles))
    at = (shingles >> np.uint64(65 - parts.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=parts), 255).astype(np.uint8)


def fold(histograms: np.ndarray, parts: int) -> np.ndarray:
    """Rows of histograms over fewer ranges; full counters stay full."""
    whole = histograms.reshape(len(histograms), parts, -1)
    return np.where((whole == 255).any(axis=2), 255, np.minimum(whole.sum(axis=2, dtype=np.int64), 255)).astype(np.int16)


def needed(n_a, n_b, percent: int):
    """Smallest intersection for which 100 * intersection >= percent * union."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Two linked sets share one of their first so many shingles in any common order."""
    return n - -(-percent * n // 100) + 1 if n else 0


def similar_histograms(histograms: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs ``(i, j)`` can have enough shingles in common, by the suffix filter.

    Ranges in which one set has more shingles than the other hold shingles of the symmetric difference, at least as many
    as the counts differ by. A sum of such differences that leaves too few shingles for the intersection rules a pair out.
    """
    parts = np.array([len(h) for h in histograms])
    keep = np.zeros(len(i), bool)
    low = np.minimum(parts[i], parts[j])
    for p in np.unique(low):
        folded = {}
        at = np.flatnonzero(low == p)
        for size in np.unique(parts[parts >= p]):
            rows = np.flatnonzero(parts == size)
            folded[size] = (rows, fold(np.stack([histograms[r] for r in rows]), p))
        table = np.zeros((len(histograms), p), np.int16)
        for rows, values in folded.values():
            table[rows] = values
        step = max(1, (1 << 22) // int(p))
        for k in range(0, len(at), step):
            s = at[k : k + step]
            apart = np.abs(table[i[s]] - table[j[s]]).sum(axis=1, dtype=np.int64)
            both = sizes[i[s]] + sizes[j[s]]
            keep[s] = (both - apart) // 2 >= needed(sizes[i[s]], sizes[j[s]], percent)
    return keep


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same of ``n`` nodes as the pairs ``(i, j)`` do, fewer than nodes."""
    if not len(i):
        return []
    near = np.zeros((n, n), bool)
    near[i, j] = near[j, i] = True
    todo = near.any(axis=1)
    out = []
    while todo.any():
        first = int(todo.argmax())
        todo[first] = False
        frontier = np.array([first])
        while len(frontier):
            reached = np.flatnonzero(near[frontier].any(axis=0) & todo)
            todo[reached] = False
            out += [(first, int(r)) for r in reached]
            frontier = reached
    return out


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Those pairs ``(i, j)`` of sets that are similar enough; a pair that earlier ones connect is not looked at."""
    at = list(range(len(sets)))

    def find(x: int) -> int:
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            a, b = sets[x], sets[y]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                at[ry] = rx
                out.append((x, y))
    return out
