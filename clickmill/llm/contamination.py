"""Benchmark passages in documents: rare n-gram seeds join passages to items, Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_memory, ship, small_table, spans, table

#: Words of a seed, which is also the fewest words of an item that is looked for; seeds of an item, its rarest n-grams.
SEED, SEEDS = 3, 8
#: Share of an item's words, its rarest ones, by which places without a seed are found; must exceed 1 - LEAST_SCORE * MATCH / STEP.
RAREST = 0.75
#: Scores of an equal word, another word, and a word that only one side has.
MATCH, OTHER, GAP = 2, -1, -1
#: What an equal word is worth more than any other word of the text.
LOSS = -max(OTHER, GAP)
STEP = MATCH + LOSS
#: Share of the best possible score of an item from which a passage counts, and the fewest equal words of it.
LEAST_SCORE, LEAST_EQUAL = 0.5, 8
#: Words of stretches that wait to be aligned, and of those that are aligned together.
WAITING, CELLS = 1 << 18, 1 << 14
#: Characters of the texts that are taken apart together, and of the pieces in which they are hashed.
CHARS, PIECE = 1 << 19, 1 << 17
#: Items that are searched for in one pass over the documents, and words of them; words of an item that are aligned as one.
ITEMS_AT_ONCE, ITEM_WORDS, LONGEST = 20_000, 1 << 20, 1 << 14

_WORD, _BREAK = re.compile(r"\w+"), re.compile(r"\W")
_BASE = 0x9E3779B97F4A7C15
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@cache
def letter_codes() -> np.ndarray:
    """A random number per word character, zero for any other."""
    points = "".join(map(chr, range(0x110000)))
    x = np.arange(1, len(points) + 1, dtype=np.uint64) * _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3 | np.uint64(1)
    out = np.zeros(len(points), np.uint64)
    for m in _WORD.finditer(points):
        out[m.start() : m.end()] = x[m.start() : m.end()]
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


@cache
def piece_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, 2 * PIECE), powers(pow(_BASE, -1, 1 << 64), 2 * PIECE)


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first character of each run of word characters of a lower-case text.

    A hash is a polynomial in the numbers of the characters, taken as a difference of running totals, so all words of
    a piece are hashed by a few array operations. Pieces end between words.
    """
    hashes, starts, at = [], [], 0
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        code = letter_codes()[np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.zeros(len(code) + 2, np.int8)
        word[1:-1] = code != 0
        edges = np.flatnonzero(np.diff(word))
        begin, stop = edges[::2], edges[1::2]
        up, down = piece_powers() if len(code) <= 2 * PIECE else (powers(_BASE, len(code)), powers(pow(_BASE, -1, 1 << 64), len(code)))
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * up[: len(code)], out=total[1:])
        h = (total[stop] - total[begin]) * down[begin]
        hashes.append((h ^ (h >> np.uint64(32))) * _M2)
        starts.append(begin + at)
        at = end
    return np.concatenate([*hashes, np.empty(0, np.uint64)]), np.concatenate([*starts, np.empty(0, np.int64)])


class Lookup:
    """Places of 64-bit hashes in a sorted set of them: the leading bits lead to the first hash that has them."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        slots = (self.keys >> np.uint64(44)).astype(np.int64)
        per_slot = np.bincount(slots, minlength=1 << 20)
        self.first = np.minimum(np.cumsum(per_slot) - per_slot, max(0, len(self.keys) - 1)).astype(np.int32)
        self.many = per_slot > 1

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is not in the set."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        slot = hashes >> np.uint64(44)
        out = self.first[slot].astype(np.int64)
        other = np.flatnonzero(self.keys[out] != hashes)
        out[other] = -1
        other = other[self.many[slot[other]]]
        at = np.minimum(np.searchsorted(self.keys, hashes[other]), len(self.keys) - 1)
        out[other] = np.where(self.keys[at] == hashes[other], at, -1)
        return out


def gram_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` words from each place of ``at`` on, by their numbers."""
    h = np.full(len(at), SEED, np.uint64)
    for k in range(SEED):
        h = (h ^ (h >> np.uint64(31))) * _M1 + words[at + k].astype(np.uint64) * _M3
    return (h ^ (h >> np.uint64(29))) * _M2


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of word characters."""
    return _WORD.findall((text or "").lower())


class Searcher:
    """The items of one block: their words as numbers, the seeds of each, and the words by which it is found without one."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        split, hashes = [], []
        self.ids = []
        for item_id, text in items:
            found, _ = word_hashes(text.lower())
            hashes.append(found)
            # an item too long to be aligned as one is searched in parts, each like an item of its own
            parts = np.array_split(found, -(-len(found) // LONGEST)) if len(found) > LONGEST else [found]
            split += parts
            self.ids += [item_id] * len(parts)
        self.numbers = Lookup(np.concatenate([*hashes, np.empty(0, np.uint64)]))  # any other word counts as 0
        self.words = [self.numbers.find(h) + 1 for h in split]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        hashes = [gram_hashes(w, np.arange(max(0, len(w) - SEED + 1))) for w in self.words]
        self.grams = Lookup(np.concatenate([*hashes, np.empty(0, np.uint64)]))
        self.item_grams = [np.unique(self.grams.find(h)) for h in hashes]
        self.keep_rarest(np.zeros(len(self.numbers) + 1, np.int64))
        self.keep_seeds(np.zeros(len(self.grams), np.int64))

    def numbered(self, text: str | None) -> np.ndarray:
        return self.numbers.find(word_hashes((text or "").lower())[0]) + 1

    def numbered_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts one after another, and the place of the first word of each text, with the end."""
        lower = [(t or "").lower() for t in texts]
        hashes, starts = word_hashes("\n".join(lower))
        first = np.cumsum([0, *(len(t) + 1 for t in lower)])
        return self.numbers.find(hashes) + 1, np.searchsorted(starts, first)

    def grams_of(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, gram) of every n-gram of an item in texts that lie one after another."""
        known = numbers != 0
        n = max(0, len(numbers) - SEED + 1)
        whole = np.ones(n, bool)
        for k in range(SEED):
            whole &= known[k : k + n]
        for k in range(1, SEED):  # none reaches into the next text
            cut = first[1:-1] - k
            whole[cut[(cut >= 0) & (cut < n)]] = False
        at = np.flatnonzero(whole)
        gram = self.grams.find(gram_hashes(numbers, at))
        return at[gram >= 0], gram[gram >= 0]

    def keep_seeds(self, frequency: np.ndarray) -> None:
        """Seeds of each item: its rarest n-grams of those that some document has; ``frequency`` has a number per n-gram."""
        items, seeds = [], []
        for k, own in enumerate(self.item_grams):
            grams = own[frequency[own] > 0]
            grams = grams[np.argsort(frequency[grams], kind="stable")[:SEEDS]]
            items.append(np.full(len(grams), k))
            seeds.append(grams)
        items, seeds = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (items, seeds))
        order = np.argsort(seeds, kind="stable")
        self.seed_items, self.seeds = items[order], seeds[order]
        self.seed_count = np.bincount(seeds, minlength=len(self.grams))
        self.seed_first = np.cumsum(self.seed_count) - self.seed_count
        #: how far a passage of any item with a seed can reach from it
        self.seed_reach = np.zeros(len(self.grams), np.int64)
        np.maximum.at(self.seed_reach, self.seeds, self.reach[self.seed_items])

    def keep_rarest(self, frequency: np.ndarray) -> None:
        """Find each item by its rarest words, a fixed share; ``frequency`` has a number per word.

        Of an item of ``n`` words, a passage of ``w`` words that counts has some ``m`` equal words, and ``MATCH * m - LOSS *
        (w - m)`` is at least the least score. Of any ``r`` words of the item at least ``r - (n - m)`` are among the equal ones,
        so ``STEP`` times the words of the passage that are among those ``r``, less ``LOSS * w``, is at least ``need``: the
        least score less ``STEP * (n - r)``. That holds for every choice, also for words that no document has.
        """
        least = np.ceil(LEAST_SCORE * MATCH * self.lengths).astype(np.int64)
        kept = np.ceil(RAREST * self.lengths).astype(np.int64)
        self.need = least - STEP * (self.lengths - kept)
        #: the passage has at most ``m + (MATCH * m - least) / LOSS`` words, and m is at most the item's length
        self.reach = self.lengths + (MATCH * self.lengths - least) // LOSS
        found = [np.unique(w[np.argsort(frequency[w], kind="stable")[:r]]) for w, r in zip(self.words, kept, strict=True)]
        words = np.concatenate([*found, np.empty(0, np.int64)])
        items = np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.argsort(words, kind="stable")
        self.items = items[order]
        self.count = np.bincount(words, minlength=len(self.numbers) + 1)
        self.first = np.cumsum(self.count) - self.count

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of every word by which an item is found, in this order."""
        at = np.flatnonzero(self.count[numbers])
        item, place = spread(numbers[at], at, self.count, self.first, self.items)
        order = np.argsort(item.astype(np.int32), kind="stable")
        return item[order], place[order]

    def seeded(self, places: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(seed, text, begin, end) of stretches that hold every passage with the seed or with its end near the seed."""
        order = np.argsort(grams, kind="stable")
        seed, place = grams[order], places[order]
        row = np.searchsorted(first, place, "right") - 1
        reach = self.seed_reach[seed]
        begin, end = np.maximum(place - 2 * reach, first[row]), np.minimum(place + reach + SEED, first[row + 1])
        return merged(seed, row, begin, end)

    def unseeded(self, numbers: np.ndarray, first: np.ndarray, places: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """(item, text, begin, end): stretches of texts that hold every passage that counts and that no seed leads to.

        The running total of a hit's worth less the words passed, above its lowest value so far, is the most that any
        stretch up to a hit has. Where it reaches the item's ``need``, a passage may have its last hit.
        """
        item, place = self.hits(numbers)
        if not len(item):
            return np.empty((0, 4), np.int64)
        row = np.searchsorted(first, place, "right") - 1
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1])
        total = STEP * np.arange(len(item)) - LOSS * place
        apart = np.cumsum(new) * (STEP * len(item) + LOSS * len(numbers) + 1)
        most = total - (np.minimum.accumulate(total - apart) + apart) + STEP - LOSS
        ends = np.flatnonzero(most >= self.need[item])
        item, place, row = item[ends], place[ends], row[ends]
        reach = self.reach[item]
        # a passage that ends at most its reach before or after a seed of the item lies in the stretch of that seed
        owner, at = spread(grams, places, self.seed_count, self.seed_first, self.seed_items)
        width = len(numbers) + 1
        keys = np.sort(owner * width + at)
        low, high = np.maximum(place - reach, first[row]), np.minimum(place + reach, first[row + 1] - 1)
        rest = np.searchsorted(keys, item * width + high, "right") <= np.searchsorted(keys, item * width + low, "left")
        item, place, row, reach = item[rest], place[rest], row[rest], reach[rest]
        return merged(item, row, np.maximum(place - reach + 1, first[row]), np.minimum(place + reach, first[row + 1]))

    def passages(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and first places of the texts, stretches per seed, and stretches per item beyond its seeds."""
        numbers, first = self.numbered_all(texts)
        places, grams = self.grams_of(numbers, first)
        some = self.seed_count[grams] > 0
        places, grams = places[some], grams[some]
        return numbers, first, self.seeded(places, grams, first), self.unseeded(numbers, first, places, grams)


def spread(keys: np.ndarray, places: np.ndarray, count: np.ndarray, first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place once per value of its key: the values of key ``k`` are the ``count[k]`` ones from ``first[k]``."""
    times = count[keys]
    entry = np.repeat(first[keys] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    return values[entry], np.repeat(places, times)


def merged(key: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Stretches, sorted by key and begin, of which those of one key and row that meet become one."""
    if not len(key):
        return np.empty((0, 4), np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
    at = np.flatnonzero(new)
    return np.column_stack((key[at], row[at], begin[at], np.append(end[at[1:] - 1], end[-1])))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman: best local score, number of equal words on its path, begin and end of it in ``text``."""
    return align_all(item, [text])[0]


def align_all(item: np.ndarray, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """:func:`align` of each text, all at once.

    One row per word of the item. Within a row the gaps from the left are a running maximum, so a row is a few array
    operations. A cell is one integer: score in the high bits, then begin of the path, then equal words, so the larger
    integer is the better path, and of equal scores the shorter one. Items and texts have fewer than 2^20 words, see
    ``LONGEST`` and :func:`cut`.
    """
    text = side_by_side(texts)
    n = text.shape[1]
    if not n or not len(item):
        return [(0, 0, 0, 0)] * len(texts)
    point = 1 << 40
    place, each = np.arange(n + 1, dtype=np.int64), np.arange(len(texts))
    fresh, gaps = place << 20, GAP * point * place
    row = np.tile(fresh, (len(texts), 1))
    best, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for word in item:
        new = np.maximum(row + GAP * point, fresh)
        np.maximum(new[:, 1:], row[:, :-1] + np.where(text == word, MATCH * point + 1, OTHER * point), out=new[:, 1:])
        new -= gaps
        row = np.maximum.accumulate(new, axis=1, out=new)
        row += gaps
        k = (row >> 40).argmax(axis=1)
        cell = row[each, k]
        better = (cell >> 40) > (best >> 40)
        best, end = np.where(better, cell, best), np.where(better, k, end)
    low = (1 << 20) - 1
    return list(zip((best >> 40).tolist(), (best & low).tolist(), (best >> 20 & low).tolist(), end.tolist(), strict=True))


def side_by_side(texts: list[np.ndarray]) -> np.ndarray:
    """One row per text, filled up with a word that no item has."""
    out = np.full((len(texts), max(map(len, texts), default=0)), -1, np.int64)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = text
    return out


def may_count(item: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Whether the words of each text that ``item`` has, in any order, are dense enough for the least score."""
    text = side_by_side(texts)
    known = np.zeros(max(int(text.max(initial=0)), int(item.max())) + 2, bool)  # the last one is for -1
    known[item] = True
    total = np.zeros((len(texts), text.shape[1] + 1), np.int64)
    np.cumsum(np.where(known[text], MATCH, -LOSS), axis=1, out=total[:, 1:])
    return (total - np.minimum.accumulate(total, axis=1)).max(axis=1) >= LEAST_SCORE * MATCH * len(item)


#: Item -> (score, equal words, begin, end) of its best passage in a text.
Found = dict[int, tuple[float, int, int, int]]


def cut(begin: int, numbers: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long stretch in pieces, so that every passage of at most ``reach`` words lies in one of them."""
    size = max(CELLS, 4 * reach)
    for at in range(0, max(1, len(numbers) - reach), size - reach):
        yield begin + at, numbers[at : at + size]


def whole(stretches: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches ``(begin, words)`` of one text, joined where they meet."""
    stretches = sorted(stretches, key=lambda s: s[0])
    begin, held = stretches[0][0], [stretches[0][1]]
    end = begin + len(held[0])
    for at, words in stretches[1:]:
        if at > end:
            yield begin, np.concatenate(held)
            begin, held, end = at, [words], at + len(words)
        elif at + len(words) > end:
            held.append(words[end - at :])
            end = at + len(words)
    yield begin, np.concatenate(held)


def best_of(searcher: Searcher, waiting: dict[int, dict[int, list[tuple[int, np.ndarray]]]], rows: int) -> list[Found]:
    """Best alignments in texts 0 to ``rows`` - 1, of which ``waiting`` has stretches per item and text; those of one item are
    aligned together."""
    out: list[Found] = [{} for _ in range(rows)]
    for item, texts in waiting.items():
        reach = int(searcher.reach[item])
        add_best(out, item, searcher.words[item], [(k, at, w) for k, parts in texts.items() for begin, numbers in whole(parts) for at, w in cut(begin, numbers, reach)])
    return out


def scored(searcher: Searcher, text: str | None) -> Found:
    """Best alignment of each item that the text holds: what the join of seeds and the alignment give, for one text."""
    numbers, _, seeded, unseeded = searcher.passages([text])
    waiting: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
    for seed, _, begin, end in seeded.tolist():
        for item in searcher.seed_items[searcher.seed_first[seed] :][: searcher.seed_count[seed]].tolist():
            waiting.setdefault(item, {}).setdefault(0, []).append((begin, numbers[begin:end]))
    for item, _, begin, end in unseeded.tolist():
        waiting.setdefault(item, {}).setdefault(0, []).append((begin, numbers[begin:end]))
    return best_of(searcher, waiting, 1)[0]


def add_best(out: list[Found], item: int, words: np.ndarray, stretches: list[tuple[int, int, np.ndarray]]) -> None:
    stretches.sort(key=lambda s: len(s[2]))
    while stretches:
        part = stretches[-max(1, CELLS // len(stretches[-1][2])) :]
        del stretches[-len(part) :]
        part = [s for s, may in zip(part, may_count(words, [s[2] for s in part]), strict=True) if may]
        for (k, begin, _), (score, equal, a, b) in zip(part, align_all(words, [s[2] for s in part]), strict=True):
            got = (score / (MATCH * len(words)), equal, begin + a, begin + b)
            if got[0] >= LEAST_SCORE and equal >= min(LEAST_EQUAL, len(words)) and (item not in out[k] or got > out[k][item]):
                out[k][item] = got


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``size``, and of at most ``ITEM_WORDS`` words or one item alone, in order of their ids;
    items of fewer words than a seed are left out."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    items = table(items, "items")
    last: tuple | None = None
    while True:
        rest = items if last is None else items.where(F.struct(F.coalesce("item_id", F.lit(-(1 << 63))), "text") > F.struct(F.lit(last[0]).cast("bigint"), F.lit(last[1])))
        rows = rest.orderBy(F.coalesce("item_id", F.lit(-(1 << 63))), "text").limit(size).collect()
        if not rows:
            return
        last = (rows[-1].item_id if rows[-1].item_id is not None else -(1 << 63), rows[-1].text)
        items_of = [(r.item_id, r.text) for r in rows]
        sizes = np.array([len(words_of(text)) for _, text in items_of])
        some = np.flatnonzero(sizes >= SEED)
        for a, b in spans(sizes[some], ITEM_WORDS):
            yield [items_of[k] for k in some[a:b].tolist()]
        if len(rows) < size:
            return


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """Documents that hold a passage like an item of the benchmark, exact, edited or paraphrased word by word.

    One row per row of ``docs`` and item found in it: ``doc_id``, ``item_id``, ``score`` (share of the best possible alignment
    score, from ``LEAST_SCORE``), ``equal_words``, and the first and last word of the best passage (``begin``, ``end``,
    exclusive). A null or empty text holds nothing; a null id stays null; rows that repeat an id are searched one by one;
    null items and items of fewer than ``SEED`` words are not looked for; an item of more than ``LONGEST`` words is looked for in
    equal parts, each scored like an item, and the best part is reported; equal items with different ids are all
    reported; a text of any length is searched whole; without documents or items there are no rows. Other columns are not
    looked at. Words are told apart by hashes of 64 bits.

    The benchmark is a stated query set and is taken in blocks of ``items_at_once`` items, which bounds what is sent to the
    tasks. Per block, one pass counts how often each word and each n-gram of an item occurs. The ``SEEDS`` rarest n-grams of
    an item that some document has are its seeds: a second pass takes the passages around them out of the documents, a
    join by seed gives each its items, and both are aligned. An edited copy may have lost all seeds; the second pass also takes
    out the places near no seed where an item's rarest words are as dense as any passage that counts makes them, so
    none is missed. Texts are read twice and never moved: the seeds of a block are broadcast, at most ``SEEDS`` per item.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    types = {"doc_id": source.schema["doc_id"].dataType.simpleString(), "item_id": benchmark.schema[item_col].dataType.simpleString()}
    types |= {"score": "double", "equal_words": "bigint", "begin": "bigint", "end": "bigint"}
    kind = ", ".join(f"{name} {of}" for name, of in types.items())
    out: DataFrame = spark.range(0).select(*(F.lit(None).cast(of).alias(name) for name, of in types.items()))
    for block in item_blocks(benchmark, item_col, item_text_col, items_at_once):
        searcher = Searcher(block)
        words, grams = frequencies(source, searcher)
        searcher.keep_rarest(words)
        searcher.keep_seeds(grams)
        out = out.unionByName(found_in(source, searcher, kind))
    return out


def groups(texts: list[str | None]) -> list[tuple[int, int]]:
    """Consecutive texts that are taken apart together: ``CHARS`` characters, or one text."""
    return spans(np.array([len(t or "") + 1 for t in texts], np.int64), CHARS)


def frequencies(source: DataFrame, searcher: Searcher) -> tuple[np.ndarray, np.ndarray]:
    """How often the documents have each word and each n-gram of a block: at most one number for each reaches the driver."""
    shared = source.sparkSession.sparkContext.broadcast(searcher)
    sizes = len(searcher.numbers) + 1, len(searcher.grams)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory()
        s = shared.value
        counts = [np.zeros(size, np.int64) for size in sizes]
        for part in parts:
            texts = part.column(0).to_pylist()
            for a, b in groups(texts):
                numbers, first = s.numbered_all(texts[a:b])
                counts[0] += np.bincount(numbers, minlength=sizes[0])
                counts[1] += np.bincount(s.grams_of(numbers, first)[1], minlength=sizes[1])
        counts = np.concatenate(counts)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["entry", "times"])

    rows = source.select("text").mapInArrow(count, "entry bigint, times bigint").groupBy("entry").agg(F.sum("times").alias("times")).collect()
    shared.destroy()
    out = np.zeros(sum(sizes), np.int64)
    for r in rows:
        out[r.entry] = r.times
    return out[: sizes[0]], out[sizes[0] :]


def found_in(source: DataFrame, searcher: Searcher, kind: str) -> DataFrame:
    """Passages of the documents, joined to items by seed, and aligned.

    The passages are written first, so a task never needs two Python workers at a time, and the number of a row is fixed. The
    join is with a broadcast table, so the passages of a document mostly stay together up to the alignment; the best of
    a document whose passages were read by several tasks is taken at the end, over the few rows that are found.
    """
    spark = source.sparkSession
    shared = spark.sparkContext.broadcast(searcher)
    types = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
    names = ["row", "doc_id", "begin", "words", "seed", "item"]

    def take(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory()
        s = shared.value
        before = TaskContext.get().partitionId() << 40
        for part in parts:
            texts = part.column(1).to_pylist()
            for a, b in groups(texts):
                numbers, first, seeded, unseeded = s.passages(texts[a:b])
                every = np.concatenate((seeded, unseeded))
                order = np.argsort(every[:, 1], kind="stable")
                is_seed = (np.arange(len(every)) < len(seeded))[order]
                key, row, begin, end = every[order].T
                for x, y in spans(end - begin, WAITING):
                    offsets = np.cumsum(np.append(0, (end - begin)[x:y]))
                    values = np.concatenate([numbers[u:v] for u, v in zip(begin[x:y].tolist(), end[x:y].tolist(), strict=True)])
                    columns = [
                        pa.array(before + a + row[x:y]), part.column(0).take(pa.array(a + row[x:y])), pa.array(begin[x:y] - first[row[x:y]]),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())), pa.array(key[x:y], mask=~is_seed[x:y]), pa.array(key[x:y], mask=is_seed[x:y]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            before += part.num_rows

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory()
        s = shared.value
        ids: list[tuple] = []
        waiting: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        size, last = 0, None

        def done() -> pa.RecordBatch:
            rows = [(k, item, *values) for k, found in enumerate(best_of(s, waiting, len(ids))) for item, values in found.items()]
            best: dict[tuple[int, int], tuple] = {}  # long items are several here, with one id
            for k, item, *values in rows:
                best[k, s.ids[item]] = max(tuple(values), best.get((k, s.ids[item]), (0.0,)))
            cols = list(zip(*best.values(), strict=True)) or [[], [], [], []]
            columns = [pa.array([ids[k][0] for k, _ in best], pa.int64()), pa.array([ids[k][1] for k, _ in best], id_type), pa.array([i for _, i in best], pa.int64())]
            columns += [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "item_id", "score", "equal_words", "begin", "end"])

        for part in parts:
            id_type = part.schema.field("doc_id").type
            words = part.column(3)
            flat, offsets = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy()
            for n, (row, doc_id, begin, item) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                if row != last:
                    if size > WAITING:
                        yield done()
                        ids, size = [], 0
                        waiting.clear()
                    ids.append((row, doc_id))
                    last = row
                stretch = flat[offsets[n] : offsets[n + 1]].astype(np.int64)
                waiting.setdefault(item, {}).setdefault(len(ids) - 1, []).append((begin, stretch))
                size += len(stretch)
        if ids:
            yield done()

    id_kind = source.schema["doc_id"].dataType.simpleString()
    passages = source.mapInArrow(take, f"row bigint, doc_id {id_kind}, begin bigint, words array<int>, seed bigint, item bigint")
    seeds = small_table(spark, seed=searcher.seeds, seed_item=searcher.seed_items)
    joined = table(passages, "passages").join(F.broadcast(seeds), "seed", "left")
    scores = joined.select("row", "doc_id", "begin", "words", F.coalesce("item", "seed_item").alias("item")).mapInArrow(score, f"row bigint, {kind}")
    best = F.max(F.struct("score", "equal_words", "begin", "end")).alias("best")
    return scores.groupBy("row", "item_id").agg(F.first("doc_id").alias("doc_id"), best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 200_000) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark; all columns stay, rows with a null id too."""
    bad = table(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    return docs.join(F.broadcast(bad) if bad.count() <= small else bad, id_col, "left_anti").select(docs.columns)
