"""Two tokenizations of the same texts, aligned at the ends that both share, and how often ids are linked."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_memory, ship, spans, table
from .encode import Encoder, PieceEncoder

#: Bytes of texts that are aligned at once; links that are made at once.
BYTES_AT_ONCE, LINKS_AT_ONCE = 1 << 20, 1 << 21
#: Pairs of ids whose counts may be broadcast: those of more than one such part of all counts are fewer.
FREQUENT = 1 << 18


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, until_a: np.ndarray, until_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a and of b up to the end of each group: divide and conquer at the ends that both sides have.

    ``ends_a`` and ``ends_b`` rise strictly; text ``k`` ends behind ``until_a[k]`` and ``until_b[k]`` tokens. An interval between two
    shared ends is cut at a shared end near its middle token, and both halves go on; one without a shared end inside, or
    with one token on a side, is a group. All intervals of a level are searched together, in order.

    From the middle token on, b is bisected for the end of a, then a for the end of b found, in turns until they meet. If that is
    at the interval's end, the same goes backwards; what lies behind a cut found backwards has no shared end, and is a group.
    """
    a1, b1 = until_a, until_b
    a0, b0 = (np.concatenate(([0], x[:-1])) for x in (a1, b1))
    leaves = []
    while len(a0):
        whole = (a1 - a0 == 1) | (b1 - b0 == 1)
        leaves.append(np.stack((a1[whole], b1[whole])))
        a0, a1, b0, b1 = (x[~whole] for x in (a0, a1, b0, b1))
        middle = (a0 + a1) // 2
        i, j = meet_after(ends_a, ends_b, middle)
        late = np.flatnonzero(i >= a1)
        leaves.append(np.stack((a1[late], b1[late])))
        i[late], j[late] = meet_before(ends_a, ends_b, middle[late] - 1, a0[late], b0[late])
        # both halves of every interval, but no second half behind a late cut and no first one before the beginning
        a0, a1 = np.stack((a0, i), 1).ravel(), np.stack((i, a1), 1).ravel()
        b0, b1 = np.stack((b0, j), 1).ravel(), np.stack((j, b1), 1).ravel()
        open_ = a1 > a0
        open_[2 * late + 1] = False
        a0, a1, b0, b1 = (x[open_] for x in (a0, a1, b0, b1))
    ends = np.concatenate([np.empty((2, 0), np.int64), *leaves], axis=1)
    ends.sort(axis=1)  # both rise together
    return ends[0], ends[1]


def meet_after(ends_a: np.ndarray, ends_b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a and b up to the first shared end behind ``start`` tokens of a or more."""
    i, j = start.copy(), np.empty_like(start)
    active = np.arange(len(start))
    while len(active):
        x = ends_a[i[active] - 1]
        at = np.searchsorted(ends_b, x)
        j[active] = at + 1
        y = ends_b[at]
        missed = y != x
        active = active[missed]
        i[active] = np.searchsorted(ends_a, y[missed]) + 1
    return i, j


def meet_before(ends_a: np.ndarray, ends_b: np.ndarray, start: np.ndarray, least_a: np.ndarray, least_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a and b up to the last shared end behind ``start`` tokens of a or fewer; the least ones share an end."""
    i, j = np.maximum(start, least_a), least_b.copy()
    active = np.flatnonzero(i > least_a)
    while len(active):
        x = ends_a[i[active] - 1]
        at = np.maximum(np.searchsorted(ends_b, x, "right"), least_b[active])
        j[active] = at
        y = np.where(at > least_b[active], ends_b[np.maximum(at, 1) - 1], -1)
        missed = y != x
        active, y = active[missed], y[missed]
        i[active] = np.maximum(np.searchsorted(ends_a, y, "right"), least_a[active])
        j[active[i[active] == least_a[active]]] = least_b[active[i[active] == least_a[active]]]
        active = active[i[active] > least_a[active]]
    return i, j


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_file: str, b_file: str) -> None:
        self.a, self.b = Encoder(a_file, special=False), PieceEncoder(b_file)
        byte_of = {c: b for b, c in self.a.alphabet.items()}
        size = self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.a_tokens = Spelling([bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names])
        self.b_tokens = Spelling([bytes([int(p[3:5], 16)]) if self.b.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(self.b.pieces)])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides; none if a side's tokens do not spell a space and the text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        a = np.frombuffer(self.a.encode(" " + text), self.a.kind).astype(np.int64)
        b = np.frombuffer(self.b.encode(text), self.b.kind).astype(np.int64)
        want = np.frombuffer((" " + text).encode("utf-8", "surrogatepass"), np.uint8)
        return (a, b) if self.a_tokens.spell(a, want) and self.b_tokens.spell(b, want) else (none, none)


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a_file: str, b_file: str) -> Pair:
    """The tokenizers of two files, made once per worker and given up when its tasks turn to another operator."""
    one_memory(_pairs)
    if (a_file, b_file) not in _pairs:
        _pairs[a_file, b_file] = Pair(a_file, b_file)
    return _pairs[a_file, b_file]


class Spelling:
    """The bytes of every token of a vocabulary, one after the other."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray, text: np.ndarray) -> bool:
        sizes = self.sizes[ids]
        return int(sizes.sum()) == len(text) and bool(np.array_equal(self.bytes[repeats(self.first[ids], sizes)], text))


def align_tokens(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of both tokenizers for every row of ``docs``, and the groups between the ends that they share.

    ``a_file`` is a byte-level BPE file, which encodes a space and the text; ``b_file`` a sentencepiece model, which adds that
    space. Columns: ``row``, ``doc_id``, ``a`` and ``b`` (ids), ``a_sizes`` and ``b_sizes`` (tokens of each group, in order).
    A text that is null or empty, or that a side's tokens do not spell, has no tokens and no groups. Names of special
    tokens are plain text. A null id stays null; rows that repeat an id are rows of their own; other columns are not
    looked at; an empty table gives no rows. One pass over the texts, no shuffle.
    """
    ship(docs.sparkSession)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_file, b_file)
        for part in parts:
            sizes = pc.fill_null(pc.binary_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
            for begin, end in spans(sizes, BYTES_AT_ONCE):
                rows = part.slice(begin, end - begin)
                yield aligned(pair, rows)

    schema = f"row bigint, doc_id {kind}, a array<int>, b array<int>, a_sizes array<int>, b_sizes array<int>"
    return source.mapInArrow(align, schema)


def aligned(pair: Pair, rows: pa.RecordBatch) -> pa.RecordBatch:
    """``rows(row, doc_id, text)`` with the lists of :func:`align_tokens`."""
    g = grouped(pair, rows.column(2).to_pylist())
    count_a, count_b = (x[g.rows] for x in (g.from_a, g.from_b))
    lists = [(count_a, g.a), (count_b, g.b), (g.rows, np.diff(g.from_a)), (g.rows, np.diff(g.from_b))]
    arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())) for offsets, values in lists]
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *arrays], names=["row", "doc_id", "a", "b", "a_sizes", "b_sizes"])


@dataclass
class Groups:
    """Aligned rows of a batch, flat: ids of both sides, where groups begin in them, and where rows begin in groups."""

    a: np.ndarray
    b: np.ndarray
    from_a: np.ndarray
    from_b: np.ndarray
    rows: np.ndarray

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per group over the groups of each row."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.rows[1:]] - total[self.rows[:-1]]


def grouped(pair: Pair, texts: list[str | None]) -> Groups:
    ids = [pair.encode(text) for text in texts]
    a, b = (np.concatenate([x[side] for x in ids]) for side in (0, 1))
    ends_a, ends_b = np.cumsum(pair.a_tokens.sizes[a]), np.cumsum(pair.b_tokens.sizes[b])
    count_a, count_b = (np.cumsum([0, *(len(x[side]) for x in ids)]) for side in (0, 1))
    filled = np.flatnonzero(np.diff(count_a)) + 1
    until_a, until_b = shared_groups(ends_a, ends_b, count_a[filled], count_b[filled])
    from_a, from_b = (np.concatenate(([0], x)) for x in (until_a, until_b))
    return Groups(a, b, from_a, from_b, np.searchsorted(from_a, count_a))  # every text ends a group


def repeats(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, …``, ``count[i]`` numbers for each i, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def links(groups: Groups, vocabulary_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, pair, times)``: each linked pair ``a * 2^32 + b`` of a row once, with the number of its links there.

    Rows of few links are done together. In a row of many, equal ids of a group count once with their number, and its
    pairs come in ranges of the id of a; one id meets each id of a group at most once, so memory follows the row's length.
    """
    n_a, n_b = np.diff(groups.from_a), np.diff(groups.from_b)
    each = groups.per_row(n_a * n_b)
    start = groups.rows
    for begin, end in spans(each, LINKS_AT_ONCE):
        g = np.arange(start[begin], start[end])
        if each[begin:end].sum() <= LINKS_AT_ONCE:
            row = np.repeat(np.arange(begin, end), each[begin:end])
            per_a = np.repeat(n_b[g], n_a[g])
            i = np.repeat(np.arange(groups.from_a[start[begin]], groups.from_a[start[end]]), per_a)
            j = repeats(np.repeat(groups.from_b[g], n_a[g]), per_a)
            # row, a and b fit into one number: rows of a span are few
            vocabulary_a = int(groups.a.max(initial=0)) + 1
            keys, times = np.unique(((row - begin) * vocabulary_a + groups.a[i]) * vocabulary_b + groups.b[j], return_counts=True)
            row, pair = np.divmod(keys, vocabulary_a * vocabulary_b)
            yield row + begin, (pair // vocabulary_b << 32) + pair % vocabulary_b, times.astype(np.int64)
        else:
            yield from links_of_long(groups, begin, g, n_a[g], n_b[g])


def links_of_long(groups: Groups, row: int, g: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    a = groups.a[groups.from_a[g[0]] : groups.from_a[g[-1] + 1]]
    b = groups.b[groups.from_b[g[0]] : groups.from_b[g[-1] + 1]]
    own = np.arange(len(g))
    key_a, times_a = counted(a * len(g) + np.repeat(own, n_a), np.ones(len(a), np.int64))
    key_b, times_b = counted(np.repeat(own, n_b) << 32 | b, np.ones(len(b), np.int64))
    id_a, group_a = np.divmod(key_a, len(g))
    first_b = np.searchsorted(key_b >> 32, own)
    count_b = np.diff(np.append(first_b, len(key_b)))
    new = np.flatnonzero(np.concatenate(([True], id_a[1:] != id_a[:-1])))
    made = np.add.reduceat(count_b[group_a], new)
    until = np.append(new, len(id_a))
    for x, y in spans(made, LINKS_AT_ONCE):
        entries = np.arange(until[x], until[y])
        met = count_b[group_a[entries]]
        i, j = np.repeat(entries, met), repeats(first_b[group_a[entries]], met)
        pair, times = counted((id_a[i] << 32) + (key_b[j] & 0xFFFFFFFF), times_a[i] * times_b[j])
        yield np.full(len(pair), row), pair, times


def written_groups(groups: Groups, a_names: np.ndarray, b_names: np.ndarray) -> list[bytes]:
    """Each row's groups as ``a1,a2|b1;a3|b2,b3``; names end with the sign that follows: three names per id."""
    n_a, n_b = np.diff(groups.from_a), np.diff(groups.from_b)
    a_key, b_key = groups.a * 3, groups.b * 3
    a_key[groups.from_a[1:] - 1] += 1
    b_key[groups.from_b[1:] - 1] += 2
    parts = np.empty(len(a_key) + len(b_key), object)
    parts[np.arange(len(a_key)) + np.repeat(groups.from_b[:-1], n_a)] = a_names[a_key]
    parts[np.arange(len(b_key)) + np.repeat(groups.from_a[1:], n_b)] = b_names[b_key]
    cuts = (groups.from_a + groups.from_b)[groups.rows].tolist()
    return [b"".join(parts[x:y].tolist())[:-1] for x, y in zip(cuts, cuts[1:], strict=False)]


def signed(size: int) -> np.ndarray:
    """The decimal names of ids, each followed by one of the signs that may come next."""
    out = np.empty(3 * size, object)
    out[:] = [b"%d%s" % (i, sign) for i in range(size) for sign in (b",", b"|", b";")]
    return out


def linked(docs: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of :func:`link_report` as far as a text alone tells, with ``pairs`` (each once) and ``times`` (its links).

    Further rows, with null in the other columns, go on with the pairs of a text that has very many.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))

    def link(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_file, b_file)
        size_b = len(pair.b_tokens.sizes)
        a_names, b_names = signed(len(pair.a_tokens.sizes)), signed(size_b)
        for part in parts:
            sizes = pc.fill_null(pc.binary_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
            for begin, end in spans(sizes, BYTES_AT_ONCE):
                rows = part.slice(begin, end - begin)
                g = grouped(pair, rows.column(2).to_pylist())
                n_a, n_b = np.diff(g.from_a), np.diff(g.from_b)
                values = [g.per_row(n_a), g.per_row(n_b), np.diff(g.rows), g.per_row(n_a * n_b)]
                digests = [hashlib.sha256(x).hexdigest() if x else "" for x in written_groups(g, a_names, b_names)]
                names = ["row", "doc_id", *numbers, "groups_sha256", "pairs", "times"]
                done = np.zeros(len(rows), bool)
                for row, pairs, times in links(g, size_b):
                    # rows of these links, and how many each has
                    at, first = np.unique(row, return_index=True)
                    new = ~done[at]
                    done[at] = True
                    mask = pa.array(~new)
                    offsets = np.append(first, len(row))
                    blank = lambda x, mask=mask: pc.if_else(mask, pa.scalar(None, x.type), x)
                    own = [blank(rows.column(1).take(pa.array(at))), *(blank(pa.array(v[at], pa.int64())) for v in values), blank(pa.array([digests[k] for k in at.tolist()], pa.string()))]
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), *own, lists(pairs, offsets), lists(times, offsets)], names=names)
                at = np.flatnonzero(~done)  # no tokens
                own = [rows.column(k).take(pa.array(at)) for k in (0, 1)]
                zeros = lists(np.empty(0, np.int64), np.zeros(len(at) + 1, np.int64))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v[at], pa.int64()) for v in values), pa.array([digests[k] for k in at.tolist()], pa.string()), zeros, zeros], names=names)

    schema = f"row bigint, doc_id {kind}, " + ", ".join(f"{c} bigint" for c in numbers) + ", groups_sha256 string, pairs array<bigint>, times array<bigint>"
    return source.mapInArrow(link, schema)


@dataclass
class Known:
    """What tasks know of the counts: the highest one of each id of a, and those of frequent pairs."""

    best: np.ndarray
    pairs: np.ndarray
    docs: np.ndarray


def known_counts(counts: DataFrame, vocabulary_a: int) -> tuple[Known, DataFrame]:
    """:class:`Known`, bounded by the vocabulary and by ``FREQUENT``, and ``(pair, docs)`` of all other pairs."""
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most")).toArrow()
    best = np.zeros(vocabulary_a, np.int64)
    best[most["a"].to_numpy()] = most["most"].to_numpy()
    total = counts.agg(F.sum("docs")).first()[0] or 0
    often = counts.where(F.col("docs") * FREQUENT > total).toArrow()
    order = np.argsort(often["pair"].to_numpy())
    return Known(best, often["pair"].to_numpy()[order], often["docs"].to_numpy()[order]), counts.where(F.col("docs") * FREQUENT <= total)


def score_links(rows: DataFrame, known: Known) -> DataFrame:
    """Written: ``(row, n_best, count_sum, pair, times)``, one row per row of :func:`linked` for its frequent pairs, without ``pair``
    and ``times``, and one per other pair, without the sums."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = shared.value
        names = ["row", "n_best", "count_sum", "pair", "times"]
        for part in parts:
            for begin, end in spans(pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False), LINKS_AT_ONCE):
                some = part.slice(begin, end - begin)
                pair, times = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
                number = some.column(0).to_numpy()
                owner = np.repeat(np.arange(len(some)), some.column(1).value_lengths().to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(k.pairs, pair), max(0, len(k.pairs) - 1))
                found = k.pairs[at] == pair if len(k.pairs) else np.zeros(len(pair), bool)
                docs, often = k.docs[at[found]], times[found]
                n_best, count_sum = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
                np.add.at(count_sum, owner[found], docs * often)
                np.add.at(n_best, owner[found], np.where(docs == k.best[pair[found] >> 32], often, 0))
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n_best), pa.array(count_sum), none, none], names=names)
                if not found.all():
                    none = pa.nulls(int((~found).sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(number[owner[~found]]), none, none, pa.array(pair[~found]), pa.array(times[~found])], names=names)

    out = table(rows.select("row", "pairs", "times").mapInArrow(score, "row bigint, n_best bigint, count_sum bigint, pair bigint, times bigint"), "scored")
    shared.destroy()
    return out


def link_report(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` the numbers of its alignment and of its links by their counts over all rows.

    Columns: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (pairs of tokens that share a group), ``n_best`` (links whose
    count is the highest of their id of a), ``count_sum`` (counts of all links) and ``groups_sha256``. Rows without tokens
    (see :func:`align_tokens`) have zeros and an empty digest. A count is the number of rows that hold a pair of ids linked.

    Counts of frequent pairs, of which there are fewer than ``FREQUENT`` at any size of the input, go to the tasks; links of
    other pairs, each with a bounded share of all, are joined with their counts by a shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = table(linked(docs, a_file, b_file, id_col, text_col), "linked")
    counts = table(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "counts")
    known, others = known_counts(counts, len(pair_of(a_file, b_file).a_tokens.sizes))
    scored = score_links(rows, known)
    most = spark.createDataFrame(list(enumerate(known.best.tolist())), "a int, most bigint")
    rest = scored.where("pair is not null").select("row", "pair", "times").join(others, "pair").join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a"))
    rest = rest.select("row", F.when(F.col("docs") == F.col("most"), F.col("times")).otherwise(0).alias("n_best"), (F.col("docs") * F.col("times")).alias("count_sum"))
    sums = scored.where("pair is null").select("row", "n_best", "count_sum").unionByName(rest)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = rows.where("groups_sha256 is not null").drop("pairs", "times").join(sums, "row")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
