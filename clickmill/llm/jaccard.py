"""Near-duplicate groups by the Jaccard similarity of word n-gram sets: a prefix-filter join on Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import discard, one_memory, runs, ship, table, utf8
from .components import components
from .heavy import heavy_keys, join_unique

#: Counters of the frequency table, and those that travel as one row.
BUCKETS, BLOCK = 1 << 22, 1 << 16
#: Rows of a list, and of a family, that are compared in one piece.
LIST_PIECE, FAMILY_PIECE = 512, 256
#: Rows up to which a list of ids to look up is broadcast.
SMALL = 200_000


def shingle_frequencies(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Number of documents per hashed shingle: ``BUCKETS`` counters over all documents.

    Tasks send compressed blocks of counters, which are added up block by block in a stream; the driver gets
    ``BUCKETS`` counters (16 MB) whatever the input. Shingles that share a counter look more frequent than they
    are, which costs candidates but never loses one, since any order is right for prefix filtering.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory(S.seen_words)
        counts, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for part in parts:
            for text in utf8(part.column(0)):
                got = S.shingle_set(text, width)
                held.append((got % np.uint64(BUCKETS)).astype(np.int64))
                size += len(got)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield from blocks((k, counts[k * BLOCK : (k + 1) * BLOCK]) for k in range(BUCKETS // BLOCK))

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for k, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(packed), "<u4")
                sums[k] = sums[k] + got if k in sums else got.astype(np.int64)
        yield from blocks(sums.items())

    def blocks(items) -> Iterator[pa.RecordBatch]:
        for k, values in items:
            if values.any():
                packed = zlib.compress(np.minimum(values, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    total = np.zeros(BUCKETS, np.uint32)
    for row in docs.select(text_col).mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).collect():
        total[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(row.counts), "<u4")
    return total


def describe(docs: DataFrame, frequencies, width: int, percent: int) -> DataFrame:
    """Per row of ``docs(row, doc_id, text)``: set size, digest of the set, rare-first prefix and histogram."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory(S.seen_words)
        often = frequencies.value
        for part in parts:
            sizes, digests, prefixes, counts = [], [], [], []
            for text in utf8(part.column(2)):
                got = S.shingle_set(text, width)
                order = np.argsort(often[got % np.uint64(BUCKETS)], kind="stable")[: S.prefix_length(len(got), percent)]
                sizes.append(len(got))
                digests.append(S.set_digest(got))
                prefixes.append(got[order].view(np.int64))
                counts.append(S.histogram(got).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(counts, pa.binary())],
                names=["row", "doc_id", "n", "digest", "prefix", "counts"],
            )

    return docs.mapInArrow(rows, "row bigint, doc_id bigint, n bigint, digest binary, prefix array<bigint>, counts binary")


def one_per_set(described: DataFrame) -> DataFrame:
    """The rows of ``described`` with shingles, without those that repeat the set of an earlier row."""
    filled = described.where("n > 0")
    first = filled.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    twice = first.where("copies > 1").select("digest", F.col("row").alias("kept"))
    repeats = table(join_unique(filled.select("row", "digest"), twice, "digest").where("row <> kept").select("row"), "repeats")
    if repeats.count() <= SMALL:
        return filled.join(F.broadcast(repeats), "row", "left_anti")
    return table(filled.join(repeats, "row", "left_anti"), "classes")


def pieces(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """Each row once for every pair of pieces of its key that its own piece is part of.

    ``parts`` is the number of pieces of the row's key. Columns ``low`` and ``high`` name the pair, ``piece`` the row's own.
    """
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(F.lit(0).cast("bigint"))
    cut = rows.withColumn("parts", parts.cast("bigint")).withColumn("piece", own)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    cut = cut.withColumn("low", F.least("piece", "other")).withColumn("high", F.greatest("piece", "other")).drop("other", "parts")
    return cut.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high", "row")


def lists(sets: DataFrame, percent: int) -> DataFrame:
    """``(token, row, n, pos, parts)``: prefix shingles of at least two sets of similar size, with the pieces of their list.

    Frequent shingles, a bounded number, are counted apart, so that a window holds a small share of all rows at most; in all
    other lists those entries end here whose neighbours in order of size are too small or too large for a link.
    """
    posted = sets.select("row", F.posexplode("prefix").alias("pos", "token"), "n")
    posted = posted.select("token", "row", (F.shiftleft("n", 32) + F.col("pos")).alias("place"))
    heavy = table(heavy_keys(posted, "token"), "heavy")
    hot = posted.join(F.broadcast(heavy), "token", "left_semi")
    counted = F.broadcast(table(hot.groupBy("token").agg(F.count("*").alias("mates")), "hot"))
    often = posted.join(counted, "token")

    size = F.shiftright("place", 32)
    order = Window.partitionBy("token").orderBy("place", "row")
    rest = posted.join(F.broadcast(heavy), "token", "left_anti")
    rest = rest.withColumn("mates", F.count("*").over(Window.partitionBy("token"))).withColumn("before", F.lag("place").over(order)).withColumn("after", F.lead("place").over(order))
    near = (F.shiftright("before", 32) * 100 >= size * percent) | (size * 100 >= F.shiftright("after", 32) * percent)
    both = often.unionByName(rest.where(near).drop("before", "after"))
    return both.select("token", "row", size.alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), F.ceil(F.col("mates") / LIST_PIECE).alias("parts"))


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all rows which some list joins by pairs that pass the length, positional and
    suffix filters: a piece of a list sends fewer edges than it has rows, however many pairs pass."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(parts, ["token", "low", "high"]):
            row, n, pos, piece = (rows[c].to_numpy(zero_copy_only=False) for c in ("row", "n", "pos", "piece"))
            if len(row) < 2:
                continue
            i, j = pairs_of(n, piece, rows["low"][0].as_py() != rows["high"][0].as_py(), percent)
            i, j = (x[np.minimum(n[i] - pos[i], n[j] - pos[j]) >= S.needed(n[i], n[j], percent)] for x in (i, j))
            if not len(i):
                continue
            counts = [np.frombuffer(c, np.uint8) for c in rows["counts"].to_pylist()]
            keep = S.similar_histograms(counts, n, i, j, percent)
            edges = S.spanning(len(row), i[keep], j[keep])
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(row[b])], names=["a", "b"])

    return entries.mapInArrow(compare, "a bigint, b bigint").distinct()


def pairs_of(n: np.ndarray, piece: np.ndarray, across: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of similar size of a piece, or of one row of each of two pieces."""
    near = (np.minimum.outer(n, n) * 100 >= np.maximum.outer(n, n) * percent) & (np.not_equal.outer(piece, piece) if across else True)
    return np.nonzero(np.triu(near, 1))


def links_in_families(docs: DataFrame, sets: DataFrame, families: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between sets of one family, by their whole texts; connected pairs are not compared again.

    ``families(node, root)`` name the rows that candidates connect, so no link leaves a family. Each text is read by
    its id, checked by the digest of its set, and sent once per pair of pieces of its family.
    """
    sizes = families.groupBy("root").agg(F.ceil(F.count("*") / FAMILY_PIECE).alias("parts"))
    named = join_unique(families, sizes, "root").withColumnRenamed("node", "row")
    wanted = table(sets.select("row", "digest", F.col("doc_id").alias("wanted")).join(named, "row"), "wanted")
    short = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    texts = docs.join(short, docs["doc_id"].eqNullSafe(short["wanted"])).select("root", "row", "parts", "digest", "text")

    def load(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory(S.seen_words)
        for part in parts:
            got = [S.shingle_set(text, width) for text in utf8(part.column(4))]
            same = pa.array([S.set_digest(x) == d for x, d in zip(got, part.column(3).to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in got], pa.binary())], names=["root", "row", "parts", "hashes"])
            yield out.filter(same)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(parts, ["root", "low", "high"]):
            row, first = np.unique(rows["row"].to_numpy(zero_copy_only=False), return_index=True)
            packed = rows["hashes"].to_pylist()
            sets_ = [np.frombuffer(packed[k], np.uint64) for k in first]
            n = np.array([len(s) for s in sets_])
            i, j = pairs_of(n, rows["piece"].to_numpy(zero_copy_only=False)[first], rows["low"][0].as_py() != rows["high"][0].as_py(), percent)
            keep = S.similar_histograms([S.histogram(s) for s in sets_], n, i, j, percent) if len(i) else np.zeros(0, bool)
            edges = S.exact_links(sets_, i[keep], j[keep], percent)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(row[b])], names=["a", "b"])

    loaded = texts.mapInArrow(load, "root bigint, row bigint, parts bigint, hashes binary")
    return pieces(loaded, "root", F.col("parts")).mapInArrow(compare, "a bigint, b bigint")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """Connected groups of rows whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more.

    One row per row of ``docs``: ``doc_id``, ``n_shingles`` (size of the set) and ``component_id`` (the smallest id
    that links reach, itself included). A null or empty text, or one without words, has no shingles and no links; a null
    id takes part, but is nobody's component unless its whole group has none; rows that repeat an id are rows of
    their own; an empty table gives no rows. Other columns are not looked at.

    1. Document frequencies of all shingles, hashed into a table of fixed size, give the rare-first order.
    2. Of rows with the same set, one goes on.
    3. Two linked sets share a shingle among their first ``n - ceil(t n) + 1``; each set sends that prefix, and lists
       of shingles that no other set of similar size sends end there.
    4. Within each list, cut into pieces of bounded size, pairs that pass the length, positional and suffix (histogram)
       filters connect their rows. A piece answers with a spanning forest, so copies cost as many edges as there are rows.
    5. The families that these edges make are compared by their whole sets, piece by piece, once per pair of sets that is not
       yet connected. No link is skipped but between rows already connected, so components are exact.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequencies = spark.sparkContext.broadcast(shingle_frequencies(source, "text", width))
    numbered = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    described = table(describe(numbered, frequencies, width, percent), "sets")
    frequencies.destroy()

    sets = one_per_set(described)
    listed = table(lists(sets, percent), "lists")
    entries = pieces(listed.join(sets.select("row", "counts"), "row"), "token", F.col("parts"))
    families = components(candidates(entries, percent))
    roots = components(links_in_families(source, sets, families, width, percent))

    rows = described.select("row", "doc_id", "n", "digest")
    linked = rows.join(roots.withColumnRenamed("node", "row"), "row") if roots.count() > SMALL else rows.join(F.broadcast(roots.withColumnRenamed("node", "row")), "row")
    first = rows.groupBy("digest").agg(F.min("row").alias("first"))
    named = first.join(linked.select("digest", "root"), "digest", "left").select("digest", F.coalesce("root", "first").alias("root"))
    grouped = table(join_unique(rows, table(named, "roots"), "digest").select("doc_id", "n", "root"), "grouped")
    lowest = table(grouped.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    discard(described, listed)
    return join_unique(grouped, lowest, "root").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its near-duplicate group; all columns stay.

    Rows that repeat an id stand for one document: all of them go if one does. Rows with a null id stay.
    """
    groups = jaccard_groups(docs, id_col, text_col, width, percent)
    dropped = table(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= SMALL else dropped, id_col, "left_anti").select(docs.columns)
