"""Frequent keys by Misra-Gries, and joins that keep them out of the shuffle.

With k counters per task, a key's summed estimate is at least its frequency less n / (k + 1), for n rows
in all. Keys whose estimate exceeds n / (k + 1) are kept: there are at most k of them, whatever the data,
and every key with more than 2 n / (k + 1) rows is among them. So a table of heavy keys may be broadcast
at any size of the input, and no other key holds more than 2 / (k + 1) of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

#: Counters of a summary, and so the most rows of a broadcast table of heavy keys.
COUNTERS = 1024


def summarise(counts: dict, more: list[tuple], counters: int) -> dict:
    """Add counted keys to a summary; if too many remain, lower all by the largest count that must go."""
    for key, n in more:
        counts[key] = counts.get(key, 0) + n
    if len(counts) > counters:
        cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - counters - 1)[len(counts) - counters - 1])
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def heavy_keys(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` values of ``key``, those of more than 2 / (counters + 1) of the rows among them.

    Null is no key. The result is a written table with the one column ``key``.
    """
    ship(rows.sparkSession)
    keys = rows.select(F.col(key)).where(F.col(key).isNotNull())
    kind = keys.schema[key].dataType.simpleString()

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for part in parts:
            seen = pc.value_counts(part.column(0))
            counts = summarise(counts, list(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True)), counters)
        names = pa.array(list(counts), part.schema.field(0).type) if counts else None
        if counts:
            yield pa.RecordBatch.from_arrays([names, pa.array(list(counts.values()), pa.int64())], names=[key, "estimate"])

    summaries = keys.mapInArrow(local, f"`{key}` {kind}, estimate bigint")
    estimates = table(summaries.groupBy(key).agg(F.sum("estimate").alias("estimate")), "estimates")
    total = keys.count()
    return estimates.where(F.col("estimate") * (counters + 1) > total).select(key)


def join_unique(rows: DataFrame, right: DataFrame, key: str, counters: int = COUNTERS, small: int = 200_000) -> DataFrame:
    """Left join of ``rows`` with ``right``, which has one row per value of ``key``.

    A right side of at most ``small`` rows, counted here, is broadcast. Beyond that, the right rows of heavy keys
    (a bounded number) are broadcast and all others are shuffled; the result is the same.
    """
    if right.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(right), key, "left")
    heavy = heavy_keys(rows, key, counters)
    hot = table(right.join(F.broadcast(heavy), key, "left_semi"), "hot")
    marked = F.broadcast(hot.select(key))
    often = rows.join(F.broadcast(hot), key, "inner")
    others = rows.join(marked, key, "left_anti").join(right, key, "left")
    return often.unionByName(others.select(often.columns))
