"""Bring values to rows by key without ever gathering a hot key in one task.

``chunk`` numbers blocks of consecutive rows. It is the salt of this library: a key that
holds a third of all rows still has at most ``chunk_rows`` of them in any one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmill.functions.clock import whole_div

CHUNK_ROWS = 1 << 20
# A table is broadcast by hint only when a count proves it to be at most this long.
BROADCAST_ROWS = 200_000


def chunk_of(row_id: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return whole_div(row_id, chunk_rows)


def with_chunk(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk`` unless the rows already carry it."""
    if "chunk" in df.columns:
        return df
    return df.withColumn("chunk", chunk_of(F.col("row_id"), chunk_rows))


def spread_lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join ``rows`` with ``table`` (one row per ``on``), however skewed ``on`` is.

    Every chunk asks for each of its keys once, so the join on ``on`` alone sees a hot key
    once per chunk; the answers then meet the rows on (chunk, on).
    """
    asked = rows.select("chunk", *on).distinct()
    answers = asked.join(table, on, "inner").repartition("chunk", *on)
    return rows.repartition("chunk", *on).join(answers, ["chunk", *on], how)


def small_or_spread_lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Broadcast ``table`` if a count proves it short, else ``spread_lookup``."""
    if is_short(table):
        return rows.join(F.broadcast(table), on, how)
    return spread_lookup(rows, table, on, how)


def is_short(table: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``table`` has at most ``limit`` rows; reads no more than it must to tell."""
    return table.limit(limit + 1).count() <= limit
