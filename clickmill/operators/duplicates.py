"""Distance of repeated clicks to the start of their run of consecutive copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickmill.functions.keys import KEYS
from clickmill.operators.frames import Total, add_needs, hidden
from clickmill.operators.lookup import CHUNK_ROWS, with_chunk

START = Window.unboundedPreceding
COPY_KEYS = ["is_train", *KEYS, "click_s"]


def add_duplicate_row_index_diff(clicks: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``DuplicateRowIndexDiff``: row distance to the start of the run, NaN if there is no copy.

    A row is a copy if its table (train or test) holds another with the same five keys and time.
    Runs are made of copies adjacent in ``row_id`` order once all other rows are left out.
    They are found within each chunk; a run that goes on from an earlier chunk takes its start
    from a summary with one row per table and chunk.
    """
    source = with_chunk(clicks, chunk_rows)
    rows = source.repartition("chunk")
    counted = add_needs(rows, "copies", COPY_KEYS, [Total()], "cells", source)
    copies = counted.where(F.col(hidden(Total(), "copies")) > 1).withColumn("_key", F.struct(*KEYS, "click_s"))

    in_chunk = Window.partitionBy("chunk", "is_train").orderBy("row_id")
    so_far = in_chunk.rowsBetween(START, 0)
    before = F.lag("_key").over(in_chunk)
    marked = copies.withColumn("_start", F.when(before != F.col("_key"), F.col("row_id"))).withColumn(
        "_local", F.last("_start", ignorenulls=True).over(so_far)
    )
    summary = marked.groupBy("is_train", "chunk").agg(
        F.min("row_id").alias("_first"),
        F.min_by("_key", "row_id").alias("_first_key"),
        F.max_by("_key", "row_id").alias("_last_key"),
        F.max("_start").alias("_last_start"),
    )
    over_chunks = Window.partitionBy("is_train").orderBy("chunk")
    entered = summary.withColumn(
        "_opens", ~F.coalesce(F.lag("_last_key").over(over_chunks) == F.col("_first_key"), F.lit(False))
    ).withColumn("_leaves", F.coalesce("_last_start", F.when(F.col("_opens"), F.col("_first"))))
    carried = F.last("_leaves", ignorenulls=True).over(over_chunks.rowsBetween(START, -1))
    entered = entered.select(
        "is_train", "chunk", F.when(F.col("_opens"), F.col("_first")).otherwise(carried).alias("_entry")
    )
    diffs = marked.join(entered.repartition("chunk"), ["is_train", "chunk"]).select(
        "chunk",
        "row_id",
        (F.col("row_id") - F.coalesce("_local", "_entry")).cast("double").alias("DuplicateRowIndexDiff"),
    )
    out = rows.join(diffs, ["chunk", "row_id"], "left")
    return out.select(
        *clicks.columns, F.coalesce("DuplicateRowIndexDiff", F.lit(float("nan"))).alias("DuplicateRowIndexDiff")
    )
