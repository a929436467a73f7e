"""Exact duplicates of whole texts: frequent digests apart from the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .heavy import COUNTERS, heavy_keys


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Texts are equal when identical; null counts as empty. Of a group, the row with the largest id stays; a null id
    is smaller than any other, and of rows that repeat the largest id the last read stays, so that exactly one row of
    each group is kept. An empty table gives no rows; other columns are not looked at. Columns: ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256`` (lowercase hex).

    Misra-Gries finds the digests that may be frequent, one pass counts them exactly and picks their winners (both
    combine before the shuffle), and the winners, at most ``counters`` rows, are broadcast: rows of frequent digests
    never move. The remaining digests, each a small share of all rows, are grouped and joined by ordinary shuffles of
    48-byte rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digests = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = table(digests.withColumn("row", F.monotonically_increasing_id()), "digests")

    best = F.max(F.struct("doc_id", "row")).alias("best")
    heavy = heavy_keys(rows, "digest", counters)
    candidates = rows.join(F.broadcast(heavy), "digest", "left_semi")
    winners = table(candidates.groupBy("digest").agg(best, F.count("*").alias("group_size")), "winners")

    often = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(best, F.count("*").alias("group_size"))
    return often.unionByName(rest.join(groups, "digest").select(often.columns)).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
