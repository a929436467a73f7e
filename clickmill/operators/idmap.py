"""Mapping of supplement click ids to submission click ids, and lookups through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmill.functions.keys import KEYS
from clickmill.operators.lookup import CHUNK_ROWS, chunk_of, spread_lookup, with_chunk

MATCH = [*KEYS, "click_s"]


def click_id_mapping(old_test: DataFrame, test: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(old_click_id, new_click_id): for each new id the last old click equal on keys and time, in order of the old ids.

    Old clicks are reduced to their last one per key before the join, so copies never multiply.
    """
    last = old_test.groupBy(*MATCH).agg(F.max_by("click_id", "row_id").alias("old_click_id"))
    new = with_chunk(test, chunk_rows).select("chunk", *MATCH, F.col("click_id").alias("new_click_id"))
    return spread_lookup(new, last, MATCH, "inner").select("old_click_id", "new_click_id").orderBy("old_click_id", "new_click_id")


def needed_clicks(test: DataFrame, mapping: DataFrame) -> DataFrame:
    """Test rows whose click id occurs in the mapping."""
    ids = mapping.select(F.col("old_click_id").alias("click_id")).distinct()
    return test.join(ids, "click_id", "left_semi")


def mapped_predictions(mapping: DataFrame, predictions: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Predictions (one row per old click id) under their new ids; unmatched ids are left out."""
    asked = mapping.withColumn("chunk", chunk_of(F.col("new_click_id"), chunk_rows))
    table = predictions.withColumnRenamed("click_id", "old_click_id")
    found = spread_lookup(asked, table, ["old_click_id"], "inner")
    return found.drop("chunk", "old_click_id").withColumnRenamed("new_click_id", "click_id")
