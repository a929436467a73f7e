"""From per-bag predictions to one score per click."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmill.operators.lookup import CHUNK_ROWS, chunk_of, spread_lookup
from clickmill.operators.ranks import tied_ranks


def mean_prediction(predictions: DataFrame) -> DataFrame:
    """Mean over bags of (bag, click_id, prediction)."""
    return predictions.groupBy("click_id").agg(F.avg("prediction").alias("is_attributed"))


def rank_average(predictions: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean over bags of the tie-averaged rank, divided by the number of clicks."""
    ranks = tied_ranks(predictions, "prediction", ["bag"]).drop("_n")
    asked = predictions.withColumn("prediction", F.col("prediction").cast("double")).withColumn(
        "chunk", chunk_of(F.col("click_id"), chunk_rows)
    )
    ranked = spread_lookup(asked, ranks, ["bag", "prediction"])
    per_click = ranked.groupBy("click_id").agg(F.avg("rank").alias("_rank"))
    size = predictions.select("click_id").distinct().count()
    return per_click.select("click_id", (F.col("_rank") / F.lit(size)).alias("is_attributed"))
