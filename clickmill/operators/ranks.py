"""Running totals and ranks over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickmill.session import cut_lineage

BUCKETS = 1024


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows ahead in ``order``.

    For short summary tables only (one row per file, range or bucket): one task sees them all.
    """
    ahead = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(ahead), F.lit(0)))


def number_rows(df: DataFrame, order: list, out: str = "row_id") -> DataFrame:
    """Dense zero-based numbers in the order of ``order``.

    Rows are range-partitioned on the whole order, each range is numbered by itself and shifted
    by the size of the ranges ahead. The ranges are written to the checkpoint folder first:
    their numbers are only meaningful together with one fixed division into ranges.
    """
    ranges = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = running_total(ranges.groupBy("_range").agg(F.count("*").alias("_n")), "_range", "_n", "_ahead")
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("bigint") - 1
    return (
        ranges.withColumn("_local", local)
        .join(F.broadcast(sizes.select("_range", "_ahead")), "_range")
        .withColumn(out, F.col("_ahead") + F.col("_local"))
        .drop("_range", "_local", "_ahead")
    )


def _score_buckets(frequencies: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``, a monotone division of the distinct values into even parts."""
    steps = [i / buckets for i in range(1, buckets)]
    edges = frequencies.agg(F.percentile_approx(value, steps, 10 * buckets).alias("e")).first()["e"] or []
    splits = [float("-inf"), *(sorted(set(edges)) or [0.0]), float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(frequencies)


def _counted(df: DataFrame, value: str, by: list[str], sums: dict, buckets: int) -> DataFrame:
    """One row per (by, value) with ``sums`` and, for each, ``_ahead_`` its total over smaller values."""
    frequencies = df.groupBy(*by, F.col(value).cast("double").alias("_value")).agg(
        *[F.sum(expr).alias(name) for name, expr in sums.items()]
    )
    frequencies = cut_lineage(frequencies)
    bucketed = _score_buckets(frequencies, "_value", buckets)
    totals = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(f"_b_{n}") for n in sums])
    over_buckets = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_b_{n}").over(over_buckets), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ahead = {
        f"_ahead_{n}": F.col(f"_off_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums
    }
    return bucketed.join(totals.repartition(*by, "_bucket"), [*by, "_bucket"]).withColumns(ahead)


def tied_ranks(df: DataFrame, value: str, by: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Ascending rank of each distinct ``value`` (per ``by``), ties sharing their average rank."""
    by = by or []
    counted = _counted(df, value, by, {"_n": F.lit(1)}, buckets)
    rank = F.col("_ahead__n") + (F.col("_n") + 1) / F.lit(2.0)
    return counted.select(*by, F.col("_value").alias(value), rank.alias("rank"), "_n")


def exact_auc(
    df: DataFrame, score: str, label: str, by: list[str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Area under the ROC curve per ``by``; a tie counts half. Null without both classes."""
    by = by or []
    sums = {"_pos": F.col(label).cast("bigint"), "_neg": 1 - F.col(label).cast("bigint")}
    counted = _counted(df, score, by, sums, buckets)
    won = F.col("_pos") * (F.col("_ahead__neg") + F.col("_neg") / F.lit(2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return counted.groupBy(*by).agg((F.sum(won) / F.nullif(pairs, F.lit(0.0))).alias("auc"))
