"""Feature tables on disk, their assembly, the submission file and the result log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FeatureStore:
    """Parquet feature tables keyed by feature name, inputs and seed; finished ones are reused."""

    def __init__(self, spark: SparkSession, root: str, inputs: Iterable[str], seed: int = 0):
        self.spark = spark
        digest = hashlib.md5(json.dumps(list(inputs)).encode()).hexdigest()[:10]
        self.base = f"{root.rstrip('/')}/inputs={digest}/seed={seed}"

    def path(self, name: str) -> str:
        return f"{self.base}/feature={name}"

    def finished(self, name: str) -> bool:
        """Whether a table was written to its end; the marker is written after the table."""
        try:
            return self.spark.read.parquet(f"{self.path(name)}.done").count() > 0
        except AnalysisException:
            return False

    def get(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        if not self.finished(name):
            compute().write.mode("overwrite").parquet(self.path(name))
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.path(name)}.done")
        return self.spark.read.parquet(self.path(name))


def assemble(tables: list[DataFrame], check: bool = True) -> DataFrame:
    """Join feature tables on ``row_id``; all must hold exactly the same rows."""
    joined = tables[0]
    for table in tables[1:]:
        joined = joined.join(table, "row_id", "inner")
    if check:
        counts = [table.count() for table in tables]
        if len(set([*counts, joined.count()])) > 1:
            raise ValueError(f"feature tables do not share one set of rows: {counts}")
    return joined


def write_submission(scores: DataFrame, path: str) -> str:
    """``click_id,is_attributed`` as CSV, sorted by click id across the part files."""
    ordered = scores.select("click_id", "is_attributed").orderBy("click_id")
    ordered.write.mode("overwrite").option("header", True).csv(path)
    return path


def bag_summary(trials: DataFrame) -> DataFrame:
    """Means and population deviations over the bags, as one row."""
    return trials.agg(
        F.avg("train_auc").alias("average_train_auc"),
        F.avg("valid_auc").alias("average_valid_auc"),
        F.stddev_pop("train_auc").alias("train_auc_std"),
        F.stddev_pop("valid_auc").alias("valid_auc_std"),
        F.avg("train_time").alias("average_train_time"),
    )


def result_log(trials: list[dict], summary: dict, config: dict) -> str:
    return json.dumps({"training": {"trials": trials, **summary}, "config": config}, indent=2)


def write_result_log(spark: SparkSession, text: str, path: str) -> str:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
