"""Splits, filters and weights that turn a feature table into training data."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the original experiments.
VALIDATION_START = "2017-11-08 16:00:00"
V2_VALIDATION_START = "2017-11-09 04:00:00"
LAST_TEST_IP = 126413
TEST_HOURS = (4, 5, 9, 10, 13, 14)
FILTER_COLUMNS = ("click_time", "ip_for_filtering")


def seconds_of(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


def time_split(rows: DataFrame, start: str = VALIDATION_START, column: str = "click_s"):
    """(train, valid): clicks before ``start``, and from then on."""
    threshold = F.lit(seconds_of(start))
    return rows.where(F.col(column) < threshold), rows.where(F.col(column) >= threshold)


def only_test_ips(rows: DataFrame, last_ip: int = LAST_TEST_IP, column: str = "ip_for_filtering") -> DataFrame:
    return rows.where(F.col(column) <= last_ip)


def in_test_hours(rows: DataFrame, hours=TEST_HOURS) -> DataFrame:
    return rows.where(F.col("hour").isin(*hours))


def with_hour_weight(rows: DataFrame, weight: float = 1.0, hours=TEST_HOURS) -> DataFrame:
    value = F.when(F.col("hour").isin(*hours), F.lit(float(weight))).otherwise(F.lit(1.0))
    return rows.withColumn("weight", value)
