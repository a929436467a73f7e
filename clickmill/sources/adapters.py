"""Click logs shaped from the general test tables ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmill.functions.clock import epoch_seconds
from clickmill.operators.ranks import number_rows
from clickmill.session import scratch_path, tune
from clickmill.sources.clicks import CLICK_COLUMNS, read_clicks, write_table

# Fixed values of the fixtures: event types as app ids, and where train ends.
APPS = {"click": 10, "view": 11, "signup": 12, "error": 13}
OTHER_APP = 14
EVENTS_TRAIN_END = 1706054400  # 2024-01-24
LINEITEM_TRAIN_END = 978307200  # 2001-01-01

_prepared: dict[tuple[str, str], str] = {}


def event_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with unique times over 30 days; ``event_id`` already numbers them in time order."""
    tune(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    app = F.lit(OTHER_APP)
    for name, number in APPS.items():
        app = F.when(F.col("event_type") == name, number).otherwise(app)
    base = events.select("event_id", "user_id", "value", app.alias("app"), k.alias("k"), epoch_seconds(F.col("ts")).alias("t"))
    is_train = F.col("t") < EVENTS_TRAIN_END
    positive = is_train & (F.col("value") > 100)
    return base.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("int").alias("ip"),
        "app",
        (F.col("k") % 2).alias("device"),
        (F.floor(F.col("k") / 2) % 3).cast("int").alias("os"),
        F.floor(F.col("k") / 10).cast("int").alias("channel"),
        F.col("t").alias("click_s"),
        F.when(positive, 1).otherwise(0).alias("is_attributed"),
        F.when(positive, F.col("t") + F.floor(F.col("value") * 10)).alias("attributed_s"),
        is_train.alias("is_train"),
    )


def lineitem_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with very many equal times, prepared once per session as a parquet table."""
    tune(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _prepared:
        path = scratch_path(spark, "lineitem-clicks")
        _prepared[key] = write_table(_number_lineitem(spark, sf_dir), path)
    return read_clicks(spark, _prepared[key])


def _number_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [
        "t", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("t", epoch_seconds(F.col("l_shipdate")))
    numbered = number_rows(lines.select(*order), order)
    is_train = F.col("t") < LINEITEM_TRAIN_END
    positive = is_train & (F.col("l_quantity") >= 41)
    return numbered.select(
        "row_id",
        F.col("l_suppkey").cast("int").alias("ip"),
        F.col("l_linenumber").cast("int").alias("app"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("device"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("os"),
        F.round(F.col("l_discount") * 100).cast("int").alias("channel"),
        F.col("t").alias("click_s"),
        F.when(positive, 1).otherwise(0).alias("is_attributed"),
        F.when(positive, F.col("t") + F.round("l_extendedprice").cast("bigint") % 90000).alias("attributed_s"),
        is_train.alias("is_train"),
    ).select(*CLICK_COLUMNS)
