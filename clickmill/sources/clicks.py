"""The click table: schema, scans, stacking of train and test.

Common columns: ``row_id`` BIGINT, the five keys INT, ``click_s`` BIGINT epoch seconds,
``is_attributed`` INT, ``attributed_s`` BIGINT or null, ``is_train`` BOOLEAN. ``row_id`` is the
position in the log; clicks are ordered by (click_s, row_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickmill.functions.clock import epoch_seconds
from clickmill.functions.keys import KEYS
from clickmill.operators.ranks import running_total

CLICK_COLUMNS = ("row_id", *KEYS, "click_s", "is_attributed", "attributed_s", "is_train")

_KEY_FIELDS = [T.StructField(key, T.IntegerType()) for key in KEYS]
TRAIN_SCHEMA = T.StructType(
    [
        *_KEY_FIELDS,
        T.StructField("click_time", T.TimestampNTZType()),
        T.StructField("attributed_time", T.TimestampNTZType()),
        T.StructField("is_attributed", T.IntegerType()),
    ]
)
TEST_SCHEMA = T.StructType(
    [
        T.StructField("click_id", T.LongType()),
        *_KEY_FIELDS,
        T.StructField("click_time", T.TimestampNTZType()),
    ]
)


def read_train_csv(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, TRAIN_SCHEMA)


def read_test_csv(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, TEST_SCHEMA)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed scan of a CSV with a header; ``row_id`` is the row's position in the files.

    A file split is read by one task in file order, so a row's place in its split is known
    without moving it; only the split sizes are added up, one row per split.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
        )
        .withColumn("_mark", F.monotonically_increasing_id())
    )
    splits = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_mark").alias("_first"))
    return (
        rows.join(_split_offsets(splits), ["_file", "_start"])
        .withColumn("row_id", F.col("_offset") + F.col("_mark") - F.col("_first"))
        .select("row_id", *schema.names)
    )


def _split_offsets(splits: DataFrame) -> DataFrame:
    in_file = splits.groupBy("_file").agg(F.sum("_n").alias("_file_n"))
    files = running_total(in_file, "_file", "_file_n", "_file_offset")
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    local = splits.withColumn("_in_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return local.join(files, "_file").select(
        "_file", "_start", "_first", (F.col("_file_offset") + F.col("_in_file")).alias("_offset")
    )


def keep_after(supplement: DataFrame, train: DataFrame, column: str = "click_time") -> DataFrame:
    """Rows of ``supplement`` at or after the last click of ``train``; all of them if there is none.

    The last click is read first, so that the filter is a plain value the scan can skip by.
    """
    last = train.agg(F.max(column)).first()[0]
    return supplement if last is None else supplement.where(F.col(column) >= F.lit(last))


def write_table(df: DataFrame, path: str, cluster_by: str | None = None) -> str:
    """Write a prepared table as parquet, optionally range-ordered by one column."""
    if cluster_by:
        df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    df.write.mode("overwrite").parquet(path)
    return path


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """Projected scan of a prepared table; columns beyond the click schema are not read."""
    return spark.read.parquet(path).select(*CLICK_COLUMNS)


def typed_clicks(raw: DataFrame, is_train: bool) -> DataFrame:
    """Raw columns (``click_time`` ...) -> click columns, nulls and missing labels read as 0."""
    columns = [F.coalesce(F.col(key), F.lit(0)).cast("int").alias(key) for key in KEYS]
    label = F.coalesce("is_attributed", F.lit(0)) if "is_attributed" in raw.columns else F.lit(0)
    attributed = epoch_seconds(F.col("attributed_time")) if "attributed_time" in raw.columns else F.lit(None)
    extra = ["click_id"] if "click_id" in raw.columns else []
    return raw.select(
        "row_id",
        *columns,
        F.coalesce(epoch_seconds(F.col("click_time")), F.lit(0)).cast("bigint").alias("click_s"),
        label.cast("int").alias("is_attributed"),
        attributed.cast("bigint").alias("attributed_s"),
        F.lit(is_train).alias("is_train"),
        *extra,
    )


def stack(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows, then test rows; missing label columns become 0.

    Test positions continue after the last train position, so (click_s, row_id) stays the order
    of the stacked log.
    """
    last = train.agg(F.max("row_id")).first()[0]
    first = test.agg(F.min("row_id")).first()[0]
    shift = (-1 if last is None else last) + 1 - (first or 0)
    moved = test.withColumn("row_id", F.col("row_id") + F.lit(shift))
    both = train.withColumn("is_train", F.lit(True)).unionByName(
        moved.withColumn("is_train", F.lit(False)), allowMissingColumns=True
    )
    fill = {key: 0 for key in (*KEYS, "click_s", "is_attributed") if key in both.columns}
    return both.na.fill(fill)


def split(stacked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return stacked.where("is_train"), stacked.where("NOT is_train")
