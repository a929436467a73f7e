"""Running totals and ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table


def running_totals(df: DataFrame, group: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (whole numbers) over the rows of the group that come before a row.

    Rows are dealt to tasks by ranges of (group, order), so that a group of any size is spread over many; a task's
    rows of a group are summed in order, and the sums of earlier tasks, one per group and task, are added. Rows
    equal in group and order get an order of their own, or share a task.
    """
    dealt = df.withColumn("__value", value.cast("bigint")).repartitionByRange(*group, *order)
    dealt = table(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "__part").agg(F.sum("__value").alias("__sum"))
    sums = sums.withColumn("__earlier", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    joined = own.join(sums, [*group, "__part"])
    return joined.withColumn(name, F.col("__earlier") + F.col("__inside")).select(*df.columns, name)
