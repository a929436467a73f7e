"""Exact-size reproducible samples and balanced bags.

The order of a sample is the md5 of row id and seed. Its first n rows are found without
sorting: a histogram of hash prefixes tells the prefix that holds the n-th row, smaller
prefixes are taken whole and only the rows of that one prefix are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 16**5 prefixes; md5 spreads rows evenly, so one prefix holds a millionth of them.
PREFIX = 5


def sample_hash(row_id: Column, seed) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(row_id.cast("string"), F.lit(":"), seed.cast("string")).cast("binary"))


def _first_by_hash(hashed: DataFrame, sizes: DataFrame) -> DataFrame:
    """First ``_size`` rows of each ``bag`` by (_hash, row_id); ``sizes`` is (bag, _size)."""
    kept = [c for c in hashed.columns if c != "_hash"]
    cut = F.substring("_hash", 1, PREFIX)
    hashed = hashed.withColumn("_prefix", cut)
    in_bag = Window.partitionBy("bag").orderBy("_prefix")
    edge = (
        hashed.groupBy("bag", "_prefix")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(in_bag.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(sizes), "bag")
        .where("_upto >= _size AND _upto - _n < _size")
        .select("bag", F.col("_prefix").alias("_edge"), (F.col("_size") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    # One row per bag. A bag without an edge row is wanted whole.
    compared = hashed.join(F.broadcast(edge), "bag", "left")
    inside = compared.where("_edge IS NULL OR _prefix < _edge")
    on_edge = compared.where("_prefix = _edge").withColumn(
        "_place", F.row_number().over(Window.partitionBy("bag").orderBy("_hash", "row_id"))
    )
    return inside.select(*kept).union(on_edge.where("_place <= _rest").select(*kept))


def fraction_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """``round(fraction * n)`` rows, in click order."""
    hashed = df.select(F.lit(0).alias("bag"), *df.columns, sample_hash(F.col("row_id"), seed).alias("_hash"))
    size = df.agg(F.lit(0).alias("bag"), F.round(F.count("*") * fraction).cast("bigint").alias("_size"))
    none_wanted = size.where("_size = 0").select("bag")
    chosen = _first_by_hash(hashed, size).join(F.broadcast(none_wanted), "bag", "left_anti")
    return chosen.select(*df.columns).orderBy("click_s", "row_id")


def balanced_bags(train: DataFrame, seeds) -> DataFrame:
    """(bag, row_id): all positives and as many negatives, drawn without replacement per seed."""
    seeds = list(seeds)
    seed_array = F.array(*[F.lit(int(s)) for s in seeds])
    labelled = train.select("row_id", "is_attributed")
    positives = labelled.where("is_attributed = 1")
    spread = positives.select(F.explode(seed_array).alias("bag"), "row_id")
    sizes = positives.agg(F.count("*").alias("_size")).select(F.explode(seed_array).alias("bag"), "_size")
    hashed = (
        labelled.where("is_attributed = 0")
        .select(F.explode(seed_array).alias("bag"), "row_id")
        .withColumn("_hash", sample_hash(F.col("row_id"), F.col("bag")))
    )
    none_wanted = sizes.where("_size = 0").select("bag")
    negatives = _first_by_hash(hashed, sizes).join(F.broadcast(none_wanted), "bag", "left_anti")
    return spread.unionByName(negatives)


def bag_rows(features: DataFrame, bags: DataFrame) -> DataFrame:
    """Rows of a feature table (computed on the full log) that are in each bag, with ``bag``."""
    return features.join(bags, "row_id")
