"""Middle-in-click-order attribution delay ("median attribute time") in three variants.

``all``      over every attributed row of the group. It sees the row's own and later labels,
             so it leaks the target; kept because the feature exists.
``past``     over attributed rows strictly before this one.
``past_v2``  over attributed rows at least a day older than the *previous* row of the group.

The delays are taken in click order and not sorted; ``true_median`` sorts instead (for ``all``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmill.functions.clock import DAY, whole_div
from clickmill.functions.keys import all_masks, feature_column, mask_suffix
from clickmill.operators.frames import Before, PreviousUpTo, Total, add_needs, by_column, cell_values, hidden, layout_parts
from clickmill.operators.grouped import LARGEST, NONE, cluster_key, plan_masks
from clickmill.operators.lookup import CHUNK_ROWS, with_chunk

KINDS = {
    "all": ("MedianAttributeTime", Total("labels")),
    "past": ("MedianAttributeTimePast", Before("labels")),
    "past_v2": ("MedianAttributeTimePastV2", PreviousUpTo(-DAY, "labels")),
}


def middle_delays(source: DataFrame, tag: str, keys: list[str], how: str, parts: int | None = None) -> DataFrame:
    """(keys, n, value): the middle delay of the first ``n`` attributed rows, for every n >= 1.

    The attributed row at position j is the upper middle of the first 2j and 2j+1 rows and the
    lower middle of the first 2j+1 and 2j+2 rows, so it adds its delay to those three and no
    group's history is ever held in one row. ``parts`` is the layout of the rows that ask.
    """
    positives = source.where("is_attributed = 1")
    layout = keys[0] if how == "direct" else "chunk"
    placed = add_needs(by_column(positives, layout, parts), tag, keys, [Before()], how, positives)
    j = F.col(hidden(Before(), tag))
    delay = F.col("attributed_s") - F.col("click_s")
    shares = F.array(
        F.struct((2 * j).alias("n"), delay.alias("d")),
        F.struct((2 * j + 1).alias("n"), (2 * delay).alias("d")),
        F.struct((2 * j + 2).alias("n"), delay.alias("d")),
    )
    # Beyond the last position n gets an incomplete sum, but no row ever asks for it.
    return (
        placed.select(*keys, F.explode(shares).alias("s"))
        .where("s.n > 0")
        .groupBy(*keys, F.col("s.n").alias("_n"))
        .agg(F.least(whole_div(F.sum("s.d"), 2), F.lit(LARGEST)).cast("int").alias("_middle"))
    )


def add_median_attribute_time(
    clicks: DataFrame,
    kind: str,
    masks=None,
    strategy: str = "auto",
    chunk_rows: int = CHUNK_ROWS,
    true_median: bool = False,
) -> DataFrame:
    name, need = KINDS[kind]
    masks = [m for m in all_masks() if masks is None or m in masks]
    plan = plan_masks(clicks, masks, strategy)
    rows = source = with_chunk(clicks, chunk_rows)
    parts = layout_parts(clicks) if strategy == "auto" else None
    clustered_on = None
    for how, lead, mask in plan:
        if cluster_key(how, lead) != clustered_on:
            clustered_on = cluster_key(how, lead)
            rows = by_column(rows, clustered_on, parts)
        keys = [lead, *[k for k in mask if k != lead]] if lead else list(mask)
        tag = mask_suffix(mask)
        rows = add_needs(rows, tag, keys, [need], how, source).withColumnRenamed(hidden(need, tag), "_n")
        if true_median:
            table = sorted_medians(source, keys)
        else:
            table = middle_delays(source, tag, keys, how, parts)
        if how == "direct":
            rows = rows.join(table, [*keys, "_n"], "left")
        else:
            asked = cell_values(source, tag, keys, need)
            answers = asked.join(table, [*keys, "_n"]).repartition("chunk")
            rows = rows.join(answers, ["chunk", *keys, "_n"], "left")
        value = F.coalesce("_middle", F.lit(NONE)).alias(feature_column(name, mask))
        rows = rows.select("*", value).drop("_n", "_middle")
    return rows.select(*clicks.columns, *[feature_column(name, mask) for mask in masks])


def sorted_medians(source: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, value) with the ordinary median of all delays of the group, n their number.

    Equal delays are counted first; ``percentile`` then merges counts, not rows.
    """
    delay = F.col("attributed_s") - F.col("click_s")
    counted = source.where("is_attributed = 1").groupBy(*keys, delay.alias("_d")).agg(F.count("*").alias("_c"))
    return counted.groupBy(*keys).agg(
        F.sum("_c").alias("_n"),
        F.least(F.percentile("_d", 0.5, F.col("_c")).cast("bigint"), F.lit(LARGEST)).cast("int").alias("_middle"),
    )
