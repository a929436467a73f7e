"""Per-key history quantities, the building blocks of every grouped click feature.

A feature states what it needs from its key group (how many clicks lie before this one, how
many up to 600 seconds later, what the next app is ...). Two plans deliver the same answers:

* ``direct``: window functions over the whole key group. One shuffle per leading column serves
  all masks that contain it. Used only where the largest group is known to fit one task.
* ``cells``: clicks are first collapsed to one row per (key, second, chunk), windows run over
  those cells, and their results return to the clicks on (chunk, key, second). A hot key is
  never in one task as clicks, only as cells: at most one per second plus one per chunk.

All frames grow from the start of the group (UNBOUNDED PRECEDING to some offset), which
Spark evaluates in one pass; a frame sliding at both ends would be re-added for every row.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickmill.functions.keys import KEYS

START = Window.unboundedPreceding
# Largest key group the direct plan may sort in one task.
DIRECT_GROUP_ROWS = 4_000_000
# Rows of a long log that a task gets on average. A task sorts its rows, with all columns added so far, a few times per mask;
# by the bytes of the shuffle alone, which is narrow and compressed, adaptive execution would give it many times more.
TASK_ROWS = 1 << 17

MEASURES = {
    "clicks": lambda: F.lit(1).cast("bigint"),
    "labels": lambda: F.col("is_attributed").cast("bigint"),
    "channels": lambda: F.col("channel").isNotNull().cast("bigint"),
}


@dataclass(frozen=True)
class Total:
    """Sum of a measure over the whole group."""

    measure: str = "clicks"

    @property
    def column(self):
        return f"_total_{self.measure}"


@dataclass(frozen=True)
class Before:
    """Sum over the rows ahead of this one in (click_s, row_id) order."""

    measure: str = "clicks"

    @property
    def column(self):
        return f"_before_{self.measure}"


@dataclass(frozen=True)
class UpTo:
    """Sum over the rows with click_s at most this row's plus ``offset`` seconds."""

    offset: int
    measure: str = "clicks"

    @property
    def column(self):
        return f"_upto_{self.measure}_{self.offset}".replace("-", "m")


@dataclass(frozen=True)
class PreviousUpTo:
    """What ``UpTo`` gave for the previous row of the group; 0 for the first row."""

    offset: int
    measure: str = "clicks"

    @property
    def column(self):
        return f"_prev{self.inner.column}"

    @property
    def inner(self):
        return UpTo(self.offset, self.measure)


@dataclass(frozen=True)
class Neighbour:
    """A column of the next (step 1) or previous (step -1) row; null at the group's end."""

    source: str
    step: int

    @property
    def column(self):
        return f"_{'next' if self.step > 0 else 'last'}_{self.source}"


Need = Total | Before | UpTo | PreviousUpTo | Neighbour


def measures_of(needs: Iterable[Need]) -> list[str]:
    return sorted({n.measure for n in needs if not isinstance(n, Neighbour)})


def hidden(need: Need, tag: str) -> str:
    """Name of the helper column holding ``need`` for the group called ``tag``."""
    return f"{need.column}__{tag}"


def add_needs(
    rows: DataFrame, tag: str, keys: list[str], needs: Iterable[Need], strategy: str, source: DataFrame
) -> DataFrame:
    """``rows`` plus one helper column per need, computed within the groups of ``keys``.

    Helper columns that no later step reads are pruned by Catalyst. ``source`` holds the same
    clicks as ``rows`` without the columns added so far: cells are made from it, so that a
    chain of masks never recomputes its own earlier steps.
    """
    needs = sorted(set(needs), key=lambda n: n.column)
    if strategy == "direct":
        return _direct(rows, tag, keys, needs)
    if strategy == "cells":
        return _cells(rows, tag, keys, needs, source)
    raise ValueError(f"unknown strategy {strategy!r}")


# ---------------------------------------------------------------- direct


def _direct(rows: DataFrame, tag: str, keys: list[str], needs: list[Need]) -> DataFrame:
    group = Window.partitionBy(*keys)
    in_order, in_time = group.orderBy("click_s", "row_id"), group.orderBy("click_s")
    by_order, by_time, lagged = {}, {}, {}
    for need in needs:
        name = hidden(need, tag)
        if isinstance(need, Total):
            by_time[name] = F.sum(MEASURES[need.measure]()).over(group)
        elif isinstance(need, Before):
            by_order[name] = _before(need.measure, in_order)
        elif isinstance(need, UpTo):
            by_time[name] = _up_to(MEASURES[need.measure](), need.offset, in_time)
        elif isinstance(need, PreviousUpTo):
            inner = hidden(need.inner, tag)
            by_time[inner] = _up_to(MEASURES[need.measure](), need.offset, in_time)
            lagged[name] = F.lag(inner, 1, 0).over(in_order)
        else:
            by_order[name] = F.lead(need.source, need.step).over(in_order)
    # The sort by (keys, click_s, row_id) also serves the windows of the later steps.
    return _in_steps(rows, by_order, by_time, lagged)


def _in_steps(rows: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    for step in steps:
        if step:
            rows = rows.select("*", *[value.alias(name) for name, value in step.items()])
    return rows


def _before(measure: str, in_order) -> Column:
    if measure == "clicks":
        return F.row_number().over(in_order).cast("bigint") - 1
    total = F.sum(MEASURES[measure]()).over(in_order.rowsBetween(START, -1))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def _up_to(value: Column, offset: int, in_time) -> Column:
    return F.coalesce(F.sum(value).over(in_time.rangeBetween(START, offset)), F.lit(0).cast("bigint"))


# ---------------------------------------------------------------- cells


def _cells(rows: DataFrame, tag: str, keys: list[str], needs: list[Need], source: DataFrame) -> DataFrame:
    grain, cells = _cell_table(tag, keys, needs, source)
    results = [c for c in cells.columns if c.startswith("_cell")]
    # The cells come to the clicks, which stay where they are: without the explicit chunk
    # layout the planner could move the clicks to the cells' layout by key, hot keys included.
    rows = rows.join(cells.select(*grain, *results).repartition("chunk"), grain, "inner")

    in_cell = Window.partitionBy(*grain).orderBy("row_id") if "click_s" in grain else None
    final = {}
    for need in needs:
        cell = F.col(f"_cell{hidden(need, tag)}")
        if isinstance(need, (Total, UpTo)):
            value = cell
        elif isinstance(need, Before):
            value = cell + _before(need.measure, in_cell)
        elif isinstance(need, PreviousUpTo):
            first = F.row_number().over(in_cell) == 1
            value = F.when(first, cell).otherwise(F.col(f"_cell{hidden(need.inner, tag)}"))
        else:
            # At the cell's edge there is no such row inside it; source columns are never null.
            value = F.coalesce(F.lead(need.source, need.step).over(in_cell), cell)
        final[hidden(need, tag)] = value
    return _in_steps(rows, final)


def cell_values(source: DataFrame, tag: str, keys: list[str], need: Total | Before | PreviousUpTo) -> DataFrame:
    """(chunk, keys, _n): every value that ``need`` has in a chunk, distinct, from the cells alone; ``Before`` may give one
    more per cell."""
    _, cells = _cell_table(tag, keys, [need], source)
    cell = F.col(f"_cell{hidden(need, tag)}")
    if isinstance(need, Total):
        values = F.array(cell)
    elif isinstance(need, Before):
        values = F.sequence(cell, cell + F.coalesce(f"_n_{need.measure}", F.lit(0)))
    else:
        values = F.array(cell, f"_cell{hidden(need.inner, tag)}")
    return cells.select("chunk", *keys, F.explode(values).alias("_n")).distinct()


def _cell_table(tag: str, keys: list[str], needs: list[Need], source: DataFrame) -> tuple[list[str], DataFrame]:
    """(grain, cells): one row per grain with the measures of its clicks and what the windows give."""
    ordered = any(not isinstance(n, Total) for n in needs)
    grain = ["chunk", *keys, "click_s"] if ordered else ["chunk", *keys]

    sums = [F.sum(MEASURES[m]()).alias(f"_n_{m}") for m in measures_of(needs)]
    edges = [
        (F.min_by if n.step > 0 else F.max_by)(n.source, "row_id").alias(f"_edge{n.column}")
        for n in needs
        if isinstance(n, Neighbour)
    ]
    cells = source.groupBy(*grain).agg(*sums, *edges)

    # Within a second, chunks number consecutive row_ids, so (click_s, chunk) is click order.
    group = Window.partitionBy(*keys)
    in_order, in_time = group.orderBy("click_s", "chunk"), group.orderBy("click_s")
    by_order, by_time, lagged = {}, {}, {}
    for need in needs:
        name = f"_cell{hidden(need, tag)}"
        if isinstance(need, Total):
            by_time[name] = F.sum(f"_n_{need.measure}").over(group)
        elif isinstance(need, Before):
            ahead = F.sum(f"_n_{need.measure}").over(in_order.rowsBetween(START, -1))
            by_order[name] = F.coalesce(ahead, F.lit(0).cast("bigint"))
        elif isinstance(need, UpTo):
            by_time[name] = _up_to(F.col(f"_n_{need.measure}"), need.offset, in_time)
        elif isinstance(need, PreviousUpTo):
            inner = f"_cell{hidden(need.inner, tag)}"
            by_time[inner] = _up_to(F.col(f"_n_{need.measure}"), need.offset, in_time)
            lagged[name] = F.lag(inner, 1, 0).over(in_order)
        else:
            by_order[name] = F.lead(f"_edge{need.column}", need.step).over(in_order)
    cells = _in_steps(cells, by_order, by_time, lagged)
    return grain, cells


# ---------------------------------------------------------------- choice of plan


def choose_strategies(clicks: DataFrame, masks, limit: int = DIRECT_GROUP_ROWS) -> list[tuple]:
    """(strategy, lead column, mask) for each mask, ordered so that shuffles are shared.

    A mask may run directly if one of its columns has no value with more than ``limit`` rows:
    all windows of the mask then cluster on that column. The check is a row count and, for
    longer logs, one aggregation of the single columns; only five numbers reach the driver.
    """
    used = [key for key in KEYS if any(key in mask for mask in masks)]
    if is_small(clicks, limit):
        safe = used
    else:
        safe = [key for key in used if _largest_group(clicks, key) <= limit]
    plan = []
    for mask in masks:
        lead = next((key for key in safe if key in mask), None)
        plan.append(("direct" if lead else "cells", lead, mask))
    # Columns add up from step to step: the hottest groups are sorted first, while rows are short, and the key that most
    # masks share comes last.
    rank = {key: i for i, key in enumerate(KEYS)}
    return sorted(plan, key=lambda p: (-rank.get(p[1], len(KEYS)), len(p[2])))


def is_small(clicks: DataFrame, limit: int = DIRECT_GROUP_ROWS) -> bool:
    """Whether the whole log is no longer than one key group may be; parquet answers from its footers."""
    return clicks.count() <= limit


def layout_parts(clicks: DataFrame, limit: int = DIRECT_GROUP_ROWS) -> int:
    """Into how many partitions the rows of a log go, whatever their bytes. A small log is spread over all cores, since a dozen
    windows over few bytes are work that adaptive execution would put in one task; of a long one, a task gets ``TASK_ROWS``."""
    spark, count = clicks.sparkSession, clicks.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if count <= limit:
        return min(parts, spark.sparkContext.defaultParallelism)
    return max(parts, -(-count // TASK_ROWS))


def by_column(rows: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """Shuffle by ``column``, to ``parts`` partitions if given."""
    return rows.repartition(parts, column) if parts else rows.repartition(column)


def _largest_group(clicks: DataFrame, key: str) -> int:
    return clicks.groupBy(key).count().agg(F.max("count")).first()[0] or 0
