"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table
from .heavy import join_unique

#: Pointers up to which their table is broadcast.
SHORT = 200_000


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: root is the smallest node of its component.

    Every round lets each node point to its smallest neighbour, follows the pointers to their ends, twice as far each time,
    and replaces the ends of all links by those. Each node with a link left is merged with another one, so their
    number at least halves per round, and the loop ends when no link is left. The pointers of all rounds are
    then put together. Links, pointers and roots stay in tables; the driver sees only whether any are left.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = table(links.where("a <> b").select(*ends).distinct(), "edges")
    rounds: list[tuple[DataFrame, bool]] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        pointers = table(least.select("node", F.least("node", "least").alias("root")), "pointers")
        short = pointers.count() <= SHORT
        pointers = to_the_end(pointers, short)
        rounds.append((pointers, short))
        met = look_up(edges, pointers.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", short)
        met = look_up(met, pointers.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", short)
        met = met.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").select(*ends).distinct()
        before, edges = edges, table(met, "edges")
        discard(before)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1][0]
    for (pointers, _), (_, short) in zip(reversed(rounds[:-1]), reversed(rounds[1:]), strict=True):
        roots = table(follow(pointers, roots, short), "roots")
    return roots


def to_the_end(pointers: DataFrame, short: bool) -> DataFrame:
    """Each node with the last node of its chain of pointers."""
    while True:
        further = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = look_up(pointers.select("node", "root"), further, "root", short)
        before, pointers = pointers, table(step.select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "pointers")
        discard(before)
        if pointers.where("moved").isEmpty():
            return pointers.select("node", "root")


def look_up(rows: DataFrame, right: DataFrame, key: str, short: bool) -> DataFrame:
    return rows.join(F.broadcast(right), key, "left") if short else join_unique(rows, right, key)


def follow(pointers: DataFrame, roots: DataFrame, short: bool) -> DataFrame:
    """Each node with the root of the node that it points to, or that node itself."""
    further = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return look_up(pointers, further, "root", short).select("node", F.coalesce("next", "root").alias("root"))
