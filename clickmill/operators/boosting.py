"""Gradient boosting of histogram trees on Spark: one pass over binned rows per level of a tree.

A row is its label, weight, margin so far, and one byte per feature. Tasks add up gradients per (node, feature, bin),
the sums of all tasks meet per (node, feature), and the driver sees one best cut for each of those. The margin is a
stored column: it is rewritten once per block of trees, and within a block the rows' few newest trees are applied on
the way, so plans have the same size at any number of trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmill.session import forget, written

#: Most bins of a feature: a bin is one byte.
BINS = 256
#: Nodes and features whose sums meet in one task; each comes from every task of the rows, as 6 KB.
GROUPS_EACH = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` and ``depth`` (0: any) bound a tree; the best cuts of a level come first."""

    rate: float = 0.1
    leaves: int = 31
    depth: int = 0
    min_rows: int = 20
    min_hessian: float = 1e-3
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    rows: float = 1.0
    features: float = 1.0
    bins: int = 255
    positive: float = 1.0
    seed: int = 0


@dataclass
class Tree:
    """Nodes as lists: feature (-1: leaf), last bin that goes left, children, value of a leaf, gain of a cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    last: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def cut(self, node: int, feature: int, last: int, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.last[node], self.gain[node] = feature, last, gain
        self.left[node], self.right[node] = children
        for value in values:
            for column, new in ((self.feature, -1), (self.last, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0)):
                column.append(new)
        return children

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins``."""
        feature, last, left, right = (np.array(x) for x in (self.feature, self.last, self.left, self.right))
        at, open_ = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(open_):
            open_ = open_[feature[at[open_]] >= 0]
            node = at[open_]
            at[open_] = np.where(bins[open_, feature[node]] <= last[node], left[node], right[node])
        return at

    def outputs(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Forest:
    """``edges``: per feature the largest value of each bin but the last; ``base``: the margin before any tree."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, features: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, features[:, k]).astype(np.uint8) for k, e in enumerate(self.edges)]
        return np.stack(columns, 1) if columns else np.zeros((len(features), 0), np.uint8)

    def margins(self, features: np.ndarray, rounds: int) -> np.ndarray:
        """The margin after 1, 2, ... ``rounds`` trees, one row per row."""
        bins = self.binned(features)
        steps = np.empty((len(features), rounds))
        for k, tree in enumerate(self.trees[:rounds]):
            steps[:, k] = tree.outputs(bins)
        return self.base + np.cumsum(steps, axis=1, out=steps)


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Quantiles of every feature, in one job; equal ones are one edge."""
    if not 2 <= bins <= BINS:
        raise ValueError(f"between 2 and {BINS} bins, not {bins}")
    steps = [k / bins for k in range(1, bins)]
    values = rows.select(vector_to_array("features").alias("v"))
    found = values.agg(*[F.percentile_approx(F.col("v")[k], steps, 50 * bins).alias(f"e{k}") for k in range(width)]).first()
    return [np.unique(np.array(found[k] or [], float)) for k in range(width)]


#: A prepared row.
ROWS = "row_id bigint, label double, weight double, margin double, bins binary"


def prepare(rows: DataFrame, forest: Forest, label: str, weight: str | None) -> DataFrame:
    """Written: binned rows at the margin ``forest.base``, from rows with ``row_id`` and ``features``."""
    given = F.col(weight).cast("double") if weight else F.lit(1.0)
    source = rows.select("row_id", F.col(label).cast("double").alias("label"), given.alias("weight"), vector_to_array("features").alias("v"))

    def bins(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = forest.binned(matrix(part.column(3)))
            margin = pa.array(np.full(part.num_rows, forest.base))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], margin, pa.array([r.tobytes() for r in made], pa.binary())], names=["row_id", "label", "weight", "margin", "bins"])

    return written(source.mapInArrow(bins, ROWS), "binned")


def matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def bytes_of(part: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(part.num_rows, width)


def chosen(row_id: np.ndarray, tree: int, growth: Growth) -> np.ndarray:
    """Rows that a tree sees: a hash of row, tree and seed below the share."""
    if growth.rows >= 1:
        return np.ones(len(row_id), bool)
    h = row_id.astype(np.uint64) * _MIX + np.uint64((tree * 1_000_003 + growth.seed) % (1 << 62))
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h >> np.uint64(11)).astype(float) / float(1 << 53) < growth.rows


def best_cuts(rows: DataFrame, newest: list[Tree], tree: Tree, number: int, open_: list[int], features: list[int], width: int, growth: Growth) -> list:
    """One row per open node and feature: the best cut and the sums on both sides of it."""
    wanted = np.array(features)

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {node: k for k, node in enumerate(open_)}
        place = np.full(len(tree.feature), -1)
        place[list(at)] = list(at.values())
        total = np.zeros((len(open_), len(features), BINS, 3))
        for part in parts:
            bins = bytes_of(part, width)
            label, weight, margin = (part.column(k).to_numpy() for k in (1, 2, 3))
            for t in newest:
                margin = margin + t.outputs(bins)
            own = place[tree.nodes(bins)]
            mine = np.flatnonzero((own >= 0) & chosen(part.column(0).to_numpy(), number, growth))
            p = 1 / (1 + np.exp(-margin[mine]))
            w = weight[mine] * np.where(label[mine] > 0, growth.positive, 1.0)
            values = np.stack(((p - label[mine]) * w, p * (1 - p) * w, np.ones(len(mine))), 1)
            for k, f in enumerate(wanted):
                key = own[mine] * BINS + bins[mine, f]
                for c in range(3):
                    total[:, k, :, c] += np.bincount(key, values[:, c], len(open_) * BINS).reshape(-1, BINS)
        node, k = np.nonzero(total[:, :, :, 2].sum(axis=2))
        part_id = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(open_)[node], pa.int32()), pa.array(wanted[k], pa.int32()), pa.array([part_id] * len(node), pa.int32()), pa.array([total[x, y].tobytes() for x, y in zip(node, k, strict=True)], pa.binary())],
            names=["node", "feature", "part", "sums"],
        )

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:  # sorted, so sums are always added in the same order
            for node, feature, packed in zip(*(part.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                got = np.frombuffer(packed).reshape(BINS, 3)
                held[node, feature] = held[node, feature] + got if (node, feature) in held else got
        out = [(*key, *cut_of(total, growth)) for key, total in held.items()]
        columns = list(zip(*out, strict=True)) or [[]] * 10
        types = [pa.int32()] * 3 + [pa.float64()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["node", "feature", "last", "gain", "g", "h", "n", "g_left", "h_left", "n_left"])

    local = rows.select("row_id", "label", "weight", "margin", "bins").mapInArrow(sums, "node int, feature int, part int, sums binary")
    met = local.repartition(-(-len(open_) * len(features) // GROUPS_EACH), "node", "feature").sortWithinPartitions("node", "feature", "part")
    kind = "node int, feature int, last int, gain double, g double, h double, n double, g_left double, h_left double, n_left double"
    return met.mapInArrow(best, kind).collect()


def pull(g, growth: Growth):
    """Gradient sum, drawn towards zero by ``l1``."""
    return np.sign(g) * np.maximum(np.abs(g) - growth.l1, 0)


def cut_of(total: np.ndarray, growth: Growth) -> tuple:
    """The best cut of one node and feature: last bin on the left, gain, sums of all and of the left side."""
    g, h, n = total.sum(axis=0)
    left = np.cumsum(total, axis=0)[:-1]
    gl, hl, nl = left.T
    ok = (np.minimum(nl, n - nl) >= growth.min_rows) & (np.minimum(hl, h - hl) >= growth.min_hessian)
    tiny = 1e-15
    gain = pull(gl, growth) ** 2 / (hl + growth.l2 + tiny) + pull(g - gl, growth) ** 2 / (h - hl + growth.l2 + tiny) - pull(g, growth) ** 2 / (h + growth.l2 + tiny)
    gain = np.where(ok, gain, -np.inf)
    k = int(gain.argmax())
    return k, float(gain[k]), float(g), float(h), float(n), *(float(x[k]) for x in (gl, hl, nl))


def leaf_value(g: float, h: float, growth: Growth) -> float:
    return float(-growth.rate * pull(g, growth) / (h + growth.l2 + 1e-15))


def grow(rows: DataFrame, newest: list[Tree], number: int, width: int, growth: Growth) -> Tree:
    """The next tree after ``newest``, which the stored margins do not hold yet: one job per level."""
    tree = Tree()
    rng = np.random.default_rng([growth.seed, number])
    features = sorted(rng.choice(width, max(1, round(growth.features * width)), replace=False).tolist()) if width else []
    open_, leaves, level = [0], 1, 0
    while open_ and features and leaves < growth.leaves and (not growth.depth or level < growth.depth):
        found = best_cuts(rows, newest, tree, number, open_, features, width, growth)
        if level == 0 and found:
            tree.value[0] = leaf_value(found[0].g, found[0].h, growth)
        best: dict = {}
        for r in sorted(found, key=lambda r: r.feature):
            if r.gain > growth.min_gain and (r.node not in best or r.gain > best[r.node].gain):
                best[r.node] = r
        open_ = []
        for r in sorted(best.values(), key=lambda r: (-r.gain, r.node))[: growth.leaves - leaves]:
            values = leaf_value(r.g_left, r.h_left, growth), leaf_value(r.g - r.g_left, r.h - r.h_left, growth)
            open_ += tree.cut(r.node, r.feature, r.last, r.gain, values)
            leaves += 1
        level += 1
    return tree


def advanced(rows: DataFrame, newest: list[Tree], width: int, steps: bool = False) -> DataFrame:
    """Written: ``rows`` with the newest trees in their margins; with ``steps``, also the margin after each of them."""

    def move(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bins = bytes_of(part, width)
            out = np.stack([part.column(3).to_numpy(), *(t.outputs(bins) for t in newest)], 1)
            np.cumsum(out, axis=1, out=out)
            columns = [*part.columns[:3], pa.array(out[:, -1]), part.column(4)]
            if steps:
                offsets = np.arange(part.num_rows + 1) * len(newest)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out[:, 1:].ravel())))
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "label", "weight", "margin", "bins", "steps"][: len(columns)])

    plain = rows.select("row_id", "label", "weight", "margin", "bins")
    return written(plain.mapInArrow(move, ROWS + ", steps array<double>" * steps), "margins")


def start(rows: DataFrame, label: str, weight: str | None, width: int, growth: Growth) -> Forest:
    """No tree yet: bins by quantiles, and the log odds of the weighted labels."""
    w = (F.col(weight).cast("double") if weight else F.lit(1.0)) * F.when(F.col(label) > 0, growth.positive).otherwise(1.0)
    positive, whole = rows.agg(F.sum(w * F.col(label)), F.sum(w)).first()
    share = min(max((positive or 0.0) / (whole or 1.0), 1e-6), 1 - 1e-6)
    return Forest(bin_edges(rows, width, growth.bins), float(np.log(share / (1 - share))))


def boost(
    rows: DataFrame, label: str, width: int, growth: Growth, rounds: int, weight: str | None = None, valid: DataFrame | None = None, patience: int | None = None, block: int = 20, measure=None
) -> tuple[Forest, list[float]]:
    """Fit up to ``rounds`` trees on ``rows`` (``row_id``, ``features``, ``label``, ``weight``).

    With ``valid``, ``measure(steps)`` gives the score of each tree of a block by the margins of the validation rows, and no
    tree is fitted beyond ``patience`` rounds after the best score. Returns the trees and their scores.
    """
    forest = start(rows, label, weight, width, growth)
    train = prepare(rows, forest, label, weight)
    checked = prepare(valid, forest, label, None) if valid is not None else None
    scores: list[float] = []
    while len(forest.trees) < rounds:
        until = len(forest.trees) + block
        if patience and checked is not None:
            until = min(until, (int(np.argmax(scores)) + 1 if scores else 1) + patience)
        until = min(until, rounds)
        if until <= len(forest.trees):
            break
        newest: list[Tree] = []
        while len(forest.trees) + len(newest) < until:
            newest.append(grow(train, newest, len(forest.trees) + len(newest), width, growth))
        forest.trees += newest
        before, train = train, advanced(train, newest, width)
        forget(before)
        if checked is not None:
            before, checked = checked, advanced(checked, newest, width, steps=True)
            forget(before)
            scores += measure(checked)
    forget(train, *([checked] if checked is not None else []))
    return forest, scores


def margins(forest: Forest, rounds: int, features: Column) -> Column:
    """The margins after each of the first trees, as an array, from a vector column."""

    @F.pandas_udf("array<double>")
    def steps(v):
        import pandas as pd

        return pd.Series(list(forest.margins(np.stack(v.to_numpy()), rounds))) if len(v) else v

    return steps(vector_to_array(features))


def margin(forest: Forest, rounds: int, features: Column) -> Column:
    """The margin after the first trees."""

    @F.pandas_udf("double")
    def last(v):
        import pandas as pd

        if not len(v):
            return pd.Series([], dtype=float)
        bins = forest.binned(np.stack(v.to_numpy()))
        return pd.Series(forest.base + sum((t.outputs(bins) for t in forest.trees[:rounds]), np.zeros(len(v))))

    return last(vector_to_array(features))
