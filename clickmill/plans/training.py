"""Boosted trees on feature tables: preparation, fit, evaluation, scoring."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmill.operators import boosting
from clickmill.operators.lookup import small_or_spread_lookup, with_chunk
from clickmill.operators.ranks import exact_auc
from clickmill.plans.registry import TARGET
from clickmill.session import cut_lineage

MISSING = -1.0
# Folds of the training rows; a row's own fold does not count for its categories.
FOLDS = 5
# Rows of average behaviour that every category starts with.
PRIOR_ROWS = 20.0
DEEPEST = 30
# Model parameters that the tree learner has no counterpart for.
WITHOUT_EFFECT = {"subsample_for_bin"}


@dataclass(frozen=True)
class Design:
    """The columns a model sees, in order, and which of them are categorical."""

    columns: tuple[str, ...]
    categorical: tuple[str, ...] = ()


@dataclass
class Encoding:
    """Per categorical column the clicks and positives of each category in the training rows.

    A category counts as its share of positives, drawn towards the overall share. Trees cut two-class categories
    in that order anyway, and it works alike for five categories and for five million.
    """

    design: Design
    tables: dict[str, DataFrame]
    share: float

    def vectors(self, rows: DataFrame, training: bool = False) -> DataFrame:
        """Add ``features``. For the rows it was learnt on (``training``), a row's own fold is left out, so that
        no label finds its way into its own features. Missing numbers are -1, unseen categories the overall share."""
        wide = rows
        for name in self.design.columns:
            if name in self.tables:
                wide = self._category(wide, name, training)
            else:
                value = F.col(name).cast("double")
                wide = wide.withColumn(f"x_{name}", F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(MISSING)))
        names = [f"x_{name}" for name in self.design.columns]
        return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)

    def _category(self, rows: DataFrame, name: str, training: bool) -> DataFrame:
        rows = with_chunk(rows)
        folded = self.tables[name]
        sums = folded.groupBy("_category").agg(F.sum("_clicks").alias("_clicks"), F.sum("_positive").alias("_positive"))
        on = ["_category"]
        rows = rows.withColumn("_category", category(F.col(name)))
        if training:
            own = folded.select("_category", "_fold", F.col("_clicks").alias("_own_clicks"), F.col("_positive").alias("_own_positive"))
            sums = own.join(sums, "_category").select("_category", "_fold", (F.col("_clicks") - F.col("_own_clicks")).alias("_clicks"), (F.col("_positive") - F.col("_own_positive")).alias("_positive"))
            rows, on = rows.withColumn("_fold", fold()), ["_category", "_fold"]
        found = small_or_spread_lookup(rows, sums, on)
        clicks, positive = F.coalesce("_clicks", F.lit(0.0)), F.coalesce("_positive", F.lit(0.0))
        value = (positive + PRIOR_ROWS * self.share) / (clicks + PRIOR_ROWS)
        return found.withColumn(f"x_{name}", value).drop(*on, "_clicks", "_positive")


@dataclass
class Booster:
    """Fitted trees of which the first ``rounds`` count; ``scores`` are their AUCs on the validation rows, if any."""

    forest: boosting.Forest
    encoding: Encoding
    rounds: int
    scores: list[float] = field(default_factory=list)


def category(column: Column) -> Column:
    """Missing ids are a category of their own."""
    return F.coalesce(column.cast("string"), F.lit(""))


def fold() -> Column:
    return F.pmod(F.xxhash64("row_id", F.lit("fold")), F.lit(FOLDS)).cast("int")


def learn_encoding(rows: DataFrame, design: Design) -> Encoding:
    share = rows.agg(F.avg(F.col(TARGET).cast("double"))).first()[0] or 0.0
    tables = {}
    for name in design.columns:
        if name in design.categorical:
            counts = rows.groupBy(category(F.col(name)).alias("_category"), fold().alias("_fold"))
            tables[name] = cut_lineage(counts.agg(F.count("*").cast("double").alias("_clicks"), F.sum(F.col(TARGET).cast("double")).alias("_positive")))
    return Encoding(design, tables, share)


def growth_of(params: dict, seed: int) -> boosting.Growth:
    """Model parameters by their usual names -> how trees grow; those without a counterpart are named in a warning."""
    for name in sorted(set(params) & WITHOUT_EFFECT):
        warnings.warn(f"model parameter {name} has no counterpart and no effect", stacklevel=2)

    def given(default, *names):
        return next((params[name] for name in names if name in params), default)

    # rows are drawn anew for trees only if a frequency is given, or left out together with it
    share = given(1.0, "subsample", "bagging_fraction") if given(1, "subsample_freq", "bagging_freq") else 1.0
    return boosting.Growth(
        rate=given(0.1, "learning_rate"),
        leaves=given(31, "num_leaves") if "num_leaves" in params or params.get("max_depth", -1) <= 0 else 1 << min(params["max_depth"], DEEPEST),
        depth=max(params.get("max_depth", -1), 0),
        min_rows=max(given(20, "min_child_samples", "min_data_in_leaf"), 1),
        min_hessian=given(1e-3, "min_child_weight", "min_sum_hessian_in_leaf"),
        min_gain=float(given(0.0, "min_split_gain", "min_gain_to_split")),
        l1=float(given(0.0, "reg_alpha", "lambda_l1")),
        l2=float(given(0.0, "reg_lambda", "lambda_l2")),
        rows=share,
        features=given(1.0, "colsample_bytree", "feature_fraction"),
        bins=min(given(255, "max_bin"), boosting.BINS),
        positive=float(given(1.0, "scale_pos_weight")),
        seed=seed,
    )


def best_round(scores: list[float], patience: int | None) -> int:
    """The round (from 1) of the best score among those before ``patience`` rounds without a better one."""
    best = 0
    for i, value in enumerate(scores):
        if value > scores[best]:
            best = i
        elif patience and i - best >= patience:
            break
    return best + 1


def fit_with_validation(
    train: DataFrame, valid: DataFrame, design: Design, params: dict, rounds: int, seed: int, weight: str | None = None, patience: int | None = None
) -> Booster:
    """Fit on ``train``; the trees that count are those up to the round with the best AUC on ``valid``, where rounds after
    ``patience`` rounds without a better AUC are not looked at."""
    missing = [name for name in (*design.columns, TARGET, "row_id") if name not in train.columns or name not in valid.columns]
    if missing:
        raise ValueError(f"train and valid must both have the columns {missing}")
    if train.isEmpty() or valid.isEmpty():
        raise ValueError("the split left no rows to train or to validate on")
    encoding = learn_encoding(train, design)

    def measure(steps: DataFrame) -> list[float]:
        found = exact_auc(rounds_of(steps, "steps"), "margin", "label", ["iteration"])
        return [r["auc"] or 0.0 for r in sorted(found.collect(), key=lambda r: r["iteration"])]

    columns = ["row_id", TARGET, "features", *([weight] if weight else [])]
    wide = cut_lineage(encoding.vectors(train, training=True).select(*columns))
    checked = encoding.vectors(valid).select("row_id", TARGET, "features")
    forest, scores = boosting.boost(wide, TARGET, len(design.columns), growth_of(params, seed), rounds, weight, checked, patience, measure=measure)
    return Booster(forest, encoding, best_round(scores, patience), scores)


def fit_all(rows: DataFrame, design: Design, params: dict, rounds: int, seed: int, weight: str | None = None) -> Booster:
    encoding = learn_encoding(rows, design)
    wide = cut_lineage(encoding.vectors(rows, training=True).select("row_id", TARGET, "features", *([weight] if weight else [])))
    forest, _ = boosting.boost(wide, TARGET, len(design.columns), growth_of(params, seed), rounds, weight)
    return Booster(forest, encoding, len(forest.trees))


def score(booster: Booster, rows: DataFrame) -> DataFrame:
    """Add ``prediction``, the probability of a positive label."""
    margin = boosting.margin(booster.forest, booster.rounds, F.col("features"))
    return booster.encoding.vectors(rows).withColumn("prediction", 1 / (1 + F.exp(-margin))).select(*rows.columns, "prediction")


def rounds_of(rows: DataFrame, steps: str, *by: str) -> DataFrame:
    """One row per row and round: ``iteration`` from 1, and ``margin`` from the array ``steps`` of all rounds' margins."""
    kept = [*by, "label"]
    return rows.select(*kept, F.posexplode(steps).alias("_at", "margin")).select(*kept, (F.col("_at") + 1).alias("iteration"), "margin")


def running_margins(outputs: str, rows: DataFrame) -> DataFrame:
    """``rows`` with ``steps``: the running sums of the array ``outputs``, which has one number per tree."""

    @F.pandas_udf("array<double>")
    def sums(values: pd.Series) -> pd.Series:
        return values.map(np.cumsum)

    return rows.withColumn("steps", sums(F.col(outputs)))


def auc_per_round(rows: DataFrame, outputs: str, by=("set",)) -> DataFrame:
    """(by, iteration, auc) of the first 1, 2, ... trees, from ``label`` and the array ``outputs`` of what each tree adds."""
    return exact_auc(rounds_of(running_margins(outputs, rows), "steps", *by), "margin", "label", [*by, "iteration"])


def auc_history(booster: Booster, rows: DataFrame, by=("set",), only: int | None = None) -> DataFrame:
    """AUC of the first 1, 2, ... trees that count (or of the first ``only``) on each set: (by, iteration, auc)."""
    wide = booster.encoding.vectors(rows).select(*by, F.col(TARGET).alias("label"), "features")
    if only is not None:
        one = wide.withColumn("margin", boosting.margin(booster.forest, only, F.col("features"))).withColumn("iteration", F.lit(only))
        return exact_auc(one, "margin", "label", [*by, "iteration"])
    steps = wide.withColumn("steps", boosting.margins(booster.forest, booster.rounds, F.col("features")))
    return exact_auc(rounds_of(steps, "steps", *by), "margin", "label", [*by, "iteration"])


def feature_importance(booster: Booster, kind: str = "gain") -> dict[str, float]:
    """What each column adds to the trees that count, as shares: by ``gain``, or by the number of its cuts (``split``)."""
    columns = booster.encoding.design.columns
    sums = [0.0] * len(columns)
    for tree in booster.forest.trees[: booster.rounds]:
        for feature, gain in zip(tree.feature, tree.gain, strict=True):
            if feature >= 0:
                sums[feature] += gain if kind == "gain" else 1.0
    whole = sum(sums) or 1.0
    return {name: value / whole for name, value in zip(columns, sums, strict=True)}
