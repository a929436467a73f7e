"""A whole experiment from a configuration: features, bags, models, submission, result log."""

from __future__ import annotations

import hashlib
import json
import time
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmill.operators.idmap import mapped_predictions, needed_clicks
from clickmill.operators.sampling import bag_rows, balanced_bags
from clickmill.plans import dataset, scoring, training
from clickmill.plans.registry import TARGET, add_features, resolve
from clickmill.session import cut_lineage
from clickmill.sources.clicks import stack
from clickmill.sources.store import FeatureStore, bag_summary, result_log, write_result_log, write_submission

# Options found in configurations that never had an effect.
IGNORED = ("higher_train_weight", "validation_ratio", "full_data_train")


@dataclass
class Outcome:
    trials: list[dict]
    summary: dict
    submission: DataFrame | None = None
    bag_predictions: DataFrame | None = None
    models: list = field(default_factory=list)


def input_names(*logs: DataFrame) -> list[str]:
    """What identifies the logs: their files, with the number of rows and a sum of row hashes, which also tells apart
    other rows of the same files."""
    names = []
    for log in logs:
        whole = log.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*log.columns).cast("decimal(38,0)")).alias("h")).first()
        names += [*sorted(log.inputFiles()), f"{whole.n}:{whole.h}"]
    return names


def feature_table(clicks: DataFrame, config: dict, compat: bool, masks=None) -> DataFrame:
    """row_id, click_id and is_train with every column the models and the splits need."""
    names = list(dict.fromkeys([*config["features"], "hour", TARGET, *dataset.FILTER_COLUMNS]))
    table = add_features(clicks, names, compat, masks)
    columns = list(dict.fromkeys([*model_columns(config, compat, masks), "hour", TARGET, *dataset.FILTER_COLUMNS]))
    return table.select("row_id", "click_id", "is_train", *columns)


def model_columns(config: dict, compat: bool, masks=None) -> list[str]:
    from clickmill.functions.keys import feature_column

    columns = []
    for item in resolve(config["features"], compat):
        if item.grouped:
            wanted = [m for m in item.grouped.masks if masks is None or m in masks]
            columns += [feature_column(item.grouped.name, m) for m in wanted]
        else:
            columns += item.columns
    return columns


def run_experiment(
    config: dict,
    train: DataFrame,
    test: DataFrame,
    cache: str,
    mapping: DataFrame | None = None,
    output: str | None = None,
    name: str = "experiment",
    compat: bool = False,
    train_only: bool = False,
    validation_start: str | None = None,
    masks=None,
    inputs: Iterable[str] | None = None,
) -> Outcome:
    """Run ``config`` on typed clicks.

    Stored features are reused only for the same ``inputs``: names of the data that the caller vouches for, or by default
    the files that the two logs are read from. Logs that come from no file are told apart by a digest of their rows.

    Features are computed on the full log and stored; bags select rows from that table only
    afterwards. Without ``negative_down_sampling.enabled`` there is one bag with all rows.
    """
    spark = train.sparkSession
    sampling = config["dataset"]["negative_down_sampling"]
    for option in IGNORED:
        if option in config or option in config["dataset"] or option in config["model"]:
            warnings.warn(f"option {option} has no effect", stacklevel=2)
    design = training.Design(
        tuple(model_columns(config, compat, masks)),
        tuple(c for item in resolve(config["features"], compat) for c in item.categorical),
    )
    clicks = stack(train.withColumn("click_id", F.lit(None).cast("bigint")), test)
    store = FeatureStore(spark, cache, inputs if inputs is not None else input_names(train, test))
    key = hashlib.md5(json.dumps([sorted(config["features"]), compat, masks and sorted(masks)]).encode())
    table = store.get(f"table-{key.hexdigest()[:10]}", lambda: feature_table(clicks, config, compat, masks))

    seeds = list(range(sampling["bagging_size"])) if sampling["enabled"] else [0]
    labelled = table.where("is_train")
    bags = balanced_bags(labelled, seeds) if sampling["enabled"] else labelled.select(F.lit(0).alias("bag"), "row_id")
    sampled = cut_lineage(bag_rows(labelled, bags))
    start = validation_start or (
        dataset.V2_VALIDATION_START if config.get("v2_validation") else dataset.VALIDATION_START
    )
    hours = config.get("test_hours", {})
    weight = "weight" if hours.get("filter_validation") else None
    test_rows = None
    if not train_only:
        test_rows = table.where("NOT is_train")
        test_rows = needed_clicks(test_rows, mapping) if mapping is not None else test_rows

    outcome, predictions = Outcome([], {}), []
    params = config["model"].get("model_params", {})
    train_params = config["model"].get("train_params", {})
    rounds, patience = train_params.get("num_boost_round", 100), train_params.get("early_stopping_rounds")
    for seed in seeds:
        began = time.time()
        rows = sampled.where(F.col("bag") == seed)
        if config.get("only_test_ips"):
            rows = dataset.only_test_ips(rows)
        rows = dataset.with_hour_weight(rows, hours.get("train_weight", 1.0)) if weight else rows
        fit_rows, valid = dataset.time_split(rows, start, "click_time")
        # only training rows are weighted
        valid = dataset.in_test_hours(valid).withColumn(weight, F.lit(1.0)) if weight else valid
        model = training.fit_with_validation(fit_rows, valid, design, params, rounds, seed, weight, patience)
        best = model.rounds
        both = fit_rows.withColumn("set", F.lit("train")).unionByName(valid.withColumn("set", F.lit("valid")))
        history = training.auc_history(model, both, only=best)
        auc = {r["set"]: r["auc"] for r in history.collect()}
        if not train_only:
            model = training.fit_all(rows, design, params, best, seed, weight)
            scored = training.score(model, test_rows)
            predictions.append(scored.select(F.lit(seed).alias("bag"), "click_id", "prediction"))
        outcome.models.append(model)
        outcome.trials.append(
            {
                "train_auc": auc.get("train"),
                "valid_auc": auc.get("valid"),
                "best_iteration": best,
                "train_time": time.time() - began,
                "feature_importance": training.feature_importance(model),
                "feature_splits": training.feature_importance(model, "split"),
            }
        )

    schema = "train_auc double, valid_auc double, train_time double"
    trials = spark.createDataFrame(
        [(t["train_auc"], t["valid_auc"], t["train_time"]) for t in outcome.trials], schema
    )
    outcome.summary = bag_summary(trials).first().asDict()
    if predictions:
        every = predictions[0]
        for more in predictions[1:]:
            every = every.unionByName(more)
        every = cut_lineage(every)
        outcome.bag_predictions = every
        if mapping is not None:
            old_ids = every.groupBy("click_id").agg(F.collect_list(F.struct("bag", "prediction")).alias("_bags"))
            new_ids = mapped_predictions(mapping, old_ids)
            every = new_ids.select("click_id", F.explode("_bags").alias("_b")).select("_b.bag", "click_id", "_b.prediction")
        average = scoring.rank_average if config.get("rank_average") else scoring.mean_prediction
        outcome.submission = average(every)
    if output:
        text = result_log(outcome.trials, outcome.summary, config)
        write_result_log(spark, text, f"{output}/{name}.result.json")
        if outcome.submission is not None:
            write_submission(outcome.submission, f"{output}/{name}.submission.csv")
    return outcome
