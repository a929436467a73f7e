import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from fixtures import DAY
from pyspark.sql import functions as F

from clickmill.operators.ranks import exact_auc, number_rows, tied_ranks
from clickmill.plans import registry, scoring, training
from clickmill.plans.experiment import input_names, run_experiment
from clickmill.session import scratch_path
from clickmill.sources import clicks as C
from clickmill.sources.store import FeatureStore, assemble

SPLIT = "2017-11-08 16:00:00"


def learnable(spark, n=1200):
    """App 12 converts often; the last day before the test is the validation part."""
    rng = random.Random(5)
    end = 1510156800 + DAY
    times = sorted(rng.randrange(end - 4 * DAY, end) for _ in range(n))
    rows = []
    for i, t in enumerate(times):
        app = rng.choice([10, 11, 12, 13])
        label = int(rng.random() < (0.7 if app == 12 else 0.1))
        rows.append((i, rng.randrange(40), app, rng.randrange(2), rng.randrange(5), rng.randrange(100, 120), t, label, t + 60 if label else None))
    schema = "row_id bigint, ip int, app int, device int, os int, channel int, click_s bigint, is_attributed int, attributed_s bigint"
    train = spark.createDataFrame(rows, schema)
    test = [(i, 5000 + i, *r[1:6], end + 10 * i) for i, r in enumerate(rows[:200])]
    test = spark.createDataFrame(
        test, "row_id bigint, click_id bigint, ip int, app int, device int, os int, channel int, click_s bigint"
    )
    return train, test


CONFIG = {
    "features": ["app", "os", "hour", "count", "future_click_count_10", "prev_click_time_delta", "duplicated_row_index_diff"],
    "model": {
        "name": "lightgbm",
        "model_params": {"learning_rate": 0.3, "max_depth": 3, "min_child_samples": 5},
        "train_params": {"num_boost_round": 3, "early_stopping_rounds": 2},
    },
    "dataset": {"negative_down_sampling": {"enabled": True, "bagging_size": 2, "random_state": 1}},
    "test_hours": {"filter_validation": True, "train_weight": 2.0},
    "rank_average": True,
}


def test_experiment_from_configuration_to_submission(spark):
    train, test = learnable(spark)
    mapping = test.where("click_id < 5150").selectExpr("click_id AS old_click_id", "click_id - 5000 AS new_click_id")
    output = scratch_path(spark, "output")
    outcome = run_experiment(
        CONFIG, train, test, scratch_path(spark, "cache"), mapping, output, masks=[("ip",), ("app", "device")]
    )
    assert len(outcome.trials) == 2 and all(t["valid_auc"] > 0.6 for t in outcome.trials)
    importance = outcome.trials[0]["feature_importance"]
    assert max(importance, key=importance.get) == "app"
    scores = {r.click_id: r.is_attributed for r in outcome.submission.collect()}
    assert sorted(scores) == list(range(150)) and all(0 < s <= 1 for s in scores.values())
    written = spark.read.option("header", True).csv(f"{output}/experiment.submission.csv")
    assert written.columns == ["click_id", "is_attributed"] and written.count() == 150
    log = json.loads(spark.read.text(f"{output}/experiment.result.json", wholetext=True).first()[0])
    assert log["config"] == CONFIG and len(log["training"]["trials"]) == 2


def test_unknown_feature_is_refused():
    with pytest.raises(ValueError, match="nonsense"):
        registry.resolve(["hour", "nonsense"])


def test_names_mean_what_they_say_unless_compat():
    assert registry.resolve(["minute"])[0].columns == ("minute",)
    assert registry.resolve(["minute"], compat=True)[0].columns == ("second",)
    assert registry.resolve(["past_click_ratio_10"], compat=True)[0].grouped.name == "FutureClickRatio_600"
    assert len(registry.FEATURES) == 35 + 20 + 4  # plus the four neighbour features that had no name


def test_own_features_and_group_rules(spark):
    train, _ = learnable(spark, 50)

    @registry.feature("late", ["late"])
    def late(clicks):
        return clicks.selectExpr("*", "click_s > 1510000000 AS late")

    try:
        assert "late" in registry.add_features(train, ["late", "hour"]).columns
    finally:
        del registry.FEATURES["late"]
    got = registry.grouped_apply(train, ["app"], lambda g: g[["row_id"]].head(1), "row_id bigint")
    assert got.count() == train.select("app").distinct().count()


def test_rank_average_and_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(b, i, rng.randrange(20) / 20, rng.randrange(2)) for b in range(2) for i in range(300)]
    frame = spark.createDataFrame(rows, "bag int, click_id bigint, prediction double, label int")
    ranks = {(r.bag, r.prediction): r["rank"] for r in tied_ranks(frame, "prediction", ["bag"], buckets=4).collect()}
    for bag in range(2):
        values = sorted(r[2] for r in rows if r[0] == bag)
        for v in set(values):
            first = values.index(v) + 1
            assert ranks[(bag, v)] == first + (values.count(v) - 1) / 2
    want = {i: sum(ranks[(b, p)] for b, j, p, _ in rows if j == i) / 2 / 300 for i in range(300)}
    got = {r.click_id: r.is_attributed for r in scoring.rank_average(frame, chunk_rows=50).collect()}
    assert all(math.isclose(got[i], want[i]) for i in want)
    auc = {r.bag: r.auc for r in exact_auc(frame, "prediction", "label", ["bag"], buckets=4).collect()}
    for bag in range(2):
        pos = [r[2] for r in rows if r[0] == bag and r[3]]
        neg = [r[2] for r in rows if r[0] == bag and not r[3]]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert math.isclose(auc[bag], wins / len(pos) / len(neg))
    assert exact_auc(frame.where("label = 1"), "prediction", "label", ["bag"]).first()["auc"] is None
    assert tied_ranks(frame.limit(0), "prediction", ["bag"]).count() == 0


def test_csv_rows_keep_their_position(spark):
    path = scratch_path(spark, "csv")
    lines = [f"{i % 7},1,2,3,4,2017-11-0{1 + i // 400} 00:00:{i % 60:02d},,{i % 2}" for i in range(1000)]
    header = "ip,app,device,os,channel,click_time,attributed_time,is_attributed"
    for part in range(4):
        text = "\n".join([header, *lines[part * 250 : part * 250 + 250]])
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{part}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = C.typed_clicks(C.read_train_csv(spark, f"{path}/*"), True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.row_id for r in rows) == list(range(1000))
    assert all(r.ip == r.row_id % 7 and r.is_attributed == r.row_id % 2 for r in rows)


def test_missing_values_read_as_zero(spark):
    raw = spark.createDataFrame([(0, None, 1, 1, 1, None, None)], "row_id bigint, ip int, app int, device int, os int, channel int, click_time timestamp_ntz")
    row = C.typed_clicks(raw, False).first()
    assert (row.ip, row.channel, row.click_s, row.is_attributed) == (0, 0, 0, 0)


def test_store_reuses_and_assemble_checks(spark):
    store = FeatureStore(spark, scratch_path(spark, "store"), ["a", "b"])
    first = store.get("x", lambda: spark.range(5).selectExpr("id AS row_id", "id AS x"))
    again = store.get("x", lambda: pytest.fail("must not be computed twice"))
    assert first.count() == again.count() == 5
    with pytest.raises(ValueError):
        assemble([first, spark.range(4).selectExpr("id AS row_id", "id AS y")])


def test_another_log_has_another_key(spark):
    train, test = learnable(spark, 60)
    same, other = learnable(spark, 60)[0], train.where("row_id < 59")
    assert input_names(train, test) == input_names(same, test)
    assert input_names(train, test) != input_names(other, test)
    path = scratch_path(spark, "log")
    train.write.parquet(path)
    read = spark.read.parquet(path)
    assert set(read.inputFiles()) < set(input_names(read)) and input_names(read) != input_names(read.where("row_id > 0"))


def test_rows_are_numbered_densely(spark):
    rows = spark.range(1000).selectExpr("1000 - id AS a", "id % 3 AS b")
    got = number_rows(rows, ["b", "a"]).orderBy("b", "a").collect()
    assert [r.row_id for r in got] == list(range(1000))


def test_best_round_by_score_and_patience():
    assert training.best_round([0.5, 0.6, 0.6, 0.55, 0.7], None) == 5
    assert training.best_round([0.5, 0.6, 0.6, 0.55, 0.7], 2) == 2
    assert training.best_round([0.5, 0.6, 0.6, 0.55, 0.7], 3) == 5
    assert training.best_round([0.5], 1) == 1


def test_small_learning_rates_keep_many_trees(spark):
    rng = random.Random(7)
    names = [f"f{k}" for k in range(6)]
    rows = []
    for i in range(4000):
        values, ip = [rng.random() for _ in names], rng.randrange(300)
        odds = sum(v > 0.5 for v in values) / 8 + 0.2 * (ip % 7 == 0)
        rows.append((i, *values, ip, int(rng.random() < odds), i % 4 == 0))
    frame = spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"{n} double" for n in names) + ", ip int, is_attributed int, valid boolean")
    train, valid = frame.where("NOT valid"), frame.where("valid")
    design = training.Design((*names, "ip"), ("ip",))
    params = {"learning_rate": 0.03, "max_depth": 2, "reg_lambda": 1.0, "subsample_for_bin": 10}
    with pytest.warns(UserWarning, match="subsample_for_bin"):
        model = training.fit_with_validation(train, valid, design, params, 15, 0, patience=10)
    history = {r["iteration"]: r["auc"] for r in training.auc_history(replace(model, rounds=len(model.forest.trees)), valid.withColumn("set", F.lit("v"))).collect()}
    assert [history[i + 1] for i in range(len(history))] == pytest.approx(model.scores) and history[model.rounds] == max(history.values())
    assert model.rounds > 5
    scores = {r.row_id: r.prediction for r in training.score(model, valid).collect()}
    assert len(scores) == 1000 and all(0 < s < 1 for s in scores.values())
    assert all(abs(sum(training.feature_importance(model, kind).values()) - 1) < 1e-9 for kind in ("gain", "split"))


def test_fit_stops_by_patience(spark):
    """One feature says all there is to say, so later trees only learn noise."""
    rng = random.Random(3)
    rows = [(i, float(i % 2), rng.random(), int(rng.random() < (0.8 if i % 2 else 0.2)), i % 3 == 0) for i in range(1500)]
    frame = spark.createDataFrame(rows, "row_id bigint, a double, noise double, is_attributed int, valid boolean")
    params = {"learning_rate": 0.5, "num_leaves": 8, "min_child_samples": 1}
    model = training.fit_with_validation(frame.where("NOT valid"), frame.where("valid"), training.Design(("a", "noise")), params, 1000, 0, patience=6)
    assert len(model.forest.trees) == len(model.scores) == model.rounds + 6
    assert model.scores.index(max(model.scores)) == model.rounds - 1


def plain_tree(x, g, h, leaves, min_rows):
    """Level by level: every cut of every leaf is tried; the best ones come first while leaves are left."""
    level, cuts, count = [list(range(len(x)))], [], 1
    while level and count < leaves:
        best = []
        for rows in level:
            G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
            options = []
            for f in range(len(x[0])):
                for v in sorted({x[i][f] for i in rows})[:-1]:
                    left = [i for i in rows if x[i][f] <= v]
                    if min(len(left), len(rows) - len(left)) >= min_rows:
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        options.append((gl * gl / hl + (G - gl) ** 2 / (H - hl) - G * G / H, f, v, left, [i for i in rows if x[i][f] > v]))
            if options:
                best.append(max(options, key=lambda o: (round(o[0], 9), -o[1], -o[2])))
        level = []
        for gain, f, v, left, right in sorted(best, key=lambda o: -o[0])[: leaves - count]:
            if gain > 0:
                cuts.append((f, v, round(gain, 6)))
                level += [left, right]
                count += 1
    return cuts


def test_trees_are_those_of_a_plain_search(spark):
    rng = random.Random(8)
    x = [[rng.randrange(12), rng.randrange(5), rng.random()] for _ in range(300)]
    y = [int(rng.random() < (0.8 if a > 6 and b < 2 or c > 0.8 else 0.2)) for a, b, c in x]
    rows = [(i, float(a), float(b), c, y[i]) for i, (a, b, c) in enumerate(x)]
    frame = spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, is_attributed int").repartition(5)
    params = {"learning_rate": 0.2, "num_leaves": 6, "min_child_samples": 10, "max_bin": 256, "min_child_weight": 0}
    model = training.fit_all(frame, training.Design(("a", "b", "c")), params, 3, 0)
    margin = [math.log(sum(y) / (300 - sum(y)))] * 300
    edges = model.forest.edges
    cut = [[float(edges[f][k]) if (k := int((edges[f] < v).sum())) < len(edges[f]) else math.inf for f, v in enumerate(r)] for r in x]
    for tree in model.forest.trees:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        want = plain_tree(cut, [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], 6, 10)
        got = [(f, float(edges[f][k]), round(gain, 6)) for f, k, gain in zip(tree.feature, tree.last, tree.gain) if f >= 0]
        assert sorted(got) == sorted(want) and sum(f < 0 for f in tree.feature) == 6
        bins = model.forest.binned(np.array(x, float))
        margin = [m + o for m, o in zip(margin, tree.outputs(bins))]
    scored = {r.row_id: r.prediction for r in training.score(model, frame).collect()}
    assert all(math.isclose(scored[i], 1 / (1 + math.exp(-m)), rel_tol=1e-9) for i, m in enumerate(margin))


def test_auc_of_many_rounds(spark):
    rng = random.Random(1)
    rows = [(s, int(rng.random() < 0.4), [float(rng.randrange(-3, 4)) for _ in range(30)]) for s in ("train", "valid") for _ in range(120)]
    got = {(r["set"], r.iteration): r.auc for r in training.auc_per_round(spark.createDataFrame(rows, "set string, label int, outputs array<double>"), "outputs").collect()}
    assert len(got) == 60
    for (name, k), auc in got.items():
        values = [(sum(o[:k]), label) for s, label, o in rows if s == name]
        pos, neg = ([v for v, label in values if label == c] for c in (1, 0))
        assert math.isclose(auc, sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


def test_categories_count_without_their_own_fold(spark):
    rows = [(i, i % 3, int(i % 3 == 0)) for i in range(300)] + [(1000, 9, 1)]
    frame = spark.createDataFrame(rows, "row_id bigint, app int, is_attributed int")
    encoding = training.learn_encoding(frame, training.Design(("app",), ("app",)))
    own = {r.row_id: r.features[0] for r in encoding.vectors(frame, training=True).collect()}
    share = 101 / 301
    assert math.isclose(own[1000], share)  # its only click is its own
    assert own[0] > 0.7 > 0.2 > own[1]
    later = {r.row_id: r.features[0] for r in encoding.vectors(frame.withColumn("row_id", F.col("row_id") + 5000)).collect()}
    assert math.isclose(later[6000], (1 + 20 * share) / 21) and math.isclose(later[5001], 20 * share / 120)
