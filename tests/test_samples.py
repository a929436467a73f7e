import hashlib

from fixtures import SCHEMA, random_clicks

from clickmill.operators import sampling
from clickmill.operators.idmap import click_id_mapping, mapped_predictions, needed_clicks
from clickmill.sources.clicks import keep_after


def place(seed):
    return lambda r: (hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest(), r[0])


def test_bags_hold_all_positives_and_the_first_negatives(spark, monkeypatch):
    rows = random_clicks()
    clicks = spark.createDataFrame(rows, SCHEMA)
    for prefix in (1, 5):
        monkeypatch.setattr(sampling, "PREFIX", prefix)
        got = sampling.balanced_bags(clicks, [0, 1, 2]).collect()
        for seed in (0, 1, 2):
            positives = [r[0] for r in rows if r[7]]
            negatives = sorted((r for r in rows if not r[7]), key=place(seed))[: len(positives)]
            assert sorted(r.row_id for r in got if r.bag == seed) == sorted([*positives, *[r[0] for r in negatives]])


def test_bags_without_enough_rows(spark):
    rows = random_clicks()
    only_negative = spark.createDataFrame([(*r[:7], 0, *r[8:]) for r in rows], SCHEMA)
    assert sampling.balanced_bags(only_negative, [0]).count() == 0
    mostly_positive = spark.createDataFrame([(*r[:7], int(r[0] > 3), *r[8:]) for r in rows], SCHEMA)
    assert sampling.balanced_bags(mostly_positive, [0, 1]).count() == 800


def test_fraction_sample(spark):
    rows = random_clicks()
    got = sampling.fraction_sample(spark.createDataFrame(rows, SCHEMA), 0.1, 114514).collect()
    assert [r.row_id for r in got] == sorted(r[0] for r in sorted(rows, key=place(114514))[:40])


def test_mapping_keeps_the_last_old_click(spark):
    old = [(10 + i, i, 1, 1, 1, 1, 1 if i != 3 else 9, 100) for i in range(6)]
    new = [(70 + i, i, 1, 1, 1, 1, c, 100) for i, c in enumerate((1, 1, 9, 8))]
    schema = "click_id bigint, row_id bigint, ip int, app int, device int, os int, channel int, click_s bigint"
    old, new = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    mapping = click_id_mapping(old, new, chunk_rows=2)
    assert [r.old_click_id for r in mapping.collect()] == sorted(r.old_click_id for r in mapping.collect())
    assert sorted(map(tuple, mapping.collect())) == [(13, 72), (15, 70), (15, 71)]
    assert sorted(r.click_id for r in needed_clicks(old, mapping).collect()) == [13, 15]
    scores = spark.createDataFrame([(15, 0.5), (11, 0.25)], "click_id bigint, prediction double")
    assert sorted(map(tuple, mapped_predictions(mapping, scores).collect())) == [(70, 0.5), (71, 0.5)]


def test_without_train_clicks_the_whole_supplement_stays(spark):
    rows = spark.createDataFrame([(1, "2017-11-07 00:00:00"), (2, "2017-11-08 00:00:00")], "row_id bigint, click_time string")
    assert keep_after(rows, rows.limit(0)).count() == 2
    assert [r.row_id for r in keep_after(rows, rows.where("row_id = 2")).collect()] == [2]
