"""What the plans must look like, whatever the data."""

import re

import pytest
from fixtures import SCHEMA, random_clicks

from clickmill.operators import frames
from clickmill.operators import grouped as G
from clickmill.operators.attribution import add_median_attribute_time
from clickmill.operators.basic import add_basic_counts
from clickmill.operators.duplicates import add_duplicate_row_index_diff


@pytest.fixture
def clicks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.createDataFrame(random_clicks(), SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df):
    """(input columns, partitioning) of every shuffle of the plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (\w+\(.*?\)),", text)


def row_shuffles(df):
    return [how for columns, how in shuffles(df) if "row_id" in columns]


@pytest.mark.parametrize(
    "add",
    [
        lambda c: G.add_grouped_features(
            c, [G.future_click_count(600), G.next_app(), G.hourly_click_count()], None, "cells", 50
        ),
        lambda c: add_basic_counts(c, "cells", 50),
        lambda c: add_duplicate_row_index_diff(c, 50),
    ],
)
def test_cells_move_clicks_once_and_only_by_chunk(clicks, add):
    moved = row_shuffles(add(clicks))
    # Self-joins at the end may list the one shuffle of the clicks again, with fewer columns.
    assert moved and all(re.match(r"hashpartitioning\(chunk#\d+L, 8\)", how) for how in moved)
    assert len(moved) <= 2


def test_medians_by_cells_move_clicks_only_by_chunk(clicks):
    moved = row_shuffles(add_median_attribute_time(clicks, "past", [("app",)], "cells", 50))
    assert moved and all(re.match(r"hashpartitioning\(chunk#\d+L, 8\)", how) for how in moved)


@pytest.mark.parametrize("kind", ["all", "past", "past_v2"])
def test_medians_by_cells_shuffle_the_clicks_once_for_all_masks(clicks, kind):
    masks = [("app",), ("os",), ("app", "os")]
    moved = shuffles(add_median_attribute_time(clicks, kind, masks, "cells", 50))
    # Other rows with row ids are those of labelled clicks, which need click_s and attributed_s, but no is_train.
    assert len([how for columns, how in moved if "is_train" in columns]) == 1
    assert sum("is_attributed" in columns and "_n" not in columns for columns, how in moved if "is_train" not in columns) == 0


def test_long_logs_are_laid_out_by_their_rows(spark, clicks, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 25)
    monkeypatch.setattr(frames.layout_parts, "__defaults__", (100,))
    monkeypatch.setattr(frames.choose_strategies, "__defaults__", (390,))
    for out in (
        G.add_grouped_features(clicks, [G.all_click_count()], [("ip",), ("ip", "app")]),
        add_median_attribute_time(clicks, "past", [("ip",), ("ip", "app")]),
    ):
        moved = [how for columns, how in shuffles(out)]
        assert moved and all(re.match(r"hashpartitioning\(ip#\d+, 16\)", how) for how in moved)
    assert frames.layout_parts(clicks) == 16  # 400 rows


def test_direct_masks_of_one_leading_column_share_a_shuffle(clicks):
    out = G.add_grouped_features(clicks, [G.future_click_count(600), G.all_click_count()], None, "direct")
    assert len(shuffles(out)) == 5
