import math

import pytest
from fixtures import DAY, SCHEMA, groups, middle, per_row, random_clicks
from test_grouped import INDEX, MASKS

from clickmill.functions.keys import feature_column
from clickmill.operators.attribution import KINDS, add_median_attribute_time
from clickmill.operators.basic import add_basic_counts
from clickmill.operators.duplicates import add_duplicate_row_index_diff
from clickmill.operators.frames import add_needs, cell_values, hidden


def delays(rows):
    return [r[8] - r[6] for r in rows if r[7]]


def v2(g, i):
    return middle(delays([r for r in g[:i] if g[i - 1][6] - r[6] >= DAY])) if i else 65535


RULES = {
    "all": lambda g, i: middle(delays(g)),
    "past": lambda g, i: middle(delays(g[:i])),
    "past_v2": v2,
}


@pytest.mark.parametrize("strategy", ["direct", "cells"])
@pytest.mark.parametrize("kind", list(KINDS))
def test_middle_in_click_order(spark, kind, strategy):
    rows = random_clicks()
    clicks = spark.createDataFrame(rows, SCHEMA)
    masks = MASKS[:3]
    got = add_median_attribute_time(clicks, kind, masks, strategy, chunk_rows=37).collect()
    assert len(got) == len(rows)
    for mask in masks:
        want = per_row(rows, lambda r: tuple(r[INDEX[k]] for k in mask), RULES[kind])
        name = feature_column(KINDS[kind][0], mask)
        assert {r["row_id"]: r[name] for r in got} == want, (strategy, name)


def test_true_median(spark):
    rows = random_clicks()
    clicks = spark.createDataFrame(rows, SCHEMA)
    got = add_median_attribute_time(clicks, "all", [("app",)], "direct", true_median=True).collect()
    want = per_row(rows, lambda r: r[2], lambda g, i: middle(sorted(delays(g))))
    assert {r["row_id"]: r["MedianAttributeTime_app"] for r in got} == want


@pytest.mark.parametrize("strategy", ["direct", "cells"])
def test_basic_counts(spark, strategy):
    rows = random_clicks()
    got = add_basic_counts(spark.createDataFrame(rows, SCHEMA), strategy, chunk_rows=37).collect()
    hourly = per_row(rows, lambda r: (r[1], r[6] // 3600), lambda g, i: len(g))
    by_app = per_row(rows, lambda r: (r[1], r[2]), lambda g, i: len(g))
    by_os = per_row(rows, lambda r: (r[1], r[2], r[4]), lambda g, i: len(g))
    for r in got:
        assert (r.n_channels, r.ip_app_count, r.ip_app_os_count) == (
            hourly[r.row_id], by_app[r.row_id], by_os[r.row_id],
        )


def duplicate_rule(rows):
    out = {}
    for train in (True, False):
        table = sorted((r for r in rows if r[9] == train), key=lambda r: r[0])
        copies = groups(table, lambda r: r[1:7])
        previous = start = None
        for r in table:
            if len(copies[r[1:7]]) > 1:
                if r[1:7] != previous:
                    start = r[0]
                out[r[0]], previous = float(r[0] - start), r[1:7]
    return out


@pytest.mark.parametrize("chunk_rows", [1, 2, 7, 64, 1000])
def test_duplicate_runs(spark, chunk_rows):
    keys = {"A": (1, 1, 1, 1, 1), "B": (2, 1, 1, 1, 1), "C": (3, 1, 1, 1, 1)}
    rows = [(i, *keys[c], 50, 0, None, i < 13) for i, c in enumerate("AABABBCAAAAAABBBCA")]
    rows += [(100 + r[0], *r[1:]) for r in random_clicks(n=150, span=2, hot=0.7)]
    got = add_duplicate_row_index_diff(spark.createDataFrame(rows, SCHEMA), chunk_rows).collect()
    assert len(got) == len(rows)
    found = {r.row_id: r.DuplicateRowIndexDiff for r in got if not math.isnan(r.DuplicateRowIndexDiff)}
    assert found == duplicate_rule(rows)


@pytest.mark.parametrize("kind", list(KINDS))
def test_values_asked_by_cells_are_those_of_the_clicks(spark, kind):
    source = spark.createDataFrame(random_clicks(), SCHEMA).selectExpr("*", "row_id div 37 AS chunk")
    need, keys = KINDS[kind][1], ["app", "os"]
    asked = {tuple(r) for r in cell_values(source, "x", keys, need).collect()}
    rows = add_needs(source, "x", keys, [need], "direct", source).select("chunk", *keys, hidden(need, "x"))
    want = {tuple(r) for r in rows.collect()}
    assert want <= asked
    assert len(asked) <= len(want) * (1 if kind == "all" else 3)
