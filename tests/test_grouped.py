import numpy as np
import pytest
from fixtures import DAY, SCHEMA, per_row, random_clicks

from clickmill.functions.keys import KEYS, all_masks, feature_column
from clickmill.operators import grouped as G

MASKS = (("ip",), ("app",), ("device", "os"), ("ip", "device", "os"), KEYS)
INDEX = {key: 1 + i for i, key in enumerate(KEYS)}
W = 600


def ratio(labels):
    return float(np.float32(sum(labels) / len(labels))) if labels else -1.0


RULES = {
    "AllClickCount": lambda g, i: len(g),
    "HourlyClickCount": lambda g, i: sum(r[6] // 3600 % 24 == g[i][6] // 3600 % 24 for r in g),
    "CumulativeClickCount": lambda g, i: i,
    "CumulativeClickCountFuture": lambda g, i: len(g) - i - 1,
    "NextClickTimeDelta": lambda g, i: min(65534, g[i + 1][6] - g[i][6]) if i + 1 < len(g) else 65535,
    "PrevClickTimeDelta": lambda g, i: min(65534, g[i][6] - g[i - 1][6]) if i else 65535,
    f"FutureClickCount_{W}": lambda g, i: sum(r[6] <= g[i][6] + W for r in g[i:]),
    f"PastClickCount_{W}": lambda g, i: sum(r[6] >= g[i][6] - W for r in g[: i + 1]),
    f"FutureClickRatio_{W}": lambda g, i: float(np.float32(sum(r[6] <= g[i][6] + W for r in g[i:]) / len(g))),
    f"PastClickRatio_{W}": lambda g, i: float(np.float32(sum(r[6] >= g[i][6] - W for r in g[: i + 1]) / len(g))),
    "AverageAttributedRatio": lambda g, i: ratio([r[7] for r in g if g[i][6] - r[6] >= DAY]),
    "ExactSameClick": lambda g, i: len(g),
    "ExactSameClickId": lambda g, i: i,
    "NextApp": lambda g, i: g[i + 1][2] if i + 1 < len(g) else 65535,
    "PrevApp": lambda g, i: g[i - 1][2] if i else 65535,
    "NextChannel": lambda g, i: g[i + 1][5] if i + 1 < len(g) else 65535,
    "PrevChannel": lambda g, i: g[i - 1][5] if i else 65535,
}


def features():
    return [
        G.all_click_count(), G.hourly_click_count(), G.cumulative_click_count(),
        G.cumulative_click_count_future(), G.next_click_time_delta(), G.prev_click_time_delta(),
        G.future_click_count(W), G.past_click_count(W), G.future_click_ratio(W), G.past_click_ratio(W),
        G.average_attributed_ratio(), G.exact_same_click(), G.exact_same_click_id(),
        G.next_app(), G.prev_app(), G.next_channel(), G.prev_channel(),
    ]


@pytest.mark.parametrize("strategy", ["direct", "cells"])
def test_every_feature_follows_its_rule(spark, strategy):
    rows = random_clicks()
    shuffled = sorted(rows, key=lambda r: hash((r[0], 1)))
    clicks = spark.createDataFrame(shuffled, SCHEMA)
    got = G.add_grouped_features(clicks, features(), masks=MASKS, strategy=strategy, chunk_rows=37)
    result = {r["row_id"]: r for r in got.collect()}
    assert len(result) == len(rows)
    for feature in features():
        for mask in set(feature.masks) & set(MASKS):
            want = per_row(rows, lambda r: tuple(r[INDEX[k]] for k in mask), RULES[feature.name])
            name = feature_column(feature.name, mask)
            assert {i: r[name] for i, r in result.items()} == want, (strategy, name)


def test_cap_at_65535_and_compat_wrap(spark):
    clicks = spark.range(70000).selectExpr(
        "id row_id", "1 ip", "1 app", "1 device", "1 os", "1 channel", "100L click_s",
        "0 is_attributed", "cast(null as bigint) attributed_s", "true is_train",
    )
    wanted = [G.all_click_count(), G.cumulative_click_count(compat=True), G.exact_same_click(compat=True)]
    got = G.add_grouped_features(clicks, wanted, masks=[KEYS], strategy="cells", chunk_rows=9000)
    name = "_ip_app_dev_os_cha"
    row = got.where("row_id = 65537").first()
    assert row["AllClickCount" + name] == 65535
    assert row["CumulativeClickCount" + name] == 1
    assert row["ExactSameClick" + name] == 70000 % 256


def test_auto_takes_cells_only_for_hot_columns(spark):
    clicks = spark.createDataFrame(random_clicks(), SCHEMA)
    from clickmill.operators.frames import choose_strategies

    assert {how for how, _, _ in choose_strategies(clicks, all_masks())} == {"direct"}
    assert {how for how, _, _ in choose_strategies(clicks, all_masks(), limit=100)} == {"cells"}
    one_row = spark.createDataFrame(random_clicks(n=1), SCHEMA)
    assert G.add_grouped_features(one_row, [G.next_click_time_delta()], masks=[("ip",)]).first()[-1] == 65535
    assert G.add_grouped_features(clicks.limit(0), [G.all_click_count()], masks=[("ip",)]).count() == 0
