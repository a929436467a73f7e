"""Features by configuration name, and the place to add one's own.

A feature is a function from clicks to clicks with more columns. Grouped features are kept as
descriptions so that all those of a configuration are computed in one pass over the masks.

By default a name means what it says. ``compat`` restores four historic bindings: ``minute``
gave the second of the minute, ``second`` the minute of the hour, and both past ratios the
future ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmill.functions import clock
from clickmill.functions.keys import KEYS, feature_column
from clickmill.operators import grouped as G
from clickmill.operators import latent
from clickmill.operators.attribution import KINDS, add_median_attribute_time
from clickmill.operators.basic import COUNTS, add_basic_counts
from clickmill.operators.duplicates import add_duplicate_row_index_diff

TARGET = "is_attributed"


@dataclass(frozen=True)
class FeatureDef:
    name: str
    columns: tuple[str, ...]
    add: Callable[[DataFrame], DataFrame] | None = None
    grouped: G.GroupFeature | None = None
    categorical: tuple[str, ...] = ()


FEATURES: dict[str, FeatureDef] = {}
COMPAT: dict[str, FeatureDef] = {}


def feature(name: str, columns, categorical=()):
    """Register ``DataFrame -> DataFrame`` under ``name``; it must add ``columns``."""

    def keep(add):
        FEATURES[name] = FeatureDef(name, tuple(columns), add, categorical=tuple(categorical))
        return add

    return keep


def _grouped(name: str, description: G.GroupFeature, into=FEATURES):
    columns = tuple(feature_column(description.name, mask) for mask in description.masks)
    into[name] = FeatureDef(name, columns, grouped=description)


def _time(name: str, column: str, value, categorical=True, into=FEATURES):
    def add(clicks):
        return clicks.withColumn(column, value(F.col("click_s")))

    into[name] = FeatureDef(name, (column,), add, categorical=(column,) if categorical else ())


for _key in KEYS:
    feature(_key, [_key], [_key])(lambda clicks: clicks)
feature("ip_for_filtering", ["ip_for_filtering"])(lambda clicks: clicks.withColumn("ip_for_filtering", F.col("ip")))
feature("click_time", ["click_time"])(lambda clicks: clicks.withColumn("click_time", F.col("click_s")))
feature(TARGET, [TARGET])(lambda clicks: clicks.withColumn(TARGET, F.coalesce(TARGET, F.lit(0))))
_time("hour", "hour", clock.hour_of_day)
_time("minute", "minute", clock.minute_of_hour)
_time("second", "second", clock.second_of_minute)
_time("minute", "second", clock.second_of_minute, into=COMPAT)
_time("second", "minute", clock.minute_of_hour, into=COMPAT)
_time("zero-minute", "zero_minute", clock.zero_minute, categorical=False)
feature("count", COUNTS)(add_basic_counts)
feature("duplicated_row_index_diff", ["DuplicateRowIndexDiff"])(add_duplicate_row_index_diff)

# Names carry minutes, windows are seconds.
_WINDOWS = {"1": 60, "10": 600, "80": 4800}
for _label, _seconds in _WINDOWS.items():
    _grouped(f"future_click_count_{_label}", G.future_click_count(_seconds))
    if _label == "1":
        continue
    _grouped(f"past_click_count_{_label}", G.past_click_count(_seconds))
    _grouped(f"future_click_ratio_{_label}", G.future_click_ratio(_seconds))
    _grouped(f"past_click_ratio_{_label}", G.past_click_ratio(_seconds))
    _grouped(f"past_click_ratio_{_label}", G.future_click_ratio(_seconds), into=COMPAT)
for _make in (
    G.next_click_time_delta, G.prev_click_time_delta, G.exact_same_click, G.exact_same_click_id,
    G.all_click_count, G.hourly_click_count, G.average_attributed_ratio, G.cumulative_click_count,
    G.cumulative_click_count_future, G.next_app, G.prev_app, G.next_channel, G.prev_channel,
):
    _grouped(_make.__name__, _make())
for _make in (G.exact_same_click, G.exact_same_click_id, G.cumulative_click_count):
    _grouped(_make.__name__, _make(compat=True), into=COMPAT)
for _kind, (_title, _) in KINDS.items():
    _suffix = "" if _kind == "all" else f"_{_kind}"
    feature(f"median_attribute_time{_suffix}", [feature_column(_title, m) for m in G.all_masks()])(
        lambda clicks, kind=_kind: add_median_attribute_time(clicks, kind)
    )
for _name, _spec in latent.SPECS.items():
    feature(_name, [f"{_spec.name}_{a}_{b}_{i}" for a, b in _spec.pairs for i in range(_spec.width)])(
        lambda clicks, spec=_spec: latent.add_latent_vectors(clicks, spec)
    )
feature("single_pca_count", [f"SinglePCACount_{i}" for i in range(30)])(latent.add_one_hot_svd)
feature("single_pca_tfidf", [f"SinglePCATfIdf_{i}" for i in range(30)])(
    lambda clicks: latent.add_one_hot_svd(clicks, weighted=True)
)
feature("user_item_lda_30", [f"UserItemLDA_{i}" for i in range(30)])(latent.add_user_item_lda)
feature("item_user_lda_30", [f"ItemUserLDA_{i}" for i in range(30)])(latent.add_item_user_lda)


def resolve(names, compat: bool = False) -> list[FeatureDef]:
    """The features of a configuration; an unknown name is an error."""
    unknown = [name for name in names if name not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    return [(COMPAT.get(name) if compat else None) or FEATURES[name] for name in names]


def add_features(clicks: DataFrame, names, compat: bool = False, masks=None, strategy: str = "auto") -> DataFrame:
    """Clicks with the columns of all named features; ``masks`` limits the grouped ones."""
    chosen = resolve(names, compat)
    descriptions = [f.grouped for f in chosen if f.grouped]
    rows = clicks
    if descriptions:
        rows = G.add_grouped_features(rows, descriptions, masks, strategy)
    for item in chosen:
        if item.add:
            rows = item.add(rows)
    return rows


def grouped_apply(clicks: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str):
    """Way out for a custom group rule in pandas. Each group must fit the memory of one task; rules for groups that do
    not are to be stated with ``frames.add_needs``."""
    return clicks.groupBy(*keys).applyInPandas(function, schema)
