"""The grouped click features: counts, windows, neighbours and attribution history.

Each feature is a few lines stating what it needs from its key group (see ``frames``) and how
its value follows. All features of a mask are computed together, so they share sorts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmill.functions.clock import DAY, hour_of_day
from clickmill.functions.keys import ALL_KEYS, all_masks, feature_column, mask_suffix
from clickmill.operators.frames import Before, Need, Neighbour, Total, UpTo, add_needs, by_column, choose_strategies, hidden, layout_parts
from clickmill.operators.lookup import CHUNK_ROWS, with_chunk

# Counts saturate at CAP, 65535 also marks "none", real values stop below it.
CAP = 65535
NONE = 65535
LARGEST = 65534
NO_HISTORY = -1.0

NEXT_APP_MASKS = (("ip", "device", "os"), ("ip", "device", "os", "channel"))
NEXT_CHANNEL_MASKS = (("ip", "device", "os"), ("ip", "app", "device", "os"))


@dataclass(frozen=True)
class GroupFeature:
    name: str
    needs: tuple[Need, ...]
    value: Callable[..., Column]
    masks: tuple[tuple[str, ...], ...] = tuple(all_masks())
    by_hour: bool = False

    def column_for(self, mask, tag: str) -> Column:
        needs = [F.col(hidden(need, tag)) for need in self.needs]
        return self.value(*needs).alias(feature_column(self.name, mask))


def _capped(count: Column) -> Column:
    return F.least(count, F.lit(CAP)).cast("int")


def _ratio(part: Column, whole: Column) -> Column:
    return (part.cast("double") / whole.cast("double")).cast("float")


def _delta(seconds: Column) -> Column:
    return F.when(seconds.isNull(), NONE).otherwise(F.least(seconds, F.lit(LARGEST))).cast("int")


def _neighbour_id(value: Column) -> Column:
    return F.coalesce(value, F.lit(NONE)).cast("int")


def all_click_count() -> GroupFeature:
    return GroupFeature("AllClickCount", (Total(),), _capped)


def hourly_click_count() -> GroupFeature:
    """Clicks of the group in the same hour of day, all days pooled."""
    return GroupFeature("HourlyClickCount", (Total(),), _capped, by_hour=True)


def exact_same_click(compat: bool = False) -> GroupFeature:
    """Clicks equal on all five keys; ``compat`` wraps at 256."""
    value = (lambda n: F.pmod(n, F.lit(256)).cast("int")) if compat else (lambda n: n)
    return GroupFeature("ExactSameClick", (Total(),), value, (ALL_KEYS,))


def exact_same_click_id(compat: bool = False) -> GroupFeature:
    """Position among the clicks equal on all five keys; ``compat`` wraps at 256."""
    value = (lambda n: F.pmod(n, F.lit(256)).cast("int")) if compat else (lambda n: n)
    return GroupFeature("ExactSameClickId", (Before(),), value, (ALL_KEYS,))


def cumulative_click_count(compat: bool = False) -> GroupFeature:
    """Zero-based position in the group; ``compat`` wraps at 65536."""
    value = (lambda n: F.pmod(n, F.lit(65536)).cast("int")) if compat else (lambda n: n)
    return GroupFeature("CumulativeClickCount", (Before(),), value)


def cumulative_click_count_future() -> GroupFeature:
    return GroupFeature(
        "CumulativeClickCountFuture", (Total(), Before()), lambda total, before: _capped(total - before - 1)
    )


def next_click_time_delta() -> GroupFeature:
    return GroupFeature(
        "NextClickTimeDelta", (Neighbour("click_s", 1),), lambda other: _delta(other - F.col("click_s"))
    )


def prev_click_time_delta() -> GroupFeature:
    return GroupFeature(
        "PrevClickTimeDelta", (Neighbour("click_s", -1),), lambda other: _delta(F.col("click_s") - other)
    )


def next_app() -> GroupFeature:
    return GroupFeature("NextApp", (Neighbour("app", 1),), _neighbour_id, NEXT_APP_MASKS)


def prev_app() -> GroupFeature:
    return GroupFeature("PrevApp", (Neighbour("app", -1),), _neighbour_id, NEXT_APP_MASKS)


def next_channel() -> GroupFeature:
    return GroupFeature("NextChannel", (Neighbour("channel", 1),), _neighbour_id, NEXT_CHANNEL_MASKS)


def prev_channel() -> GroupFeature:
    return GroupFeature("PrevChannel", (Neighbour("channel", -1),), _neighbour_id, NEXT_CHANNEL_MASKS)


def future_click_count(seconds: int) -> GroupFeature:
    """This click and later rows up to ``seconds`` ahead; earlier rows of the same second do not count."""
    return GroupFeature(
        f"FutureClickCount_{seconds}", (UpTo(seconds), Before()), lambda upto, before: _capped(upto - before)
    )


def past_click_count(seconds: int) -> GroupFeature:
    """This click and earlier rows up to ``seconds`` back; later rows of the same second do not count."""
    return GroupFeature(
        f"PastClickCount_{seconds}",
        (Before(), UpTo(-seconds - 1)),
        lambda before, older: _capped(before + 1 - older),
    )


def future_click_ratio(seconds: int) -> GroupFeature:
    return GroupFeature(
        f"FutureClickRatio_{seconds}",
        (UpTo(seconds), Before(), Total()),
        lambda upto, before, total: _ratio(upto - before, total),
    )


def past_click_ratio(seconds: int) -> GroupFeature:
    return GroupFeature(
        f"PastClickRatio_{seconds}",
        (Before(), UpTo(-seconds - 1), Total()),
        lambda before, older, total: _ratio(before + 1 - older, total),
    )


def average_attributed_ratio() -> GroupFeature:
    """Mean label of the group's rows at least a day older; -1 where there are none."""
    return GroupFeature(
        "AverageAttributedRatio",
        (UpTo(-DAY, "labels"), UpTo(-DAY)),
        lambda labels, count: F.when(count == 0, F.lit(NO_HISTORY).cast("float")).otherwise(
            _ratio(labels, F.greatest(count, F.lit(1)))
        ),
    )


def add_grouped_features(
    clicks: DataFrame,
    features: Iterable[GroupFeature],
    masks=None,
    strategy: str = "auto",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the columns of ``features`` for all their masks (or those also in ``masks``)."""
    features = list(features)
    wanted = {}
    for feature in features:
        for mask in feature.masks:
            if masks is None or mask in masks:
                wanted.setdefault(mask, []).append(feature)
    plan = plan_masks(clicks, list(wanted), strategy)
    rows = source = prepare_rows(clicks, features, plan, chunk_rows)
    parts = layout_parts(clicks) if strategy == "auto" else None
    clustered_on = None
    for how, lead, mask in plan:
        if cluster_key(how, lead) != clustered_on:
            # One shuffle per leading column (direct), one by chunk in all (cells).
            clustered_on = cluster_key(how, lead)
            rows = by_column(rows, clustered_on, parts)
        for by_hour in (False, True):
            group = [f for f in wanted[mask] if f.by_hour == by_hour]
            if not group:
                continue
            tag = mask_suffix(mask) + ("_hour" if by_hour else "")
            keys = [*mask, "_hour"] if by_hour else list(mask)
            keys = [lead, *[k for k in keys if k != lead]] if lead else keys
            needs = {need for f in group for need in f.needs}
            rows = add_needs(rows, tag, keys, needs, how, source)
            rows = rows.select("*", *[f.column_for(mask, tag) for f in group])
    in_order = [feature_column(f.name, m) for f in features for m in f.masks if m in wanted]
    return rows.select(*clicks.columns, *in_order)


def cluster_key(how: str, lead: str | None) -> str:
    return lead if how == "direct" else "chunk"


def plan_masks(clicks: DataFrame, masks, strategy: str) -> list[tuple]:
    if strategy == "auto":
        return choose_strategies(clicks, masks)
    if strategy == "direct":
        return [("direct", mask[0], mask) for mask in sorted(masks, key=all_masks().index)]
    return [(strategy, None, mask) for mask in masks]


def prepare_rows(clicks: DataFrame, features, plan, chunk_rows: int) -> DataFrame:
    rows = clicks
    if any(f.by_hour for f in features):
        rows = rows.withColumn("_hour", hour_of_day(F.col("click_s")))
    if any(how == "cells" for how, _, _ in plan):
        rows = with_chunk(rows, chunk_rows)
    return rows
