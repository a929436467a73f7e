"""Key columns, their subsets ("masks"), feature names and packed keys."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ("ip", "app", "device", "os", "channel")

# Name parts and bit widths of the five keys.
NAME_PARTS = {"ip": "ip", "app": "app", "device": "dev", "os": "os", "channel": "cha"}
KEY_BITS = {"ip": 20, "app": 10, "device": 14, "os": 10, "channel": 10}

ALL_KEYS = KEYS


def all_masks() -> list[tuple[str, ...]]:
    """The 31 non-empty key subsets, those sharing a first column next to each other."""
    subsets = [mask for n in range(1, 6) for mask in combinations(KEYS, n)]
    return sorted(subsets, key=lambda mask: (KEYS.index(mask[0]), len(mask)))


def mask_suffix(mask) -> str:
    """``ip, device`` -> ``ip_dev``; parts always come in the order of ``KEYS``."""
    return "_".join(NAME_PARTS[key] for key in KEYS if key in mask)


def feature_column(feature: str, mask) -> str:
    return f"{feature}_{mask_suffix(mask)}"


def composite_key(mask) -> Column:
    """The selected key columns as one struct, usable wherever a single key is needed."""
    return F.struct(*[F.col(key) for key in KEYS if key in mask])


def packed_key(mask) -> Column:
    """The selected key columns packed into one BIGINT, ip in the highest bits.

    Unlike a struct this is only collision-free while every value fits its width.
    """
    packed, shift = F.lit(0).cast("bigint"), 0
    for key in reversed(KEYS):
        if key in mask:
            packed = packed.bitwiseOR(F.shiftleft(F.col(key).cast("bigint"), shift))
        shift += KEY_BITS[key]
    return packed
