"""Small tie-heavy click logs and plain loops stating each rule once more."""

import random

SCHEMA = (
    "row_id bigint, ip int, app int, device int, os int, channel int, click_s bigint, "
    "is_attributed int, attributed_s bigint, is_train boolean"
)
DAY = 86400


def random_clicks(n=400, seed=3, span=12, step=DAY // 4, hot=0.35):
    """Times on a coarse grid (many ties); about a third of the rows share one key."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(span) * step + rng.choice([0, 0, 1, 599, 600, 601]) for _ in range(n))
    rows = []
    for i, t in enumerate(sorted(times)):
        key = (7, 3, 0, 1, 5) if rng.random() < hot else tuple(rng.randrange(m) for m in (5, 3, 2, 3, 4))
        train = i < n * 0.75
        label = int(train and rng.random() < 0.4)
        rows.append((i, *key, t, label, t + rng.randrange(90000) if label else None, train))
    return rows


def groups(rows, key):
    out = {}
    for row in sorted(rows, key=lambda r: (r[6], r[0])):
        out.setdefault(key(row), []).append(row)
    return out


def per_row(rows, key, rule):
    """``rule(group, i)`` for each row of each key group, by row_id."""
    return {g[i][0]: rule(g, i) for g in groups(rows, key).values() for i in range(len(g))}


def middle(deltas):
    n = len(deltas)
    return min(65534, (deltas[n // 2] + deltas[(n - 1) // 2]) // 2) if n else 65535
