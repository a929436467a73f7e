"""The registered queries once more, as SQL for DuckDB over the raw tables."""

from __future__ import annotations

from clickmill.functions.keys import ALL_KEYS, feature_column

EVENTS = """
base AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
                CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t FROM events),
clicks AS (SELECT event_id AS row_id, CAST(user_id AS INTEGER) AS ip,
  CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 11 WHEN 'signup' THEN 12 WHEN 'error' THEN 13 ELSE 14 END AS app,
  k % 2 AS device, CAST(k // 2 AS INTEGER) % 3 AS os, CAST(k // 10 AS INTEGER) AS channel, t AS click_s,
  CASE WHEN t < 1706054400 AND value > 100 THEN 1 ELSE 0 END AS is_attributed,
  CASE WHEN t < 1706054400 AND value > 100 THEN t + CAST(floor(value * 10) AS BIGINT) END AS attributed_s,
  t < 1706054400 AS is_train FROM base)"""

LINEITEM = """
li AS (SELECT *, CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS t FROM lineitem),
clicks AS (SELECT CAST(row_number() OVER (ORDER BY t, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS BIGINT) AS row_id,
  CAST(l_suppkey AS INTEGER) AS ip, CAST(l_linenumber AS INTEGER) AS app,
  CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS device,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS os,
  CAST(round(l_discount * 100) AS INTEGER) AS channel, t AS click_s,
  CASE WHEN t < 978307200 AND l_quantity >= 41 THEN 1 ELSE 0 END AS is_attributed,
  CASE WHEN t < 978307200 AND l_quantity >= 41 THEN t + CAST(round(l_extendedprice) AS BIGINT) % 90000 END AS attributed_s,
  t < 978307200 AS is_train FROM li)"""

LOGS = {"E": EVENTS, "L": LINEITEM}


def over(log: str, body: str) -> str:
    return f"WITH {LOGS[log]}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().removeprefix('+')}"


def _int(text: str) -> str:
    return f"CAST({text} AS INTEGER)"


def feature_sql(name: str, mask) -> str:
    """The SQL expression of one grouped feature for one mask."""
    keys = ", ".join(mask)
    group = f"(PARTITION BY {keys})"
    order = f"(PARTITION BY {keys} ORDER BY click_s, row_id)"
    stem, _, window = name.partition("_")

    def upto(frame, measure="1"):
        return (
            f"coalesce(sum({measure}) OVER (PARTITION BY {keys} ORDER BY click_s "
            f"RANGE BETWEEN UNBOUNDED PRECEDING AND {frame}), 0)"
        )

    rn = f"row_number() OVER {order}"
    size = f"count(*) OVER {group}"
    future = f"({upto(f'{window} FOLLOWING')} - ({rn} - 1))"
    past = f"({rn} - {upto(f'{int(window) + 1} PRECEDING')})" if window else ""
    day = "86400 PRECEDING"

    def delta(text):
        return f"CASE WHEN {text} IS NULL THEN 65535 ELSE least({text}, 65534) END"

    return {
        "AllClickCount": lambda: _int(f"least({size}, 65535)"),
        "HourlyClickCount": lambda: _int(
            f"least(count(*) OVER (PARTITION BY {keys}, (click_s // 3600) % 24), 65535)"
        ),
        "ExactSameClick": lambda: f"CAST({size} AS BIGINT)",
        "ExactSameClickId": lambda: f"CAST({rn} - 1 AS BIGINT)",
        "CumulativeClickCount": lambda: f"CAST({rn} - 1 AS BIGINT)",
        "CumulativeClickCountFuture": lambda: _int(f"least({size} - {rn}, 65535)"),
        "NextClickTimeDelta": lambda: _int(delta(f"(lead(click_s) OVER {order} - click_s)")),
        "PrevClickTimeDelta": lambda: _int(delta(f"(click_s - lag(click_s) OVER {order})")),
        "NextApp": lambda: _int(f"coalesce(lead(app) OVER {order}, 65535)"),
        "PrevApp": lambda: _int(f"coalesce(lag(app) OVER {order}, 65535)"),
        "NextChannel": lambda: _int(f"coalesce(lead(channel) OVER {order}, 65535)"),
        "PrevChannel": lambda: _int(f"coalesce(lag(channel) OVER {order}, 65535)"),
        "FutureClickCount": lambda: _int(f"least({future}, 65535)"),
        "PastClickCount": lambda: _int(f"least({past}, 65535)"),
        "FutureClickRatio": lambda: f"CAST(CAST({future} AS DOUBLE) / {size} AS FLOAT)",
        "PastClickRatio": lambda: f"CAST(CAST({past} AS DOUBLE) / {size} AS FLOAT)",
        "AverageAttributedRatio": lambda: (
            f"CAST(CASE WHEN {upto(day)} = 0 THEN -1 "
            f"ELSE CAST({upto(day, 'is_attributed')} AS DOUBLE) / {upto(day)} END AS FLOAT)"
        ),
    }[stem]()


def grouped_sql(log: str, features, masks=None) -> str:
    columns = [
        f"{feature_sql(f.name, m)} AS {feature_column(f.name, m)}"
        for f in features
        for m in f.masks
        if masks is None or m in masks
    ]
    return over(log, "SELECT row_id, " + ",\n ".join(columns) + " FROM clicks")


def median_sql(log: str, kind: str, name: str, masks) -> str:
    parts, joins, columns = [], [], []
    for i, mask in enumerate(masks):
        keys = ", ".join(mask)
        on = " AND ".join(f"a.{k} = n.{k}" for k in mask)
        order = f"PARTITION BY {keys} ORDER BY click_s, row_id"
        day = (
            f"sum(is_attributed) OVER (PARTITION BY {keys} ORDER BY click_s "
            "RANGE BETWEEN UNBOUNDED PRECEDING AND 86400 PRECEDING)"
        )
        count = {
            "all": f"sum(is_attributed) OVER (PARTITION BY {keys})",
            "past": f"sum(is_attributed) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
            "past_v2": f"lag(day_old) OVER ({order})",
        }[kind]
        parts.append(f"o{i} AS (SELECT *, {day} AS day_old FROM clicks)")
        parts.append(f"n{i} AS (SELECT row_id, {keys}, CAST(coalesce({count}, 0) AS BIGINT) AS n FROM o{i})")
        parts.append(
            f"a{i} AS (SELECT {keys}, row_number() OVER ({order}) - 1 AS pos, attributed_s - click_s AS d "
            "FROM clicks WHERE is_attributed = 1)"
        )
        parts.append(
            f"r{i} AS (SELECT n.row_id, CAST(CASE WHEN n.n = 0 THEN 65535 ELSE least(65534, (a.d + b.d) // 2) END "
            f"AS INTEGER) AS v FROM n{i} n LEFT JOIN a{i} a ON {on} AND a.pos = n.n // 2 AND n.n > 0 "
            f"LEFT JOIN a{i} b ON {on.replace('a.', 'b.')} AND b.pos = (n.n - 1) // 2 AND n.n > 0)"
        )
        joins.append(f"JOIN r{i} USING (row_id)")
        columns.append(f"r{i}.v AS {feature_column(name, mask)}")
    return over(
        log, "+" + ",\n".join(parts) + f" SELECT row_id, {', '.join(columns)} FROM clicks {' '.join(joins)}"
    )


DUPLICATES = f"""+
c AS (SELECT *, count(*) OVER (PARTITION BY is_train, {', '.join(ALL_KEYS)}, click_s) AS copies FROM clicks),
d AS (SELECT *, lag(struct_pack(ip, device, os, channel, app, click_s)) OVER (PARTITION BY is_train ORDER BY row_id) AS p,
  struct_pack(ip, device, os, channel, app, click_s) AS s FROM c WHERE copies > 1),
e AS (SELECT *, last_value(CASE WHEN p IS DISTINCT FROM s THEN row_id END IGNORE NULLS) OVER
  (PARTITION BY is_train ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM d)
SELECT c.row_id, CASE WHEN e.row_id IS NULL THEN CAST('NaN' AS DOUBLE) ELSE CAST(e.row_id - e.start AS DOUBLE) END AS DuplicateRowIndexDiff
FROM c LEFT JOIN e ON c.row_id = e.row_id"""

BAGS = """+
pos AS (SELECT count(*) AS n FROM clicks WHERE is_train AND is_attributed = 1),
seeds AS (SELECT CAST(unnest(range({seeds})) AS INTEGER) AS bag),
neg AS (SELECT bag, row_id, row_number() OVER (PARTITION BY bag ORDER BY
  md5(CAST(row_id AS VARCHAR) || ':' || CAST(bag AS VARCHAR)), row_id) AS place
  FROM clicks, seeds WHERE is_train AND is_attributed = 0),
bags AS (SELECT bag, row_id FROM neg, pos WHERE place <= n
  UNION ALL SELECT bag, row_id FROM clicks, seeds WHERE is_train AND is_attributed = 1)
"""

PREDICTIONS = """+
p AS (SELECT b.bag, c.row_id AS click_id, ((c.row_id * (7919 + b.bag)) % 1000) / 1000.0::DOUBLE AS prediction,
  c.is_attributed AS label FROM clicks c, (SELECT CAST(unnest(range(3)) AS INTEGER) AS bag) b)
"""
