"""The registered queries: every operator over the whole test tables, with its SQL if it has one.

``_E`` queries run on the click log shaped from ``events``, ``_L`` on the tie-heavy one shaped
from ``lineitem``. The ``_cells`` twins force the plan for hot keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmill.functions import clock
from clickmill.functions.keys import ALL_KEYS, KEYS, all_masks, packed_key
from clickmill.operators import documents as D
from clickmill.operators import grouped as G
from clickmill.operators import latent
from clickmill.operators.attribution import KINDS, add_median_attribute_time
from clickmill.operators.basic import COUNTS, add_basic_counts
from clickmill.operators.duplicates import add_duplicate_row_index_diff
from clickmill.operators.factors import svd_each
from clickmill.operators.idmap import click_id_mapping, mapped_predictions, needed_clicks
from clickmill.operators.ranks import exact_auc
from clickmill.operators.sampling import bag_rows, balanced_bags, fraction_sample
from clickmill.plans import dataset, scoring, training
from clickmill.plans.oracles import BAGS, DUPLICATES, PREDICTIONS, grouped_sql, median_sql, over
from clickmill.session import cut_lineage, scratch_path
from clickmill.sources import clicks as C
from clickmill.sources.adapters import event_clicks, lineitem_clicks
from clickmill.sources.store import FeatureStore, assemble, bag_summary, write_submission

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SOURCES = {"E": event_clicks, "L": lineitem_clicks}

DAY = clock.DAY
ALL = tuple(all_masks())
# One mask per size, with and without ip; the SQL check of 31 masks is kept for a few features.
SOME = (("ip",), ("app",), ("device", "os"), ("app", "device"), ("ip", "app", "os"), ("ip", "device", "os", "channel"), KEYS)
CELL_CHUNK = 4096


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def _grouped(name: str, log: str, features, masks=None, strategy="auto", chunk_rows=CELL_CHUNK):
    def run(spark, sf_dir):
        rows = G.add_grouped_features(SOURCES[log](spark, sf_dir), features, masks, strategy, chunk_rows)
        return rows.drop(*[c for c in C.CLICK_COLUMNS if c != "row_id"])

    query(name, grouped_sql(log, features, masks))(run)


# ---------------------------------------------------------------- sources and sinks


def _times(column: str):
    """Epoch seconds as a timestamp without zone, whatever the session zone is."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(column))


CLICK_FIELDS = (
    "row_id, ip, app, device, os, channel, click_s, is_attributed, coalesce(attributed_s, 0) AS attributed_s, is_train"
)


def _filled(rows: DataFrame) -> DataFrame:
    """Missing attribution times read as 0."""
    return rows.na.fill(0, ["attributed_s"])


@query("s_csv_train_E", over("E", f"SELECT {CLICK_FIELDS} FROM clicks WHERE is_train"))
def s_csv_train(spark, sf_dir):
    path = scratch_path(spark, "train-csv")
    train = event_clicks(spark, sf_dir).where("is_train").withColumns(
        {"click_time": _times("click_s"), "attributed_time": _times("attributed_s")}
    )
    ordered = train.orderBy("click_s", "row_id").select(*C.TRAIN_SCHEMA.names)
    ordered.write.option("header", True).csv(path)
    return _filled(C.typed_clicks(C.read_train_csv(spark, path), True))


@query(
    "s_csv_test_E",
    over(
        "E",
        """SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS row_id, ip, app, device, os, channel,
        click_s, 0 AS is_attributed, CAST(0 AS BIGINT) AS attributed_s, FALSE AS is_train, row_id AS click_id
        FROM clicks WHERE NOT is_train""",
    ),
)
def s_csv_test(spark, sf_dir):
    path = scratch_path(spark, "test-csv")
    test = event_clicks(spark, sf_dir).where("NOT is_train")
    test = test.withColumn("click_time", _times("click_s")).withColumn("click_id", F.col("row_id"))
    test.orderBy("click_s", "row_id").select(*C.TEST_SCHEMA.names).write.option("header", True).csv(path)
    return _filled(C.typed_clicks(C.read_test_csv(spark, path), False))


@query(
    "s_overlap_filter_E",
    over(
        "E",
        "SELECT row_id, ip, click_s FROM clicks WHERE click_s >= (SELECT max(click_s) FROM clicks WHERE is_train)",
    ),
)
def s_overlap_filter(spark, sf_dir):
    log = event_clicks(spark, sf_dir)
    return C.keep_after(log, log.where("is_train"), "click_s").select("row_id", "ip", "click_s")


@query(
    "s_small_sample_E",
    over(
        "E",
        """SELECT row_id, click_s FROM (SELECT *, row_number() OVER (ORDER BY
        md5(CAST(row_id AS VARCHAR) || ':114514'), row_id) AS place FROM clicks)
        WHERE place <= (SELECT CAST(round(count(*) * 0.01) AS BIGINT) FROM clicks) ORDER BY click_s, row_id""",
    ),
)
def s_small_sample(spark, sf_dir):
    return fraction_sample(event_clicks(spark, sf_dir), 0.01, 114514).select("row_id", "click_s")


@query(
    "s_stack_fill_E",
    over(
        "E",
        """SELECT row_id, ip, app, device, os, channel, click_s, CASE WHEN is_train THEN is_attributed ELSE 0 END
        AS is_attributed, is_train FROM clicks""",
    ),
)
def s_stack_fill(spark, sf_dir):
    log = event_clicks(spark, sf_dir)
    test = log.where("NOT is_train").drop("is_attributed", "attributed_s")
    return C.stack(log.where("is_train"), test).drop("attributed_s")


@query("s_projected_scan_L", over("L", f"SELECT {CLICK_FIELDS} FROM clicks"))
def s_projected_scan(spark, sf_dir):
    return _filled(lineitem_clicks(spark, sf_dir))


def _stored_counts(spark, sf_dir):
    log = event_clicks(spark, sf_dir)
    store = FeatureStore(spark, scratch_path(spark, "features"), [sf_dir])

    def counted(mask):
        rows = G.add_grouped_features(log, [G.all_click_count()], [mask])
        return rows.drop(*[c for c in C.CLICK_COLUMNS if c != "row_id"])

    return [store.get(f"count-{'-'.join(m)}", lambda m=m: counted(m)) for m in SOME[:3]], store


@query("s_feature_store_E", grouped_sql("E", [G.all_click_count()], SOME[:1]))
def s_feature_store(spark, sf_dir):
    tables, store = _stored_counts(spark, sf_dir)
    if not store.finished("count-ip"):
        raise RuntimeError("a stored feature must be found again")
    return store.get("count-ip", lambda: tables[1])


@query("s_assemble_E", grouped_sql("E", [G.all_click_count()], SOME[:3]))
def s_assemble(spark, sf_dir):
    return assemble(_stored_counts(spark, sf_dir)[0])


# ---------------------------------------------------------------- projections and filters


@query(
    "p_passthrough_E",
    over(
        "E",
        """SELECT row_id, ip, app, os, device, channel, ip AS ip_for_filtering, click_s AS click_time,
        coalesce(is_attributed, 0) AS is_attributed FROM clicks""",
    ),
)
def p_passthrough(spark, sf_dir):
    from clickmill.plans.registry import add_features

    names = ["ip", "app", "os", "device", "channel", "ip_for_filtering", "click_time", "is_attributed"]
    return add_features(event_clicks(spark, sf_dir), names).select("row_id", *names)


@query(
    "p_calendar_E",
    over(
        "E",
        """SELECT row_id, CAST(click_s // 3600 % 24 AS INTEGER) AS hour, CAST(click_s // 60 % 60 AS INTEGER) AS minute,
        CAST(click_s % 60 AS INTEGER) AS second, click_s // 60 % 60 = 0 AS zero_minute,
        CAST(day(make_timestamp(click_s * 1000000)) AS INTEGER) AS day FROM clicks""",
    ),
)
def p_calendar(spark, sf_dir):
    s = F.col("click_s")
    return event_clicks(spark, sf_dir).select(
        "row_id",
        clock.hour_of_day(s).alias("hour"),
        clock.minute_of_hour(s).alias("minute"),
        clock.second_of_minute(s).alias("second"),
        clock.zero_minute(s).alias("zero_minute"),
        clock.day_of_month(s).alias("day"),
    )


@query(
    "p_time_split_E",
    over(
        "E",
        """SELECT row_id, CASE WHEN click_s < 1705766400 THEN 'train' ELSE 'valid' END AS part
        FROM clicks WHERE is_train""",
    ),
)
def p_time_split(spark, sf_dir):
    rows = event_clicks(spark, sf_dir).where("is_train")
    train, valid = dataset.time_split(rows, "2024-01-20 16:00:00")
    return (
        train.withColumn("part", F.lit("train"))
        .unionByName(valid.withColumn("part", F.lit("valid")))
        .select("row_id", "part")
    )


@query(
    "p_hour_filter_weight_E",
    over(
        "E",
        """SELECT row_id, click_s // 3600 % 24 AS hour,
        CAST(CASE WHEN click_s // 3600 % 24 IN (4, 5, 9, 10, 13, 14) THEN 2.5 ELSE 1 END AS DOUBLE) AS weight
        FROM clicks WHERE click_s < 1705766400 AND is_train
        UNION ALL SELECT row_id, click_s // 3600 % 24, 1.0 FROM clicks
        WHERE click_s >= 1705766400 AND is_train AND click_s // 3600 % 24 IN (4, 5, 9, 10, 13, 14)""",
    ),
)
def p_hour_filter_weight(spark, sf_dir):
    rows = event_clicks(spark, sf_dir).where("is_train").withColumn("hour", clock.hour_of_day(F.col("click_s")))
    train, valid = dataset.time_split(rows, "2024-01-20 16:00:00")
    train = dataset.with_hour_weight(train, 2.5)
    valid = dataset.in_test_hours(valid).withColumn("weight", F.lit(1.0))
    return train.unionByName(valid).select("row_id", F.col("hour").cast("bigint").alias("hour"), "weight")


@query("p_ip_filter_E", over("E", "SELECT row_id, ip AS ip_for_filtering FROM clicks WHERE ip <= 100"))
def p_ip_filter(spark, sf_dir):
    rows = event_clicks(spark, sf_dir).select("row_id", F.col("ip").alias("ip_for_filtering"))
    return dataset.only_test_ips(rows, 100)


@query(
    "p_packed_key_E",
    over(
        "E",
        """SELECT row_id, (CAST(ip AS BIGINT) << 44) | (CAST(app AS BIGINT) << 34) | (CAST(device AS BIGINT) << 20)
        | (CAST(os AS BIGINT) << 10) | channel AS packed_all,
        (CAST(ip AS BIGINT) << 44) | (CAST(os AS BIGINT) << 10) AS packed_ip_os,
        coalesce(attributed_s - click_s, 0) AS delay_s FROM clicks""",
    ),
)
def p_packed_key(spark, sf_dir):
    nanos = (F.col("attributed_s") - F.col("click_s")) * 1_000_000_000 + 999
    return event_clicks(spark, sf_dir).select(
        "row_id",
        packed_key(KEYS).alias("packed_all"),
        packed_key(("ip", "os")).alias("packed_ip_os"),
        F.coalesce(clock.nanos_to_seconds(nanos), F.lit(0)).alias("delay_s"),
    )


# ---------------------------------------------------------------- counts and windows


def _basic(log: str, strategy: str):
    def run(spark, sf_dir):
        return add_basic_counts(SOURCES[log](spark, sf_dir), strategy, CELL_CHUNK).select("row_id", *COUNTS)

    return run


for _log, _strategy, _suffix in (("E", "auto", "E"), ("L", "cells", "L_cells")):
    query(
        f"a_basic_counts_{_suffix}",
        over(
            _log,
            """+days AS (SELECT *, day(make_timestamp(click_s * 1000000)) AS d, click_s // 3600 % 24 AS h FROM clicks)
            SELECT row_id, CAST(count(channel) OVER (PARTITION BY ip, d, h) AS INTEGER) AS n_channels,
            CAST(count(channel) OVER (PARTITION BY ip, app) AS INTEGER) AS ip_app_count,
            CAST(count(channel) OVER (PARTITION BY ip, app, os) AS INTEGER) AS ip_app_os_count FROM days""",
        ),
    )(_basic(_log, _strategy))

_grouped("a_all_click_count_E", "E", [G.all_click_count()])
_grouped("a_hourly_click_count_E", "E", [G.hourly_click_count()], SOME)
_grouped("a_exact_same_click_L", "L", [G.exact_same_click()])
_grouped("w_cumulative_E", "E", [G.cumulative_click_count()], SOME)
_grouped("w_cumulative_future_E", "E", [G.cumulative_click_count_future()], SOME)
_grouped("w_same_click_id_L", "L", [G.exact_same_click_id()])
_grouped("w_next_delta_E", "E", [G.next_click_time_delta()], SOME)
_grouped("w_prev_delta_E", "E", [G.prev_click_time_delta()], SOME)
_grouped("w_next_app_E", "E", [G.next_app()])
_grouped("w_prev_app_E", "E", [G.prev_app()])
_grouped("w_next_channel_E", "E", [G.next_channel()])
_grouped("w_prev_channel_E", "E", [G.prev_channel()])
_grouped("w_future_count_60_E", "E", [G.future_click_count(60)], SOME)
_grouped("w_future_count_600_E", "E", [G.future_click_count(600)], SOME)
_grouped("w_future_count_4800_E", "E", [G.future_click_count(4800)], SOME)
_grouped("w_past_count_600_E", "E", [G.past_click_count(600)], SOME)
_grouped("w_past_count_4800_E", "E", [G.past_click_count(4800)], SOME)
_grouped("w_future_ratio_600_E", "E", [G.future_click_ratio(600)], SOME)
_grouped("w_future_ratio_4800_E", "E", [G.future_click_ratio(4800)], SOME)
_grouped("w_past_ratio_600_E", "E", [G.past_click_ratio(600)], SOME)
_grouped("w_past_ratio_4800_E", "E", [G.past_click_ratio(4800)], SOME)
_grouped("w_avg_attr_ratio_E", "E", [G.average_attributed_ratio()], SOME)

# Every grouped feature over all 31 masks; the queries above time a few masks of each.
_grouped("a_hourly_click_count_all_masks_E", "E", [G.hourly_click_count()])
_grouped("w_cumulative_all_masks_E", "E", [G.cumulative_click_count()])
_grouped("w_cumulative_future_all_masks_E", "E", [G.cumulative_click_count_future()])
_grouped("w_future_count_60_all_masks_E", "E", [G.future_click_count(60)])
_grouped("w_past_count_600_all_masks_E", "E", [G.past_click_count(600)])
_grouped("w_future_ratio_600_all_masks_E", "E", [G.future_click_ratio(600)])
_grouped("w_past_ratio_600_all_masks_E", "E", [G.past_click_ratio(600)])

# The features most configurations use, over all 31 masks in one pass.
COMMON = [
    G.future_click_count(600), G.future_click_count(4800), G.next_click_time_delta(),
    G.prev_click_time_delta(), G.average_attributed_ratio(),
]
_grouped("w_common_features_all_masks_E", "E", COMMON)

# Tie-heavy twins with windows of days, direct and by cells.
TIES = [
    G.future_click_count(7 * DAY), G.past_click_count(7 * DAY), G.future_click_ratio(30 * DAY),
    G.past_click_ratio(30 * DAY), G.average_attributed_ratio(), G.next_click_time_delta(),
    G.prev_click_time_delta(), G.cumulative_click_count(), G.cumulative_click_count_future(),
]
_grouped("w_tie_heavy_L", "L", TIES, SOME)
_grouped("w_tie_heavy_L_cells", "L", TIES, SOME, "cells")
_grouped("a_all_click_count_L_cells", "L", [G.all_click_count()], ALL, "cells")
_grouped(
    "w_neighbours_L_cells",
    "L",
    [G.next_app(), G.prev_app(), G.next_channel(), G.prev_channel(), G.exact_same_click(), G.exact_same_click_id()],
    None,
    "cells",
)
_grouped("a_hourly_click_count_L_cells", "L", [G.hourly_click_count()], SOME, "cells")


def _median(name: str, kind: str, masks, strategy: str = "auto"):
    def run(spark, sf_dir):
        rows = add_median_attribute_time(lineitem_clicks(spark, sf_dir), kind, masks, strategy, CELL_CHUNK)
        return rows.drop(*[c for c in C.CLICK_COLUMNS if c != "row_id"])

    ordered = [m for m in ALL if m in masks]
    query(name, median_sql("L", kind, KINDS[kind][0], ordered))(run)


_median("a_median_attr_L", "all", SOME)
_median("w_median_past_L", "past", SOME)
_median("w_median_past_v2_L", "past_v2", SOME)
_median("a_median_attr_all_masks_L", "all", ALL)
_median("w_median_past_all_masks_L", "past", ALL)
_median("w_median_past_v2_all_masks_L", "past_v2", ALL)
_median("a_median_attr_L_cells", "all", SOME, "cells")
_median("w_median_past_L_cells", "past", SOME, "cells")
_median("w_median_past_v2_L_cells", "past_v2", SOME, "cells")


@query("w_dup_row_diff_L", over("L", DUPLICATES))
def w_dup_row_diff(spark, sf_dir):
    rows = add_duplicate_row_index_diff(lineitem_clicks(spark, sf_dir), CELL_CHUNK)
    return rows.select("row_id", "DuplicateRowIndexDiff")


# ---------------------------------------------------------------- id mapping

TEST_HOURS_SQL = "(4, 5, 9, 10, 13, 14)"
OLD_TEST = """+
old AS (SELECT *, row_id AS click_id FROM clicks WHERE NOT is_train),
new AS (SELECT * REPLACE (row_id + 1000000 AS click_id) FROM old WHERE {subset}),
last AS (SELECT ip, app, device, os, channel, click_s, arg_max(click_id, row_id) AS old_click_id FROM old
  GROUP BY ip, app, device, os, channel, click_s),
mapping AS (SELECT old_click_id, new.click_id AS new_click_id FROM new
  JOIN last USING (ip, app, device, os, channel, click_s))
"""
E_SUBSET = f"click_s // 3600 % 24 IN {TEST_HOURS_SQL}"
L_SUBSET = "app <= 2"


def _tests(log: str, spark, sf_dir):
    old = SOURCES[log](spark, sf_dir).where("NOT is_train").withColumn("click_id", F.col("row_id"))
    hour = clock.hour_of_day(F.col("click_s"))
    new = old.where(hour.isin(*dataset.TEST_HOURS) if log == "E" else F.col("app") <= 2)
    return old, new.withColumn("click_id", F.col("row_id") + 1_000_000)


@query("j_id_mapping_L", over("L", OLD_TEST.format(subset=L_SUBSET) + "SELECT * FROM mapping"))
def j_id_mapping(spark, sf_dir):
    return click_id_mapping(*_tests("L", spark, sf_dir), CELL_CHUNK)


@query(
    "j_semi_test_E",
    over(
        "E",
        OLD_TEST.format(subset=E_SUBSET)
        + "SELECT click_id, row_id, ip FROM old WHERE click_id IN (SELECT old_click_id FROM mapping)",
    ),
)
def j_semi_test(spark, sf_dir):
    old, new = _tests("E", spark, sf_dir)
    return needed_clicks(old, click_id_mapping(old, new)).select("click_id", "row_id", "ip")


@query(
    "j_prediction_lookup_E",
    over(
        "E",
        OLD_TEST.format(subset=E_SUBSET)
        + """SELECT new_click_id AS click_id, ((old_click_id * 7919) % 1000) / 1000.0::DOUBLE AS prediction
        FROM mapping JOIN old ON old_click_id = old.click_id""",
    ),
)
def j_prediction_lookup(spark, sf_dir):
    old, new = _tests("E", spark, sf_dir)
    scores = old.select("click_id", (F.col("click_id") * 7919 % 1000 / 1000.0).alias("prediction"))
    return mapped_predictions(click_id_mapping(old, new), scores)


# ---------------------------------------------------------------- bags


def _train(spark, sf_dir):
    return event_clicks(spark, sf_dir).where("is_train")


@query("d_bag_E", over("E", BAGS.format(seeds=1) + "SELECT bag, row_id FROM bags"))
def d_bag(spark, sf_dir):
    return balanced_bags(_train(spark, sf_dir), [0])


@query("d_bags_5_E", over("E", BAGS.format(seeds=5) + "SELECT bag, row_id FROM bags"))
def d_bags_5(spark, sf_dir):
    return balanced_bags(_train(spark, sf_dir), range(5))


@query(
    "d_bag_features_E",
    over(
        "E",
        BAGS.format(seeds=2)
        + """, f AS (SELECT row_id, CAST(least(count(*) OVER (PARTITION BY app, device ORDER BY click_s RANGE BETWEEN
        UNBOUNDED PRECEDING AND 600 FOLLOWING) - (row_number() OVER (PARTITION BY app, device ORDER BY click_s, row_id)
        - 1), 65535) AS INTEGER) AS FutureClickCount_600_app_dev FROM clicks)
        SELECT bag, row_id, FutureClickCount_600_app_dev FROM bags JOIN f USING (row_id)""",
    ),
)
def d_bag_features(spark, sf_dir):
    log = event_clicks(spark, sf_dir)
    table = G.add_grouped_features(log, [G.future_click_count(600)], [("app", "device")])
    bagged = bag_rows(table, balanced_bags(log.where("is_train"), range(2)))
    return bagged.select("bag", "row_id", "FutureClickCount_600_app_dev")


# ---------------------------------------------------------------- documents and latent vectors

COUNTS_SQL = "+counts AS (SELECT app AS doc, ip AS term, count(*) AS tf FROM clicks GROUP BY app, ip)"
VOCABULARY_SQL = COUNTS_SQL + """,
vocabulary AS (SELECT term, count(*) AS df FROM counts WHERE term >= 10 GROUP BY term HAVING count(*) >= 2)"""


def _counts(spark, sf_dir):
    return D.cooccurrence(event_clicks(spark, sf_dir), "app", "ip")


@query("l_cooccurrence_E", over("E", COUNTS_SQL + " SELECT * FROM counts"))
def l_cooccurrence(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("l_vocab_min_df_E", over("E", VOCABULARY_SQL + " SELECT * FROM vocabulary"))
def l_vocab_min_df(spark, sf_dir):
    return D.vocabulary(_counts(spark, sf_dir), 2, drop_single_digit=True)


@query(
    "l_tfidf_E",
    over(
        "E",
        VOCABULARY_SQL
        + """, n AS (SELECT max(doc) + 1 AS n FROM counts),
        raw AS (SELECT doc, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS r FROM counts JOIN vocabulary USING (term), n)
        SELECT doc, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc)), 6) AS weight FROM raw""",
    ),
)
def l_tfidf(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    weights = D.tfidf(D.document_terms(counts, 2, drop_single_digit=True), D.document_count(counts))
    return weights.withColumn("weight", F.round("weight", 6))


USERS_SQL = "+counts AS (SELECT ip, device, os, channel, app, count(*) AS tf, min(row_id) AS seen FROM clicks GROUP BY ip, device, os, channel, app)"


@query(
    "l_user_docs_E",
    over(
        "E",
        USERS_SQL
        + """ SELECT ip, device, os, channel, app, tf FROM (SELECT *, sum(tf) OVER (PARTITION BY ip, device, os, channel)
        AS total FROM counts) WHERE total >= 3""",
    ),
)
def l_user_docs(spark, sf_dir):
    return D.user_documents(event_clicks(spark, sf_dir))


@query(
    "l_item_docs_E",
    over(
        "E",
        USERS_SQL
        + """, first AS (SELECT ip, device, os, channel FROM counts GROUP BY ip, device, os, channel
        ORDER BY min(seen) LIMIT 10) SELECT app, ip, device, os, channel, tf FROM counts
        ANTI JOIN first USING (ip, device, os, channel)""",
    ),
)
def l_item_docs(spark, sf_dir):
    return D.item_documents(event_clicks(spark, sf_dir), drop_first_users=True)


@query("l_item_docs_all_E", over("E", USERS_SQL + " SELECT app, ip, device, os, channel, tf FROM counts"))
def l_item_docs_all(spark, sf_dir):
    return D.item_documents(event_clicks(spark, sf_dir))


def _latent(name: str, method: str, pairs, width: int = 5):
    spec = latent.LatentSpec(f"Latent{method.upper()}{width}", method, width, 2, pairs)

    def run(spark, sf_dir):
        rows = latent.add_latent_vectors(event_clicks(spark, sf_dir), spec)
        return rows.drop(*[c for c in C.CLICK_COLUMNS if c != "row_id"])

    query(name)(run)


_latent("l_lda_E", "lda", (("ip", "app"), ("app", "ip")))
_latent("l_svd_E", "svd", (("ip", "app"), ("app", "ip")))
_latent("l_nmf_E", "nmf", (("ip", "app"),))


BOTH_WAYS = [("ip", "channel"), ("channel", "ip")]


@query("l_svd_gram_E", over("E", """
+ c AS (SELECT 0 AS m, ip AS doc, channel AS term, count(*) AS tf FROM clicks GROUP BY ip, channel
  UNION ALL SELECT 1, channel, ip, count(*) FROM clicks GROUP BY channel, ip),
n AS (SELECT m, max(doc) + 1 AS n FROM c GROUP BY m), v AS (SELECT m, term, count(*) AS df FROM c GROUP BY m, term),
raw AS (SELECT m, doc, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS r FROM c JOIN v USING (m, term) JOIN n USING (m)),
x AS (SELECT m, doc, term, r / sqrt(sum(r * r) OVER (PARTITION BY m, doc)) AS w FROM raw),
last AS (SELECT m, term, w AS other FROM x WHERE (m, doc) IN (SELECT (m, max(doc)) FROM x GROUP BY m))
SELECT m::INTEGER AS m, doc::BIGINT AS doc, round(sum(w * coalesce(other, 0)), 5) + 0.0::DOUBLE AS dot FROM x LEFT JOIN last USING (m, term) GROUP BY m, doc"""))
def l_svd_gram(spark, sf_dir):
    """Scores at full rank have the dot products of the rows they stand for: each document with the last one of its matrix."""
    weights = D.stacked_tfidf(D.stacked_cooccurrence(event_clicks(spark, sf_dir), BOTH_WAYS, list(KEYS)), 1)
    scores, _, _ = svd_each(weights, 10)
    scores = cut_lineage(scores)
    last = scores.groupBy("m").agg(F.max_by("f", "id").alias("other"))  # one row per matrix
    dot = F.aggregate(F.zip_with("f", "other", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return scores.join(F.broadcast(last), "m").select("m", F.col("id").alias("doc"), (F.round(dot, 5) + F.lit(0.0)).alias("dot"))


def _configured(name: str):
    def run(spark, sf_dir):
        rows = latent.add_latent_vectors(event_clicks(spark, sf_dir), latent.SPECS[name])
        return rows.drop(*[c for c in C.CLICK_COLUMNS if c != "row_id"])

    query(f"l_{name}_E")(run)


# The named configurations are one function with other parameters.
for _name in latent.SPECS:
    _configured(_name)


CHECKED = (("ip", "app"), ("app", "ip"))


def _checked(name: str, method: str, sql: str, columns):
    """What must hold for every click's vectors of a method, beside SQL that says the same of every click."""
    spec = latent.LatentSpec("Checked", method, 5, 2, CHECKED)

    def run(spark, sf_dir):
        rows = latent.add_latent_vectors(event_clicks(spark, sf_dir), spec)
        vectors = {(a, b): [F.col(f"Checked_{a}_{b}_{i}") for i in range(5)] for a, b in CHECKED}
        return rows.select("row_id", *[columns(v).alias(f"ok_{a}_{b}") for (a, b), v in vectors.items()])

    query(name, over("E", sql))(run)


ALWAYS = "SELECT row_id, TRUE AS ok_ip_app, TRUE AS ok_app_ip FROM clicks"
# Shares are positive and sum to one; parts of a non-negative factorisation are not below zero.
_checked("l_lda_shares_E", "lda", ALWAYS, lambda v: (F.abs(sum(v) - 1) < 1e-4) & (F.least(*v) > 0))
_checked("l_nmf_signs_E", "nmf", ALWAYS, lambda v: F.least(*v) >= 0)
# A document is zero in the SVD just if no word of it is in two documents or more, or all its weight is beyond the rank.
_checked("l_svd_finite_E", "svd", ALWAYS, lambda v: F.abs(sum(x * x for x in v)) <= 1.0001)


def _row_features(name: str, add):
    def run(spark, sf_dir):
        return add(event_clicks(spark, sf_dir)).drop(*[c for c in C.CLICK_COLUMNS if c != "row_id"])

    query(name)(run)


_row_features("l_onehot_svd_E", latent.add_one_hot_svd)
_row_features("l_onehot_tfidf_svd_E", lambda log: latent.add_one_hot_svd(log, weighted=True))
_row_features("l_user_item_lda_E", latent.add_user_item_lda)
_row_features("l_item_user_lda_E", latent.add_item_user_lda)


# ---------------------------------------------------------------- models and scores


def _predictions(spark, sf_dir):
    log = event_clicks(spark, sf_dir)
    bagged = log.select("row_id", "is_attributed", F.explode(F.array(*[F.lit(b) for b in range(3)])).alias("bag"))
    value = (F.col("row_id") * (7919 + F.col("bag")) % 1000 / 1000.0).alias("prediction")
    return bagged.select("bag", F.col("row_id").alias("click_id"), value, F.col("is_attributed").alias("label"))


RANKS_SQL = PREDICTIONS + """, r AS (SELECT *, rank() OVER (PARTITION BY bag ORDER BY prediction)
+ (count(*) OVER (PARTITION BY bag, prediction) - 1) / 2.0::DOUBLE AS rank FROM p)
"""
AUC_SQL = RANKS_SQL + """, auc AS (SELECT bag, round((sum(CASE WHEN label = 1 THEN rank END)
- sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label)), 9) AS auc FROM r GROUP BY bag)
"""


@query("e_auc_E", over("E", AUC_SQL + "SELECT bag, auc FROM auc"))
def e_auc(spark, sf_dir):
    found = exact_auc(_predictions(spark, sf_dir), "prediction", "label", ["bag"])
    return found.withColumn("auc", F.round("auc", 9))


MEAN_SQL = PREDICTIONS + "SELECT click_id, round(avg(prediction), 9) AS is_attributed FROM p GROUP BY click_id"


@query("e_mean_E", over("E", MEAN_SQL))
def e_mean(spark, sf_dir):
    found = scoring.mean_prediction(_predictions(spark, sf_dir))
    return found.withColumn("is_attributed", F.round("is_attributed", 9))


@query(
    "e_rank_average_E",
    over(
        "E",
        RANKS_SQL
        + """SELECT click_id, round(avg(rank) / (SELECT count(DISTINCT click_id) FROM p), 9) AS is_attributed
        FROM r GROUP BY click_id""",
    ),
)
def e_rank_average(spark, sf_dir):
    found = scoring.rank_average(_predictions(spark, sf_dir))
    return found.withColumn("is_attributed", F.round("is_attributed", 9))


@query("s_submission_E", over("E", MEAN_SQL))
def s_submission(spark, sf_dir):
    path = write_submission(scoring.mean_prediction(_predictions(spark, sf_dir)), scratch_path(spark, "submission"))
    written = spark.read.schema("click_id bigint, is_attributed double").option("header", True).csv(path)
    return written.withColumn("is_attributed", F.round("is_attributed", 9))


@query(
    "e_bag_summary_E",
    over(
        "E",
        AUC_SQL
        + """SELECT round(avg(auc), 8) AS average_train_auc, round(avg(1 - auc), 8) AS average_valid_auc,
        round(stddev_pop(auc), 8) AS train_auc_std, round(stddev_pop(1 - auc), 8) AS valid_auc_std,
        round(avg(bag), 8) AS average_train_time FROM auc""",
    ),
)
def e_bag_summary(spark, sf_dir):
    trials = e_auc(spark, sf_dir).select(
        F.col("auc").alias("train_auc"), (1 - F.col("auc")).alias("valid_auc"), F.col("bag").alias("train_time")
    )
    summary = bag_summary(trials)
    return summary.select(*[F.round(c, 8).alias(c) for c in summary.columns])


MODEL_MASKS = [("ip",), ("app", "device")]
MODEL_PARAMS = {"max_depth": 4, "learning_rate": 0.1, "min_child_samples": 20, "subsample": 0.7}
DESIGN = training.Design(
    ("app", "os", "channel", "hour", *[f"FutureClickCount_600_{m}" for m in ("ip", "app_dev")]),
    ("app", "os", "channel", "hour"),
)


def _model_rows(spark, sf_dir):
    log = event_clicks(spark, sf_dir)
    table = G.add_grouped_features(log, [G.future_click_count(600)], MODEL_MASKS)
    table = table.withColumn("hour", clock.hour_of_day(F.col("click_s")))
    bagged = bag_rows(table.where("is_train"), balanced_bags(log.where("is_train"), [0]))
    return table, *dataset.time_split(cut_lineage(bagged), "2024-01-20 16:00:00")


def _model(spark, sf_dir, rounds=8, patience=None):
    table, train, valid = _model_rows(spark, sf_dir)
    return training.fit_with_validation(train, valid, DESIGN, MODEL_PARAMS, rounds, 0, patience=patience), table, train, valid


@query("e_gbt_scores_E")
def e_gbt_scores(spark, sf_dir):
    """Fit with validation, refit on both parts for the best number of rounds, score the test rows."""
    model, table, train, valid = _model(spark, sf_dir)
    final = training.fit_all(train.unionByName(valid), DESIGN, MODEL_PARAMS, model.rounds, 0)
    return training.score(final, table.where("NOT is_train")).select("row_id", "prediction")


@query("e_score_range_E", over("E", "SELECT row_id, TRUE AS is_share FROM clicks WHERE NOT is_train"))
def e_score_range(spark, sf_dir):
    """Every test click, and no other, has a score between 0 and 1."""
    return e_gbt_scores(spark, sf_dir).select("row_id", F.col("prediction").between(0, 1).alias("is_share"))


@query("e_importance_total_E", f"SELECT {len(DESIGN.columns)}::BIGINT AS features, 1.0::DOUBLE AS gain, 1.0::DOUBLE AS cuts FROM events LIMIT 1")
def e_importance_total(spark, sf_dir):
    model, _, _, _ = _model(spark, sf_dir)
    kinds = [training.feature_importance(model, kind) for kind in ("gain", "split")]
    return spark.createDataFrame([(len(kinds[0]), *(round(sum(k.values()), 9) for k in kinds))], "features bigint, gain double, cuts double")


@query("e_feature_importance_E")
def e_feature_importance(spark, sf_dir):
    model, _, _, _ = _model(spark, sf_dir)
    named = training.feature_importance(model)
    return spark.createDataFrame(list(named.items()), "feature string, importance double")


@query("e_auc_history_E")
def e_auc_history(spark, sf_dir):
    model, _, train, valid = _model(spark, sf_dir)
    both = train.withColumn("set", F.lit("train")).unionByName(valid.withColumn("set", F.lit("valid")))
    return training.auc_history(model, both)


# Trees whose AUCs are checked.
ROUNDS = 200


@query("e_auc_rounds_E", over("E", f"""
+ steps AS (
  SELECT row_id, label, is_train, iteration, sum((row_id * (7919 + iteration)) % 1001 - 500) OVER (PARTITION BY row_id ORDER BY iteration)::DOUBLE AS margin
  FROM (SELECT row_id, is_attributed AS label, is_train FROM clicks), (SELECT unnest(range(1, {ROUNDS + 1})) AS iteration)),
r AS (SELECT *, rank() OVER (PARTITION BY is_train, iteration ORDER BY margin)
  + (count(*) OVER (PARTITION BY is_train, iteration, margin) - 1) / 2.0::DOUBLE AS rank FROM steps)
SELECT is_train, iteration::INTEGER AS iteration, round((sum(CASE WHEN label = 1 THEN rank END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
  / nullif(sum(label)::DOUBLE * sum(1 - label), 0), 9) AS auc FROM r GROUP BY is_train, iteration"""))
def e_auc_rounds(spark, sf_dir):
    """AUC after each of many trees whose outputs are given."""
    log = event_clicks(spark, sf_dir)
    outputs = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda k: (F.col("row_id") * (7919 + k) % 1001 - 500).cast("double"))
    rows = log.select("row_id", "is_train", F.col("is_attributed").alias("label"), outputs.alias("outputs"))
    return training.auc_per_round(rows, "outputs", ["is_train"]).withColumn("auc", F.round("auc", 9))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: future and previous click features by app and device."""
    log = event_clicks(spark, sf_dir)
    features = [G.future_click_count(600), G.prev_click_time_delta(), G.average_attributed_ratio()]
    return G.add_grouped_features(log, features, [("app", "device"), ("ip",), ALL_KEYS])
