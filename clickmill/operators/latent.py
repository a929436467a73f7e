"""Latent vectors of categories, as columns for every click."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import permutations

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmill.functions.keys import KEYS
from clickmill.operators import documents as D
from clickmill.operators.factors import nmf, nmf_each, svd_each, top_directions, truncated_svd
from clickmill.operators.lookup import CHUNK_ROWS, small_or_spread_lookup, with_chunk
from clickmill.operators.topics import topic_mixtures
from clickmill.session import cut_lineage, written

# Fixed value: the order in which column pairs are listed.
PAIR_ORDER = ("ip", "app", "os", "device", "channel")
NO_DEVICE = ("ip", "app", "os", "channel")
SALTS = 1024
PAIRS_AT_ONCE = 4


def pairs(columns=PAIR_ORDER, first: str | None = None, order: str | None = None) -> list[tuple[str, str]]:
    """Ordered column pairs; ``first`` fixes the document column, ``order`` compares names."""
    found = [p for p in permutations(columns, 2) if first is None or p[0] == first]
    if order == "<":
        return [p for p in found if p[0] < p[1]]
    if order == ">":
        return [p for p in found if p[0] > p[1]]
    return found


@dataclass(frozen=True)
class LatentSpec:
    name: str
    method: str
    width: int
    min_df: int
    pairs: tuple[tuple[str, str], ...]


def _spec(name, method, width, min_df, found):
    return LatentSpec(name, method, width, min_df, tuple(found))


# Names, widths, least document frequencies and pairs of the stored configurations.
SPECS = {
    "komaki_lda_5": _spec("KomakiLDA5", "lda", 5, 2, pairs()),
    "komaki_lda_5_no_device": _spec("KomakiLDA5NoDevice", "lda", 5, 2, pairs(NO_DEVICE)),
    "komaki_lda_5_mindf_1": _spec("KomakiLDA5MinDF1", "lda", 5, 1, pairs()),
    "komaki_lda_10_no_device_1": _spec("KomakiLDA10NoDevice_1", "lda", 10, 1, pairs(NO_DEVICE, order="<")),
    "komaki_lda_10_no_device_2": _spec("KomakiLDA10NoDevice_2", "lda", 10, 1, pairs(NO_DEVICE, order=">")),
    "komaki_lda_20_no_device_ip": _spec("KomakiLDA20NoDevice_Ip", "lda", 20, 1, pairs(NO_DEVICE, "ip")),
    "komaki_lda_10_ip": _spec("KomakiLDA10_Ip", "lda", 10, 1, pairs(first="ip")),
    "komaki_lda_20_ip": _spec("KomakiLDA20_Ip", "lda", 20, 1, pairs(first="ip")),
    "komaki_lda_30_ip": _spec("KomakiLDA30_Ip", "lda", 30, 1, pairs(first="ip")),
    "komaki_lda_20_no_device_app": _spec("KomakiLDA20NoDevice_App", "lda", 20, 1, pairs(NO_DEVICE, "app")),
    "komaki_lda_20_no_device_os": _spec("KomakiLDA20NoDevice_Os", "lda", 20, 1, pairs(NO_DEVICE, "os")),
    "komaki_lda_20_no_device_channel": _spec(
        "KomakiLDA20NoDevice_Channel", "lda", 20, 1, pairs(NO_DEVICE, "channel")
    ),
    "komaki_pca_5": _spec("KomakiPCA5", "svd", 5, 2, pairs()),
    "komaki_pca_5_no_device": _spec("KomakiPCA5NoDevice", "svd", 5, 2, pairs(NO_DEVICE)),
    "komaki_nmf_5": _spec("KomakiNMF5", "nmf", 5, 2, pairs()),
    "komaki_nmf_5_no_device": _spec("KomakiNMF5NoDevice", "nmf", 5, 2, pairs(NO_DEVICE)),
}


def latent_table(
    clicks: DataFrame, doc: str, term: str, method: str, width: int, min_df: int, compat: bool = False, lda: str = "online"
) -> DataFrame:
    """(doc, f): the latent vector of every value of column ``doc``, by its ``term`` values.

    ``compat`` leaves out the term values 0-9; ``lda`` is the method of ``topics.topic_mixtures``.
    """
    counts = cut_lineage(D.cooccurrence(clicks, doc, term))
    docs = counts.select("doc").distinct()
    terms = D.document_terms(counts, min_df, compat)
    if method == "lda":
        return topic_mixtures(terms, docs, width, method=lda)
    weights = D.tfidf(terms, D.document_count(counts))
    if method == "svd":
        found, _ = truncated_svd(weights, width)
    elif method == "nmf":
        found, _, _ = nmf(weights, width)
    else:
        raise ValueError(f"unknown method {method!r}")
    zero = F.array_repeat(F.lit(0.0), width)
    found = found.withColumnRenamed("id", "doc")
    return docs.join(found, "doc", "left").select("doc", F.coalesce("f", zero).alias("f"))


def latent_tables(clicks: DataFrame, spec: LatentSpec, compat: bool = False) -> dict[tuple[str, str], DataFrame]:
    """:func:`latent_table` of every pair of a configuration by SVD or NMF, all matrices factored together."""
    counts = written(D.stacked_cooccurrence(clicks, list(spec.pairs), list(KEYS)), "counts")
    weights = D.stacked_tfidf(counts, spec.min_df, compat)
    factors = {"svd": svd_each, "nmf": nmf_each}[spec.method](weights, spec.width)
    found = written(factors[0].withColumnRenamed("id", "doc"), "vectors")
    zero = F.array_repeat(F.lit(0.0), spec.width)
    out = {}
    for m, pair in enumerate(spec.pairs):
        docs = counts.where(F.col("m") == m).select("doc").distinct()
        own = found.where(F.col("m") == m).select("doc", "f")
        out[pair] = docs.join(own, "doc", "left").select(F.col("doc").cast(clicks.schema[pair[0]].dataType).alias("doc"), F.coalesce("f", zero).alias("f"))
    return out


def vector_columns(vector: Column, prefix: str, width: int) -> list[Column]:
    return [vector[i].cast("float").alias(f"{prefix}_{i}") for i in range(width)]


def add_latent_vectors(
    clicks: DataFrame, spec: LatentSpec, chunk_rows: int = CHUNK_ROWS, compat: bool = False, lda: str = "online"
) -> DataFrame:
    """``Name_col1_col2_j`` columns for every pair of the configuration.

    Pairs of one document column share the lookup from clicks to values.
    """
    rows = with_chunk(clicks, chunk_rows)

    def fitted(pair):
        return latent_table(clicks, *pair, spec.method, spec.width, spec.min_df, compat, lda)

    # Topics of the pairs are independent jobs, a few at a time; matrices are factored together.
    if spec.method == "lda":
        with ThreadPoolExecutor(PAIRS_AT_ONCE) as pool:
            # The wrapper copies the caller's local properties once, so every pair has one of its own: in a shared copy
            # threads overwrite and clear the execution ids that Spark keeps there.
            runs = [pool.submit(inheritable_thread_target(clicks.sparkSession)(fitted), pair) for pair in spec.pairs]
            tables = {pair: run.result() for pair, run in zip(spec.pairs, runs)}
    else:
        tables = latent_tables(clicks, spec, compat)
    names = []
    for column in dict.fromkeys(p[0] for p in spec.pairs):
        table = None
        for doc, term in (p for p in spec.pairs if p[0] == column):
            found = tables[(doc, term)]
            prefix = f"{spec.name}_{doc}_{term}"
            found = found.select(F.col("doc").alias(column), *vector_columns(F.col("f"), prefix, spec.width))
            names += [f"{prefix}_{i}" for i in range(spec.width)]
            table = found if table is None else table.join(found, column)
        rows = small_or_spread_lookup(rows, cut_lineage(table), [column])
    return rows.select(*clicks.columns, *names)


# ---------------------------------------------------------------- one-hot rows


def _value(key: str) -> Column:
    """A key's value as one number across all five columns."""
    return F.lit(KEYS.index(key) << 40).cast("bigint") + F.col(key)


def one_hot_directions(clicks: DataFrame, k: int, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """(combinations with weights, directions) of the click x category-value matrix.

    Clicks equal on all keys are one row with a count. The right singular vectors are the
    leading eigenvectors of the value x value co-occurrence sums, so the wide one-hot matrix
    is never made.
    """
    combos = clicks.groupBy(*KEYS).agg(F.count("*").alias("n"))
    combos = combos.withColumn("chunk", F.pmod(F.xxhash64(*KEYS), F.lit(SALTS)))
    if weighted:
        total = clicks.count()
        for key in KEYS:
            df = clicks.groupBy(key).agg(F.count("*").alias("df"))
            idf = df.select(key, D.inverse_frequency(total).alias(f"w_{key}"))
            combos = small_or_spread_lookup(combos, idf, [key])
        length = F.sqrt(sum(F.col(f"w_{key}") * F.col(f"w_{key}") for key in KEYS))
        combos = combos.select(*KEYS, "chunk", "n", *[(F.col(f"w_{k}") / length).alias(f"w_{k}") for k in KEYS])
    else:
        combos = combos.withColumns({f"w_{key}": F.lit(1.0) for key in KEYS})
    combos = cut_lineage(combos)
    # The row is always five values wide, so these are 25 pairs per combination.
    together = [
        F.struct(
            _value(a).alias("doc"), _value(b).alias("term"),
            (F.col("n") * F.col(f"w_{a}") * F.col(f"w_{b}")).alias("weight"),
        )
        for a in KEYS
        for b in KEYS
    ]
    entries = (
        combos.select(F.explode(F.array(*together)).alias("e"))
        .groupBy("e.doc", "e.term")
        .agg(F.sum("e.weight").alias("weight"))
    )
    return combos, cut_lineage(top_directions(entries, k))


def add_one_hot_svd(
    clicks: DataFrame, weighted: bool = False, k: int = 30, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``SinglePCACount_j`` (``SinglePCATfIdf_j`` if ``weighted``): SVD scores of each click."""
    name = "SinglePCATfIdf" if weighted else "SinglePCACount"
    combos, directions = one_hot_directions(clicks, k, weighted)
    for key in KEYS:
        table = directions.select(F.col("id").alias("_value"), F.col("f").alias(f"f_{key}"))
        combos = small_or_spread_lookup(combos.withColumn("_value", _value(key)), table, ["_value"]).drop("_value")
    scores = [
        sum(F.col(f"w_{key}") * F.col(f"f_{key}")[i] for key in KEYS).cast("float").alias(f"{name}_{i}")
        for i in range(k)
    ]
    table = cut_lineage(combos.select(*KEYS, *scores))
    rows = small_or_spread_lookup(with_chunk(clicks, chunk_rows), table, list(KEYS))
    return rows.select(*clicks.columns, *[f"{name}_{i}" for i in range(k)])


# ---------------------------------------------------------------- users and items


def add_user_item_lda(
    clicks: DataFrame, k: int = 30, min_df: int = 1, chunk_rows: int = CHUNK_ROWS, compat: bool = False, lda: str = "online"
) -> DataFrame:
    """``UserItemLDA_j``: topic shares of the click's user over apps; zeros for users below three clicks."""
    counts = D.user_documents(clicks).withColumn("doc", F.struct(*D.USER)).withColumnRenamed("app", "term")
    counts = cut_lineage(counts.select("doc", "term", "tf"))
    terms = D.document_terms(counts, min_df, compat)
    table = topic_mixtures(terms, counts.select("doc").distinct(), k, method=lda).select("doc.*", "f")
    rows = small_or_spread_lookup(with_chunk(clicks, chunk_rows), cut_lineage(table), D.USER)
    share = F.coalesce("f", F.array_repeat(F.lit(0.0), k))
    return rows.select(*clicks.columns, *vector_columns(share, "UserItemLDA", k))


def add_item_user_lda(
    clicks: DataFrame, k: int = 30, min_df: int = 1, chunk_rows: int = CHUNK_ROWS, compat: bool = False, lda: str = "online"
) -> DataFrame:
    """``ItemUserLDA_j``: topic shares of the click's app over its users."""
    counts = cut_lineage(D.item_documents(clicks, compat).withColumnRenamed("app", "doc"))
    frequent = counts.groupBy(*D.USER).agg(F.count("*").alias("_df"))
    frequent = frequent.where(F.col("_df") >= min_df).drop("_df")
    docs = clicks.select(F.col("app").alias("doc")).distinct()
    table = topic_mixtures(counts.join(frequent, D.USER), docs, k, words=D.USER, method=lda)
    table = cut_lineage(table.withColumnRenamed("doc", "app"))
    rows = small_or_spread_lookup(with_chunk(clicks, chunk_rows), table, ["app"])
    return rows.select(*clicks.columns, *vector_columns(F.col("f"), "ItemUserLDA", k))
