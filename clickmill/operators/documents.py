"""Sparse document-term tables from category co-occurrence, as (doc, term, tf) rows.

A document is a value of one column (or a user), its words are the values of another column
over all its clicks. Words are counted at once; click-long word lists never exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: in compatible vocabularies words of one character are not kept, so the ids 0-9 are no words.
FIRST_WORD = 10
USER = ["ip", "device", "os", "channel"]
USER_MIN_CLICKS = 3


def cooccurrence(clicks: DataFrame, doc: str, term: str) -> DataFrame:
    return clicks.groupBy(F.col(doc).alias("doc"), F.col(term).alias("term")).agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, min_df: int, drop_single_digit: bool = False) -> DataFrame:
    """(term, df) of the terms kept: in ``min_df`` documents or more, and if asked for, at least two digits long."""
    kept = counts.where(F.col("term") >= FIRST_WORD) if drop_single_digit else counts
    return kept.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def document_terms(counts: DataFrame, min_df: int, drop_single_digit: bool = False) -> DataFrame:
    """(doc, term, tf, df) restricted to the vocabulary."""
    return counts.join(vocabulary(counts, min_df, drop_single_digit), "term").select("doc", "term", "tf", "df")


def inverse_frequency(documents: int) -> Column:
    """ln((1 + n) / (1 + df)) + 1"""
    return F.log(F.lit(1.0 + documents) / (1 + F.col("df"))) + 1


def tfidf(terms: DataFrame, documents: int) -> DataFrame:
    """(doc, term, weight): tf times inverse frequency, each document scaled to length 1."""
    raw = terms.select("doc", "term", (F.col("tf") * inverse_frequency(documents)).alias("_raw"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_norm"))
    return raw.join(norms, "doc").select("doc", "term", (F.col("_raw") / F.col("_norm")).alias("weight"))


def document_count(counts: DataFrame) -> int:
    """Documents are numbered 0 .. largest value, so values that never occur count as empty ones."""
    largest = counts.agg(F.max("doc")).first()[0]
    return 0 if largest is None else largest + 1


def stacked_cooccurrence(clicks: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """(m, doc, term, tf): :func:`cooccurrence` of the m-th pair of columns, for all pairs in one scan of the clicks."""
    combos = clicks.groupBy(*keys).agg(F.count("*").alias("n"))
    each = [F.struct(F.lit(m).alias("m"), F.col(doc).cast("bigint").alias("doc"), F.col(term).cast("bigint").alias("term")) for m, (doc, term) in enumerate(pairs)]
    rows = combos.select("n", F.explode(F.array(*each)).alias("e"))
    return rows.groupBy("e.m", "e.doc", "e.term").agg(F.sum("n").alias("tf"))


def stacked_tfidf(counts: DataFrame, min_df: int, drop_single_digit: bool = False) -> DataFrame:
    """(m, doc, term, weight): :func:`tfidf` of every matrix of ``counts``, each with its own vocabulary and number of documents."""
    kept = counts.where(F.col("term") >= FIRST_WORD) if drop_single_digit else counts
    words = kept.groupBy("m", "term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    documents = F.broadcast(counts.groupBy("m").agg((F.max("doc") + 1).alias("documents")))  # one row per matrix
    raw = counts.join(words, ["m", "term"]).join(documents, "m")
    raw = raw.select("m", "doc", "term", (F.col("tf") * (F.log((1.0 + F.col("documents")) / (1 + F.col("df"))) + 1)).alias("_raw"))
    norms = raw.groupBy("m", "doc").agg(F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_norm"))
    return raw.join(norms, ["m", "doc"]).select("m", "doc", "term", (F.col("_raw") / F.col("_norm")).alias("weight"))


def user_documents(clicks: DataFrame) -> DataFrame:
    """(ip, device, os, channel, app, tf) of the users with at least three clicks."""
    counts = clicks.groupBy(*USER, "app").agg(F.count("*").alias("tf"))
    totals = counts.groupBy(*USER).agg(F.sum("tf").alias("_clicks")).where(F.col("_clicks") >= USER_MIN_CLICKS)
    return counts.join(totals.drop("_clicks"), USER)


def item_documents(clicks: DataFrame, drop_first_users: bool = False) -> DataFrame:
    """(app, ip, device, os, channel, tf): the users of each app.

    ``drop_first_users`` leaves out the first ten users: where users are numbered by first appearance and words must have
    two digits, those have no word.
    """
    counts = clicks.groupBy("app", *USER).agg(F.count("*").alias("tf"), F.min("row_id").alias("_seen"))
    if not drop_first_users:
        return counts.drop("_seen")
    first = counts.groupBy(*USER).agg(F.min("_seen").alias("_seen")).orderBy("_seen").limit(FIRST_WORD)
    return counts.drop("_seen").join(F.broadcast(first.select(*USER)), USER, "left_anti").select("app", *USER, "tf")
