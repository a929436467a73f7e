"""Topic mixtures of documents by LDA, by one of two methods that the caller names.

"online" passes over all documents with the updates of online variational Bayes; its topics (words x k) are on the driver.
"joins" writes the variational updates as joins and grouped sums over the (doc, term, tf) entries: topics and mixtures stay
tables at any size of the vocabulary, such as the users of an app, and only k numbers per round reach the driver.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickmill.operators.factors import BROADCAST_FACTORS, start_factor
from clickmill.operators.lookup import is_short
from clickmill.session import cut_lineage, forget, written

# Passes of the online fit over all documents, at any number of them, and how much the t-th one counts: (OFFSET + t) ** -DECAY.
PASSES = 20
OFFSET, DECAY = 1.0, 0.7
# A document's parameters are found when they change by less than this on average.
SETTLED = 1e-3
# Words whose sums travel in one row, and numbers in a matrix of counts.
PIECE = 1 << 14
CELLS = 1 << 19
# The fit by joins ends when the shares of topics change by less than this on average, or with a warning after so many rounds.
TOLERANCE = 1e-3
ROUNDS = 30


def word_counts(terms: DataFrame, words: list[str]) -> DataFrame:
    """(doc, alike, places, counts): the words of each document, numbered 0 .. size-1, and a digest of them.

    A row holds each word of the vocabulary once at most, however many clicks it counts. Documents with equal words and
    counts have the same digest.
    """
    vocabulary = terms.select(*words).distinct()
    numbered = vocabulary.withColumn("place", F.row_number().over(Window.orderBy(*words)) - 1)
    packed = (
        terms.join(numbered, words)
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.col("tf").cast("double").alias("tf")))).alias("_words"))
    )
    alike = F.sha2(F.to_json("_words"), 256).alias("alike")
    return packed.select("doc", alike, F.col("_words.place").alias("places"), F.col("_words.tf").alias("counts"))


def _matrices(batch: pa.RecordBatch):
    """(rows, words, counts): slices of the batch as dense matrices, rows x the words that a slice has."""
    starts = batch["places"].offsets.to_numpy() - batch["places"].offsets[0].as_py()
    places, counts = batch["places"].flatten().to_numpy(), batch["counts"].flatten().to_numpy()
    some = int(np.clip(CELLS // max(1, len(np.unique(places))), 1, batch.num_rows or 1))
    for low in range(0, batch.num_rows, some):
        high = min(low + some, batch.num_rows)
        own = slice(starts[low], starts[high])
        words, column = np.unique(places[own], return_inverse=True)
        matrix = np.zeros((high - low, len(words)))
        matrix[np.repeat(np.arange(high - low), np.diff(starts[low : high + 1])), column] = counts[own]
        yield slice(low, high), words, matrix


def document_parameters(counts: np.ndarray, topics: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Dirichlet parameters of the rows of ``counts`` (documents x words) under ``topics`` (words x k) and the ``prior`` of k
    numbers.

    Every second update is carried on by squared extrapolation, without which documents of a million clicks take thousands of
    updates. A document is done when a plain update moves it by less than ``SETTLED`` on average.
    """
    found, left = np.empty((len(counts), topics.shape[1])), np.arange(len(counts))
    now = np.ones_like(found)

    def updated(parameters):
        share = np.exp(digamma(parameters))
        return prior + share * ((counts / (share @ topics.T + 1e-100)) @ topics)

    while len(left):
        new = updated(now)
        moved = new - now
        more = np.abs(moved).mean(1) >= SETTLED
        found[left[~more]] = new[~more]
        if not more.all():
            left, counts, now, new, moved = left[more], counts[more], now[more], new[more], moved[more]
        if len(left):
            bend = updated(new) - new - moved
            step = np.sqrt((moved**2).sum(1, keepdims=True) / ((bend**2).sum(1, keepdims=True) + 1e-300))
            step = np.maximum(step, 1.0)  # at 1 it is two plain updates
            now = np.maximum(now + 2 * step * moved + step**2 * bend, prior)
    return found


def online_mixtures(terms: DataFrame, k: int, words, size: int, seed: int) -> DataFrame:
    """(doc, f): topic shares by online variational Bayes whose batches are all documents.

    Tasks find the parameters of the documents and add up what they give to each word; documents with equal words and counts
    have equal parameters, so one of them stands for all, with their number as its weight.
    """
    spark = terms.sparkSession
    documents = written(word_counts(terms, words), "documents")
    kinds = documents.groupBy("alike").agg(F.first("places").alias("places"), F.first("counts").alias("counts"), F.count("*").cast("double").alias("n"))
    # The layout is fixed, so that the fit is repeatable.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = written(kinds.repartition(parts, "alike").sortWithinPartitions("alike"), "kinds")
    topics, prior = np.random.default_rng(seed).gamma(100.0, 0.01, (size, k)), np.full(k, 1.0 / k)
    for t in range(1, PASSES + 1):
        weight = (OFFSET + t) ** -DECAY
        given, logs = _sums(kinds, topics, prior)
        topics = (1 - weight) * topics + weight * (1.0 / k + given)
        prior = next_prior(prior, logs, weight)
    shared = spark.sparkContext.broadcast(_expected_topics(topics))

    def shares(batches):
        for batch in batches:
            for rows, found, matrix in _matrices(batch):
                f = document_parameters(matrix, shared.value[found], prior)
                f /= f.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch["alike"][rows], pa.array(list(f), pa.list_(pa.float64()))], ["alike", "f"])

    mixtures = written(kinds.mapInArrow(shares, "alike string, f array<double>"), "mixtures")
    shared.destroy()
    found = cut_lineage(documents.select("doc", "alike").join(mixtures, "alike").select("doc", "f"))
    forget(documents, kinds, mixtures)
    return found


def _expected_topics(topics: np.ndarray) -> np.ndarray:
    return np.exp(digamma(topics) - digamma(topics.sum(0)))


def next_prior(prior: np.ndarray, logs: np.ndarray, weight: float) -> np.ndarray:
    """A step of Newton's method, ``weight`` long, towards the likeliest prior of documents whose mean expected log shares are
    ``logs``; none if a number would not stay positive."""
    slope = digamma(prior.sum(keepdims=True)) - digamma(prior) + logs
    bends = -trigamma(prior)
    common = (slope / bends).sum() / (1 / trigamma(prior.sum(keepdims=True)) + (1 / bends).sum())
    new = prior - weight * (slope - common) / bends
    return new if (new > 0).all() else prior


def _sums(kinds: DataFrame, topics: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the documents give to each word (words x k) under ``topics`` and ``prior``, and the mean of their expected log shares.

    Sums come per piece of the vocabulary, added up in tasks if there are many, so that the driver sees each number once. The
    logs, with the number of documents, come as the piece at -1.
    """
    size, k = topics.shape
    shared = kinds.sparkSession.sparkContext.broadcast(_expected_topics(topics))

    def sums(batches):
        total, logs = np.zeros((size, k)), np.zeros(k + 1)
        for batch in batches:
            weights = batch["n"].to_numpy()
            for own, words, matrix in _matrices(batch):
                expected = shared.value[words]
                found = document_parameters(matrix, expected, prior)
                shares, n = digamma(found), weights[own]
                logs += np.append(n @ (shares - digamma(found.sum(1, keepdims=True))), n.sum())
                share = np.exp(shares)
                matrix *= n[:, None] / (share @ expected.T + 1e-100)
                total[words] += expected * (matrix.T @ share)
        pieces = [(low, total[low : low + PIECE]) for low in range(0, size, PIECE)]
        for low, part in [(-1, logs), *pieces]:
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["low", "part"])

    def add(key, frame):
        return pd.DataFrame({"low": [key[0]], "part": [sum(map(np.frombuffer, frame["part"])).tobytes()]})

    schema = "low int, part binary"
    found = kinds.mapInArrow(sums, schema)
    if size > PIECE:
        found = found.groupBy("low").applyInPandas(add, schema)
    total, logs = np.zeros((size, k)), np.zeros(k + 1)
    for row in found.collect():
        part = np.frombuffer(row["part"])
        if row["low"] < 0:
            logs += part
        else:
            total[row["low"] : row["low"] + PIECE] += part.reshape(-1, k)
    shared.destroy()
    return total, logs[:k] / logs[k]


def topic_mixtures(
    terms: DataFrame, docs: DataFrame, k: int, words=("term",), seed: int = 71, method: str = "online",
    tolerance: float = TOLERANCE, rounds: int = ROUNDS,
) -> DataFrame:
    """(doc, f): k topic shares for every row of ``docs``; documents without words get 1/k each.

    ``method`` "online" keeps the topics (words x k numbers) on the driver; "joins" keeps them in tables, for
    vocabularies of any size. The choice is the caller's and never made by a count.
    """
    uniform = F.array_repeat(F.lit(1.0 / k), k)
    size = terms.select(*words).distinct().count()
    if not size:
        return docs.select("doc", uniform.alias("f"))
    if method == "joins":
        found = fitted_mixtures(terms, k, words, seed, tolerance, rounds)
    elif method == "online":
        found = online_mixtures(terms, k, list(words), size, seed)
    else:
        raise ValueError(f"unknown method {method!r}")
    return docs.join(found, "doc", "left").select("doc", F.coalesce("f", uniform).alias("f"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log-gamma for positive numbers: the series at x + 6, and the recurrence back."""
    shift = 1 / x
    for step in range(1, 6):
        shift += 1 / (x + step)
    x = x + 6
    inverse = 1 / (x * x)
    return np.log(x) - 0.5 / x - inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252)) - shift


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of :func:`digamma`, in the same way."""
    shift = sum(1 / (x + step) ** 2 for step in range(6))
    x = x + 6
    inverse = 1 / (x * x)
    return shift + 1 / x + inverse / 2 + inverse / x * (1 / 6 - inverse * (1 / 30 - inverse / 42))


def _expected(column: Column, totals: np.ndarray | None = None) -> Column:
    """exp(E[log p]) of Dirichlet parameters, normalised by the row's sum or by ``totals``."""

    @F.pandas_udf("array<double>")
    def expected(f: pd.Series) -> pd.Series:
        if not len(f):
            return f
        values = np.stack(f.to_numpy())
        whole = values.sum(1, keepdims=True) if totals is None else totals[None, :]
        return pd.Series(list(np.exp(digamma(values) - digamma(whole))))

    return expected(column)


def _weighted(entries: DataFrame, topics: DataFrame, shares: DataFrame, by: str, k: int, short: dict) -> DataFrame:
    """(id, f): the counts of each document or term, from the current topics and shares, with the prior."""
    beta, theta = topics.select(F.col("id").alias("term"), "b"), shares.select(F.col("id").alias("doc"), "t")
    joined = entries.join(F.broadcast(beta) if short["term"] else beta, "term")
    joined = joined.join(F.broadcast(theta) if short["doc"] else theta, "doc")
    fit = sum(F.col("b")[i] * F.col("t")[i] for i in range(k)) + F.lit(1e-100)
    summed = joined.select(by, "b", "t", (F.col("weight") / fit).alias("r")).groupBy(F.col(by).alias("id")).agg(
        *[F.sum(F.col("r") * F.col("b")[i] * F.col("t")[i]).alias(f"f{i}") for i in range(k)]
    )
    return summed.select("id", F.array(*[F.col(f"f{i}") + F.lit(1.0 / k) for i in range(k)]).alias("f"))


def _normalised(column: str) -> Column:
    whole = F.aggregate(column, F.lit(0.0), lambda total, v: total + v)
    return F.transform(column, lambda v: v / whole)


def fitted_mixtures(terms: DataFrame, k: int, words=("term",), seed: int = 71, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(doc, f): topic shares by batch variational updates.

    A round takes the documents' shares from the topics, then the topics from those shares. It is one job that writes both
    tables; the mean change of a share, which is read from them, decides about another round.
    """
    entries = terms.select("doc", F.struct(*words).alias("term"), F.col("tf").cast("double").alias("weight"))
    entries = written(entries, "entries")
    ids = {side: entries.select(F.col(side).alias("id")).distinct() for side in ("doc", "term")}
    short = {side: is_short(found, BROADCAST_FACTORS) for side, found in ids.items()}
    start = start_factor(ids["term"], k, seed, positive=True)
    topics = written(start.select("id", F.transform("f", lambda v: v + 1).alias("f")), "topics")
    shares = written(ids["doc"].select("id", F.array_repeat(F.lit(1.0), k).alias("f")), "shares")
    for _ in range(rounds):
        totals = np.array(topics.agg(*[F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(k)]).first())
        beta = topics.select("id", _expected(F.col("f"), totals).alias("b"))
        theta = shares.select("id", _expected(F.col("f")).alias("t"))
        after = _weighted(entries, beta, theta, "doc", k, short).withColumnRenamed("f", "new")
        after = written(after.join(shares, "id"), "shares")
        apart = F.zip_with(_normalised("new"), _normalised("f"), lambda x, y: F.abs(x - y))
        change = after.agg(F.avg(F.aggregate(apart, F.lit(0.0), lambda total, v: total + v) / k)).first()[0]
        shares = after.select("id", F.col("new").alias("f"))
        if change < tolerance:
            break
        theta = shares.select("id", _expected(F.col("f")).alias("t"))
        topics = written(_weighted(entries, beta, theta, "term", k, short), "topics")
    else:
        warnings.warn(f"topic shares still changed by {change:.2g} after {rounds} rounds", stacklevel=2)
    return cut_lineage(shares.select(F.col("id").alias("doc"), _normalised("f").alias("f")))
