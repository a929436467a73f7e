"""Truncated SVD and NMF of sparse tables by joins and sums.

A matrix is a table of its entries (doc, term, weight); a factor is a table (id, f) with one
array of k numbers per row or column of the matrix. Products of the two are a join and a
grouped sum. Only k x k matrices reach the driver. Many matrices are factored at once when their
number ``m`` is part of every key: twenty then cost as many jobs as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmill.operators.lookup import is_short
from clickmill.session import cut_lineage, forget, written

OVERSAMPLE = 5
# Residual of a singular direction, relative to the largest squared singular value, at which it counts as found.
SVD_RESIDUAL = 1e-6
# A factorisation is done when a round takes less than this share of the first error away.
NMF_SHARE = 1e-4
TINY = 1e-9
# 50,000 rows of 35 doubles are 14 MB; longer factors are joined by shuffle.
BROADCAST_FACTORS = 50_000


def product(entries: DataFrame, out: str, over: str, factor: DataFrame, k: int, short: bool) -> DataFrame:
    """(id, f): for each ``out`` the sum of weight * f over its ``over`` entries."""
    table = factor.select(F.col("id").alias(over), "f")
    joined = entries.join(F.broadcast(table) if short else table, over)
    summed = joined.groupBy(F.col(out).alias("id")).agg(
        *[F.sum(F.col("weight") * F.col("f")[i]).alias(f"f{i}") for i in range(k)]
    )
    return summed.select("id", F.array(*[F.col(f"f{i}") for i in range(k)]).alias("f"))


def gram(left: DataFrame, right: str | None = None) -> np.ndarray:
    """k x k matrix of the sums of f (x) f, or of f (x) ``right``, over all rows."""
    right = right or "f"

    def partial(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = np.stack(batch["a"].to_numpy()).T @ np.stack(batch["b"].to_numpy())
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    pairs = left.select(F.col("f").alias("a"), F.col(right).alias("b"))
    parts = pairs.mapInPandas(partial, "i int, j int, v double")
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max((c["i"] for c in cells), default=-1) + 1
    matrix = np.zeros((size, size))
    for cell in cells:
        matrix[cell["i"], cell["j"]] = cell["v"]
    return matrix


def turned(column: Column, matrix: np.ndarray) -> Column:
    """The array column times a small matrix."""

    @F.pandas_udf("array<double>")
    def multiply(f: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(f.to_numpy()) @ matrix)) if len(f) else f

    return multiply(column)


def start_factor(ids: DataFrame, k: int, seed: int, positive: bool = False) -> DataFrame:
    """Reproducible pseudo-random numbers, a function of id, position and seed alone."""
    unit = [F.xxhash64("id", F.lit(i), F.lit(seed)) / F.lit(float(2**63)) for i in range(k)]
    return ids.select("id", F.array(*[F.abs(u) + 0.01 if positive else u for u in unit]).alias("f"))


def orthonormal(factor: DataFrame) -> tuple[DataFrame, int]:
    """An orthonormal basis of the factor's columns, and its size (less than k at lower rank)."""
    values, vectors = np.linalg.eigh(gram(factor))
    kept = values > max(values.max(initial=0.0), 0.0) * 1e-12
    kept &= values > 0
    basis = vectors[:, kept] / np.sqrt(values[kept])
    if not kept.any():
        return factor.limit(0), 0
    return cut_lineage(factor.select("id", turned(F.col("f"), basis).alias("f"))), int(kept.sum())


def _padded(column: Column, have: int, k: int) -> Column:
    return F.concat(column, F.array_repeat(F.lit(0.0), k - have)) if have < k else column


def grams(rows: DataFrame, *others: tuple[str, str]) -> list[dict[int, np.ndarray]]:
    """Per ``m`` the sums of f (x) f over its rows, and of further pairs of columns: one job for all of them."""
    wanted = [("f", "f"), *others]

    def partial(batches):
        totals: dict = {}
        for batch in batches:
            for m, part in batch.groupby("m"):
                arrays = {c: np.stack(part[c].to_numpy()) for c in {c for pair in wanted for c in pair}}
                for n, (x, y) in enumerate(wanted):
                    totals[m, n] = totals.get((m, n), 0) + arrays[x].T @ arrays[y]
        for (m, n), total in totals.items():
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"m": m, "n": n, "i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    columns = sorted({c for pair in wanted for c in pair})
    cells = rows.select("m", *columns).mapInPandas(partial, "m int, n int, i int, j int, v double").groupBy("m", "n", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out: list[dict] = [{} for _ in wanted]
    for (m, n), part in cells.groupby(["m", "n"]):
        matrix = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        matrix[part["i"], part["j"]] = part["v"]
        out[n][int(m)] = matrix
    return out


def turned_each(column: Column, matrices: dict[int, np.ndarray]) -> Column:
    """The array column times the small matrix of the row's ``m``."""

    @F.pandas_udf("array<double>")
    def multiply(m: pd.Series, f: pd.Series) -> pd.Series:
        out = pd.Series(index=f.index, dtype=object)
        for number, at in m.groupby(m).groups.items():
            out[at] = list(np.stack(f[at].to_numpy()) @ matrices[number])
        return out

    return multiply(F.col("m"), column)


def product_each(entries: DataFrame, out: str, over: str, factor: DataFrame, k: int, short: bool) -> DataFrame:
    """(m, id, f): :func:`product` of every matrix with its factor."""
    table = factor.select("m", F.col("id").alias(over), "f")
    joined = entries.join(F.broadcast(table) if short else table, ["m", over])
    summed = joined.groupBy("m", F.col(out).alias("id")).agg(*[F.sum(F.col("weight") * F.col("f")[i]).alias(f"f{i}") for i in range(k)])
    return summed.select("m", "id", F.array(*[F.col(f"f{i}") for i in range(k)]).alias("f"))


def started(ids: DataFrame, k: int, seed: int, positive: bool = False) -> DataFrame:
    """:func:`start_factor` of each matrix."""
    return start_factor(ids.withColumn("key", F.struct("m", "id")).select(F.col("key").alias("id")), k, seed, positive).select("id.m", "id.id", "f")


def sides(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written: (m, id) of the documents and of the terms."""
    return tuple(written(entries.select("m", F.col(side).alias("id")).distinct(), side) for side in ("doc", "term"))


def whitening(gram_: np.ndarray) -> np.ndarray:
    """What turns vectors of a Gram matrix into orthonormal ones; directions beyond the rank become zero."""
    values, vectors = np.linalg.eigh(gram_)
    kept = values > max(values.max(initial=0.0), 0.0) * 1e-12
    kept &= values > 0
    return np.where(kept, vectors / np.sqrt(np.where(kept, values, 1.0)), 0.0)


def svd_each(entries: DataFrame, k: int, seed: int = 71, iterations: int = 30, residual: float = SVD_RESIDUAL) -> tuple[DataFrame, DataFrame, dict[int, float]]:
    """(scores X V, directions V, residuals) of every matrix in entries (m, doc, term, weight), k wide, without centring.

    Subspace iteration with Rayleigh-Ritz: each round gives every matrix' singular values, and the residual of each
    direction by sums that are there anyway. It ends when all of the k leading ones are found, or after ``iterations``.
    Columns come by falling singular value; directions beyond the rank are zero.
    """
    entries = written(entries, "entries")
    docs, terms = sides(entries)
    short_docs, short_terms = is_short(docs, BROADCAST_FACTORS), is_short(terms, BROADCAST_FACTORS)
    width = k + OVERSAMPLE
    image = written(started(terms, width, seed), "start")
    spans_, residuals = grams(image)[0], {}
    for step in range(iterations):
        basis = image.select("m", "id", turned_each(F.col("f"), {m: whitening(g) for m, g in spans_.items()}).alias("f"))
        scores = written(product_each(entries, "doc", "term", basis, width, short_terms), "scores")
        ritz = {m: np.linalg.eigh(g) for m, g in grams(scores)[0].items()}
        after = written(product_each(entries, "term", "doc", scores, width, short_docs), "image")
        spans_ = grams(after)[0]
        for m, (values, vectors) in ritz.items():
            left = np.einsum("ji,jk,ki->i", vectors, spans_[m], vectors) - values**2
            residuals[m] = float(np.sqrt(max(left[::-1][:k].max(), 0.0)) / max(values[-1], TINY))
        done = all(r <= residual for r in residuals.values()) or step + 1 == iterations
        if done:
            turn = {m: vectors[:, ::-1][:, :k] for m, (_, vectors) in ritz.items()}
            return tuple(t.select("m", "id", turned_each(F.col("f"), turn).alias("f")) for t in (scores, basis)) + (residuals,)
        forget(scores, image)
        image = after
    raise ValueError("at least one iteration is needed")


def nmf_each(entries: DataFrame, k: int, seed: int = 71, iterations: int = 40, share: float = NMF_SHARE) -> tuple[DataFrame, DataFrame, dict[int, list[float]]]:
    """(document factors W, term factors H, squared errors after each round) of every matrix, by multiplicative updates.

    A round is four jobs for all matrices together. It ends when no matrix' round takes away ``share`` of its first error, or
    after ``iterations``. A matrix without weight keeps the factors it starts with and has no errors.
    """
    entries = written(entries, "entries")
    docs, terms = sides(entries)
    short_docs, short_terms = is_short(docs, BROADCAST_FACTORS), is_short(terms, BROADCAST_FACTORS)
    w, h = written(started(docs, k, seed, positive=True), "w"), written(started(terms, k, seed + 1, positive=True), "h")
    squares = {r.m: r.s for r in entries.groupBy("m").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect() if r.s}
    errors: dict[int, list[float]] = {m: [] for m in squares}
    h_gram = grams(h)[0]
    for _ in range(iterations if squares else 0):
        before, w = w, step_each(w, product_each(entries, "doc", "term", h, k, short_terms), h_gram)
        forget(before)
        w_gram = grams(w)[0]
        before, h = h, step_each(h, product_each(entries, "term", "doc", w, k, short_docs), w_gram)
        forget(before)
        h_gram, cross = grams(h, ("f", "g"))
        for m, square in squares.items():
            errors[m].append(float(square - 2 * np.trace(cross[m]) + np.sum(w_gram[m] * h_gram[m])))
        if all(len(e) > 1 and e[-2] - e[-1] < share * e[0] for e in errors.values()):
            break
    return w.select("m", "id", "f"), h.select("m", "id", "f"), errors


def step_each(factor: DataFrame, toward: DataFrame, other: dict[int, np.ndarray]) -> DataFrame:
    """Written: f * toward / (f . gram), the multiplicative step, with ``toward`` as column g."""
    both = factor.select("m", "id", "f").join(toward.withColumnRenamed("f", "g"), ["m", "id"]).withColumn("d", turned_each(F.col("f"), other))
    ratio = F.zip_with("g", "d", lambda g, d: g / F.greatest(d, F.lit(TINY)))
    return written(both.select("m", "id", F.zip_with("f", ratio, lambda f, r: f * r).alias("f"), "g"), "factor")


def truncated_svd(entries: DataFrame, k: int, seed: int = 71, iterations: int = 30) -> tuple[DataFrame, DataFrame]:
    """:func:`svd_each` of one matrix: (id, f) of its document scores and of its term directions."""
    scores, directions, _ = svd_each(entries.withColumn("m", F.lit(0)), k, seed, iterations)
    return scores.drop("m"), directions.drop("m")


def nmf(entries: DataFrame, k: int, seed: int = 71, iterations: int = 40) -> tuple[DataFrame, DataFrame, list[float]]:
    """:func:`nmf_each` of one matrix: (document factor W, term factor H, squared error after each round)."""
    w, h, errors = nmf_each(entries.withColumn("m", F.lit(0)), k, seed, iterations)
    return w.drop("m"), h.drop("m"), errors.get(0, [])


def top_directions(entries: DataFrame, k: int, seed: int = 71, iterations: int = 8) -> DataFrame:
    """(id, f): the k leading eigenvectors of a symmetric matrix with entries (doc, term, weight)."""
    entries = cut_lineage(entries)
    ids = entries.select(F.col("term").alias("id")).distinct()
    short = is_short(ids, BROADCAST_FACTORS)
    basis, width = orthonormal(start_factor(ids, k + OVERSAMPLE, seed))
    for _ in range(iterations):
        basis, width = orthonormal(product(entries, "doc", "term", basis, width, short))
    image = product(entries, "doc", "term", basis, width, short).withColumnRenamed("f", "g")
    values, vectors = np.linalg.eigh(gram(basis.join(image, "id"), "g"))
    turn = vectors[:, np.argsort(-values)][:, :k]
    return basis.select("id", _padded(turned(F.col("f"), turn), turn.shape[1], k).alias("f"))
