"""Mixing sources to target weights by temperature, as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .heavy import join_unique
from .totals import running_totals

#: Tokens of a block; levels of the bisection per job, and jobs; decimals of the exponent.
BLOCK_TOKENS, LEVELS, JOBS, DECIMALS = 1 << 18, 4, 11, 9
#: Bounds of the exponent.
LOW, HIGH = 0.0, 16.0


@dataclass
class Mixture:
    """The exponent, the budget, and ``weights``: source key, tokens, weight, token budget, documents."""

    exponent: float
    budget: int
    weights: DataFrame


def source_key(column: Column) -> Column:
    """Null sources are a group of their own."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit(""))


def token_count(text: Column) -> Column:
    """Words between ASCII blanks and one end of document."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint") + 1


def bisect(sources: DataFrame, total: int, budget: int, entropy: float | None, repeats: float | None) -> float:
    """Exponent at which the weights have the entropy (in nats), or at which no source is repeated more often.

    Entropy falls as the exponent grows; so does, up to 1, the largest number of passes over a source. The bounds
    are halved ``LEVELS`` times per job: all points that these steps could ask for are evaluated together, as sums over the
    table of sources, and the steps are then taken with the answers. An entropy that no exponent gives, or a limit that
    even shares in proportion break, leads to the nearer bound.
    """
    low, high = (LOW, HIGH) if repeats is None else (LOW, 1.0)
    p = F.col("tokens") / float(total)
    for _ in range(JOBS):
        points = [low + (high - low) * k / (1 << LEVELS) for k in range(1, 1 << LEVELS)]
        columns = []
        for k, a in enumerate(points):
            w = F.pow(p, F.lit(a))
            columns += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log(w)).alias(f"s{k}"), F.max(w / F.col("tokens")).alias(f"r{k}")]
        got = sources.agg(*columns).first()
        left, right = 0, 1 << LEVELS
        while right - left > 1:
            mid = (left + right) // 2
            z, s, r = (got[f"{c}{mid - 1}"] for c in "zsr")
            over = math.log(z) - s / z > entropy if repeats is None else budget * r / z > repeats
            left, right = (mid, right) if over else (left, mid)
        step = (high - low) / (1 << LEVELS)
        low, high = low + left * step, low + right * step
    return round((low + high) / 2, DECIMALS)


def entropies(sources: DataFrame, total: int) -> tuple[float, float]:
    """Entropy of equal weights and of the shares themselves, in nats."""
    p = F.col("tokens") / float(total)
    got = sources.agg(F.count("*").alias("n"), F.sum(-p * F.log(p)).alias("h")).first()
    return math.log(max(1, got.n)), got.h or 0.0


def mixture(tokens: DataFrame, budget: int | None = None, entropy: float | None = None, repeats: float | None = None, most_passes: float | None = None) -> Mixture:
    """Weights of the sources of ``tokens(key, n_tokens)``.

    Without a target, the entropy half-way between the shares' own and that of equal weights is aimed at. ``most_passes``
    bounds the passes over any source on top of an entropy: where the target would repeat a source more often, the exponent
    is raised until it does not, so a tiny source beside large ones cannot fill the budget with its copies. The budget
    is by default the number of tokens there are.
    """
    sources = table(tokens.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    if not total:
        return Mixture(1.0, 0, sources.withColumn("weight", F.lit(0.0)).withColumn("budget", F.lit(0).cast("bigint")))
    if entropy is None and repeats is None:
        flat, own = entropies(sources, total)
        entropy = (flat + own) / 2
    several = sources.count() > 1
    exponent = bisect(sources, total, budget, entropy, repeats) if several else 1.0
    if several and most_passes is not None and exponent < 1:
        exponent = max(exponent, bisect(sources, total, budget, None, most_passes))
    w = F.pow(F.col("tokens") / float(total), F.lit(exponent))
    z = sources.agg(F.sum(w)).first()[0]
    weights = sources.withColumn("weight", w / z).withColumn("budget", F.round(F.col("weight") * budget).cast("bigint"))
    return Mixture(exponent, budget, weights)


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in the permutation of an epoch."""
    return F.md5(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), epoch.cast("string"), F.lit(str(seed))))


def copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, budget: int | None, entropy: float | None, repeats: float | None, most_passes: float | None) -> tuple[DataFrame, Mixture]:
    """Rows ``(doc_id, source, key, epoch, place, n_tokens, before, budget)`` of the chosen passes, and the mixture.

    A source's passes follow each other, each in a permutation of its own; those rows stay that begin within the budget.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), source_key(F.col(source_col)).alias("key"), token_count(text).alias("n_tokens"), F.md5(F.coalesce(text, F.lit(""))).alias("content")
    )
    narrow = table(narrow, "mixed")
    mix = mixture(narrow.select("key", "n_tokens"), budget, entropy, repeats, most_passes)
    mix.weights = table(mix.weights, "weights")
    passes = join_unique(narrow, mix.weights.select("key", "tokens", "budget"), "key")
    last = F.greatest(F.ceil(F.col("budget") / F.col("tokens")) - 1, F.lit(0))
    passes = passes.where("budget > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    passes = passes.withColumn("place", order_key(F.col("doc_id"), F.col("epoch"), seed))
    placed = running_totals(passes, ["key"], ["epoch", "place", "doc_id", "content"], F.col("n_tokens"))
    return placed.where("before < budget"), mix


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, budget: int | None = None, entropy: float | None = None, repeats: float | None = None, most_passes: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The mixed corpus: one row per chosen copy of a document, with its block and its position there.

    Sources get weights in proportion to their token share to the power of an exponent that is found by bisection, for a
    target ``entropy`` or a limit on ``repeats``, and never with more than ``most_passes`` over a source, if given. Tokens are
    words between blanks, not ids of a tokenizer. Each source's documents are taken in random order, pass after pass, until
    its part of the ``budget`` is reached, so a source is repeated or cut short; the last copy may reach beyond. All sources
    are then spread evenly over blocks of ``block_tokens`` tokens: every block holds them in the same weights, in a
    random order. Columns: ``doc_id``, ``source``, ``epoch``, ``n_tokens``, ``block``, ``position``.

    A null source is a source; a null or empty text is one token; a null id and rows that repeat an id take part as rows;
    equal rows are chosen in turn; one source alone keeps its order of passes; an empty table gives no rows. Texts are
    read once; all else moves narrow rows, dealt by ranges, so that no source, however large, is one task's.
    """
    chosen, mix = copies(docs, id_col, text_col, source_col, seed, budget, entropy, repeats, most_passes)
    blocks = max(1, -(-mix.budget // block_tokens))
    block = F.expr(f"least(cast(before as decimal(19, 0)) * cast({blocks} as decimal(12, 0)) div cast(budget as decimal(19, 0)), {blocks - 1})")
    rows = chosen.withColumn("block", block.cast("bigint")).withColumn("shuffled", F.md5(F.concat_ws("/", "place", F.col("epoch").cast("string"))))
    ranked = running_totals(rows, ["block"], ["shuffled", "doc_id", "content"], F.lit(1), "position")
    return ranked.select("doc_id", "source", "epoch", "n_tokens", "block", "position")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, budget: int | None = None, entropy: float | None = None, repeats: float | None = None, most_passes: float | None = None) -> DataFrame:
    """The chosen copies as whole rows of ``docs``, as often as they were chosen; the same choice as :func:`mix_sources`.

    Per source only the last pass and the place at which it ends must be known, so texts are not moved. Rows that have the same
    id, and so the same place, are chosen together.
    """
    chosen, _ = copies(docs, id_col, text_col, source_col, seed, budget, entropy, repeats, most_passes)
    ends = table(chosen.groupBy("key").agg(F.max(F.struct("epoch", "place")).alias("end")), "ends")
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, source = (F.col(names[docs.columns.index(c)]) for c in (id_col, source_col))
    rows = join_unique(plain.withColumn("key", source_key(source)), ends, "key").where("end is not null")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end.epoch"))))
    taken = (F.col("epoch") < F.col("end.epoch")) | (order_key(doc_id, F.col("epoch"), seed) <= F.col("end.place"))
    return rows.where(taken).select(*names).toDF(*docs.columns)
