"""URL verdicts: fixed host rules, and gradient-boosted trees on lexical features for all other URLs.

Only DataFrame functions and MLlib's trees are used, so everything runs inside the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path). A rule fits its host and all subdomains if the path starts with its own; the longest wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Most labelled URLs to learn from; trees, their depth; suffixes (or heads of paths) up to which their table is broadcast, parts beyond.
SAMPLE, TREES, DEPTH, SMALL, SALTS = 20_000, 15, 4, 200_000, 16

FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "host_label", "digits", "host_digits", "signs", "hyphens", "entropy", "host_entropy",
    "parameters", "query_length", "fragment", "secure", "extension", "suffix_log_count", "suffix_share", "suffix_mean_length", "head_log_count", "head_share", "head_mean_length",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; then up to ``?``, ``#`` or
    the end. Both are empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, pattern, 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def share(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kind}]", "")) / F.greatest(F.length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Of the distribution of characters, in bits."""
    n = F.greatest(F.length(text), F.lit(1))

    def term(acc: Column, c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return acc - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), term)


def suffix(host: Column) -> Column:
    """The last two labels of a host without its port."""
    return F.substring_index(F.substring_index(host, ":", 1), ".", -2)


def lexical(pages: DataFrame) -> DataFrame:
    """``pages(url, host, path, suffix, ...)`` with the ``FEATURES`` that need nothing but the URL."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, char: F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
    labels = F.split(host, r"\.")
    columns = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": count(path, "/"), "labels": F.size(labels),
        "host_label": F.array_max(F.transform(labels, F.length)), "digits": share(url, "0-9"), "host_digits": share(host, "0-9"),
        "signs": 1 - share(url, "A-Za-z0-9"), "hyphens": count(host, "-"), "entropy": entropy(url), "host_entropy": entropy(host),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_length": F.length(query),
        "fragment": F.instr(url, "#") > 0, "secure": F.lower(url).startswith("https:"), "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$"),
    }
    return pages.withColumns({f"f_{k}": v.cast("double") for k, v in columns.items()})


def head(path: Column) -> Column:
    """The first part of a path."""
    return F.regexp_extract(path, "^/?([^/]*)", 1)


def with_statistics(pages: DataFrame, column: str) -> DataFrame:
    """Adds how many URLs of the whole table share the value of ``column``, as a log and a share, and their mean length.

    Counting combines before its shuffle. The table of values is broadcast if it is counted to be short; else frequent
    values are spread over ``SALTS`` parts, for which the table is repeated.
    """
    counts = table(pages.groupBy(column).agg(F.count("*").alias("n"), F.avg(F.length("url")).alias("mean")), column)
    total = max(1, counts.agg(F.sum("n")).first()[0] or 1)
    facts = counts.select(column, F.log1p("n").alias(f"f_{column}_log_count"), (F.col("n") / total).alias(f"f_{column}_share"), F.col("mean").alias(f"f_{column}_mean_length"))
    if facts.count() <= SMALL:
        return pages.join(F.broadcast(facts), column)
    left = pages.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    right = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return left.join(right, [column, "salt"]).drop("salt")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, rows: int = SAMPLE) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    Rules decide where one fits. All other URLs, null (taken as empty) ones too, get the verdict of trees that learn from the
    URLs with a rule, at most about ``rows`` of them, the same number of either verdict, chosen by a hash of the URL. If all
    labels are alike, that is the verdict; without any it is ``allow``. Repeated rows are judged one by one, other columns are
    not looked at, and an empty table gives no rows. Scoring is a pass over the URLs; only counts per host suffix and first part of the path are shuffled.
    """
    host, path = host_and_path(F.col("url"))
    source = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    cut = source.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    cut = cut.withColumns({"rule": name, "by_rule": verdict, "suffix": suffix(F.col("host")), "head": head(F.col("path"))})
    described = lexical(with_statistics(with_statistics(cut, "suffix"), "head"))

    counts = {r.by_rule: r["count"] for r in cut.where("rule is not null").groupBy("by_rule").count().collect()}
    if len(counts) < 2:
        only = next(iter(counts), "allow")
        judged = cut.withColumn("block_score", F.lit(1.0 if only == "block" else 0.0))
    else:
        assembler = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features")
        part = F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
        odds = F.when(F.col("by_rule") == "block", min(1.0, rows / 2 / counts["block"])).otherwise(min(1.0, rows / 2 / counts["allow"]))
        picked = described.where(F.col("rule").isNotNull() & (part < odds))
        label = (F.col("by_rule") == "block").cast("double").alias("label")
        learn = table(picked.select(label, *(f"f_{k}" for k in FEATURES)), "urls").coalesce(1)  # the bounded sample
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, stepSize=0.3, cacheNodeIds=False)
        model = trees.fit(assembler.transform(learn))
        scored = model.transform(assembler.transform(described))
        judged = scored.withColumn("block_score", F.element_at(vector_to_array("probability"), 2))
    by_trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), "block_score")
