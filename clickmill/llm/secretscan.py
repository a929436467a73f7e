"""Secrets in whole texts: fixed patterns, and tokens that a battery of randomness tests finds too random for prose.

Only DataFrame functions are used, so everything runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order in which spans of one start are listed. The last one is what the tests add.
KINDS = ("assign", "access", "hex", "random")
#: A keyword, a sign and a value of six characters or more; the length is looked at after matching, so that a short value
#: still uses up its characters. The other two patterns are runs, for which a least length can be part of the pattern.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the tests look at: unbroken runs of the characters of common encodings. A longer run is looked at in stretches of
#: ``LONGEST`` characters, each tested by itself.
LONGEST = 4096
TOKEN = r"[A-Za-z0-9+/_-]{20,%d}={0,2}" % LONGEST
LEAST_VALUE = 6

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of common encodings, smallest first; the first that has all characters of a token is inferred.
ALPHABETS = (
    ("[0-9]+", _DIGITS),
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[A-Z2-7]+", _UPPER + "234567"),
    ("[0-9a-z]+", _DIGITS + _LOWER),
    ("[0-9A-Z]+", _DIGITS + _UPPER),
    ("[0-9A-Za-z]+", _UPPER + _LOWER + _DIGITS),
    ("[0-9A-Za-z+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("[0-9A-Za-z_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
)
ALL = _UPPER + _LOWER + _DIGITS + "+/-_"
#: Prose as the tests see it: chance that two letters agree, share of neighbours of different classes (lower, upper,
#: digit), and correlation of being a vowel between neighbours.
PROSE_AGREE, PROSE_CHANGE, PROSE_SERIAL = 0.066, 0.08, -0.3
#: Below this probability under randomness a token is no random string; false discovery rate of what is added.
LEAST_RANDOM, RATE = 1e-3, 0.01
BINS, PER_DECADE = 3000, 100
#: Matches whose places are added up one by one; the sums of such blocks are then added up in turn.
BLOCK = 128


def let(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often the function uses it."""
    return F.transform(F.array(value), function)[0]


def blocks_of(values: Column) -> Column:
    """An array in arrays of ``BLOCK`` elements."""
    count = F.greatest((F.size(values) + (BLOCK - 1)) / BLOCK, F.lit(0)).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))


def before_each(sizes: Column) -> Column:
    """For an array of whole numbers, the sum of the ones before each, as an array of the same size."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)


def placed(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, value)`` of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves take turns, so running sums of lengths give the places. They are
    taken within blocks of ``BLOCK`` matches and then over the blocks, since a sum that grows an array copies it
    each time: a text with 100,000 matches takes about a second.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), found, lambda gap, value: F.struct(gap.alias("gap"), F.coalesce(F.length(value), F.lit(0)).alias("size"), value.alias("value")))

    def in_block(block: Column, offset: Column) -> Column:
        steps = before_each(F.transform(block, lambda x: x["gap"] + x["size"]))
        spans = F.zip_with(block, steps, lambda x, at: F.struct((offset + at + x["gap"]).alias("start"), (offset + at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))
        return F.filter(spans, lambda x: x["value"].isNotNull())  # the last piece has no match after it

    def of_blocks(blocks: Column) -> Column:
        offsets = before_each(F.transform(blocks, lambda block: total(F.transform(block, lambda x: x["gap"] + x["size"]))))
        return F.flatten(F.zip_with(blocks, offsets, in_block))

    return F.when(text.rlike(pattern), let(pairs, lambda p: let(blocks_of(p), of_blocks))).otherwise(empty)


def number_below(sorted_values: Column, limit: Column) -> Column:
    """How many of the sorted values are below the limit, by halving."""
    halves = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    step = lambda low, half: F.when((half <= F.size(sorted_values) - low) & (F.get(sorted_values, low + half - 1) < limit), low + half).otherwise(low)
    return F.aggregate(halves, F.lit(0), step)


def apart_from(tokens: Column, spans: Column) -> Column:
    """The tokens that meet none of ``spans``, which follow each other without overlap: of those that begin before the
    token's end, all must have ended at its start."""

    def search(starts: Column, ends: Column) -> Column:
        return F.filter(tokens, lambda t: number_below(starts, t["end"]) == number_below(ends, t["start"] + 1))

    return F.when(F.size(spans) == 0, tokens).otherwise(let(F.transform(spans, lambda s: s["start"]), lambda a: let(F.transform(spans, lambda s: s["end"]), lambda b: search(a, b))))


def as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal exceeds ``z``, by a polynomial with an error below 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def pairwise(values: Column, function) -> Column:
    """Sum of ``function`` over all neighbours of an array."""
    n = F.size(values)
    terms = F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), function)
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def tested(tokens: Column) -> Column:
    """Per token ``start``, ``end``, ``size``, and ``text_p`` and ``random_p``: how well prose and randomness explain it.

    Under randomness in the inferred alphabet of k characters, the chi-squared statistic, the number of runs above
    and below the middle, and the correlation of neighbours have known means and variances; the probability is that of the
    sum of their squared standard scores. Under prose, tokens have more equal pairs of characters, fewer changes of class and
    a negative correlation of vowels; the three scores are added with equal weight.
    """
    alphabet = lambda body: F.coalesce(*(F.when(body.rlike(f"^{p}$"), F.lit(a)) for p, a in ALPHABETS), F.lit(ALL))
    bare = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.rtrim(m["value"], F.lit("=")).alias("body"))
    spelled = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["body"].alias("body"), F.split(m["body"], "").alias("chars"), alphabet(m["body"]).alias("alphabet"))

    def numbers(m: Column) -> Column:
        body, chars = m["body"], m["chars"]
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(body) - F.length(F.replace(body, c, F.lit(""))), F.lit(2)))
        values = F.transform(chars, lambda c: F.instr(m["alphabet"], c).cast("double"))
        vowels = F.transform(chars, lambda c: F.when(F.instr(F.lit("aeiouyAEIOUY"), c) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        letters = F.regexp_replace(body, "[^A-Za-z0-9]", "")
        classes = F.split(F.translate(letters, _UPPER + _LOWER + _DIGITS, "U" * 26 + "l" * 26 + "d" * 10), "")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.length(body).cast("double").alias("n"), F.length(m["alphabet"]).cast("double").alias("k"), squares.alias("squares"), values.alias("values"), vowels.alias("vowels"), classes.alias("classes"))

    def mean(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)

    def sums(m: Column) -> Column:
        half = m["k"] / 2
        side = F.transform(m["values"], lambda v: F.when(v > half, F.lit(1.0)).otherwise(F.lit(0.0)))
        return F.struct(
            *(m[c].alias(c) for c in ("start", "end", "n", "k", "squares", "values", "vowels")),
            (pairwise(side, lambda x, y: F.abs(x - y)) + 1).alias("runs"),
            (mean(side) * m["n"]).alias("above"),
            pairwise(m["classes"], lambda x, y: F.when(x != y, F.lit(1.0)).otherwise(F.lit(0.0))).alias("changes"),
            F.size(m["classes"]).cast("double").alias("letters"),
            mean(m["values"]).alias("mv"),
            mean(m["vowels"]).alias("mw"),
        )

    def correlations(m: Column) -> Column:
        def serial(x: Column, mu: Column) -> Column:
            spread = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - mu) * (v - mu))
            return F.when(spread > 0, pairwise(x, lambda p, q: (p - mu) * (q - mu)) / spread).otherwise(F.lit(1.0))

        keep = (m[c].alias(c) for c in ("start", "end", "n", "k", "squares", "runs", "above", "changes", "letters"))
        return F.struct(*keep, serial(m["values"], m["mv"]).alias("serial"), serial(m["vowels"], m["mw"]).alias("vowel_serial"))

    def scores(m: Column) -> Column:
        n, k, above = m["n"], m["k"], m["above"]
        chi = k / n * m["squares"] - n
        z1 = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        mu = 2 * above * (n - above) / n + 1
        z2 = F.when((mu > 2), (m["runs"] - mu) / F.sqrt((mu - 1) * (mu - 2) / (n - 1))).otherwise(F.sqrt(n))
        z3 = (m["serial"] + 1 / n) * F.sqrt(n)
        agree = (m["squares"] - n) / 2
        due = n * (n - 1) / 2 * PROSE_AGREE
        t1 = 2 * (F.sqrt(due) - F.sqrt(agree + 0.375))
        t2 = 2 * (F.sqrt(m["changes"] + 0.375) - F.sqrt(F.greatest(m["letters"] - 1, F.lit(1.0)) * PROSE_CHANGE + 0.375))
        t3 = (m["vowel_serial"] - PROSE_SERIAL) * F.sqrt(n)
        squared = z1 * z1 + z2 * z2 + z3 * z3
        # chi-squared with three degrees of freedom by the cube-root transform
        random_p = upper_tail((F.cbrt(squared / 3) - (1 - 2 / 27)) / F.sqrt(F.lit(2 / 27)))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), n.alias("size"), upper_tail((t1 + t2 + t3) / F.sqrt(F.lit(3.0))).alias("text_p"), random_p.alias("random_p"))

    def whole(m: Column) -> Column:
        # one token after the other, so that the arrays of a single one are held at a time
        for function in (bare, spelled, numbers, sums, correlations):
            m = F.transform(m, function)
        return F.transform(m, scores)[0]

    return F.transform(tokens, lambda m: whole(F.array(m)))


def grade(c: Column, mean_size: float) -> Column:
    """Bin of a tested token: its probability under prose, relaxed in proportion to its length, on a log scale."""
    weight = c["size"] / max(mean_size, 1.0)
    return F.least(F.greatest(F.floor(-PER_DECADE * F.log10(F.greatest(c["text_p"] / weight, F.lit(1e-300)))), F.lit(0)), F.lit(BINS)).cast("int")


def least_bin(found: DataFrame, rate: float) -> tuple[float, int]:
    """Mean token size, and the first bin whose tokens are discoveries at the rate (Benjamini-Hochberg on bins).

    Long tokens, which can show more, get weights above one, short ones below, with mean one. The driver sees
    one number per bin, ``BINS`` at most.
    """
    tokens = found.select(F.explode("tokens").alias("c"))
    mean_size = tokens.agg(F.avg("c.size")).first()[0] or 1.0
    rows = tokens.groupBy(grade(F.col("c"), mean_size).alias("bin")).count().collect()
    total = sum(r["count"] for r in rows)
    best, seen = BINS + 1, 0
    for r in sorted(rows, key=lambda r: -r["bin"]):
        seen += r["count"]
        if total * 10.0 ** (-r["bin"] / PER_DECADE) <= rate * seen:
            best = r["bin"]
    return mean_size, best


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Spans of secrets in every whole text.

    One row per row of ``docs``: ``doc_id``, the numbers of base spans ``n_assign``, ``n_access`` and ``n_hex``,
    ``base_sha256`` over the base spans, ``spans`` (all spans) and ``n_random``. A null text counts as empty and, like any text
    without a match, gives zeros, the digest of the empty string and no spans. Rows that repeat an id are rows of their own;
    other columns are not looked at; an empty table gives no rows.

    The texts are read once: matches and test results go to a narrow table, from which the threshold of the false discovery
    rate over the whole corpus is taken. Nothing is shuffled but one count per bin.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    value = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= LEAST_VALUE
    matched = source.select(
        "doc_id",
        as_spans(F.filter(placed(F.col("text"), ASSIGN), value), "assign").alias("assign"),
        as_spans(placed(F.col("text"), ACCESS), "access").alias("access"),
        as_spans(placed(F.col("text"), HEX), "hex").alias("hex"),
        placed(F.col("text"), TOKEN).alias("runs"),
    )
    runs = F.col("runs")
    for kind in KINDS[:3]:
        matched = matched.withColumn("runs", apart_from(runs, F.col(kind)))
    matched = matched.select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]), F.concat("assign", "access", "hex").alias("base"), tested(F.col("runs")).alias("tokens")
    )
    found = table(matched, "secrets")
    mean_size, least = least_bin(found, rate)
    random = F.filter("tokens", lambda c: (grade(c, mean_size) >= least) & (c["random_p"] >= LEAST_RANDOM))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", added)).alias("spans"), F.size(added).cast("bigint").alias("n_random")
    )
