"""Quality rules of single texts, and lines that many documents of a host share. SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: A line is removed from a host at so many distinct documents, if they are at least this share of the host's.
LEAST_DOCS, LEAST_SHARE = 10, 0.005
#: Fewest words of a text, and the percentage of them in repeated windows from which it fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document is depleted if fewer than this share of its words is left.
LEAST_LEFT = 0.5
#: Words of a window.
WINDOW = 3
#: A line in more than one such part of all line entries is hot; so there are fewer than this many of them.
HOT = 4096
#: Rows up to which a table is broadcast.
SMALL = 200_000

BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, although ``use`` may look at it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the text, the first one included.

    Windows are compared by 64-bit hashes. Those are sorted with their places, so equal ones are neighbours; the places of
    those with an equal neighbour, in order, add what each window covers beyond the one before it.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("total"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(width), p - acc["last"])).alias("total"))
        total = F.aggregate(bound(placed, places), start, step, lambda acc: acc["total"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(total)

    window = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
    return F.when(F.size(words) < width, F.lit(0).cast("bigint")).otherwise(bound(window(words), covered))


def text_statistics(text: Column) -> Column:
    """One struct: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` of a text that is not null."""
    words = F.array_remove(F.split(text, f"{BLANK}+"), "")
    full = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    return F.struct(
        bound(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        bound(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )


def normalised_lines(text: Column) -> Column:
    """The lines of a text in lower case, with 0 for any digit and one space for what is neither letter nor digit."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    return F.transform(F.split(F.translate(plain, "123456789", "000000000"), "\n"), lambda line: F.trim(line))


def hashed_lines(text: Column, host: Column) -> Column:
    """``(pos, h, words)`` of each line with a letter or digit: place, hash of host and normalised line, and its words."""
    entry = lambda line, i: F.struct(i.alias("pos"), F.xxhash64(host, line).alias("h"), (F.length(line) - F.length(F.translate(line, " ", "")) + 1).alias("words"), (line != "").alias("full"))
    return F.transform(F.filter(F.transform(normalised_lines(text), entry), lambda e: e["full"]), lambda e: e.dropFields("full"))


def described(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One written row per row of ``docs``, without its text: statistics, host, digest of host and text, and hashed lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.col(host_col).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), host.isNull().alias("nameless"), F.coalesce(host, F.lit("")).alias("host"))
    rows = rows.select(
        "row", "doc_id", text_statistics(F.col("text")).alias("s"), F.xxhash64("host", "nameless").alias("host"),
        F.unhex(F.sha2("text", 256)).alias("digest"), hashed_lines(F.col("text"), F.xxhash64("host", "nameless")).alias("lines"),
    )
    return table(rows.select("row", "doc_id", "s.w.*", *(f"s.{c}" for c in ("word_chars", "n_symbols", "n_dup_lines")), "host", "digest", "lines"), "described")


def short(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting if a count proves it small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def join_counted(rows: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has one row per key, and in ``weight`` the key's share of ``total``.

    A short right side is broadcast; else the right rows of more than one ``HOT``-th of the total, fewer than ``HOT``, are,
    and only rows of other keys are shuffled.
    """
    if right.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(right), keys)
    hot, cold = right.where(F.col(weight) * HOT > total), right.where(F.col(weight) * HOT <= total)
    often = rows.join(F.broadcast(hot), keys)
    return often.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def frequent_lines(rows: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """Lines that are above the limits, and the hot lines, above or not, at most ``HOT``: ``(h, removed)`` both.

    Rows of one host with the same text are one document. Counts combine before they are shuffled, by line; a line is counted in
    distinct documents for the limits and in entries for being hot.
    """
    first = rows.groupBy("host", "digest").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    twice = table(first.where("n > 1").select("host", "digest", "n", F.col("row").alias("kept")), "repeated")
    total, entries = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    repeats = join_counted(rows.select("row", "host", "digest"), twice, ["host", "digest"], "n", total).where("row <> kept").select("row")
    repeats = table(repeats.withColumn("again", F.lit(1)), "repeats")
    marked = rows.select("row", "host", "lines").join(short(repeats), "row", "left")
    marked = marked.withColumn("own", F.when(F.col("again").isNull(), 1).otherwise(0))

    hosts = table(marked.groupBy("host").agg(F.sum("own").alias("documents")), "hosts")
    each = marked.select("host", "own", F.explode(F.array_distinct("lines.h")).alias("h"))
    lines = table(each.groupBy("h").agg(F.min("host").alias("host"), F.sum("own").alias("documents"), F.count("*").alias("entries")).where("entries > 1"), "lines")

    often = join_counted(lines.where(F.col("documents") >= least_docs), hosts.withColumnRenamed("documents", "of"), ["host"], "of", total)
    often = table(often.where(F.col("documents") >= F.col("of") * least_share).select("h", F.lit(True).alias("removed")), "frequent")
    hot = lines.where(F.col("entries") * HOT > entries).select("h")
    return often, table(hot.join(often, "h", "left").select("h", F.coalesce("removed", F.lit(False)).alias("removed")), "hot")


def removed_lines(rows: DataFrame, often: DataFrame, hot: DataFrame) -> DataFrame:
    """``(row, pos, words)`` of every line entry that is above the limits.

    Entries of hot lines are answered by a broadcast of at most ``HOT`` rows; each of the other lines has a bounded share of
    all entries, so these may be shuffled by line.
    """
    entries = rows.select("row", F.explode("lines").alias("e")).select("row", "e.*")
    answered = entries.join(F.broadcast(hot), "h", "left")
    rest = answered.where("removed is null").drop("removed").join(short(often.join(F.broadcast(hot.select("h")), "h", "left_anti")), "h", "left_semi")
    return answered.where("removed").drop("removed").unionByName(rest).select("row", "pos", "words")


def line_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, least_left: float = LEAST_LEFT
) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    Columns: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``,
    then ``line_words`` (words of its normalised lines) and ``removed_words`` (those of lines above the limits: in ``least_docs``
    distinct documents of its host or more, and in ``least_share`` of them). A row is kept unless its own text fails or
    it is depleted: less than ``least_left`` of its words remain.

    A null or empty text has no words and fails; a null host is a host; a null id stays null; rows that repeat an id are
    judged each; rows of a host with the same text count as one document, so copies make no line frequent; an empty
    table gives no rows; other columns are not looked at. Texts are read once; hashes of lines, not lines, are shuffled.
    """
    rows = described(docs, id_col, text_col, host_col)
    return verdicts(rows, removed_lines(rows, *frequent_lines(rows, least_docs, least_share)), least_left)


def verdicts(rows: DataFrame, removed: DataFrame, least_left: float) -> DataFrame:
    gone = table(removed.groupBy("row").agg(F.sum("words").alias("removed_words")), "depleted")
    judged = rows.withColumn("line_words", F.aggregate("lines", F.lit(0).cast("bigint"), lambda acc, e: acc + e["words"])).join(short(gone), "row", "left")
    judged = judged.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("line_words") - F.col("removed_words") >= least_left * F.col("line_words")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*names, failed.alias("base_failed"), (~failed & left).alias("kept"), "line_words", "removed_words")


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, least_left: float = LEAST_LEFT
) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, and their text without the lines above the limits.

    Judges like :func:`line_rules`. Rows are numbered and written once, and the numbers of their removed lines come back to them.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (id_col, text_col, host_col)}
    source = table(docs.toDF(*names).withColumn("number", F.monotonically_increasing_id()), "numbered")
    rows = described(source, "number", at[text_col], at[host_col])
    removed = table(removed_lines(rows, *frequent_lines(rows, least_docs, least_share)), "removed")
    kept = verdicts(rows, removed, least_left).where("kept").select(F.col("doc_id").alias("number"))
    cuts = removed.join(rows.select("row", F.col("doc_id").alias("number")), "row").groupBy("number").agg(F.collect_set("pos").alias("cuts"))
    text = F.col(at[text_col]).cast("string")
    whole = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("cuts")), lambda p: F.get(lines, p)), "\n")
    joined = source.join(kept, "number", "left_semi").join(cuts, "number", "left")
    cleaned = F.when(F.col("cuts").isNull(), text).otherwise(bound(F.split(text, "\n"), whole))
    return joined.select(*(cleaned.alias(c) if c == at[text_col] else F.col(c) for c in names)).toDF(*docs.columns)
