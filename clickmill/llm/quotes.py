"""Quotation linking: quoted passages found by their normalised text, and reply-ordered conversations without quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, table
from .heavy import join_unique
from .totals import running_totals

#: A line of a quote: one or more ``>``, each with blanks around it. A line that announces a quote is not the writer's text.
MARKS = r"^((?:[ \t]*>)+)[ \t]?(.*)$"
ANNOUNCES = r"(?i)^[ \t]*(?:on\b.{0,200}\bwrote:|.{0,200}\bwrote:|-+ ?original message ?-+)[ \t]*$"
#: Fewest normalised characters of a passage that may link to another conversation, and of a piece that may link in place of its passage.
LEAST = 12


def normalised(text: Column) -> Column:
    """Lower case, with every run of other characters than letters and digits as one space: rewrapped and reindented
    passages agree."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def digest(text: Column, least: int = 1) -> Column:
    return F.when(F.length(text) >= least, F.unhex(F.md5(text)))


def lines_of(text: Column) -> Column:
    """Array of ``(level, line)``: level 0 is the writer's own text, level n what stands behind n marks, and level -1 a line of
    any level that announces a quote."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        text = F.when(level > 0, F.regexp_extract(line, MARKS, 2)).otherwise(line)
        return F.struct(F.when(text.rlike(ANNOUNCES), F.lit(-1)).otherwise(level).alias("level"), text.alias("line"))

    return F.transform(lines, one)


def passages_of(lines: Column) -> Column:
    """Array of ``(level, text)``: neighbouring lines of one level, put together in order."""
    empty = F.array().cast("array<struct<level:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["level"].alias("level"), F.concat(last["text"], F.lit("\n"), x["line"]).alias("text"))
        new = F.struct(x["level"].alias("level"), x["line"].alias("text"))
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["level"] == x["level"])
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(lines, empty, step)


def parsed(messages: DataFrame) -> DataFrame:
    """``own`` text, its ``stretches`` between quotes, ``levels`` and quoted ``passages`` of each message."""
    text = F.col("text")
    quoted = text.rlike(r"(?m)^[ \t]*>")
    cut = messages.withColumn("lines", F.when(quoted | text.rlike("(?m)" + ANNOUNCES), lines_of(text)))
    cut = cut.withColumn("parts", passages_of(F.col("lines")))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    passages = F.filter("parts", lambda p: p["level"] > 0)
    none = F.array().cast("array<struct<level:int,text:string>>")
    return cut.select(
        "row", "conv_id", "turn", "role",
        F.when(quoted, F.trim(F.regexp_replace(own, r"\n{3,}", "\n\n"))).otherwise(text).alias("own"),
        F.coalesce(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"]), F.array(text)).alias("stretches"),
        F.when(quoted, passages).otherwise(none).alias("passages"),
    )


def pieces(text: Column) -> Column:
    """Paragraphs and lines of a text, each alone and with the next one."""

    def with_next(parts: Column) -> Column:
        filled = F.filter(parts, lambda p: normalised(p) != "")
        pairs = F.zip_with(filled, F.slice(filled, 2, F.greatest(F.size(filled), F.lit(1))), lambda a, b: F.concat(a, F.lit("\n"), b))
        return F.concat(filled, F.filter(pairs, lambda p: p.isNotNull()))

    return F.concat(with_next(F.split(text, r"\n[ \t]*\n")), with_next(F.split(text, r"\n")))


def units(own: Column, stretches: Column) -> Column:
    """Digests under which a text can be found: the whole, its stretches between quotes and their pieces."""
    parts = F.concat(F.array(own), stretches, F.flatten(F.transform(stretches, pieces)))
    return F.filter(F.array_distinct(F.transform(parts, lambda p: digest(normalised(p)))), lambda d: d.isNotNull())


def asked_units(text: Column) -> Column:
    """Array of ``(digest, size, whole)``: a passage and its pieces."""

    def one(p: Column, whole: bool) -> Column:
        plain = normalised(p)
        return F.struct(digest(plain, 1 if whole else LEAST).alias("digest"), F.length(plain).alias("size"), F.lit(whole).alias("whole"))

    parts = F.array_distinct(F.transform(pieces(text), lambda p: one(p, False)))
    whole = one(text, True)
    return F.filter(F.concat(F.array(whole), F.filter(parts, lambda p: p["digest"] != whole["digest"])), lambda p: p["digest"].isNotNull())


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, in reply order, without the quotes.

    Columns: ``conv_id``, ``turn``, ``role``, ``text`` (the writer's own), ``quotes`` (number of quoted passages),
    ``quote_level`` (deepest level), ``linked`` (passages whose original was found), ``parent_conv`` and ``parent_turn`` (the
    message replied to), ``root_turn``, ``depth`` and ``position`` (place in the conversation, from 0).

    A passage is the neighbouring lines of one level, without those that announce a quote. Its original is the first message
    that has the same normalised passage as its own text, a stretch of it between quotes, one or two paragraphs or lines: in the
    same conversation before the quoting turn, else, from ``LEAST`` characters on, the first one in all other conversations. If there is none, each paragraph and line
    of ``LEAST`` characters, alone and with the next one, names its first message by the same rule, and of these the original is the one
    that has most characters of such pieces, in the same conversation if equal.
    A message replies to the original of its outermost, then longest, linked passage; without one it starts a thread. Threads
    follow each other by the turn that starts them, replies in order of their turns.

    A null or empty text is an empty message. Null conversations are one conversation, null turns come first; messages that
    repeat a turn are messages of their own, the first read counting as the original. A conversation of any size is dealt to tasks by
    ranges. An empty table gives no rows; other columns are not looked at.
    """
    source = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = table(parsed(source.withColumn("row", F.monotonically_increasing_id())), "messages")
    place = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("at"), F.col("row"))

    quoted = rows.select("row", "conv_id", place.alias("place"), F.posexplode("passages").alias("nr", "p"))
    quoted = quoted.withColumn("length", F.length(normalised(F.col("p.text")))).withColumn("unit", F.explode(asked_units(F.col("p.text"))))
    quoted = table(quoted.select("row", "conv_id", "place", "nr", F.col("p.level").alias("level"), "length", "unit.*"), "quoted")

    # only passages that somebody quotes can be originals of anything
    asked = quoted.select("digest").distinct()
    said = rows.select("row", "conv_id", place.alias("place"), F.explode(units(F.col("own"), F.col("stretches"))).alias("digest"))
    said = table(said.join(asked, "digest", "left_semi"), "said")
    conv = F.xxhash64("digest", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull())
    near = said.withColumn("near", conv).groupBy("near").agg(F.min("place").alias("near_place"))
    firsts = table(said.groupBy("digest", "conv_id").agg(F.min("place").alias("place")), "firsts")
    far = firsts.groupBy("digest").agg(F.min(F.struct("conv_id", "place")).alias("far"))
    other = F.when(~F.col("far.conv_id").eqNullSafe(F.col("conv_id")), F.struct("conv_id", "place"))
    far = join_unique(firsts, table(far, "far"), "digest").groupBy("digest").agg(F.min("far").alias("far"), F.min(other).alias("next"))
    met = join_unique(quoted.withColumn("near", conv), near, "near")
    met = met.withColumn("near_place", F.when(F.col("near_place") < F.col("place"), F.col("near_place")))
    met = join_unique(met, far, "digest")
    elsewhere = F.when(F.col("size") >= LEAST, F.when(F.col("far.conv_id").eqNullSafe(F.col("conv_id")), F.col("next")).otherwise(F.col("far")))
    within = F.when(F.col("near_place").isNotNull(), F.struct("conv_id", F.col("near_place").alias("place")))
    met = table(met.withColumn("original", F.coalesce(within, elsewhere)).drop("far", "next", "near", "near_place"), "met")
    met = original_of_pieces(met, said)
    best = F.min(F.when(F.col("original").isNotNull(), F.struct("level", (-F.col("length")).alias("shorter"), "nr", F.col("original.conv_id").alias("conv_id"), F.col("original.place").alias("place"))))
    replies = met.groupBy("row").agg(best.alias("best"), F.count("original").alias("linked"))

    facts = rows.select("row", "conv_id", "turn", "role", "own", F.size("passages").alias("quotes"), F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).alias("quote_level"))
    joined = table(facts.join(replies, "row", "left"), "replies")
    inside = F.col("best.conv_id").eqNullSafe(F.col("conv_id")) & F.col("best").isNotNull()
    threads = thread_roots(joined.select("row", F.when(inside, F.col("best.place.row")).alias("parent")))
    starts = rows.select(F.col("row").alias("root"), F.col("turn").alias("root_turn"))
    named = join_unique(joined.join(threads, "row"), starts, "root")
    group = named.withColumn("conv", F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull()))
    ranked = running_totals(group, ["conv"], ["root_turn", "root", "turn", "row"], F.lit(1), "position")
    discard(said, quoted, firsts)
    return ranked.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.col("quotes").cast("bigint").alias("quotes"), F.col("quote_level").cast("bigint").alias("quote_level"), F.coalesce("linked", F.lit(0)).alias("linked"),
        F.col("best.conv_id").alias("parent_conv"), F.when(F.col("best").isNotNull(), F.when(F.col("best.place.at") > -(1 << 62), F.col("best.place.at"))).alias("parent_turn"),
        "root_turn", "depth", "position",
    )


def original_of_pieces(met: DataFrame, said: DataFrame) -> DataFrame:
    """One row per passage with its ``original``: that of the whole passage, else of the named messages the one with most of it."""
    whole = met.where("whole and original is not null").select("row", "nr", "level", "length", "original")
    rest = met.where("not whole").join(whole.select("row", "nr"), ["row", "nr"], "left_anti")
    named = rest.where("original is not null").select("row", "nr", "original").distinct()
    asked = rest.where("original is not null").join(named.withColumnRenamed("original", "named"), ["row", "nr"])
    asked = asked.withColumn("held", F.xxhash64("named.place.row", "digest"))
    holds = said.select(F.xxhash64("row", "digest").alias("held"), F.lit(True).alias("has")).distinct()
    inside = F.col("named.conv_id").eqNullSafe(F.col("conv_id"))
    sums = join_unique(asked, holds, "held").where("has").groupBy("row", "nr", "level", "length", "named").agg(F.sum("size").alias("shared"), F.max(inside).alias("inside"))
    most = F.min(F.struct((-F.col("shared")).alias("less"), (~F.col("inside")).alias("outside"), F.col("named.conv_id").alias("conv_id"), F.col("named.place").alias("place")))
    best = sums.groupBy("row", "nr", "level", "length").agg(most.alias("best"))
    return whole.unionByName(best.select("row", "nr", "level", "length", F.struct(F.col("best.conv_id").alias("conv_id"), F.col("best.place").alias("place")).alias("original")))


def thread_roots(parents: DataFrame) -> DataFrame:
    """``(row, root, depth)`` from ``(row, parent)``: every round follows twice as many steps as the one before.

    A parent is always an earlier message, so there are no circles, and the loop ends when no one has a step left.
    """
    state = table(parents.select("row", F.coalesce("parent", "row").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth")), "threads")
    while True:
        onward = state.where("depth > 0").select(F.col("row").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moving = state.where("depth > 0").join(onward, "root", "left_semi")
        if moving.isEmpty():
            return state
        step = join_unique(state, onward, "root")
        before, state = state, table(step.select("row", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")
        discard(before)
