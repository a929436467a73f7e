"""Fill-in-the-middle documents: whole texts cut at token boundaries and written in another order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundaries import BITS, BoundarySet
from .common import ship, spans

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those from which the text stays plain, and of the others those with the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Bytes of texts that are turned at once; a longer text is alone.
BYTES_AT_ONCE = 1 << 22

_MARK = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))


def boundaries(text: str) -> BoundarySet:
    """0 and the end of every token: a run of ASCII letters, or any other character."""
    found = BoundarySet()
    letter = False
    for key in range((len(text) >> BITS) + 1):
        # one character more than the block, to know whether a run goes on
        points = np.frombuffer(text[key << BITS : ((key + 1) << BITS) + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        lower = points | 32
        letters = np.concatenate(([letter], (lower >= 97) & (lower <= 122) & (points < 128), [False]))
        block = min(1 << BITS, len(text) + 1 - (key << BITS))
        inside = letters[:block] & letters[1 : block + 1]
        found.add_block(key, np.flatnonzero(~inside))
        letter = bool(letters[block])
    return found


def draws(doc_id: object, seed: int = 1) -> tuple[int, int, int, int]:
    """Four whole numbers of 32 bits by the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))  # type: ignore[return-value]


def turned(text: str, doc_id: object, seed: int = 1) -> tuple[str, int, str, int | None, int | None]:
    """Output, number of tokens, form, and characters of prefix and middle."""
    ends = boundaries(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_FROM or _MARK.search(text):
        return text, n, "plain", None, None
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends.select(first), ends.select(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", n, "spm", a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", n, "psm", a, b - a


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Every row of ``docs`` as a training text whose middle comes last.

    Columns: ``doc_id``, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``. The digest of
    seed and id draws two cuts among the n + 1 token boundaries, which a set of containers finds, and the form: plain for
    an empty text, one with a mark in it, or by chance; else ``psm`` or ``spm``.

    A null text is empty; a null id draws as an empty one and stays null; rows that repeat an id draw the same numbers;
    a text without letters has one token per character; an empty table gives no rows; other columns are not looked at.
    One pass, no shuffle; a task holds one batch of texts.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def turn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in spans(pc.binary_length(part.column(1)).to_numpy(), BYTES_AT_ONCE):
                rows = part.slice(a, b - a)
                got = [turned(text, doc_id, seed) for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
                output, n, form, prefix, middle = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return source.mapInArrow(turn, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` was given, from its output and form, in SQL functions.

    No part of a text holds a mark, so the first mark found after the leading one ends the first part, and so on.
    """

    def parts(first: str, second: str) -> Column:
        rest = F.substr(output, F.lit(len(first) + 1))
        at = F.locate(second, rest)
        later = F.substr(rest, at + len(second))
        end = F.locate(MIDDLE, later)
        return F.struct(F.substr(rest, F.lit(1), at - 1).alias("one"), F.substr(later, F.lit(1), end - 1).alias("two"), F.substr(later, end + len(MIDDLE)).alias("middle"))

    psm, spm = parts(PREFIX, SUFFIX), parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(psm["one"], psm["middle"], psm["two"])).when(form == "spm", F.concat(spm["two"], spm["middle"], spm["one"])).otherwise(output)
