"""Small tables with awkward rows, and plain rules to hold the operators against."""

import collections
import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = ("row", "digest", "n", "key", "before", "score", "kept", "token", "epoch", "label", "shard")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corner_rows():
    rng = random.Random(5)
    base = words(rng, 120)
    edited = base.split()
    edited[60] = "changed"
    far = base.split()
    for k in range(0, 120, 10):
        far[k] = "other"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, " ".join(edited), "en", None, None),
        (4, " ".join(far), "de", "b", 4),
        (5, None, None, None, None),
        (6, "", "en", "b", 0),
        (7, "  \t\n ", "en", "b", 5),
        (8, "one", "en", "c", 3),
        (9, "ONE", None, "c", 3),
        (10, "one two", "fr", "c", 7),
        (None, base, "en", "a", 1),
        (None, "alone with no id at all", "en", "a", 1),
        (12, words(rng, 30000), "en", "hot", 1),
        (13, "été àç 日本 \U0001f600 <|endoftext|> x  y\n\n z", "fr", "hot", 1),
        (13, "the same id again", "fr", "hot", 1),
        (2, base, "en", "a", 1),
    ]
    for k in range(40):
        rows.append((100 + k, words(rng, rng.randrange(1, 60)), "en", "hot", 1))
    return rows


def corner_docs(spark):
    docs = spark.createDataFrame(corner_rows(), DOCS)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(width, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def linked_groups(texts, percent=90, width=3):
    """For each position of ``texts`` the smallest position that links reach; every pair is compared."""
    sets = [shingles(t, width) for t in texts]
    at = list(range(len(texts)))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                at[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def as_counts(rows):
    return collections.Counter(map(tuple, rows))
