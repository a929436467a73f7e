"""Exact duplicates, heavy keys, components and near-duplicate groups."""

import collections
import hashlib
import random

import numpy as np
import pytest
from corners import as_counts, corner_docs, corner_rows, empty_docs, linked_groups
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickmill.llm import jaccard
from clickmill.llm import shingles as S
from clickmill.llm.components import components
from clickmill.llm.exact import exact_duplicates
from clickmill.llm.heavy import heavy_keys, join_unique, summarise
from clickmill.llm.jaccard import jaccard_groups, keep_one_per_group


def test_exact_duplicates_of_corner_rows(spark):
    got = exact_duplicates(corner_docs(spark), counters=2).collect()
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in corner_rows():
        groups[text or ""].append(doc_id)
    assert len(got) == len(corner_rows())
    kept = collections.Counter()
    for r in got:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.doc_id in ids
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_duplicates(empty_docs(spark)).collect() == []


def test_heavy_winners_and_shuffled_rows_agree(spark):
    texts = ["hot"] * 900 + ["warm"] * 300 + [f"t{k % 250}" for k in range(500)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(7)
    one, other = (exact_duplicates(docs, counters=c).collect() for c in (1, 64))
    assert as_counts(one) == as_counts(other)
    assert sum(r.kept for r in one) == 252


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=6), st.integers(1, 6))
def test_summary_keeps_every_frequent_key(batches, counters):
    counts, total, true = {}, 0, collections.Counter()
    for batch in batches:
        counts = summarise(counts, list(collections.Counter(batch).items()), counters)
        total += len(batch)
        true.update(batch)
    assert len(counts) <= counters
    for key, n in true.items():
        assert counts.get(key, 0) <= n
        assert counts.get(key, 0) >= n - total / (counters + 1)


def test_heavy_keys_are_few_and_complete(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 10 == 1, -2).otherwise(F.col("id")).alias("key"))
    got = {r.key for r in heavy_keys(rows.repartition(9), "key", 8).collect()}
    assert {-1} <= got and len(got) <= 8


def test_join_unique_plans_agree(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("key"), "id")
    right = spark.range(0, 2000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    one, other = (join_unique(rows, right, "key", counters=4, small=s).select("id", "key", "twice").collect() for s in (10, 10**6))
    assert as_counts(one) == as_counts(other) and len(one) == 3000


def test_components_of_paths_stars_and_pairs(spark):
    rng = random.Random(1)
    path = list(range(1000, 1300))
    links = [*zip(path, path[1:]), *((5, k) for k in range(6, 400)), (2000, 2001), (2002, 2001), (3000, 3000)]
    for _ in range(200):
        links.append(tuple(sorted(rng.sample(range(4000, 4300), 2), reverse=True)))
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        at[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in at if x != 3000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_groups_of_corner_rows(spark):
    got = jaccard_groups(corner_docs(spark)).collect()
    rows = corner_rows()
    roots, sizes = linked_groups([r[1] for r in rows])
    want = []
    for (doc_id, *_), root, size in zip(rows, roots, sizes):
        ids = [r[0] for r, x in zip(rows, roots) if x == root and r[0] is not None]
        want.append((doc_id, size, (min(ids) if ids else None) if size else doc_id))
    assert as_counts(got) == as_counts(want)
    assert jaccard_groups(empty_docs(spark)).collect() == []


@pytest.fixture(scope="module")
def cluster():
    """A large family of copies with zero to many edits, families of small ones, and texts that share frequent words."""
    rng = random.Random(3)
    texts = []
    base = [f"b{rng.randrange(900)}" for _ in range(80)]
    for _ in range(250):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(5000)}"
        texts.append(" ".join(w))
    for f in range(40):
        w = [f"f{f}x{rng.randrange(300)}" for _ in range(rng.randrange(2, 70))]
        for _ in range(rng.randrange(1, 6)):
            v = list(w)
            if rng.random() < 0.7:
                v[rng.randrange(len(v))] += "!"
            texts.append(" ".join(v))
    for _ in range(150):
        texts.append(" ".join(rng.choice(("the", "of", "and", "to")) for _ in range(rng.randrange(1, 25))))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent", [90, 75])
def test_near_groups_against_all_pairs(spark, cluster, percent):
    docs = spark.createDataFrame(list(enumerate(cluster)), "doc_id bigint, text string").repartition(5)
    roots, sizes = linked_groups(cluster, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs, percent=percent).collect()}
    assert got == {k: (sizes[k], roots[k]) for k in range(len(cluster))}


def test_near_groups_with_lists_and_families_in_pieces(spark, cluster, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_PIECE", 20)
    monkeypatch.setattr(jaccard, "FAMILY_PIECE", 15)
    monkeypatch.setattr(jaccard, "SMALL", 10)
    docs = spark.createDataFrame(list(enumerate(cluster)), "doc_id bigint, text string").repartition(3)
    roots, _ = linked_groups(cluster)
    assert {r.doc_id: r.component_id for r in jaccard_groups(docs).collect()} == dict(enumerate(roots))


def test_one_document_of_each_group_stays(spark):
    docs = corner_docs(spark)
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and ids.count(None) == 2 and ids.count(13) == 2


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1), st.sets(st.integers(0, 200), min_size=1), st.sampled_from((60, 80, 90, 100)))
def test_bounds_and_prefixes(a, b, percent):
    hashed = lambda s: np.unique(np.array([hash((x, "s")) & (2**64 - 1) for x in s], np.uint64))
    x, y = hashed(a), hashed(b)
    both = len(np.intersect1d(x, y))
    sizes = np.array([len(x), len(y)])
    passed = S.similar_histograms([S.histogram(x), S.histogram(y)], sizes, np.array([0]), np.array([1]), percent)[0]
    linked = 100 * both >= percent * (len(x) + len(y) - both)
    assert linked == (both >= S.needed(len(x), len(y), percent))
    assert [(0, 1)] * linked == S.exact_links([x, y], np.array([0]), np.array([1]), percent)
    if linked:
        assert passed
        p, q = (z[: S.prefix_length(len(z), percent)] for z in (x, y))
        assert len(np.intersect1d(p, q))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12), st.data())
def test_spanning_edges_connect_alike(n, data):
    pairs = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda p: p[0] != p[1]), max_size=20))
    i, j = (np.array([p[k] for p in pairs], int) for k in (0, 1))

    def groups(edges):
        at = list(range(n))
        for _ in range(n):
            for a, b in edges:
                at[a] = at[b] = min(at[a], at[b])
        return at

    edges = S.spanning(n, i, j)
    assert groups(edges) == groups(pairs) and len(edges) < n


def test_long_histograms_fold():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 40000, dtype=np.uint64) * np.uint64(2))
    y = x[200:]
    assert S.similar_histograms([S.histogram(x), S.histogram(y)], np.array([len(x), len(y)]), np.array([0]), np.array([1]), 90)[0]
    z = np.unique(rng.integers(0, 2**63, 40000, dtype=np.uint64) * np.uint64(2))
    assert not S.similar_histograms([S.histogram(x), S.histogram(z)], np.array([len(x), len(z)]), np.array([0]), np.array([1]), 90)[0]
