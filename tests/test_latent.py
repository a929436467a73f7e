import threading
from dataclasses import replace

import numpy as np
import pytest
from fixtures import SCHEMA, random_clicks
from pyspark.sql import functions as F

from clickmill.functions.keys import KEYS
from clickmill.operators import documents as D
from clickmill.operators import factors, latent, topics


def wide_clicks(spark):
    rows = random_clicks(n=300, hot=0.2)
    rows = [(r[0], r[1] * 7 % 23 + 8, r[2] + 10, r[3] + 10, r[4] + 9, r[5] + 10 + r[0] % 9, *r[6:]) for r in rows]
    return spark.createDataFrame(rows, SCHEMA), rows


def matrix(spark, shape=(30, 12), seed=1):
    dense = np.random.default_rng(seed).random(shape)
    dense[dense < 0.4] = 0
    dense *= 0.6 ** np.arange(shape[1])  # a falling spectrum, so that few iterations settle it
    rows = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*dense.nonzero())]
    return dense, spark.createDataFrame(rows, "doc int, term int, weight double")


def test_svd_scores_have_the_best_rank_k_gram_matrix(spark):
    dense, entries = matrix(spark)
    scores, _ = factors.truncated_svd(entries, 3, iterations=12)
    got = np.zeros((30, 3))
    for r in scores.collect():
        got[r.id] = r.f
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    want = u[:, :3] * s[:3]
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-5)
    assert np.allclose(np.linalg.norm(got, axis=0), s[:3], rtol=1e-6)


def test_svd_pads_beyond_the_rank(spark):
    entries = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "doc int, term int, weight double")
    scores, _ = factors.truncated_svd(entries, 4, iterations=2)
    assert all(len(r.f) == 4 and r.f[1:] == [0.0, 0.0, 0.0] for r in scores.collect())


def test_nmf_is_non_negative_and_its_error_falls(spark):
    dense, entries = matrix(spark)
    w, h, errors = factors.nmf(entries, 3, iterations=4)
    w_dense, h_dense = np.zeros((30, 3)), np.zeros((12, 3))
    for table, out in ((w, w_dense), (h, h_dense)):
        for r in table.collect():
            out[r.id] = r.f
    assert (w_dense >= 0).all() and (h_dense >= 0).all()
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    assert np.isclose(errors[-1], ((dense - w_dense @ h_dense.T) ** 2).sum())


def test_matrices_factored_together_are_as_if_alone(spark):
    rng = np.random.default_rng(4)
    shapes = [(14, 9), (40, 6), (3, 3)]
    dense = [rng.integers(0, 4, shape).astype(float) for shape in shapes]
    dense[2][:] = np.outer([1.0, 2.0, 3.0], [1.0, 0.0, 2.0])  # rank one
    rows = [(m, i, j, float(v)) for m, x in enumerate(dense) for (i, j), v in np.ndenumerate(x) if v]
    entries = spark.createDataFrame(rows, "m int, doc bigint, term bigint, weight double")
    scores, directions, residuals = factors.svd_each(entries, 3)
    assert max(residuals.values()) <= factors.SVD_RESIDUAL
    w, h, errors = factors.nmf_each(entries, 3, iterations=60, share=1e-5)
    for m, x in enumerate(dense):
        left, right = np.zeros((len(x), 3)), np.zeros((x.shape[1], 3))
        parts = {}
        for name, table in (("scores", scores), ("directions", directions), ("w", w), ("h", h)):
            out = (left if name in ("scores", "w") else right).copy()
            for r in table.where(F.col("m") == m).collect():
                out[r.id] = r.f
            parts[name] = out
        values = np.linalg.svd(x, compute_uv=False)
        assert np.allclose(np.linalg.norm(parts["scores"], axis=0), values[:3], atol=1e-4 * values[0])
        assert np.allclose(x @ parts["directions"], parts["scores"], atol=1e-8)
        assert (parts["w"] >= 0).all() and (parts["h"] >= 0).all()
        error = ((x - parts["w"] @ parts["h"].T) ** 2).sum()
        assert np.isclose(error, errors[m][-1], atol=1e-6) and error <= (values[1:] ** 2).sum() + 1e-2 * (x**2).sum()
    assert factors.nmf_each(entries.limit(0), 3)[2] == {} and factors.svd_each(entries.limit(0), 3)[0].count() == 0


def test_stacked_weights_are_those_of_single_pairs(spark):
    clicks, _ = wide_clicks(spark)
    pairs = [("app", "channel"), ("ip", "os")]
    stacked = D.stacked_tfidf(D.stacked_cooccurrence(clicks, pairs, list(KEYS)), 2)
    got = {(r.m, r.doc, r.term): r.weight for r in stacked.collect()}
    want = {}
    for m, (doc, term) in enumerate(pairs):
        counts = D.cooccurrence(clicks, doc, term)
        for r in D.tfidf(D.document_terms(counts, 2), D.document_count(counts)).collect():
            want[m, r.doc, r.term] = r.weight
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_lda_shares_sum_to_one_and_are_repeatable(spark):
    clicks, _ = wide_clicks(spark)
    spec = latent.LatentSpec("T", "lda", 5, 2, (("app", "channel"), ("app", "device")))
    first = latent.add_latent_vectors(clicks, spec, chunk_rows=50).collect()
    again = latent.add_latent_vectors(clicks, spec, chunk_rows=50).collect()
    names = [f"T_app_channel_{i}" for i in range(5)]
    assert len(first) == 300
    assert all(abs(sum(r[n] for n in names) - 1) < 1e-4 for r in first)
    again = {r.row_id: r for r in again}
    assert all(np.allclose([r[n] for n in names], [again[r.row_id][n] for n in names], atol=1e-5) for r in first)


def test_pairs_fitted_at_once_have_local_properties_of_their_own(spark, monkeypatch):
    clicks, _ = wide_clicks(spark)
    spec = replace(latent.SPECS["komaki_lda_5_mindf_1"], pairs=tuple(latent.pairs()[: 2 * latent.PAIRS_AT_ONCE]))
    context, together, seen = spark.sparkContext, threading.Barrier(latent.PAIRS_AT_ONCE), {}

    def noted(clicks, doc, term, *rest):
        before = context.getLocalProperty("pair")
        context.setLocalProperty("pair", f"{doc} {term}")
        together.wait(120)  # all threads have set theirs
        seen[doc, term] = (context.getLocalProperty("caller"), before, context.getLocalProperty("pair"))
        together.wait(120)
        return clicks.select(F.col(doc).alias("doc"), F.array_repeat(F.lit(0.2), spec.width).alias("f")).distinct()

    monkeypatch.setattr(latent, "latent_table", noted)
    context.setLocalProperty("caller", "test")
    try:
        latent.add_latent_vectors(clicks, spec)
        assert context.getLocalProperty("pair") is None
    finally:
        context.setLocalProperty("caller", None)
    assert seen == {(doc, term): ("test", None, f"{doc} {term}") for doc, term in spec.pairs}


def test_one_hot_scores_match_a_dense_svd(spark):
    clicks, rows = wide_clicks(spark)
    for weighted in (False, True):
        got = latent.add_one_hot_svd(clicks, weighted, k=4, chunk_rows=50).orderBy("row_id").collect()
        name = "SinglePCATfIdf" if weighted else "SinglePCACount"
        scores = np.array([[r[f"{name}_{i}"] for i in range(4)] for r in got])
        values = sorted({(c, r[1 + c]) for r in rows for c in range(5)})
        dense = np.array([[float(r[1 + c] == v) for c, v in values] for r in rows])
        if weighted:
            dense = dense * (np.log((1 + len(rows)) / (1 + dense.sum(0))) + 1)
            dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        s = np.linalg.svd(dense, compute_uv=False)
        assert np.allclose(np.linalg.norm(scores, axis=0)[:2], s[:2], rtol=1e-3)


def test_user_and_item_topics(spark):
    clicks, rows = wide_clicks(spark)
    users = {}
    for r in rows:
        users[(r[1], r[3], r[4], r[5])] = users.get((r[1], r[3], r[4], r[5]), 0) + 1
    for r in latent.add_user_item_lda(clicks, k=3).collect():
        total = sum(r[f"UserItemLDA_{i}"] for i in range(3))
        assert abs(total - (users[(r.ip, r.device, r.os, r.channel)] >= 3)) < 1e-4
    for r in latent.add_item_user_lda(clicks, k=3).collect():
        assert abs(sum(r[f"ItemUserLDA_{i}"] for i in range(3)) - 1) < 1e-4


def test_users_with_equal_apps_have_equal_topics(spark):
    clicks, rows = wide_clicks(spark)
    apps = {}
    for r in rows:
        apps.setdefault((r[1], r[3], r[4], r[5]), []).append(r[2])
    seen = {}
    for r in latent.add_user_item_lda(clicks, k=3).collect():
        seen.setdefault(tuple(sorted(apps[r.ip, r.device, r.os, r.channel])), set()).add(tuple(r[f"UserItemLDA_{i}"] for i in range(3)))
    assert all(len(found) == 1 for found in seen.values())


def test_long_vocabularies_are_fitted_by_joins(spark, monkeypatch):
    # Two kinds of documents with words of their own: shares must tell them apart.
    rows = [(d, 100 + 20 * (d % 2) + w, 1 + (d + w) % 3) for d in range(20) for w in range(0, 20, 1 + d % 4)]
    terms = spark.createDataFrame(rows, "doc int, term int, tf bigint")
    docs = spark.createDataFrame([(d,) for d in range(21)], "doc int")
    monkeypatch.setattr(topics, "BROADCAST_FACTORS", 5)
    got = {r.doc: r.f for r in topics.topic_mixtures(terms, docs, 2, method="joins", rounds=8).collect()}
    assert len(got) == 21 and got[20] == [0.5, 0.5]
    assert all(abs(sum(f) - 1) < 1e-9 for f in got.values())
    kind = [int(np.argmax(got[d])) for d in range(20)]
    assert kind in ([0, 1] * 10, [1, 0] * 10)


def test_documents_with_equal_words_are_fitted_once(spark, monkeypatch):
    # 300 documents of 3 kinds: each kind is one row of the fit, and its documents have the same shares to the last digit.
    rows = [(d, w, 1 + (d % 3) * w) for d in range(300) for w in range(4) if w != d % 3]
    terms = spark.createDataFrame(rows, "doc int, term int, tf bigint")
    docs = spark.createDataFrame([(d,) for d in range(301)], "doc int")
    fitted, sums = [], topics._sums
    monkeypatch.setattr(topics, "_sums", lambda kinds, *now: fitted.append(kinds.count()) or sums(kinds, *now))
    got = {r.doc: r.f for r in topics.topic_mixtures(terms, docs, 30).collect()}
    assert fitted == [3] * topics.PASSES
    assert len(got) == 301 and got[300] == [1 / 30] * 30
    assert len({tuple(got[d]) for d in range(300)}) == 3 and all(got[d] == got[d % 3] for d in range(300))
    assert all(abs(sum(f) - 1) < 1e-9 and min(f) > 0 for f in got.values())


def test_online_topics_are_those_of_plain_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (12, 7)) * (rng.random((12, 7)) < 0.7)
    counts[:, 0] += 1
    rows = [(d, 10 * w, int(counts[d, w])) for d, w in zip(*counts.nonzero())]
    terms = spark.createDataFrame([(int(d), int(w), n) for d, w, n in rows], "doc int, term int, tf bigint")
    monkeypatch.setattr(topics, "PIECE", 2)  # sums of words come in pieces, added up in tasks
    monkeypatch.setattr(topics, "CELLS", 20)  # documents are taken a few at a time
    got = {r.doc: r.f for r in topics.topic_mixtures(terms, terms.select("doc").distinct(), 3, seed=5).collect()}
    words, prior = np.random.default_rng(5).gamma(100.0, 0.01, (7, 3)), np.full(3, 1 / 3)
    for t in range(1, topics.PASSES + 2):
        expected = np.exp(topics.digamma(words) - topics.digamma(words.sum(0)))
        found = topics.document_parameters(counts.astype(float), expected, prior)
        share = np.exp(topics.digamma(found))
        logs = (topics.digamma(found) - topics.digamma(found.sum(1, keepdims=True))).mean(0)
        given = expected * ((counts / (share @ expected.T)).T @ share)
        weight = (1.0 + t) ** -0.7
        words = (1 - weight) * words + weight * (1 / 3 + given)
        prior = topics.next_prior(prior, logs, weight)
    assert np.allclose([got[d] for d in range(12)], found / found.sum(1, keepdims=True), atol=1e-6)


@pytest.mark.parametrize("size", [1, 3, 60, 100_000])
def test_documents_of_any_length_settle_in_few_updates(monkeypatch, size):
    rng = np.random.default_rng(size)
    counts = rng.multinomial(size, rng.dirichlet(np.ones(300)), 4).astype(float)
    words = rng.gamma(100.0, 0.01, (300, 10))
    expected = np.exp(topics.digamma(words) - topics.digamma(words.sum(0)))
    digamma, calls = topics.digamma, []
    monkeypatch.setattr(topics, "digamma", lambda x: calls.append(1) or digamma(x))
    found = topics.document_parameters(counts, expected, np.full(10, 0.1))
    assert len(calls) < 300  # plain updates of 100,000 words take some thousands
    share = np.exp(digamma(found))
    again = 0.1 + share * ((counts / (share @ expected.T)) @ expected)
    assert (np.abs(again - found).mean(1) < 2 * topics.SETTLED).all()
    assert np.allclose(found.sum(1), size + 1, atol=0.1)


def test_priors_follow_the_documents():
    rng = np.random.default_rng(1)
    true, prior = np.array([0.3, 1.0, 4.0]), np.full(3, 1 / 3)
    logs = np.log(rng.dirichlet(true, 200_000) + 1e-300).mean(0)
    for _ in range(30):
        prior = topics.next_prior(prior, logs, 0.6)
    assert np.allclose(prior, true, rtol=0.02)
    assert np.allclose(topics.trigamma(np.array([1.0, 0.5])), [np.pi**2 / 6, np.pi**2 / 2], atol=1e-6)


def test_digamma():
    # psi(1) = -gamma, psi(1/2) = -gamma - 2 ln 2
    values = topics.digamma(np.array([1.0, 0.5, 10.0]))
    assert np.allclose(values, [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-8)


@pytest.mark.parametrize("name", sorted(latent.SPECS))
def test_every_configuration_gives_its_columns(spark, name):
    clicks, _ = wide_clicks(spark)
    spec = latent.SPECS[name]
    one = replace(spec, pairs=spec.pairs[:1])
    got = latent.add_latent_vectors(clicks, one)
    a, b = spec.pairs[0]
    assert got.columns[len(clicks.columns) :] == [f"{spec.name}_{a}_{b}_{i}" for i in range(spec.width)]
    assert got.dropna(subset=[f"{spec.name}_{a}_{b}_0"]).count() == 300


def test_pair_lists():
    assert [len(s.pairs) * s.width for s in latent.SPECS.values()] == [
        100, 60, 100, 60, 60, 60, 40, 80, 120, 60, 60, 60, 100, 60, 100, 60,
    ]
