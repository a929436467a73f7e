"""Language, quality and URL models: held-out accuracy, corner rows, and gradients against differences."""

import zlib

import numpy as np
import pytest
from corners import corner_docs, corner_rows, empty_docs
from pyspark.sql import functions as F

from clickmill.llm import language as L
from clickmill.llm import quality as Q
from clickmill.llm import urlfilter as U

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs, rows=800).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.97


def test_language_of_corner_rows(spark):
    docs = corner_docs(spark)
    got = L.identify(docs).collect()
    assert len(got) == len(corner_rows())
    by_id = {r.doc_id: r for r in got}
    for k in (5, 6, 7):
        assert (by_id[k].lang_pred, by_id[k].score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
    assert by_id[None].held_out
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({5, 6, 7})
    assert L.identify(empty_docs(spark)).collect() == [] == L.keep_identified(empty_docs(spark)).collect()


def test_network_gradients_are_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = L.train([b"ab" * 50, b"cd" * 50, b"ef" * 50], ["a", "b", "c"], epochs=1)
    weight = np.ones(6)

    def loss():
        p = net.probabilities(x, {w: [t.astype(float) for t in ts] for w, ts in exact_tables(net).items()})
        return -np.mean(np.log(p[np.arange(6), y]))

    def exact_tables(n):
        return {w: [n.vectors @ f[0]] + [n.vectors @ f[k] for k in range(1, w)] for w, f in n.filters.items()}

    def plain_loss():
        pooled = []
        for w, f in net.filters.items():
            out = np.stack([sum(net.vectors[x[:, k + s]] @ f[k] for k in range(w)) for s in range(40 - w + 1)], 1)
            pooled.append(np.maximum(out.max(axis=1) + net.bias[w], 0))
        p = L.softmax(np.concatenate(pooled, 1) @ net.dense + net.offset)
        return -np.mean(np.log(p[np.arange(6), y])), p

    grads = L.gradients(net, x, y, weight)
    assert np.allclose(plain_loss()[1], net.probabilities(x, net.tables()), atol=1e-4)
    for name, value in (("dense", net.dense), ("vectors", net.vectors), ("filters.3", net.filters[3]), ("bias.2", net.bias[2])):
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        old, h = value[at], 1e-6
        value[at] = old + h
        up = plain_loss()[0]
        value[at] = old - h
        down = plain_loss()[0]
        value[at] = old
        assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-4


def test_windows_cover_whole_texts():
    for n in (0, 1, 255, 256, 257, 1000):
        text = bytes(k % 250 + 1 for k in range(n))
        cut = L.cut_windows(text)
        assert cut.shape[1] == L.WINDOW and bytes(cut.ravel())[:n] == text and not cut.ravel()[n:].any()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.score_quality(docs, labels).join(labels, "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in tested]) > 0.98


def test_quality_of_corner_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (8, 0), (12, 1), (4, 7), (104, 0)], "doc_id bigint, quality int")
    got = Q.score_quality(corner_docs(spark), labels).collect()
    assert len(got) == len(corner_rows()) and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id in (1, 2)]
    assert len(set(same)) == 1
    assert {r.score for r in Q.score_quality(corner_docs(spark), labels.limit(0)).collect()} == {0.5}
    assert Q.score_quality(empty_docs(spark), labels).collect() == []


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.train(x, y, pairs=1)
    assert list(model.grids) == [(0, 1)]
    assert np.mean((model.score(x) >= 0.5) == y) > 0.95
    at = model.bins(x)
    plain = [model.offset + sum(t[at[k, j]] for j, t in enumerate(model.tables)) + sum(t[model.coarse[i][at[k, i]], model.coarse[j][at[k, j]]] for (i, j), t in model.grids.items()) for k in range(50)]
    assert np.allclose(model.score(x[:50]), 1 / (1 + np.exp(-np.array(plain))))


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "://", "https://", "HTTP://WWW.Example.COM/en/1", "https://example.com", "https://example.com/en/", "https://a.net/es/x?y#z", "https://a.net/fr",
    "https://net/fr/1", "https://xnet/fr/1", "a://b://c.com/x", "https://İ.com/ü\n/é", "https://com/?q=://x.net/es/", "https://notexample.com/en/1", "https://m.www.example.com/en/2#a?b",
]


@pytest.mark.parametrize("corner", [True, False])
def test_urls_against_plain_rules(spark, corner):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(3, "https://a.com/x"), (None, "https://a.com/x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("x")) if corner else spark.read.parquet(f"{SF}/pages.parquet")
    got = U.judge_urls(pages).collect()
    want = {}
    for r in pages.select("page_id", "url").collect():
        host, path = plain_url(r.url)
        want.setdefault(r.page_id, set()).add((host, path, *plain_rule(host, path)))
    assert len(got) == pages.count()
    for r in got:
        assert r.verdict in ("allow", "block")
        assert any((r.host, r.path, r.rule) == w[:3] and (w[3] is None or w[3] == r.verdict) for w in want[r.page_id])


def test_url_trees_agree_with_rules_they_learnt_from(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = U.judge_urls(pages).where("rule is not null").collect()
    assert np.mean([(r.block_score >= 0.5) == (r.verdict == "block") for r in got]) > 0.95
    monkeypatch.setattr(U, "SMALL", 0)
    spread = U.with_statistics(pages.select("page_id", "url").withColumn("suffix", U.suffix(U.host_and_path(F.col("url"))[0])), "suffix")
    assert spread.count() == pages.count()
    assert abs(spread.select("suffix", "f_suffix_share").distinct().agg(F.sum("f_suffix_share")).first()[0] - 1) < 1e-9


def test_urls_without_labels(spark):
    one = spark.createDataFrame([(1, "https://a.org/x")], "page_id bigint, url string")
    assert [r.verdict for r in U.judge_urls(one).collect()] == ["allow"]
    assert U.judge_urls(one.limit(0)).collect() == []
