"""The pipeline against its stages in plain Python, on a small corpus."""

import collections
import random

import pytest
from corners import linked_groups, words

import corpus_pipeline
from clickmill.llm import contamination, mixing
from clickmill.llm.queries import QUERIES, tokenizer_file


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = tmp_path_factory.mktemp("corpus")
    items = [(k, words(rng, 30, 5000)) for k in range(5)]
    rows = []
    for k in range(240):
        text = words(rng, rng.randrange(20, 120), 3000)
        if k % 8 == 1:
            text = rows[-1][1] + (" end" if k % 16 == 1 else "")
        if k % 30 == 7:
            text += "\n" + items[k % 5][1]
        rows.append((k, None if k == 100 else "12 34 !" if k == 101 else text, "en" if k % 3 else "fr", rng.choice(["big", "big", "big", "small"]), len(text)))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages_take_effect(spark, corpus):
    folder, rows, items = corpus
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = [set(text)]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    named, distinct, clean, mixed = ids[1:]
    assert {100, 101}.isdisjoint(named) and len(named) >= 0.9 * len(rows)
    named = sorted(named)
    roots, _ = linked_groups([text[i] for i in named], percent=80, width=5)
    assert sorted(distinct) == [i for k, i in enumerate(named) if roots[k] == k]
    with_item = {i for i in distinct if any(t in text[i] for _, t in items)}
    assert with_item and with_item.isdisjoint(clean) and set(distinct) - with_item == set(clean)
    assert set(mixed) <= set(clean)
    chosen = mixing.mix_sources(spark.read.parquet(f"{folder}/decontamination")).collect()
    assert collections.Counter(mixed) == collections.Counter(r.doc_id for r in chosen)
    last = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert collections.Counter(r.doc_id for r in last) == collections.Counter(mixed)
    position = 0
    for r in sorted(last, key=lambda r: r.start):
        assert r.start == position
        position += r.n_tokens
    assert sorted(collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())) == sorted(set(mixed))


def test_near_copies_by_five_words_and_four_fifths(spark):
    """Copies with scattered edits, or with text added or cut, on both sides of the rule."""
    rng = random.Random(12)
    texts = []
    for k in range(40):
        w = words(rng, 200, 5000).split()
        copy = list(w)
        if k % 4 == 0:
            copy += words(rng, rng.randrange(20, 70), 5000).split()
        elif k % 4 == 1:
            copy = copy[: rng.randrange(140, 185)]
        else:
            for at in range(10, 200, rng.choice((30, 50, 60, 90))):
                copy[at] = "edited"
        texts += [" ".join(w), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want, narrow = ([k for k, root in enumerate(linked_groups(texts, percent, width)[0]) if root == k] for percent, width in ((80, 5), (90, 3)))
    got = sorted(r.doc_id for r in corpus_pipeline.remove_near_copies(spark, docs, "").collect())
    assert got == want
    assert 45 <= len(want) < len(narrow) - 5 and len(want) < 75


def test_every_dealt_operator_is_registered():
    assert sorted({int(name[2:].split("_")[0]) for name in QUERIES}) == list(range(1, 14))
    assert len(QUERIES) == 13 and [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_copies", "decontamination", "mixing", "token_files"]
    assert contamination.SEED and tokenizer_file().endswith(".json")
