"""Line rules, fill-in-the-middle cuts and token alignment against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from corners import CLASHING, corner_docs, corner_rows, empty_docs, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickmill.llm import alignment, linefreq, middle
from clickmill.llm.boundaries import ArrayContainer, BitmapContainer, BoundarySet, RunContainer, container
from clickmill.llm.encode import Encoder, PieceEncoder, byte_alphabet
from clickmill.llm.queries import tokenizer_file

A_FILE, B_FILE = tokenizer_file(), tokenizer_file("piece_bpe_32k.model")
AWKWARD = ["", " ", "\n", "a", "  two  blanks  ", "tab\tand\nline\r\n end ", "日本語のテキスト", "été \U0001f600 ça", "a▁b", "<P>x", "<|endoftext|> <s> <0x41>", "x" * 300, "1234567890 " * 20, " " * 70, " nbsp wide", "don't we'll", "\x00\x01"]


# line rules


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_lines(text):
    plain = "".join(c if c.isalpha() or c.isdigit() or c == "\n" else " " for c in text.lower())
    return [" ".join(x.split(" ")).strip() for x in (re.sub(" +", " ", re.sub("[0-9]", "0", y)) for y in plain.split("\n"))]


def plain_rules(rows, least_docs, least_share):
    """``rows``: (doc_id, text, host)."""
    hosts = collections.defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
    often = {h: collections.Counter(x for t in texts for x in set(plain_lines(t)) if x) for h, texts in hosts.items()}
    out = []
    for doc_id, text, host in rows:
        n, *rest = plain_statistics(text or "")
        lines = [x for x in plain_lines(text or "") if x]
        gone = [x for x in lines if often[host][x] >= max(least_docs, least_share * len(hosts[host]))]
        total, removed = (sum(len(x.split(" ")) for x in y) for y in (lines, gone))
        failed = n < 50 or 100 * rest[-1] > 50 * n
        out.append((doc_id, n, *rest, failed, not failed and total - removed >= 0.5 * total, total, removed))
    return out


@pytest.fixture(scope="module")
def boilerplate():
    rng = random.Random(4)
    menu = [words(rng, 30) + " 2019", words(rng, 28)]
    rows = []
    for k in range(150):
        body = [words(rng, rng.randrange(1, 40), 5000) for _ in range(rng.randrange(1, 5))]
        if k % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), menu[0].upper().replace("2019", str(2000 + k % 9)) if k % 2 else "- " + menu[0])
        if k % 5 == 0:
            body += [menu[1], menu[1]]
        if k % 7 == 0:
            body += [body[0], "same words again and again " * rng.randrange(1, 12)]
        rows.append((k, "\n".join(body), rng.choice([None, "big", "big", "small"])))
    rows += [(1000 + k, "\n".join([words(random.Random(8), 60, 5000), "copied line of one text"]), "big") for k in range(30)]  # one text counts once
    return rows


def test_line_rules_against_plain_version(spark, boilerplate):
    docs = spark.createDataFrame(boilerplate, "doc_id bigint, text string, source string")
    for name in ("row", "lines", "h", "words", "host", "digest", "own", "number"):
        docs = docs.withColumn(name, F.lit("x"))
    want = plain_rules(boilerplate, 5, 0.02)
    got = linefreq.line_rules(docs, least_docs=5, least_share=0.02)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert 5 <= sum(not r[6] and not r[7] for r in want) and any(r[7] and r[9] for r in want)
    assert all(r[9] == 0 for r in want if r[0] >= 1000)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_line_rules_beyond_a_broadcast(spark, boilerplate, monkeypatch):
    monkeypatch.setattr(linefreq, "SMALL", 1)
    monkeypatch.setattr(linefreq, "HOT", 40)
    docs = spark.createDataFrame(boilerplate, "doc_id bigint, text string, source string")
    got = linefreq.line_rules(docs, least_docs=5, least_share=0.02)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain_rules(boilerplate, 5, 0.02))


def test_clean_lines(spark, boilerplate):
    docs = spark.createDataFrame(boilerplate, "doc_id bigint, text string, source string").withColumn("number", F.lit(3))
    cleaned = linefreq.clean_lines(docs, least_docs=5, least_share=0.02)
    assert cleaned.columns == docs.columns
    verdicts = {r[0]: r for r in plain_rules(boilerplate, 5, 0.02)}
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert set(got) == {k for k, r in verdicts.items() if r[7]}
    for doc_id, text, _ in boilerplate:
        if doc_id in got:
            assert (got[doc_id] == text) == (verdicts[doc_id][9] == 0)
            assert sum(len(x.split(" ")) for x in plain_lines(got[doc_id]) if x) == verdicts[doc_id][8] - verdicts[doc_id][9]


def test_line_rules_corners(spark):
    docs = corner_docs(spark)
    got = collections.Counter((r.doc_id, *list(r)[1:6]) for r in linefreq.line_rules(docs).collect())
    assert got == collections.Counter((r[0], *plain_statistics(r[1] or "")) for r in corner_rows())
    assert linefreq.line_rules(empty_docs(spark)).collect() == [] == linefreq.clean_lines(empty_docs(spark)).collect()
    long = spark.createDataFrame([(1, "a b c d\n" * 30_000, "h"), (2, None, None)], "doc_id bigint, text string, source string")
    rows = {r.doc_id: r for r in linefreq.line_rules(long).collect()}
    assert (rows[1].n_words, rows[1].n_dup_lines, rows[1].n_repeat_words) == (120_000, 29_999, 120_000) and not rows[2].kept


# fill in the middle


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["run", "dense", "sparse", "none", "one"]), min_size=1, max_size=6), st.integers(0, 2**32))
def test_select_in_containers(kinds, seed):
    rng = np.random.default_rng(seed)
    found, want = BoundarySet(), []
    for key, kind in enumerate(kinds):
        low = {
            "run": np.arange(100, 60_000),
            "dense": np.flatnonzero(rng.random(1 << 16) < 0.6),
            "sparse": np.flatnonzero(rng.random(1 << 16) < 0.01),
            "none": np.empty(0, np.int64),
            "one": np.array([65535]),
        }[kind]
        found.add_block(key, low)
        want += ((key << 16) + low).tolist()
    assert len(found) == len(want)
    for k in {0, len(want) - 1, *(int(x) for x in rng.integers(0, max(1, len(want)), 50))} if want else ():
        assert found.select(k) == want[k]
    with pytest.raises(IndexError):
        found.select(len(want))


def test_container_forms():
    assert isinstance(container(np.arange(65536)), RunContainer)
    assert isinstance(container(np.arange(0, 65536, 100)), ArrayContainer)
    assert isinstance(container(np.arange(0, 65536, 2)), BitmapContainer)


def plain_middle(doc_id, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(t) for t in (tokens[:x], tokens[x:y], tokens[y:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_version(spark):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in corner_rows()] + [(200 + k, t) for k, t in enumerate(AWKWARD)]
    rows += [(300 + k, "".join(rng.choice("ab <>PSM,é日\n\U0001f600") for _ in range(rng.randrange(1, 200)))) for k in range(150)]
    rows += [(600, "x" * 200_000), (601, ", " * 70_000 + "word " * 30_000), (602, "ab" * 32_768), (603, "é" * 65_535 + "ab" * 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in (*CLASHING, "form", "output"):
        docs = docs.withColumn(name, F.lit("x"))
    made = middle.fill_in_middle(docs)
    got = collections.Counter(map(tuple, made.collect()))
    assert got == collections.Counter((d, *plain_middle(d, t or "")) for d, t in rows)
    back = made.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((d, t or "") for d, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(empty_docs(spark)).collect() == []


# alignment


def plain_groups(texts):
    """Per text the ids of both sides and the groups; None without tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a_model.encode_special_tokens = True
    back = {c: b for b, c in byte_alphabet().items()}
    out = []
    for text in texts:
        out.append(None)
        if not text:
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        spelt_a = [bytes(back[c] for c in a_model.id_to_token(i)) for i in a]
        spelt_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        if b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
            ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (spelt_a, spelt_b))
            groups, i, j = [], 0, 0
            after_a, after_b = ({end: k + 1 for k, end in enumerate(x)} for x in (ends_a, ends_b))
            for cut in sorted(set(ends_a) & set(ends_b)):
                x, y = after_a[cut], after_b[cut]
                groups.append((tuple(a[i:x]), tuple(b[j:y])))
                i, j = x, y
            out[-1] = (a, b, groups)
    return out


def plain_report(texts):
    rows = plain_groups(texts)
    count = collections.Counter(pair for r in rows if r for pair in {(p, q) for x, y in r[2] for p in x for q in y})
    best = collections.Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        met = [(p, q) for x, y in r[2] for p in x for q in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2])
        out.append((len(r[0]), len(r[1]), len(r[2]), len(met), sum(count[m] == best[m[0]] for m in met), sum(count[m] for m in met), hashlib.sha256(text.encode()).hexdigest()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 6), min_size=1, max_size=30), st.lists(st.integers(1, 6), min_size=1, max_size=30)), max_size=5))
def test_shared_groups(texts):
    ends, until = ([], []), ([], [])
    begin, want = 0, []
    for sizes in texts:
        total = max(map(sum, sizes))
        for side, own in enumerate(sizes):
            filled = [*own, total - sum(own)] if sum(own) < total else own
            ends[side].extend((begin + np.cumsum(filled)).tolist())
            until[side].append(len(ends[side]))
        begin += total
    want = sorted(set(ends[0]) & set(ends[1]))
    i, j = alignment.shared_groups(*(np.array(x, np.int64) for x in (*ends, *until)))
    assert [ends[0][k - 1] for k in i] == want == [ends[1][k - 1] for k in j]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab é日\n\t'1.▁  \U0001f600<s>"), max_size=40))
def test_encoders_are_the_tokenizers(text):
    pair = alignment.pair_of(A_FILE, B_FILE)
    assert np.frombuffer(pair.b.encode(text), pair.b.kind).tolist() == pair.b.model.encode(text)
    whole = pair.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    assert np.frombuffer(pair.a.encode(" " + text), pair.a.kind).tolist() == whole


def test_special_names_are_plain_text_only_if_asked_for():
    assert len(Encoder(A_FILE).encode("<|endoftext|>")) == 2 < len(Encoder(A_FILE, special=False).encode("<|endoftext|>"))
    assert PieceEncoder(B_FILE).plain


def alignment_rows():
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in corner_rows()] + [(200 + k, t) for k, t in enumerate(AWKWARD)]
    rows += [(300 + k, "".join(rng.choice("abcde fgh,é日\n\U0001f600") for _ in range(rng.randrange(1, 200)))) for k in range(60)]
    return rows + [(500, " " * 4000 + "x"), (501, "日本" * 3000)]


@pytest.mark.parametrize("at_once, frequent", [(1 << 21, 1 << 18), (1 << 21, 30), (2000, 1 << 18), (1, 1)])
def test_link_report_against_plain_version(spark, monkeypatch, at_once, frequent):
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    rows = alignment_rows()
    if at_once == 1:
        rows = rows[:4] + rows[20:60]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in (*CLASHING, "pair", "times", "a", "docs"):
        docs = docs.withColumn(name, F.lit("x"))
    got = collections.Counter(map(tuple, alignment.link_report(docs, A_FILE, B_FILE).collect()))
    assert got == collections.Counter((d, *r) for (d, _), r in zip(rows, plain_report([t for _, t in rows]), strict=True))


def test_many_links_in_pieces_are_the_same(monkeypatch):
    """A text of long groups, in ranges of one id at a time and at once."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 500), rng.integers(0, 7, 300)
    groups = alignment.Groups(a, b, np.array([0, 200, 350, 500]), np.array([0, 100, 250, 300]), np.array([0, 3]))
    want = collections.Counter((int(p), int(q)) for k in range(3) for p in a[groups.from_a[k] : groups.from_a[k + 1]] for q in b[groups.from_b[k] : groups.from_b[k + 1]])
    for at_once in (1 << 21, 500, 1):
        monkeypatch.setattr(alignment, "LINKS_AT_ONCE", at_once)
        got = [(int(p) >> 32, int(p) & 0xFFFFFFFF, int(t)) for _, pair, times in alignment.links(groups, 7) for p, t in zip(pair, times, strict=True)]
        assert len(got) == len(want) and {(p, q): t for p, q, t in got} == want


def test_align_tokens(spark):
    rows = alignment_rows()
    got = alignment.align_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), A_FILE, B_FILE).orderBy("row").collect()
    for r, (doc_id, _), want in zip(got, rows, plain_groups([t for _, t in rows]), strict=True):
        a, b, groups = want or ([], [], [])
        assert (r.doc_id, r.a, r.b) == (doc_id, a, b)
        assert (r.a_sizes, r.b_sizes) == ([len(x) for x, _ in groups], [len(y) for _, y in groups])
    assert alignment.align_tokens(empty_docs(spark), A_FILE, B_FILE).collect() == [] == alignment.link_report(empty_docs(spark), A_FILE, B_FILE).collect()
