"""Quality scores by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, utf8
from .language import fold

#: Most labelled rows to learn from.
SAMPLE = 6000
#: Bins of a feature, of each side of an interaction, and interactions.
BINS, GRID, PAIRS = 32, 8, 6
#: A row is predicted as 1 from this score on.
CUT = 0.3

FEATURES = (
    "log_bytes", "words", "word_length", "longest_word", "upper", "digit", "punctuation", "symbol", "space", "non_ascii",
    "distinct_words", "top_word", "distinct_lines", "repeated_triples", "line_length", "stop_ends", "control", "byte_entropy", "caps_words", "mixed_words",
)

_CLASS = np.zeros((256, 8))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t\r\n\v\f", bytes(range(128, 256)), bytes([*range(9), *range(14, 32), 127]))):
    for _c in _chars:
        _CLASS[_c, _k] = 1


def describe(text: bytes | None) -> list[float]:
    """The ``FEATURES`` of one whole text; null counts as empty, which is all zero."""
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digit, punct, symbol, space, high, control, _ = counts @ _CLASS / n
    p = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2)
    return [
        float(np.log(n)), float(np.log1p(len(words))), (n - counts[32]) / w, float(max(map(len, words), default=0)), upper, digit, punct, symbol, space, high,
        len(seen) / w, max(seen.values(), default=0) / w, len(set(lines)) / max(1, len(lines)), triples, np.log1p(n / max(1, len(lines))),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)), control, float(-(p * np.log(p)).sum()),
        sum(n for x, n in seen.items() if x.isupper() and len(x) > 1) / w, sum(n for x, n in seen.items() if not x[-1:].isalnum() and x[-1:] not in b".,") / w,
    ]


@dataclass
class AdditiveModel:
    """``offset`` + one table over the bins of each feature + one over the grid of each pair of features."""

    edges: list[np.ndarray] = field(default_factory=list)
    offset: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    grids: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row of features."""
        total = np.full(len(x), self.offset)
        if self.edges:
            at = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[at[:, j]]
            for (i, j), t in self.grids.items():
                total += t[self.coarse[i][at[:, i]], self.coarse[j][at[:, j]]]
        return 1 / (1 + np.exp(-total))


def best_cuts(grad: np.ndarray, hess: np.ndarray, leaves: int, damp: float = 1.0) -> np.ndarray:
    """Values per bin of a shallow tree with at most ``leaves`` leaves: the best cut of any leaf is made, and again."""
    bounds = [0, len(grad)]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + damp)
    for _ in range(leaves - 1):
        best, cut = 1e-9, None
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                won = gain(a, m) + gain(m, b) - gain(a, b)
                if won.max() > best:
                    best, cut = won.max(), int(m[won.argmax()])
        if cut is None:
            break
        bounds = sorted([*bounds, cut])
    out = np.zeros(len(grad))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out[a:b] = -(g[b] - g[a]) / (h[b] - h[a] + damp)
    return out


def best_quarters(grad: np.ndarray, hess: np.ndarray, damp: float = 1.0) -> tuple[np.ndarray, float]:
    """Values on a grid of the tree that cuts each of two features once, and what it gains."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, values = -1.0, np.zeros_like(grad)
    for i in range(1, len(grad)):
        for j in range(1, grad.shape[1]):
            gs = np.array([[g[i - 1, j - 1], g[i - 1, -1] - g[i - 1, j - 1]], [g[-1, j - 1] - g[i - 1, j - 1], g[-1, -1] - g[i - 1, -1] - g[-1, j - 1] + g[i - 1, j - 1]]])
            hs = np.array([[h[i - 1, j - 1], h[i - 1, -1] - h[i - 1, j - 1]], [h[-1, j - 1] - h[i - 1, j - 1], h[-1, -1] - h[i - 1, -1] - h[-1, j - 1] + h[i - 1, j - 1]]])
            gain = float((gs**2 / (hs + damp)).sum())
            if gain > best:
                best = gain
                leaf = -gs / (hs + damp)
                values = np.repeat(np.repeat(leaf, [i, len(grad) - i], axis=0), [j, grad.shape[1] - j], axis=1)
    return values, best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, leaves: int = 3, patience: int = 20, pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets one shallow tree, added to its table.

    Then the ``pairs`` interactions that explain most of what is left are boosted in the same way. Either phase ends by
    its ``rounds`` or when the loss on every fifth row has not fallen for ``patience`` rounds, and keeps its best state.
    """
    if not len(y):
        return AdditiveModel()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(offset=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [np.arange(len(e) + 1) * GRID // (len(e) + 1) for e in model.edges]
    at = model.bins(x)
    check = np.arange(len(y)) % 5 == 4
    fit = ~check
    total = np.full(len(y), model.offset)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.where(fit, p - y, 0.0), np.where(fit, p * (1 - p), 0.0)

    def loss() -> float:
        t = total[check]
        return float(np.mean(np.logaddexp(0, t) - y[check] * t)) if check.any() else 0.0

    def boost(parts: dict, cells: dict, tree) -> None:
        nonlocal total
        best, kept, since = loss(), {k: v.copy() for k, v in parts.items()}, 0
        for _ in range(rounds):
            for key, t in parts.items():
                g, h = slopes()
                size = t.size
                step = rate * tree(np.bincount(cells[key], g, size).reshape(t.shape), np.bincount(cells[key], h, size).reshape(t.shape))
                t += step
                total = total + step.ravel()[cells[key]]
            now = loss()
            if now < best - 1e-6:
                best, kept, since = now, {k: v.copy() for k, v in parts.items()}, 0
            else:
                since += 1
                if since >= patience:
                    break
        for key, t in parts.items():
            total = total + (kept[key] - t).ravel()[cells[key]]
            t[...] = kept[key]

    boost(dict(enumerate(model.tables)), {j: at[:, j] for j in range(x.shape[1])}, lambda g, h: best_cuts(g, h, leaves))

    g, h = slopes()
    cells = {(i, j): model.coarse[i][at[:, i]] * GRID + model.coarse[j][at[:, j]] for i, j in combinations(range(x.shape[1]), 2)}
    grid = lambda v, key: np.bincount(cells[key], v, GRID * GRID).reshape(GRID, GRID)
    gains = {key: best_quarters(grid(g, key), grid(h, key))[1] for key in cells}
    chosen = sorted(gains, key=lambda key: (-gains[key], key))[:pairs]
    model.grids = {key: np.zeros((GRID, GRID)) for key in chosen}
    boost(model.grids, {key: cells[key] for key in chosen}, lambda g, h: best_quarters(g, h)[0])
    return model


def add_features(docs: DataFrame) -> DataFrame:
    """``docs(key, text)`` as ``key`` and ``features``; the whole text counts."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([describe(t) for t in utf8(part.column(1))], pa.list_(pa.float64()))], names=["key", "features"])

    return docs.mapInArrow(rows, f"key {docs.schema['key'].dataType.simpleString()}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> AdditiveModel:
    """Train on at most about ``rows`` (the documented bound) labelled rows of ``docs(doc_id, text)``.

    Labels decide by a hash of the id; only the chosen ones are joined, so texts are read once and not moved.
    Labels other than 0 and 1, and null ids, do not count; of several labels of one id the largest counts.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    picked = known.where(chance < share)
    texts = docs.join(F.broadcast(picked), "doc_id").select(F.struct("doc_id", "label").alias("key"), "text")
    got = add_features(texts).select("key.label", "key.doc_id", "features").orderBy("doc_id", "features").limit(2 * rows).collect()
    x = np.array([r.features for r in got], float).reshape(len(got), len(FEATURES))
    return train(x, np.array([r.label for r in got], float))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Learns from labelled rows that are not held out; ids and labels are no inputs of a score. A null text counts as
    empty. Rows that repeat an id are scored one by one, other columns are not looked at, and without any usable label every
    score is 0.5. One pass over the texts after training; no shuffle.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(source.where(~fold("doc_id")), marks.where(~fold("doc_id")), rows))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array([describe(t) for t in utf8(part.column(2))], float).reshape(part.num_rows, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", fold("doc_id").alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
