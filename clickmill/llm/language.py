"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import one_memory, ship, utf8, with_any_names

#: Bytes of a window, widths of the filters, filters per width, size of a byte's vector.
WINDOW, WIDTHS, FILTERS, VECTOR = 256, (2, 3, 4), 10, 8
#: Most labelled rows to learn from, over all languages, and most windows of each.
SAMPLE, WINDOWS_EACH = 4000, 2
#: Windows that are scored together.
BATCH = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """``vectors[256, v]``, ``filters[width] = (width, v, f)``, ``bias[width]``, ``dense[sum f, classes]``, ``offset``."""

    classes: list[str]
    vectors: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What each pair of bytes, and the odd last byte, add to the filters of each width: the convolution is then
        a sum of looked-up rows, without any product per position."""
        out = {}
        for width, w in self.filters.items():
            single = [self.vectors @ w[k] for k in range(width)]
            pairs = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(1 << 16, -1) for k in range(0, width - 1, 2)]
            out[width] = [np.ascontiguousarray(t, np.float32) for t in pairs + ([single[-1]] if width % 2 else [])]
        return out

    def probabilities(self, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Softmax per row of ``windows`` (bytes, padded by zero)."""
        flat = np.ascontiguousarray(windows)
        pair = (flat[:, :-1].astype(np.uint16) << np.uint16(8)) | flat[:, 1:]
        n = flat.shape[1]
        pooled = []
        for width, looked in tables.items():
            span = n - width + 1
            total = looked[0].take(pair[:, :span].ravel(), axis=0)
            for k, t in enumerate(looked[1:], 1):
                at = pair[:, 2 * k : 2 * k + span] if t.shape[0] > 256 else flat[:, 2 * k : 2 * k + span]
                total += t.take(at.ravel(), axis=0)
            pooled.append(np.maximum(total.reshape(len(flat), span, -1).max(axis=1) + self.bias[width], 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.dense + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All bytes of a text as rows of ``size``; consecutive rows share no byte, the last one is padded by zero."""
    rows = max(1, -(-len(text) // size))
    return np.frombuffer(text.ljust(rows * size, b"\0"), np.uint8).reshape(rows, size)


def train(texts: list[bytes], labels: list[str], epochs: int = 12, rate: float = 0.01, batch: int = 128, seed: int = 7) -> Network:
    """Fit by Adam on up to ``WINDOWS_EACH`` windows of each text; classes weigh alike."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    rows, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        cut = cut_windows(text)
        picked = rng.choice(len(cut), min(WINDOWS_EACH, len(cut)), replace=False)
        rows.append(cut[picked])
        ys += [classes.index(label)] * len(picked)
    net = Network(
        classes,
        rng.normal(0, 0.5, (256, VECTOR)),
        {w: rng.normal(0, 1 / np.sqrt(w * VECTOR), (w, VECTOR, FILTERS)) for w in WIDTHS},
        {w: np.zeros(FILTERS) for w in WIDTHS},
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))),
        np.zeros(len(classes)),
    )
    if not rows or len(classes) < 2:
        return net
    x, y = np.concatenate(rows), np.array(ys)
    weight = 1 / np.bincount(y, minlength=len(classes)).clip(1)[y]
    weight /= weight.mean()
    steps: dict[str, list[np.ndarray]] = {}
    count = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), batch):
            at = order[start : start + batch]
            count += 1
            for name, grad in gradients(net, x[at], y[at], weight[at]).items():
                value = getattr(net, name) if "." not in name else getattr(net, name.split(".")[0])[int(name.split(".")[1])]
                m, v = steps.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8)
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean cross entropy of one batch. Max pooling sends a gradient to one position per filter, so only
    those positions enter the backward pass."""
    n, size = x.shape
    pooled, where = [], {}
    for w in WIDTHS:
        span = size - w + 1
        single = [net.vectors @ net.filters[w][k] for k in range(w)]
        total = sum(single[k].take(x[:, k : k + span].ravel(), axis=0) for k in range(w)).reshape(n, span, FILTERS)
        where[w] = total.argmax(axis=1)
        pooled.append(np.maximum(np.take_along_axis(total, where[w][:, None, :], 1)[:, 0] + net.bias[w], 0))
    h = np.concatenate(pooled, axis=1)
    delta = softmax(h @ net.dense + net.offset)
    delta[np.arange(n), y] -= 1
    delta *= (weight / n)[:, None]
    out = {"dense": h.T @ delta, "offset": delta.sum(axis=0)}
    back = (delta @ net.dense.T) * (h > 0)
    vectors = np.zeros_like(net.vectors)
    for i, w in enumerate(WIDTHS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        grad = np.zeros_like(net.filters[w])
        for k in range(w):
            at = np.take_along_axis(x, where[w] + k, 1)
            grad[k] = np.einsum("nf,nfv->vf", g, net.vectors[at])
            np.add.at(vectors, at.ravel(), (g[:, :, None] * net.filters[w][k].T[None]).reshape(-1, VECTOR))
        out[f"filters.{w}"] = grad
        out[f"bias.{w}"] = g.sum(axis=0)
    out["vectors"] = vectors
    return out


def some_windows(text: bytes, size: int = WINDOW) -> bytes:
    """``WINDOWS_EACH`` windows of a text, chosen by its checksum, one after the other."""
    cut = cut_windows(text, size)
    picked = np.random.default_rng(zlib.crc32(text)).choice(len(cut), min(WINDOWS_EACH, len(cut)), replace=False)
    return cut[picked].tobytes()


def labelled_sample(docs: DataFrame, text_col: str, label_col: str, id_col: str, rows: int) -> list:
    """Some windows, and the label, of about ``rows`` rows, the same number per label, chosen by a hash of the id.

    Labels are counted first; each row then decides by its own hash whether it is in, and its windows are cut where it is read,
    so the driver gets at most ``2 * rows`` rows of a fixed size.
    """
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(rows).collect()}
    if not counts:
        return []
    each = max(1, rows // len(counts))
    share = F.create_map(*(F.lit(v) for label, n in counts.items() for v in (label, min(1.0, each / n))))
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    picked = known.where(chance < share[F.col(label_col)]).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.col(id_col).cast("string").alias("id"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            windows = pa.array([some_windows(t) for t in utf8(part.column(0))], pa.binary())
            yield pa.RecordBatch.from_arrays([windows, part.column(1), part.column(2)], names=["windows", "label", "id"])

    windows = picked.mapInArrow(cut, f"windows binary, label {known.schema[label_col].dataType.simpleString()}, id string")
    return windows.orderBy(F.xxhash64("id"), "id", "windows").limit(2 * rows).collect()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE) -> Network:
    """Train on a bounded sample (``rows``, the documented bound) of the labelled rows of ``docs``."""
    got = labelled_sample(docs, text_col, label_col, id_col, rows)
    return train([bytes(r.windows) for r in got], [r.label for r in got])


def predict(texts: list[bytes | None], net: Network, tables: dict) -> tuple[list[str], list[float]]:
    """Language and mean probability of it over all windows of each whole text."""
    if not net.classes:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(net.classes)))
    counts = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    size = 0

    def flush() -> None:
        if held:
            p = net.probabilities(np.concatenate(held), tables)
            who = np.repeat([o for o, _ in owners], [k for _, k in owners])
            np.add.at(sums, who, p)
            np.add.at(counts, who, 1)

    for i, text in enumerate(texts):
        rows = cut_windows(text or b"")
        for start in range(0, len(rows), BATCH):
            part = rows[start : start + BATCH]
            held.append(part)
            owners.append((i, len(part)))
            size += len(part)
            if size >= BATCH:
                flush()
                held, owners, size = [], [], 0
    flush()
    mean = sums / counts[:, None].clip(1)
    best = mean.argmax(axis=1)
    letters = [bool(t) and has_letter(t) for t in texts]
    names = [net.classes[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return names, [float(mean[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))]


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter; ASCII is looked at first."""
    if any(97 <= c <= 122 or 65 <= c <= 90 for c in text[:64]):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def add_language(docs: DataFrame, net: Network) -> DataFrame:
    """``docs(doc_id, held_out, text)`` with ``lang_pred`` and ``score`` in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory()
        model = shared.value
        tables = model.tables()
        for part in parts:
            names, scores = predict(utf8(part.column(2)), model, tables)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def fold(id_col: str) -> Column:
    """Rows of remainder 0 are held out; a null id counts as such."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)), F.lit(0)) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row.

    Learns from rows that are not held out and have a text and a language. A null text, or one without a letter, is
    ``und`` with score 0; so is every text if nothing could be learnt. Ties go to the first language by name. Rows that repeat
    an id are rows of their own; other columns are not looked at. One pass over the texts after training; no shuffle.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    net = fit(source.where(~fold("doc_id")), "doc_id", "text", "lang", rows)
    return add_language(source.select("doc_id", fold("doc_id").alias("held_out"), "text"), net)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = 0.4, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a language of probability ``least`` or more, and all their columns as they are.

    Learns and judges like :func:`identify`; rows are filtered where they are read.
    """
    ship(docs.sparkSession)
    net = fit(docs.where(~fold(id_col)), id_col, text_col, label_col, rows)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_memory()
        model = shared.value
        tables = model.tables()
        for part in parts:
            names, scores = predict(utf8(part.column(at)), model, tables)
            yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return with_any_names(docs, keep)
