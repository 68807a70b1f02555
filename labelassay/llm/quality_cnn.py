"""Quality by a small convolutional network over the bytes of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

WIDTH, STRIDE, FILTERS = 8, 2, 16
CHUNK = 128  # bytes of a chunk
STEP = CHUNK - WIDTH + STRIDE  # so every window of every chunk border is in some chunk
PAD = 256


def chunks(text: str) -> np.ndarray:
    """Overlapping chunks that cover the whole text, padded; one at least."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(data) - CHUNK) // STEP) + 1)
    padded = np.full((n - 1) * STEP + CHUNK, PAD, np.uint16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


@dataclass
class QualityModel:
    """A filter is a table with a weight for each byte at each of ``WIDTH`` places."""

    tables: np.ndarray  # WIDTH, 257, FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    shift: float

    @classmethod
    def start(cls, prior: float, seed: int = 5) -> QualityModel:
        dice = np.random.default_rng(seed)
        tables = dice.normal(0, 0.25, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        return cls(tables, np.zeros(FILTERS, np.float32), dice.normal(0, 0.1, FILTERS).astype(np.float32), float(np.log(prior / (1 - prior))))

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Of all filters at all windows of chunks ``x``: chunks, windows, filters."""
        n = (CHUNK - WIDTH) // STRIDE + 1
        total = self.tables[0][x[:, 0 : STRIDE * n : STRIDE]]
        for k in range(1, WIDTH):
            total += self.tables[k][x[:, k : k + STRIDE * (n - 1) + 1 : STRIDE]]
        return total

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each chunk, after the bias, at least 0."""
        parts = [self.responses(x[i : i + 256]).max(axis=1) for i in range(0, len(x), 256)]
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1: the mean over all chunks, weighted and squashed."""
        cut = [chunks(t) for t in texts]
        sizes = np.array([len(c) for c in cut])
        mean = np.add.reduceat(self.pooled(np.concatenate(cut)), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return 1 / (1 + np.exp(-np.clip(mean @ self.out + self.shift, -30, 30)))


def slopes_of(model: QualityModel, cut: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Slopes of the mean log loss over documents (their chunks), by tables, bias, out and shift."""
    sizes = np.array([len(c) for c in cut])
    x = np.concatenate(cut).astype(np.int64)
    best, top = np.empty((len(x), len(model.bias)), np.int64), np.empty((len(x), len(model.bias)), np.float32)
    for i in range(0, len(x), 512):
        raw = model.responses(x[i : i + 512])
        at = raw.argmax(axis=1)  # chunks, filters
        best[i : i + 512], top[i : i + 512] = at, np.take_along_axis(raw, at[:, None, :], 1)[:, 0] + model.bias
    act = np.maximum(top, 0)
    mean = np.add.reduceat(act, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    p = 1 / (1 + np.exp(-np.clip(mean @ model.out + model.shift, -30, 30)))
    d = ((p - labels) / len(cut)).astype(np.float32)
    d_top = np.repeat(d / sizes, sizes)[:, None] * model.out * (top > 0)
    seen = x[np.arange(len(x))[:, None, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]  # chunks, filters, places
    cell = (np.arange(WIDTH) * (PAD + 1) + seen) * FILTERS + np.arange(FILTERS)[:, None]
    d_tables = np.bincount(cell.ravel(), np.repeat(d_top.ravel(), WIDTH), model.tables.size).reshape(model.tables.shape)
    return [d_tables, d_top.sum(axis=0), mean.T @ d, np.array([d.sum()])]


def fit(samples: list[str], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 5) -> QualityModel:
    """Adam on the log loss over whole texts, all their chunks."""
    prior = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    model = QualityModel.start(prior, seed)
    if len(set(labels.tolist())) < 2:
        model.out[:] = 0
        return model
    dice = np.random.default_rng(seed)
    values = [model.tables, model.bias, model.out, np.array([model.shift], np.float32)]
    first, second, t = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        order = dice.permutation(len(samples))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            model.shift = float(values[3][0])
            slopes = slopes_of(model, [chunks(samples[r]) for r in rows], labels[rows])
            slopes[0] = slopes[0] + 1e-5 * model.tables
            slopes[2] = slopes[2] + 1e-4 * model.out
            t += 1
            pace = rate * (0.5 if epoch >= epochs * 2 // 3 else 1) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for v, g, m, s in zip(values, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (pace * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    model.shift = float(values[3][0])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = 3000, folds: int = 5) -> QualityModel:
    """Learn from a bounded sample of labelled documents.

    Only labels of documents whose crc32(doc_id) isn't divisible by ``folds``
    are used: the ``rows`` with the least hash of doc_id, with their whole
    texts, which is all that the driver gathers. Labels that repeat
    for a doc_id count with their mean; null ones don't count.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where(~held_out(F.col("doc_id"), folds) & F.col("label").isNotNull())
    chosen = usable.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # Rows that share a doc_id are one sample each, up to as many as there are labels.
    found = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in found], np.array([r["label"] for r in found], np.float32))


def quality_of(text: Column, model: QualityModel) -> Column:
    """Probability (0 to 1) that a whole text has quality 1; null counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch:
                held.append(text if isinstance(text, str) else "")
                size += len(held[-1])
                if size > 1 << 20:
                    out.append(model.score(held))
                    held, size = [], 0
            if held:
                out.append(model.score(held))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """Quality of every whole text.

    Reads ``doc_id`` and ``text`` of ``docs``, and ``doc_id`` and ``quality``
    of ``labels``; other columns are left out. Null texts count as empty, and
    an empty text has the score of one padded chunk. Repeated rows get a
    result each; a null doc_id counts as held out; without labels of both
    kinds every score is the share of ones (0.5 without labels). An empty
    table gives no rows. Returns doc_id, held_out, score, predicted.
    """
    model = model or fit_quality(docs, labels, folds=folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quality_of(F.col("text").cast("string"), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
