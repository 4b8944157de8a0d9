"""Quality by ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(threshold_k - w.x): all grades share the weights w of
hashed byte trigrams and of binned shape statistics; the thresholds are ordered
by construction. Expected grade and tail probability follow for any document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkit
from millrace.llm.toxicity import held_out

GRAMS, BINS = 4096, 12
STATS = ("words", "word_length", "upper", "digit", "symbol", "space", "distinct", "lines", "repeats")
WIDTH = GRAMS + BINS * len(STATS)
#: Graded rows that are read at most.
TRAIN_ROWS = 4000
STEPS, RATE, PENALTY = 300, 0.05, 1e-4

_UPPER, _DIGIT, _SYMBOL, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SPACE[list(textkit.SPACES)] = True


def _slots(data: np.ndarray) -> np.ndarray:
    """The slot of the trigram that starts at each byte but the last two."""
    d = data.astype(np.uint32)
    return ((d[:-2] * 0x9E3779B1 + d[1:-1] * 0x85EBCA6B + d[2:] * 0xC2B2AE35) * np.uint32(0x27D4EB2F)) >> np.uint32(20)


def _bins(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, statistics): the bin of each statistic of each row."""
    starts, ends, first = textkit.word_spans(part, at)
    hashes = textkit.span_hashes(part, starts, ends)
    size, words = np.maximum(np.diff(at), 1), np.diff(first)
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[part])])[at]) / size
    distinct = np.array([len(np.unique(hashes[b:e])) / max(1, e - b) for b, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    again = np.concatenate([[0, 0], np.cumsum(hashes[1:] == hashes[:-1])])[: len(hashes) + 1]
    repeats = (again[first[1:]] - again[np.minimum(first[:-1] + 1, first[1:])]) / np.maximum(words, 1)
    breaks = np.diff(np.concatenate([[0], np.cumsum(part == 10)])[at])
    out = [
        np.log2(words + 1) * 0.75,
        np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[first]) / np.maximum(words, 1),
        share(_UPPER) * BINS,
        share(_DIGIT) * 2 * BINS,
        share(_SYMBOL) * 2 * BINS,
        share(_SPACE) * 2 * BINS,
        distinct * BINS,
        np.log2(size / (breaks + 1) + 1),
        repeats * 2 * BINS,
    ]
    return np.clip(np.array(out).T, 0, BINS - 1).astype(np.int64)


def _features(texts: pa.Array) -> np.ndarray:
    data, offsets = textkit.text_buffers(texts)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    for row, end, part, at in textkit.chunks(data, offsets):
        bins = _bins(part, at)
        for i in range(row, end):
            own = part[at[i - row] : at[i - row + 1]]
            if len(own) > 2:
                out[i, :GRAMS] = np.bincount(_slots(own), minlength=GRAMS) / np.float32(len(own) - 2)
        places = GRAMS + np.arange(len(STATS)) * BINS + bins
        out[np.arange(row, end)[:, None], places] = 1
    return out


@dataclass(frozen=True)
class Model:
    """Weights of the features, ordered thresholds between the grades, and the grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[int, ...]

    def lean(self, texts: pa.Array) -> np.ndarray:
        """w.x of each text, without building x."""
        data, offsets = textkit.text_buffers(texts)
        out = np.zeros(len(offsets) - 1)
        w = self.weights
        for row, end, part, at in textkit.chunks(data, offsets):
            bins = _bins(part, at)
            out[row:end] = w[GRAMS + np.arange(len(STATS)) * BINS + bins].sum(axis=1)
            if len(part) > 2:
                total = np.concatenate([[0.0], np.cumsum(w[_slots(part)]), [0.0, 0.0]])
                n = np.diff(at) - 2
                some = n > 0
                out[row:end][some] += (total[at[:-1][some] + n[some]] - total[at[:-1][some]]) / n[some]
        return out

    def above(self, lean: np.ndarray) -> np.ndarray:
        """(rows, thresholds): the probability of a grade above each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - lean[:, None], -60, 60)))


def train(texts: list[str | None], grades: list[int], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Fit by gradient descent with per-weight rates. With fewer than two grades there is no threshold."""
    known = tuple(sorted(set(grades)))
    if len(known) < 2:
        return Model(np.zeros(WIDTH), np.zeros(0), known)
    x = _features(pa.array(texts, pa.string()))
    scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)).astype(np.float32) + np.float32(1e-4)
    x /= scale
    y = np.searchsorted(known, grades)
    cuts = len(known) - 1
    shares = np.clip(np.array([(y <= k).mean() for k in range(cuts)]), 1e-3, 1 - 1e-3)
    start = np.log(shares / (1 - shares))
    # thresholds are the first and the logs of the steps from each to the next
    p = np.concatenate([np.zeros(WIDTH), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(len(y))
    for t in range(1, steps + 1):
        w, gaps = p[:WIDTH].astype(np.float32), np.exp(p[WIDTH + 1 :])
        theta = p[WIDTH] + np.concatenate([[0], np.cumsum(gaps)])
        z = (x @ w).astype(np.float64)
        # the loss is -log(F(upper) - F(lower)); its slopes by upper and lower bound
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        f = 1 / (1 + np.exp(-np.clip(edge[None, :] - z[:, None], -60, 60)))
        f[:, 0], f[:, -1] = 0, 1
        hit = np.maximum(f[rows, y + 1] - f[rows, y], 1e-12)
        up, low = f[rows, y + 1] * (1 - f[rows, y + 1]) / hit, f[rows, y] * (1 - f[rows, y]) / hit
        slope = np.zeros_like(p)
        slope[:WIDTH] = x.T @ ((up - low) / len(y)).astype(np.float32) + penalty * p[:WIDTH]
        by_cut = np.array([low[y == k + 1].sum() - up[y == k].sum() for k in range(cuts)]) / len(y)
        slope[WIDTH] = by_cut.sum()
        slope[WIDTH + 1 :] = by_cut[1:][::-1].cumsum()[::-1] * gaps
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(p[:WIDTH] / scale, p[WIDTH] + np.concatenate([[0], np.cumsum(np.exp(p[WIDTH + 1 :]))]), known)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model from at most `rows` graded documents that are not held out: the least by a hash of the id.

    Where ids repeat, the same bound holds for the rows of documents and of labels:
    2 * rows of the join are read at most. Rows with a null id or grade don't count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).select("doc_id", F.col(grade).cast("int").alias("grade")).where(~held_out(F.col("doc_id")))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `rows` at most
    sample = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "text").limit(2 * rows).toPandas()
    return train(sample["text"].tolist(), sample["grade"].tolist())


def graded(docs: DataFrame, model: Model, least: int | None = None, tail: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability (of grade `least`, the highest, or above) and kept.

    Kept: the tail probability is `tail` at least. A null text is an empty one.
    Without thresholds the expected grade is the only one known, or null, and all
    rows are kept. Columns of docs keep their names; those three are replaced.
    """
    grades = np.array(model.grades, dtype=float)
    place = len(grades) - 1 if least is None else int(np.searchsorted(grades, least))
    names = ("expected_grade", "tail_probability", "kept")
    docs = docs.drop(*names)
    # columns go by place, so that any name will do
    places = [f"c{i}" for i in range(len(docs.columns))]
    text = places[[c.lower() for c in docs.columns].index("text")]
    given = docs.toDF(*places)
    schema = given.schema.__class__([*given.schema.fields]).add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if len(grades) < 2:
                expected, mass = (np.full(n, grades[0]) if len(grades) else [None] * n), np.ones(n)
            else:
                above = model.above(model.lean(batch.column(text)))
                expected = grades[0] + above @ np.diff(grades)
                mass = np.ones(n) if place == 0 else above[:, place - 1] if place <= above.shape[1] else np.zeros(n)
            columns = [pa.array(expected, pa.float64()), pa.array(mass, pa.float64()), pa.array(mass >= tail)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return given.mapInArrow(run, schema).toDF(*docs.columns, *names)
