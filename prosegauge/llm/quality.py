"""Quality by naive Bayes support vectors.

Features are indicators of n-grams: byte n-grams of the text and n-grams of word shapes (how a
word is written, how long it is, whether it repeats the word before). Each is scaled by the log
ratio of its smoothed counts in the two classes; a linear hinge-loss model is fitted to the
scaled rows by dual coordinate descent, and a sigmoid turns margins into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, as_bytes, forget_kept
from .training import LEAST_OF_CLASS, fold, labelled_sample, platt, sigmoid

BITS = 17
BYTE_GRAMS = (1, 2, 3)
SHAPE_GRAMS = (1, 2, 3)
#: Bytes of a text that are looked at together.
BLOCK = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def shape(word: bytes) -> int:
    """Under 128: case of the letters, marks and digits, and the length in four steps."""
    letters = b"".join(_LETTERS.findall(word))
    core = letters.decode("utf-8", "replace")
    case = 0 if not core else 1 if core.islower() else 2 if core.isupper() and len(core) > 1 else 3 if core[0].isupper() else 4
    digits = any(48 <= c <= 57 for c in word)
    marks = len(word) - len(letters)
    step = 0 if len(word) <= 3 else 1 if len(word) <= 8 else 2 if len(word) <= 16 else 3
    return case + 5 * (0 if marks == 0 else 1 if marks == 1 else 2) + 15 * digits + 30 * step


def features(text: bytes, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted numbers (below 2**BITS) of the n-grams that the text has."""
    seen = np.zeros(1 << BITS, dtype=bool)

    def mark(codes: np.ndarray, kind: int) -> None:
        """Set the numbers of 32-bit n-gram codes: the top bits of a product that wraps."""
        seen[((codes ^ np.uint32(kind * 0x2545F491 & 0xFFFFFFFF)) * _MULTIPLIERS[kind % 3]) >> np.uint32(32 - BITS)] = True

    def grams(items: np.ndarray, sizes: tuple[int, ...], base: int) -> None:
        code = items
        for n in range(1, max(sizes) + 1):
            if n > 1:
                if len(items) < n:
                    break
                code = (code[:-1] << np.uint32(8)) + items[n - 1 :]
            if n in sizes:
                mark(code, base + n)

    data = np.frombuffer(text, dtype=np.uint8)
    longest = max(BYTE_GRAMS)
    for at in range(0, len(data), BLOCK):  # blocks overlap, so no n-gram is lost between them
        grams(data[at : at + BLOCK + longest - 1].astype(np.uint32), BYTE_GRAMS, 0)
    words = text.split()
    if words:
        shapes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint32, count=len(words))
        again = np.fromiter(map(bytes.__eq__, words[1:], words[:-1]), dtype=bool, count=len(words) - 1)
        shapes[1:] += np.uint32(128) * again
        grams(shapes, SHAPE_GRAMS, 10)
    return np.flatnonzero(seen).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smoothing)
    for x, label in zip(rows, y, strict=True):
        counts[label, x] += 1
    share = counts / np.abs(counts).sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L2-regularised hinge loss over rows scale[x] / sqrt(len(x)).

    One dual variable at a time is set to its best value between 0 and its row's cost.
    """
    signs = np.where(y == 1, 1.0, -1.0)
    norms = [1 / np.sqrt(max(1, len(x))) for x in rows]
    values = [scale[x] * n for x, n in zip(rows, norms, strict=True)]
    square = np.array([v @ v + 1.0 for v in values])
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost.max():
            break
    return w, b


@dataclass(frozen=True)
class QualityModel:
    """weights over feature numbers (already scaled), intercept and the sigmoid's two numbers."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / np.sqrt(max(1, len(x)))) + self.intercept

    def scores(self, texts: list[bytes | None], memo: dict) -> np.ndarray:
        margins = np.array([self.margin(features(t or b"", memo)) for t in texts])
        return sigmoid(self.slope * margins + self.offset)


def train(texts: list[bytes], y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> QualityModel:
    """A model; of one class only, or of nothing, it scores the smoothed share of label 1 throughout."""
    up, n = int(y.sum()), len(y)
    if min(up, n - up) < LEAST_OF_CLASS:
        prior = (up + 1) / (n + 2)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    memo = WordMemo(shape)
    rows = [features(t, memo) for t in texts]
    costs = cost * np.where(y == 1, 0.5 * n / up, 0.5 * n / (n - up))

    def fit(which: np.ndarray) -> tuple[np.ndarray, float]:
        part = [rows[i] for i in which]
        ratios = log_count_ratios(part, y[which])
        w, b = dual_coordinate_descent(part, y[which], ratios, costs[which], rounds)
        return w * ratios, b

    def margins(model: tuple[np.ndarray, float], which: np.ndarray) -> np.ndarray:
        return np.array([model[0][rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + model[1] for i in which])

    # The sigmoid is fitted to margins of rows that their model has not seen.
    part = np.arange(n) % 3
    unseen = np.zeros(n)
    for k in range(3):
        out = np.flatnonzero(part == k)
        unseen[out] = margins(fit(np.flatnonzero(part != k)), out)
    a, b = platt(unseen, y)
    w, intercept = fit(np.arange(n))
    return QualityModel(w, intercept, a, b)


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 3, held_out: int = 1, sample_rows: int = 3000, sample_bytes: int = 24 << 20) -> QualityModel:
    """Train on a bounded sample (sample_rows, sample_bytes) of rows outside the held-out fold."""
    return train(*labelled_sample(docs, labels, label_col, modulus, held_out, sample_rows, sample_bytes))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """docs with the double column out_col (replaced if there), from the whole text alone.

    A null text scores as the empty one. Equal texts score equally. No rows: no rows.
    """
    docs = docs.drop(out_col)
    names = docs.columns
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), as_bytes(text_col).alias("txt"))
    schema = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        memo = WordMemo(shape)
        for batch in batches:
            got = shared.value.scores(batch.column("txt").to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, pa.float64())], ["row", "score"])

    return source.mapInArrow(run, schema).select("row.*", F.col("score").alias(out_col))


def held_out(id_col: str = "doc_id", modulus: int = 3, remainder: int = 1) -> F.Column:
    return F.coalesce(fold(id_col, modulus) == remainder, F.lit(False))
