"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, of the whole word and of its first letters. Filters of several widths slide over the words of a
text, each keeps its largest response (max pooling over the whole text), and a linear layer gives
the logit. Embeddings start at zero, so a word that training never moved has no say. Thresholds
are calibrated by the language guessed from the function words of the text itself: the score is
the sigmoid of the logit minus the threshold of that language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, as_bytes
from .quality import held_out  # noqa: F401  (the fold of the query)
from .training import LEAST_OF_CLASS, labelled_sample, sigmoid

HASH_BITS = 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
#: Letters of a word's beginning that have an embedding of their own.
STEM = 4
PAD = max(WIDTHS)
#: Words that are looked at together when scoring.
BLOCK = 50_000
#: Function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the and of to in is that for with was are this from",
    "fr": "le la les des et une dans pour que qui sur du",
    "de": "der die das und ist von mit ein eine nicht den im",
    "es": "el los las una y en por con para su es como",
}
LANGUAGES = ("other", *FUNCTION_WORDS)
_LANGUAGE_OF = {w.encode(): k + 1 for k, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}
_EDGES = re.compile(rb"^[^A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff]+$")
_MASK = (1 << HASH_BITS) - 1


def word_code(word: bytes) -> int:
    """Two hashes and the language (by number) of the lower-cased word without marks at its ends."""
    core = _EDGES.sub(b"", word.decode("utf-8", "replace").lower().encode())
    if not core:
        return 0
    stem = core.decode("utf-8", "replace")[:STEM].encode()
    return (zlib.crc32(core) & _MASK) | (zlib.crc32(stem, 7) & _MASK) << HASH_BITS | _LANGUAGE_OF.get(core, 0) << 2 * HASH_BITS | 1 << 40


@dataclass
class ToxicityModel:
    """Embedding tables (two, 2**HASH_BITS x DIM), filters by width, linear layer, thresholds by language."""

    tables: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray

    def embed(self, codes: np.ndarray) -> np.ndarray:
        """Zero rows for code 0 (padding and words without letters or digits)."""
        x = self.tables[0][codes & _MASK] + self.tables[1][(codes >> HASH_BITS) & _MASK]
        x[codes == 0] = 0
        return x

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Before pooling: for each width, a row per window start that has a whole window."""
        shares = x @ np.concatenate([w[j] for w in self.filters for j in range(len(w))], axis=1)
        found, column = [], 0
        for width, bias in zip(WIDTHS, self.biases, strict=True):
            rows = len(x) - width + 1
            z = shares[:rows, column : column + FILTERS] + bias
            for j in range(1, width):
                z += shares[j : j + rows, column + j * FILTERS : column + (j + 1) * FILTERS]
            found.append(z)
            column += width * FILTERS
        return found

    def pooled(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest responses over windows starting in [start, end) of a padded run of words."""
        rows = len(codes) - PAD + 1  # the last window starts lie in the last padding
        z = np.concatenate([z[:rows] for z in self.responses(self.embed(codes))], axis=1)
        cuts = np.stack([starts, ends], axis=1).ravel()
        return np.maximum.reduceat(z, np.minimum(cuts, rows - 1), axis=0)[::2]

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def scores(self, texts: list[bytes | None], memo: dict) -> np.ndarray:
        """Scores of whole texts; long ones are pooled over overlapping blocks."""
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf)
        spoken = np.zeros((len(texts), len(LANGUAGES)), dtype=np.int64)
        for codes, starts, ends, owner in blocks(texts, memo):
            np.maximum.at(best, owner, self.pooled(codes, starts, ends))
            tongues = codes >> 2 * HASH_BITS & 7
            hits = np.flatnonzero(tongues)
            of = np.searchsorted(starts, hits, side="right") - 1
            sure = hits < ends[of]
            np.add.at(spoken, (owner[of[sure]], tongues[hits[sure]]), 1)
        return sigmoid(self.logit(best) - self.thresholds[language(spoken)])


def language(spoken: np.ndarray) -> np.ndarray:
    """The number of the language with the most function words; 0 where there are none."""
    return np.where(spoken.max(axis=1) > 0, spoken.argmax(axis=1), 0)


def blocks(texts: list[bytes | None], memo: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of word codes with padding behind each text or part of one: codes, starts, ends, owners."""
    pad = np.zeros(PAD, dtype=np.int64)
    parts, starts, ends, owner, held = [], [], [], [], 0

    def run() -> tuple:
        return np.concatenate(parts), np.array(starts), np.array(ends), np.array(owner)

    for number, text in enumerate(texts):
        words = (text or b"").split()
        codes = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
        for at in range(0, max(1, len(codes)), BLOCK):
            part = codes[at : at + BLOCK + PAD]  # windows that start in this block end in it
            own = min(BLOCK, len(codes) - at)
            parts += [part, pad]
            starts.append(held)
            ends.append(held + max(1, own))
            owner.append(number)
            held += len(part) + PAD
            if held >= BLOCK:
                yield run()
                parts, starts, ends, owner, held = [], [], [], [], 0
    if held:
        yield run()


def train(texts: list[bytes], y: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.05, seed: int = 11) -> ToxicityModel:
    """Fit on texts and 0/1 labels; of one class only, the model scores the smoothed share throughout."""
    rng = np.random.default_rng(seed)
    tables = np.zeros((2, 1 << HASH_BITS, DIM), dtype=np.float32)
    filters = [rng.normal(0, 0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    up, n = int(y.sum()), len(y)
    prior = float(np.log((up + 1) / (n - up + 1)))
    model = ToxicityModel(tables, filters, biases, out, prior, np.zeros(len(LANGUAGES)))
    if min(up, n - up) < LEAST_OF_CLASS:
        return model
    memo = WordMemo(word_code)
    coded = [np.fromiter(map(memo.__getitem__, w), dtype=np.int64, count=len(w)) for w in map(bytes.split, texts)]
    pad = np.zeros(PAD, dtype=np.int64)
    valid = np.arange(n) % 5 == 4
    rows = np.flatnonzero(~valid)
    lift = np.sqrt((n - up) / up)
    speed_tables = np.zeros((2, 1 << HASH_BITS), dtype=np.float32)
    dense = [*filters, *biases, out]
    speed = [np.zeros_like(p) for p in dense]
    speed_bias = 0.0

    def forward(numbers: np.ndarray) -> tuple:
        codes = np.concatenate([p for i in numbers for p in (coded[i], pad)])
        lengths = np.array([len(coded[i]) for i in numbers])
        starts = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]])
        return codes, starts, starts + np.maximum(1, lengths)

    for _ in range(epochs):
        order = rng.permutation(rows)
        for k in range(0, len(order), batch):
            numbers = order[k : k + batch]
            codes, starts, ends = forward(numbers)
            x = model.embed(codes)
            responses = model.responses(x)
            where = np.stack([[s + z[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)] for z in responses])  # width, doc, filter
            pooled = np.concatenate([np.take_along_axis(z, w, axis=0) for z, w in zip(responses, where, strict=True)], axis=1)
            active = np.maximum(pooled, 0)
            p = sigmoid(active @ model.out + model.out_bias)
            delta = ((p - y[numbers]) * np.where(y[numbers] == 1, lift, 1.0) / len(numbers)).astype(np.float32)
            # Responses at or below zero let a tenth through, so that filters can come alive.
            back = (delta[:, None] * model.out[None, :] * np.where(pooled > 0, 1.0, 0.1)).astype(np.float32)
            grads = []
            touched_codes, touched_grads = [], []
            for f, width in enumerate(WIDTHS):
                g, at = back[:, f * FILTERS : (f + 1) * FILTERS], where[f]
                gw = np.zeros_like(filters[f])
                for j in range(width):
                    gw[j] = np.einsum("dfe,df->ef", x[at + j], g)
                    touched_codes.append(codes[at + j].ravel())
                    touched_grads.append((g[:, :, None] * filters[f][j].T[None]).reshape(-1, DIM))
                grads.append(gw)
            grads += [back[:, f * FILTERS : (f + 1) * FILTERS].sum(axis=0) for f in range(len(WIDTHS))]
            grads.append(active.T @ delta)
            for q, g, s in zip(dense, grads, speed, strict=True):  # AdaGrad
                s += g * g
                q -= rate * g / (np.sqrt(s) + 1e-6)
            gb = float(delta.sum())
            speed_bias += gb * gb
            model.out_bias -= rate * gb / (speed_bias**0.5 + 1e-6)
            at, g = np.concatenate(touched_codes), np.concatenate(touched_grads)
            at, g = at[at != 0], g[at != 0]
            for t, index in enumerate((at & _MASK, (at >> HASH_BITS) & _MASK)):
                unique, back_to = np.unique(index, return_inverse=True)
                total = np.zeros((len(unique), DIM), dtype=np.float32)
                np.add.at(total, back_to, g)
                speed_tables[t][unique] += (total * total).mean(axis=1)
                tables[t][unique] -= rate * 2 * total / (np.sqrt(speed_tables[t][unique])[:, None] + 1e-6)

    # Thresholds: the cut with the fewest weighted errors on rows that training did not see.
    held = np.flatnonzero(valid)
    logits, spoken = np.zeros(len(held)), np.zeros((len(held), len(LANGUAGES)), dtype=np.int64)
    for k in range(0, len(held), 64):
        codes, starts, ends = forward(held[k : k + 64])
        logits[k : k + 64] = model.logit(model.pooled(codes, starts, ends))
        for r, (s, e) in enumerate(zip(starts, ends, strict=True)):
            spoken[k + r] = np.bincount(codes[s:e] >> 2 * HASH_BITS & 7, minlength=8)[: len(LANGUAGES)]
    spoken[:, 0] = 0
    plain = float(np.log(lift))  # where the weighted loss puts even odds
    common = _shrunk(threshold(logits, y[held], plain), plain, y[held])
    tongue = language(spoken)
    model.thresholds[:] = common
    for k in range(1, len(LANGUAGES)):
        own = tongue == k
        model.thresholds[k] = _shrunk(threshold(logits[own], y[held][own], common), common, y[held][own])
    return model


def _shrunk(found: float, default: float, y: np.ndarray, rows: int = 20) -> float:
    """Between found and default: few rows of the rarer label move a threshold little."""
    n = min(y.sum(), len(y) - y.sum())
    return float((n * found + rows * default) / (n + rows))


def threshold(logits: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle of the range of cuts with the best F1; default where there are not both labels."""
    if not 0 < y.sum() < len(y):
        return default
    order = np.argsort(logits)
    z, hits = logits[order], y[order]
    found = hits[::-1].cumsum()[::-1]  # label 1 at or above each cut
    f1 = 2 * found / (np.arange(len(z), 0, -1) + hits.sum())
    best = int(f1.argmax())
    return float(z[best] if best == 0 else (z[best - 1] + z[best]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5, held_out: int = 0, sample_rows: int = 12_000, sample_bytes: int = 64 << 20) -> ToxicityModel:
    """Train on a bounded sample (sample_rows, sample_bytes) of rows outside the held-out fold."""
    return train(*labelled_sample(docs, labels, label_col, modulus, held_out, sample_rows, sample_bytes))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with the double column out_col (replaced if there), from the whole text alone.

    A null text scores as the empty one. Equal texts score equally. No rows: no rows.
    """
    docs = docs.drop(out_col)
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    source = docs.select(row, as_bytes(text_col).alias("txt"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(word_code)
        for batch in batches:
            got = shared.value.scores(batch.column("txt").to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, pa.float64())], ["row", "score"])

    return source.mapInArrow(run, docs.select(row, F.lit(0.0).alias("score")).schema).select("row.*", F.col("score").alias(out_col))
