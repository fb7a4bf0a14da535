"""Labelled samples for the classifiers and the fit of a probability to margins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Pieces of an over-long training text, spread over the whole of it.
PIECES = 16
#: Rows of either label under which the classifiers cannot be fitted.
LEAST_OF_CLASS = 5


def fold(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def fair_share(lengths: np.ndarray, total: int) -> int:
    """The largest share such that the lengths, each cut to it, sum to at most total."""
    left = total
    for k, n in enumerate(np.sort(lengths).tolist()):
        if n * (len(lengths) - k) > left:
            return left // (len(lengths) - k)
        left -= n
    return int(lengths.max(initial=0))


def excerpt(text: bytes, most: int) -> bytes:
    """The text, or of a longer one than ``most`` PIECES that are spread from its start to its end.

    Pieces are joined by spaces; words that a cut goes through are left out where a piece has others.
    """
    if len(text) <= most:
        return text
    size = most // PIECES - 1
    if size < 1:
        return text[:most]
    out = []
    for k in range(PIECES):
        a = (len(text) - size) * k // (PIECES - 1)
        piece = text[a : a + size]
        words = piece.split()
        if a and words and not text[a - 1 : a].isspace() and not piece[:1].isspace():
            words = words[1:]
        if a + size < len(text) and words and not piece[-1:].isspace() and not text[a + size : a + size + 1].isspace():
            words = words[:-1]
        out.append(b" ".join(words) if words else piece)
    return b" ".join(out)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    modulus: int,
    held_out: int,
    rows: int,
    total_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[bytes], np.ndarray]:
    """Texts (UTF-8) and 0/1 labels of at most ``rows`` documents and ``total_bytes`` of text.

    Rows are taken in the order of a hash of the id, never from the held-out fold. Labels other
    than 0 and 1 and null ids are left out; of several labels or texts of an id the least counts.
    No row is left out for its length: where the texts have more than total_bytes together, the
    over-long ones take part with an excerpt of the share that each of them is left.

    Raises where the labelled documents outside the fold have enough of both classes and the sample
    has not.
    """
    valid = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & (fold("i", modulus) != held_out))
        .groupBy("i")
        .agg(F.min("y").alias("y"))
    )
    chosen = valid.orderBy(F.xxhash64("i"), "i").limit(rows)
    texts = (
        docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
        .join(F.broadcast(chosen), "i")  # at most ``rows`` rows of two numbers
        .groupBy("i")
        .agg(F.min("t").alias("t"), F.min("y").alias("y"))
    )
    sample = stored(texts.withColumn("n", F.length("t")), "sample")
    share = fair_share(np.array(sample.select("n").toArrow().column("n").to_pylist(), dtype=np.int64), total_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array([excerpt(t.as_py(), share) for t in batch.column("t")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("i"), short, batch.column("y")], ["i", "t", "y"])

    kept = sample.select("i", "t", "y")
    got = kept.mapInArrow(cut, kept.schema).orderBy(F.xxhash64("i"), "i").select("t", "y").toArrow()
    y = np.array(got.column("y").to_pylist(), dtype=np.int64)
    up = int(y.sum())
    if len(y) and min(up, len(y) - up) < LEAST_OF_CLASS:
        there = valid.join(docs.select(F.col(id_col).alias("i")), "i", "left_semi").agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
        if min(there) >= LEAST_OF_CLASS:
            raise ValueError(f"{label_col}: {there[0]} documents are labelled 0 and {there[1]} are labelled 1, but the sample has {len(y) - up} and {up}; at least {LEAST_OF_CLASS} of each are needed")
    return got.column("t").to_pylist(), y


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of sigmoid(a margin + b), fitted by Newton's method to smoothed targets."""
    up, down = int(y.sum()), int((1 - y).sum())
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, w = p - goal, np.maximum(p * (1 - p), 1e-6)
        ga, gb = (g * margins).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b
        haa, hab, hbb = (w * margins**2).sum() + 1e-3, (w * margins).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db))
        shrink = 1.0 if size <= 5 else 5 / size
        a, b = a - shrink * da, b - shrink * db
        if size < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
