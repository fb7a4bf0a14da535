"""Document fingerprints of improbable features.

Every window of WINDOW bytes of a text, one at each byte, has an entropy over byte classes, rounded
to levels; windows are ranked by how rare their level is in all windows of the whole corpus, of one
level by a hash of their bytes. In each run of RUN neighbouring windows the highest wins, and windows
that win WINS runs on end, or all where fewer than LEAST do, are the features of the text. Features
go, in order and each once, into a chain of Bloom filters of fixed size, a new one after PER_FILTER
features. Two fingerprints compare by the overlap of their filters' bits, normalised so that what
chance alone would share counts as 0.

The entropies of neighbouring windows differ by the byte that leaves and the one that enters, so all
of a text follow from the first one and two counts at each byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

WINDOW = 32
RUN = 64
WINS = 16
LEAST = 8
SHORT = 8
FILTER_BITS = 2048
PER_FILTER = 160
HASHES = 5
LEVELS = 101
#: Windows that are looked at together; memory stays bounded for very long texts.
BLOCK = 1 << 15
#: Classes of bytes: letters without case, digits, white space, marks, bytes of other characters.
_CLASS = np.full(256, 28, dtype=np.uint8)
_CLASS[[*range(65, 91)]] = np.arange(26)
_CLASS[[*range(97, 123)]] = np.arange(26)
_CLASS[[*range(48, 58)]] = 26
_CLASS[[9, 10, 11, 12, 13, 32]] = 27
_CLASS[128:192] = 29
_CLASS[192:] = 30
#: n log2 n in units of 1 / UNIT, and what the n-th occurrence of a class in a window adds to it.
UNIT = 1 << 16
NLOGN = np.rint(UNIT * np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))])).astype(np.int32)
_GAIN = np.diff(NLOGN, prepend=np.int32(0))
#: Odd factors of the hash of a window's four words, and of its mixing.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy, in twentieths of a bit, of the window at each byte of at least WINDOW ones."""
    n = len(data) - WINDOW + 1
    c = np.take(_CLASS, data)
    first, last = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):  # how often a window holds the class of its first, and of its last, byte
        same = np.equal(c[:-k], c[k:]).view(np.uint8)
        np.add(first, same[:n], out=first)
        np.add(last, same[WINDOW - 1 - k :][:n], out=last)
    sums = np.take(_GAIN, last)
    sums[1:] -= np.take(_GAIN, first[:-1])
    sums[0] = NLOGN[np.bincount(c[:WINDOW], minlength=32)].sum()
    np.cumsum(sums, out=sums)
    # (5 - sum / (WINDOW UNIT)) 20 to the nearest whole number; sums count in parts of 2^21.
    return (((5 * WINDOW * UNIT - sums) * 20 + (1 << 20)) >> 21).astype(np.uint8)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the window at each byte."""
    n = len(data) - WINDOW + 1
    word = data.astype(np.uint64)
    for size in (1, 2, 4):  # words of 2, 4 and 8 bytes from each byte on
        word = word[:-size] | (word[size:] << np.uint64(8 * size))
    h = word[:n] * _ODD[0]
    for k in (1, 2, 3):
        h += word[8 * k : 8 * k + n] * _ODD[k]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def joined(texts: Iterable[bytes], overlap: int = WINDOW - 1) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Bytes to look at together, and whose they are: (number of the text, start, length) in turn.

    Short texts are put together; a long one comes alone, in blocks that share ``overlap`` bytes.
    Texts shorter than a window are left out.
    """
    held: list[bytes] = []
    owners: list[tuple[int, int, int]] = []
    size = 0
    for k, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        if held and size + len(text) > BLOCK:
            yield np.frombuffer(b"".join(held), np.uint8), owners
            held, owners, size = [], [], 0
        if len(text) > BLOCK + overlap:
            data = np.frombuffer(text, np.uint8)
            for a in range(0, len(text) - overlap, BLOCK):
                part = data[a : a + BLOCK + overlap]
                yield part, [(k, 0, len(part))]
            continue
        held.append(text)
        owners.append((k, size, len(text)))
        size += len(text)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), owners


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each entropy level occurs in all windows of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            for data, owners in joined(t.as_py() or b"" for t in batch.column("txt")):
                found = levels(data)
                if len(owners) > 1:  # windows of one text only
                    found = np.concatenate([found[a : a + n - WINDOW + 1] for _, a, n in owners])
                counts += np.bincount(found, minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(counts)], ["level", "n"])

    rows = docs.select(as_bytes(text_col).alias("txt")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n")).collect()
    out = np.zeros(LEVELS, dtype=np.int64)
    for level, n in rows:
        out[level] = n
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """The place of each level, 0 for the most frequent one of the corpus; of equals, the lower is rarer."""
    order = np.lexsort((-np.arange(len(counts)), -counts))
    out = np.zeros(len(counts), dtype=np.uint64)
    out[order] = np.arange(len(counts), dtype=np.uint64)
    return out


def window_keys(data: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The rank of the window at each byte: rarity of its level, then its hash."""
    return (rare[levels(data)] << np.uint64(57)) | (window_hashes(data) >> np.uint64(7))


def _stretches(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(top)]])
    return top[cuts[:-1]], np.diff(cuts)


def _winners(texts: list[bytes], rare: np.ndarray) -> list[list[int]]:
    """For each text the keys that win at least WINS runs on end, in their order, each once."""
    stretches: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for data, owners in joined(texts, RUN + WINDOW - 2):
        if len(data) < RUN + WINDOW - 1:
            continue
        top = window_keys(data, rare)
        for k in (1, 2, 4, 8, 16, 32):  # the highest key of each run
            top = np.maximum(top[:-k], top[k:])
        for k, a, n in owners:
            if n >= RUN + WINDOW - 1:
                stretches[k].append(_stretches(top[a : a + n - RUN - WINDOW + 2]))
    out = []
    for parts in stretches:
        if not parts:
            out.append([])
            continue
        value, length = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:  # a stretch may go on in the next block
            new = np.concatenate([[True], value[1:] != value[:-1]])
            value, length = value[new], np.bincount(np.cumsum(new) - 1, length)
        out.append(list(dict.fromkeys(value[length >= WINS].tolist())))
    return out


def _every_window(text: bytes, rare: np.ndarray) -> list[int]:
    found: dict[int, None] = {}
    for data, _ in joined([text]):
        found.update(dict.fromkeys(window_keys(data, rare).tolist()))
    return list(found)


def features(texts: list[bytes], rare: np.ndarray) -> list[np.ndarray]:
    """Hashes of the selected features of each text in their order, each once.

    Of a text shorter than two windows, which an edit would leave no window of, each run of SHORT
    bytes is a feature, or the whole text if it is no longer; the empty text has none.
    """
    out = []
    for text, keys in zip(texts, _winners(texts, rare), strict=True):
        if len(text) < 2 * WINDOW:
            runs = (text[a : a + SHORT] for a in range(max(len(text) - SHORT + 1, 1))) if text else ()
            keys = list(dict.fromkeys(map(xxhash.xxh3_64_intdigest, runs)))
        elif len(keys) < LEAST:
            keys = _every_window(text, rare)
        mixed = np.array(keys, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return out


_SHIFTS = np.arange(HASHES, dtype=np.uint64) * np.uint64(11)


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, a row of bytes each; at least one."""
    chain = max(1, -(-len(hashes) // PER_FILTER))
    bits = np.zeros(chain * FILTER_BITS, dtype=np.uint8)
    places = ((hashes[:, None] >> _SHIFTS) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    places += (np.arange(len(hashes)) // PER_FILTER * FILTER_BITS)[:, None]
    bits[places.ravel()] = 1
    return np.packbits(bits, bitorder="little").reshape(chain, -1)


def prints_of(texts: list[bytes], rare: np.ndarray) -> list[np.ndarray]:
    """The fingerprint of each text; the same whatever the other texts are."""
    return [filters(f) for f in features(texts, rare)]


def fingerprint(text: bytes | None, rare: np.ndarray) -> np.ndarray:
    return prints_of([text or b""], rare)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the mean, over the shorter chain's filters, of the best normalised overlap.

    Equal fingerprints are 1; chains of one length take the mean of both directions. A filter
    without bits is like nothing but itself.
    """
    if len(a) == len(b):
        return 1.0 if (a == b).all() else (_best_overlaps(a, b) + _best_overlaps(b, a)) / 2
    return _best_overlaps(a, b) if len(a) < len(b) else _best_overlaps(b, a)


def _best_overlaps(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = 0.0
    for k in range(len(x)):
        shared = np.bitwise_count(x[k] & y).sum(axis=1, dtype=np.int64)
        most = np.minimum(nx[k], ny)
        chance = nx[k] * ny / FILTER_BITS
        score = np.where(most > chance, (shared - chance) / np.maximum(most - chance, 1e-9), 0.0)
        total += float(np.clip(score, 0, 1).max())
    return total / len(x)


def fingerprints(docs: DataFrame, rare: np.ndarray, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of the whole text as lower-case hex in out_col (replaced if there)."""
    docs = docs.drop(out_col)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [p.tobytes().hex() for p in prints_of([t.as_py() or b"" for t in batch.column("txt")], rare)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, pa.string())], ["row", "fp"])

    schema = docs.select(row, F.lit("").alias("fp")).schema
    return docs.select(row, as_bytes(text_col).alias("txt")).mapInArrow(run, schema).select("row.*", F.col("fp").alias(out_col))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much, or all, of the beginning of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def slices(lengths: np.ndarray, most: int = 1 << 21, rows: int = 500) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes, or one row, and at most ``rows`` rows."""
    a = held = 0
    for k, n in enumerate(lengths.tolist()):
        if k > a and (held + n > most or k - a == rows):
            yield a, k
            a, held = k, 0
        held += n
    if len(lengths):
        yield a, len(lengths)


#: Bytes of text in a part of the order of documents, and the most parts that a stage can plan.
PART_BYTES = 12 << 20
MOST_PARTS = 20_000


def edit_test(docs: DataFrame, rare: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and the next text's.

    Columns: id_col, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is that with the next smaller id, after the last the first; rows of equal
    ids are ordered by a hash of the text, null ids come last, a single document follows itself.
    Null texts are empty. No rows: no rows.

    Documents are dealt to parts by cut points of the id, each part a task, so texts are shuffled
    once; the first document of each part is also sent to the part before it. Beyond MOST_PARTS the
    parts grow; a part is sorted on disk and read as a stream.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("txt"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("key"),
    )
    size = rows.agg(F.sum(F.octet_length("txt"))).first()[0]
    if size is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    parts = min(MOST_PARTS, max(1, -(-size // PART_BYTES)))
    cuts = np.array(sorted(set(rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0])) if parts > 1 else [], dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, key.to_numpy()))

    dealt = rows.withColumns({"part": part_of("key"), "tie": F.xxhash64("txt")})
    heads = dealt.groupBy("part").agg(F.max(F.struct("key", F.bitwise_not("tie").alias("tie"))).alias("head")).collect()
    used = sorted(r.part for r in heads)
    before = {p: used[k - 1] for k, p in enumerate(used)}
    firsts = docs.sparkSession.createDataFrame([(r.head.key, ~r.head.tie, before[r.part]) for r in heads], "key long, tie long, to int")
    sent = dealt.join(F.broadcast(firsts), ["key", "tie"]).groupBy("to").agg(F.min(F.struct("key", "tie", "txt")).alias("h"))
    last = sent.select(F.lit(None).cast("long").alias("id"), F.col("h.txt").alias("txt"), F.col("h.key").alias("key"), F.col("to").alias("part"), F.col("h.tie").alias("tie"), F.lit(1).alias("is_next"))
    ordered = (
        dealt.withColumn("is_next", F.lit(0))
        .unionByName(last)
        .repartitionById(parts, "part")
        .sortWithinPartitions("part", "is_next", F.desc("key"), "tie")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, np.ndarray] | None = None
        for batch in batches:
            every = batch.column("txt")
            for a, b in slices(pc.binary_length(every).to_numpy()):
                ids, texts = batch.column("id")[a:b].to_pylist(), every[a:b].to_pylist()
                nexts = batch.column("is_next")[a:b].to_pylist()
                prints = prints_of([t.encode() for t in texts], rare)
                pairs = []
                for i, text, print_, last in zip(ids, texts, prints, nexts, strict=True):
                    if held is not None:
                        pairs.append((*held, edited(held[1], text), print_))
                    held = None if last else (i, text, print_)
                others = prints_of([p[3].encode() for p in pairs], rare)
                out = [
                    (i, len(own), changed, mine.tobytes().hex(), other.tobytes().hex(), likeness(mine, other), likeness(mine, following))
                    for (i, own, mine, changed, following), other in zip(pairs, others, strict=True)
                ]
                if out:
                    yield _batch(out)

    schema = "id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("id", "txt", "is_next").mapInArrow(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
