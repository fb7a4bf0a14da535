"""Removal of word windows that an earlier document already has, behind a count-min prefilter.

1. Each task counts the hashes of its windows in sketch cells (several rows of cells) and sends
   the cells it touched, at most twice each, as compact runs. Merged by range of cells, they give
   the cells that were hit at least twice: a window that occurs twice always lies in such cells, so
   the estimate loses none. The bitmaps are written to the shared folder.
2. A second pass keeps only windows whose cells all are repeated. Within a task, the least document
   of a window settles all later ones at once, so a window that a third of all documents share
   costs a row a task; only the least document's rows are grouped exactly, on 96 bits, with those
   of other tasks.
3. The windows found to start in a smaller document go back to the documents, which are cut.

The sketch has four cells to a window and row, up to ``max_cells``; beyond that it lets more
single windows through to the exact pass, which still decides alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, as_bytes, new_path, open_store

WORDS = 13
ROWS = 2
#: Bits of the number of cells of a shard of the sketch, which one group of rows fills.
SHARD_BITS = 18
#: log2 of the least number of cells of a row.
LEAST_BITS = 22
#: Windows that a task holds at a time.
HELD = 2_000_000
#: Bytes of text in a group of documents of the last step, and windows in a group of the second.
GROUP_BYTES = 12 << 20
GROUP_WINDOWS = 2_000_000
_ODD = np.random.default_rng(13).integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CELL = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 5)


def window_hashes(words: list[bytes], memo: dict, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of each window of width words, by its start."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(width):
        part = h[k : k + n]
        first += part * _ODD[0, k]
        second += part * _ODD[1, k]
    return first ^ (first >> np.uint64(29)), (second >> np.uint64(32)).astype(np.uint32)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * _CELL[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def packed_cells(cells: np.ndarray) -> bytes:
    """Sorted cells as differences of one byte, 255 standing for one of the four-byte rest."""
    gaps = np.diff(cells, prepend=np.uint32(0))
    small = np.minimum(gaps, 255).astype(np.uint8)
    large = gaps[gaps >= 255].astype("<u4")
    return len(small).to_bytes(4, "little") + small.tobytes() + large.tobytes()


def unpacked_cells(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    gaps = np.frombuffer(data, np.uint8, n, 4).astype(np.uint32)
    gaps[gaps == 255] = np.frombuffer(data, "<u4", -1, 4 + n)
    return np.cumsum(gaps, dtype=np.uint32)


def sketch_bits(windows: int, max_cells: int) -> int:
    """log2 of the cells of a row: four a window, at least LEAST_BITS, at most max_cells."""
    return max(LEAST_BITS, min(math.ceil(math.log2(4 * max(1, windows))), int(math.log2(max_cells))))


def write_sketch(docs: DataFrame, path: str, bits: int, width: int) -> None:
    """Bitmaps of the repeated cells of docs (txt binary), by row and shard, as Parquet at path."""
    low = np.uint32((1 << SHARD_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(word_hash)
        held: list[np.ndarray] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate(held)
            for row in range(ROWS):
                cells = np.sort(cells_of(hashes, row, bits))
                if len(cells) > 2:  # no more than two of a kind are needed
                    cells = cells[np.concatenate([[True, True], cells[2:] != cells[:-2]])]
                shards = cells >> np.uint32(SHARD_BITS)
                cuts = np.searchsorted(shards, np.arange((1 << bits - SHARD_BITS) + 1))
                keys, blobs = [], []
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    keys.append(row << 32 | s)
                    blobs.append(packed_cells(cells[cuts[s] : cuts[s + 1]] & low))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["part", "cells"])

        for batch in batches:
            for text in batch.column("txt"):
                first, _ = window_hashes((text.as_py() or b"").split(), memo, width)
                if len(first):
                    held.append(first)
                    size += len(first)
                if size >= HELD:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SHARD_BITS, dtype=np.uint8)
        for batch in batches:
            for blob in batch.column("cells"):
                cells = unpacked_cells(blob.as_py())
                once = np.concatenate([[True], cells[1:] != cells[:-1]])
                counts[cells[once]] += 1
                counts[cells[~once]] += 1
                np.minimum(counts, 2, out=counts)
        bitmap = np.packbits(counts >= 2, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bitmap], pa.binary())], ["part", "bitmap"])

    parts = docs.mapInArrow(count, "part long, cells binary").groupBy("part")
    parts.applyInArrow(merge, "part long, bitmap binary").write.parquet(path)


_sketches: dict[str, list[np.ndarray]] = {}


def read_sketch(path: str, bits: int) -> list[np.ndarray]:
    """The bitmaps of each row, kept by a worker until it reads another sketch."""
    if path not in _sketches:
        _sketches.clear()
        rows = [np.zeros(1 << bits - 3, dtype=np.uint8) for _ in range(ROWS)]
        store, root = open_store(path)
        step = 1 << SHARD_BITS - 3
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("part-"):
                with store.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(batch_size=16):
                        for part, bitmap in zip(batch.column("part").to_pylist(), batch.column("bitmap"), strict=True):
                            shard = part & 0xFFFFFFFF
                            rows[part >> 32][shard * step : (shard + 1) * step] = np.frombuffer(bitmap.as_py(), np.uint8)
        _sketches[path] = rows
    return _sketches[path]


def repeated(hashes: np.ndarray, sketch: list[np.ndarray], bits: int) -> np.ndarray:
    """The numbers of hashes whose cells all are repeated."""
    keep = np.arange(len(hashes))
    for row, bitmap in enumerate(sketch):
        cells = cells_of(hashes[keep], row, bits)
        keep = keep[(bitmap[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 == 1]
    return keep


def _later(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): rows sorted by window and id, and which of them have a smaller id before."""
    order = np.lexsort((ids, second, first))
    f, s, i = first[order], second[order], ids[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
    least = i[new][np.cumsum(new) - 1]
    return order, i > least


def _reply(ids: np.ndarray, marks: np.ndarray, at: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Window starts to remove, packed by group of documents: ids, text marks and starts in turn."""
    if not len(ids):
        return
    group = group_of(ids, marks, groups)
    order = np.lexsort((at, marks, ids, group))
    ids, marks, at, group = ids[order], marks[order], at[order], group[order]
    cuts = np.searchsorted(group, np.arange(groups + 1))
    keys = np.flatnonzero(np.diff(cuts))
    blobs = [zlib.compress(ids[a:b].tobytes() + marks[a:b].tobytes() + at[a:b].astype("<u4").tobytes(), 1) for a, b in zip(cuts[keys], cuts[keys + 1], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([-1] * len(keys), pa.int64()), pa.array(keys.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "grp", "data"])


def group_of(ids: np.ndarray, marks: np.ndarray, groups: int) -> np.ndarray:
    """The group in which a document meets its replies; by id and text, so copies are dealt out."""
    mixed = (ids.view(np.uint64) * _CELL[0]) ^ marks
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(groups)).astype(np.int64)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WORDS,
    max_cells: int = 1 << 29,
) -> DataFrame:
    """One row per row of docs: id_col (a whole number), n_words, n_removed and kept_text.

    A word goes if a window of ``width`` consecutive words that covers it also starts in a document
    with a smaller id; windows are judged on the input. kept_text is what stays, joined by single
    spaces. Windows repeated within one id, or between rows of equal ids, stay. A null text has no
    words. A row with a null id is kept whole and removes nothing. No rows: no rows. Other columns
    are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("txt"))
    size = texts.agg(F.sum(F.octet_length("txt"))).first()[0] or 0
    bits = sketch_bits(size // 5, max_cells)
    groups = max(1, -(-size // GROUP_BYTES))
    buckets = max(1, -(-size // 5 // 4 // GROUP_WINDOWS))
    path = new_path(docs.sparkSession, "sketch")
    write_sketch(texts.where("id is not null"), path, bits, width)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, memo = read_sketch(path, bits), WordMemo(word_hash)
        held: list[tuple] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            first, second, ids, marks, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order, later = _later(first, second, ids)
            gone = order[later]
            yield from _reply(ids[gone], marks[gone], at[gone], groups)
            kept = order[~later]
            to = (first[kept] % np.uint64(buckets)).astype(np.int64)
            by = kept[np.argsort(to, kind="stable")]
            cuts = np.searchsorted(np.sort(to), np.arange(buckets + 1))
            keys = np.flatnonzero(np.diff(cuts))
            blobs = []
            for k in keys.tolist():
                rows = by[cuts[k] : cuts[k + 1]]
                owners, index = np.unique(np.stack([ids[rows].view(np.uint64), marks[rows]], axis=1), axis=0, return_inverse=True)
                blobs.append(len(rows).to_bytes(4, "little") + len(owners).to_bytes(4, "little") + owners.tobytes() + first[rows].tobytes() + second[rows].tobytes() + index.astype("<u4").tobytes() + at[rows].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array([-1] * len(keys), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "grp", "data"])

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for k, text in enumerate(batch.column("txt")):
                text = text.as_py() or b""
                first, second = window_hashes(text.split(), memo, width)
                at = repeated(first, sketch, bits)
                if len(at):
                    mark = np.uint64(xxhash.xxh64_intdigest(text, 9))
                    held.append((first[at], second[at], np.full(len(at), ids[k], np.int64), np.full(len(at), mark, np.uint64), at.astype(np.uint32)))
                    size += len(at)
                if size >= HELD // 4:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    def settle(table: pa.Table) -> pa.Table:
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for blob in table.column("data"):
            data = blob.as_py()
            n, m = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
            owners = np.frombuffer(data, np.uint64, 2 * m, 8).reshape(m, 2)
            p = 8 + 16 * m
            index = np.frombuffer(data, "<u4", n, p + 12 * n)
            for x, y in zip(got, (np.frombuffer(data, np.uint64, n, p), np.frombuffer(data, np.uint32, n, p + 8 * n), owners[index, 0].view(np.int64), owners[index, 1], np.frombuffer(data, "<u4", n, p + 16 * n)), strict=True):
                x.append(y)
        first, second, ids, marks, at = (np.concatenate(x) for x in got)
        order, later = _later(first, second, ids)
        gone = order[later]
        out = list(_reply(ids[gone], marks[gone], at[gone], groups))
        return pa.Table.from_batches(out, schema=shape)

    shape = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("data", pa.binary())])
    found = texts.where("id is not null").mapInArrow(candidates, "bucket long, grp long, data binary")
    # One pass sends both kinds of rows: those settled by their task, and those to be grouped.
    keyed = found.withColumn("key", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.col("grp")))

    def settle_or_pass(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(["bucket", "grp", "data"])
        return settle(table) if key[0].as_py() >= 0 else table.cast(shape)

    replies = keyed.groupBy("key").applyInArrow(settle_or_pass, "bucket long, grp long, data binary").select("grp", "data")

    def mark_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([xxhash.xxh64_intdigest(t.as_py() or b"", 9) for t in batch.column("txt")], dtype=np.uint64)
            ids = batch.column("id")  # null ids get no replies, so any group will do for them
            spread = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.arange(len(ids)), ids.fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids, batch.column("txt"), pa.array(marks.view(np.int64)), pa.array(group_of(spread, marks, groups))], ["id", "txt", "mark", "grp"])

    def cut(rows: pa.Table, notes: pa.Table) -> pa.Table:
        owners: dict[tuple[int, int], list[np.ndarray]] = {}
        for blob in notes.column("data"):
            data = zlib.decompress(blob.as_py())
            n = len(data) // 20
            ids, marks, at = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, "<u4", n, 16 * n)
            edges = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])) + 1, [n]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                owners.setdefault((int(ids[a]), int(marks[a])), []).append(at[a:b])
        words_of, removed, kept = [], [], []
        for i, t, m in zip(rows.column("id").to_pylist(), rows.column("txt"), rows.column("mark").to_pylist(), strict=True):
            words = (t.as_py() or b"").split()
            starts = owners.get((i, m)) if i is not None else None
            words_of.append(len(words))
            if starts is None:
                removed.append(0)
            else:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, np.concatenate(starts).astype(np.int64), 1)
                np.subtract.at(change, np.concatenate(starts).astype(np.int64) + width, 1)
                stay = np.cumsum(change[:-1]) == 0
                removed.append(len(words) - int(stay.sum()))
                words = [words[k] for k in np.flatnonzero(stay).tolist()]
            kept.append(b" ".join(words))
        text = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table({"id": rows.column("id"), "n_words": pa.array(words_of, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": text})

    marked = texts.mapInArrow(mark_texts, "id long, txt binary, mark long, grp long")
    joined = marked.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(cut, "id long, n_words long, n_removed long, kept_text string")
    return joined.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept_text")


#: DuckDB SQL for the query op3.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT r, i FROM win JOIN least_doc USING (s) WHERE doc_id > m),
cov AS (SELECT DISTINCT r, i + k AS j FROM hit, (SELECT unnest(range(0, 13)) AS k)),
tok AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
         FROM tok ANTI JOIN cov USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
