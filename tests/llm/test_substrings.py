import random

import numpy as np
import pytest

from prosegauge.llm import substrings


def brute(rows, width):
    """(id, n_words, n_removed, kept) of each row."""
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - width + 1):
            if i is not None:
                key = tuple(words[k : k + width])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - width + 1):
            if i is not None and first[tuple(words[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    passages = [[f"p{j}_{k}" for k in range(rng.randrange(3, 40))] for j in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))]
        rows.append((rng.choice([i, i, 5, None]) if i % 7 == 0 else i, None if i % 19 == 0 else rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(3, "same " * 60), (90, "same " * 60), (91, "same " * 13 + "é ü\xa0x"), rows[4], (200, rows[4][1])]
    return rows


@pytest.mark.parametrize("seed,width,small", [(1, 13, False), (2, 13, True), (3, 4, True)])
def test_equals_brute_force(spark, monkeypatch, seed, width, small):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, mark int").repartition(5)
    options = {}
    if small:
        monkeypatch.setattr(substrings, "GROUP_BYTES", 3000)
        monkeypatch.setattr(substrings, "GROUP_WINDOWS", 500)
        options["max_cells"] = 1 << substrings.SHARD_BITS
    got = substrings.remove_repeats(frame, width=width, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows, width)


def test_copies_of_one_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 2000)
    text = " ".join(f"w{k}" for k in range(20))
    rows = [*((i, text) for i in range(200)), *((None, text) for _ in range(60)), *((i, None) for i in range(200, 260))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(frame).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows, 13)
    ids = np.arange(10_000)
    sizes = np.bincount(substrings.group_of(ids, np.full(10_000, 77, np.uint64), 16), minlength=16)
    assert sizes.min() > 400 and sizes.max() < 900


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.n_words for r in substrings.remove_repeats(blank).collect()] == [0, 0]


def test_cells_survive_packing():
    cells = np.sort(np.random.default_rng(2).integers(0, 1 << 22, 5000).astype(np.uint32))
    cells = np.sort(np.concatenate([cells, cells[:50], np.array([0, 0], np.uint32)]))
    assert (substrings.unpacked_cells(substrings.packed_cells(cells)) == cells).all()


def test_sketch_never_loses_a_repeat():
    hashes = np.random.default_rng(3).integers(0, 2**64, 4000, dtype=np.uint64)
    twice = np.concatenate([hashes, hashes[:500]])
    bits = 12
    bitmaps = []
    for row in range(substrings.ROWS):
        counts = np.bincount(substrings.cells_of(twice, row, bits), minlength=1 << bits)
        bitmaps.append(np.packbits(counts >= 2, bitorder="little"))
    kept = substrings.repeated(hashes, bitmaps, bits)
    assert set(range(500)) <= set(kept.tolist())
