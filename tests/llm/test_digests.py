import hashlib
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from prosegauge.llm import digests


def text_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def brute_level(window):
    classes = [int(digests._CLASS[b]) for b in window]
    parts = [round(65536 * classes.count(c) * math.log2(classes.count(c))) for c in set(classes)]
    return math.floor(Fraction(5 * 32 * 65536 - sum(parts), 32 * 65536) * 20 + Fraction(1, 2))


def brute_print(text, rare):
    """A fingerprint by loops over every window and every run, with Python's whole numbers."""
    mask, out = (1 << 64) - 1, []
    n = len(text) - 31
    if len(text) < 64:
        starts = range(max(len(text) - 7, 1)) if text else ()
        keys = [xxhash.xxh3_64_intdigest(text[k : k + 8]) for k in starts]
    else:
        every = []
        for k in range(n):
            window = text[k : k + 32]
            h = sum(int.from_bytes(window[8 * j : 8 * j + 8], "little") * int(digests._ODD[j]) for j in range(4)) & mask
            h ^= h >> 32
            h = h * int(digests._MIX) & mask
            h ^= h >> 29
            every.append(int(rare[brute_level(window)]) << 57 | h >> 7)
        tops = [max(every[k : k + 64]) for k in range(n - 63)]
        keys = [k for k, g in itertools.groupby(tops) if len(list(g)) >= 16]
        if len(set(keys)) < 8:
            keys = every
    for k in dict.fromkeys(keys):
        k = (k ^ (k >> 31)) * int(digests._MIX) & mask
        out.append(k ^ (k >> 32))
    chain = [0] * max(1, -(-len(out) // 160))
    for k, f in enumerate(out):
        for j in range(5):
            chain[k // 160] |= 1 << (f >> 11 * j & 2047)
    return b"".join(c.to_bytes(256, "little") for c in chain)


def some_ranks():
    return digests.rarity(np.random.default_rng(3).integers(0, 1000, digests.LEVELS))


def odd_texts():
    rng = np.random.default_rng(1)
    plain = [b"", b"a", b"short", b"a" * 300, b"ab" * 400, b"one phrase again and " * 40, text_of(5, 30).encode(), text_of(1, 1500).encode()]
    return plain + [rng.integers(0, top, n).astype(np.uint8).tobytes() for n in (7, 31, 32, 33, 63, 64, 94, 95, 96, 130, 1000) for top in (2, 256)]


def test_levels_by_brute_force():
    for text in (t for t in odd_texts() if len(t) >= 32):
        got = digests.levels(np.frombuffer(text, dtype=np.uint8)).tolist()
        assert got == [brute_level(text[k : k + 32]) for k in range(len(text) - 31)]


@pytest.mark.parametrize("block", [100, 128, 1 << 15])
def test_whole_fingerprints_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(digests, "BLOCK", block)
    rare, texts = some_ranks(), odd_texts()
    got = digests.prints_of(texts, rare)
    assert [p.tobytes() for p in got] == [brute_print(t, rare) for t in texts]
    assert any(len(p) > 1 for p in got)


def test_level_counts_are_of_every_window(spark, monkeypatch):
    texts = [text_of(k, 20 * k + 1) for k in range(12)] + ["", None, "x" * 31]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    expected_ = np.zeros(digests.LEVELS, dtype=np.int64)
    for t in texts:
        data = (t or "").encode()
        for k in range(len(data) - 31):
            expected_[brute_level(data[k : k + 32])] += 1
    assert digests.level_counts(docs).tolist() == expected_.tolist()


def test_rarity_orders_levels():
    assert digests.rarity(np.array([5, 0, 9, 5])).tolist() == [2, 3, 0, 1]


def test_very_long_text_in_bounded_blocks():
    rare, text = some_ranks(), text_of(9, 60_000).encode()
    parts = list(digests.joined([b"x" * 40, text, b"y" * 40]))
    assert max(len(d) for d, _ in parts) <= digests.BLOCK + 31 and len(parts) > 5
    a, b = digests.prints_of([text, text[: len(text) // 3 * 2]], rare)
    assert digests.likeness(a, b) > 0.6


def test_equal_edited_and_other_texts():
    rare = digests.rarity(np.zeros(digests.LEVELS, dtype=np.int64))
    for n in (60, 400, 3000):
        a, b = text_of(n, n), text_of(n + 1, n)
        fa, fb = (digests.fingerprint(t.encode(), rare) for t in (a, b))
        assert digests.likeness(fa, digests.fingerprint(a.encode(), rare)) == 1.0
        near = digests.likeness(fa, digests.fingerprint(digests.edited(a, b).encode(), rare))
        assert near > max(0.3 if n < 100 else 0.45, digests.likeness(fa, fb) + 0.2) and digests.likeness(fa, fb) < 0.2
        assert digests.likeness(fa, fb) == digests.likeness(fb, fa)
    empty = digests.fingerprint(None, rare)
    assert digests.likeness(empty, digests.fingerprint(b"", rare)) == 1.0 and digests.likeness(empty, fa) == 0.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return {(i, hashlib.sha256(digests.edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest(), len(t or "")) for k, (i, t) in enumerate(order)}


@pytest.mark.parametrize("part_bytes", [1 << 20, 700])
def test_next_documents_over_parts(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(digests, "PART_BYTES", part_bytes)
    rows = [(i * 3, None if i % 11 == 0 else text_of(i, i % 30) + " 😀é") for i in range(40)] + [(None, "last of all")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_chars string").repartition(4)
    got = digests.edit_test(docs, digests.rarity(digests.level_counts(docs))).collect()
    assert {(r.doc_id, hashlib.sha256(r.edited_text.encode()).hexdigest(), r.n_chars) for r in got} == expected(rows) and len(got) == len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_one_row_repeats_and_empty(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    rare = digests.rarity(digests.level_counts(one))
    assert digests.edit_test(one, rare).first().edited_text == "abcdab"
    assert digests.edit_test(one.limit(0), rare).count() == 0
    twice = one.unionByName(one).unionByName(one)
    assert [r.near_next for r in digests.edit_test(twice, rare).collect()] == [1.0] * 3
    prints = digests.fingerprints(twice.withColumnRenamed("doc_id", "fingerprint2"), rare).collect()
    assert len({r.fingerprint for r in prints}) == 1


@pytest.mark.parametrize("head", ["the same first words of all texts", "a" * 40, "ab" * 400, "one phrase again and " * 50])
def test_texts_that_share_a_beginning_differ(head):
    rare = digests.rarity(np.zeros(digests.LEVELS, dtype=np.int64))
    for seed in range(40):
        rng = random.Random(seed)
        for n in (3, 8, 20):
            a, b = (head + "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(n)) for _ in range(2))
            fa, fb = (digests.fingerprint(t.encode(), rare) for t in (a, b))
            assert a == b or digests.likeness(fa, fb) < 1


def test_text_inside_repetition_is_seen():
    rare = digests.rarity(np.zeros(digests.LEVELS, dtype=np.int64))
    plain, marked = b"a" * 300, b"a" * 150 + b"xyz" + b"a" * 147
    assert (digests.fingerprint(plain, rare) != digests.fingerprint(marked, rare)).any()
