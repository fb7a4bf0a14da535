import zlib

import numpy as np
import public_tokenizers
import pytest

from prosegauge.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def whole_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 2]


TEXTS = [
    "", "Hello, WORLD!", "it's they'll don't I'M", "a\xa0b c\x0bd\x1ce", "Éôß ÀÉ é ño", "<|endoftext|> x<|startoftext|>y",
    "123 4.5 foo!!! bar*** $$$ | x", "中文字符 한국어 emoji 😀", "İstanbul ǅ ﬁ", "  lead\n\ntail \t", "x" * 300, "a\x85b\u2028c\u3000d ZÜRICH ÿ Ð÷× ª º",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_those_of_the_whole_text(text):
    got = packing.WordIds(PATH).of([text])[0]
    assert np.frombuffer(got, dtype="<u4").tolist() == whole_ids(text)[:-1]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 50)
    text = " ".join(f"word{i}, it's" for i in range(200)) + "y" * 400
    assert np.frombuffer(b"".join(packing.WordIds(PATH, limit=20).runs(text)), dtype="<u4").tolist() == whole_ids(text)[:-1]


def test_sum_of_squares_by_brute_force():
    sizes = np.random.default_rng(1).integers(1, 17, 300)
    window, offset, fills = packing.sum_of_squares(sizes, 16)
    levels: list[int] = []
    for s, w, o in zip(sizes, window, offset):
        def cost(level):
            counts = np.zeros(17)
            for x in levels:
                counts[x] += 1
            if level:
                counts[level] -= 1
            counts[level + s] += 1
            return (counts[1:16] ** 2).sum()
        choices = {0, *(x for x in levels if x + s <= 16)}
        assert cost(o) == min(map(cost, choices))
        assert o == max(c for c in choices if cost(c) == min(map(cost, choices)))
        if o:
            levels.remove(o)
        if o + s < 16:
            levels.append(o + s)
    assert fills.sum() == sizes.sum() and fills.max() <= 16


def test_pack_round_trip(spark):
    texts = TEXTS * 3 + ["word " * 9000, None]
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(texts)] + [(7, TEXTS[7], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = packing.pack(docs, PATH, length=64, shard_docs=8).collect()
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(whole_ids(t or ""))
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id.keys() == want.keys()
    for i, pieces in by_id.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[i]))
        for p in pieces:
            assert any(
                len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
                for ids in want[i]
            )
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64 and pieces[0].sequence_tokens == (at if at & (at - 1) == 0 else 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    again = packing.pack(docs, PATH, length=64, shard_docs=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
