"""Packing token ids into training sequences by sum-of-squares online packing.

Documents are cut into windows of the sequence length; what is left at a document's end is a
piece to pack. Each piece goes, as it comes, into the fill level that minimises the sum of the
squared counts of partially filled windows per level, which an array of counts by level tracks.
Documents are dealt by a hash of the id to shards of bounded expected size, each packed by
itself, so nothing gathers in one task; the same rows give the same sequences.

Open windows at the end of a shard are padded to the full length, except those that stand at a
power of two.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_LENGTH, forget_kept, kept_by_worker, sorted_groups, stored

END_ID = 2
#: Letters and marks for which a word's ids are those of the lower-cased letters, then of the marks:
#: letters that composition leaves alone, and marks without the apostrophe, which contractions use.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|*$%&#]*)")
#: Control characters that str.split() takes for white space and the tokenizer does not.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(r"[ \t\n\r]+")
#: Distinct words, and distinct runs of letters, of which a worker remembers the ids; none is long.
MEMO_WORDS = 600_000
#: Characters of text that are looked at together.
SLICE = 1 << 20

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def split_words(text: str) -> list[str]:
    return text.split() if not any(c in text for c in _CONTROLS) else [w for w in _SPACE.split(text) if w]


class WordIds:
    """Ids of white-space separated words, as little-endian 32-bit bytes.

    For tokenizers that drop white space and join no tokens across it: the ids of a text are those
    of its words in order. Words are encoded once while they are remembered; runs of plain letters
    go straight to the tokenizer's model, which is what its other steps would hand them to.
    """

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        self.tokenizer, self.limit = _tokenizer(path), limit
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if chr(c).isalpha()]
        step = self.tokenizer.pre_tokenizer
        self.letters = str.maketrans({c: "".join(p for p, _ in step.pre_tokenize_str(c)) for c in letters})
        probe = "It's plain, WORDS élan!\nnaïve x1 straße"
        whole = np.array(self.tokenizer.encode(probe, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if b"".join(self.of([probe])) != whole:
            raise ValueError("this tokenizer does not encode words independently of each other")

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, new: set[str]) -> None:
        """Remember the ids of words that are not known yet."""
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
        if len(self.cores) > self.limit:
            self.cores.clear()
        cores, words, letters, model = self.cores, self.words, self.letters, self.tokenizer.model.tokenize
        odd = []
        for w in new:
            m = _SIMPLE.fullmatch(w)
            if m is None:
                odd.append(w)
                continue
            core, marks = m.groups()
            core = core.lower()
            ids = cores.get(core)
            if ids is None:
                ids = b"".join([t.id.to_bytes(4, "little") for t in model(core.translate(letters))])
                if len(core) <= MEMO_LENGTH:
                    cores[core] = ids
            if marks:
                tail = cores.get(marks)
                if tail is None:
                    tail = self._encode([marks])[0]
                    if len(marks) <= MEMO_LENGTH:
                        cores[marks] = tail
                ids += tail
            words[w] = ids
        words.update(zip(odd, self._encode(odd), strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what is new in them is learned together."""
        split = [split_words(t) for t in texts]
        new = set().union(*split)
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
        new.difference_update(self.words)
        self.learn(new)
        known = self.words
        found = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:  # so that what is remembered is bounded in bytes too
            if len(w) > MEMO_LENGTH:
                del known[w]
        return found

    def runs(self, text: str) -> Iterator[bytes]:
        """The ids of a long text in runs of bounded size."""
        at = 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):  # end at white space; a longer run without any is taken whole
                space = _SPACE.search(text, end)
                end = space.end() if space else len(text)
            yield self.of([text[at:end]])[0]
            at = end


@kept_by_worker
def _word_ids(path: str) -> WordIds:
    """Kept by a worker from task to task."""
    return WordIds(path)


def pieces_of(runs: Iterable[bytes], length: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: whole windows and the rest, END_ID last."""
    out, start, held, width = [], 0, bytearray(), 4 * length

    def cut(data: bytes) -> None:
        nonlocal start
        out.append((start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4

    for run in runs:
        held += run
        if len(held) >= width:
            whole = len(held) // width * width
            for k in range(0, whole, width):
                cut(bytes(held[k : k + width]))
            del held[:whole]
    held += END_ID.to_bytes(4, "little")
    cut(bytes(held))
    return out


def tokenized(docs: DataFrame, tokenizer_path: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece: ``doc`` (the id) and PIECES."""
    source = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(tokenizer_path)
        for batch in batches:
            texts = batch.column("txt")
            rows: list[tuple] = []
            where: list[int] = []
            waiting: list[tuple[int, str]] = []
            size = 0

            def take(k: int, runs: Iterable[bytes]) -> None:
                got = pieces_of(runs, length)
                total = got[-1][0] + got[-1][1]
                rows.extend((s, n, c, total) for s, n, c in got)
                where.extend([k] * len(got))

            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if len(text) > SLICE:
                    take(k, ids.runs(text))
                else:
                    waiting.append((k, text))
                    size += len(text)
                if size > SLICE or k == batch.num_rows - 1:
                    for (n, _), data in zip(waiting, ids.of([t for _, t in waiting]), strict=True):
                        take(n, (data,))
                    waiting, size = [], 0
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(where)), *columns], ["doc", *PIECES.replace(" long", "").split(", ")])

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"doc {kind}, {PIECES}")


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset, fill of each window) for pieces of the given sizes in their order.

    Placing a piece moves one window from level h to h + size; of the levels that hold a window,
    and of a new window, that with the least resulting sum of squared counts is taken, the fuller
    one of equals. Full windows leave the sum.
    """
    counts = np.zeros(length + 1, dtype=np.int64)
    at: list[list[int]] = [[] for _ in range(length + 1)]
    window = np.zeros(len(sizes), dtype=np.int64)
    offset = np.zeros(len(sizes), dtype=np.int64)
    fills: list[int] = []
    never = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        room = length - s
        # Change of the sum over levels 0..room: a count falls at h and one rises at h + s.
        change = 2 * (counts[s:] - counts[: room + 1]) + 2
        change[counts[: room + 1] == 0] = never
        change[0] = 2 * counts[s] + 1
        if s == length:
            change[0] = 0
        elif counts[room]:
            change[room] = 1 - 2 * counts[room]
        level = room - int(np.argmin(change[::-1]))
        if level == 0:
            number = len(fills)
            fills.append(0)
        else:
            number = at[level].pop()
            counts[level] -= 1
        window[k], offset[k] = number, level
        fills[number] = level + s
        if level + s < length:
            at[level + s].append(number)
            counts[level + s] += 1
    return window, offset, np.array(fills, dtype=np.int64)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 4096,
    shard_docs: int = 16_384,
) -> DataFrame:
    """A row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    sequence_tokens (the padded length of the sequence).

    A document's ids are the tokenizer's without special tokens, then END_ID; a null or empty text
    is END_ID alone. Rows with equal ids are separate documents and null ids are kept. A sequence
    is padded to ``length`` unless it ends at a power of two. Other columns are not read. No rows:
    no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = stored(tokenized(docs, tokenizer_path, length, id_col, text_col), "pieces")
    shards = max(1, -(-pieces.where("start = 0").count() // shard_docs))
    dealt = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)))
        .repartition("shard")
        .sortWithinPartitions("shard", "doc", "doc_tokens", "start", "ids_crc32")
    )
    names = ["doc", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for (shard,), rows in sorted_groups(batches, ["shard"]):
            window, offset, fills = sum_of_squares(rows["length"], length)
            padded = np.where((fills & (fills - 1)) == 0, fills, length)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(rows[n]) for n in names), pa.array((shard << 40) + window), pa.array(offset), pa.array(padded[window])],
                [*names, "sequence_id", "offset", "sequence_tokens"],
            )

    schema = f"doc {kind}, {PIECES}, sequence_id long, offset long, sequence_tokens long"
    return dealt.mapInArrow(run, schema).withColumnRenamed("doc", id_col)
