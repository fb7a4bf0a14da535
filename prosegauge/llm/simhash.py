"""SimHash near-duplicates by pivot distance tables.

Fingerprints are 64 bits; two link when at most ``max_bits`` bits differ, and groups are the
connected components of the links.

* *Index*: distances to any references are too alike to index 64-bit fingerprints (half of all random
  pairs differ by no more than 4 in a coordinate), so fingerprints first meet in cells of equal bits.
  They are cut into ``max_bits + t`` blocks; at least t blocks are untouched in any linked pair, so
  pairs meet in a cell of t blocks and no link is lost. t grows with the number of fingerprints, so
  that a cell has CELL_MEMBERS members or fewer on average.
* *Pivot table*: in every cell, the Hamming distances of each member to the REFS reference
  fingerprints are computed once. |d(x, p) - d(y, p)| <= d(x, y), so a pair whose largest coordinate
  difference is above ``max_bits`` is discarded; survivors are verified exactly.

Pairs that are in one group already are passed over, and a cell emits a spanning star, never all
pairs. Cells above ``cell_rows`` are dealt to several tasks as pairs of blocks; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, forget_kept, stored, whole_groups
from .graph import SMALL_ROWS, connected_components, spread_join

SEED = 42
#: Reference fingerprints of the pivot table, and members that a cell has on average at most.
REFS = np.random.default_rng(7).integers(0, 2**64, 32, dtype=np.uint64)
CELL_MEMBERS = 8


def fingerprint(text: bytes | None, words_per_shingle: int = 4) -> int:
    """The SimHash of a text: bit i is set where over half of the shingle hashes have it set."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - words_per_shingle + 1].tolist()
    ends = ends[words_per_shingle - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), 100_000):  # memory stays bounded for very long texts
        part = [one(joined[a:b], SEED) for a, b in zip(starts[k : k + 100_000], ends[k : k + 100_000], strict=True)]
        octets = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", words_per_shingle: int = 4) -> DataFrame:
    """docs (any columns) with its text column replaced by the long column out_col."""
    rest = [c for c in docs.columns if c not in (text_col, out_col)]
    source = docs.select(*(f"`{c}`" for c in rest), as_bytes(text_col).alias("_pg_text"))
    schema = docs.select(*(f"`{c}`" for c in rest)).withColumn(out_col, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            got = [fingerprint(t, words_per_shingle) for t in batch.column("_pg_text").to_pylist()]
            fps = pa.array(np.array(got, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), fps], [*rest, out_col])

    return source.mapInArrow(run, schema)


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances to each reference (rows) of each fingerprint (columns)."""
    return np.bitwise_count(fps[None, :] ^ REFS[:, None]).astype(np.int8)


def untouched_blocks(n: int, max_bits: int) -> int:
    """The number t of blocks that a cell agrees on, for n fingerprints."""
    t = 1
    while t < 6 and n > CELL_MEMBERS << (64 * t // (max_bits + t)):
        t += 1
    return t


def cells(max_bits: int, t: int) -> list[Column]:
    """The keys of the cells of a fingerprint fp: a combination of t blocks, then their bits."""
    edges = [64 * k // (max_bits + t) for k in range(max_bits + t + 1)]
    code = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1).cast("long")) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    keys = []
    for number, blocks in enumerate(combinations(range(max_bits + t), t)):
        key = F.lit(number).cast("long")
        for k in blocks:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(code[k])
        keys.append(key)
    return keys


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of the component of each of n rows under the links a, b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            return label
        for end in (a, b):  # roots move too, so chains shorten quickly
            np.minimum.at(label, label[end], least)
            np.minimum.at(label, end, least)
        while (label[label] != label).any():
            label = label[label]


def spanning_links(group: np.ndarray, fps: np.ndarray, max_bits: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Links (root, member) that span the components of each group of fingerprints, and how many
    pairs were held against the pivot table and how many of them were verified.

    group: equal for the neighbouring rows of a group. side, if given: only rows of different sides,
    or of side -1, are held against each other.
    """
    n = len(fps)
    table = distances(fps)
    label = np.arange(n)
    met = verified = 0
    d, left = 1, np.flatnonzero(group[1:] == group[:-1])
    while len(left):
        open_ = left[label[left] != label[left + d]]
        if side is not None:
            open_ = open_[(side[open_] != side[open_ + d]) | (side[open_] == -1)]
        met += len(open_)
        for row in table:  # the largest coordinate difference decides
            open_ = open_[np.abs(row[open_] - row[open_ + d]) <= max_bits]
            if not len(open_):
                break
        verified += len(open_)
        sure = open_[np.bitwise_count(fps[open_] ^ fps[open_ + d]) <= max_bits]
        if len(sure):
            known = np.flatnonzero(label != np.arange(n))
            label = _labels(n, np.concatenate([known, sure]), np.concatenate([label[known], sure + d]))
        d += 1
        left = left[left + d < n]
        left = left[group[left] == group[left + d]]
    member = np.flatnonzero(label != np.arange(n))
    return fps[label[member]], fps[member], met, verified


def _compared(prints: DataFrame, max_bits: int, cell_rows: int) -> DataFrame:
    """(u, v, met, verified): spanning links, and by task, with null links, the pairs held against the
    pivot table and the verified ones."""
    spark = prints.sparkSession
    shape = "u long, v long, met long, verified long"
    if not 0 <= max_bits <= 12:
        raise ValueError("max_bits must be between 0 and 12")
    if max_bits == 0:
        return spark.createDataFrame([], shape)

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        met = verified = 0
        for rows in whole_groups(batches, ["cell", "pair"]):
            same = (rows["cell"][1:] == rows["cell"][:-1]) & (rows["pair"][1:] == rows["pair"][:-1])
            group = np.concatenate([[0], np.cumsum(~same)])
            u, v, m, k = spanning_links(group, rows["fp"].view(np.uint64), max_bits, rows["side"])
            met, verified = met + m, verified + k
            none = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), none, none], ["u", "v", "met", "verified"])
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([met]), pa.array([verified])], ["u", "v", "met", "verified"])

    each = prints.select("fp").distinct()
    t = untouched_blocks(each.count(), max_bits)
    entered = each.select("fp", F.explode(F.array(*cells(max_bits, t))).alias("cell"))
    crowded = stored(entered.groupBy("cell").count().where("count > 1"), "crowded")
    hot = crowded.where(F.col("count") > cell_rows)
    n_hot = hot.limit(SMALL_ROWS + 1).count()
    if 0 < n_hot <= SMALL_ROWS:
        hot = F.broadcast(hot)
    calm = entered.join(hot, "cell", "left_anti") if n_hot else entered
    dealt = calm.join(crowded.where(F.col("count") <= cell_rows), "cell").select("cell", "fp", F.lit(0).cast("long").alias("pair"), F.lit(-1).cast("long").alias("side"))
    if n_hot:
        # Pairs (i, j) of blocks of a cell, of which each member joins all that hold its own.
        blocks = F.ceil(F.col("count") / F.lit(cell_rows)).cast("long")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        pairs = F.transform(others, lambda o: F.struct((F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own"))).alias("pair"), F.when(o == F.col("own"), -1).otherwise(F.col("own")).cast("long").alias("side")))
        met = entered.join(hot, "cell") if n_hot <= SMALL_ROWS else spread_join(entered, hot, "cell", "fp")
        dealt = dealt.unionByName(met.withColumn("blocks", blocks).withColumn("own", own).select("cell", "fp", F.inline(pairs)))
    return dealt.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "fp").mapInArrow(span, shape)


def links(prints: DataFrame, max_bits: int = 4, cell_rows: int = 20_000) -> DataFrame:
    """(u, v): links between different fingerprints of prints (fp long) that span every component."""
    return _compared(prints, max_bits, cell_rows).where("u is not null").select("u", "v").distinct()


def pair_figures(prints: DataFrame, max_bits: int = 4, cell_rows: int = 20_000) -> tuple[int, int, int]:
    """How many pairs of prints meet in cells, how many the pivot table discards, and how many are verified."""
    met, verified = _compared(prints, max_bits, cell_rows).agg(F.coalesce(F.sum("met"), F.lit(0)), F.coalesce(F.sum("verified"), F.lit(0))).first()
    return met, met - verified, verified


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 4,
    words_per_shingle: int = 4,
) -> DataFrame:
    """One row per row of docs: id_col, ``fp`` (long) and ``component_id``.

    component_id is the smallest id reachable over links of at most max_bits differing bits, the
    document's own included. Null or wordless texts have fingerprint 0 and link like any other.
    Rows with equal ids are separate documents. A null id is never the smallest; a component of
    null ids only has a null component_id. An empty table gives no rows. Other columns of docs
    are not read.
    """
    prints = stored(
        fingerprints(docs.select(F.col(id_col).alias("_pg_id"), F.col(text_col).alias("_pg_txt")), "_pg_txt", "fp", words_per_shingle),
        "simhash",
    )
    each = stored(prints.groupBy("fp").agg(F.min("_pg_id").alias("least")), "prints")
    parts = stored(connected_components(links(each, max_bits)).withColumnRenamed("node", "fp"), "parts")
    labelled = each.join(parts, "fp")  # the groups of several fingerprints
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    grouped = spread_join(labelled.select("fp", "component"), ids, "component", "fp").select("fp", F.col("component_id").alias("_pg_group"))
    by_print = stored(each.join(grouped, "fp", "left").select("fp", F.coalesce("_pg_group", "least").alias("component_id")), "components")
    return spread_join(prints, by_print, "fp", "_pg_id").select(F.col("_pg_id").alias(id_col), "fp", "component_id")


def keep_representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 4,
    words_per_shingle: int = 4,
) -> DataFrame:
    """The rows of docs without near duplicates: one row of each group, that with the smallest id.

    Of rows that share a group's smallest id, that with the smallest hash of the row stays; null
    ids come last. Texts without words are one group. All columns are kept. No rows: no rows.
    """
    names = docs.columns
    hashable = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.withColumns({"_pg_id": F.col(f"`{id_col}`"), "_pg_hash": F.xxhash64(*hashable), "_pg_txt": F.col(f"`{text_col}`")})
    marks = ["_pg_id", "_pg_hash"]
    prints = stored(fingerprints(rows.select(*marks, "_pg_txt"), "_pg_txt", "fp", words_per_shingle), "simhash")
    first = F.min(F.struct(F.col("_pg_id").isNull().alias("last"), "_pg_id", "_pg_hash"))
    each = stored(prints.groupBy("fp").agg(first.alias("first")), "prints")
    parts = connected_components(links(each, max_bits))
    labelled = each.join(parts, each["fp"] == parts["node"], "left").select("first", F.coalesce("component", "fp").alias("part"))
    kept = stored(labelled.groupBy("part").agg(F.min("first").alias("f")).select(*(F.col(f"f.{c}") for c in marks)).distinct(), "kept")
    # One small row a group; the texts meet it by id and row hash.
    chosen = rows.join(kept.withColumnsRenamed({"_pg_id": "_pg_kid", "_pg_hash": "_pg_khash"}), F.col("_pg_id").eqNullSafe(F.col("_pg_kid")) & (F.col("_pg_hash") == F.col("_pg_khash")))
    repeats = prints.groupBy(*marks).count().where("count > 1").join(kept, marks)
    if repeats.limit(1).count() or prints.where("_pg_id is null").limit(1).count():  # rows that are equal throughout
        chosen = chosen.dropDuplicates(["_pg_id", "_pg_hash"])
    return chosen.select(*(f"`{c}`" for c in names))
