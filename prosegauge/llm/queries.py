"""The registered opN_ queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digests, mixing, neighbours, packing, pii, quality, simhash, substrings, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model, out_col="score")
    return _verdicts(scored, 5, 0)


def _verdicts(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select(
        "doc_id",
        quality.held_out("doc_id", modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.fitted(table(spark, sf_dir, "documents"))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, pii.BASE_KINDS),
        F.sha2(pii.written("base").cast("binary"), 256).alias("base_sha256"),
        pii.written("spans").alias("spans"),
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model, out_col="score")
    return _verdicts(scored, 3, 1)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tested = digests.edit_test(docs, digests.rarity(digests.level_counts(docs)))
    return tested.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        F.col("mix_position").alias("position"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_substrings": op3_substrings,
    "op4_simhash": op4_simhash,
    "op5_neighbours": op5_neighbours,
    "op6_quality": op6_quality,
    "op7_pack": op7_pack,
    "op8_fingerprints": op8_fingerprints,
    "op9_mix": op9_mix,
    "op10_warc": op10_warc,
}
ORACLE: dict[str, str] = {"op3_substrings": substrings.ORACLE, "op9_mix": mixing.ORACLE, "op10_warc": warc.ORACLE}
