"""Corpus upkeep: hashes, admission, duplicates, boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import textprims as T
from . import items as I


def verify_hashes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, status): ok, CHANGED, or unlisted where the manifest has no hash. files: (id, content)."""
    own = files.select("id", F.sha2("content", 256).alias("own"), F.length("content").alias("size"))
    listed = manifest.select("id", "sha256")
    status = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("own").eqNullSafe(F.col("sha256")), "ok").otherwise("CHANGED")
    return own.join(listed, "id", "left").select("id", "size", status.alias("status"))


def source_status(manifest: DataFrame, raw_ids: DataFrame) -> DataFrame:
    """What to do with each source: fetch it, extract it, keep it, or fetch it by hand."""
    here = raw_ids.select("id", F.lit(True).alias("here"))
    auto = F.col("access").isin("auto", "auto-referer")
    status = (
        F.when(auto & F.col("here"), "cached")
        .when(auto, "download")
        .when((F.col("access") == "manual") & F.col("here"), "extract")
        .when(F.col("access") == "manual", "by hand")
        .otherwise("none")
    )
    return manifest.join(here, "id", "left").withColumn("status", status).drop("here")


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """The document with the least order_col of each different text; only hashes are grouped.

    Documents meet the chosen ones by hash and order_col, so many copies crowd no task. Rows that
    share the least order_col of a text all stay.
    """
    hashed = docs.withColumn("text_hash", F.sha2(F.col(text_col).cast("binary"), 256))
    first = hashed.groupBy("text_hash").agg(F.min(order_col).alias("_first"), F.count("*").alias("n_copies"))
    chosen = first.withColumnRenamed("text_hash", "_hash")
    same = (F.col("text_hash") == F.col("_hash")) & F.col(order_col).eqNullSafe(F.col("_first"))
    return hashed.join(chosen, same).drop("_first", "_hash")


def admitted(items: DataFrame, least_l1: int = 3, least_items: int = 12, least_nominal: float = 0.8) -> DataFrame:
    """doc_id of documents with enough bullet items that mostly end in nouns. items: checker items."""
    from ..functions.endings import checked_ending

    nominal = checked_ending("text").isin("noun_or_mieum", "paren", "number")
    counts = items.groupBy("doc_id").agg(
        F.count_if(F.col("level") == 1).alias("n_L1"), F.count("*").alias("n_items"), F.avg(nominal.cast("int")).alias("nominal")
    )
    return counts.where((F.col("n_L1") >= least_l1) & (F.col("n_items") >= least_items) & (F.col("nominal") >= least_nominal))


def repeated_lines(docs: DataFrame, least: int = 2, text_col: str = "text") -> DataFrame:
    """(line, n_docs, n): lines that several documents have."""
    lines = docs.select("doc_id", F.explode(F.split(text_col, "\n")).alias("line")).where("trim(line) <> ''")
    per_doc = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("line").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")).where(F.col("n_docs") >= least)


def tail_boilerplate(blocks: DataFrame, depth: int = 3, least: int = 2) -> DataFrame:
    """blocks (doc_id, block_no, text) with from_end and is_boilerplate: repeated at post ends."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("block_no"))
    placed = blocks.withColumn("from_end", F.row_number().over(w) - 1)
    tails = placed.where(F.col("from_end") < depth).groupBy("text").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= least)
    marked = placed.join(tails.select("text", F.lit(True).alias("r")), "text", "left")
    return marked.withColumn("is_boilerplate", F.coalesce("r", F.lit(False)) & (F.col("from_end") < depth)).drop("r")


def corpus_hash(posts: DataFrame, key: str, text_col: str) -> DataFrame:
    """One hash of a corpus: of the sorted lines "key:sha256 of the text"."""
    line = F.concat_ws(":", key, F.sha2(F.col(text_col).cast("binary"), 256))
    # A line a post; corpora of posts are small, and the order makes the hash well defined.
    return posts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("corpus_hash"))


def genre_hint(docs: DataFrame) -> DataFrame:
    """(doc_id, bullet_share, genre): report where bullets carry a text, else blog; between them unsure.

    The limits are this engine's choice.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    marks = I.checker_marks(lines)
    share = marks.groupBy("doc_id").agg(F.avg(F.col("sym").isNotNull().cast("int")).alias("bullet_share"))
    genre = F.when(F.col("bullet_share") >= 0.5, "report").when(F.col("bullet_share") <= 0.2, "blog").otherwise("unsure")
    return share.withColumn("genre", genre)


def without_noise_lines(text: str = "text") -> F.Column:
    """An English brief without what a mirror site adds, up to its closing parts."""
    body = F.split(F.col(text), r"\bDisclaimer\b|\bMetadata\b|Revision History")[0]
    noise = r"EveryCRSReport|Download PDF|link to page|Report Type|Raw Metadata|^\s*(?:HTML|PDF|·)\s*$"
    return F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.regexp_like(x, F.lit(noise))), "\n")


def english_headings(lines: DataFrame, most: int = 14) -> DataFrame:
    """(doc_id, heading_no, heading): short capitalised lines without a full stop."""
    line = F.trim("line")
    n = F.size(T.tokens("line"))
    fits = n.between(2, 8) & ~line.endswith(".") & line.rlike(r"^[A-Z][A-Za-z0-9 ,’'\-:()/]+$") & ~line.rlike(r"\b(?:CRS|Figure|Table|Source|Notes?)\b")
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.where(fits).select("doc_id", no.alias("heading_no"), line.alias("heading")).where(F.col("heading_no") <= most)
