"""Original against rewrite: invented and lost numbers, quotations and marks; overlap of word runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textprims as T

#: What must not be invented, by kind.
TOKENS = {
    "number": r"\d[\d,.]*\d|\d",
    "quote": r"\"[^\"\n]+\"|“[^”\n]+”|「[^」\n]+」|『[^』\n]+』",
    "placeholder": r"\[[^\]\n]*필요\]|\{\{[^}\n]+\}\}",
    "footnote": r"\[\^[^\]\n]+\]",
}
#: Hashes that are held in memory to look runs of words up.
MOST_HASHES = 1_000_000
NEGATIONS = r"(?:지 않|지 못|(?<![가-힣])안 |(?<![가-힣])못 |없|아니)"


def token_rows(df: DataFrame, id_col: str, text_col: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """(id, kind, token, n): how often each token occurs in each text."""
    found = [_tagged(text_col, kind, p) for kind, p in (kinds or TOKENS).items()]
    return df.select(F.col(id_col).alias("id"), F.explode(F.concat(*found)).alias("t")).groupBy("id", "t.kind", "t.token").agg(F.count("*").alias("n"))


def _tagged(text_col: str, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))


def compare(original: DataFrame, result: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, kind, token, n_original, n_result, verdict): verdict is invented or lost.

    A token only in the result is invented and blocks; one that the result has less often is lost
    and is counted only.
    """
    a = token_rows(original, id_col, text_col).withColumnRenamed("n", "n_original")
    b = token_rows(result, id_col, text_col).withColumnRenamed("n", "n_result")
    return verdicts_of(a, b)


def verdicts_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """compare() of counted tokens: a has n_original, b has n_result."""
    both = a.join(b, ["id", "kind", "token"], "full").na.fill(0, ["n_original", "n_result"])
    verdict = F.when(F.col("n_original") == 0, "invented").when(F.col("n_result") < F.col("n_original"), "lost")
    return both.withColumn("verdict", verdict).where("verdict is not null")


def lost_negations(original: DataFrame, result: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    n = F.regexp_count(F.col(text_col), F.lit(NEGATIONS))
    a = original.select(F.col(id_col).alias("id"), n.alias("before"))
    b = result.select(F.col(id_col).alias("id"), n.alias("after"))
    return a.join(b, "id").select("id", "before", "after", F.greatest(F.lit(0), F.col("before") - F.col("after")).alias("lost"))


def missing_quotes(quotes: DataFrame, corpus: DataFrame, quote_col: str = "quote", text_col: str = "text", width: int = 4) -> DataFrame:
    """Quotations that no text of the corpus holds.

    Candidates meet by the hash of their first words, so no quotation is held against every text;
    quotations of fewer words meet by all of them.
    """
    words = T.tokens(quote_col)
    q = quotes.select(F.col(quote_col).alias("quote"), F.least(F.size(words), F.lit(width)).alias("k"), words.alias("w")).where("k > 0")
    keyed = q.select("quote", "k", F.xxhash64(F.array_join(F.slice("w", 1, F.col("k")), " ")).alias("key"))
    grams = F.flatten(F.array(*(_grams(F.col("_w"), F.lit(k)) for k in range(1, width + 1))))
    bound = corpus.select(T.collapsed(text_col).alias("t"), T.tokens(text_col).alias("_w"))
    texts = bound.select("t", F.explode(F.array_distinct(grams)).alias("key"))
    found = keyed.join(texts, "key").where(F.contains("t", T.collapsed("quote"))).select("quote").distinct()
    return q.select("quote").distinct().join(found, "quote", "left_anti")


def _grams(words: Column, k: Column) -> Column:
    n = F.size(words) - k + 1
    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))


def shingles(words: Column, k: int) -> Column:
    """Runs of k words joined by spaces, with repeats."""
    n = F.size(words) - k + 1
    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))


def overlap(texts: DataFrame, examples: DataFrame, text_id: str, example_id: str, k: int = 4, text_col: str = "text") -> DataFrame:
    """(text_id, example_id, n): different shared runs of k words.

    The runs meet by value in a hash join, each once a text and once an example. Where the examples
    have few different runs by count, runs of the texts that no example has, by a hash, never leave
    their task.
    """
    def grams(df: DataFrame, key: str) -> DataFrame:  # words are bound once, not once a run
        bound = df.select(key, T.tokens(text_col).alias("_w"))
        return bound.select(key, F.explode(F.array_distinct(shingles(F.col("_w"), k))).alias("gram"))

    a, b = grams(texts, text_id), grams(examples, example_id)
    hashes = b.select(F.xxhash64("gram").alias("_h")).distinct()
    if hashes.limit(MOST_HASHES + 1).count() <= MOST_HASHES:
        a = a.withColumn("_h", F.xxhash64("gram")).join(F.broadcast(hashes), "_h", "left_semi").drop("_h")
    return a.join(b, "gram").distinct().groupBy(text_id, example_id).agg(F.count("*").alias("n"))


def fixed_regions(segments: DataFrame) -> DataFrame:
    """Tables and quotations of segments, as (doc_id, region)."""
    quotes = F.regexp_extract_all("text", F.lit(TOKENS["quote"]), F.lit(0))
    regions = F.when(F.col("kind") == "table", F.array("text")).otherwise(quotes)
    return segments.select("doc_id", F.explode(regions).alias("region"))


def changed_regions(original: DataFrame, result: DataFrame) -> DataFrame:
    """Fixed regions of the original that the result has not, with repeats."""
    return fixed_regions(original).exceptAll(fixed_regions(result))
