"""Corpus statistics: distributions, shares, top lists, sequences of sentences and roll-ups.

Numbers stay unrounded doubles; rounding belongs to the reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import textprims as T
from ..functions.endings import length_class
from . import lines as L


def dist(c: Column | str, points: dict[str, float] | None = None) -> list[Column]:
    """n, mean, quantiles (linear interpolation) and max of a column, nulls left out."""
    c = T.col(c)
    points = points or {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    return [
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        *(F.percentile(c, F.lit(p)).alias(name) for name, p in points.items()),
        F.max(c).alias("max"),
    ]


def distribution(df: DataFrame, by: list[str], c: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(*dist(c))


def class_share(df: DataFrame, by: list[str], class_col: str) -> DataFrame:
    """n and percent of each class within its group."""
    n = df.groupBy(*by, class_col).agg(F.count("*").alias("n"))
    return n.withColumn("pct", T.percent(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))


def top_k(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group; ties by value."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def item_stats(items: DataFrame, by: list[str]) -> DataFrame:
    """The statistics of bullet items by group."""
    n = F.col("n_chars_nospace")
    return items.groupBy(*by).agg(
        *dist(n),
        F.avg("n_eojeol").alias("mean_eojeol"),
        T.share(n > 60).alias("pct_over60"),
        T.share(n > 90).alias("pct_over90"),
        T.share(F.col("n_lines") > 2).alias("pct_over2lines"),
        T.share(F.col("has_digit")).alias("pct_digit"),
        F.avg("n_numbers").alias("mean_numbers"),
        T.share(F.col("paren_head")).alias("pct_paren_head"),
        T.share(F.col("connective").isNotNull()).alias("pct_connective"),
    )


def corpus_summary(docs: DataFrame, by: list[str]) -> DataFrame:
    """Second-level statistics over document summaries."""
    sums = {k: F.sum(f"n_L{k}") for k in (1, 2, 3)}
    return docs.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        F.avg("n_items").alias("mean_items"),
        F.percentile("n_items", F.lit(0.5)).alias("median_items"),
        (sums[2] / F.greatest(F.lit(1), sums[1])).alias("l2_per_l1"),
        (sums[3] / F.greatest(F.lit(1), sums[2])).alias("l3_per_l2"),
        F.avg("n_tables").alias("mean_tables"),
        F.avg("n_figures").alias("mean_figures"),
        T.share(F.col("n_L3") > 0).alias("pct_with_l3"),
        T.share((F.col("n_tables") > 0) | (F.col("n_figures") > 0)).alias("pct_with_table_or_figure"),
    )


def title_stats(titles: DataFrame, title_col: str = "title") -> DataFrame:
    t = F.col(title_col)
    main = T.main_title(t)
    return titles.agg(
        *dist(F.length(t)),
        F.avg(F.length(F.trim(main))).alias("main_mean"),
        T.share(main != t).alias("pct_subtitle"),
        T.share(t.rlike("및|과 |와 ")).alias("pct_and"),
        T.share(T.has_digit(t)).alias("pct_digit"),
    )


def english_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Words, sentences, long words, clarity index and passives of each document.

    All by array functions on the row: no shuffle, one pass over the text.
    """
    base = docs.select(*keep, F.col(text_col).alias("_t"), T.en_sentences(text_col).alias("_s"), T.en_words(text_col).alias("_w"))
    counts = base.withColumns({
        "_c": F.transform("_s", lambda s: F.regexp_count(s, F.lit(fixed.EN_WORD))),
        "n_long": T.long_word_count(F.array_join("_w", " ")),
        "n_words": F.size("_w"),
        "n_sentences": F.size("_s"),
    })
    total = F.aggregate("_c", F.lit(0), lambda a, x: a + x)
    mean = F.coalesce(total / F.nullif(F.col("n_sentences"), F.lit(0)), F.lit(0.0))
    words = F.nullif(F.col("n_words"), F.lit(0))
    return counts.select(
        *keep,
        "n_words",
        "n_sentences",
        mean.alias("words_per_sentence"),
        T.percent(F.size(F.filter("_c", lambda x: x > 25)), F.col("n_sentences")).alias("pct_over25"),
        (F.lit(100.0) * F.col("n_long") / words).alias("pct_long_words"),
        (mean + F.coalesce(F.lit(100.0) * F.col("n_long") / words, F.lit(0.0))).alias("clarity_index"),
        (F.lit(100.0) * T.passive_count("_t") / words).alias("passive_per_100"),
    )


def paragraph_stats(docs: DataFrame, by: list[str], least_words: int = 25, text_col: str = "text") -> DataFrame:
    """Paragraphs of enough words and the distribution of their sentences."""
    paras = L.paragraphs(docs.select(*by, text_col), text_col).where(T.en_word_count("paragraph") >= least_words)
    return paras.withColumn("s", F.size(T.en_sentences("paragraph"))).groupBy(*by).agg(*dist("s"))


def sentence_rows(docs: DataFrame, keep: list[str], text_col: str = "text", language: str = "en") -> DataFrame:
    """(…keep, para_no, sent_no, sentence, len): sentences with their place."""
    paras = L.paragraphs(docs.select(*keep, text_col), text_col)
    sents = L.sentences(paras, "paragraph", language)
    return sents.withColumn("len", F.length("sentence"))


def length_profile(sents: DataFrame, by: list[str]) -> DataFrame:
    """Sentence length: distribution, deviation, shares of short and long ones."""
    n = F.col("len")
    return sents.groupBy(*by).agg(
        *dist(n, {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}),
        F.min(n).alias("min"),
        F.stddev_samp(n).alias("sd"),
        T.share(n <= 35).alias("pct_le35"),
        T.share(n.between(36, 70)).alias("pct_36_70"),
        T.share(n > 70).alias("pct_gt70"),
        T.share(n > 100).alias("pct_gt100"),
    )


def paragraph_lengths(docs: DataFrame, keep: list[str], text_col: str = "text", language: str = "en") -> DataFrame:
    """(…keep, para_no, lens): the lengths of the sentences of each paragraph that has any.

    A paragraph comes from one row, so sequences of its sentences are array functions: no shuffle.
    """
    split = T.en_sentences("paragraph") if language == "en" else T.ko_sentences("paragraph")
    paras = L.paragraphs(docs.select(*keep, text_col), text_col)
    return paras.select(*keep, "para_no", F.transform(split, F.length).alias("lens")).where(F.size("lens") > 0)


def _neighbours(values: Column, pair) -> Column:
    """pair(value, next value) of each two neighbours of an array."""
    n = F.size(values) - 1
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), pair)


def length_transitions(paras: DataFrame, by: list[str]) -> DataFrame:
    """Shares of the steps between the length classes of neighbouring sentences of a paragraph."""
    steps = _neighbours(F.col("lens"), lambda a, b: F.concat(length_class(a), length_class(b)))
    return class_share(paras.select(*by, F.explode(steps).alias("step")), by, "step")


def rhythm(paras: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The most frequent patterns of length classes of whole paragraphs."""
    pattern = F.array_join(F.transform("lens", length_class), "")
    return top_k(paras.select(*by, pattern.alias("pattern")), by, "pattern", k)


def after_long(paras: DataFrame, by: list[str], long: int = 90, short: int = 40) -> DataFrame:
    """Length of the sentence that follows a long one."""
    after = F.filter(_neighbours(F.col("lens"), lambda a, b: F.when(a >= long, b)), lambda n: n.isNotNull())
    rows = paras.select(*by, F.explode(after).alias("len"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("len").alias("mean"), T.share(F.col("len") <= short).alias("pct_short"))


def first_last(paras: DataFrame, by: list[str]) -> DataFrame:
    """Mean length of the first and of the last sentence of paragraphs."""
    return paras.groupBy(*by).agg(
        F.avg(F.element_at("lens", 1)).alias("first_mean"), F.avg(F.element_at("lens", -1)).alias("last_mean"), F.count("*").alias("n_paragraphs")
    )


def consecutive_short(paras: DataFrame, by: list[str], most: int = 30) -> DataFrame:
    """How often a sentence of at most so many characters follows another one in its paragraph."""
    both = F.size(F.filter(_neighbours(F.col("lens"), lambda a, b: (a <= most) & (b <= most)), lambda x: x))
    return paras.groupBy(*by).agg(F.sum(both).alias("n"))


def comma_stats(sents: DataFrame, by: list[str]) -> DataFrame:
    commas = F.regexp_count("sentence", F.lit(","))
    return sents.withColumn("commas", commas).groupBy(*by).agg(
        (F.sum("commas") / F.count("*")).alias("commas_per_sent"),
        T.share(F.col("commas") == 0).alias("pct_no_comma"),
        T.share(F.col("commas") >= 2).alias("pct_two_commas"),
    )


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """(…keys, run_start, run_length): stretches of neighbouring rows for which a flag holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_b", F.sum((~F.col("_f")).cast("int")).over(w))
    return marked.where("_f").groupBy(*keys, "_b").agg(F.min(order).alias("run_start"), F.count("*").alias("run_length")).drop("_b")


def consecutive(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Number of rows whose neighbour before them has the flag as well, by keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    both = f.withColumn("_p", F.coalesce(F.lag("_f").over(w), F.lit(False)))
    return both.groupBy(*keys).agg(F.count_if(F.col("_f") & F.col("_p")).alias("n"))


def lexicon_counts(docs: DataFrame, terms: dict[str, str], text_col: str = "text") -> DataFrame:
    """(term, n): uses of each term in all documents, one pass; terms maps a name to a pattern.

    The patterns are literals of the plan, so each is compiled once.
    """
    sums = docs.agg(*(F.sum(F.regexp_count(F.col(text_col), F.lit(p))).alias(f"t{k}") for k, p in enumerate(terms.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("term"), F.coalesce(F.col(f"t{k}"), F.lit(0)).alias("n")) for k, name in enumerate(terms)))
    return sums.select(F.inline(pairs))


def rollup_stats(sents: DataFrame, slug: str) -> DataFrame:
    """A row for each slug and one, with a null slug, for the corpus."""
    return sents.rollup(slug).agg(F.count("*").alias("n_sentences"), F.sum("len").alias("chars"), F.avg("len").alias("mean_len"))


def next_bound(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """df with the row's end: one before the next row's start, the group's last open."""
    return df.withColumn(end, F.lead(start).over(Window.partitionBy(*by).orderBy(start)) - 1)
