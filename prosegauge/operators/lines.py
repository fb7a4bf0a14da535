"""Splitters: documents to pages, lines, paragraphs, sentences and words; one row a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textprims as T

PAGE = "<<<PAGE "


def pages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (…, page, body) of paged text; what stands before the first mark is dropped.

    Of equal page numbers of a text, the last counts.
    """
    rest = [c for c in docs.columns if c != text_col]
    parts = F.slice(F.split(F.col(text_col), PAGE), 2, 1 << 30)
    entries = F.transform(
        parts,
        lambda p, i: F.struct(
            F.trim(F.substring_index(p, ">>>", 1)).try_cast("int").alias("page"),
            i.alias("at"),
            F.regexp_replace(p, r"(?s)^.*?>>>", "").alias("body"),
        ),
    )
    # Entries are bound once; only their numbers are compared with each other.
    bound = docs.select(*rest, entries.alias("_e")).withColumn("_n", F.transform("_e", lambda e: e["page"]))
    last = F.filter("_e", lambda e: ~F.array_contains(F.slice("_n", e["at"] + 2, 1 << 30), e["page"]))
    return bound.select(*rest, F.explode(last).alias("_p")).select(*rest, "_p.page", "_p.body")


def lines(df: DataFrame, text_col: str = "text", keep_blank: bool = True) -> DataFrame:
    """Rows (…, line_no from 1, line), white space at the ends removed."""
    rest = [c for c in df.columns if c != text_col]
    out = df.select(*rest, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line")).withColumns(
        {"line_no": F.col("line_no") + 1, "line": F.regexp_replace("line", r"(?U)^\s+|\s+$", "")}
    )
    return out if keep_blank else out.where("line <> ''")


def paragraphs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (…, para_no from 1, paragraph): stretches between blank lines, empty ones left out."""
    rest = [c for c in df.columns if c != text_col]
    parts = F.filter(F.transform(F.split(F.col(text_col), r"\n[ \t\r]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return df.select(*rest, F.posexplode(parts).alias("para_no", "paragraph")).withColumn("para_no", F.col("para_no") + 1)


def sentences(df: DataFrame, text_col: str = "text", language: str = "en") -> DataFrame:
    """Rows (…, sent_no from 1, sentence) by the English or the Korean rule."""
    rest = [c for c in df.columns if c != text_col]
    split = T.en_sentences(text_col) if language == "en" else T.ko_sentences(text_col)
    return df.select(*rest, F.posexplode(split).alias("sent_no", "sentence")).withColumn("sent_no", F.col("sent_no") + 1)


def words(df: DataFrame, text_col: str = "text") -> DataFrame:
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(T.tokens(text_col)).alias("word_no", "word")).withColumn("word_no", F.col("word_no") + 1)


def toc_titles(lines_: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Titles of a table of contents: (…by, no, title, start_printed).

    A line "12호" opens a title; the lines after it belong to it up to a page number or the next one.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(*order)
    opened = F.regexp_extract("line", r"^(\d{1,3})호$", 1)
    number = F.regexp_extract("line", r"^(\d{1,4})$", 1)
    marked = lines_.where("line <> ''").withColumns(
        {"no": F.last(F.nullif(opened, F.lit("")), ignorenulls=True).over(w), "opens": opened != "", "is_page": number != ""}
    )
    inside = Window.partitionBy(*by, "no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    body = marked.where("no is not null").withColumn("closed", F.coalesce(F.max(F.col("is_page")).over(inside), F.lit(False)))
    text = F.array_sort(F.collect_list(F.when(~F.col("opens") & ~F.col("is_page"), F.struct(*order, "line"))))
    grouped = body.where(~F.col("closed")).groupBy(*by, "no").agg(
        F.array_join(F.transform(text, lambda x: x["line"]), " ").alias("title"),
        F.min(F.when(F.col("is_page"), F.col("line").try_cast("int"))).alias("start_printed"),
    )
    return grouped.withColumns({"no": F.col("no").cast("int"), "title": T.without_controls(T.collapsed("title"))})


def page_ranges(titles: DataFrame, by: list[str], offset: int = 1, last_page: int | None = None) -> DataFrame:
    """titles with first_page and last_page: each ends before the next one begins."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy("no")
    end = F.lead("start_printed").over(w) - 1 + offset
    return titles.withColumns(
        {"first_page": F.col("start_printed") + offset, "last_page": F.coalesce(end, F.lit(last_page).cast("int"))}
    )
