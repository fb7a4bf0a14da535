"""Bullet items: the item parser as windows, the checker's items, document summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import textprims as T
from ..functions.endings import ending


def _level(line: Column, dialect: str) -> tuple[Column, Column]:
    """(level, body) of a bullet line, null level for others."""
    level, body = F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, pattern in sorted(fixed.BULLETS[dialect].items(), reverse=True):
        hit = line.rlike(pattern)
        level = F.when(hit, n).otherwise(level)
        body = F.when(hit, F.trim(F.regexp_replace(line, pattern, ""))).otherwise(body)
    return level, body


def classified_lines(lines: DataFrame, dialect: str = "nabo") -> DataFrame:
    """lines with kind (BLANK, BULLET, BREAK, HEAD, TEXT), level, body, is_table and is_figure."""
    line = F.col("line")
    level, body = _level(line, dialect)
    breaks = (
        line.rlike(fixed.CAPTION) | line.rlike(fixed.FOOTNOTE) | line.rlike(fixed.NOTE) | line.rlike(fixed.PAGE_MARK)
        | line.rlike(fixed.NUMERIC_LINE) | line.isin(*fixed.TABLE_HEADS)
    )
    head = F.length(line).between(2, 15) & line.rlike(fixed.HANGUL) & ~line.rlike(r"(?U)\d")
    kind = F.when(line == "", "BLANK").when(level.isNotNull(), "BULLET").when(breaks, "BREAK").when(head, "HEAD").otherwise("TEXT")
    return lines.withColumns({
        "level": level,
        "body": body,
        "kind": kind,
        "is_table": line.startswith("[표"),
        "is_figure": line.startswith("[그림"),
    })


def islands(classified: DataFrame, by: list[str]) -> DataFrame:
    """Adds island and in_item: runs of lines that begin at a bullet, a break or a page start.

    by: columns of the document; pages are columns page and line_no.
    """
    page = Window.partitionBy(*by, "page").orderBy("line_no")
    doc = Window.partitionBy(*by).orderBy("page", "line_no")
    n = F.length("line")
    empty = F.coalesce((F.lag("kind").over(page) == "BULLET") & (F.lag("body").over(page) == ""), F.lit(False))
    closes = F.col("kind").isin("BLANK", "BREAK") | (
        (n < 10) & ((n < 3) | (F.col("kind") == "HEAD")) & ~F.col("after_empty")
    )
    begins = (F.col("kind") == "BULLET") | F.col("closes") | (F.row_number().over(page) == 1)
    return (
        classified.withColumn("after_empty", empty)
        .withColumn("closes", closes)
        .withColumn("island", F.sum(begins.cast("int")).over(doc))
        .withColumn("in_item", F.first("kind").over(Window.partitionBy(*by, "island").orderBy("page", "line_no")) == "BULLET")
    )


def item_columns(text: Column) -> dict[str, Column]:
    """The derived columns of an item."""
    end = ending(text)
    return {
        "n_chars": F.length(text),
        "n_chars_nospace": T.nospace_len(text),
        "n_eojeol": T.eojeol(text),
        "ending_class": end["ending_class"],
        "ending_token": end["ending_token"],
        "has_digit": T.has_digit(text),
        "n_numbers": T.n_numbers(text),
        "paren_head": T.paren_head(text),
        "connective": T.connective(text),
    }


def items(lines: DataFrame, by: list[str], dialect: str = "nabo") -> DataFrame:
    """One row per bullet item of lines (…by, page, line_no, line): level, page, text, n_lines and
    the derived columns. Items without any text are left out."""
    run = islands(classified_lines(lines, dialect), by).where(F.col("in_item"))
    part = F.when(F.col("kind") == "BULLET", F.col("body")).otherwise(F.col("line"))
    grouped = run.withColumn("part", F.nullif(part, F.lit(""))).groupBy(*by, "island").agg(
        F.min("page").alias("page"),
        F.max("level").alias("level"),
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("page", "line_no", "part")))).alias("parts"),
    )
    joined = T.collapsed(F.array_join(F.transform("parts", lambda p: p["part"]), " "))
    out = grouped.where(F.size("parts") > 0).withColumns({"text": joined, "n_lines": F.size("parts")})
    return out.withColumns(item_columns(F.col("text"))).drop("parts").withColumnRenamed("island", "item_no")


def headings(lines: DataFrame, by: list[str], dialect: str = "nabo") -> DataFrame:
    """(…by, heading_no, heading): runs of short heading lines outside items, joined."""
    doc = Window.partitionBy(*by).orderBy("page", "line_no")
    run = islands(classified_lines(lines, dialect), by)
    head = (F.col("kind") == "HEAD") & (~F.col("in_item") | F.col("closes"))
    marked = run.withColumn("head", head).withColumn(
        "start", (F.col("head") & ~(F.coalesce(F.lag("head").over(doc), F.lit(False)) & (F.lag("page").over(doc) == F.col("page")))).cast("int")
    )
    numbered = marked.withColumn("heading_no", F.sum("start").over(doc)).where("head")
    text = F.array_sort(F.collect_list(F.struct("page", "line_no", "line")))
    return numbered.groupBy(*by, "heading_no").agg(F.array_join(F.transform(text, lambda x: x["line"]), " ").alias("heading"))


def doc_summary(lines: DataFrame, by: list[str], dialect: str = "nabo", most_headings: int = 40) -> DataFrame:
    """Counts of items by level, tables, figures and headings, and the first headings, a row a document."""
    counted = items(lines, by, dialect).groupBy(*by).agg(
        F.count("*").alias("n_items"), *(F.count_if(F.col("level") == k).alias(f"n_L{k}") for k in (1, 2, 3))
    )
    marks = classified_lines(lines, dialect).groupBy(*by).agg(
        F.count_if("is_table").alias("n_tables"), F.count_if("is_figure").alias("n_figures"), F.count_distinct("page").alias("pages")
    )
    named = headings(lines, by, dialect).groupBy(*by).agg(
        F.count("*").alias("n_headings_approx"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("heading_no", "heading"))), lambda h: h["heading"]), 1, most_headings).alias("headings_approx"),
    )
    zero = {c: 0 for c in ("n_items", "n_L1", "n_L2", "n_L3", "n_headings_approx")}
    out = marks.join(counted, by, "left").join(named, by, "left").na.fill(zero)
    return out.withColumn("headings_approx", F.coalesce("headings_approx", F.array().cast("array<string>")))


# Items of the checker


def checker_marks(lines: DataFrame) -> DataFrame:
    """lines (doc, line_no, line unstripped) with the parts of bullet lines and the fixed levels."""
    line = T.strip_md(F.regexp_replace("line", r"(?U)\s+$", ""))
    out = lines.withColumn("line", line).withColumns({
        "indent": F.length(F.replace(F.regexp_extract("line", fixed.CHECK_BULLET, 1), F.lit("\t"), F.lit("  "))),
        "sym": F.nullif(F.regexp_extract("line", fixed.CHECK_BULLET, 2), F.lit("")),
        "body": F.trim(F.regexp_extract("line", fixed.CHECK_BULLET, 3)),
    })
    s = F.col("sym")
    level = (
        F.when(s.isin("□", "■", "☐", "▪"), 1)
        .when(s.isin("○", "●", "❍", "ㅇ"), 2)
        .when(s.isin("-", "‑", "–", "—", "·", "•", "・", "◦", "∙"), F.when(F.col("indent") >= 2, 3).otherwise(2))
        .when(s.isin("*", "※"), 4)
    )
    return out.withColumn("fixed_level", level)


def _depths(marks: pd.DataFrame) -> pd.DataFrame:
    """Levels of numbered marks: how many smaller indents are open."""
    marks = marks.sort_values("line_no")
    open_: list[int] = []
    levels = []
    for indent, known in zip(marks["indent"], marks["fixed_level"], strict=True):
        if pd.notna(known):
            levels.append(int(known))
            continue
        while open_ and open_[-1] >= indent:
            open_.pop()
        open_.append(int(indent))
        levels.append(len(open_))
    return marks.assign(level=levels)[["doc_id", "line_no", "level"]]


def checker_items(lines: DataFrame) -> DataFrame:
    """(doc_id, item_no, level, sym, text, line_no, line_end, indent) of all documents at once.

    A line that directly follows an item's last line belongs to it, unless it is a caption, a note
    or a table row. Numbered marks take their level from the open indents of their document; only
    documents with such marks leave the built-in expressions.
    """
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    marked = checker_marks(lines).withColumn("blank", F.trim("line") == "")
    joins = ~F.col("blank") & F.col("sym").isNull() & ~F.trim("line").rlike(fixed.CHECK_STOP)
    # A run is broken by a blank or excluded line; lines of a run belong to the bullet it begins with.
    broken = marked.withColumn("joins", joins).withColumn("run", F.sum((~F.col("joins")).cast("int")).over(doc))
    first = Window.partitionBy("doc_id", "run").orderBy("line_no")
    run = broken.withColumn("opener", F.first("sym").over(first)).where("opener is not null")
    text = F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("sym").isNotNull(), F.col("body")).otherwise(F.trim("line")).alias("t"))))
    found = run.groupBy("doc_id", "run").agg(
        F.min("line_no").alias("line_no"),
        F.max("line_no").alias("line_end"),
        F.max("sym").alias("sym"),
        F.max("indent").alias("indent"),
        F.max("fixed_level").alias("fixed_level"),
        F.trim(F.array_join(F.transform(text, lambda x: x["t"]), " ")).alias("text"),
    )
    needs = found.where("fixed_level is null").select("doc_id").distinct()
    stacked = (
        found.join(needs, "doc_id", "left_semi")
        .select("doc_id", "line_no", "indent", "fixed_level")
        .groupBy("doc_id")
        .applyInPandas(_depths, f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, line_no int, level int")
    )
    return (
        found.join(stacked, ["doc_id", "line_no"], "left")
        .withColumn("level", F.coalesce("fixed_level", "level"))
        .withColumn("item_no", F.row_number().over(doc))
        .select("doc_id", "item_no", "level", "sym", "text", "line_no", "line_end", "indent")
    )


def only_children(found: DataFrame) -> DataFrame:
    """Items of level 1 and 2 with exactly one child before the next item of their level or above."""
    top = found.where("level < 4")
    doc = Window.partitionBy("doc_id").orderBy("item_no").rowsBetween(1, Window.unboundedFollowing)
    ends = {k: F.min(F.when(F.col("level") <= k, F.col("item_no"))).over(doc) for k in (1, 2)}
    bounded = top.withColumns({"end": F.when(F.col("level") == 1, ends[1]).when(F.col("level") == 2, ends[2])})
    # Children are counted by running counts of each level at the item and at its end.
    through = Window.partitionBy("doc_id").orderBy("item_no")
    counts = bounded.withColumns({f"upto{k}": F.count_if(F.col("level") == k).over(through) for k in (2, 3)})
    last = Window.partitionBy("doc_id")
    at_end = counts.withColumns({f"total{k}": F.max(f"upto{k}").over(last) for k in (2, 3)})
    ends_at = at_end.select("doc_id", F.col("item_no").alias("end"), *(F.col(f"upto{k}").alias(f"e{k}") for k in (2, 3)), F.col("level").alias("elevel"))
    joined = at_end.where("level < 3").join(ends_at, ["doc_id", "end"], "left")
    kids = F.when(
        F.col("level") == 1, F.coalesce(F.col("e2") - F.when(F.col("elevel") == 2, 1).otherwise(0), F.col("total2")) - F.col("upto2")
    ).otherwise(F.coalesce(F.col("e3") - F.when(F.col("elevel") == 3, 1).otherwise(0), F.col("total3")) - F.col("upto3"))
    return joined.withColumn("kids", kids).where("kids = 1").select("doc_id", "item_no", "line_no", "level")


