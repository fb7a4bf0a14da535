"""Markdown to segments: prose paragraphs, list items, headings and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seg_no, kind, text, line_no, is_last): kind is prose, list, heading or table.

    Code fences and stretches between style-exempt comments are left out, as are tables that teach
    (their first two header cells, or a style-teaching comment above them). A heading may be
    underlined. is_last marks the last prose or list segment of a document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(?:```|~~~)")
    marked = rows.withColumn("fence", fence).withColumn("depth", F.sum(F.col("fence").cast("int")).over(doc))
    opened = F.sum(F.when(F.contains("line", F.lit("<!-- style-exempt -->")), 1).when(F.contains("line", F.lit("<!-- /style-exempt -->")), -1).otherwise(0)).over(doc)
    plain = marked.withColumn("exempt", opened > 0).where("not fence and depth % 2 = 0 and not exempt")
    under = F.lead("line").over(doc)
    line = F.trim("line")
    kind = (
        F.when(line == "", "blank")
        .when(line.rlike(r"^<!--.*-->$"), "comment")
        .when(line.rlike(r"^#{1,6}\s"), "heading")
        .when(line.rlike(r"^(?:=+|-{3,})$"), "rule")
        .when(line.rlike(r"^\|"), "table")
        .when(F.coalesce(under.rlike(r"^\s*(?:=+|-{3,})\s*$"), F.lit(False)), "heading")
        .when(line.rlike(r"^(?:[-*+•·○□]|\d+[.)])\s"), "list")
        .otherwise("prose")
    )
    typed = plain.withColumn("kind", kind)
    before = F.lag("kind").over(doc)
    # A line goes on where the same block does: prose after prose or a list item, a table row after one.
    goes_on = ((F.col("kind") == "prose") & before.isin("prose", "list")) | ((F.col("kind") == "table") & (before == "table"))
    blocks = typed.withColumn("block", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(doc))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t"))))
    made = blocks.groupBy("doc_id", "block").agg(
        F.min_by("kind", "line_no").alias("kind"),
        F.min("line_no").alias("line_no"),
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"),
    )
    above = F.lag("text").over(Window.partitionBy("doc_id").orderBy("block"))
    cells = F.transform(F.split(F.split("text", "\n")[0], r"(?<!\\)\|"), lambda c: F.trim(c))
    pair = F.concat_ws("|", F.try_element_at(cells, F.lit(2)), F.try_element_at(cells, F.lit(3)))
    teaches = pair.isin(*("|".join(p) for p in fixed.TEACHING_HEADERS)) | F.coalesce(F.contains(above, F.lit("style-teaching")), F.lit(False))
    kept = made.withColumn("teaches", (F.col("kind") == "table") & teaches).where(F.col("kind").isin("prose", "list", "heading", "table") & ~F.col("teaches"))
    text = F.when(F.col("kind") == "heading", F.regexp_replace("text", r"^#+\s*", "")).when(
        F.col("kind") == "list", F.regexp_replace("text", r"^(?:[-*+•·○□]|\d+[.)])\s+", "")
    ).otherwise(F.col("text"))
    body = F.max(F.when(F.col("kind").isin("prose", "list"), F.col("block"))).over(Window.partitionBy("doc_id"))
    return kept.select(
        "doc_id",
        F.row_number().over(Window.partitionBy("doc_id").orderBy("block")).alias("seg_no"),
        "kind",
        text.alias("text"),
        (F.col("line_no") + 1).alias("line_no"),
        F.coalesce(F.col("block") == body, F.lit(False)).alias("is_last"),
    )
