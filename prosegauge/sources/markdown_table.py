"""Markdown tables as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CELL = re.compile(r"(?<!\\)\|")


def table_cells(text: str) -> list[list[str]]:
    """Cells of the table rows of a text, escaped bars restored; separator rows are left out."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line.startswith("|") or re.fullmatch(r"[|:\- ]+", line):
            continue
        cells = [c.strip().replace("\\|", "|") for c in _CELL.split(line.strip())]
        out.append(cells[1:-1] if line.endswith("|") else cells[1:])
    return out


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, cells) of the table rows of Markdown files, read and split by Spark."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    rows = text.where(F.trim("line").startswith("|") & ~F.trim("line").rlike(r"^[|:\- ]+$"))
    cells = F.transform(F.split(F.trim("line"), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    return rows.select("file", "line_no", F.slice(cells, 2, F.size(cells) - 2).alias("cells"))
