"""Readers and writers: paged text, manifests, posts, sample tables, HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L

ITEM_SCHEMA = (
    "corpus string, doc string, level int, page int, text string, n_chars int, n_chars_nospace int, n_eojeol int, n_lines int, "
    "ending_class string, ending_token string, has_digit boolean, n_numbers int, paren_head boolean, connective string"
)
SOURCE_SCHEMA = (
    "id string, title string, org string, year string, pages string, access string, landing_url string, alt_urls array<string>, "
    "download_url string, raw_file string, text_file string, manual string, used_for string"
)
SAMPLE_SCHEMA = (
    "sample_id string, source_id string, pdf_page int, block_indices string, unit_within_group int, unit_type string, "
    "characters_with_spaces int, characters_without_spaces int, space_tokens int, text_sha256 string, group_bbox string"
)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))


def paged_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, body)."""
    return L.pages(whole_texts(spark, path))


def items_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM_SCHEMA).json(path)


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row a source; page numbers come as an array, other notes on pages as null."""
    doc = spark.read.schema(f"sources array<struct<{SOURCE_SCHEMA.replace(' string', ':string').replace(' array', ':array')}>>").option("multiLine", True).json(path)
    return doc.select(F.inline("sources")).withColumn("page_list", F.from_json("pages", "array<int>"))


def hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, sha256, bytes) of a JSON object by id."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string,struct<sha256:string,bytes:bigint>>")).alias("id", "v"))
    return parsed.select("id", "v.sha256", "v.bytes")


def sample_table(spark: SparkSession, path: str) -> DataFrame:
    """The sample metrics CSV; a byte order mark before the header is skipped with it."""
    rows = spark.read.schema(SAMPLE_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)
    box = F.transform(F.split(F.regexp_replace("group_bbox", r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    return rows.withColumn("bbox", box)


def blog_posts(spark: SparkSession, path: str) -> DataFrame:
    """(slug, title, date, category, excerpt, body) of Markdown posts."""
    t = F.col("text")
    meta = F.regexp_extract(t, r"(?m)^<!--\s*(.*?)\s*-->", 1)
    parts = F.transform(F.split(meta, r"\|"), lambda p: F.trim(p))
    return whole_texts(spark, path).select(
        F.coalesce(F.try_element_at(parts, F.lit(3)), F.regexp_replace("doc", r"\.md$", "")).alias("slug"),
        F.trim(F.regexp_extract(t, r"(?m)^#\s+(.*)$", 1)).alias("title"),
        F.try_to_date(F.try_element_at(parts, F.lit(1))).alias("date"),
        F.try_element_at(parts, F.lit(2)).alias("category"),
        F.trim(F.regexp_extract(t, r"(?m)^>\s+(.*)$", 1)).alias("excerpt"),
        F.regexp_replace(F.regexp_replace(t, r"(?m)^(?:#\s.*|<!--.*-->|>\s.*)$", ""), r"^\s+|\s+$", "").alias("body"),
    )


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of a sitemap file."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


_BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 td th tr br section article blockquote pre".split())
_HIDDEN = frozenset("script style noscript template nav footer header form".split())


class _Text(HTMLParser):
    """Visible text of a page by blocks: (kind, text)."""

    def __init__(self, noise: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.noise, self.hidden, self.kind, self.now = noise, [], "p", []
        self.blocks: list[tuple[str, str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append((self.kind, text))
        self.now = []

    def handle_starttag(self, tag, attrs):
        classes = set((dict(attrs).get("class") or "").split())
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden.append(tag)
        elif tag in _HIDDEN or classes & self.noise:
            self.flush()
            self.hidden = [tag]
        if tag in _BLOCKS and not self.hidden:
            self.flush()
            self.kind = tag

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden.pop()
        elif tag in _BLOCKS:
            self.flush()
            self.kind = "p"

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)


def html_blocks(html: str, noise: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    parser = _Text(frozenset(noise))
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def html_segments(pages: DataFrame, id_col: str, html_col: str, noise: tuple[str, ...] = ()) -> DataFrame:
    """(id, seg_no, tag, text): blocks of visible text of each page, in Arrow batches.

    noise: class names whose elements are left out.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, tag, text) for i, h in zip(batch["id"], batch["html"], strict=True) for n, (tag, text) in enumerate(html_blocks(h or "", noise), 1)]
            yield pd.DataFrame(rows, columns=["id", "seg_no", "tag", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, seg_no int, tag string, text string").withColumnRenamed("id", id_col)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_report(df: DataFrame, most_rows: int = 200, digits: int = 1) -> str:
    """A small result as a Markdown table, rounded for reading."""
    def shown(v) -> str:
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(map(shown, r)) + " |" for r in df.limit(most_rows).collect())])


