"""The report checker: findings of every document at once, as (doc_id, severity, rule_id, line_no, value, term)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import needles as N
from ..functions import textprims as T
from ..functions.endings import checked_ending
from . import items as I

SCHEMA = ("doc_id", "severity", "rule_id", "line_no", "value", "term")


def _rows(df: DataFrame, severity: str, rule: str, line: Column | None = None, value: Column | None = None, term: Column | None = None) -> DataFrame:
    return df.select(
        "doc_id",
        F.lit(severity).alias("severity"),
        F.lit(rule).alias("rule_id"),
        (line if line is not None else F.lit(None)).cast("int").alias("line_no"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (term if term is not None else F.lit(None)).cast("string").alias("term"),
    )


def _one(severity: str, rule: str, when: Column, line: Column | None = None, value: Column | None = None) -> Column:
    """A finding where a condition holds, else null."""
    none = F.lit(None)
    return F.when(when, F.struct(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"), (none if line is None else line).cast("int").alias("line_no"),
        (none if value is None else value).cast("double").alias("value"), none.cast("string").alias("term"),
    ))


def _inlined(df: DataFrame, *found: Column) -> DataFrame:
    """The findings of each row, in one pass over df."""
    return df.select("doc_id", F.inline(F.array_compact(F.array(*found))))


def raw_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines as they are."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def head_checks(docs: DataFrame) -> DataFrame:
    """Title (H1) and opening lines (H2); documents without a line that is not blank are left out."""
    full = docs.select("doc_id", F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 4).alias("first")).where(F.size("first") > 0)
    # get(), since the title may be evaluated ahead of the filter on size.
    head = full.select(
        "doc_id",
        F.trim(T.strip_md(F.get("first", F.lit(0)))).alias("title"),
        F.array_join(F.transform(F.slice("first", 2, 3), T.strip_md), " ").alias("opening"),
        F.size("first").alias("lines"),
    )
    titled = F.col("title") != ""
    long = F.length(F.replace("title", F.lit(" "), F.lit("")))
    ends = F.col("title").rlike(f"(?:{T.literal_pattern(fixed.TITLE_TAILS)})$")
    vague = F.col("title").rlike("(?:동향|현황)$") & (F.length("title") < 14)
    concludes = F.col("opening").rlike(T.literal_pattern(fixed.CONCLUSIONS)) | T.has_digit("opening")
    return _inlined(
        head,
        _one("hard", "H1a", titled & (long > 40), value=long),
        _one("soft", "H1b", titled & ~ends),
        _one("soft", "H1c", titled & vague),
        _one("hard", "H2", (F.col("lines") > 1) & ~concludes),
    )


def item_checks(lines: DataFrame) -> DataFrame:
    """Bullet items: depth, length, endings, evidence, connectives, only children (H3 to H8).

    One pass over the items of a document in their order; what concerns the whole document is
    reported with its first item.
    """
    level, no = F.col("level"), F.col("item_no")
    doc, through = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("item_no")
    top = level < 4
    starts = T.connective("text", fixed.CHECK_CONNECTIVES).isNotNull().cast("int")
    placed = I.checker_items(lines).withColumns({
        "g1": F.count_if(level == 1).over(through),  # a level's children come before the next item of it or above
        "g2": F.count_if(level <= 2).over(through),
        "n": T.nospace_len(T.unquoted("text")),
        "depth": F.max(F.when(top, level)).over(doc),
        "n_evidence": F.count_if(level.isin(2, 3)).over(doc),
        "evidence": F.avg(F.when(level.isin(2, 3), T.has_digit("text").cast("int"))).over(doc),
        "n_top": F.count_if(top).over(doc),
        "connected": F.avg(F.when(top, starts)).over(doc),
    }).withColumns({
        "kids1": F.count_if(level == 2).over(Window.partitionBy("doc_id", "g1")),
        "kids2": F.count_if(level == 3).over(Window.partitionBy("doc_id", "g2")),
    })
    n, line = F.col("n"), F.col("line_no")
    only = ((level == 1) & (F.col("kids1") == 1)) | ((level == 2) & (F.col("kids2") == 1))
    found = (
        _one("hard", "H3", (no == 1) & (F.col("depth") > 3), value=F.col("depth")),
        _one("hard", "H4a", top & (n > 120), line, n),
        _one("soft", "H4b", top & n.between(91, 120), line, n),
        _one("hard", "H5", top & (checked_ending("text") == "sentence"), line),
        _one("soft", "H6", (no == 1) & (F.col("n_evidence") >= 4) & (F.col("evidence") < 0.5), value=F.col("evidence")),
        _one("soft", "H7", (no == 1) & (F.col("n_top") >= 5) & (F.col("connected") > 0.15), value=F.col("connected")),
        _one("soft", "H8", only, line),
    )
    # A document without a bullet has no items.
    bare = I.checker_marks(lines).groupBy("doc_id").agg(F.bool_or(F.col("sym").isNotNull()).alias("any")).where("not any")
    return _inlined(placed, *found).unionByName(_rows(bare, "info", "no_items"))


def prose_checks(docs: DataFrame) -> DataFrame:
    """Sentences of prose (P0 to P3)."""
    sents = docs.select("doc_id", F.explode(T.ko_sentences("text")).alias("s")).withColumns({"e": F.size(T.tokens("s")), "n": T.nospace_len("s")})
    stats = sents.groupBy("doc_id").agg(F.avg("n").alias("chars"), F.avg("e").alias("eojeol"))
    passive = T.double_passive_count("text")
    return (
        _inlined(stats, _one("info", "P0", F.lit(True), value=F.col("chars")), _one("soft", "P1", F.col("eojeol") > 20, value=F.col("eojeol")))
        .unionByName(_rows(sents.where("e > 35"), "hard", "P2", value=F.col("e")))
        .unionByName(_rows(docs.where(passive > 0), "soft", "P3", value=passive))
    )


#: Rule, severity and pattern of the notation checks.
NOTATION = (
    ("S2a", r"(?U)\d{4}년\s*\d{1,2}월\s*\d{1,2}일"),
    ("S2b", r"(?U)\d{4}\.\d{1,2}\.\d{1,2}\.?(?!\d)"),
    ("S2c", r"(?U)(?:오전|오후)\s*\d{1,2}시"),
    ("S2d", r"(?U)\d{1,3}(?:,\d{3})*천\s*원"),
)


def text_checks(docs: DataFrame, limit: int | None = None, most_terms: int = 10, most_acronyms: int = 12) -> DataFrame:
    """Words, acronyms, notation and size (S1 to S3): one pass over the text, no shuffle.

    Terms of the word lists come as their most_terms most frequent, by list.
    """
    def terms(rule: str, patterns: dict[str, str], top: int | None) -> Column:
        cells = ", ".join(f"struct(-{N.counted('text', p)} AS k, {i} AS i, {T.quoted(t)} AS term)" for i, (t, p) in enumerate(patterns.items()))
        used = f"filter(array({cells}), x -> x.k < 0)"
        used = f"slice(array_sort({used}), 1, {top})" if top else used
        return F.expr(f"transform({used}, x -> struct('soft' AS severity, '{rule}' AS rule_id, cast(-x.k AS double) AS value, x.term AS term))")

    def one(severity: str, rule: str, value: Column, when: Column) -> Column:
        row = F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"), value.cast("double").alias("value"), F.lit(None).cast("string").alias("term"))
        return F.when(when, F.array(row)).otherwise(F.array().cast("array<struct<severity:string,rule_id:string,value:double,term:string>>"))

    literal = lambda words: {w: re.escape(w) for w in words}
    acronyms = F.transform(F.slice(T.bare_acronyms("text"), 1, most_acronyms), lambda a: F.struct(F.lit("info").alias("severity"), F.lit("S1e").alias("rule_id"), F.lit(None).cast("double").alias("value"), a.alias("term")))
    size = T.nospace_len("text")
    over = size > limit if limit else F.lit(False)
    parts = [
        terms("S1a", literal(fixed.VAGUE), most_terms),
        terms("S1b", literal(fixed.HANJA), most_terms),
        terms("S1c", {p: p for p in fixed.TRANSLATED}, None),
        terms("S1d", {p: p for p in fixed.FILLERS}, None),
        acronyms,
        *(one("soft", rule, F.expr(N.counted("text", p)), F.expr(f"{N.counted('text', p)} > 0")) for rule, p in NOTATION),
        one("hard", "S3", size, over),
        one("info", "S3", size, ~over),
    ]
    found = docs.select("doc_id", F.explode(F.concat(*parts)).alias("f"))
    return found.select("doc_id", "f.severity", "f.rule_id", F.lit(None).cast("int").alias("line_no"), "f.value", "f.term")


def check_reports(docs: DataFrame, mode: str = "bullet", limit: int | None = None) -> DataFrame:
    """All findings of docs (doc_id, text)."""
    if mode not in ("bullet", "prose"):
        raise ValueError("mode is bullet or prose")
    docs = docs.select("doc_id", "text")
    lines = raw_lines(docs)
    body = item_checks(lines) if mode == "bullet" else prose_checks(docs)
    return head_checks(docs).unionByName(body).unionByName(text_checks(docs, limit)).select(*SCHEMA)


def verdicts(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, n_hard, n_soft, passed): passed means no hard finding."""
    counts = findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "hard").alias("n_hard"), F.count_if(F.col("severity") == "soft").alias("n_soft"))
    out = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0)
    return out.withColumn("passed", F.col("n_hard") == 0)
