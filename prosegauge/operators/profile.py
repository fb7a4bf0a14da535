"""The profile of a corpus of posts: sentences, endings, commas, word lists, spellings, structure.

Word lists count plain substrings. Sequences and parts of a text are array functions on its row, so
the only shuffle of each table is the one of its counts, after partial aggregation. A null text has
no paragraphs and adds nothing. Where no definition is published, this engine's own is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import textprims as T
from ..functions.endings import closing_flags, comma_class, heading_flags, opening_type, register, spelling_preference
from . import lines as L
from .stats import class_share

#: Word lists of the profile by kind.
LISTS = {
    "banned": fixed.BANNED,
    "sensory": fixed.SENSORY,
    "intensifier": fixed.INTENSIFIERS,
    "nonpreferred": tuple(a for a, _ in fixed.SPELLING_PAIRS),
    "watch": fixed.WATCHLIST,
}


def _tail(sentence: str) -> Column:
    return F.regexp_replace(sentence, r"[\s.!?…”\"')\]]+$", "")


def sentence_profile(sents: DataFrame, by: list[str]) -> DataFrame:
    """Shares and counts over sentences by group: endings, speakers, marks, one phrase."""
    s, end = F.col("sentence"), _tail("sentence")
    count = lambda p: F.sum(F.regexp_count(s, F.lit(p)))
    return sents.groupBy(*by).agg(
        F.count("*").alias("n_sentences"),
        T.share(end.endswith("생각합니다")).alias("pct_think"),
        T.share(end.endswith("것 같습니다")).alias("pct_seem"),
        T.share(end.endswith("것입니다")).alias("pct_will"),
        T.share(s.rlike(fixed.HUMBLE_START)).alias("pct_humble_start"),
        T.share(s.rlike(fixed.PLAIN_SELF)).alias("pct_plain_self"),
        F.count_if(s.rlike(fixed.HUMBLE) & s.rlike(fixed.PLAIN_SELF)).alias("n_mixed_self"),
        count(r"[(（]").alias("n_parentheses"),
        count("/").alias("n_slashes"),
        count(fixed.GLOSS).alias("n_glosses"),
        count("!").alias("n_exclamations"),
        count("통해").alias("n_through"),
        T.share(s.contains("통해")).alias("pct_through"),
    )


def paragraph_profile(docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """Paragraphs, the percent of them that have parentheses, and their emoticons, by group.

    Emoticons follow the end of a sentence and are too short for one, so they are counted here.
    """
    paras = L.paragraphs(docs.select(*by, text_col), text_col)
    return paras.groupBy(*by).agg(F.count("*").alias("n_paragraphs"), T.share(F.col("paragraph").rlike(r"[(（]")).alias("pct_parentheses"), F.sum(F.regexp_count("paragraph", F.lit(fixed.EMOTICON))).alias("n_emoticons"))


def ending_tails(sents: DataFrame, by: list[str]) -> DataFrame:
    """(…by, tail_class, n, pct): speech level and the longest known tail of each sentence."""
    end = _tail("sentence")
    tail = F.coalesce(*(F.when(end.endswith(t), F.lit(t)) for t in sorted(fixed.ENDING_TAILS, key=len, reverse=True)), F.lit(""))
    return class_share(sents.select(*by, F.concat(register("sentence"), F.lit(":"), tail).alias("tail_class")), by, "tail_class")


def comma_positions(sents: DataFrame, by: list[str]) -> DataFrame:
    """(…by, position, n, pct): what stands before the commas of sentences."""
    words = F.explode(F.regexp_extract_all("sentence", F.lit(r"([^\s,]+),"), 1))
    return class_share(sents.select(*by, words.alias("w")).select(*by, comma_class("w").alias("position")), by, "position")


def _uses(text_col: str, term: str) -> str:
    return f"(length({text_col}) - length(replace({text_col}, {T.quoted(term)}, ''))) div {len(term)}"


def word_lists(docs: DataFrame, by: list[str], lists: dict[str, tuple[str, ...]] | None = None, text_col: str = "text") -> DataFrame:
    """(…by, kind, term, n): uses of each term of each list, one pass; terms without a use have 0."""
    pairs = [(kind, term) for kind, terms in (lists or LISTS).items() for term in terms]
    sums = docs.groupBy(*by).agg(*(F.coalesce(F.sum(F.expr(_uses(text_col, term))), F.lit(0)).alias(f"_t{k}") for k, (_, term) in enumerate(pairs)))
    rows = ", ".join(f"named_struct('kind', {T.quoted(kind)}, 'term', {T.quoted(term)}, 'n', _t{k})" for k, (kind, term) in enumerate(pairs))
    return sums.select(*by, F.expr(f"inline(array({rows}))"))


def spelling_preferences(docs: DataFrame, by: list[str], variants: tuple[tuple[str, str], ...] = fixed.SPELLING_VARIANTS, text_col: str = "text") -> DataFrame:
    """(…by, author, standard, n_author, n_standard, preferred) of each pair of spellings that is used.

    preferred is the spelling itself, or 혼용 where neither prevails.
    """
    sums = docs.groupBy(*by).agg(
        *(F.coalesce(F.sum(F.expr(_uses(text_col, w))), F.lit(0)).alias(f"_{side}{k}") for k, pair in enumerate(variants) for side, w in zip("as", pair, strict=True))
    )
    rows = ", ".join(
        f"named_struct('author', {T.quoted(a)}, 'standard', {T.quoted(s)}, 'n_author', _a{k}, 'n_standard', _s{k})" for k, (a, s) in enumerate(variants)
    )
    used = sums.select(*by, F.expr(f"inline(array({rows}))")).where("n_author + n_standard > 0")
    which = spelling_preference(F.col("n_author"), F.col("n_standard"))
    return used.withColumn("preferred", F.when(which == "author", F.col("author")).when(which == "standard", F.col("standard")).otherwise(which))


def _body(text_col: str) -> Column:
    return F.regexp_replace(text_col, r"(?m)^(?:#|>|<!--).*$", "")


def openings_and_closings(docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(…by, part, kind, n): opening types, and closings that call, look ahead or sum up; n counts texts."""
    paras = F.filter(F.transform(F.split(_body(text_col), r"\n[ \t\r]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    ends = docs.select(*by, paras.alias("_p")).where(F.size("_p") > 0).select(
        *by, opening_type(F.element_at("_p", 1)).alias("opening"), closing_flags(F.element_at("_p", -1)).alias("closing")
    )
    named = lambda part, kind: F.struct(F.lit(part).alias("part"), kind.alias("kind"))
    kinds = F.array(
        named("opening", F.col("opening")),
        *(named("closing", F.when(F.col(f"closing.{flag}"), F.lit(flag))) for flag in ("call_or_outlook", "summary")),
    )
    rows = ends.select(*by, F.inline(kinds)).where("kind is not null")
    return rows.groupBy(*by, "part", "kind").agg(F.count("*").alias("n"))


def heading_kinds(docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(…by, kind, n, pct) of Markdown headings; kinds overlap, pct is of all headings of the group."""
    heads = docs.select(*by, F.explode(F.regexp_extract_all(text_col, F.lit(r"(?m)^#{1,6}[ \t]+([^\n]*)$"), 1)).alias("_h"))
    flagged = heads.select(*by, heading_flags("_h").alias("_f"))
    kinds = ("noun_phrase", "declarative", "imperative", "question", "numbered")
    sums = flagged.groupBy(*by).agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"_f.{k}")).alias(k) for k in kinds))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n"), T.percent(F.col(k), F.col("_n")).alias("pct")) for k in kinds))
    return sums.select(*by, F.inline(rows))
