"""Column expressions over text; all built in, so they stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(value: str) -> str:
    """A string literal of Spark SQL. Long expressions over data are built as one SQL text, since
    building them column by column takes a call to the JVM for each part."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_pattern(words: tuple[str, ...]) -> str:
    """Alternation of literal strings, the longer first so that a prefix does not hide them."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def collapsed(c: Column | str) -> Column:
    """White space runs (Unicode) as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def nospace(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s", "")


def nospace_len(c: Column | str) -> Column:
    return F.length(nospace(c))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(collapsed(c), " "), lambda x: x != "")


def eojeol(c: Column | str) -> Column:
    """White-space token count where the text is really spaced, else null."""
    n = F.size(tokens(c))
    least = F.greatest(F.lit(2), F.floor(nospace_len(c) / 12).cast("int"))
    return F.when(F.contains(collapsed(c), F.lit(" ")) & (n >= least), n)


def strip_tail(c: Column | str) -> Column:
    """Collapsed text without footnote marks and closing marks at its end."""
    marks = F.regexp_replace(collapsed(c), r"(?U)(?:(?<=[가-힣)\]”’.])\d{1,2}\))+$", "")
    return F.regexp_replace(marks, r"[ .。,;:]+$", "")


def strip_md(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^#+\s*", ""), r"\*\*|__|`", "")


def unquoted(c: Column | str) -> Column:
    return F.regexp_replace(col(c), fixed.QUOTED, "")


def has_digit(c: Column | str) -> Column:
    return col(c).rlike(r"(?U)\d")


def n_numbers(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"(?U)\d[\d,.]*"))


def paren_head(c: Column | str) -> Column:
    return col(c).rlike(r"^[(（][^)）]{1,14}[)）]")


def connective(c: Column | str, words: tuple[str, ...] = fixed.CONNECTIVES) -> Column:
    """The connective that the text begins with, or null."""
    return F.nullif(F.regexp_extract(col(c), rf"(?U)^({literal_pattern(words)})[\s,]", 1), F.lit(""))


def main_title(c: Column | str) -> Column:
    return F.split(col(c), r"(?U)\s[-–—:]\s|\s-|–")[0]


def last_word_tail(c: Column | str, n: int = 2) -> Column:
    return F.right(F.try_element_at(tokens(c), F.lit(-1)), F.lit(n))


def between(c: Column | str, start: str, end: str) -> Column:
    """From start (kept) up to the first end after it; '' where there is none."""
    return F.regexp_extract(col(c), rf"(?s)({re.escape(start)}.*?){re.escape(end)}", 1)


def without_circled(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[❶-❿⓫-⓴➀-➓]", "")


def without_controls(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[\x00-\x1f]", "")


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole; null where whole is 0."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def share(predicate: Column) -> Column:
    """Percent of the rows of a group for which a predicate holds; nulls are left out."""
    return F.lit(100.0) * F.avg(predicate.cast("int"))


def page_kept(page: Column | str, pages: Column | str) -> Column:
    """Page filter: only a non-empty list of numbers filters."""
    wanted = col(pages)
    return F.coalesce((F.size(wanted) == 0) | F.array_contains(wanted, col(page)), F.lit(True))


def is_pdf(content: Column | str) -> Column:
    return F.substring(col(content), 1, 5) == F.lit(b"%PDF-")


# English


def en_words(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(fixed.EN_WORD), 0)


def en_word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(fixed.EN_WORD))


def syllables(word: Column) -> Column:
    """Vowel groups of at most two letters, after silent endings are dropped."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    core = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    groups = F.greatest(F.lit(1), F.regexp_count(core, F.lit("[aeiouy]{1,2}")))
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(groups)


def long_word_count(words: Column) -> Column:
    """How many of some words, joined by spaces, have three syllables or more; see syllables().

    All words at once, so the expressions run over a text and not over each word.
    """
    letters = F.regexp_replace(F.lower(words), "[^a-z ]", "")
    core = F.regexp_replace(F.regexp_replace(letters, "(?:[^laeiouy ]es|ed|[^laeiouy ]e)(?= |$)", ""), "(?<![a-z])y", "")
    return F.regexp_count(core, F.lit("(?:[aeiouy]{1,2}+[^aeiouy ]*+){3,}+"))


def en_sentences(c: Column | str, least_words: int = 3) -> Column:
    """Sentences of at least so many words, as an array."""
    flat = F.regexp_replace(col(c), r"(?U)\s+", " ")
    dots = F.regexp_replace(flat, r"(?<=[a-z0-9)])\.(?=\s+[A-Z“\"(])", ".\n")
    marks = F.regexp_replace(dots, r"([!?])(?=\s+[A-Z“\"(])", "$1\n")
    parts = F.transform(F.split(marks, "\n"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.regexp_count(s, F.lit(fixed.EN_WORD)) >= least_words)


def passive_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(fixed.PASSIVE))


# Korean


def ko_sentences(c: Column | str, least_chars: int = 6) -> Column:
    parts = F.transform(F.split(F.regexp_replace(col(c), r"(?U)\s+", " "), r"(?<=[.!?다요])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least_chars)


def double_passive_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit("되어지|시켜지|에 의해 .{0,12}(?:되|된|됨)"))


def bare_acronyms(c: Column | str) -> Column:
    """Acronyms that no Hangul word explains in brackets, sorted."""
    used = F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(?U)\b[A-Z]{2,6}\b"), 0))
    glossed = F.regexp_extract_all(col(c), F.lit(r"(?U)[가-힣]\s*\(([A-Z]{2,6})\)"), 1)
    return F.array_sort(F.array_except(used, glossed))


def emoji_count(c: Column | str) -> Column:
    pattern = r"[\x{1F300}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}&&[^" + fixed.NOT_EMOJI + "]]"
    return F.regexp_count(col(c), F.lit(pattern))
