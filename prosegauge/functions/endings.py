"""How an item or a sentence ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .textprims import col, strip_tail


def ending(c: Column | str) -> Column:
    """Struct (ending_class, ending_token) of an item; the first class that fits."""
    s = strip_tail(c)
    last = F.right(s, F.lit(1))

    def result(name: str, n: int) -> Column:
        return F.struct(F.lit(name).alias("ending_class"), F.right(s, F.lit(n)).alias("ending_token"))

    mieum = last.isin(*fixed.MIEUM) & ~F.right(s, F.lit(2)).isin(*fixed.MIEUM_NOUNS)
    return (
        F.when(s == "", F.struct(F.lit("기타").alias("ending_class"), F.lit("").alias("ending_token")))
        .when(last.isin(")", "）", "]"), result("괄호부연", 8))
        .when(s.rlike(rf"(?U)[\d%]$|\d(?:{fixed.NUMBER_UNITS})$"), result("수치", 6))
        .when(~last.rlike(fixed.HANGUL), result("기타", 6))
        .when(last == "다", result("종결어미(-다)", 4))
        .when(s.endswith("필요"), result("필요", 4))
        .when(s.rlike("(?:요망|바람)$"), result("요망/바람", 4))
        .when(last == "요", result("종결어미(-요)", 4))
        .when(s.rlike("(?:중|중임)$"), result("-중(진행)", 4))
        .when(s.rlike("(?:것|것임)$"), result("-것", 4))
        .when(last == "등", result("등(열거)", 4))
        .when(mieum, result("명사형어미(-ㅁ)", 4))
        .otherwise(result("체언(명사구)", 4))
    )


def checked_ending(c: Column | str) -> Column:
    """The checker's five classes; unlike ending(), one footnote mark is dropped, wherever it stands."""
    flat = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    s = F.regexp_replace(F.regexp_replace(flat, r"(?U)\d{1,2}\)$", ""), r"[ .。,;:]+$", "")
    return (
        F.when(s == "", "empty")
        .when(s.rlike(f"(?:{fixed.NOUN_ENDINGS})$"), "noun_or_mieum")
        .when(s.rlike(f"(?:{fixed.SENTENCE_ENDINGS})$"), "sentence")
        .when(s.rlike(r"[)）]$"), "paren")
        .when(s.rlike(r"(?U)[\d%]$"), "number")
        .otherwise("noun_or_mieum")
    )


def register(sentence: Column | str) -> Column:
    """Speech level of a blog sentence. The suffixes are this engine's choice where none is published."""
    s = F.regexp_replace(col(sentence), r"[\s.!?…”\"')\]]+$", "")
    return (
        F.when(s.rlike("(?:니다|니까|시오)$"), "합쇼체")
        .when(s.rlike("죠$"), "-죠")
        .when(s.rlike("요$"), "해요체")
        .when(s.rlike("다$"), "해라체")
        .otherwise("기타")
    )


def length_class(n: Column) -> Column:
    return F.when(n <= 30, "S").when(n <= 70, "M").otherwise("L")


def length_bucket(n: Column) -> Column:
    bounds = ((20, "0-20"), (35, "21-35"), (50, "36-50"), (70, "51-70"), (100, "71-100"))
    out = F.lit("101+")
    for most, name in reversed(bounds):
        out = F.when(n <= most, name).otherwise(out)
    return out


def comma_class(before: Column | str) -> Column:
    """What stands before a comma: a connective ending, a particle or a list item."""
    w = col(before)
    out = F.when(w.isin(*fixed.CONNECTIVES, "그리고", "하지만", "그래서"), "접속부사 뒤")
    for tail in ("고", "나", "지만", "며", "면", "서", "데", "도", "니"):
        out = out.when(w.endswith(tail), f"-{tail}")
    return out.when(w.rlike("[은는이가]$"), "주어 뒤").when(w.rlike(fixed.LISTED), "나열").otherwise("기타")


def heading_flags(c: Column | str) -> Column:
    """Kinds of a heading: how it ends (a noun phrase where no other ending fits), and whether a number leads."""
    h = F.trim(col(c))
    declarative, imperative, question = h.rlike(r"다\.?$"), h.rlike(r"(?:라|세요|시오|자)\.?$"), h.rlike(r"\?$|까$")
    return F.struct(
        (~(declarative | imperative | question)).alias("noun_phrase"),
        declarative.alias("declarative"),
        imperative.alias("imperative"),
        question.alias("question"),
        h.rlike(r"(?U)^\(?\d").alias("numbered"),
    )


def closing_flags(paragraph: Column | str) -> Column:
    """Whether a last paragraph calls, looks ahead or thanks, and whether it sums up."""
    p = col(paragraph)
    return F.struct(
        p.rlike("(?:보세요|봅시다|바랍니다|좋겠습니다|것입니다|감사합니다|겠습니다|기대합니다)").alias("call_or_outlook"),
        p.rlike("(?:요약하면|정리하면|결론적으로|요약하자면|정리하자면)").alias("summary"),
    )


def opening_type(paragraph: Column | str) -> Column:
    p = col(paragraph)
    return (
        F.when(p.rlike("안녕하세요|저는|제가"), "이력/인사")
        .when(p.rlike(r"\?"), "질문")
        .when(p.rlike("(?:이란|란|의미합니다|뜻합니다)"), "정의")
        .otherwise("배경/기타")
    )


def spelling_preference(author: Column, standard: Column) -> Column:
    """Which of two spellings a corpus prefers; fewer than two uses are mixed, none is null."""
    total = author + standard
    return F.when(total == 0, None).when((total < 2) | (author == standard), "혼용").when(author > standard, "author").otherwise("standard")
