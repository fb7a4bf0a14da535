"""Registered queries over the engine's operators, with the DuckDB SQL that must give the same rows.

Language-neutral operators run over the whole tables; Korean ones over inline texts, since the
tables hold none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import endings, fixed
from ..functions import textprims as T
from ..operators import acceptance, corpus, fidelity, items, lines, profile, report_check, rules, segments, stats, targets
from ..sources import readers
from ..streaming import taste
from . import fixtures as X
from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# Parts of the SQL: English sentences of a paragraph or text, and Markdown-free paragraphs.
FLAT = r"regexp_replace({t}, '\s+', ' ', 'g')"
SENTENCES = (
    r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(" + FLAT + r", '([a-z0-9)])\.( [A-Z“\"(])', '\1.' || chr(10) || '\2', 'g'),"
    r" '([!?])( [A-Z“\"(])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda s: trim(s)),"
    r" lambda s: len(regexp_extract_all(s, '[A-Za-z][A-Za-z''’\-]*')) >= 3)"
)
WORDS = r"regexp_extract_all({t}, '[A-Za-z][A-Za-z''’\-]*')"
SYLLABLES = (
    "CASE WHEN {w} = '' THEN 0 WHEN len({w}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all("
    "regexp_replace(regexp_replace({w}, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{{1,2}}'))) END"
)
PARAGRAPHS = r"""paras AS (
  SELECT doc_id, lang, source, para_no, paragraph FROM (
    SELECT doc_id, lang, source, unnest(p) AS paragraph, unnest(range(1, len(p) + 1)) AS para_no
    FROM (SELECT doc_id, lang, source,
                 list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: trim(x)), lambda x: x <> '') AS p
          FROM documents)))"""
SENTS = (
    "WITH " + PARAGRAPHS + r""", sents AS (
  SELECT doc_id, lang, source, para_no, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS sent_no, unnest(list_transform(s, lambda x: length(x))) AS len
  FROM (SELECT doc_id, lang, source, para_no, """ + SENTENCES.format(t="paragraph") + " AS s FROM paras))"
)
CLASS = "CASE WHEN len <= 30 THEN 'S' WHEN len <= 70 THEN 'M' ELSE 'L' END"


def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return stats.sentence_rows(documents(spark, d), ["doc_id", "lang", "source"])


def paragraph_lengths(spark: SparkSession, d: str) -> DataFrame:
    return stats.paragraph_lengths(documents(spark, d), ["doc_id", "lang"])


@query("""SELECT lang, count(n_chars) AS n, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.25) AS p25,
 quantile_cont(n_chars, 0.75) AS p75, quantile_cont(n_chars, 0.9) AS p90, max(n_chars) AS max FROM documents GROUP BY lang""")
def doc_length_dist_by_lang(spark, d):
    return stats.distribution(documents(spark, d), ["lang"], "n_chars")


@query(r"""WITH l AS (SELECT lang, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
m AS (SELECT lang, length(regexp_replace(line, '\s', '', 'g')) AS n, regexp_matches(line, '[0-9]') AS d FROM l WHERE line <> '')
SELECT lang, count(*) AS n_lines, 100.0 * avg(CAST(n > 60 AS INT)) AS pct_over60, 100.0 * avg(CAST(n > 90 AS INT)) AS pct_over90,
 100.0 * avg(CAST(d AS INT)) AS pct_digit FROM m GROUP BY lang""")
def line_shares(spark, d):
    rows = lines.lines(documents(spark, d).select("lang", "text"), keep_blank=False)
    n = T.nospace_len("line")
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_lines"), T.share(n > 60).alias("pct_over60"), T.share(n > 90).alias("pct_over90"), T.share(T.has_digit("line")).alias("pct_digit")
    )


@query(r"""WITH b AS (SELECT doc_id, text, """ + SENTENCES.format(t="text") + " AS s, " + WORDS.format(t="text") + r""" AS w FROM documents WHERE lang = 'en'),
c AS (SELECT doc_id, list_transform(s, lambda x: len(""" + WORDS.format(t="x") + r""")) AS k, len(s) AS n_sentences, len(w) AS n_words,
 len(list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: """ + SYLLABLES.format(w="x") + r""" >= 3)) AS n_long,
 len(regexp_extract_all(text, '(?i)\b(?:am|is|are|was|were|be|being|been)\s+(?:\w+ed|\w+en)\b')) AS passive FROM b),
m AS (SELECT *, coalesce(CAST(list_sum(k) AS DOUBLE) / nullif(n_sentences, 0), 0) AS mean FROM c)
SELECT doc_id, CAST(n_words AS INT) AS n_words, CAST(n_sentences AS INT) AS n_sentences, mean AS words_per_sentence,
 100.0 * len(list_filter(k, lambda x: x > 25)) / nullif(n_sentences, 0) AS pct_over25, 100.0 * n_long / nullif(n_words, 0) AS pct_long_words,
 mean + coalesce(100.0 * n_long / nullif(n_words, 0), 0) AS clarity_index, 100.0 * passive / nullif(n_words, 0) AS passive_per_100 FROM m""")
def en_style_stats(spark, d):
    return stats.english_stats(documents(spark, d).where("lang = 'en'"), ["doc_id"])


@query(r"""WITH w AS (SELECT source, regexp_replace(lower(unnest(""" + WORDS.format(t="text") + r""")), '[^a-z]', '', 'g') AS w FROM documents WHERE lang = 'en')
SELECT source, count(*) AS n_words, 100.0 * avg(CAST(""" + SYLLABLES.format(w="w") + r""" >= 3 AS INT)) AS pct_long FROM w GROUP BY source""")
def syllable_long_word_share(spark, d):
    words = documents(spark, d).where("lang = 'en'").select("source", T.en_words("text").alias("w"))
    counts = words.select("source", F.size("w").alias("n"), T.long_word_count(F.array_join("w", " ")).alias("long")).where("n > 0")
    return counts.groupBy("source").agg(F.sum("n").alias("n_words"), (F.lit(100.0) * (F.sum("long") / F.sum("n"))).alias("pct_long"))


LEXICON = ("the", "and", "tion", "worthless", "token", "les", "para", "der", "@", "zzzz")


@query("SELECT term, CAST(sum((length(text) - length(replace(text, term, ''))) // length(term)) AS BIGINT) AS n FROM documents, (SELECT unnest(["
       + ", ".join(f"'{w}'" for w in LEXICON) + "]) AS term) GROUP BY term HAVING n > 0 ORDER BY n DESC, term LIMIT 8")
def lexicon_topk(spark, d):
    import re

    counts = stats.lexicon_counts(documents(spark, d), {w: re.escape(w) for w in LEXICON})
    return counts.where("n > 0").orderBy(F.desc("n"), "term").limit(8)


@query(r"""WITH t AS (SELECT lang, right(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[-1], 2) AS tail FROM documents),
n AS (SELECT lang, tail, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, tail, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, tail) AS INT) AS rank FROM n QUALIFY rank <= 5""")
def ending_token_topk(spark, d):
    return stats.top_k(documents(spark, d).select("lang", T.last_word_tail("text").alias("tail")), ["lang"], "tail", 5)


@query("""SELECT min(doc_id) AS doc_id, count(*) AS n_copies, sha256(text) AS text_hash FROM documents GROUP BY text""")
def exact_dup_docs(spark, d):
    return corpus.drop_exact_duplicates(documents(spark, d)).select("doc_id", "n_copies", "text_hash")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY line HAVING n_docs >= 2""")
def repeated_lines(spark, d):
    return corpus.repeated_lines(documents(spark, d))


GRAMS = r"""(SELECT {i}, array_to_string(w[k:k + 3], ' ') AS gram FROM (SELECT {i}, w, unnest(range(1, len(w) - 2)) AS k FROM
 (SELECT {i}, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM {t}) WHERE len(w) >= 4))"""


@query("WITH a AS (SELECT DISTINCT * FROM " + GRAMS.format(i="doc_id", t="documents") + "), b AS (SELECT DISTINCT * FROM " + GRAMS.format(i="item_id", t="benchmark")
       + ") SELECT doc_id, item_id, count(*) AS n FROM a JOIN b USING (gram) GROUP BY doc_id, item_id")
def ngram_overlap_benchmark(spark, d):
    return fidelity.overlap(documents(spark, d), table(spark, d, "benchmark"), "doc_id", "item_id")


@query(r"""WITH t AS (SELECT conv_id, role, unnest(regexp_extract_all(text, '[0-9][0-9,.]*[0-9]|[0-9]')) AS token FROM conversations),
a AS (SELECT conv_id, token, count(*) AS n FROM t WHERE role = 'user' GROUP BY ALL), b AS (SELECT conv_id, token, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY ALL)
SELECT conv_id, token, coalesce(a.n, 0) AS n_original, coalesce(b.n, 0) AS n_result, CASE WHEN a.n IS NULL THEN 'invented' ELSE 'lost' END AS verdict
FROM a FULL JOIN b USING (conv_id, token) WHERE a.n IS NULL OR coalesce(b.n, 0) < a.n""")
def new_numbers_vs_original(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role", "text")
    kinds = {"number": fidelity.TOKENS["number"]}
    a = fidelity.token_rows(turns.where("role = 'user'"), "id", "text", kinds).withColumnRenamed("n", "n_original")
    b = fidelity.token_rows(turns.where("role = 'assistant'"), "id", "text", kinds).withColumnRenamed("n", "n_result")
    return fidelity.verdicts_of(a, b).select(F.col("id").alias("conv_id"), "token", "n_original", "n_result", "verdict")


@query()
def html_text_segments(spark, d):
    return readers.html_segments(table(spark, d, "pages"), "page_id", "html")


@query(SENTS + f""", p AS (SELECT lang, {CLASS} || lead({CLASS}) OVER (PARTITION BY doc_id, lang, source, para_no ORDER BY sent_no) AS step FROM sents),
n AS (SELECT lang, step, count(*) AS n FROM p WHERE step IS NOT NULL GROUP BY ALL)
SELECT lang, step, n, 100.0 * n / sum(n) OVER (PARTITION BY lang) AS pct FROM n""")
def length_transition(spark, d):
    return stats.length_transitions(paragraph_lengths(spark, d), ["lang"])


@query(SENTS + f""", p AS (SELECT doc_id, lang, para_no, string_agg({CLASS}, '' ORDER BY sent_no) AS pattern FROM sents GROUP BY ALL),
n AS (SELECT lang, pattern, count(*) AS n FROM p GROUP BY ALL)
SELECT lang, pattern, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, pattern) AS INT) AS rank FROM n QUALIFY rank <= 10""")
def rhythm_topk(spark, d):
    return stats.rhythm(paragraph_lengths(spark, d), ["lang"])


@query(SENTS + """ SELECT lang, count(len) AS n, avg(len) AS mean, quantile_cont(len, 0.1) AS p10, quantile_cont(len, 0.25) AS p25, quantile_cont(len, 0.5) AS median,
 quantile_cont(len, 0.75) AS p75, quantile_cont(len, 0.9) AS p90, CAST(max(len) AS INT) AS max, CAST(min(len) AS INT) AS min, stddev_samp(len) AS sd, 100.0 * avg(CAST(len <= 35 AS INT)) AS pct_le35,
 100.0 * avg(CAST(len BETWEEN 36 AND 70 AS INT)) AS pct_36_70, 100.0 * avg(CAST(len > 70 AS INT)) AS pct_gt70, 100.0 * avg(CAST(len > 100 AS INT)) AS pct_gt100 FROM sents GROUP BY lang""")
def sentence_length_profile(spark, d):
    return stats.length_profile(sentence_rows(spark, d), ["lang"])


@query(SENTS + """, b AS (SELECT lang, len, lag(len) OVER (PARTITION BY doc_id, para_no ORDER BY sent_no) AS before FROM sents)
SELECT lang, count(*) AS n, avg(len) AS mean, 100.0 * avg(CAST(len <= 40 AS INT)) AS pct_short FROM b WHERE before >= 90 GROUP BY lang""")
def after_long_sentence(spark, d):
    return stats.after_long(paragraph_lengths(spark, d), ["lang"])


@query(SENTS + """, e AS (SELECT lang, arg_min(len, sent_no) AS f, arg_max(len, sent_no) AS l FROM sents GROUP BY doc_id, lang, para_no)
SELECT lang, avg(f) AS first_mean, avg(l) AS last_mean, count(*) AS n_paragraphs FROM e GROUP BY lang""")
def first_last_sentence(spark, d):
    return stats.first_last(paragraph_lengths(spark, d), ["lang"])


@query(SENTS + """, c AS (SELECT lang, length(sentence) - length(replace(sentence, ',', '')) AS k FROM sents)
SELECT lang, sum(k) / count(*) AS commas_per_sent, 100.0 * avg(CAST(k = 0 AS INT)) AS pct_no_comma, 100.0 * avg(CAST(k >= 2 AS INT)) AS pct_two_commas FROM c GROUP BY lang""")
def comma_stats(spark, d):
    return stats.comma_stats(sentence_rows(spark, d), ["lang"])


BUCKET = "CASE WHEN len <= 20 THEN '0-20' WHEN len <= 35 THEN '21-35' WHEN len <= 50 THEN '36-50' WHEN len <= 70 THEN '51-70' WHEN len <= 100 THEN '71-100' ELSE '101+' END"


@query(SENTS + f""", n AS (SELECT lang, {BUCKET} AS bucket, count(*) AS n FROM sents GROUP BY ALL)
SELECT lang, bucket, n, 100.0 * n / sum(n) OVER (PARTITION BY lang) AS pct FROM n""")
def length_buckets(spark, d):
    return stats.class_share(sentence_rows(spark, d).withColumn("bucket", endings.length_bucket(F.col("len"))), ["lang"], "bucket")


@query(SENTS + " SELECT source, count(*) AS n_sentences, CAST(sum(len) AS BIGINT) AS chars, avg(len) AS mean_len FROM sents GROUP BY ROLLUP (source)")
def source_rollup(spark, d):
    return stats.rollup_stats(sentence_rows(spark, d), "source")


@query(SENTS + r""", f AS (SELECT doc_id, len <= 30 AS short, sent_no, para_no FROM sents),
p AS (SELECT doc_id, short, lag(short) OVER (PARTITION BY doc_id, para_no ORDER BY sent_no) AS before FROM f)
SELECT doc_id, count(*) FILTER (short AND before) AS n FROM p GROUP BY doc_id HAVING n > 0""")
def consecutive_short_sentences(spark, d):
    return stats.consecutive_short(paragraph_lengths(spark, d), ["doc_id"]).where("n > 0")


@query("WITH " + PARAGRAPHS + r""", s AS (SELECT lang, len(""" + SENTENCES.format(t="paragraph") + r""") AS s FROM paras WHERE len(""" + WORDS.format(t="paragraph") + r""") >= 25)
SELECT lang, count(s) AS n, avg(s) AS mean, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.25) AS p25, quantile_cont(s, 0.75) AS p75, quantile_cont(s, 0.9) AS p90, CAST(max(s) AS INT) AS max FROM s GROUP BY lang""")
def paragraph_sentences(spark, d):
    paras = lines.paragraphs(documents(spark, d).select("doc_id", "lang", "text")).where(T.en_word_count("paragraph") >= 25)
    return paras.withColumn("s", F.size(T.en_sentences("paragraph"))).groupBy("lang").agg(*stats.dist("s"))


@query("SELECT source, doc_id AS start, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS end_ FROM documents")
def range_next_bound(spark, d):
    return stats.next_bound(documents(spark, d).select("source", F.col("doc_id").alias("start")), ["source"], "start", "end_")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
f AS (SELECT doc_id, line_no, trim(line) AS heading FROM l WHERE len(list_filter(regexp_split_to_array(trim(regexp_replace(line, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) BETWEEN 2 AND 8
 AND NOT ends_with(trim(line), '.') AND regexp_matches(trim(line), '^[A-Z][A-Za-z0-9 ,’''\-:()/]+$') AND NOT regexp_matches(trim(line), '\b(?:CRS|Figure|Table|Source|Notes?)\b'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS heading_no, heading FROM f QUALIFY heading_no <= 14""")
def english_headings(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return corpus.english_headings(rows)


@query("SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS size FROM pages")
def page_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))


# Inline texts.

BRIEF_SQL = r"""WITH b AS (SELECT * FROM """ + X.values(X.BRIEFS, "doc, page, body") + r"""),
l AS (SELECT doc, page, i AS line_no, trim(ls[i]) AS line FROM (SELECT doc, page, string_split(body, chr(10)) AS ls, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM b)),
k AS (SELECT *, length(line) AS n,
 CASE WHEN regexp_matches(line, '^[≐▪]') THEN 1
      WHEN regexp_matches(line, '^(?:‑‑|‑|-|–)\s*[^0-9△▲\s]') OR regexp_matches(line, '^(?:‑‑|‑|-|–)\s*$') OR regexp_matches(line, '^(?:‑‑|‑|-|–)\s+') THEN 2
      WHEN regexp_matches(line, '^[•・·]') THEN 3 END AS level FROM l),
c AS (SELECT *, CASE WHEN line = '' THEN 'BLANK' WHEN level IS NOT NULL THEN 'BULLET'
  WHEN regexp_matches(line, '^(?:\[표|\[그림|그림\s*[0-9]|표\s*[0-9]|\(단위|자료\s*:|주\s*:|출처|※\s*자료)') OR regexp_matches(line, '^[0-9]{1,2}\)\s') OR regexp_matches(line, '^[※*]')
    OR regexp_matches(line, '^(?:포커스|[0-9]{1,3})$') OR regexp_matches(line, '^[0-9\s,.\-–△▲+%()~’''/:]+$')
    OR line IN ('구분','주요 내용','주요내용','비고','일자','내용','구 분','합계','계','연도') THEN 'BREAK'
  WHEN n BETWEEN 2 AND 15 AND regexp_matches(line, '[가-힣]') AND NOT regexp_matches(line, '[0-9]') THEN 'HEAD' ELSE 'TEXT' END AS kind,
  CASE level WHEN 1 THEN trim(regexp_replace(line, '^[≐▪]\s*', '')) WHEN 2 THEN trim(regexp_replace(line, '^(?:‑‑|‑|-|–)\s*', '')) WHEN 3 THEN trim(regexp_replace(line, '^[•・·]\s*', '')) END AS body FROM k),
e AS (SELECT *, coalesce(lag(kind) OVER w = 'BULLET' AND lag(body) OVER w = '', false) AS after_empty, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY doc, page ORDER BY line_no)),
s AS (SELECT *, kind IN ('BLANK', 'BREAK') OR (n < 10 AND (n < 3 OR kind = 'HEAD') AND NOT after_empty) AS closes FROM e),
i AS (SELECT *, sum(CAST(kind = 'BULLET' OR closes OR rn = 1 AS INT)) OVER (PARTITION BY doc ORDER BY page, line_no) AS island FROM s),
g AS (SELECT doc, island, min(page) AS page, max(level) AS level, arg_min(kind, page * 10000 + line_no) AS opener,
  string_agg(nullif(CASE WHEN kind = 'BULLET' THEN body ELSE line END, ''), ' ' ORDER BY page, line_no) AS text,
  count(nullif(CASE WHEN kind = 'BULLET' THEN body ELSE line END, '')) AS n_lines FROM i GROUP BY doc, island),
items AS (SELECT * FROM g WHERE opener = 'BULLET' AND n_lines > 0)
"""


def briefs(spark: SparkSession) -> DataFrame:
    pages = X.frame(spark, X.BRIEFS, "doc string, page int, body string")
    return lines.lines(pages, "body")


@query(BRIEF_SQL + r"""SELECT doc, CAST(page AS INT) AS page, CAST(level AS INT) AS level, text, CAST(n_lines AS INT) AS n_lines, CAST(length(text) AS INT) AS n_chars,
 CAST(length(regexp_replace(text, '\s', '', 'g')) AS INT) AS n_chars_nospace, regexp_matches(text, '[0-9]') AS has_digit,
 CAST(len(regexp_extract_all(text, '[0-9][0-9,.]*')) AS INT) AS n_numbers, regexp_matches(text, '^[(（][^)）]{1,14}[)）]') AS paren_head FROM items""")
def ko_item_parse(spark, d):
    found = items.items(briefs(spark), ["doc"])
    return found.select("doc", "page", "level", "text", "n_lines", "n_chars", "n_chars_nospace", "has_digit", "n_numbers", "paren_head")


@query(BRIEF_SQL + r"""SELECT CAST(level AS INT) AS level, count(*) AS n, avg(length(regexp_replace(text, '\s', '', 'g'))) AS mean,
 100.0 * avg(CAST(regexp_matches(text, '[0-9]') AS INT)) AS pct_digit FROM items GROUP BY level""")
def ko_item_stats(spark, d):
    found = stats.item_stats(items.items(briefs(spark), ["doc"]), ["level"])
    return found.select("level", "n", "mean", "pct_digit")


@query()
def ko_doc_summary(spark, d):
    return items.doc_summary(briefs(spark), ["doc"])


@query(r"""WITH t AS (SELECT * FROM """ + X.values([(k, t) for k, t in enumerate(X.ENDINGS)], "id, text") + r"""),
s AS (SELECT id, rtrim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([가-힣)\]”’.])(?:[0-9]{1,2}\))+$', '\1'), ' .。,;:') AS s FROM t)
SELECT CAST(id AS INT) AS id, CASE WHEN s = '' THEN '기타' WHEN regexp_matches(s, '[)）\]]$') THEN '괄호부연' WHEN regexp_matches(s, '[0-9%]$|[0-9](?:원|명|건|개|호|년|월|일|p)$') THEN '수치'
 WHEN NOT regexp_matches(s, '[가-힣]$') THEN '기타' WHEN s LIKE '%다' THEN '종결어미(-다)' WHEN s LIKE '%필요' THEN '필요' WHEN s LIKE '%요망' OR s LIKE '%바람' THEN '요망/바람'
 WHEN s LIKE '%요' THEN '종결어미(-요)' WHEN s LIKE '%중' OR s LIKE '%중임' THEN '-중(진행)' WHEN s LIKE '%것' OR s LIKE '%것임' THEN '-것' WHEN s LIKE '%등' THEN '등(열거)'
 WHEN regexp_matches(s, '[함음임됨짐림옴줌봄뿜씀]$') AND right(s, 2) NOT IN ('책임','위임','수임','모임','믿음','도움','결함','손실','수입','신임') THEN '명사형어미(-ㅁ)'
 ELSE '체언(명사구)' END AS ending_class FROM s""")
def ko_ending_class(spark, d):
    rows = X.frame(spark, list(enumerate(X.ENDINGS)), "id int, text string")
    return rows.select("id", endings.ending("text")["ending_class"].alias("ending_class"))


@query(BRIEF_SQL + r""", h AS (SELECT i.*, kind = 'HEAD' AND (g.opener <> 'BULLET' OR closes) AS head FROM i JOIN g USING (doc, island)),
b2 AS (SELECT *, head AND NOT coalesce(lag(head) OVER w AND lag(page) OVER w = page, false) AS start FROM h WINDOW w AS (PARTITION BY doc ORDER BY page, line_no)),
n2 AS (SELECT *, sum(CAST(start AS INT)) OVER (PARTITION BY doc ORDER BY page, line_no) AS heading_no FROM b2)
SELECT doc, CAST(heading_no AS BIGINT) AS heading_no, string_agg(line, ' ' ORDER BY page, line_no) AS heading FROM n2 WHERE head GROUP BY doc, heading_no""")
def ko_headings(spark, d):
    return items.headings(briefs(spark), ["doc"])


def reports(spark: SparkSession) -> DataFrame:
    return X.frame(spark, X.REPORTS, "doc_id string, text string")


@query(O.report_bullets(X.values(X.REPORTS, "doc_id, text"), 400))
def report_check_findings(spark, d):
    return report_check.check_reports(reports(spark), "bullet", limit=400)


@query(O.report_prose(X.values(X.REPORTS, "doc_id, text")))
def report_check_prose(spark, d):
    return report_check.check_reports(reports(spark), "prose")


@query(O.report_verdicts(X.values(X.REPORTS, "doc_id, text")))
def report_check_verdicts(spark, d):
    docs = reports(spark)
    return report_check.verdicts(docs, report_check.check_reports(docs, "bullet"))


NOTATION_SQL = r"""WITH t AS (SELECT * FROM """ + X.values(X.REPORTS, "doc_id, text") + r"""),
n AS (SELECT doc_id, 'S2a' AS rule_id, len(regexp_extract_all(text, '[0-9]{4}년\s*[0-9]{1,2}월\s*[0-9]{1,2}일')) AS n FROM t
 UNION ALL SELECT doc_id, 'S2c', len(regexp_extract_all(text, '(?:오전|오후)\s*[0-9]{1,2}시')) FROM t
 UNION ALL SELECT doc_id, 'S2d', len(regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})*천\s*원')) FROM t)
SELECT doc_id, rule_id, CAST(n AS DOUBLE) AS value FROM n WHERE n > 0"""


@query(NOTATION_SQL)
def notation_findings(spark, d):
    found = report_check.text_checks(reports(spark))
    return found.where(F.col("rule_id").isin("S2a", "S2c", "S2d")).select("doc_id", "rule_id", "value")


@query("WITH t AS (SELECT * FROM " + X.values(X.REPORTS, "doc_id, text") + "), w AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in fixed.VAGUE)
       + "]) AS term) SELECT doc_id, term, CAST((length(text) - length(replace(text, term, ''))) // length(term) AS DOUBLE) AS value FROM t, w WHERE contains(text, term)")
def vague_terms(spark, d):
    return report_check.text_checks(reports(spark), most_terms=50).where("rule_id = 'S1a'").select("doc_id", "term", "value")


@query()
def ai_tell_findings(spark, d):
    docs = X.frame(spark, X.RULE_TEXTS, "doc_id string, text string")
    return rules.findings(segments.segments(docs))


@query(O.rule_findings(X.values([*X.RULE_TEXTS, *X.word_texts(O.plain_rules())], "doc_id, text")))
def ai_tell_plain_findings(spark, d):
    """The rules that need no lookaround, over texts of their own words too."""
    plain = O.plain_rules()
    docs = X.frame(spark, [*X.RULE_TEXTS, *X.word_texts(plain)], "doc_id string, text string")
    return rules.findings(segments.segments(docs), plain)


@query(O.rule_findings("documents"))
def ai_tell_plain_documents(spark, d):
    return rules.findings(segments.segments(documents(spark, d)), O.plain_rules())


TARGET_ROWS = X.values([(a, c, d_, e) for a, _, c, d_, e, _ in fixed.TARGETS], "metric, level, lo, hi")


@query(O.delegated(X.values([*X.RULE_TEXTS, *X.REPORTS], "doc_id, text"), TARGET_ROWS, acceptance.DELEGATED, acceptance.DELEGATED_TERMS))
def ai_tell_delegated(spark, d):
    return acceptance.delegated(X.frame(spark, [*X.RULE_TEXTS, *X.REPORTS], "doc_id string, text string"))


@query(O.post_targets("(SELECT doc_id AS slug, text AS body FROM documents)", TARGET_ROWS))
def post_target_documents(spark, d):
    posts = documents(spark, d).select(F.col("doc_id").alias("slug"), F.col("text").alias("body"))
    return targets.evaluate(targets.unpivot(targets.post_metrics(posts), "slug"), targets.published_targets(spark))


@query(O.report_prose("documents", 3000))
def report_check_prose_documents(spark, d):
    return report_check.check_reports(documents(spark, d), "prose", limit=3000)


@query(O.report_bullets("documents", 3000))
def report_check_documents(spark, d):
    return report_check.check_reports(documents(spark, d), "bullet", limit=3000)


@query(O.md_segments(X.values(X.RULE_TEXTS, "doc_id, text")))
def md_segments(spark, d):
    return segments.segments(X.frame(spark, X.RULE_TEXTS, "doc_id string, text string"))


@query(O.segment_counts("documents"))
def md_segments_documents(spark, d):
    found = segments.segments(documents(spark, d))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(r"""WITH v AS (SELECT * FROM """ + X.values(X.METRICS, "doc_id, metric, value") + "), t AS (SELECT * FROM "
       + X.values([(a, c, d_, e) for a, _, c, d_, e, _ in fixed.TARGETS], "metric, level, lo, hi") + r""")
SELECT doc_id, metric, value, level, lo AS min, hi AS max, NOT (coalesce(value < lo, false) OR coalesce(value > hi, false)) AS ok,
 (coalesce(value < lo, false) OR coalesce(value > hi, false)) AND level = 'hard' AS blocks FROM v JOIN t USING (metric)""")
def target_eval(spark, d):
    return targets.evaluate(X.frame(spark, X.METRICS, "doc_id string, metric string, value double"), targets.published_targets(spark))


@query(SENTS + """, m AS (SELECT source, avg(len) AS len_mean, 100.0 * avg(CAST(len <= 35 AS INT)) AS pct_short, CAST(sum(length(sentence) - length(replace(sentence, ',', ''))) AS DOUBLE) / count(*) AS commas FROM sents GROUP BY source),
u AS (SELECT source, 'len_mean' AS metric, len_mean AS value, 'len' AS kind FROM m UNION ALL SELECT source, 'pct_short', pct_short, 'pct' FROM m UNION ALL SELECT source, 'commas', commas, 'ratio' FROM m)
SELECT metric, min(value) AS env_min, max(value) AS env_max,
 CASE any_value(kind) WHEN 'len' THEN floor(min(value) - 3) WHEN 'pct' THEN greatest(0, floor(min(value) - 3)) ELSE floor((min(value) - 0.05) * 10) / 10 END AS min,
 CASE any_value(kind) WHEN 'len' THEN ceil(max(value) + 3) WHEN 'pct' THEN least(100, ceil(max(value) + 3)) ELSE ceil((max(value) + 0.05) * 10) / 10 END AS max FROM u GROUP BY metric""")
def target_envelopes(spark, d):
    m = sentence_rows(spark, d).groupBy("source").agg(
        F.avg("len").alias("len_mean"), T.share(F.col("len") <= 35).alias("pct_short"), (F.sum(F.regexp_count("sentence", F.lit(","))) / F.count("*")).alias("commas")
    )
    kinds = X.frame(spark, [("len_mean", "len", True), ("pct_short", "pct", True), ("commas", "ratio", True)], "metric string, kind string, has_min boolean")
    return targets.envelopes(targets.unpivot(m, "source"), kinds)


@query("""WITH f AS (SELECT doc_id, 'quality' AS metric, quality = 1 AS flag FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 1 FROM labels)
SELECT metric, count(*) FILTER (flag) AS n_true, count(flag) AS n, CASE WHEN bool_and(flag) OR NOT bool_or(flag) THEN bool_and(flag) END AS equals,
 bool_and(flag) OR NOT bool_or(flag) AS kept FROM f GROUP BY metric""")
def stable_flags(spark, d):
    lab = table(spark, d, "labels")
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(c) == 1).alias("flag")) for c in ("quality", "toxic")))
    return targets.stable_booleans(lab.select("doc_id", F.inline(pairs)))


@query(O.post_targets(X.values(X.RULE_TEXTS, "slug, body"), TARGET_ROWS))
def post_target_check(spark, d):
    posts = X.frame(spark, X.RULE_TEXTS, "slug string, body string")
    return targets.evaluate(targets.unpivot(targets.post_metrics(posts), "slug"), targets.published_targets(spark))


@query("SELECT rule, count(*) AS n_cases, CAST(sum(CASE WHEN contains(comment, '[규칙]') THEN 2 ELSE 1 END) AS BIGINT) AS weight, "
       "CASE WHEN sum(CASE WHEN contains(comment, '[규칙]') THEN 2 ELSE 1 END) >= 4 THEN 'rule' WHEN sum(CASE WHEN contains(comment, '[규칙]') THEN 2 ELSE 1 END) >= 2 THEN 'trend' "
       "ELSE 'observation' END AS stage FROM " + X.values(X.CASES, "case_id, rule, comment") + " GROUP BY rule")
def taste_promotion(spark, d):
    return taste.promote(X.frame(spark, X.CASES, "case_id string, rule string, comment string"))


@query(O.fidelity(X.values(X.REWRITES, "id, a, b"), fidelity.TOKENS))
def rewrite_fidelity(spark, d):
    rows = X.frame(spark, X.REWRITES, "id string, a string, b string")
    return fidelity.compare(rows.select("id", F.col("a").alias("text")), rows.select("id", F.col("b").alias("text")))


@query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations) SELECT role, count(*) AS n_turns, avg(length(text)) AS mean_len,
 100.0 * avg(CAST(ends_with(trim(text), '?') AS INT)) AS pct_question FROM t GROUP BY role""")
def turn_profile(spark, d):
    t = table(spark, d, "conversations")
    return t.groupBy("role").agg(F.count("*").alias("n_turns"), F.avg(F.length("text")).alias("mean_len"), T.share(F.trim("text").endswith("?")).alias("pct_question"))


@query()
def check_all_findings(spark, d):
    rows = X.frame(spark, X.REWRITES, "doc_id string, a string, b string")
    return acceptance.check_all(rows.select("doc_id", F.col("b").alias("text")), rows.select("doc_id", F.col("a").alias("text")))


@query("SELECT doc_id, round(n_bullets / n, 9) AS bullet_share FROM (SELECT doc_id, count(*) FILTER (regexp_matches(line, '^\\s*(?:[□○◦▪■●•・·∙☐❍\\-‑–—*※]|[0-9]+[.)]|[가-힣][.)]|\\([0-9]+\\)|[①-⑳])')) AS n_bullets, count(*) AS n "
       "FROM (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '^#+\\s*', ''), '\\*\\*|__|`', '', 'g') AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id)")
def bullet_share(spark, d):
    return corpus.genre_hint(documents(spark, d)).select("doc_id", F.round("bullet_share", 9).alias("bullet_share"))


# The profile of a corpus: inline posts, and all documents.
CORPORA = "(SELECT corpus, text FROM " + X.values(X.POSTS, "corpus, text") + " UNION ALL SELECT 'documents', text FROM documents)"


def corpora(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, X.POSTS, "corpus string, text string").unionByName(documents(spark, d).select(F.lit("documents").alias("corpus"), "text"))


def korean_sentences(spark: SparkSession, d: str) -> DataFrame:
    return stats.sentence_rows(corpora(spark, d), ["corpus"], language="ko")


@query(O.sentence_profile(CORPORA))
def blog_sentences(spark, d):
    return profile.sentence_profile(korean_sentences(spark, d), ["corpus"])


@query(O.paragraph_profile(CORPORA))
def blog_paragraphs(spark, d):
    return profile.paragraph_profile(corpora(spark, d), ["corpus"])


@query(O.ending_tails(CORPORA))
def blog_ending_tails(spark, d):
    return profile.ending_tails(korean_sentences(spark, d), ["corpus"])


@query(O.comma_positions(CORPORA))
def blog_comma_positions(spark, d):
    return profile.comma_positions(korean_sentences(spark, d), ["corpus"])


@query(O.word_lists(CORPORA, profile.LISTS))
def blog_word_lists(spark, d):
    return profile.word_lists(corpora(spark, d), ["corpus"])


@query(O.spelling_preferences(CORPORA))
def blog_spellings(spark, d):
    return profile.spelling_preferences(corpora(spark, d), ["corpus"])


@query(O.openings_and_closings(CORPORA))
def blog_openings_and_closings(spark, d):
    return profile.openings_and_closings(corpora(spark, d), ["corpus"])


@query(O.heading_kinds(CORPORA))
def blog_heading_kinds(spark, d):
    return profile.heading_kinds(corpora(spark, d), ["corpus"])
