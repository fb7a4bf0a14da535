"""DuckDB SQL of the segment, rule, report and target queries, built over any source of texts.

A source is a FROM item with (doc_id, text). The SQL states the results anew over windows and lists;
of the engine it shares the fixed values only. Its regular expressions know no lookaround, so rules
that need it are left to the tests.
"""

from __future__ import annotations

import re

from ..functions import fixed
from ..operators.rules import Rule, load_rules


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def either(values) -> str:
    """An alternation of literal strings, the longer first."""
    return "|".join(re.escape(v) for v in sorted(values, key=lambda v: (-len(v), v)))


def segments(source: str) -> str:
    """A WITH list that ends in seg (doc_id, seg_no, kind, text, line_no, is_last)."""
    pairs = words("|".join(p) for p in fixed.TEACHING_HEADERS)
    return rf"""WITH src AS (SELECT doc_id, text FROM {source}),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM src),
fn AS (SELECT *, regexp_matches(line, '^\s*(?:```|~~~)') AS fence FROM ln),
dp AS (SELECT *, sum(CAST(fence AS INT)) OVER w AS depth,
  sum(CASE WHEN contains(line, '<!-- style-exempt -->') THEN 1 WHEN contains(line, '<!-- /style-exempt -->') THEN -1 ELSE 0 END) OVER w AS opened
  FROM fn WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
pl AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS under, trim(line) AS t FROM dp WHERE NOT fence AND depth % 2 = 0 AND opened <= 0),
ty AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^<!--.*-->$') THEN 'comment' WHEN regexp_matches(t, '^#{{1,6}}\s') THEN 'heading'
  WHEN regexp_matches(t, '^(?:=+|-{{3,}})$') THEN 'rule' WHEN starts_with(t, '|') THEN 'table'
  WHEN coalesce(regexp_matches(under, '^\s*(?:=+|-{{3,}})\s*$'), false) THEN 'heading'
  WHEN regexp_matches(t, '^(?:[-*+•·○□]|\d+[.)])\s') THEN 'list' ELSE 'prose' END AS kind FROM pl),
bk AS (SELECT *, coalesce((kind = 'prose' AND before IN ('prose', 'list')) OR (kind = 'table' AND before = 'table'), false) AS goes_on
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM ty)),
nb AS (SELECT *, sum(CAST(NOT goes_on AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM bk),
md AS (SELECT doc_id, block, arg_min(kind, line_no) AS kind, min(line_no) AS line_no, string_agg(t, chr(10) ORDER BY line_no) AS text FROM nb GROUP BY doc_id, block),
ab AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY block) AS above,
  list_transform(string_split(replace(string_split(text, chr(10))[1], '\|', chr(1)), '|'), lambda c: trim(replace(c, chr(1), '\|'))) AS cells FROM md),
kp AS (SELECT * FROM ab WHERE kind IN ('prose', 'list', 'heading', 'table')
  AND NOT (kind = 'table' AND (list_contains({pairs}, concat_ws('|', cells[2], cells[3])) OR coalesce(contains(above, 'style-teaching'), false)))),
seg AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) AS INT) AS seg_no, kind,
  CASE kind WHEN 'heading' THEN regexp_replace(text, '^#+\s*', '') WHEN 'list' THEN regexp_replace(text, '^(?:[-*+•·○□]|\d+[.)])\s+', '') ELSE text END AS text,
  CAST(line_no + 1 AS INT) AS line_no,
  coalesce(block = max(CASE WHEN kind IN ('prose', 'list') THEN block END) OVER (PARTITION BY doc_id), false) AS is_last FROM kp)"""


def md_segments(source: str) -> str:
    return segments(source) + " SELECT doc_id, seg_no, kind, text, line_no, is_last FROM seg"


def segment_counts(source: str) -> str:
    return segments(source) + " SELECT kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM seg GROUP BY kind"


def plain_rules() -> list[Rule]:
    """The pattern rules that SQL can express: without lookaround."""
    around = re.compile(r"\(\?[<!=]")
    run = [r for r in load_rules() if r.detector in ("regex", "literal", "density")]
    return [r for r in run if not around.search(r.pattern) and not around.search(r.exception_pattern)]


def rule_findings(source: str) -> str:
    """findings() of the plain rules: S1 by segment, the others by unit from their threshold on."""
    hits = []
    for r in plain_rules():
        pattern = text("(?m)" + r.pattern)
        if r.exception_pattern or r.unit == "문장":
            parts = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))"
            kept = f"list_filter({parts}, lambda s: NOT regexp_matches(s, {text('(?m)' + r.exception_pattern)}))" if r.exception_pattern else parts
            n = f"coalesce({'list_max' if r.unit == '문장' else 'list_sum'}(list_transform({kept}, lambda s: len(regexp_extract_all(s, {pattern})))), 0)"
        else:
            n = f"len(regexp_extract_all(text, {pattern}))"
        last = " AND NOT is_last" if r.skips_last else ""
        unit = r.unit or "문서"
        by_segment = r.severity == "S1" or unit != "문서"
        least = 1 if r.severity == "S1" else r.threshold or 1
        hits.append(
            f"SELECT doc_id, {text(r.id)} AS rule_id, {text(r.severity)} AS severity, {text(unit)} AS unit, {'seg_no' if by_segment else '0'} AS unit_no, {least} AS least, {n} AS n"
            f" FROM seg WHERE list_contains({words(r.scope)}, kind){last}"
        )
    return (
        segments(source) + ", hits AS (" + " UNION ALL ".join(hits) + ") SELECT doc_id, rule_id, severity, unit, CAST(unit_no AS INT) AS unit_no, CAST(sum(n) AS BIGINT) AS n"
        " FROM hits GROUP BY doc_id, rule_id, severity, unit, unit_no, least HAVING sum(n) >= least"
    )


# The report checker

SQUASHED = r"regexp_replace({t}, '\s', '', 'g')"
TOKENS = r"len(list_filter(string_split(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' '), lambda x: x <> ''))"
KO_SENTENCES = (
    r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '\s+', ' ', 'g'), '([.!?다요])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)),"
    " lambda s: length(s) >= 6)"
)
PLAIN_LINE = r"regexp_replace(regexp_replace({t}, '^#+\s*', ''), '\*\*|__|`', '', 'g')"



def _row(severity: str, rule: str, value: str = "NULL", line: str = "NULL", term: str = "NULL") -> str:
    return (
        f"SELECT doc_id, '{severity}' AS severity, '{rule}' AS rule_id, CAST({line} AS INT) AS line_no, CAST({value} AS DOUBLE) AS value, CAST({term} AS VARCHAR) AS term"
    )


def _terms(rule: str, patterns: list[tuple[str, str]], most: int | None) -> str:
    listed = ", ".join(f"({k}, {text(t)}, {text(p)})" for k, (t, p) in enumerate(patterns))
    top = f" QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) <= {most}" if most else ""
    return (
        f"SELECT doc_id, 'soft' AS severity, '{rule}' AS rule_id, CAST(NULL AS INT) AS line_no, CAST(n AS DOUBLE) AS value, term FROM ("
        f"SELECT doc_id, i, term, len(regexp_extract_all(text, p)) AS n FROM src, (VALUES {listed}) AS w(i, term, p)) WHERE n > 0{top}"
    )


def _text_checks(limit: int | None) -> list[str]:
    size = f"length({SQUASHED.format(t='text')})"
    notation = (
        ("S2a", r"\d{4}년\s*\d{1,2}월\s*\d{1,2}일"), ("S2b", r"\d{4}\.\d{1,2}\.\d{1,2}\.?(?:[^\d]|$)"), ("S2c", r"(?:오전|오후)\s*\d{1,2}시"),
        ("S2d", r"\d{1,3}(?:,\d{3})*천\s*원"),
    )
    literal = lambda values: [(w, re.escape(w)) for w in values]
    glossed = r"regexp_extract_all(text, '[가-힣]\s*\(([A-Z]{2,6})\)', 1)"
    whole = r"list_filter(regexp_split_to_array(text, '[^\pL\pM\pN\p{Pc}]+'), lambda w: regexp_full_match(w, '[A-Z]{2,6}'))"
    bare = f"list_sort(list_filter(list_distinct({whole}), lambda a: NOT list_contains({glossed}, a)))[1:12]"
    return [
        _terms("S1a", literal(fixed.VAGUE), 10),
        _terms("S1b", literal(fixed.HANJA), 10),
        _terms("S1c", [(p, p) for p in fixed.TRANSLATED], None),
        _terms("S1d", [(p, p) for p in fixed.FILLERS], None),
        f"{_row('info', 'S1e', term='a')} FROM (SELECT doc_id, unnest({bare}) AS a FROM src)",
        *(f"{_row('soft', rule, value='n')} FROM (SELECT doc_id, len(regexp_extract_all(text, {text(p)})) AS n FROM src) WHERE n > 0" for rule, p in notation),
        f"SELECT doc_id, CASE WHEN {size} > {limit or 10**15} THEN 'hard' ELSE 'info' END, 'S3', CAST(NULL AS INT), CAST({size} AS DOUBLE), CAST(NULL AS VARCHAR) FROM src",
    ]


_HEAD = rf""", rl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM src),
hl AS (SELECT doc_id, {PLAIN_LINE.format(t='line')} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM rl WHERE trim(line) <> '' QUALIFY n <= 4),
hd AS (SELECT doc_id, trim(max(line) FILTER (n = 1)) AS title, coalesce(string_agg(line, ' ' ORDER BY n) FILTER (n > 1), '') AS opening, max(n) AS lines FROM hl GROUP BY doc_id)"""


def _head_checks() -> list[str]:
    long = "length(replace(title, ' ', ''))"
    return [
        f"{_row('hard', 'H1a', value=long)} FROM hd WHERE title <> '' AND {long} > 40",
        f"{_row('soft', 'H1b')} FROM hd WHERE title <> '' AND NOT regexp_matches(title, {text('(?:' + either(fixed.TITLE_TAILS) + ')$')})",
        f"{_row('soft', 'H1c')} FROM hd WHERE title <> '' AND regexp_matches(title, '(?:동향|현황)$') AND length(title) < 14",
        f"{_row('hard', 'H2')} FROM hd WHERE lines > 1 AND NOT regexp_matches(opening, {text(either(fixed.CONCLUSIONS) + '|[0-9]')})",
    ]


def report_prose(source: str, limit: int | None = None) -> str:
    passive = "len(regexp_extract_all(text, '되어지|시켜지|에 의해 .{0,12}(?:되|된|됨)'))"
    parts = [
        *_head_checks(),
        f"{_row('info', 'P0', value='chars')} FROM st",
        f"{_row('soft', 'P1', value='eojeol')} FROM st WHERE eojeol > 20",
        f"{_row('hard', 'P2', value='e')} FROM se WHERE e > 35",
        f"{_row('soft', 'P3', value=passive)} FROM src WHERE {passive} > 0",
        *_text_checks(limit),
    ]
    return (
        f"WITH src AS (SELECT doc_id, text FROM {source})" + _HEAD
        + f", se AS (SELECT doc_id, {TOKENS.format(t='s')} AS e, length({SQUASHED.format(t='s')}) AS n FROM (SELECT doc_id, unnest({KO_SENTENCES.format(t='text')}) AS s FROM src))"
        + ", st AS (SELECT doc_id, avg(n) AS chars, avg(e) AS eojeol FROM se GROUP BY doc_id) "
        + " UNION ALL ".join(parts)
    )


def report_bullets(source: str, limit: int | None = None) -> str:
    bullet = r"^(\s*)([□○◦▪■●•・·∙☐❍\-‑–—*※]|ㅇ(?:\s)|\d+[.)]|[가-힣][.)]|\(\d+\)|[①-⑳])\s*(.*)$"
    line = PLAIN_LINE.format(t=r"regexp_replace(line, '\s+$', '')")
    part = lambda k: f"regexp_extract(t, {text(bullet)}, {k})"
    bare = r"""regexp_replace(text, '"[^"\n]*"|“[^”]*”|「[^」]*」|『[^』]*』', '', 'g')"""
    n = f"length({SQUASHED.format(t=bare)})"
    ending = r"regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\d{1,2}\)$', ''), '[ .。,;:]+$', '')"
    sentence = f"regexp_matches({ending}, '(?:{fixed.SENTENCE_ENDINGS})$') AND NOT regexp_matches({ending}, '(?:{fixed.NOUN_ENDINGS})$')"
    digit = "CAST(regexp_matches(text, '[0-9]') AS INT)"
    starts = f"CAST(regexp_matches(text, {text('^(?:' + either(fixed.CHECK_CONNECTIVES) + r')[\s,]')}) AS INT)"
    parts = [
        *_head_checks(),
        f"{_row('hard', 'H3', value='d')} FROM (SELECT doc_id, max(level) AS d FROM top GROUP BY doc_id) WHERE d > 3",
        f"{_row('hard', 'H4a', value=n, line='line_no')} FROM top WHERE {n} > 120",
        f"{_row('soft', 'H4b', value=n, line='line_no')} FROM top WHERE {n} BETWEEN 91 AND 120",
        f"{_row('hard', 'H5', line='line_no')} FROM top WHERE {sentence}",
        f"{_row('soft', 'H6', value='s')} FROM (SELECT doc_id, count(*) AS k, avg({digit}) AS s FROM items WHERE level IN (2, 3) GROUP BY doc_id) WHERE k >= 4 AND s < 0.5",
        f"{_row('soft', 'H7', value='s')} FROM (SELECT doc_id, count(*) AS k, avg({starts}) AS s FROM top GROUP BY doc_id) WHERE k >= 5 AND s > 0.15",
        f"{_row('soft', 'H8', line='line_no')} FROM kids WHERE n = 1",
        f"{_row('info', 'no_items')} FROM src WHERE doc_id NOT IN (SELECT doc_id FROM items)",
        *_text_checks(limit),
    ]
    return (
        f"WITH RECURSIVE src AS (SELECT doc_id, text FROM {source})" + _HEAD
        + rf""", mk AS (SELECT doc_id, line_no, t, length(replace({part(1)}, chr(9), '  ')) AS indent, nullif(trim({part(2)}), '') AS sym, trim({part(3)}) AS body
  FROM (SELECT doc_id, line_no, {line} AS t FROM rl)),
lv AS (SELECT *, CASE WHEN sym IN ('□', '■', '☐', '▪') THEN 1 WHEN sym IN ('○', '●', '❍', 'ㅇ') THEN 2
  WHEN sym IN ('-', '‑', '–', '—', '·', '•', '・', '◦', '∙') THEN CASE WHEN indent >= 2 THEN 3 ELSE 2 END WHEN sym IN ('*', '※') THEN 4 END AS level,
  trim(t) <> '' AND sym IS NULL AND NOT regexp_matches(trim(t), '{fixed.CHECK_STOP}') AS joins FROM mk),
rn AS (SELECT *, sum(CAST(NOT joins AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM lv),
fi AS (SELECT doc_id, min(line_no) AS line_no, max(indent) FILTER (sym IS NOT NULL) AS indent, max(level) AS known, arg_min(sym, line_no) AS sym, bool_or(sym IS NOT NULL) AS opened,
  trim(string_agg(CASE WHEN sym IS NOT NULL THEN body ELSE trim(t) END, ' ' ORDER BY line_no)) AS text FROM rn GROUP BY doc_id, run HAVING opened),
nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS item_no FROM fi),
stack AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS item_no, CAST([] AS BIGINT[]) AS open_, CAST(NULL AS BIGINT) AS level FROM nu
  UNION ALL SELECT nu.doc_id, nu.item_no, CASE WHEN known IS NOT NULL THEN open_ ELSE list_append(list_filter(open_, lambda o: o < indent), indent) END,
    CASE WHEN known IS NOT NULL THEN known ELSE len(list_filter(open_, lambda o: o < indent)) + 1 END
  FROM stack JOIN nu ON nu.doc_id = stack.doc_id AND nu.item_no = stack.item_no + 1),
items AS (SELECT nu.doc_id, item_no, line_no, text, stack.level FROM nu JOIN stack USING (doc_id, item_no)),
top AS (SELECT * FROM items WHERE level < 4),
ends AS (SELECT a.doc_id, a.item_no, a.line_no, a.level, min(b.item_no) AS e FROM top a LEFT JOIN top b ON b.doc_id = a.doc_id AND b.item_no > a.item_no AND b.level <= a.level
  WHERE a.level < 3 GROUP BY ALL),
kids AS (SELECT x.doc_id, x.line_no, count(c.item_no) AS n FROM ends x LEFT JOIN top c ON c.doc_id = x.doc_id AND c.item_no > x.item_no AND c.level = x.level + 1
  AND c.item_no < coalesce(x.e, 1000000000) GROUP BY x.doc_id, x.item_no, x.line_no)
"""
        + " UNION ALL ".join(parts)
    )


def report_verdicts(source: str) -> str:
    return (
        f"WITH f AS ({report_bullets(source)}), c AS (SELECT doc_id, count(*) FILTER (severity = 'hard') AS n_hard, count(*) FILTER (severity = 'soft') AS n_soft FROM f GROUP BY doc_id)"
        f" SELECT doc_id, coalesce(n_hard, 0) AS n_hard, coalesce(n_soft, 0) AS n_soft, coalesce(n_hard, 0) = 0 AS passed FROM (SELECT doc_id FROM {source}) LEFT JOIN c USING (doc_id)"
    )


# Posts and targets


def post_targets(source: str, targets: str) -> str:
    """source: (slug, body); targets: a FROM item with (metric, level, lo, hi)."""
    starts = either((*fixed.CHECK_CONNECTIVES, "그래서", "그런데"))
    bad = either(c for c in fixed.CHECK_CONNECTIVES if c not in fixed.COMMA_CONJUNCTIONS)
    percent = lambda x: f"100.0 * avg(CAST({x} AS INT))"
    uses = lambda values: f"sum(len(regexp_extract_all(sentence, {text(either(values))})))"
    count = lambda p: f"len(regexp_extract_all(sentence, {text(p)}))"
    sentence_metrics = {
        "len_mean": "avg(len)", "pct_xlong_gt100": percent("len > 100"), "pct_short_le35": percent("len <= 35"), "pct_long_gt70": percent("len > 70"),
        "pct_hapsyo": percent("reg = '합쇼체'"), "pct_haeyo": percent("reg IN ('해요체', '-죠')"), "pct_haera": percent("reg = '해라체'"),
        "consecutive_haeyo": "count(*) FILTER (reg = '해요체' AND reg_before = '해요체')", "pct_question": percent("ends_with(sentence, '?')"),
        "pct_conj_start": percent("conj"), "conj_comma_bad": "sum(bad)", "conj_consecutive": "count(*) FILTER (conj AND conj_before)",
        "commas_per_sent": "CAST(sum(commas) AS DOUBLE) / count(*)", "pct_sent_no_comma": percent("commas = 0"),
        "pct_list_or_go_comma": "100.0 * sum(list_go) / nullif(sum(commas), 0)", "comma_after_subject": "sum(subject)",
        "ye_reul_deureo": uses(("예를 들어", "예를 들면")), "yeoreobun_dangsin": uses(("여러분", "당신")), "sensory_total": uses(fixed.SENSORY),
        "banned_total": uses(fixed.BANNED), "nonpref_total": uses(a for a, _ in fixed.SPELLING_PAIRS), "pct_contrast": percent("regexp_matches(sentence, '아니라|보다는|말고')"),
    }
    others = ("sent_per_para_mean", "pct_para_1", "closing_is_call_or_outlook", "closing_is_summary", "ai_bullet_bold")
    names = [*sentence_metrics, *others]
    tail = r"""regexp_replace(sentence, '[\s.!?…”"'')\]]+$', '')"""
    return (
        rf"""WITH po AS (SELECT slug, body, regexp_replace(body, '(?m)^(?:#|>|<!--).*$', '', 'g') AS b FROM {source}),
pa AS (SELECT slug, unnest(p) AS paragraph, unnest(range(1, len(p) + 1)) AS para_no FROM (
  SELECT slug, list_filter(list_transform(regexp_split_to_array(b, '\n[ \t\r]*\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM po)),
sn AS (SELECT slug, para_no, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS sent_no FROM (SELECT slug, para_no, {KO_SENTENCES.format(t='paragraph')} AS s FROM pa)),
f1 AS (SELECT *, length(sentence) AS len, {tail} AS s FROM sn),
f2 AS (SELECT *, CASE WHEN regexp_matches(s, '(?:니다|니까|시오)$') THEN '합쇼체' WHEN ends_with(s, '죠') THEN '-죠' WHEN ends_with(s, '요') THEN '해요체'
    WHEN ends_with(s, '다') THEN '해라체' ELSE '기타' END AS reg, regexp_matches(sentence, {text('^(?:' + starts + r')[\s,]')}) AS conj,
  length(sentence) - length(replace(sentence, ',', '')) AS commas, {count('^(?:' + bad + '),')} AS bad,
  {count('고,')} + {count('[가-힣],')} - {count('[은는이가고며면서데지만],')} AS list_go, {count('[가-힣][은는이가],')} AS subject FROM f1),
f3 AS (SELECT *, lag(reg) OVER (PARTITION BY slug, para_no ORDER BY sent_no) AS reg_before, lag(conj) OVER (PARTITION BY slug ORDER BY para_no, sent_no) AS conj_before FROM f2),
bp AS (SELECT slug, {', '.join(f'{e} AS {m}' for m, e in sentence_metrics.items())} FROM f3 GROUP BY slug),
pp AS (SELECT slug, avg(n) AS sent_per_para_mean, 100.0 * avg(CAST(n = 1 AS INT)) AS pct_para_1 FROM (SELECT slug, count(*) AS n FROM f3 GROUP BY slug, para_no) GROUP BY slug),
cl AS (SELECT slug, CAST(regexp_matches(p, '보세요|봅시다|바랍니다|좋겠습니다|것입니다|감사합니다|겠습니다|기대합니다') AS INT) AS closing_is_call_or_outlook,
  CAST(regexp_matches(p, '요약하면|정리하면|결론적으로|요약하자면|정리하자면') AS INT) AS closing_is_summary FROM (SELECT slug, arg_max(paragraph, para_no) AS p FROM pa GROUP BY slug)),
bb AS (SELECT slug, len(regexp_extract_all(body, '(?m)^\s*[-*+]\s+\*\*[^*\n]+\*\*\s?[:：]')) AS ai_bullet_bold FROM po),
al AS (SELECT * FROM bp JOIN pp USING (slug) JOIN cl USING (slug) JOIN bb USING (slug)),
v AS (SELECT slug AS doc_id, unnest({words(names)}) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in names)}]) AS value FROM al),
t AS (SELECT * FROM {targets})
SELECT doc_id, metric, value, level, lo AS min, hi AS max, NOT (coalesce(value < lo, false) OR coalesce(value > hi, false)) AS ok,
 (coalesce(value < lo, false) OR coalesce(value > hi, false)) AND level = 'hard' AS blocks FROM v JOIN t USING (metric)"""
    )


def fidelity(source: str, kinds: dict[str, str]) -> str:
    """source: (id, a, b), original and rewrite."""
    tokens = lambda c: " UNION ALL ".join(f"SELECT id, '{k}' AS kind, unnest(regexp_extract_all({c}, {text(p)})) AS token FROM s" for k, p in kinds.items())
    return (
        f"WITH s AS (SELECT * FROM {source}), x AS (SELECT id, kind, token, count(*) AS n FROM ({tokens('a')}) GROUP BY ALL),"
        f" y AS (SELECT id, kind, token, count(*) AS n FROM ({tokens('b')}) GROUP BY ALL)"
        " SELECT id, kind, token, coalesce(x.n, 0) AS n_original, coalesce(y.n, 0) AS n_result, CASE WHEN x.n IS NULL THEN 'invented' ELSE 'lost' END AS verdict"
        " FROM x FULL JOIN y USING (id, kind, token) WHERE x.n IS NULL OR coalesce(y.n, 0) < x.n"
    )


def delegated(source: str, targets: str, metrics: dict[str, tuple[str, ...]], terms: dict[str, str]) -> str:
    """source: (doc_id, text). The delegated rules over the SQL of the targets and of the word lists."""
    cases = " ".join(f"WHEN metric = '{m}' THEN '{r}'" for r, names in metrics.items() for m in names)
    rule, name = next(iter(terms.items()))
    posts = post_targets(f"(SELECT doc_id AS slug, text AS body FROM {source})", targets)
    words_sql = _terms(name, [(p, p) for p in fixed.TRANSLATED], None)
    return (
        f"WITH src AS (SELECT doc_id, text FROM {source}), x AS (SELECT doc_id, CASE {cases} END AS rule_id, 1.0 AS value FROM ({posts}) WHERE NOT ok"
        f" UNION ALL SELECT doc_id, '{rule}', value FROM ({words_sql}))"
        " SELECT doc_id, rule_id, 'S2' AS severity, CAST(sum(value) AS BIGINT) AS n FROM x WHERE rule_id IS NOT NULL GROUP BY doc_id, rule_id"
    )


def _profile(source: str) -> str:
    """source: (corpus, text). CTEs so (texts), pa (paragraphs) and sn (sentences s, their end e)."""
    return rf"""WITH so AS (SELECT corpus, text, row_number() OVER () AS id FROM {source}),
pa AS (SELECT corpus, id, unnest(p) AS paragraph, unnest(range(1, len(p) + 1)) AS para_no FROM (
  SELECT corpus, id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM so)),
sn AS (SELECT corpus, s, regexp_replace(s, '[\s.!?…”"'')\]]+$', '') AS e FROM (SELECT corpus, unnest({KO_SENTENCES.format(t='paragraph')}) AS s FROM pa))"""


REGISTER = """CASE WHEN regexp_matches(e, '(?:니다|니까|시오)$') THEN '합쇼체' WHEN ends_with(e, '죠') THEN '-죠' WHEN ends_with(e, '요') THEN '해요체'
 WHEN ends_with(e, '다') THEN '해라체' ELSE '기타' END"""


def _shares(name: str, rows: str) -> str:
    return f"SELECT corpus, {name}, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY corpus) AS pct FROM ({rows}) GROUP BY corpus, {name}"


def sentence_profile(source: str) -> str:
    share = lambda x: f"100.0 * avg(CAST({x} AS INT))"
    count = lambda p: f"CAST(sum(len(regexp_extract_all(s, {text(p)}))) AS BIGINT)"
    has = lambda p: f"regexp_matches(s, {text(p)})"
    columns = {
        "n_sentences": "count(*)", "pct_think": share("ends_with(e, '생각합니다')"), "pct_seem": share("ends_with(e, '것 같습니다')"), "pct_will": share("ends_with(e, '것입니다')"),
        "pct_humble_start": share(has(fixed.HUMBLE_START)), "pct_plain_self": share(has(fixed.PLAIN_SELF)), "n_mixed_self": f"count(*) FILTER ({has(fixed.HUMBLE)} AND {has(fixed.PLAIN_SELF)})",
        "n_parentheses": count("[(（]"), "n_slashes": count("/"), "n_glosses": count(fixed.GLOSS), "n_exclamations": count("!"),
        "n_through": count("통해"), "pct_through": share("contains(s, '통해')"),
    }
    return _profile(source) + " SELECT corpus, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM sn GROUP BY corpus"


def paragraph_profile(source: str) -> str:
    return _profile(source) + " SELECT corpus, count(*) AS n_paragraphs, 100.0 * avg(CAST(regexp_matches(paragraph, '[(（]') AS INT)) AS pct_parentheses, " + f"CAST(sum(len(regexp_extract_all(paragraph, {text(fixed.EMOTICON)}))) AS BIGINT) AS n_emoticons FROM pa GROUP BY corpus"


def ending_tails(source: str) -> str:
    tails = " ".join(f"WHEN ends_with(e, {text(t)}) THEN {text(t)}" for t in sorted(fixed.ENDING_TAILS, key=lambda t: (-len(t), t)))
    return _profile(source) + " " + _shares("tail_class", f"SELECT corpus, {REGISTER} || ':' || CASE {tails} ELSE '' END AS tail_class FROM sn")


def comma_positions(source: str) -> str:
    conjunctions = ", ".join(text(c) for c in (*fixed.CONNECTIVES, "그리고", "하지만", "그래서"))
    tails = " ".join(f"WHEN ends_with(w, '{t}') THEN '-{t}'" for t in ("고", "나", "지만", "며", "면", "서", "데", "도", "니"))
    position = f"""CASE WHEN w IN ({conjunctions}) THEN '접속부사 뒤' {tails} WHEN regexp_matches(w, '[은는이가]$') THEN '주어 뒤'
 WHEN regexp_matches(w, {text(fixed.LISTED)}) THEN '나열' ELSE '기타' END"""
    return _profile(source) + " " + _shares("position", rf"SELECT corpus, {position} AS position FROM (SELECT corpus, unnest(regexp_extract_all(s, '([^\s,]+),', 1)) AS w FROM sn)")


def _used(term: str) -> str:
    return f"coalesce(CAST(sum((length(text) - length(replace(text, {term}, ''))) // length({term})) AS BIGINT), 0)"


def word_lists(source: str, lists: dict[str, tuple[str, ...]]) -> str:
    rows = ", ".join(f"({text(kind)}, {text(term)})" for kind, terms in lists.items() for term in terms)
    return f"SELECT corpus, kind, term, {_used('term')} AS n FROM {source}, (VALUES {rows}) AS l(kind, term) GROUP BY corpus, kind, term"


def spelling_preferences(source: str) -> str:
    rows = ", ".join(f"({text(a)}, {text(s)})" for a, s in fixed.SPELLING_VARIANTS)
    return f"""SELECT *, CASE WHEN n_author + n_standard < 2 OR n_author = n_standard THEN '혼용' WHEN n_author > n_standard THEN author ELSE standard END AS preferred FROM (
 SELECT corpus, author, standard, {_used('author')} AS n_author, {_used('standard')} AS n_standard FROM {source}, (VALUES {rows}) AS l(author, standard) GROUP BY corpus, author, standard)
WHERE n_author + n_standard > 0"""


def openings_and_closings(source: str) -> str:
    return rf"""WITH b AS (SELECT corpus, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '(?m)^(?:#|>|<!--).*$', '', 'g'), '\n[ \t\r]*\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {source}),
e AS (SELECT corpus, p[1] AS f, p[-1] AS l FROM b WHERE len(p) > 0),
k AS (SELECT corpus, 'opening' AS part, CASE WHEN regexp_matches(f, '안녕하세요|저는|제가') THEN '이력/인사' WHEN contains(f, '?') THEN '질문'
   WHEN regexp_matches(f, '이란|란|의미합니다|뜻합니다') THEN '정의' ELSE '배경/기타' END AS kind FROM e
 UNION ALL SELECT corpus, 'closing', 'call_or_outlook' FROM e WHERE regexp_matches(l, '보세요|봅시다|바랍니다|좋겠습니다|것입니다|감사합니다|겠습니다|기대합니다')
 UNION ALL SELECT corpus, 'closing', 'summary' FROM e WHERE regexp_matches(l, '요약하면|정리하면|결론적으로|요약하자면|정리하자면'))
SELECT corpus, part, kind, count(*) AS n FROM k GROUP BY ALL"""


def heading_kinds(source: str) -> str:
    ends = {"declarative": r"regexp_matches(h, '다\.?$')", "imperative": r"regexp_matches(h, '(?:라|세요|시오|자)\.?$')", "question": r"regexp_matches(h, '\?$|까$')"}
    flags = {"noun_phrase": f"NOT ({' OR '.join(ends.values())})", **ends, "numbered": r"regexp_matches(h, '^\(?[0-9]')"}
    heads = rf"WITH h AS (SELECT corpus, trim(unnest(regexp_extract_all(text, '(?m)^#{{1,6}}[ \t]+([^\n]*)$', 1))) AS h FROM {source})"
    return heads + " UNION ALL ".join(
        f" SELECT corpus, '{k}' AS kind, count(*) FILTER ({c}) AS n, 100.0 * count(*) FILTER ({c}) / count(*) AS pct FROM h GROUP BY corpus" for k, c in flags.items()
    )
