"""Rules as data: the rule table and its evaluation over segments, all documents at once.

Every executable rule becomes a literal expression of one projection, so a segment is read once
and each pattern is compiled once per task; rules are not joined as rows, which would compile a
pattern per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import needles as N
from ..functions import textprims as T
from ..functions.rule_table import TABLE
from ..sources.markdown_table import table_cells

LAST = "마지막 세그먼트"
COMMON = "공통"
CELL_SEPARATOR = " · "
#: Characters up to which a sentence is short, and how many in a row make a run; not published.
SHORT, SHORT_RUN = 12, 3


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    name: str
    severity: str
    detector: str
    scope: tuple[str, ...]
    genre: str
    expression: str
    exception: str
    threshold: int | None
    unit: str | None

    @property
    def skips_last(self) -> bool:
        return LAST in self.exception

    @property
    def exception_pattern(self) -> str:
        parts = [p for p in self.exception.split(CELL_SEPARATOR) if p.strip() and p.strip() != LAST]
        return "|".join(p.strip().strip("`") for p in parts)

    @property
    def pattern(self) -> str:
        """The expression as a pattern: literals are quoted, alternatives joined."""
        cell = self.expression
        if cell.startswith("`") and cell.endswith("`"):
            return cell[1:-1]
        return "|".join(re.escape(x.strip()) for x in cell.split(CELL_SEPARATOR) if x.strip())


def load_rules(text: str = TABLE) -> list[Rule]:
    """Rules of a Markdown table; rows whose first cell is not an id are left out."""
    found = []
    for cells in table_cells(text):
        if len(cells) < 10 or not re.fullmatch(r"[A-Z]+-\d+", cells[0]):
            continue
        limit = re.match(r"(\d+)\s*/?\s*(.*)", cells[9])
        found.append(Rule(
            *cells[:5], tuple(s.strip() for s in cells[5].split(",")), cells[6], cells[7], cells[8],
            int(limit[1]) if limit else None, (limit[2] or None) if limit else None,
        ))
    return found


def _java(pattern: str) -> str:
    """Unicode classes and line anchors, as the rules' dialect has them."""
    return f"(?mU){pattern}"


#: Where the sentences of a segment end.
SENTENCE_END = r"(?<=[.!?])\s+|\n"


def _hits(rule: Rule) -> str:
    """SQL: matches of a rule in a segment, sentence by sentence where an exception may excuse one."""
    pattern = T.quoted(_java(rule.pattern))
    count = f"regexp_count(text, {pattern})"
    if rule.exception_pattern:
        kept = f"filter(split(text, {T.quoted(SENTENCE_END)}), s -> NOT regexp_like(s, {T.quoted(_java(rule.exception_pattern))}))"
        count = f"aggregate({kept}, 0, (a, s) -> a + regexp_count(s, {pattern}))"
    if rule.skips_last:
        count = f"CASE WHEN is_last THEN 0 ELSE {count} END"
    least = N.needles(rule.pattern)
    met = f" AND {N.guard('text', least)}" if least else ""
    return f"CASE WHEN kind IN ({', '.join(map(T.quoted, rule.scope))}){met} THEN {count} ELSE 0 END"


def rule_hits(segments: DataFrame, rules: list[Rule], genre: str | None = None) -> DataFrame:
    """(doc_id, seg_no, rule_id, n) for regex, literal and density rules; genre None takes all.

    A pattern runs only over segments that contain a string which its matches must contain, and
    segments without a character of any such string meet no rule.
    """
    run = [r for r in rules if r.detector in ("regex", "literal", "density") and (genre is None or r.genre in (COMMON, genre))]
    if not run:
        return segments.select("doc_id", "seg_no", "text", F.lit("").alias("rule_id"), F.lit(0).alias("n")).limit(0)
    cells = ", ".join(f"struct({T.quoted(r.id)} AS rule_id, {_hits(r)} AS n)" for r in run)
    least = [N.needles(r.pattern) for r in run]
    if all(least):
        segments = segments.where(F.col("text").rlike(N.screen([x for found in least for x in found])))
    return segments.select("doc_id", "seg_no", "text", F.expr(f"explode(array({cells})) AS h")).select("doc_id", "seg_no", "text", "h.rule_id", "h.n").where("n > 0")


def _limits(rules: list[Rule]) -> tuple[Column, Column, Column]:
    def of_rule(value) -> Column:
        return F.expr(f"element_at(map({', '.join(f'{T.quoted(r.id)}, {value(r)}' for r in rules)}), rule_id)")

    return of_rule(lambda r: T.quoted(r.severity)), of_rule(lambda r: r.threshold or 1), of_rule(lambda r: T.quoted(r.unit or "문서"))


def findings(segments: DataFrame, rules: list[Rule] | None = None, genre: str | None = None) -> DataFrame:
    """(doc_id, rule_id, severity, unit, unit_no, n): S1 a row a segment with matches, S2 and S3 a row
    a unit whose count reaches the threshold. Structure rules are included."""
    rules = load_rules() if rules is None else rules
    hits = rule_hits(segments, rules, genre)
    if not rules:
        return structure_findings(segments, rules, genre)
    severity, least, unit = _limits(rules)
    marked = hits.withColumns({"severity": severity, "least": least, "unit": unit})
    # Sentence units need the counts of each sentence; only rules of that unit are split.
    by_sentence = {r.id: r.pattern for r in rules if r.unit == "문장" and r.detector in ("regex", "literal", "density")}
    most = F.lit(0)
    for rule_id, pattern in by_sentence.items():
        most = F.when(F.col("rule_id") == rule_id, F.array_max(_sentence_counts(pattern))).otherwise(most)
    n = F.when(F.col("unit") == "문장", most).otherwise(F.col("n"))
    unit_no = F.when(F.col("unit") == "문서", 0).otherwise(F.col("seg_no"))
    unit_no = F.when(F.col("severity") == "S1", F.col("seg_no")).otherwise(unit_no)
    counted = marked.withColumns({"n": n, "unit_no": unit_no}).groupBy("doc_id", "rule_id", "severity", "unit", "unit_no", "least").agg(F.sum("n").alias("n"))
    plain = counted.where((F.col("severity") == "S1") | (F.col("n") >= F.col("least"))).drop("least")
    extra = structure_findings(segments, rules, genre)
    return plain.unionByName(extra)


def _sentence_counts(pattern: str) -> Column:
    return F.transform(F.split("text", SENTENCE_END), lambda s: F.regexp_count(s, F.lit(_java(pattern))))


# Structure detectors: key -> rule -> array of (unit_no, n) of a document, whose segments in their
# order are the array segs.

_HITS = "array<struct<unit_no:int,n:bigint>>"


def _hit(unit_no: Column, n: Column) -> Column:
    return F.struct(unit_no.cast("int").alias("unit_no"), n.cast("bigint").alias("n"))


def _if(condition: Column, n: Column, unit_no: Column | None = None) -> Column:
    """One hit where a condition holds, else none."""
    return F.when(condition, F.array(_hit(F.lit(0) if unit_no is None else unit_no, n))).otherwise(F.array().cast(_HITS))


def _segments(*kinds: str) -> Column:
    return F.filter("segs", lambda s: s["kind"].isin(*kinds))


def _sentences(text: Column, newline: bool = False) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n" if newline else r"(?<=[.!?])\s+"), lambda s: s != "")


def triad_lists(rule: Rule) -> Column:
    kinds = F.array_join(F.transform("segs", lambda s: F.when(s["kind"] == "list", "l").otherwise("-")), "")
    lists = F.regexp_extract_all(kinds, F.lit("l+"), F.lit(0))
    return _if((F.size(lists) >= (rule.threshold or 3)) & F.forall(lists, lambda x: F.length(x) == 3), F.size(lists))


def short_run(rule: Rule) -> Column:
    def longest(text: Column) -> Column:
        runs = F.array_join(F.transform(_sentences(text, True), lambda s: F.when(T.nospace_len(s) <= SHORT, "s").otherwise("-")), "")
        return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(runs, F.lit("s+"), F.lit(0)), F.length)), F.lit(0))

    return F.filter(F.transform(_segments("prose"), lambda s: _hit(s["seg_no"], longest(s["text"]))), lambda h: h["n"] >= SHORT_RUN)


def closing_kicker(rule: Rule) -> Column:
    end = F.try_element_at(_segments("prose"), F.lit(-1))
    text = end["text"]
    return _if((F.size(_sentences(text)) == 1) & (F.length(text) <= (rule.threshold or 40)) & ~T.has_digit(text), F.lit(1), end["seg_no"])


def bold_label_run(rule: Rule) -> Column:
    bold = r"^\*\*[^*\n]{1,40}\*\*\s?[:：]|^\*\*[^*\n]{1,40}[:：]\*\*"
    marks = F.array_join(F.transform("segs", lambda s: F.when((s["kind"] == "list") & s["text"].rlike(bold), "B").otherwise("-")), "")
    starts = F.filter(F.sequence(F.lit(1), F.length(marks)), lambda i: (F.substr(marks, i, F.lit(1)) == "B") & ((i == 1) | (F.substr(marks, i - 1, F.lit(1)) != "B")))
    sized = F.transform(starts, lambda i: _hit(F.element_at("segs", i)["seg_no"], F.length(F.regexp_extract(F.substr(marks, i), "^B+", 0))))
    return F.filter(sized, lambda h: h["n"] >= (rule.threshold or 3))


def emoji(rule: Rule) -> Column:
    used = _segments(*rule.scope)
    if rule.skips_last:
        used = F.filter(used, lambda s: ~s["is_last"])
    n = F.aggregate(used, F.lit(0), lambda a, s: a + T.emoji_count(s["text"]))
    return _if(n >= (rule.threshold or 1), n)


def heading_echo(rule: Rule) -> Column:
    def echo(head: Column, body: Column) -> Column:
        first = F.split(body["text"], r"(?<=[.!?])\s+|\n")[0]
        words = F.array_distinct(T.tokens(head["text"]))
        said = F.forall(words, lambda x: F.contains(first, x)) & (F.size(words) > 0)
        hit = (head["kind"] == "heading") & body["kind"].isin("prose", "list") & (F.length(first) <= (rule.threshold or 40)) & said
        return F.when(hit, _hit(head["seg_no"], F.lit(1)))

    n = F.size("segs") - 1
    return F.array_compact(F.zip_with(F.slice("segs", 1, n), F.slice("segs", 2, n), echo))


def para_closer(rule: Rule) -> Column:
    prose = _segments("prose")
    rest = F.slice(prose, F.lit(1), F.greatest(F.size(prose) - 1, F.lit(0)))
    closes = lambda s: F.try_element_at(_sentences(s["text"]), F.lit(-1)).rlike("^(?:결국|이처럼|이렇게|요컨대|즉)")
    n = F.size(F.filter(rest, closes))
    return _if((n > 0) & (n * 100 >= F.size(rest) * (rule.threshold or 50)), n)


def _end_pattern(last: bool):
    def run(rule: Rule) -> Column:
        pattern = _java(rule.pattern.split("::", 1)[1].strip())
        n = F.regexp_count(F.try_element_at(_segments("prose", "list"), F.lit(-1 if last else 1))["text"], F.lit(pattern))
        return _if(n >= (rule.threshold or 1), n)

    return run


STRUCTURES = {
    "triad_lists": triad_lists,
    "short_run": short_run,
    "closing_kicker": closing_kicker,
    "bold_label_run": bold_label_run,
    "emoji": emoji,
    "heading_echo": heading_echo,
    "para_closer": para_closer,
    "opening_platitude": _end_pattern(False),
    "closing_moral": _end_pattern(True),
}


def _named(rule: Rule, hits: Column) -> Column:
    names = [F.lit(v).alias(c) for c, v in (("rule_id", rule.id), ("severity", rule.severity), ("unit", rule.unit or "문서"))]
    return F.transform(hits, lambda h: F.struct(*names, h["unit_no"].alias("unit_no"), h["n"].alias("n")))


def structure_findings(segments: DataFrame, rules: list[Rule], genre: str | None = None) -> DataFrame:
    """Findings of the structure rules: segments are gathered once a document, and all detectors are
    expressions over that row."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", "kind", "text", "is_last")))
    docs = segments.groupBy("doc_id").agg(ordered.alias("segs"))
    found = []
    for r in rules:
        key = r.pattern.split("::", 1)[0].strip()
        if r.detector != "structure" or key not in STRUCTURES or (genre is not None and r.genre not in (COMMON, genre)):
            continue
        found.append(_named(r, STRUCTURES[key](r)))
    if not found:
        return docs.select("doc_id", F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.lit("").alias("unit"), F.lit(0).alias("unit_no"), F.lit(0).cast("long").alias("n")).limit(0)
    return docs.select("doc_id", F.inline(F.concat(*found)))


def verdicts(found: DataFrame, docs: DataFrame, strict: tuple[str, ...] = ("S1", "S2")) -> DataFrame:
    """(doc_id, passed): documents without findings of the blocking severities."""
    blocked = found.where(F.col("severity").isin(*strict)).select("doc_id").distinct().withColumn("blocked", F.lit(True))
    return docs.select("doc_id").join(blocked, "doc_id", "left").select("doc_id", F.col("blocked").isNull().alias("passed"))
