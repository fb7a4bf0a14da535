"""Acceptance of a rewritten text: all checkers at once, and the verification of a style kit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import textprims as T
from . import fidelity, report_check, rules, segments, targets

SCHEMA = ("doc_id", "checker", "rule_id", "severity", "blocks", "value")

#: Words that say that data are missing; this engine's choice.
ABSENCE = r"자료가 없|확인되지 않|알 수 없|공개되지 않|파악되지 않|집계되지 않"


def fill_after_absence(docs: DataFrame, within: int = 2) -> DataFrame:
    """(doc_id, sent_no): sentences with a figure soon after one that says there are no data."""
    sents = docs.select("doc_id", F.posexplode(T.ko_sentences("text")).alias("sent_no", "s"))
    w = Window.partitionBy("doc_id").orderBy("sent_no").rowsBetween(-within, -1)
    missing = F.coalesce(F.max(F.col("s").rlike(ABSENCE)).over(w), F.lit(False))
    return sents.withColumn("after", missing).where(F.col("after") & T.has_digit("s")).select("doc_id", "sent_no")


#: Rules that are delegated: the targets, or the report checker's rule, that decide them.
DELEGATED = {"AT-40": ("pct_conj_start",), "AT-42": ("pct_short_le35", "pct_long_gt70", "sent_per_para_mean", "pct_para_1")}
DELEGATED_TERMS = {"AT-41": "S1c"}


def delegated(docs: DataFrame) -> DataFrame:
    """(doc_id, rule_id, severity, n) of the delegated rules for docs (doc_id, text): n counts the
    targets of a rule that are missed, or the uses of its expressions."""
    metrics = targets.unpivot(targets.post_metrics(docs, "doc_id", "text"))
    missed = targets.evaluate(metrics, targets.published_targets(docs.sparkSession)).where("not ok")
    cases = " ".join(f"WHEN {T.quoted(m)} THEN {T.quoted(r)}" for r, names in DELEGATED.items() for m in names)
    by_target = missed.select("doc_id", F.expr(f"CASE metric {cases} END").alias("rule_id"), F.lit(1.0).alias("value"))
    cases = " ".join(f"WHEN {T.quoted(name)} THEN {T.quoted(r)}" for r, name in DELEGATED_TERMS.items())
    by_term = report_check.text_checks(docs).select("doc_id", F.expr(f"CASE rule_id {cases} END").alias("rule_id"), "value")
    found = by_target.unionByName(by_term).where("rule_id is not null").groupBy("doc_id", "rule_id").agg(F.sum("value").cast("long").alias("n"))
    return found.select("doc_id", "rule_id", F.lit("S2").alias("severity"), "n")


def check_all(docs: DataFrame, original: DataFrame | None = None, genre: str = "줄글", report: bool = False) -> DataFrame:
    """Findings (doc_id, checker, rule_id, severity, blocks, value) of every checker for docs (doc_id, text).

    report adds the bullet checks of reports, original (doc_id, text) the comparison with it. What
    blocks: hard findings, S1 and S2 rules, invented numbers, quotations and marks.
    """
    def rows(df: DataFrame, checker: str, rule, severity, blocks, value) -> DataFrame:
        return df.select("doc_id", F.lit(checker).alias("checker"), rule.alias("rule_id"), severity.alias("severity"), blocks.alias("blocks"), value.cast("double").alias("value"))

    found = rules.findings(segments.segments(docs), genre=genre)
    out = rows(found, "rules", F.col("rule_id"), F.col("severity"), F.col("severity").isin("S1", "S2"), F.col("n"))
    if report:
        r = report_check.check_reports(docs)
        out = out.unionByName(rows(r, "report", F.col("rule_id"), F.col("severity"), F.col("severity") == "hard", F.col("value")))
    else:
        metrics = targets.unpivot(targets.post_metrics(docs, "doc_id", "text"))
        spark = docs.sparkSession
        t = targets.evaluate(metrics, targets.published_targets(spark)).where("not ok")
        out = out.unionByName(rows(t, "targets", F.col("metric"), F.col("level"), F.col("blocks"), F.col("value")))
    if original is not None:
        c = fidelity.compare(original, docs, "doc_id").withColumnRenamed("id", "doc_id")
        blocks = F.col("verdict") == "invented"
        out = out.unionByName(rows(c, "original", F.concat_ws(":", "kind", "token"), F.col("verdict"), blocks, F.col("n_result")))
        lost = fidelity.lost_negations(original, docs, "doc_id").where("lost > 0").withColumnRenamed("id", "doc_id")
        out = out.unionByName(rows(lost, "original", F.lit("negation"), F.lit("lost"), F.lit(False), F.col("lost")))
    return out.select(*SCHEMA)


def accepted(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, n_blocking, accepted); a text without blocking findings needs small edits only."""
    n = findings.groupBy("doc_id").agg(F.count_if("blocks").alias("n_blocking"))
    return docs.select("doc_id").join(n, "doc_id", "left").na.fill(0).withColumn("accepted", F.col("n_blocking") == 0)


_SLOT = re.compile(r"\{\{(?:(n|one_in|ratio):)?([^{}]+)\}\}")


def render(template: str, numbers: dict[str, float], texts: dict[str, str] | None = None) -> str:
    """A guide from its template: {{n:metric}}, {{one_in:percent}}, {{ratio:a/b}} and {{name}} slots.

    An unknown slot raises a KeyError, so a rendered guide never holds an open one.
    """
    def shown(x: float) -> str:
        return f"{x:.1f}".removesuffix(".0")

    def fill(m: re.Match) -> str:
        kind, name = m[1], m[2].strip()
        if kind == "n":
            return shown(numbers[name])
        if kind == "one_in":
            return shown(round(100 / numbers[name])) if numbers[name] else "0"
        if kind == "ratio":
            a, b = name.split("/")
            return shown(numbers[a.strip()] / numbers[b.strip()])
        return (texts or {})[name]

    return _SLOT.sub(fill, template)


def verify_kit(posts: DataFrame, control: DataFrame, quotes: DataFrame, least_control: int = 5) -> DataFrame:
    """(check, ok): the corpus passes its own hard targets, the control fails, quotations exist."""
    spark = posts.sparkSession
    table = targets.published_targets(spark)

    def blocked(df: DataFrame) -> DataFrame:
        return targets.evaluate(targets.unpivot(targets.post_metrics(df, "doc_id", "text")), table).where("blocks")

    corpus = blocked(posts).agg((F.count("*") == 0).alias("ok")).select(F.lit("corpus_passes").alias("check"), "ok")
    failing = blocked(control).agg((F.count("*") >= least_control).alias("ok")).select(F.lit("control_fails").alias("check"), "ok")
    present = fidelity.missing_quotes(quotes, posts).agg((F.count("*") == 0).alias("ok")).select(F.lit("quotes_exist").alias("check"), "ok")
    return corpus.unionByName(failing).unionByName(present)
